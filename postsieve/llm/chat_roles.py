"""Minimum-cost role repair of conversations.

A legal conversation is an optional system turn, then user and assistant turns in alternation, user first, ended by an
assistant turn. For each conversation dynamic programming over this automaton finds the cheapest edit: keep a turn, merge
it into the turn before it (which must end up with the same role), give it another role, or insert an empty turn.

The automaton has four states, so what a run of turns does to the costs is a 4 x 4 table in min-plus algebra, and tables
of consecutive runs combine. All turns are range-sorted by conversation and turn into bounded chunks; each chunk gives its
table, a conversation's tables fix the states at its chunk borders, and each chunk then traces its own turns. A conversation
with a third of all turns is thus many chunks, never one task. A turn's piece of the rendering is made where the turn is, so a
conversation's rendering is the pieces in order and no piece is longer than its turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postsieve.llm.shared import written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, last turn by system, user, assistant. Roles are states 1 to 3.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: A relabelled turn puts words into another mouth, so it costs more than a merge and an empty turn together.
COSTS = {"merge": 1.0, "relabel": 4.0, "insert": 2.0}
CHUNK = 2048
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def insertions(cost: float) -> np.ndarray:
    """Cheapest cost of empty turns that lead from one state to another."""
    d = np.full((4, 4), np.inf)
    np.fill_diagonal(d, 0)
    for a, nexts in LEGAL.items():
        for b in nexts:
            d[a, b] = cost
    for k in range(4):
        d = np.minimum(d, d[:, k, None] + d[None, k, :])
    return d


def inserted(a: int, b: int) -> list[int]:
    """The roles of those turns: the shortest legal way, smallest states first."""
    level, back = [a], {a: None}
    while b not in back:
        level = [y for x in level for y in LEGAL[x] if y not in back and not back.update({y: x})]
    way = []
    while b != a:
        way.append(b)
        b = back[b]
    return way[::-1]


def step_table(role: int, costs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one turn: cost from state to state, the state before the turn itself (after insertions), and whether it merges.

    Ties: fewer changes of the turn first (keep, then merge, then relabel), then smaller states.
    """
    ins = insertions(costs["insert"])
    best, mid, merged = np.full((4, 4), np.inf), np.zeros((4, 4), np.int64), np.zeros((4, 4), bool)
    for b in (SYSTEM, USER, ASSISTANT):
        change = 0.0 if b == role else costs["relabel"]
        for a in range(4):
            for m in range(4):
                if b in LEGAL[m] and ins[a, m] + change < best[a, b]:
                    best[a, b], mid[a, b], merged[a, b] = ins[a, m] + change, m, False
            if a == b and costs["merge"] + change < best[a, b]:
                best[a, b], mid[a, b], merged[a, b] = costs["merge"] + change, a, True
    return best, mid, merged


def chunk_table(roles: np.ndarray, steps: list) -> np.ndarray:
    total = np.where(np.eye(4) > 0, 0, np.inf)
    for r in roles:
        total = (total[:, :, None] + steps[r][0][None]).min(1)
    return total


def trace(roles: np.ndarray, steps: list, start: int, end: int) -> list[tuple[int, int, bool]]:
    """(state before, role, merged) of each turn on the cheapest way from start to end."""
    cost = np.full(4, np.inf)
    cost[start], back = 0, []
    for r in roles:
        ways = cost[:, None] + steps[r][0]
        back.append(ways.argmin(0))
        cost = ways.min(0)
    out, state = [], end
    for r, b in zip(roles[::-1], back[::-1]):
        before = int(b[state])
        out.append((before, state, bool(steps[r][2][before, state])))
        state = before
    return out[::-1]


def close(cost: np.ndarray, costs: dict) -> int:
    """The state to end in, before the empty turns that lead to an assistant turn."""
    return int((cost + insertions(costs["insert"])[:, ASSISTANT]).argmin())


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: dict | None = None) -> DataFrame:
    """Rows (key, pos, turn, role, action, piece): every turn and every inserted one, in the order of pos.

    action: keep, relabel, merge, merge+relabel or insert (turn null, empty text). piece is the turn's part of the rendering:
    a role line when it opens a turn, its text, an end line when it closes one; merged texts are joined by a line end.
    pos orders all rows, conversation by conversation. Turns are ordered by number, nulls first, then role and text, so ties and
    repeated rows have a fixed order. A null key is a conversation of its own. Roles compare in lower case without outer blanks;
    a null or unknown role must be relabelled. Null and empty texts are empty turns. Other columns are not read; an empty table
    gives no rows.
    """
    costs = {**COSTS, **(costs or {})}
    steps = [step_table(r, costs) for r in range(4)]  # 0: a role that is none of ROLES
    kind, number = turns.schema[key].dataType.simpleString(), turns.schema[turn].dataType.simpleString()
    said = F.lower(F.trim(F.coalesce(F.col(role), F.lit(""))))
    rows = turns.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), (F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), said), F.lit(0))).cast("int").alias("said"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "conv", "turn", "said", "text").sortWithinPartitions("conv", "turn", "said", "text").withColumn("pos", F.monotonically_increasing_id())
    rows = written(rows.withColumn("chunk", F.shiftright("pos", int(np.log2(CHUNK)))), "turns")

    def sorted_runs(t: pa.Table):
        """The chunk's rows in order, and where each conversation's run begins and ends in it."""
        t = t.take(pa.array(np.argsort(t.column("pos").to_numpy())))
        convs = t.column("conv").to_pylist()
        cuts = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
        return t, list(zip(cuts, cuts[1:]))

    def table(t: pa.Table) -> pa.Table:
        t, runs = sorted_runs(t)
        roles = t.column("said").to_numpy()
        first = pa.array([a for a, _ in runs], pa.int64())
        return pa.table({"conv": t.column("conv").take(first), "chunk": t.column("chunk").take(first), "costs": pa.array([chunk_table(roles[a:b], steps).ravel().tolist() for a, b in runs], pa.list_(pa.float64()))})

    tables = written(rows.groupBy("chunk").applyInArrow(table, f"conv {kind}, chunk long, costs array<double>"), "tables")

    def borders(t: pa.Table) -> pa.Table:
        turn_ = np.argsort(t.column("chunk").to_numpy())
        each = np.array(t.column("costs").to_pylist()).reshape(-1, 4, 4)[turn_]
        cost, back = np.array([0, np.inf, np.inf, np.inf]), []
        for c in each:
            ways = cost[:, None] + c
            back.append(ways.argmin(0))
            cost = ways.min(0)
        ends = [close(cost, costs)]
        for b in back[::-1]:
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        return pa.table({"conv": t.column("conv").take(pa.array(turn_)), "chunk": t.column("chunk").take(pa.array(turn_)), "a": pa.array(ends[:-1], pa.int32()), "b": pa.array(ends[1:], pa.int32()),
                         "last": pa.array([i == len(each) - 1 for i in range(len(each))])})

    # only conversations of several chunks need their borders fixed; one row of 16 numbers per 2048 turns meets there
    several = tables.groupBy("conv").agg(F.count("*").alias("chunks")).where("chunks > 1").select(F.col("conv").alias("c"))
    several = tables.join(several, tables.conv.eqNullSafe(F.col("c")), "left_semi")
    fixed = written(several.groupBy("conv").applyInArrow(borders, f"conv {kind}, chunk long, a int, b int, last boolean"), "borders")
    fixed = fixed.withColumnRenamed("conv", "c").withColumnRenamed("chunk", "k")

    def render(roles: np.ndarray, texts: list[str], pos: np.ndarray, start: int, end: int | None, last: bool) -> list[tuple]:
        """(place, row, role, action, piece) for one run of a conversation."""
        if end is None:
            end = close(chunk_table(roles, steps)[start], costs)
        out, way = [], trace(roles, steps, start, end)
        opened = start != START
        empty = lambda r: (CLOSE if opened else "") + OPEN.format(ROLES[r - 1])
        for i, (before, state, merged) in enumerate(way):
            mid = int(steps[roles[i]][1][before, state])
            for j, r in enumerate(inserted(before, mid) if not merged else []):
                out.append((int(pos[i]) * 16 + j, None, r, "insert", empty(r)))
                opened = True
            action = "+".join(filter(None, ["merge" if merged else "", "relabel" if state != roles[i] else ""])) or "keep"
            out.append((int(pos[i]) * 16 + 8, i, state, action, ("" if merged else empty(state)) + texts[i] + "\n"))
            opened = True
        if last:
            for j, r in enumerate(inserted(end, ASSISTANT)):
                out.append((int(pos[-1]) * 16 + 9 + j, None, r, "insert", empty(r)))
            out[-1] = (*out[-1][:4], out[-1][4] + CLOSE)
        return out

    def pieces(t: pa.Table) -> pa.Table:
        t, runs = sorted_runs(t)
        roles, texts, pos = t.column("said").to_numpy(), t.column("text").to_pylist(), t.column("pos").to_numpy()
        fixed_a, fixed_b, lasts, out = t.column("a").to_pylist(), t.column("b").to_pylist(), t.column("last").to_pylist(), []
        for a, b in runs:
            alone = fixed_a[a] is None
            rows_ = render(roles[a:b], texts[a:b], pos[a:b], START if alone else fixed_a[a], fixed_b[a], alone or lasts[a])
            out += [(a, at, None if i is None else a + i, r, action, piece) for at, i, r, action, piece in rows_]
        return pa.table({"conv": t.column("conv").take(pa.array([o[0] for o in out], pa.int64())), "at": pa.array([o[1] for o in out], pa.int64()), "turn": t.column("turn").take(pa.array([o[2] for o in out], pa.int64())),
                         "role": pa.array([ROLES[o[3] - 1] for o in out], pa.string()), "action": pa.array([o[4] for o in out], pa.string()), "piece": pa.array([o[5] for o in out], pa.string())})

    joined = rows.join(fixed, rows.conv.eqNullSafe(fixed.c) & (rows.chunk == fixed.k), "left").drop("c", "k")
    done = joined.groupBy("chunk").applyInArrow(pieces, f"conv {kind}, at long, turn {number}, role string, action string, piece string")
    return done.select(F.col("conv").alias(key), F.col("at").alias("pos"), F.col("turn").alias(turn), "role", "action", "piece")
