"""Readings that follow their predecessors, reckoned in chunks.

Which readings of a run are kept depends on the last one kept, and the smoothed rate on the rate before it. Both are recurrences with
a small state, so a chunk of a run is summed up by its map from the state before it to the state after it: for the kept readings a
short table, as only where the first kept reading lies makes a difference; for the smoothed rate an affine map, and a value for
the case that nothing was positive yet. Chunks are even ranges of (run, t, done); their maps are composed per run, and then each chunk
is worked out by itself. No task holds a run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postsieve.operators.position import ranged
from postsieve.session import materialize

#: Readings closer than this many milliseconds to the last one kept are skipped; the share of the old value in the smoothed rate.
GAP_MS, KEEP = 50, 0.7
CHUNK_ROWS = 250_000


def _next_kept(t: np.ndarray) -> np.ndarray:
    """For each reading of a sorted run the number of the first one that is far enough behind it; len(t) for none."""
    return np.searchsorted(t, t + GAP_MS)


def _last_kept(t: np.ndarray) -> np.ndarray:
    """For each reading the last one kept if it is kept."""
    after, last = _next_kept(t), np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            last[i] = last[after[i]]
    return last


def _runs(chunk: pd.DataFrame):
    """(run, t, done) of each run in a chunk, sorted."""
    chunk = chunk.sort_values("_place", kind="stable")
    run = chunk["run"].to_numpy()
    cuts = np.flatnonzero(run[1:] != run[:-1]) + 1
    for part in np.split(np.arange(len(run)), cuts):
        yield run[part[0]], chunk["t"].to_numpy()[part], chunk["done"].to_numpy()[part]


def _chunk_map(chunk: pd.DataFrame) -> pd.DataFrame:
    """Per run of a chunk: its first reading's exit, and for each other possible first kept reading its time and exit."""
    out = []
    for run, t, done in _runs(chunk):
        last = _last_kept(t)
        # a reading kept before this chunk lies no later than its first one, so the first kept here is at most GAP_MS behind that
        reach = min(len(t), int(np.searchsorted(t, t[0] + GAP_MS)) + 1)
        begin = np.flatnonzero(np.diff(t[:reach], prepend=t[0] - 1) > 0)
        out.append((run, chunk["_range"].iat[0], int(t[last[0]]), int(done[last[0]]), t[begin].tolist(), t[last[begin]].tolist(), done[last[begin]].tolist()))
    return pd.DataFrame(out, columns=["run", "_range", "own_t", "own_done", "begin", "exit_t", "exit_done"])


def _entries(maps: pd.DataFrame) -> pd.DataFrame:
    """The reading last kept before each chunk of one run; a row per chunk."""
    out, state = [], None
    columns = ["run", "_range", "own_t", "own_done", "begin", "exit_t", "exit_done"]
    for run, place, own_t, own_done, begin, exit_t, exit_done in maps.sort_values("_range")[columns].itertuples(index=False, name=None):
        out.append((run, place, *(state or (None, None))))
        if state is None:
            state = own_t, own_done
        else:
            at = int(np.searchsorted(np.array(begin), state[0] + GAP_MS))
            state = (exit_t[at], exit_done[at]) if at < len(begin) else state
    return pd.DataFrame(out, columns=["run", "_range", "entry_t", "entry_done"]).astype({"entry_t": "Int64", "entry_done": "Int64"})


def _kept(chunk: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The kept readings of a chunk with their rate, and the map from the smoothed rate before the chunk to that at each of them."""
    if not len(chunk):
        return pd.DataFrame([], columns=["run", "_range", "n", "t", "done", "rate", "a", "b", "z"])
    entry = {run: None if pd.isna(t) else (int(t), int(done)) for run, t, done in entries[["run", "entry_t", "entry_done"]].itertuples(index=False, name=None)}
    out = []
    for run, t, done in _runs(chunk):
        known, after = entry[run], _next_kept(t)
        at = int(np.searchsorted(t, known[0] + GAP_MS)) if known else 0
        path = []
        while at < len(t):
            path.append(at)
            at = after[at]
        times, totals = t[path], done[path]
        if known:
            times, totals = np.concatenate([[known[0]], times]), np.concatenate([[known[1]], totals])
        rate = np.maximum(0.0, np.diff(totals.astype(float))) / (np.diff(times) / 1000)
        b = z = 0.0
        for n, r in enumerate(rate):
            b = KEEP * b + (1 - KEEP) * r
            z = KEEP * z + (1 - KEEP) * r if z > 0 else r
            out.append((run, chunk["_range"].iat[0], n, int(times[n + 1]), int(totals[n + 1]), r, KEEP ** (n + 1), b, z))
    return pd.DataFrame(out, columns=["run", "_range", "n", "t", "done", "rate", "a", "b", "z"])


def _smoothed_before(maps: pd.DataFrame) -> pd.DataFrame:
    """The smoothed rate before each chunk of one run; a row per chunk."""
    out, state = [], 0.0
    for run, place, a, b, z in maps.sort_values("_range")[["run", "_range", "a", "b", "z"]].itertuples(index=False, name=None):
        out.append((run, place, state))
        state = a * state + b if state > 0 else z
    return pd.DataFrame(out, columns=["run", "_range", "before"])


def throughput(progress: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(run, t, done, rate, ema) from (run, t in ms, done): smoothed rate, readings under 50 ms apart skipped.

    The first reading of a run only begins it. Readings of one time go by ``done``.
    """
    rows = progress.select(F.col("run").cast("long").alias("run"), F.col("t").cast("long").alias("t"), F.col("done").cast("long").alias("done"))
    rows = ranged(rows, [F.col("run"), F.col("t"), F.col("done")], rows.count(), chunk_rows)
    maps = rows.groupBy("_range").applyInPandas(_chunk_map, "run long, _range long, own_t long, own_done long, begin array<long>, exit_t array<long>, exit_done array<long>")
    entries = maps.groupBy("run").applyInPandas(_entries, "run long, _range long, entry_t long, entry_done long")
    kept = rows.groupBy("_range").cogroup(entries.groupBy("_range")).applyInPandas(_kept, "run long, _range long, n long, t long, done long, rate double, a double, b double, z double")
    kept = materialize(kept, "kept")
    ends = kept.groupBy("run", "_range").agg(F.max_by(F.struct("a", "b", "z"), "n").alias("m")).select("run", "_range", "m.*")
    before = ends.groupBy("run").applyInPandas(_smoothed_before, "run long, _range long, before double")
    ema = F.when(F.col("before") > 0, F.col("a") * F.col("before") + F.col("b")).otherwise(F.col("z"))
    return kept.join(before, ["run", "_range"]).select("run", "t", "done", "rate", ema.alias("ema"))
