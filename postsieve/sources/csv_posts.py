"""Delimited files of unknown shape to posts, with every rejected row reported.

All files are read as splittable text lines. Where a quoted field may go on over line ends, the quote state is found by a prefix
scan: a line maps the state before it to the state after it, lines of one input split are composed in order, and so are the splits
of a file. That fixes where each record begins, in any split; only the lines of records that span several meet again.
Row numbers need no sort: rows of one input split are contiguous, so a small count per split gives the offset.

Every file has its own header; columns are matched by name, and a file without the text column is rejected row by row.
"""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postsieve import values as V
from postsieve.functions import text as T
from postsieve.functions.settle import settle
from postsieve.operators.geo import accepted_coordinates
from postsieve.session import materialize
from postsieve.sources import files as files_source

_HEAD_LINES = 50
#: Characters of a record that goes over line ends; a longer one is an unclosed quote, reported as such.
MAX_RECORD = 64 << 20
csv.field_size_limit(2**31 - 1)  # a cell of the first lines may be long


@dataclass
class CsvReport:
    """What the reader understood; a few strings."""

    delimiter: str = ","
    headers: list[str] = field(default_factory=list)
    chosen_column: str = ""
    mapped: dict[str, str | None] = field(default_factory=dict)
    positions: dict[str, int] = field(default_factory=dict)
    width: int = 0


# --- header and dialect, from the first lines only ---------------------------------------------

def _records(lines: list[str], delimiter: str) -> list[list[str]]:
    rows = csv.reader(io.StringIO("\n".join(lines)), delimiter=delimiter)
    return [r for r in rows if r][:10]


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that splits the first rows most evenly into at least two fields; comma when none does."""
    best, best_key = ",", None
    for d in V.DELIMITERS:
        counts = [len(r) for r in _records(lines, d)]
        if not counts or sum(counts) / len(counts) <= 1.99:
            continue
        change = sum(abs(a - b) for a, b in zip(counts, counts[1:]))
        key = (change, -sum(counts) / len(counts))
        if best_key is None or key < best_key:
            best, best_key = d, key
    return best


def header_key(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", header.strip().lower()).strip("_")


def pick_header(headers: list[str], candidates: list[str]) -> str | None:
    """Exact name first, then a longer candidate inside a name, then a short one as a whole part of a name."""
    keyed = [(h, header_key(h)) for h in headers]
    rules = (
        (candidates, lambda key, c: key == c),
        ([c for c in candidates if len(c) >= 4], lambda key, c: c in key),
        ([c for c in candidates if len(c) < 4], lambda key, c: c in key.split("_")),
    )
    for names, fits in rules:
        for c in names:
            for h, key in keyed:
                if fits(key, c):
                    return h
    return None


# --- rows --------------------------------------------------------------------------------------

def _scanned(value: Column, delimiter: str, inside: bool) -> Column:
    """What a line leaves behind, given whether it begins inside a quoted field: ``inside`` (again) and ``ends``, the delimiters outside quotes.

    A quote opens a field only at its start; in a quoted field two quotes stand for one. State 2 means just closed. Pairs of quotes are left out
    first: inside a field they change nothing, and elsewhere they are an empty field or plain text, so a long cell full of them is one step.
    """
    segments, ends = F.split(F.replace(value, F.lit('""'), F.lit("")), F.lit('"'), F.lit(-1)), lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit("")))

    def at_quote(now: Column, segment: Column) -> Column:
        opens = segment.endswith(delimiter) | (now["first"] & (segment == ""))
        state = F.when(now["state"] == 1, 2).when((now["state"] == 2) & (segment == ""), 1).when(opens, 1).otherwise(0)
        return F.struct(state.alias("state"), (now["ends"] + F.when(now["state"] == 1, 0).otherwise(ends(segment))).alias("ends"), F.lit(False).alias("first"))
    begin = F.struct(F.lit(int(inside)).alias("state"), F.lit(0).alias("ends"), F.lit(not inside).alias("first"))
    last = F.element_at(segments, -1)
    return F.aggregate(F.slice(segments, F.lit(1), F.size(segments) - 1), begin, at_quote, lambda now: F.struct(
        (now["state"] == 1).alias("inside"), (now["ends"] + F.when(now["state"] == 1, 0).otherwise(ends(last))).alias("ends")))


def _after(value: Column, delimiter: str, inside: bool) -> Column:
    return F.when(value.contains('"'), _scanned(value, delimiter, inside)["inside"]).otherwise(F.lit(inside))


def _composed(df: DataFrame, by: list[str], order: str, out: Column, turn: Column, names: tuple[str, str, str, str]) -> DataFrame:
    """Prefix composition of maps of a two-valued state, in order within groups.

    ``out`` is the state that a row always leaves, or null where it keeps or (``turn``) flips what it finds. Adds the map of all rows
    up to each one, as the two columns names[:2] in the same form, and that of the rows before it, as names[2:].
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_out", out).withColumn("_turns", F.sum(F.when(F.col("_out").isNull() & turn, 1).otherwise(0)).over(upto))
    df = df.withColumn("_last", F.last(F.when(F.col("_out").isNotNull(), F.struct("_out", "_turns")), ignorenulls=True).over(upto))
    odd = F.pmod(F.col("_turns") - F.coalesce("_last._turns", F.lit(0)), F.lit(2)) == 1
    df = df.withColumn(names[0], F.col("_last._out") != odd).withColumn(names[1], odd).drop("_out", "_turns", "_last")
    before = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(names[2], F.lag(names[0]).over(before)).withColumn(names[3], F.coalesce(F.lag(names[1]).over(before), F.lit(False)))


def _state(found: str, turn: str, entry: Column) -> Column:
    return F.coalesce(F.col(found), F.col(turn) != entry)


def _spanning_records(lines: DataFrame, delimiter: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(records: file, line, value, fault; files: file, size) of lines (value, file, block, id) whose quoted fields may hold line ends.

    A record of more than ``limit`` characters comes out without its value and with a fault, as does, with its value, one whose quote
    never closes.
    """
    split = ["file", "block"]
    lines = lines.withColumn("a0", _after(F.col("value"), delimiter, False)).withColumn("a1", _after(F.col("value"), delimiter, True))
    lines = _composed(lines, split, "id", F.when(F.col("a0") == F.col("a1"), F.col("a0")), F.col("a0"), ("after", "after_turn", "before", "before_turn"))
    upto = Window.partitionBy(*split).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = lambda entry: (F.col("value") != "") & ~_state("before", "before_turn", F.lit(entry))
    for name, entry in (("begun0", False), ("begun1", True)):  # records begun so far in the split, for either state at its start
        lines = lines.withColumn(name, F.sum(begins(entry).cast("long")).over(upto))
    lines = materialize(lines.drop("a0", "a1"), "lines")
    blocks = lines.groupBy(*split).agg(F.max_by(F.struct("after", "after_turn", "begun0", "begun1"), "id").alias("s")).select(*split, "s.*")
    blocks = _composed(blocks, ["file"], "block", F.col("after"), F.col("after_turn"), ("_a", "_b", "entered", "entered_turn"))  # a row per input split
    blocks = blocks.select(*split, F.coalesce("entered", "entered_turn").alias("entry"), "begun0", "begun1")
    blocks = blocks.withColumn("begun", F.when(F.col("entry"), F.col("begun1")).otherwise(F.col("begun0")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("begun").alias("size"))
    blocks = blocks.withColumn("skip", F.coalesce(F.sum("begun").over(earlier), F.lit(0))).select(*split, "entry", "skip")
    placed = lines.join(blocks, split).select("file", "block", "id", "value", _state("before", "before_turn", F.col("entry")).alias("inside"), _state("after", "after_turn", F.col("entry")).alias("open"),
                                              (F.col("skip") + F.when(F.col("entry"), F.col("begun1")).otherwise(F.col("begun0")) - 1).alias("line"))
    single = placed.where("NOT inside AND NOT open AND value <> ''").select("file", "line", "value", F.lit(None).cast("string").alias("fault"))
    shared = placed.where("inside OR open")
    sizes = shared.groupBy("file", "line").agg((F.sum(F.length("value") + 1)).alias("chars"), F.min("open").alias("unclosed"))
    fault = F.when(F.col("chars") > limit, F.lit(f"Quoted field of more than {limit} characters")).when(F.col("unclosed"), F.lit("Quoted field unterminated"))
    sizes = materialize(sizes.withColumn("fault", fault), "sizes")
    whole = shared.join(sizes.where(F.col("chars") <= limit).select("file", "line"), ["file", "line"])
    joined = whole.groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "\n").alias("value"))
    many = sizes.join(joined, ["file", "line"], "left").select("file", "line", "value", "fault")
    return single.unionByName(many), files


def _text_lines(spark: SparkSession, path: str, encoding: str, blanks: bool = False) -> DataFrame:
    """(value, file, block, id): the lines of the files; ids rise within a split, and by one without blank lines."""
    if encoding.upper() not in ("UTF-8", "UTF8"):
        return files_source.range_lines(spark, path, encoding, blanks)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return (lines if blanks else lines.where("value <> ''")).withColumn("id", F.monotonically_increasing_id())


def _records_of(spark: SparkSession, path: str, encoding: str, delimiter: str, limit: int) -> tuple[DataFrame, int]:
    """(value, fault, part, line, before) per record and the number of files: ``part`` (file order by name), ``line`` (0-based in its file, blank
    lines not counted) and ``before`` (records of earlier files)."""
    lines = _text_lines(spark, path, encoding)
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max(_after(F.col("value"), delimiter, False)).alias("open"))
    blocks = materialize(blocks, "splits")  # a row per input split: the windows below run over a small table
    files = blocks.groupBy("file").agg(F.sum("n").alias("size"), F.max("open").alias("open"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    skips = blocks.withColumn("skip", F.coalesce(F.sum("n").over(in_file), F.lit(0)))
    plain = lines.join(skips.join(files.where("NOT open").select("file"), "file").select("file", "block", "first", "skip"), ["file", "block"])
    records = plain.select("file", (F.col("id") - F.col("first") + F.col("skip")).alias("line"), "value", F.lit(None).cast("string").alias("fault"))
    sizes = files.where("NOT open").select("file", "size")
    if not files.where("open").isEmpty():
        spanning = _text_lines(spark, path, encoding, blanks=True).join(files.where("open").select("file"), "file", "left_semi")
        found, held = _spanning_records(spanning, delimiter, limit)
        records, sizes = records.unionByName(found), sizes.unionByName(held)
    by_name = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    sizes = sizes.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("part"), F.coalesce(F.sum("size").over(by_name), F.lit(0)).alias("before"))
    return records.join(sizes, "file").drop("file"), files.count()


def _places(header: str, report: CsvReport, headers: list[str]) -> tuple[list[int], int]:
    """Where a file with this header line keeps each column of the report (-1: nowhere), and its number of columns."""
    names = [h.strip() for h in _records([header.lstrip("\ufeff")], report.delimiter)[0]]
    keys = [header_key(n) for n in names]
    roles = {pick_header(report.headers, c): c for c in reversed(V.COLUMN_CANDIDATES.values())}  # the first role of a column names it

    def place(h: str) -> int:
        if h in names or header_key(h) in keys:
            return names.index(h) if h in names else keys.index(header_key(h))
        other = pick_header(names, roles[h]) if h in roles else None
        return -1 if other is None else names.index(other)
    return [place(h) if h else -1 for h in headers], len(names)


def read_rows(spark: SparkSession, path: str, encoding: str = "UTF-8", max_record: int = MAX_RECORD) -> tuple[DataFrame | None, CsvReport]:
    """(rows with ``f`` = array of fields in the order of the report's columns, ``places`` = where the row's own file keeps them, ``bad`` = field
    count when it is wrong for that file, ``width``, ``fault``, part, row, before) and the dialect, told from the first lines of the first file
    by name. Row 1 of a file is its header, with ``f`` null."""
    lines = _text_lines(spark, path, encoding)
    first = lines.agg(F.min("file")).first()[0]
    if first is None:
        return None, CsvReport()
    head = [r[0] for r in lines.where((F.col("file") == first) & (F.col("block") == 0)).orderBy("id").limit(_HEAD_LINES).collect()]
    head[0] = head[0].lstrip("\ufeff")
    delimiter = sniff_delimiter(head)
    headers = [h.strip() for h in _records(head, delimiter)[0]]
    named = list(dict.fromkeys(h for h in headers if h))  # the first of several equal names wins
    report = CsvReport(delimiter, named, positions={h: headers.index(h) for h in named}, width=len(headers))
    records, many = _records_of(spark, path, encoding, delimiter, max_record)
    own = ([h if headers.index(h) == i else "" for i, h in enumerate(headers)])
    if many > 1:  # a row per distinct header line
        said = [r[0] for r in records.where("line = 0").select("value").distinct().collect()]
        layouts = [(h, *_places(h, report, own)) for h in said if h is not None]
    else:
        layouts = [(None, list(range(len(headers))), len(headers))]
    width = max(w for _, _, w in layouts)
    if len({(tuple(p), w) for _, p, w in layouts}) == 1:
        records = records.withColumn("places", F.lit(layouts[0][1]).cast("array<int>")).withColumn("width", F.lit(layouts[0][2]))
    else:
        known = spark.createDataFrame(layouts, "value string, places array<int>, width int")
        nowhere = F.lit([-1] * len(headers)).cast("array<int>")  # a file whose header can't be read
        by_part = records.where("line = 0").select("part", "value").join(F.broadcast(known), "value", "left").select("part", F.coalesce("places", nowhere).alias("places"), F.coalesce("width", F.lit(width)).alias("width"))
        records = records.join(by_part, "part")
    names = [f"c{i}" for i in range(width)]
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = records.withColumn("p", F.when(F.col("line") > 0, F.from_csv("value", ", ".join(f"{n} string" for n in names) + ", _bad string", options)))
    fields = F.array(*[F.col(f"p.{n}") for n in names])
    count = F.when(F.col("p._bad").isNotNull(), 1 + _scanned(F.col("value"), delimiter, False)["ends"]).otherwise(width)
    parsed = parsed.withColumn("_n", settle(F.when((F.col("line") > 0) & F.col("value").isNotNull(), count)))
    rows = parsed.select(
        F.when(F.col("p").isNotNull(), F.transform("places", lambda i: F.when(i >= 0, F.get(fields, i)))).alias("f"), "places", "width",
        F.when(F.col("_n") != F.col("width"), F.col("_n")).alias("bad"), "fault", "part", (F.col("line") + 1).alias("row"), "before")
    return rows, report


def infer_text_column(rows: DataFrame, headers: list[str], positions: dict[str, int]) -> str:
    """The column that reads most like prose over all rows: long, spaced, not numeric. One pass of averages."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col("f")[positions[h]].alias("v")) for i, h in enumerate(headers)])
    long = rows.select(F.explode(pairs).alias("x")).select("x.*").where("v <> ''")
    share = lambda c: F.avg(c.cast("double"))
    score = F.avg(F.length("v")) * (1 - share(F.col("v").rlike(r"^[\d.,\s-]+$"))) * (0.5 + share(F.col("v").contains(" ")) / 2)
    best = long.groupBy("i").agg(score.alias("s")).orderBy(F.desc("s"), "i").first()  # one row per column
    return headers[best["i"]] if best else headers[0]


def _number(c: Column) -> Column:
    t = T.trim_all(c)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def read_posts_csv(spark: SparkSession, path: str, forced_column: str | None = None, parts: bool = False,
                   encoding: str = "UTF-8", max_record: int = MAX_RECORD) -> tuple[DataFrame, DataFrame, CsvReport]:
    """(posts, rejects, report). ``parts`` reads a directory of files with one header each, ids made unique.

    Files may differ in the order and number of their columns; a column that a file lacks is empty there, and a file without the text
    column gives a reject for every row.
    """
    posts_schema = ("seq long, id string, source string, text string, lat double, lon double, place string, ts string, "
                    "author string, fetch_method string, part int, row long")
    rows, report = read_rows(spark, path, encoding, max_record)
    if rows is None or not report.headers:
        rejects = spark.createDataFrame([(0, "no header row found — is this a CSV?")], "row long, reason string")
        return spark.createDataFrame([], posts_schema), rejects, report
    positions, headers = report.positions, report.headers
    chosen = forced_column if forced_column in headers else pick_header(headers, V.COLUMN_CANDIDATES["text"])
    chosen = chosen or infer_text_column(rows.where("f IS NOT NULL"), headers, positions)
    report.chosen_column = chosen
    report.mapped = {"text": chosen, **{r: pick_header(headers, V.COLUMN_CANDIDATES[r]) for r in ("lat", "lon", "ts", "author", "place")}}

    def role(name):
        header = report.mapped[name]
        return F.lit(None).cast("string") if header is None else F.nullif(F.col("f")[positions[header]], F.lit(""))

    df = rows.select(
        T.trim_all(F.coalesce(F.col("f")[positions[chosen]], F.lit(""))).alias("text"), "bad", "width", "fault", "part", "row", "before", F.col("f").isNotNull().alias("parsed"),
        (F.col("places")[positions[chosen]] < 0).alias("foreign"),
        _number(role("lat")).alias("_lat"), _number(role("lon")).alias("_lon"), role("ts").alias("ts"),
        role("author").alias("author"), role("place").alias("place"))
    df = df.withColumn("text", settle(F.col("text")))
    ok = accepted_coordinates(F.col("_lat"), F.col("_lon"))
    lat = F.when(ok, F.col("_lat"))
    label = F.concat(F.lit("c"), F.col("row").cast("string"))
    ident = F.concat(F.lit("k"), F.col("part").cast("string"), F.lit("_"), label) if parts else label
    posts = df.where("row > 1 AND text <> ''").select(
        (F.col("before") + F.col("row")).cast("long").alias("seq"), ident.alias("id"), F.lit("csv").alias("source"), "text",
        lat.alias("lat"), F.when(ok, F.col("_lon")).alias("lon"), "place", "ts", "author",
        F.when(F.col("author").isNotNull() | ok, "manual").alias("fetch_method"),
        F.col("part").cast("int").alias("part"), F.col("row").cast("long").alias("row"))
    shown = F.col("row") + (F.col("before") - F.col("part") if parts else F.lit(0))
    expected = F.col("width").cast("string")
    counts = F.concat(F.lit("expected "), expected, F.lit(" fields but parsed "), F.col("bad").cast("string"))
    absent = F.lit(f'column "{chosen}" is not in this file\'s header')
    reasons = F.array_compact(F.array(*[F.when(F.expr(when), reason) for when, reason in (
        ("row > 1 AND text = '' AND NOT foreign AND (fault IS NULL OR parsed)", F.lit(f'column "{chosen}" was empty')),
        ("row > 1 AND foreign", absent), ("fault IS NOT NULL AND (row = 1 OR NOT foreign)", F.col("fault")),
        ("bad IS NOT NULL AND NOT foreign", F.concat(F.when(F.col("bad") < F.col("width"), "Too few fields: ").otherwise("Too many fields: "), counts)))]))
    rejects = df.select(shown.alias("row"), F.explode(settle(reasons)).alias("reason"))  # all reasons of a row in one pass over the files
    if rows.where("row > 1").isEmpty():
        rejects = spark.createDataFrame([(1, "header row found, but the file has no data rows")], "row long, reason string")
    return posts, rejects.select(F.col("row").cast("long").alias("row"), "reason"), report


def read_parts(spark: SparkSession, directory: str, forced_column: str | None = None) -> tuple[DataFrame, DataFrame, CsvReport]:
    """A directory of parts of one upload: unique ids, reject rows counted through, copies left to ``collapse_exact``."""
    return read_posts_csv(spark, directory, forced_column, parts=True)


def split_pasted(df: DataFrame, text_col: str = "text", by_line: bool = True) -> DataFrame:
    """Pasted text to posts: one per non-blank line, or the whole text."""
    if by_line:
        rows = df.select(F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("pos", "text"), *[c for c in df.columns if c != text_col])
    else:
        rows = df.select(F.lit(0).alias("pos"), F.col(text_col).alias("text"), *[c for c in df.columns if c != text_col])
    return (rows.withColumn("text", T.trim_all(F.col("text"))).where("text <> ''")
            .withColumn("source", F.lit("manual")).withColumn("fetch_method", F.lit("manual")))
