"""Questions over the records: named terms, exact counts, evidence, and enforced citations.

Questions are a table. Phrases meet posts in an equi-join on word n-grams, confirmed by the exact pattern, so no
question is ever tried against every post.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from postsieve import schema as S, values as V
from postsieve.functions import text as T
from postsieve.functions.regex import java
from postsieve.functions.settle import place_number, settle
from postsieve.operators.geo import named_aliases_joined, with_named_aliases
from postsieve.session import materialize
from postsieve.sources.gazetteer import Places, fits_inline

_TERM = "array<struct<ord:int,label:string,phrases:array<string>>>"


def is_count_question(question: Column) -> Column:
    return T.matches(question, V.COUNT_QUESTION_PATTERN)


def _named_terms(questions: DataFrame, places: Places | DataFrame | None) -> DataFrame:
    """The questions with ``_named``: the places they name, in the gazetteer's order. A large gazetteer is joined."""
    if isinstance(places, DataFrame) and fits_inline(places):
        places = Places.of(places)
    if isinstance(places, DataFrame):
        asked = questions.select(F.col("qid").alias("seq"), T.collapse(F.col("question")).alias("text"))
        term = F.struct("ord", F.col("name").alias("label"), F.col("aliases").alias("phrases"))
        entries = places.select(F.explode("aliases").alias("alias"), term.alias("term")).withColumn("alias", F.lower("alias"))
        named = named_aliases_joined(asked, places).join(entries, "alias")
        named = named.groupBy(F.col("seq").alias("qid")).agg(F.array_sort(F.collect_set("term")).alias("_named"))  # bounded by one question
        return questions.select("qid", "question").join(named, "qid", "left").withColumn("_named", F.coalesce("_named", F.array().cast(_TERM)))
    places = places or Places.of()
    by_alias = {a: [{"ord": r["ord"], "label": r["name"], "phrases": list(r["aliases"])} for r in rows]
                for a, rows in places.alias_entries().items()}
    constant = F.from_json(F.lit(json.dumps(by_alias)), f"map<string,{_TERM}>")
    df = with_named_aliases(questions.select("qid", "question"), T.collapse(F.col("question")), places, "_a")
    named = F.array_sort(F.array_distinct(F.flatten(F.transform("_a", lambda a: F.element_at(constant, a)))))
    return df.withColumn("_named", settle(named)).drop("_a")


def extract_terms(questions: DataFrame, places: Places | DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(qid, rank, label, phrases): places named, then quoted phrases of any length, then capitalised words; all of them unless limited."""
    q, df = F.col("question"), _named_terms(questions, places)
    quoted = F.transform(F.regexp_extract_all(q, F.lit('["\u201c]([^"\u201d]+)["\u201d]'), F.lit(1)), T.trim_all)
    words = F.filter(F.split(F.regexp_replace(q, java(r"[^A-Za-z0-9'\s-]"), " "), java(r"\s+")), lambda w: w != "")
    capitals = F.filter(words, lambda w, i: (i > 0) & w.rlike("^[A-Z][a-z]{2,}"))
    df = df.withColumn("_extra", settle(F.concat(quoted, capitals)))
    covered = F.flatten(F.transform(F.flatten(F.col("_named.phrases")), lambda p: F.split(p, " ")))
    df = df.withColumn("_covered", settle(covered))
    useful = F.filter("_extra", lambda e: ~F.lower(e).isin(V.QUESTION_STOP_WORDS) & ~F.array_contains(F.col("_covered"), F.lower(e)))
    df = df.withColumn("_extra", settle(useful))
    lowered = F.transform("_extra", lambda e: F.lower(e))
    once = F.filter("_extra", lambda e, i: F.array_position(lowered, F.lower(e)) == i + 1)
    term = lambda label, phrases: F.struct(label.alias("label"), phrases.alias("phrases"))
    all_terms = F.concat(F.transform("_named", lambda t: term(t["label"], t["phrases"])),
                         F.transform(once, lambda e: term(e, F.array(e))))
    return df.select("qid", F.posexplode(settle(all_terms if limit is None else F.slice(all_terms, 1, limit))).alias("rank", "t")).select(
        "qid", "rank", "t.label", "t.phrases")


def _spaced(text: Column) -> Column:
    """Words and single marks between blanks; marks keep words apart as the phrase pattern does."""
    return T.collapse(F.regexp_replace(F.lower(text), java(r"((?!\s)[^a-z0-9])"), " $1 "))


MAX_INLINE_WORDS = 5000


def _few(df: DataFrame, column: str) -> list[str] | None:
    """The distinct values when there are few enough to travel inside a filter, else None."""
    rows = df.select(column).distinct().limit(MAX_INLINE_WORDS + 1).collect()
    return [r[0] for r in rows] if len(rows) <= MAX_INLINE_WORDS else None


def _grams_of(n: int, starts: str | None = None) -> Column:
    """The runs of n words of ``w``, or those that begin at the places in ``starts``."""
    places = F.sequence(F.lit(0), F.size("w") - 1) if starts is None else F.col(starts)
    starts = F.filter(places, lambda i: i + n <= F.size("w"))
    return F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, n), " "))


def term_matches(terms: DataFrame, posts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(label, phrases, seq, and columns of the post to carry): each post that mentions a distinct term, once."""
    distinct = terms.select("label", "phrases").distinct()
    phrases = distinct.select("label", "phrases", F.explode("phrases").alias("phrase"))
    phrases = phrases.withColumn("gram", _spaced(F.col("phrase"))).withColumn("n", F.size(F.split("gram", " ")))
    # words alone decide by themselves; a phrase with marks in it is confirmed by the pattern afterwards
    phrases = phrases.withColumn("doubtful", F.col("gram").rlike("[^a-z0-9 ]"))
    some = phrases.select("label", "phrases", "gram", "n", "doubtful").distinct().limit(MAX_INLINE_WORDS + 1).collect()
    if not some:
        return distinct.crossJoin(posts.select("seq", *carry).limit(0))
    words = posts.select("seq", "text", *carry, settle(F.split(_spaced(F.col("text")), " ")).alias("w"))
    if len(some) <= MAX_INLINE_WORDS:
        return _matched_in_place(some, words, carry)
    # more phrases than fit a plan: only their lengths are known to it, and n-grams meet them in a join
    kinds = phrases.select("n", "doubtful").distinct().collect()
    grams = F.flatten(F.array(*[_grams_of(n) for n in sorted({k["n"] for k in kinds})]))
    seen = words.select("seq", *carry, settle(F.array_distinct(grams)).alias("g")).select("seq", *carry, F.explode("g").alias("gram"))
    found = seen.join(phrases.select("label", "phrases", "gram", "doubtful"), "gram")
    sure = found.where("NOT doubtful").select("label", "phrases", "seq", *carry)
    if any(k["doubtful"] for k in kinds):
        check = found.where("doubtful").withColumn("pattern", T.mentions_pattern_column(F.col("phrases")))
        check = check.join(posts.select("seq", "text"), "seq").where(F.expr("regexp_like(text, pattern)"))
        sure = sure.unionByName(check.select("label", "phrases", "seq", *carry))
    return sure.distinct()


def _matched_in_place(some: list, words: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Matches of a bounded number of phrases: each post finds its terms, every one once, before any row leaves it."""
    terms = sorted({(r["label"], tuple(r["phrases"])) for r in some}, key=str)
    number = {t: i for i, t in enumerate(terms)}
    firsts = sorted({r["gram"].split(" ")[0] for r in some})
    words = words.withColumn("_s", settle(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(firsts))))
    grams = F.flatten(F.array(*[_grams_of(n, "_s") for n in sorted({r["n"] for r in some})]))

    def found(doubtful: bool) -> Column:
        of: dict[str, list[int]] = {}
        for r in some:
            if r["doubtful"] == doubtful:
                of.setdefault(r["gram"], []).append(number[r["label"], tuple(r["phrases"])])
        table = F.from_json(F.lit(json.dumps(of)), "map<string,array<int>>")
        return F.array_distinct(F.flatten(F.transform(F.filter("_g", lambda g: g.isin(list(of))), lambda g: F.element_at(table, g))))

    words = words.withColumn("_g", settle(grams))
    rows = words.select("seq", "text", *carry, settle(found(False)).alias("sure"), settle(found(True)).alias("doubt"))
    each = F.concat(F.transform("sure", lambda i: F.struct(i.alias("i"), F.lit(True).alias("sure"))),
                    F.transform(F.array_except("doubt", "sure"), lambda i: F.struct(i.alias("i"), F.lit(False).alias("sure"))))
    rows = rows.select("seq", "text", *carry, F.explode(each).alias("m")).select("seq", "text", *carry, "m.*")
    table = words.sparkSession.createDataFrame([(i, label, list(phrases)) for (label, phrases), i in number.items()], "i int, label string, phrases array<string>")
    table = F.broadcast(table.withColumn("pattern", T.mentions_pattern_column(F.col("phrases"))))  # at most MAX_INLINE_WORDS rows
    hits = rows.join(table, "i").where(F.col("sure") | F.expr("regexp_like(text, pattern)"))
    return hits.select("label", "phrases", "seq", *carry)


def exact_facts(terms: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, rank, label, count_all, count_relevant) over every record."""
    flags = records.select("seq", "text", S.relevant().alias("rel"))
    hits = term_matches(terms, flags, ("rel",))
    counts = hits.groupBy("label", "phrases").agg(F.count("*").alias("count_all"), F.count_if("rel").alias("count_relevant"))
    return (terms.join(counts, ["label", "phrases"], "left").fillna(0, ["count_all", "count_relevant"])
            .select("qid", "rank", "label", "phrases", "count_all", "count_relevant"))


def totals(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total_loaded"), F.count_if(S.relevant()).alias("total_relevant"))


def most_named_places(records: DataFrame, limit: int = V.ASK_PLACES) -> DataFrame:
    """Places by number of records that name them; the first seen goes first among equals."""
    rows = records.select("seq", F.posexplode(F.array_distinct("places.name")).alias("pos", "name"))
    return (rows.groupBy("name").agg(F.count("*").alias("count"), F.min(place_number("seq", "pos")).alias("first"))
            .orderBy(F.desc("count"), "first").limit(limit))


def _asked(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, f, times, first): what a question asks for: its keywords and its named terms, as one kind of feature."""
    keys = questions.select("qid", F.explode(F.array_distinct(T.tokenize(F.col("question")))).alias("word")).where("length(word) > 3")
    words = keys.select("qid", F.concat(F.lit("w:"), "word").alias("f"), F.lit(False).alias("first"))
    named = terms.select("qid", _term_key().alias("f"), (F.col("rank") == 0).alias("first"))
    return words.unionByName(named).groupBy("qid", "f").agg(F.count("*").alias("times"), F.max("first").alias("first"))


def _term_key() -> Column:
    return F.concat(F.lit("t:"), F.sha2(F.to_json(F.struct("label", "phrases")), 256))


def _postings(asked: DataFrame, terms: DataFrame, rel: DataFrame) -> DataFrame:
    """(f, seq, points, severity, confidence): a keyword's occurrences in a post, two points for a named term; asked features only."""
    wanted = asked.where(F.col("f").startswith("w:")).select(F.substring("f", 3, 1 << 20).alias("word")).distinct()
    spoken = rel.select("seq", "severity", "confidence", F.explode(F.split(T.normalize(F.col("text")), " ")).alias("word"))
    few = _few(wanted, "word")
    spoken = spoken.join(wanted, "word", "left_semi") if few is None else spoken.where(F.col("word").isin(few))  # other words are not shuffled
    spoken = spoken.groupBy("word", "seq", "severity", "confidence").agg(F.count("*").alias("points"))
    hits = term_matches(terms, rel.select("seq", "text", "severity", "confidence"), ("severity", "confidence"))
    hits = hits.select(_term_key().alias("f"), "seq", F.lit(2).cast("long").alias("points"), "severity", "confidence").distinct()
    return spoken.select(F.concat(F.lit("w:"), "word").alias("f"), "seq", "points", "severity", "confidence").unionByName(hits)


_BEST = (F.desc, "severity"), (F.desc, "confidence"), (F.asc, "seq")


def evidence(questions: DataFrame, terms: DataFrame, records: DataFrame, limit: int = V.ASK_EVIDENCE) -> DataFrame:
    """(qid, rank, seq, id, overlap, first_term): the relevant records that serve a question best.

    Ranked by shared keywords plus two per named term, then severity, then confidence. Records that share
    nothing can only fill up from the best ``limit`` overall.

    Questions that ask for the same are one search. Each keyword and term has a list of its posts by impact, of which the first
    ``limit`` are tried in full; the last of them bounds what any other post can get there. A search whose last hit is not below the sum of
    these bounds, ties included, is complete. Only the others take all posts of their lists.
    """
    rel = records.where(S.relevant()).select(
        "seq", "id", "text", F.coalesce("labels.severity.value", F.lit(0.0)).alias("severity"),
        F.coalesce("labels.relevant.confidence", F.lit(0.0)).alias("confidence"))
    asked = _asked(questions, terms)
    sets = questions.select("qid").join(asked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("f", "times", "first"))).alias("fs")), "qid", "left")
    sets = materialize(sets.withColumn("fs", F.coalesce("fs", F.array().cast(sets.schema["fs"].dataType))).withColumn("search", F.xxhash64(F.to_json("fs"))), "questions")
    searches = sets.groupBy("search").agg(F.first("fs").alias("fs"))
    wants = materialize(searches.select("search", F.explode("fs").alias("x")).select("search", "x.*"), "searches")
    postings = materialize(_postings(asked, terms, rel), "postings")
    impact = Window.partitionBy("f").orderBy(F.desc("points"), *[o(c) for o, c in _BEST])
    lists = materialize(postings.withColumn("place", F.row_number().over(impact)).where(F.col("place") <= limit), "lists")
    best = rel.orderBy(*[o(c) for o, c in _BEST]).limit(limit).agg(F.collect_list("seq").alias("seqs")).first()["seqs"]  # at most 60 numbers
    filler = searches.select("search", F.explode(F.array(*[F.lit(s) for s in best]).cast("array<bigint>")).alias("seq"))

    def ranked(pairs: DataFrame) -> DataFrame:
        """The first ``limit`` of each search among pairs (search, seq), each of them scored in full."""
        points = pairs.join(wants, "search").join(postings.select("f", "seq", "points"), ["f", "seq"]).groupBy("search", "seq").agg(
            F.sum(F.col("points") * F.col("times")).alias("overlap"), F.max("first").alias("first_term"))
        full = pairs.join(points, ["search", "seq"], "left").fillna(0, ["overlap"]).fillna(False, ["first_term"]).join(rel.drop("text"), "seq")
        order = Window.partitionBy("search").orderBy(F.desc("overlap"), *[o(c) for o, c in _BEST])
        return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    found = materialize(ranked(wants.join(lists.select("f", "seq"), "f").select("search", "seq").unionByName(filler).distinct()), "found")
    key = F.struct((-F.col("severity")).alias("s"), (-F.col("confidence")).alias("c"), "seq")
    bounds = wants.join(lists.where(F.col("place") == limit), "f").groupBy("search").agg(F.sum(F.col("points") * F.col("times")).alias("most"), F.max(key).alias("last"))
    ends = found.where(F.col("rank") == limit).select("search", "overlap", key.alias("end"))
    open_ = bounds.join(ends, "search").where((F.col("most") > F.col("overlap")) | ((F.col("most") == F.col("overlap")) & (F.col("end") > F.col("last")))).select("search")
    open_ = materialize(open_, "open")
    if not open_.isEmpty():
        every = wants.join(open_, "search").join(postings.select("f", "seq"), "f").select("search", "seq").unionByName(filler.join(open_, "search")).distinct()
        found = found.join(open_, "search", "left_anti").unionByName(ranked(every))
    return sets.select("qid", "search").join(found, "search").select("qid", "rank", "seq", "id", "overlap", "first_term")


def answer_counts(questions: DataFrame, facts: DataFrame, proof: DataFrame, total_loaded: int) -> DataFrame:
    """(qid, sentence, cited): exact answers to count questions that name a term, citing its first two matches."""
    asked = questions.where(is_count_question(F.col("question"))).join(facts.where("rank = 0"), "qid")
    window = Window.partitionBy("qid").orderBy("rank")
    cites = (proof.where("first_term").withColumn("c", F.row_number().over(window)).where("c <= 2")
             .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("c", "id"))).alias("ids")))
    label = F.regexp_replace("label", ", [A-Z]{2}$", "")
    tail = F.when(F.col("count_relevant") != F.col("count_all"),
                  F.concat(F.lit(", "), F.col("count_relevant").cast("string"), F.lit(" of them classified relevant."))).otherwise(".")
    sentence = F.concat(F.col("count_all").cast("string"), F.lit(f" of the {total_loaded} loaded posts mention "), label, tail)
    empty = F.array().cast("array<string>")
    return asked.join(cites, "qid", "left").select(
        "qid", sentence.alias("sentence"), F.coalesce(F.transform("ids", lambda x: x["id"]), empty).alias("cited"))


def source_snippets(cited: DataFrame, records: DataFrame, limit: int = 40) -> DataFrame:
    """(id, snippet) for every cited record."""
    ids = cited.select(F.explode("cited").alias("id")).distinct()
    return records.join(ids, "id", "left_semi").select("id", T.snippet(F.col("text"), limit).alias("snippet"))


# --- generated sentences ----------------------------------------------------------------------

def kill_reason(sentence: Column) -> Column:
    return F.when(T.matches(sentence, V.KILL_PATTERN), V.KILL_REASON).when(T.matches(sentence, V.PEOPLE_PATTERN), V.PEOPLE_REASON)


def narrative_inputs(representatives: DataFrame, records: DataFrame) -> DataFrame:
    """What a narrative may be written from: representatives without personal data."""
    safe = records.where(~F.coalesce("labels.has_pii.value", F.lit(False)))
    return safe.join(representatives.select("id").distinct(), "id", "left_semi").select(
        "id", "text", F.col("labels.category.value").alias("category"), F.col("places.name").alias("places"))


def enforce_citations(sentences: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with reason) from (sid, sentence, cited). The first failing rule names the reason."""
    trimmed = sentences.select("sid", T.trim_all(F.coalesce("sentence", F.lit(""))).alias("sentence"),
                               F.coalesce("cited", F.array().cast("array<string>")).alias("cited"))
    known = allowed.select(F.col("id").alias("cid"), F.lit(True).alias("known")).distinct()
    unknown = (trimmed.select("sid", F.posexplode("cited").alias("pos", "cid")).join(known, "cid", "left")
               .where("known is null").groupBy("sid").agg(F.min(F.struct("pos", "cid")).alias("u")))
    judged = trimmed.join(unknown, "sid", "left").withColumn("reason", settle(
        F.when(F.col("sentence") == "", "empty sentence").when(F.size("cited") == 0, "no citations")
        .when(F.col("u").isNotNull(), F.concat(F.lit("cites unknown id "), F.col("u.cid")))
        .otherwise(kill_reason(F.col("sentence")))))
    dash = F.regexp_replace("sentence", java("\\s*[\u2014\u2013]\\s*"), ", ")
    kept = judged.where("reason is null").select("sid", dash.alias("sentence"), "cited")
    return kept, judged.where("reason is not null").select("sid", "sentence", "reason")


def keeps_numbers(source: Column, rewrite: Column) -> Column:
    """Every number of the source is in the rewrite, as written."""
    return F.forall(T.numbers(source), lambda n: rewrite.contains(n))
