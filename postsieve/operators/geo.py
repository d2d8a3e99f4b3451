"""Places named in text, as column expressions: no shuffle, no Python workers, so batch and streams share them.

A gazetteer that fits ``MAX_INLINE_ALIASES`` travels inside the plan as one constant; a larger one is joined on
word n-grams. Either way a post ends up with its candidate aliases, and the rest is the same expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from postsieve import schema as S, values as V
from postsieve.functions.regex import java
from postsieve.functions.settle import settle
from postsieve.sources.gazetteer import Places, alias_table, fits_inline, reserves_of

_ENTRY = ("struct<name:string,kind:string,lat:double,lon:double,admin:string,country:string,population:bigint,"
          "community:string>")
_FIELDS = ("name", "kind", "lat", "lon", "admin", "country", "population", "community")


# --- words ------------------------------------------------------------------------------------

def searchable(text: Column, places: Places) -> Column:
    """Lower-case words between single blanks; a hashtag that starts with an alias is also given split.

    Alternatives are tried in order, so the longest single-word alias that leaves a rest wins.
    """
    singles = [a for a in places.aliases() if " " not in a and len(a) >= 3]
    lowered = F.lower(text)
    if singles:
        alternatives = "|".join(re.escape(a) for a in singles)
        lowered = F.regexp_replace(lowered, rf"#(({alternatives})({java(r"\w")}+))", " $1 $2 $3 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " ")), F.lit(" "))


def _searchable_joined(posts: DataFrame, text: Column, aliases: DataFrame) -> DataFrame:
    """``searchable`` for a gazetteer that is joined: distinct hashtags meet aliases on their prefixes."""
    tagged = posts.withColumn("_lower", F.lower(text)).withColumn(
        "_tags", F.array_distinct(F.regexp_extract_all("_lower", F.lit(java(r"#(\w+)")), F.lit(1))))
    tags = tagged.select(F.explode("_tags").alias("tag")).where("length(tag) > 3").distinct()
    prefixes = tags.select("tag", F.explode(F.expr(
        "transform(sequence(3, length(tag) - 1), n -> substring(tag, 1, n))")).alias("prefix"))
    longest = (prefixes.join(aliases.select(F.col("alias").alias("prefix")), "prefix")
               .groupBy("tag").agg(F.max_by("prefix", F.length("prefix")).alias("prefix")))
    per_post = (tagged.select("seq", F.explode("_tags").alias("tag")).join(longest, "tag")
                .groupBy("seq").agg(F.collect_list(F.struct("tag", "prefix")).alias("_splits")))  # bounded by one post
    out = tagged.join(per_post, "seq", "left")
    expanded = F.expr("""aggregate(coalesce(_splits, array()), _lower, (t, s) -> regexp_replace(t,
        concat('#', s.tag, '(?![A-Za-z0-9_])'), concat(' ', s.tag, ' ', s.prefix, ' ', substring(s.tag, length(s.prefix) + 1), ' ')))""")
    return out.withColumn("_hay", F.trim(F.regexp_replace(expanded, "[^a-z0-9]+", " "))).drop("_lower", "_tags", "_splits")


def _alias_constant(places: Places) -> Column:
    """alias -> (rank, entries) as one constant map."""
    entries = places.alias_entries()
    data = {a: {"rank": i, "entries": [{f: e[f] for f in _FIELDS} for e in entries[a]]}
            for i, a in enumerate(places.aliases())}
    return F.from_json(F.lit(json.dumps(data)), f"map<string,struct<rank:int,entries:array<{_ENTRY}>>>")


def _grams(words: Column, starts: Column, longest: int) -> Column:
    """Word n-grams (position, length, text) that begin at the given positions."""
    return F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)),
        lambda n: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("alias")))))


def _inline_candidates(words: Column, places: Places) -> Column:
    """Alias occurrences in ``words`` as (rank, pos, n, alias, entries)."""
    aliases = places.aliases()
    firsts = sorted({a.split(" ")[0] for a in aliases})
    longest = max(len(a.split(" ")) for a in aliases)
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(firsts))
    constant = _alias_constant(places)
    found = F.filter(_grams(words, starts, longest), lambda g: g["alias"].isin(aliases))
    return F.transform(found, lambda g: F.struct(
        F.element_at(constant, g["alias"])["rank"].alias("rank"), g["pos"].alias("pos"), g["n"].alias("n"),
        g["alias"].alias("alias"), F.element_at(constant, g["alias"])["entries"].alias("entries")))


def _exact_words(text: Column) -> Column:
    """Lower-case words letter for letter. Punctuation stays a word of its own so that it separates: "high-river" does not name
    "high river". The pattern is not one class, see ``functions.regex``."""
    return F.split(F.regexp_replace(F.lower(text), "(?! )[^a-z0-9]", " | "), " ")


def with_named_aliases(df: DataFrame, text: Column, places: Places, out: str, min_length: int = 3) -> DataFrame:
    """Adds the distinct aliases a text names letter for letter between non-alphanumerics, as an array of strings.

    Nested aliases all count, unlike ``geoparse``. The words are settled first: a lambda that is given an expression works it out
    again for every element.
    """
    aliases = [a for a in places.aliases() if len(a) >= min_length]
    firsts, longest = sorted({a.split(" ")[0] for a in aliases}), max((len(a.split(" ")) for a in aliases), default=1)
    starts = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("_w", i).isin(firsts))
    grams = F.flatten(F.transform("_s", lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - i)), lambda n: F.array_join(F.slice("_w", i + 1, n), " "))))
    named = df.withColumn("_w", settle(_exact_words(text))).withColumn("_s", settle(starts))
    return named.withColumn(out, settle(F.array_distinct(F.filter(grams, lambda g: g.isin(aliases))))).drop("_w", "_s")


#: Bits of a bitmap of words; one of this size is a constant of 256 kB in the plan.
MAX_BITS = 1 << 21


def bitmap_of(words: DataFrame) -> Callable[[Column], Column]:
    """A test of whether a value may be among ``words`` (one column): a bit per digest, built once, read inside the row.

    It never misses a word; with up to a sixteenth of its bits set it lets one in sixteen others pass, more for very many words.
    """
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(10, (16 * words.count()).bit_length()))
    bit = lambda value: F.pmod(F.xxhash64(value), F.lit(bits))
    cells = (words.select(bit(F.col(words.columns[0])).alias("b")).groupBy(F.shiftright("b", 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("bits")).collect())  # MAX_BITS / 64 rows at most
    held = [0] * (bits >> 6)
    for r in cells:
        held[r["cell"]] = r["bits"]
    table = F.from_json(F.lit(json.dumps(held)), "array<bigint>")
    return lambda value: F.getbit(F.get(table, F.shiftright(bit(value), 6).cast("int")), F.pmod(bit(value), F.lit(64)).cast("int")) == 1


def _likely_grams(words: Column, aliases: DataFrame, longest: int) -> Column:
    """The n-grams of ``words`` that may be aliases: their first word and they themselves pass bitmaps of those of the aliases."""
    first = bitmap_of(aliases.select(F.split("alias", " ")[0].alias("word")).distinct())
    whole = bitmap_of(aliases.select("alias"))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: first(F.get(words, i)))
    return F.filter(_grams(words, starts, longest), lambda g: whole(g["alias"]))


def named_aliases_joined(posts: DataFrame, gazetteer: DataFrame, min_length: int = 3) -> DataFrame:
    """(seq, alias, first) of ``with_named_aliases`` for a gazetteer of any size; only n-grams that may be aliases leave their row."""
    aliases = alias_table(gazetteer).where(F.length("alias") >= min_length).select("alias", "rank.first")
    words = posts.select("seq", settle(_exact_words(F.col("text"))).alias("w"))
    grams = F.array_distinct(F.transform(_likely_grams(F.col("w"), aliases, longest_alias(gazetteer)), lambda g: g["alias"]))
    return words.select("seq", F.explode(settle(grams)).alias("alias")).join(aliases, "alias").select("seq", "alias", "first")


def longest_alias(gazetteer: DataFrame) -> int:
    """Words of the longest alias."""
    return gazetteer.select(F.explode("aliases").alias("a")).agg(F.max(F.size(F.split("a", " ")))).first()[0] or 1


# --- matching ---------------------------------------------------------------------------------

def _accept(candidates: Column) -> Column:
    """Longest alias first, then left to right; words taken by one alias are not used again.

    Of two adjacent copies of an alias only the first takes its words, so a nested alias still matches in
    the second copy.
    """
    hit = f"array<struct<alias:string,entries:array<{_ENTRY}>>>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(hit).alias("hits"),
                     F.lit("").alias("last"), F.lit(-1).alias("end"))

    def step(s, c):
        span = F.sequence(c["pos"], c["pos"] + c["n"] - 1)
        same = s["last"] == c["alias"]
        free = ~(same & (s["end"] == c["pos"])) & ~F.arrays_overlap(s["used"], span)
        hits = F.when(same, s["hits"]).otherwise(
            F.concat(s["hits"], F.array(F.struct(c["alias"].alias("alias"), c["entries"].alias("entries")))))
        return F.when(free, F.struct(F.concat(s["used"], span).alias("used"), hits.alias("hits"),
                                     c["alias"].alias("last"), (c["pos"] + c["n"]).alias("end"))).otherwise(s)

    ordered = F.array_sort(candidates, lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1)
                           .otherwise(a["pos"] - b["pos"]))
    return F.aggregate(ordered, start, step, lambda s: s["hits"])


def _specificity(kind: Column) -> Column:
    rank = F.lit(V.SPECIFICITY_DEFAULT)
    for name, value in V.SPECIFICITY.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return rank


def _resolve(df: DataFrame, hits: str, out: str) -> DataFrame:
    """Aliases with their entries to ordered places: context vote, choice among namesakes, order."""
    single = F.filter(F.col(hits), lambda m: F.size(m["entries"]) == 1)
    df = (df.withColumn("_admins", F.transform(single, lambda m: F.get(m["entries"], 0)["admin"]))
          .withColumn("_nations", F.transform(single, lambda m: F.get(m["entries"], 0)["country"])))

    def score(e):
        vote = F.when(F.array_contains(F.col("_admins"), e["admin"]), V.ADMIN_VOTE).otherwise(0.0)
        vote = vote + F.when(F.array_contains(F.col("_nations"), e["country"]), V.COUNTRY_VOTE).otherwise(0.0)
        return vote + F.coalesce(F.least(F.lit(1.0), e["population"] / V.FULL_POPULATION), F.lit(0.0))

    df = df.withColumn("_ranked", F.transform(F.col(hits), lambda m: F.array_sort(F.transform(
        m["entries"], lambda e, i: F.struct((-score(e)).alias("neg"), i.alias("i"), e.alias("e"))))))

    def pick(r, i):
        margin = F.get(r, 1)["neg"] - F.get(r, 0)["neg"]
        sure = F.when(F.size(r) == 1, V.SURE_ALONE)
        for lead, confidence in V.SURE_BY_LEAD:
            sure = sure.when(margin >= lead, confidence)
        sure = sure.otherwise(V.SURE_OTHERWISE)
        e = F.get(r, 0)["e"]
        others = F.transform(F.slice(r, F.lit(2), F.size(r)), lambda x: F.struct(
            x["e"]["name"].alias("name"), x["e"]["lat"].alias("lat"), x["e"]["lon"].alias("lon")))
        conf = F.when(e["kind"] == "region", F.least(sure, F.lit(V.SURE_REGION))).otherwise(sure)
        hit = F.struct(
            e["name"].alias("name"), e["kind"].alias("kind"), e["lat"].alias("lat"), e["lon"].alias("lon"),
            conf.alias("confidence"), F.lit("gazetteer").alias("method"),
            F.when(F.size(others) > 0, others).alias("alternatives"),
            F.when(e["community"].isNotNull(), F.struct(e["community"].alias("name"), e["name"].alias("id"))).alias("community"))
        return F.struct(_specificity(e["kind"]).alias("s"), (-conf).alias("c"), i.alias("i"), hit.alias("hit"))

    df = df.withColumn("_picked", F.transform(F.col("_ranked"), pick))
    names = F.transform(F.col("_picked"), lambda p: p["hit"]["name"])
    first = F.filter(F.col("_picked"), lambda p, i: F.array_position(names, p["hit"]["name"]) == i + 1)
    ordered = F.array_sort(first, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"])
                           .when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1).otherwise(a["i"] - b["i"]))
    df = df.withColumn(out, F.transform(ordered, lambda p: p["hit"]).cast(S.PLACES))
    return df.drop("_admins", "_nations", "_ranked", "_picked")


def find_aliases(posts: DataFrame, gazetteer: Places | DataFrame | None, text: Column,
                 countries: list[str] | None = None, out: str = "_hits") -> DataFrame:
    """Adds the accepted aliases of each post with their entries, limited to ``countries`` when given."""
    if isinstance(gazetteer, DataFrame) and fits_inline(gazetteer):
        gazetteer = Places.of(gazetteer)
    if isinstance(gazetteer, DataFrame):
        df = _joined_candidates(posts, text, gazetteer)
    else:
        places = gazetteer or Places.of()
        df = posts.withColumn("_words", settle(F.split(F.trim(searchable(text, places)), " ")))
        df = df.withColumn("_cands", _inline_candidates(F.col("_words"), places)).drop("_words")
    empty = F.array().cast(f"array<struct<alias:string,entries:array<{_ENTRY}>>>")
    df = df.withColumn(out, F.when(F.size("_cands") > 0, _accept(F.col("_cands"))).otherwise(empty)).drop("_cands")
    if countries:
        scoped = F.transform(F.col(out), lambda m: F.struct(
            m["alias"].alias("alias"), F.filter(m["entries"], lambda e: e["country"].isin(countries)).alias("entries")))
        df = df.withColumn(out, F.filter(scoped, lambda m: F.size(m["entries"]) > 0))
    return df


def _joined_candidates(posts: DataFrame, text: Column, gazetteer: DataFrame) -> DataFrame:
    """Candidates for a gazetteer of any size: the n-grams that bitmaps of the aliases let pass meet the alias table in an equi-join.

    Spark picks the join by the table's size; a post's candidates are collected again per ``seq``, which its own
    length bounds.
    """
    aliases = alias_table(gazetteer)
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    singles = aliases.where(~F.col("alias").contains(" ") & (F.length("alias") >= 3))
    df = _searchable_joined(posts, text, singles)
    words = df.select("seq", settle(F.split("_hay", " ")).alias("w"))
    grams = words.select("seq", F.explode(settle(_likely_grams(F.col("w"), aliases, longest))).alias("g")).select("seq", "g.*")
    found = (grams.join(aliases, "alias")
             .groupBy("seq").agg(F.collect_list(F.struct("rank", "pos", "n", "alias", "entries")).alias("_cands")))
    empty = found.schema["_cands"].dataType.simpleString()
    return (df.drop("_hay").join(found, "seq", "left")
            .withColumn("_cands", F.coalesce("_cands", F.array().cast(empty))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = (F.pow(F.sin(d_lat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2))
    return 2 * V.EARTH_KM * F.asin(F.sqrt(h))


def nearest_community(lat: Column, lon: Column, places: Places, radius_km: float = V.COMMUNITY_RADIUS_KM) -> Column:
    """Community of the closest reserve point within the radius, or null. Not a boundary test."""
    reserves = [{"ord": i, "name": r["community"] or r["name"], "id": r["name"], "lat": r["lat"], "lon": r["lon"]}
                for i, r in enumerate(places.reserves())]
    table = F.from_json(F.lit(json.dumps(reserves)),
                        "array<struct<ord:int,name:string,id:string,lat:double,lon:double>>")
    band = radius_km / 111.0  # a degree of latitude is a little longer, so the band is safe
    near = F.filter(table, lambda r: F.abs(r["lat"] - lat) <= band)
    measured = F.transform(near, lambda r: F.struct(
        haversine_km(lat, lon, r["lat"], r["lon"]).alias("km"), r["ord"].alias("ord"),
        r["name"].alias("name"), r["id"].alias("id")))
    best = F.array_min(F.filter(measured, lambda m: m["km"] <= radius_km))
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["id"].alias("id")))


def accepted_coordinates(lat: Column, lon: Column) -> Column:
    """Both numeric, on Earth, and not the (0, 0) that stands for missing."""
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def provided_place(lat: Column, lon: Column, places: Places, name: Column | None = None,
                   method: Column | None = None) -> Column:
    method = F.lit("provided") if method is None else method
    default = F.when(method == "exif", "EXIF coordinates").otherwise("Provided coordinates")
    named = default if name is None else F.coalesce(F.when(name != "", name), default)
    return F.struct(named.alias("name"), F.lit("point").alias("kind"), lat.alias("lat"), lon.alias("lon"),
                    F.lit(1.0).alias("confidence"), method.alias("method"),
                    F.lit(None).cast("array<struct<name:string,lat:double,lon:double>>").alias("alternatives"),
                    nearest_community(lat, lon, places).alias("community")).cast(S.PLACE)


def geoparse(posts: DataFrame, gazetteer: Places | DataFrame | None = None, countries: list[str] | None = None,
             text: str = "text", use_place: bool = True, communities: Places | None = None,
             skip: Column | None = None) -> DataFrame:
    """Adds ``places``: the given coordinates when there are any, else the places the text names.

    ``skip`` marks posts without coordinates whose text is not searched. ``use_place`` searches the place
    column too and names a given point after it. ``communities`` supplies reserves when the gazetteer itself
    is a large table; without it they are joined from that table.
    """
    if isinstance(gazetteer, DataFrame) and fits_inline(gazetteer):
        gazetteer = Places.of(gazetteer)
    large = isinstance(gazetteer, DataFrame)
    small = communities or (Places(()) if large else gazetteer or Places.of())
    has_place = use_place and "place" in posts.columns
    given = accepted_coordinates(F.col("lat"), F.col("lon"))
    method = F.col("geo_method") if "geo_method" in posts.columns else None
    searched = F.col(text)
    if has_place:
        searched = F.concat(searched, F.lit(" "), F.coalesce("place", F.lit("")))
    ignore = given if skip is None else given | F.coalesce(skip, F.lit(False))
    df = posts.withColumn("_search", F.when(ignore, "").otherwise(F.coalesce(searched, F.lit(""))))
    df = _resolve(find_aliases(df, gazetteer, F.col("_search"), countries), "_hits", "_found")
    point = provided_place(F.col("lat"), F.col("lon"), small, F.col("place") if has_place else None, method)
    places = F.when(given, F.array(point)).otherwise(F.col("_found"))
    df = df.withColumn("places", settle(places)).drop("_search", "_hits", "_found")
    return _with_joined_communities(df, gazetteer) if large and communities is None else df


def _with_joined_communities(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Communities of given points from a gazetteer that is joined: distinct points meet the reserves of their cells."""
    given = accepted_coordinates(F.col("lat"), F.col("lon"))
    near = nearest_community_joined(df.where(given).select("lat", "lon").distinct(), reserves_of(gazetteer))
    df = df.join(near.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_near"), (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left")
    changed = F.transform("places", lambda p: p.withField("community", F.col("_near")))
    return df.withColumn("places", F.when(given, changed).otherwise(F.col("places"))).drop("_lat", "_lon", "_near")


def nearest_community_joined(points: DataFrame, reserves: DataFrame, radius_km: float = V.COMMUNITY_RADIUS_KM) -> DataFrame:
    """(lat, lon, _near: name and id of the nearest reserve's community) for distinct points and a reserve table of any size.

    An equi-join on quarter-degree cells, then the distance: a reserve is copied into every cell its radius can touch, round
    the date line too, and a point lies in one, so no pair is tried outside neighbouring cells.
    """
    cell, band, around = 0.25, radius_km / 111.0, 1440
    wide = F.lit(band) / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + band, F.lit(89.9)))), F.lit(0.001))
    r = reserves.select(
        F.struct("ord", "community", "name", "lat", "lon").alias("r"), F.least(wide, F.lit(180.0)).alias("_w"),
        F.explode(F.sequence(F.floor((F.col("lat") - band) / cell), F.floor((F.col("lat") + band) / cell))).alias("_cy"))
    columns = F.transform(F.sequence(F.floor((F.col("r.lon") - F.col("_w")) / cell), F.floor((F.col("r.lon") + F.col("_w")) / cell)), lambda c: F.pmod(c, F.lit(around)))
    r = r.select("r", "_cy", F.explode(F.array_distinct(columns)).alias("_cx"))
    p = points.select("lat", "lon", F.floor(F.col("lat") / cell).alias("_cy"), F.pmod(F.floor(F.col("lon") / cell), F.lit(around)).alias("_cx"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("r.lat"), F.col("r.lon"))
    near = p.join(r, ["_cx", "_cy"]).withColumn("km", km).where(F.col("km") <= radius_km)
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("km", "r")).alias("b"))
    return best.select("lat", "lon", F.struct(F.col("b.r.community").alias("name"), F.col("b.r.name").alias("id")).alias("_near"))


def community_rollup(records: DataFrame) -> DataFrame:
    """Posts per community; a post that names one twice counts once."""
    names = F.array_distinct(F.filter(F.transform("places", lambda p: p["community"]["name"]), lambda n: n.isNotNull()))
    return records.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("count"))
