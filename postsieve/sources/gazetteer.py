"""Gazetteers: the built-in one, reading another from a file, and merging new places.

A gazetteer is a DataFrame with GAZETTEER_SCHEMA. Every geo operator takes one as a parameter; a
file (JSON object with a ``places`` array, fields name, aliases, lat, lon, kind, admin, country, population,
isFirstNation, community) is read with ``read_gazetteer``.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

GAZETTEER_SCHEMA = (
    "ord int, name string, aliases array<string>, lat double, lon double, kind string, admin string, "
    "country string, population long, is_first_nation boolean, community string"
)

# Above this many aliases a gazetteer is joined as a table instead of travelling inside the plan.
MAX_INLINE_ALIASES = 5000


@lru_cache(maxsize=1)
def _default_rows() -> tuple:
    """The built-in places, a file of fixed values beside this module; a few hundred rows."""
    with open(os.path.join(os.path.dirname(__file__), "places.json"), encoding="utf-8") as f:
        places = json.load(f)["places"]
    return tuple({
        "ord": i, "name": p["name"], "aliases": [a.lower() for a in p["aliases"]], "lat": float(p["lat"]), "lon": float(p["lon"]),
        "kind": p["kind"], "admin": p["admin"], "country": p["country"], "population": p.get("population"),
        "is_first_nation": bool(p.get("isFirstNation", False)), "community": p.get("community"),
    } for i, p in enumerate(places))


def default_rows() -> list[dict]:
    return [dict(r) for r in _default_rows()]


def default_gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_rows(), GAZETTEER_SCHEMA)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Reads one JSON object with a ``places`` array."""
    fields = ("name string, aliases array<string>, lat double, lon double, kind string, admin string, "
              "country string, population long, isFirstNation boolean, community string")
    raw = spark.read.schema(f"places array<struct<{_ddl(fields)}>>").json(path, multiLine=True)
    place = raw.select(F.posexplode("places").alias("ord", "p")).select("ord", "p.*")
    return place.select(
        "ord", "name", F.transform("aliases", F.lower).alias("aliases"), "lat", "lon", "kind", "admin", "country",
        "population", F.coalesce("isFirstNation", F.lit(False)).alias("is_first_nation"), "community")


def _ddl(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(", "))


def merge_gazetteer(gazetteer: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds the places whose lower-cased name is absent. Returns (gazetteer, refused with a reason).

    Running it twice adds nothing the second time.
    """
    on_earth = F.coalesce(F.abs("lat") <= 90, F.lit(False)) & F.coalesce(F.abs("lon") <= 180, F.lit(False))
    known = gazetteer.select(F.lower("name").alias("_known")).distinct()
    keyed = new.withColumn("_key", F.lower("name"))
    # the first of several new rows with one name wins
    firsts = keyed.where(on_earth).groupBy("_key").agg(F.min("ord").alias("_first"))
    keyed = (keyed.join(known, keyed._key == known._known, "left").join(firsts, "_key", "left")
             .withColumn("reason", F.when(~on_earth, "bad coordinates").when(F.col("_known").isNotNull(), "already present")
                         .when(F.col("ord") != F.col("_first"), "repeated in the new places")))
    last = gazetteer.agg(F.max("ord")).first()[0]
    columns = gazetteer.columns
    added = keyed.where("reason is null").withColumn(
        "ord", (F.col("ord") + F.lit(1 + (-1 if last is None else last))).cast("int"))
    refused = keyed.where("reason is not null").select("name", "reason")
    return gazetteer.unionByName(added.select(columns)), refused


@dataclass(frozen=True)
class Places:
    """A gazetteer small enough to travel inside the query plan; its size is checked on construction."""

    rows: tuple

    @classmethod
    def of(cls, gazetteer: DataFrame | list[dict] | None = None) -> "Places":
        if gazetteer is None:
            return cls(tuple(default_rows()))
        if isinstance(gazetteer, DataFrame):
            if not fits_inline(gazetteer):
                raise ValueError("gazetteer is too large to inline; pass the DataFrame to geoparse")
            gazetteer = [r.asDict(recursive=True) for r in gazetteer.orderBy("ord").collect()]
        return cls(tuple(gazetteer))

    def alias_entries(self) -> dict[str, list[dict]]:
        index: dict[str, list[dict]] = {}
        for row in self.rows:
            for alias in row["aliases"]:
                index.setdefault(alias.lower(), []).append(row)
        return index

    def aliases(self) -> list[str]:
        """Longest first, file order among equals. The position is the alias rank used to break ties."""
        return sorted(self.alias_entries(), key=lambda a: -len(a))

    def reserves(self) -> list[dict]:
        return [r for r in self.rows if r["is_first_nation"]]

    def countries_of(self, names: list[str]) -> list[str]:
        """Countries behind a set of place names or aliases."""
        wanted = {n.lower() for n in names}
        return sorted({r["country"] for r in self.rows
                       if r["name"].lower() in wanted or wanted & set(r["aliases"])})

    def display_names(self, aliases: list[str]) -> list[str]:
        """Place names of aliases, repeats dropped, order kept; the last place of an alias names it."""
        names = {}
        for row in self.rows:
            for alias in [row["name"], *row["aliases"]]:
                names[alias.lower()] = row["name"]
        return list(dict.fromkeys(names[a.lower()] for a in aliases if a.lower() in names))


def fits_inline(gazetteer: DataFrame) -> bool:
    return gazetteer.select(F.explode("aliases")).limit(MAX_INLINE_ALIASES + 1).count() <= MAX_INLINE_ALIASES


def alias_table(gazetteer: DataFrame) -> DataFrame:
    """One row per alias with its entries in file order, for gazetteers that are joined."""
    entry = F.struct("name", "kind", "lat", "lon", "admin", "country", "population", "community")
    return (gazetteer.select("ord", F.posexplode("aliases").alias("pos", "alias"), entry.alias("entry"))
            .withColumn("alias", F.lower("alias"))
            .groupBy("alias")
            .agg(F.min(F.struct("ord", "pos")).alias("first"),
                 F.array_sort(F.collect_list(F.struct("ord", "entry"))).alias("e"))
            .select("alias", F.transform("e", lambda x: x["entry"]).alias("entries"),
                    F.struct(-F.length("alias"), "first").alias("rank")))


def _by_alias(gazetteer: DataFrame) -> DataFrame:
    """(alias, ord, name, country): every alias of every place, with the lower-cased name as one of them."""
    return gazetteer.select("ord", "name", "country", F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), F.transform("aliases", F.lower)))).alias("alias"))


def display_names(ranked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(name) of ranked aliases, each once; the last place of an alias names it."""
    named = ranked.select("alias").join(_by_alias(gazetteer), "alias").groupBy("alias").agg(F.max_by("name", "ord").alias("name"))
    return named.select("name").distinct()


def countries_of(ranked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(country) behind ranked aliases, each once."""
    return ranked.select("alias").join(_by_alias(gazetteer), "alias").select("country").distinct()


def reserves_of(gazetteer: DataFrame) -> DataFrame:
    """(ord, name, community, lat, lon) of the places that name a community."""
    return gazetteer.where("is_first_nation").select("ord", "name", F.coalesce("community", "name").alias("community"), "lat", "lon")
