"""Geoparsing as SQL over the places the sample posts can name."""

from postsieve import values as V
from postsieve.sources.gazetteer import Places, default_rows

# longest first, file order among equals
NAMED = ["millennium park", "siksika nation", "medicine hat", "high river", "highway 22", "glenmore", "sardinia",
         "calgary", "canmore", "siksika", "abflood", "boulder", "peguis", "london", "manila", "yyc"]


def _s(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def gazetteer_sql() -> str:
    rows = []
    for r in default_rows():
        for i, a in enumerate(r["aliases"]):
            rows.append("(" + ", ".join(_s(v) for v in (
                r["ord"], r["name"], a, i, r["lat"], r["lon"], r["kind"], r["admin"], r["country"],
                r["population"], r["is_first_nation"], r["community"])) + ")")
    return ("SELECT * FROM (VALUES " + ",\n".join(rows) + ") g(ord, name, alias, pos, lat, lon, kind, admin, country, "
            "population, is_first_nation, community)")


def alias_rank_sql() -> str:
    return ("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_s(a)})" for i, a in enumerate(Places.of().aliases()))
            + ") a(rank, alias)")


SPECIFICITY_SQL = ("CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.SPECIFICITY.items())
                   + f" ELSE {V.SPECIFICITY_DEFAULT} END")


def hay_sql(text: str = "text") -> str:
    x = f"lower({text})"
    for tag, words in (("#yycflood", " yycflood yyc flood "), ("#abflood", " abflood "), ("#job", " job ")):
        x = f"replace({x}, '{tag}', '{words}')"
    return f"' ' || trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g')) || ' '"


def km_sql(a_lat, a_lon, b_lat, b_lon):
    return (f"2 * 6371 * asin(sqrt(pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * "
            f"cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2)))")


def ok_sql(lat="lat", lon="lon"):
    return f"coalesce(abs({lat}) <= 90 AND abs({lon}) <= 180 AND NOT ({lat} = 0 AND {lon} = 0), false)"


def place_ctes(source: str, skip: str = "false", countries: str | None = None) -> dict[str, str]:
    """CTEs ending in ``placed``: one row per (id, place) with its position."""
    steps, prev = [], "h0"
    for i, a in enumerate(NAMED, 1):
        steps.append(f"contains({prev}, ' {a} ') AS m{i}, replace({prev}, ' {a} ', ' ') AS h{i}")
        prev = f"h{i}"
    hits = ", ".join(f"CASE WHEN m{i} THEN '{a}' END" for i, a in enumerate(NAMED, 1))
    scope = f"AND g.country IN ({countries})" if countries else ""
    return {
        "gaz": gazetteer_sql(),
        "found": f"SELECT id, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM (SELECT id, {hay_sql()} AS h0, "
                 + ", ".join(steps) + f" FROM {source} WHERE NOT {ok_sql()} AND NOT ({skip}))",
        "named": "SELECT id, unnest(hits) AS alias, generate_subscripts(hits, 1) AS mi FROM found",
        "cand": f"""SELECT n.id, n.mi, g.*, count(*) OVER (PARTITION BY n.id, n.mi) AS namesakes
                    FROM named n JOIN gaz g USING (alias) WHERE true {scope}""",
        "votes": "SELECT id, list(admin) AS admins, list(country) AS nations FROM cand WHERE namesakes = 1 GROUP BY id",
        "rated": """SELECT c.*, (CASE WHEN list_contains(v.admins, c.admin) THEN 3 ELSE 0 END)
                       + (CASE WHEN list_contains(v.nations, c.country) THEN 1 ELSE 0 END)
                       + coalesce(least(1.0, c.population / 2000000.0), 0) AS score
                     FROM cand c LEFT JOIN votes v USING (id)""",
        "ranked": """SELECT *, row_number() OVER w AS rn, score - lead(score) OVER w AS margin
                     FROM rated WINDOW w AS (PARTITION BY id, mi ORDER BY score DESC, ord)""",
        "chosen": """SELECT *, CASE WHEN kind = 'region' THEN least(sure, 0.4) ELSE sure END AS confidence FROM (
                       SELECT *, CASE WHEN namesakes = 1 THEN 0.85 WHEN margin >= 3 THEN 0.8 WHEN margin >= 1 THEN 0.55 ELSE 0.35 END AS sure,
                       row_number() OVER (PARTITION BY id, name ORDER BY mi) AS again FROM ranked WHERE rn = 1) WHERE again = 1""",
        "others": "SELECT id, mi, string_agg(name, '; ' ORDER BY rn) AS alternatives FROM ranked WHERE rn > 1 GROUP BY id, mi",
        "given": f"SELECT id, lat, lon FROM {source} WHERE {ok_sql()}",
        "close": f"""SELECT p.id, g.community, g.name AS cid, row_number() OVER (PARTITION BY p.id ORDER BY {km_sql('p.lat', 'p.lon', 'g.lat', 'g.lon')}, g.ord) AS r
                     FROM given p JOIN (SELECT DISTINCT ord, name, community, lat, lon FROM gaz WHERE is_first_nation) g
                     ON {km_sql('p.lat', 'p.lon', 'g.lat', 'g.lon')} <= 25""",
        "placed": f"""SELECT c.id, row_number() OVER (PARTITION BY c.id ORDER BY {SPECIFICITY_SQL}, confidence DESC, c.mi) - 1 AS pos,
                        name, kind, lat, lon, CAST(confidence AS DOUBLE) AS confidence, 'gazetteer' AS method, community,
                        CASE WHEN community IS NOT NULL THEN name END AS community_id, o.alternatives
                      FROM chosen c LEFT JOIN others o ON c.id = o.id AND c.mi = o.mi
                      UNION ALL
                      SELECT p.id, 0, 'Provided coordinates', 'point', p.lat, p.lon, CAST(1 AS DOUBLE), 'provided', k.community, k.cid, NULL
                      FROM given p LEFT JOIN close k ON p.id = k.id AND k.r = 1""",
    }
