import pytest
from hypothesis import given, settings, strategies as st

from postsieve.llm import url_filter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("NET", "/fr/", "block"), ("t.net", "", "block"),
         ("dup.org", "/a", "allow"), ("dup.org", "/a", "block"), (None, "/x", "block"), ("odd.org", None, "block"), ("q.org", "/", "perhaps")]
URLS = ["http://www.example.com/en/1", "https://EXAMPLE.com/en/", "https://example.com/enx", "http://com/", "http://com", "http://xcom/", "ftp://a.b.net/es/?q=/fr/", "http://net/fr/x#y",
        "http://net?x=/fr/", "http://T.net", "http://a.t.net?z", "http://dup.org/ab", "http://odd.org/anything", "http://q.org/", "no scheme", "", None, "x://y://com/", "http://é.example.com/en/ü",
        "http://example.com./en/", "http://" + "a." * 400 + "com/" + "p" * 5000, "http://a.com/\nb?c"]
SCHEMA = "page_id long, url string, host string, rule string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for h, p, v in rules:
        if h and v in ("allow", "block") and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or ""):
            best = max(best or (0,), (len(h + (p or "")), len(h), h.lower() + (p or ""), v == "block"))
    return host, path, best and best[2], ("block" if best[3] else "allow") if best else default


@pytest.mark.parametrize("limit", [U.MAX_FILE_BYTES, 1])
def test_equals_brute_force_as_file_and_as_join(spark, limit):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y"), (None, URLS[1], "x", "y")], SCHEMA)
    got = {(r[0], r[1:]) for r in map(tuple, U.judge_urls(pages, rules, max_file_bytes=limit).collect())}
    assert got == {(i, brute(u, RULES)) for i, u in enumerate(URLS)} | {(None, brute(URLS[1], RULES))}


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", "x", "y")], SCHEMA)
    assert tuple(U.judge_urls(pages, none, default="block").first()) == (1, "a.com", "/", None, "block")
    assert U.judge_urls(pages.limit(0), none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b.a", "c.b.a", "d"]), st.sampled_from(["", "/", "/x", "/x/y"]), st.sampled_from(["allow", "block"])), unique_by=lambda r: r[:2]),
       st.lists(st.tuples(st.sampled_from(["a", "b.a", "c.b.a", "d", "z", ""]), st.sampled_from(["", "/", "/x", "/x/y/z"])), min_size=1))
def test_colliding_keys_do_no_harm(rules, urls):
    same = lambda text: 7
    array = U.DigestArray(U.DigestArray.build(rules, key=same))
    rule, verdict = array.judge([h for h, _ in urls], [p for _, p in urls], key=same)
    assert [(r, v) for r, v in zip(rule, verdict)] == [(b[2], b[3] if b[2] else None) for b in (brute(f"http://{h}{p}", rules) for h, p in urls)]
