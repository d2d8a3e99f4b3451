import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postsieve.sources import csv_posts, files, links


def read(spark, content, **kw):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = os.path.join(folder, "up.csv")
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    posts, rejects, report = csv_posts.read_posts_csv(spark, path, **kw)
    return posts.orderBy("seq").collect(), rejects.orderBy("row", "reason").collect(), report


@pytest.mark.parametrize("content,texts", [
    ("tweet\nFerry stops at six\nNo wind today", ["Ferry stops at six", "No wind today"]),
    ("id;tweet\n1;Ring road wet, go slow\n2;Market opens late", ["Ring road wet, go slow", "Market opens late"]),
    ("tweet\tother\nLower lane is a pond\tx\nJust fog\ty", ["Lower lane is a pond", "Just fog"]),
    ("tweet|other\nLeave the east bank|x\nIdle shift|y", ["Leave the east bank", "Idle shift"]),
    ("﻿tweet\nGauge up again\n", ["Gauge up again"]),
    ("tweet\r\nGate shut\r\nLane free\r\n", ["Gate shut", "Lane free"]),
    ("tweet\rGate shut\rLane free", ["Gate shut", "Lane free"]),
    ('tweet\n"Hail, mud, and sleet in one hour"\n"Sun, shade, tea"', ["Hail, mud, and sleet in one hour", "Sun, shade, tea"]),
    ('tweet,other\n"Top half of a note\nbottom half of it",x\n"Short note",y', ["Top half of a note\nbottom half of it", "Short note"]),
    ('tweet\n"Sign reads ""no boats"" in red"', ['Sign reads "no boats" in red']),
    ("text,text,text\nTake this one,dupe b,dupe c\nAnd that,x,y", ["Take this one", "And that"]),
    ("text,,other\nKept words,left out,other value", ["Kept words"]),
    ("Post Body (raw)\nCreek has left its bed by the mill\nSlow day", ["Creek has left its bed by the mill", "Slow day"]),
])
def test_dialects(spark, content, texts):
    posts, rejects, _ = read(spark, content)
    assert [p["text"] for p in posts] == texts and rejects == []
    assert [p["id"] for p in posts] == [f"c{i + 2}" for i in range(len(texts))]


def test_ragged_rows_are_flagged_and_kept(spark):
    posts, rejects, _ = read(spark, "a,b,text\nonly,two\nx,y,fine\nq,r,s,t")
    assert [p["text"] for p in posts] == ["fine", "s"]
    assert [(r["row"], r["reason"]) for r in rejects] == [
        (2, "Too few fields: expected 3 fields but parsed 2"), (2, 'column "text" was empty'), (4, "Too many fields: expected 3 fields but parsed 4")]


def test_ragged_rows_with_long_quoted_cells(spark):
    cell = '"' + "word, " * 3000 + '""said"" once"'
    posts, rejects, _ = read(spark, f"a,text\n{cell},fine,extra\nx,ok\n")
    assert [p["text"] for p in posts] == ["fine", "ok"] and [r["reason"] for r in rejects] == ["Too many fields: expected 2 fields but parsed 3"]


def test_folder_must_be_shared_outside_one_process(spark, monkeypatch):
    from postsieve import session

    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "local-cluster[2,1,1024]", "app"
    with pytest.raises(RuntimeError):
        session.scratch_path(Far, "x")
    Far.conf.get = staticmethod(lambda key, default=None: "file:///shared")
    assert session.scratch_path(Far, "x").startswith("file:///shared/app/x-")


def test_blank_rows_header_only_and_empty(spark):
    posts, rejects, _ = read(spark, "tweet\nfirst\n   \n\nlast\n")
    assert [p["text"] for p in posts] == ["first", "last"] and [(r["row"], r["reason"]) for r in rejects] == [(3, 'column "tweet" was empty')]
    assert read(spark, "tweet\n")[1][0]["reason"].endswith("no data rows") and read(spark, "tweet\n")[1][0]["row"] == 1
    assert read(spark, "")[1][0]["row"] == 0


def test_coordinates(spark):
    posts, _, _ = read(spark, "tweet,lat,lon\nBad,not-a-number,junk\nGood,51.05,-114.07\nImpossible,200,50\nZero,0,0\nHalf,51,")
    assert [(p["lat"], p["lon"]) for p in posts] == [(None, None), (51.05, -114.07), (None, None), (None, None), (None, None)]


def test_forced_and_inferred_column(spark):
    content = "a,b,c\n1,some longer words here,7\n2,and other words,8"
    assert read(spark, content)[2].chosen_column == "b" and read(spark, content, forced_column="c")[2].chosen_column == "c"
    assert read(spark, "a,b,c\n1,2,3\n4,5,6")[2].chosen_column


def test_header_matching():
    assert csv_posts.pick_header(["Tweet Text", "geo_x"], ["lon", "x"]) == "geo_x"
    assert csv_posts.pick_header(["tweet_text_cleaned"], ["text", "tweet_text"]) == "tweet_text_cleaned"


def test_big_cell_and_utf16(spark):
    assert len(read(spark, 'tweet,b\n"' + "word " * 200_000 + '",x')[0][0]["text"]) == 999_999
    posts, _, _ = read(spark, b"\xff\xfe" + "tweet\nGate shut\n".encode("utf-16le"), encoding="UTF-16")
    assert [p["text"] for p in posts] == ["Gate shut"]


def test_parts_number_rows_through(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, rows in enumerate((["a", " "], [" ", "b"])):
        with open(f"{folder}/p{i}.csv", "w") as f:
            f.write("tweet\n" + "\n".join(rows) + "\n")
    posts, rejects, _ = csv_posts.read_parts(spark, folder)
    assert [p["id"] for p in posts.orderBy("seq").collect()] == ["k0_c2", "k1_c3"]
    assert sorted(r["row"] for r in rejects.collect()) == [3, 4]


def folder_of(files):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, content in files.items():
        with open(f"{folder}/{name}.csv", "w", newline="") as f:
            f.write(content)
    return folder


def read_folder(spark, files, **kw):
    posts, rejects, report = csv_posts.read_posts_csv(spark, folder_of(files), parts=True, **kw)
    return posts.orderBy("seq").collect(), rejects.orderBy("row", "reason").collect(), report


def test_every_file_has_its_own_header(spark):
    posts, rejects, report = read_folder(spark, {
        "a": "id,text,author\n1,alpha flood,ann\n", "b": "text,author,id\n\"gamma, flood here\",cat,3\n", "c": "Author,Id,Tweet,lat,lon\ndan,4,delta,51,-114\nshort,5\n",
        "d": "name,price\nboat,3\nrope,4\n", "e": "TEXT,Id\nepsilon,6\n"})
    assert [(p["text"], p["author"], p["id"]) for p in posts] == [("alpha flood", "ann", "k0_c2"), ("gamma, flood here", "cat", "k1_c2"), ("delta", "dan", "k2_c2"), ("epsilon", None, "k4_c2")]
    reasons = [(r["row"], r["reason"]) for r in rejects]
    assert [x for x in reasons if "header" in x[1]] == [(n, 'column "text" is not in this file\'s header') for n in (6, 7)]
    assert sorted(x[1] for x in reasons if "header" not in x[1]) == ["Too few fields: expected 5 fields but parsed 2", 'column "text" was empty']
    assert len(posts) + len({x[0] for x in reasons}) == 7 and report.width == 3


def test_a_header_that_does_not_end_is_reported(spark):
    posts, rejects, _ = read_folder(spark, {"a": "id,text\n1,fine\n2,too\n", "b": 'id,"text\n' + "3,lost\n" * 40, "c": "text,id\nlast,4\n"}, max_record=100)
    assert [p["text"] for p in posts] == ["fine", "too", "last"]
    assert [r["reason"] for r in rejects] == ["Quoted field of more than 100 characters"]


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)


def test_quoted_line_ends_over_many_splits(spark):
    import csv
    import io
    import random
    rng = random.Random(3)
    pieces = ["flood", "a, b", 'he said "no"', "\n", "\n\n", "x" * 40, ",", '"', "end", "5\" pipe"]
    rows = [[str(k), " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))), rng.choice(["ann", "bob", ""])] for k in range(600)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "text", "author"])
    for k, r in enumerate(rows):
        writer.writerow(r)
        if k % 50 == 0:
            out.write("\n")
    plain = "author,text\n" + "".join(f"zed,plain row {k}\n" for k in range(80))
    try:
        small_splits(spark, 700)
        posts, rejects, _ = read_folder(spark, {"a": out.getvalue(), "b": plain})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = [(k, r) for k, r in enumerate(rows) if r[1].strip()]
    want = [(f"k0_c{k + 2}", r[1].strip(), r[2] or None) for k, r in kept] + [(f"k1_c{k + 2}", f"plain row {k}", "zed") for k in range(80)]
    assert [(p["id"], p["text"], p["author"]) for p in posts] == want
    assert [r["row"] for r in rejects] == [k + 2 for k, r in enumerate(rows) if not r[1].strip()]


def test_stray_quotes_do_not_open_a_field(spark):
    posts, rejects, _ = read(spark, 'id,text\n1,a 5" pipe\n2,b 6" and 7" pipe\n3,"whole, text"\n4,say ""x""\n')
    assert [p["text"] for p in posts] == ['a 5" pipe', 'b 6" and 7" pipe', "whole, text", 'say ""x""'] and rejects == []


def test_unclosed_quotes_are_reported(spark):
    posts, rejects, _ = read(spark, 'id,text\n1,fine\n2,"open\n3,rest\n')
    assert [p["text"] for p in posts][0] == "fine" and len(posts) == 2
    assert (3, "Quoted field unterminated") in [(r["row"], r["reason"]) for r in rejects]
    posts, rejects, _ = read(spark, 'id,text\n1,fine\n2,"open\n' + "3,rest of it\n" * 50, max_record=100)
    assert [p["text"] for p in posts] == ["fine"] and [(r["row"], r["reason"]) for r in rejects] == [(3, "Quoted field of more than 100 characters")]


def test_encodings(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cases = {
        "a": (b"\xef\xbb\xbftweet", "utf-8", "certain", "tweet"), "b": (b"\xff\xfe" + "road".encode("utf-16le"), "utf-16le", "certain", "road"),
        "c": (b"\xfe\xff" + "road".encode("utf-16be"), "utf-16be", "certain", "road"), "d": ("Harbour light".encode("utf-16le"), "utf-16le", "guessed", "Harbour light"),
        "e": ("Café — \U0001f30a".encode(), "utf-8", "certain", "Café — \U0001f30a"), "f": (b"Caf\xe9 isn\x92t", "windows-1252", "guessed", "Café isn’t"),
    }
    for name, (content, *_rest) in cases.items():
        with open(f"{folder}/{name}.csv", "wb") as f:
            f.write(content)
    got = {r["path"].rsplit("/", 1)[1][0]: (r["encoding"], r["confidence"], r["text"]) for r in files.audit_files(spark, folder + "/*.csv").collect()}
    assert got == {k: v[1:] for k, v in cases.items()}


def test_ranges_cut_no_character_and_no_line(spark):
    body = "tweet,n\r\n" + "".join(f"Café \U0001f30a — 水 {k},{k}\r\n" for k in range(40)) + 'last "one\ntwo",9'
    wide, late = body.encode("utf-16le"), ("plain line\n" * 30).encode() + b"isn\x92t\n"
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    cases = {"u": body.encode(), "l": b"\xff\xfe" + wide, "b": b"\xfe\xff" + body.encode("utf-16be"), "w": late}
    for name, content in cases.items():
        with open(f"{folder}/{name}.csv", "wb") as f:
            f.write(content)
    for size in (8, 10, 66, 1 << 20):
        rows = files.audit_files(spark, folder + "/*.csv", size).orderBy("path", "start").collect()
        text, said = {}, {}
        for r in rows:
            name = r["path"].rsplit("/", 1)[1][0]
            text[name] = text.get(name, "") + r["text"]
            said[name] = (r["encoding"], r["confidence"])
        assert text == {"u": body, "l": body, "b": body, "w": "plain line\n" * 30 + "isn’t\n"} and len(rows) == sum(-(-len(c) // size) for c in cases.values())
        assert said == {"u": ("utf-8", "certain"), "l": ("utf-16le", "certain"), "b": ("utf-16be", "certain"), "w": ("windows-1252", "guessed")}
        for name, encoding in (("l", "UTF-16"), ("b", "UTF-16"), ("w", "windows-1252")):
            lines = files.range_lines(spark, f"{folder}/{name}.csv", encoding, True, size).orderBy("block", "id").collect()
            assert [r["value"] for r in lines] == [x.rstrip("\r") for x in text[name].split("\n") if x or name != "w"]


@pytest.mark.parametrize("size", [34, 4 << 20])
def test_other_encodings_are_read_by_ranges_too(spark, monkeypatch, size):
    monkeypatch.setattr(files.range_lines, "__defaults__", (size,))
    rows = ["Gate shut", 'Öl "spill"\n\nin two lines', "\r\nodd, start", "plain"] * 9
    body = "tweet,n\r\n" + "".join('"' + r.replace('"', '""') + f'",{k}\r\n' for k, r in enumerate(rows))
    for encoding, content in (("UTF-16", b"\xff\xfe" + body.encode("utf-16le")), ("UTF-16BE", body.encode("utf-16be")), ("windows-1252", body.encode("cp1252"))):
        posts, rejects, _ = read(spark, content, encoding=encoding)
        assert [p["text"] for p in posts] == [r.replace("\r\n", "\n").strip() for r in rows] and rejects == []


@pytest.mark.parametrize("url,outcome,route", [
    ("https://twitter.com/a/status/1", "ok", "x"), ("https://bsky.app/profile/a/post/k1", "ok", "bluesky"), ("https://bsky.app/about", "blocked", "bluesky"),
    ("https://m.example/@u/123", "ok", "mastodon"), ("https://e.org/p.PNG?x=1", "ok", "image"), ("http://localhost/x", "invalid", None),
    ("http://169.254.169.254/latest", "invalid", None), ("http://172.20.0.1/", "invalid", None), ("http://172.40.0.1/", "ok", "generic"),
    ("http://[::1]/", "invalid", None), ("http://[fd00::2]/", "invalid", None), ("ftp://x/", "invalid", None), ("nonsense", "invalid", None),
    ("https://old.reddit.com/r/x", "blocked", None), ("https://notreddit.com/", "ok", "generic"), ("https://threads.net/@u/post/1", "blocked", None),
])
def test_url_triage(spark, url, outcome, route):
    r = links.triage_urls(spark.createDataFrame([(url,)], "url string")).first()
    assert (r["outcome"], r["route"]) == (outcome, route)


def test_page_text(spark):
    html = ("<html><head><meta property='og:title' content='T &amp; U'><meta content=\"D\" property=\"og:description\"></head><body><nav>menu</nav>"
            "<main>M<aside>ad</aside> text&nbsp;&#8212; &#x41; &amp;lt; &#38;lt;<!-- c --> </main><footer>f</footer></body></html>")
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(links.readable_text(F.col("html"))).first()[0] == "T & U -- D\n\nM text — A &lt; &lt;"
    quote = "<blockquote><p lang='en'>Flood<br>now &lt;3</p>-- Someone</blockquote>"
    df = spark.createDataFrame([(quote,)], "html string")
    assert df.select(links.embedded_text(F.col("html"))).first()[0] == "Flood\nnow <3"
