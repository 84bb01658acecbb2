"""Variants, hints, states, candidate URLs and landed files on rows written by hand."""

import json
import os

import duckdb
from pyspark.sql import functions as F

from quarry import queries
from quarry.functions import names, urls
from quarry.operators import quality, reports, tagging
from quarry.sources import readers


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


def test_tags(spark):
    aliases = spark.createDataFrame([("navbar", "navbar", False, False), ("navbar", "mega nav", False, False), ("form", "form", False, False), ("card", "card", False, False)], tagging.SCHEMA)
    texts = spark.createDataFrame([(1, "Mega navbar"), (2, "mega nav"), (3, "sticky card"), (4, None)], "id int, text string")
    v = spark.createDataFrame([("navbar", "mega", "mega"), ("card", "sticky", "sticky")], "element string, variant string, alias string")
    assert {tuple(r) for r in tagging.variants(texts, aliases, v).collect()} == {(1, "navbar", "mega"), (3, "card", "sticky")}
    rows = spark.createDataFrame(
        [(1, "CardUI", "CardUI navbar", ["form", "card"], ["components"], "a card", "n" * 101), (2, "x", None, None, None, "card", None), (3, None, None, [None], ["motion"], None, "a navbar")],
        "id int, name string, desc string, labels array<string>, categories array<string>, about string, note string",
    )
    assert {tuple(r) for r in tagging.hints(rows, aliases).collect()} == {(1, "navbar", True), (1, "card", False), (3, "navbar", False)}


def test_states(spark):
    rows = [("a", 200, "text/plain", "# A", False, False), ("a", 404, "text/html", "", False, False), ("b", 200, "text/html", "<html>", False, False), ("c", 401, "text/plain", "login", False, True), ("d", 403, "text/html", "x", True, False), ("e", None, None, None, None, None)]
    got = {r.id: r.state for r in quality.llms_state(spark.createDataFrame(rows, "id string, status int, type string, body string, challenged boolean, gated boolean")).collect()}
    assert got == {"a": "ok", "b": "no-llms", "c": "gated", "d": "challenge", "e": "no-llms"}
    rows = [("f", None, None, None, 200, False), (None, "README.md", None, None, 0, True), (None, None, "ok", None, 0, False), (None, None, "gated", "no-llms", 200, False), (None, None, None, "challenge", 200, False), (None, None, None, None, 200, True), (None, None, None, None, 503, True), (None, None, None, "no-llms", 200, False)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e int, f boolean").select(quality.reachability(*[F.col(x) for x in "abcdef"]))
    assert [r[0] for r in df.collect()] == ["corpus:f", "repo:README.md", "registry", "gated", "bot-walled", "repo-gone", "dead", "no-endpoint"]


def test_reports(spark):
    s = spark.createDataFrame([(1, "Button props"), (1, "button"), (1, "A b"), (1, "Card"), (2, None)], "doc int, title string")
    assert [tuple(r) for r in reports.title_hints(s).collect()] == [(1, ["button 2", "card 1"])]
    u = reports.unreachable(spark.createDataFrame([(["a", "b"], "dead"), (["a"], "gated")], "categories array<string>, reason string"))
    assert {tuple(r) for r in u.collect()} == {("a", "dead", 1), ("a", "gated", 1), ("b", "dead", 1), ("a", None, 2), ("b", None, 1)}
    t = reports.taxonomy_prompt(spark.createDataFrame([("g", 1, "b", None), ("g", 0, "a", "x")], "group string, pos int, id string, definition string"))
    assert t.first().text == "- a: x\n- b: "


def test_urls(spark):
    assert one(spark, "a b/c", lambda c: urls.candidates(c, ["https://x/{name}.json", "https://x/{name}.json", "https://y/{name}"])) == ["https://x/a%20b/c.json", "https://y/a%20b/c"]
    assert one(spark, "../c", lambda c: urls.candidates(c, ["https://x/{name}"])) == [] and one(spark, None, lambda c: urls.candidates(c, ["https://x/{name}"])) == []
    assert one(spark, "radix/x", lambda c: urls.probe(c, "https://x/{name}")) == f"https://x/radix/{urls.NO_SUCH_NAME}"
    short = lambda d: one(spark, d, lambda c: names.short_desc(c, F.lit("Acme Kit"), F.lit("acme.dev")))
    assert [short(d) for d in ("Acme — buttons", "GitHub - o/r: Kits", "Other - buttons", None, "x" * 120)] == ["buttons", "Kits", "Other - buttons", "", "x" * 97 + "…"]


def test_landed(spark, tmp_path):
    files = lambda x: [tuple(f) for f in one(spark, json.dumps(x), readers.item_files)]
    assert files({"files": [{"path": "a.tsx", "content": "1"}, {"target": "b", "content": "2"}, {"path": "../c", "content": "3"}, {"path": "d"}]}) == [("a.tsx", "1"), ("b", "2")]
    assert files({"css": {".a": "x"}, "cssVars": {"k": 1}}) == [("css", '.a {\nx\n}\n\n:root {\n{"k":1}\n}')]
    assert files({}) == [] and one(spark, "no json", readers.item_files) == []
    lines = spark.createDataFrame([("A.com # x",), ("# no",), ("a.com",), ("",), (None,)], "value string")
    assert [r.domain for r in readers.domain_list(lines).collect()] == ["a.com"]
    (tmp_path / "rendered-1.json").write_text(json.dumps({"url": "https://a.com", "links": ["https://a.com/x"], "anchors": [{"id": "i", "text": "t"}]}, indent=1))
    assert readers.rendered(spark, str(tmp_path)).first().anchors[0].id == "i"
    p = readers.probe_summary(spark.createDataFrame([("s", "u", "<a href='/docs/a'></a><a href='/docs'></a><a href='/x?y'></a><h2 id=a></h2>"), ("t", "u", None)], "site string, url string, html string"))
    assert {r.site: (r.links, r.prefixes, r.ids) for r in p.collect()} == {"s": (3, ["/docs 2", "/x 1"], 1), "t": (None, None, None)}


def test_files_are_written_by_tasks(spark, tmp_path):
    """A file a row, also for equal names; none in a folder of its own."""
    at = tmp_path / "files"
    rows = [(f"n{k % 40}", f"ü{k}\nx\n") for k in range(50)] + [("empty", "")]
    readers.write_files(spark.createDataFrame(rows, "name string, content string"), f"file://{at}")
    assert sorted(r.value for r in readers.text_files(spark, f"file://{at}").collect()) == sorted(c for _, c in rows if c)
    assert len(os.listdir(at)) == 51 and all((at / f).is_file() for f in os.listdir(at))


def landed_by(spark, query, d):
    """The rows of a query, and what it left in the shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    got = [tuple(r) for r in queries.queries()[query](spark, d).collect()]
    (new,) = set(os.listdir(shared)) - before
    return got, [f.is_file() for f in os.scandir(f"{shared}/{new}")]


def test_renders_are_landed_without_folders(spark, tmp_path):
    """The last page of a site counts, by number and not by its digits; a page is a file, not a folder."""
    rows = [(9, "https://a.com/x", ""), (10, "https://a.com/y", ""), (12_345_678_901, "https://b.com/z", ""), (2, "https://b.com", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, files = landed_by(spark, "renders_read", str(tmp_path))
    assert sorted(got) == [(10, "a.com"), (12_345_678_901, "b.com")] and files == [True] * 4


def test_texts_are_landed_without_folders(spark, tmp_path):
    """Rows of equal keys are files of their own."""
    rows = [(1, "a", 3, 0.0), (1, "b", 4, 0.0), (2, "c", 5, 0.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got, files = landed_by(spark, "text_round_trip", str(tmp_path))
    assert sorted(got) == [(1, "a\n3"), (1, "b\n4"), (2, "c\n5")] and files == [True] * 3


def test_gunzipped_bodies_as_in_sql(spark, tmp_path):
    """Bodies that say little in many bytes, and empty ones: cut short they are corrupt, or too large where they were."""
    rows = [(k, "u", t) for k, t in [(3, ""), (7, "a"), (11, "ab" * 2000), (15, "x" * 3001), (19, "x" * 3000), (1, ""), (5, "y" * 4000), (2, ""), (23, "ü" * 3001)]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.queries()["gunzipped_bodies"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["gunzipped_bodies"]).fetchall())
