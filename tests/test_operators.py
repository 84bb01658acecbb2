"""Operators on small rows written by hand."""

import gzip

import pytest
from pyspark.sql import functions as F

from quarry.functions import html, text, urls
from quarry.operators import catalog, items, quality, reports, search, sections, tagging, validation
from quarry.plans.api import Catalog
from quarry.sources import readers
from quarry.streaming import upserts


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize("word,want", [("buttons", "button"), ("categories", "category"), ("boxes", "box"), ("glass", "glass"), ("status", "status"), ("loading", "load"), ("animation", "anim"), ("nested", "nest"), ("h2s", "h2s"), ("tabs", "tab")])
def test_stem(spark, word, want):
    assert one(spark, word, text.stem) == want


def test_text(spark):
    assert one(spark, "AlertDialog v2Beta über-uns", text.tokens) == ["alert", "dialog", "v", "2", "beta", "über", "uns"]
    assert one(spark, "https://A.com/B c!", text.slug) == "a-com-b-c"
    assert one(spark, "alert-dialog_x", text.humanise) == "Alert Dialog X"
    assert one(spark, "abcdef", lambda c: text.clip(c, 4)) == "abc…"
    assert one(spark, "a</untrusted>", text.untrusted).count("</untrusted>") == 1
    assert one(spark, "under the MIT licence", text.license_of) == "MIT"
    assert one(spark, "x-demo", lambda c: text.rewrite(c, [("^(.*)-demo$", "$1"), ("x", "y")])) == "y"


@pytest.mark.parametrize("url,want", [("HTTPS://Www.A.com/B/?utm_source=x&b=1#c", "https://www.a.com/B?b=1"), ("http://a.com/)", "http://a.com"), ("ftp://a", None), ("https://a.com/x?ref=1", "https://a.com/x")])
def test_normalize(spark, url, want):
    assert one(spark, url, urls.normalize) == want


def test_urls(spark):
    assert one(spark, "https://www.github.com/Own/Repo/", urls.key) == "github.com/own/repo"
    assert [one(spark, h, urls.is_public) for h in ("a.com", "localhost", "10.1.2.3", "8.8.8.8", "192.168.0.1", "172.20.1.1", "a.local")] == [True, False, False, True, False, False, False]
    assert one(spark, "/docs/components/button", lambda c: urls.match(c, ["/docs/{*}/{name}", "/{name}"])) == "button"
    assert one(spark, "a.b.com", urls.suffixes) == ["a.b.com", "b.com", "com"]
    assert one(spark, "/x", lambda c: urls.repair(c, F.lit("a.com"))) == "https://a.com/x"
    assert one(spark, "../b", lambda c: urls.resolve(F.lit("https://a.com/x/y"), c)) == "https://a.com/b"
    assert one(spark, "https://a.com/p?page=2&x=1", lambda c: urls.with_page(c, "page", F.lit(3))) == "https://a.com/p?x=1&page=3"


def test_html(spark):
    page = "<html><head><title>A &amp; B</title><meta content='d' name='description'></head><body><nav><a href='/p'>Pricing</a></nav><h1>Head <b>x</b></h1><script>no</script><p>One</p><p>We use cookies</p><p>One</p><a href='#t'>t</a></body></html>"
    got = one(spark, page, lambda c: html.digest(F.lit("u"), c))
    assert (got.title, got.description, got.headings, got.nav, got.links) == ("A & B", "d", ["Head x"], ["Pricing"], ["/p"])
    assert one(spark, page, lambda c: html.clean_lines(html.visible(c))) == ["A & B", "Head x", "One", "t"]
    assert one(spark, "<title>Just a moment...</title>", lambda c: html.unreadable(F.lit(200), F.lit("text/html"), c)) == "challenge"


def test_sources(spark):
    md = "## Kits · 2\n| Name | What |\n|---|---|\n| [A](https://a.com) | first |\n## More\n| x | [B](https://b.com) | second |"
    rows = readers.markdown_rows(readers.lines_of(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t")).orderBy("pos").collect()
    assert [(r.category, r.name, r.url, r.desc) for r in rows] == [("Kits", "A", "https://a.com", "first"), ("More", "B", "https://b.com", "second")]
    got = one(spark, "<urlset><url><loc><![CDATA[https://a.com/?a=1&amp;b]]></loc><image:image><image:loc>i</image:loc></image:image></url></urlset>", readers.sitemap)
    assert got.kind == "urlset" and got.locs == ["https://a.com/?a=1&b"]
    assert one(spark, "- [T](/x): d\nno\n* [U](y)", readers.link_lines)[0].asDict() == {"title": "T", "url": "/x", "desc": "d"}
    landed = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>i</loc></sitemap><sitemap><loc>s</loc></sitemap></sitemapindex>"), ("s", "<urlset><url><loc>p</loc></url></urlset>")], "url string, text string")
    assert [tuple(r) for r in readers.expand(spark.createDataFrame([("d", "i")], "domain string, url string"), landed).collect()] == [("d", "p")]
    z = spark.createDataFrame([("a", bytearray(gzip.compress(b"hi"))), ("b", bytearray(b"\x1f\x8bxx")), ("c", bytearray(b"plain"))], "path string, content binary")
    assert {r.path: r.text for r in readers.gunzipped(z).collect()}["a"] == "hi"


def test_robots(spark):
    lines = readers.lines_of(spark.createDataFrame([("h", "User-agent: a\nUser-agent: *\nDisallow: /p # no\nAllow: /p/q\nUser-agent: b\nDisallow: /")], "id string, t string"), "id", "t").withColumnRenamed("doc", "host")
    rules = readers.robots_rules(lines)
    assert {(r.agent, r.allow, r.rule) for r in rules.collect()} == {("a", False, "/p"), ("a", True, "/p/q"), ("*", False, "/p"), ("*", True, "/p/q"), ("b", False, "/")}
    probes = spark.createDataFrame([("h", "/p/x"), ("h", "/p/q/1"), ("h", "/z")], "host string, path string")
    assert {r.path: r.allowed for r in quality.robots(probes, rules.where("agent = '*'")).collect()} == {"/p/x": False, "/p/q/1": True, "/z": True}


@pytest.mark.parametrize("name,want", [("floating-navbar", ["navbar"]), ("pricing-table", ["pricing"]), ("alert-dialog", ["modal"]), ("footer with button", ["footer"]), ("menu-dock", ["dock"]), ("mind-map", []), ("pricing card", ["pricing"]), ("menu", ["menu"])])
def test_tagging(spark, name, want):
    got = tagging.elements(spark.createDataFrame([(1, name)], "id int, text string"), spark.createDataFrame(tagging.ALIASES, tagging.SCHEMA))
    assert sorted(r.element for r in got.collect()) == want


def test_catalog(spark):
    e = spark.createDataFrame([("a", "x", "old"), ("b", "y", "old")], "id string, name string, desc string")
    r = spark.createDataFrame([("a", ["desc", "name"], "unknown", "new")], "id string, present array<string>, name string, desc string")
    assert sorted(tuple(x) for x in catalog.merge_records(e, r, ["name", "desc"]).select("id", F.coalesce("name", F.lit("-")), "desc").collect()) == [("a", "-", "new"), ("b", "y", "old")]
    links = spark.createDataFrame([("l", 1, "a"), ("l", 2, "b"), ("l", 3, "a"), ("l", 4, "c")], "listing string, page int, link string")
    assert sorted(x.page for x in items.listing_stop(links).collect()) == [1, 2]


def test_sections():
    t = "# A\n" + "x" * 300 + "\n```\n# no\n```\n## B\n" + "y" * 300 + "\n---\nSource: u\n# C\n" + "line\n" * 4000
    got = sections.split_text(t)
    assert got[0]["title"] == "A" and got[1]["path"] == ["A", "B"] and got[0]["start"] == 0 and got[-1]["end"] == len(t)
    assert all(a["end"] == b["start"] for a, b in zip(got, got[1:])) and all(s["end"] - s["start"] <= 12_000 for s in got)


def test_budget(spark):
    p = spark.createDataFrame([(1, k, s) for k, s in enumerate([100, 500, 900])], "doc int, part int, size int")
    assert [r.given for r in sections.share_budget(p, 1000).orderBy("part").collect()] == [100, 450, 450]
    assert [r.given for r in reports.greedy_pack(p, "doc", "part", "size", 700, 200).orderBy("part").collect()] == [100, 500]


def test_validation(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}, "uniqueItems": True}}, "if": {"properties": {"a": {"const": 1}}}, "then": {"required": ["b"]}}
    rows = spark.createDataFrame([(1, '{"a": 2}'), (2, '{"a": 1}'), (3, '{"b": ["x", "y"]}'), (4, "no"), (5, '{"a": 2, "c": 1}')], "id int, body string")
    got = {r.id: len(r.problems) for r in validation.validate(rows, "id", "body", schema, closed=True).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 1, 5: 1}
    assert validation.arguments({"limit": 0}, {"limit": {"type": "integer", "minimum": 1}}) == "limit: is out of range"


def test_api(spark):
    e = spark.createDataFrame([("a", "Alpha UI", "https://alpha.dev", "alpha.dev", "site", "button kit", ["kits"], ["button"], 3), ("b", "Beta", "https://beta.dev", "beta.dev", "site", "charts and buttons", ["charts"], ["chart"], 5)], "id string, name string, url string, domain string, kind string, desc string, categories array<string>, elements array<string>, mentions int")
    i = spark.createDataFrame([("a/x", "a", "Shiny Button", "shiny-button", ["button"], "code", "https://alpha.dev/r/x.json", "registry:ui"), ("b/x", "b", "Shiny Button", "shiny-button", ["button"], "gated", None, "registry:ui")], "id string, parent string, name string, slug string, elements array<string>, access string, install_url string, type string")
    c = Catalog(e, i, spark.createDataFrame([("a", "# One\n" + "word " * 60 + "\n# Two\nbutton " + "more " * 60)], "doc string, text string"))
    assert c.search("alpha ui").first().id == "a"
    assert {r.id for r in c.search("button").collect()} == {"a", "b", "a/x", "b/x"}
    assert [r.id for r in c.search(None, kind="site").collect()] == ["a", "b"]
    got = c.search_items("button").collect()
    assert len(got) == 1 and len(got[0].also) == 1
    assert c.resolve("Beta") == "b" and c.resolve("alpha.dev") == "a"
    with pytest.raises(ValueError):
        c.resolve("gamma")
    with pytest.raises(ValueError):
        c.search(element="nope")
    assert [r.id for r in c.list_pages("a").collect()] == ["a/x"] and c.list_registry("a", "shiny", "ui").count() == 1
    assert c.content("a", query="button").first().title == "Two" and c.content("a", section=1).first().title == "One"
    assert len(c.get("a", 60).first().record.encode()) <= 120
    plan = {r.id: (r.command, r.skipped) for r in c.install_plan(["a/x", "b/x", "z"], "pnpm").collect()}
    assert plan["a/x"][0].startswith("pnpm dlx") and plan["b/x"][1] == "gated" and plan["z"][1] == "unknown"
    assert {(r.access, r.n) for r in c.facets("button").collect()} == {("code", 1), ("gated", 1)}


def test_stream(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string").coalesce(1).write.parquet(f"{at}/in")
    s = spark.readStream.schema("k string, at int, v string").parquet(f"{at}/in")
    upserts.upsert(s, f"{at}/out", ["k"], "at", f"{at}/ck").awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{at}/out/0").collect()) == [("a", "y"), ("b", "z")]


def test_scores_prefer_whole_matches(spark):
    from quarry.operators import index

    docs = spark.createDataFrame([(1, "red button"), (2, "red thing"), (3, "plain button thing")], "doc_id int, text string")
    p = index.postings(docs, "doc_id", {"name": "text"})
    c = search.analyse(spark.createDataFrame([("red buttons",)], "q string"), spark.createDataFrame([], "term string, alt_terms array<string>"))
    assert search.top(search.score(p, index.idf(p, 3), c), 1).first().doc == 1


def test_postings_count_terms_where_documents_lie(spark):
    """Fields and tags of a row are added up without a shuffle of terms; several rows of a document are added up too."""
    from quarry.operators import index

    rows = [(1, "Red buttons, red", "a red 2x", ["x", "x", None]), (2, "", None, None), (3, "button", "", []), (4, None, "plain", ["y"])]
    kind = "id int, name string, about string, tags array<string>"
    made = lambda r: index.postings(spark.createDataFrame(r, kind), "id", {"name": "name", "about": "about"}, [("element", "el", F.col("tags"))])
    p = made(rows)
    mean = (3 * 3 + 4 + 2 * 3 + 3 + 1 + 3) / 3
    tf = lambda w, n: max(1, int(100 * w / (0.25 + 0.75 * n / mean) + 0.5))
    want = {(1, "red"): (7, 33), (1, "button"): (3, 1), (1, "a"): (1, 32), (1, "2"): (1, 32), (1, "x"): (1, 32), (1, "el:x"): (3, 2), (1, None): (3, 2), (3, "button"): (3, 1), (4, "plain"): (1, 32), (4, "el:y"): (3, 2)}
    length = {1: 19, 3: 3, 4: 4}
    assert {(r.doc, r.term): (r.tf100, r.mask) for r in p.collect()} == {k: (tf(w, length[k[0]]), m) for k, (w, m) in want.items()}
    assert "term#" not in "".join(x for x in p._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
    assert sorted((r.doc, r.term) for r in made([(3, "button", None, None), (3, "button", None, None)]).collect()) == [(3, "button")]


def test_delta_makes_postings_once(spark):
    from quarry.operators import index

    docs = spark.createDataFrame([(k, "all" + (" odd" if k % 2 else "")) for k in (0, 1, 5, 9, 70_000, 70_001, 200_001)], "id long, text string")
    d = index.delta(index.postings(docs, "id", {"about": "text"})).select("term", "doc", "gap36").groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc", "gap36"))).alias("g"))
    got = {r.term: [int(x.gap36, 36) for x in r.g] for r in d.collect()}
    assert got == {"all": [0, 1, 4, 4, 69_991, 1, 130_000], "odd": [1, 4, 4, 69_992, 130_000]}
    assert "ReusedExchange" in d._jdf.queryExecution().executedPlan().toString()
