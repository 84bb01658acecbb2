"""Names, keywords, page choice, anchors, outlines, template mining and facts on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.operators import catalog, items, pages, sections, tagging


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize("word,want", [("Menus", "menu"), ("mega-menus", "mega-menu"), ("  Nav_bars! ", "nav bar"), ("stories", "story"), ("cookies", "cookie"), ("boxes", "box"), ("heroes", "hero"), ("glass", "glass"), ("kubernetes", "kubernetes"), ("ﬁelds", "field"), ("h2s", "h2s"), ("", ""), (None, "")])
def test_keyword(spark, word, want):
    assert one(spark, word, names.keyword) == want


def test_stacks(spark):
    assert one(spark, ["Tailwind  CSS", "tailwindcss", "Next.js", "My Stack", " "], names.stacks, "array<string>") == ["tailwind", "nextjs", "my-stack"]
    assert one(spark, None, names.stacks, "array<string>") is None


def test_names(spark):
    rows = [
        ("given", "Acme Kit", "site", "https://acme.dev", "acme.dev", None), ("brand", "acme.dev", "site", "https://acme.dev", "acme.dev", "Home | Acme — buttons"),
        ("repo", "github.com", "repo", "https://github.com/o/r?x", "github.com", None), ("page", "acme.dev", "page", "https://acme.dev/p/x", "acme.dev", "Button | Acme"),
        ("twin1", "acme.dev", "page", "https://acme.dev/p/claims-form", "acme.dev", "Form | Acme"), ("twin2", "acme.dev", "page", "https://acme.dev/p/sign-form.html", "acme.dev", "Form | Acme"),
        ("gone", "acme.dev", "page", "https://acme.dev/p/deadbeef01", "acme.dev", "404"), ("none", None, "site", None, "acme.dev", None),
    ]
    got = {r.id: r.name for r in catalog.name_pages(spark.createDataFrame(rows, "id string, name string, kind string, url string, domain string, title string")).collect()}
    assert got == {"given": "Acme Kit", "brand": "Acme", "repo": "o/r", "page": "Button (Acme)", "twin1": "Claims form (Acme)", "twin2": "Sign form (Acme)", "gone": "acme.dev", "none": None}


def test_cuts(spark):
    assert one(spark, "Button - Docs | Acme", lambda c: names.without_site(c, ["Acme"])) == "Button - Docs"
    assert one(spark, "äöü", lambda c: names.clip_bytes(c, 6)) == "äöü"
    assert one(spark, "äöüß", lambda c: names.clip_bytes(c, 6)) == "ä…"
    assert [one(spark, "a😀b😀c", lambda c, n=n: names.clip_bytes(c, n)) for n in (3, 4, 7, 8, 9, 10, 11)] == ["…", "a…", "a…", "a😀…", "a😀b…", "a😀b…", "a😀b😀c"]
    assert one(spark, "12345678\n90", lambda c: names.cut_at_line(c, 10)) == "12345678"
    assert one(spark, "1\n345678901", lambda c: names.cut_at_line(c, 10)) == "1\n34567890"


def test_keywords(spark):
    said = spark.createDataFrame([("navbar", "navbar", 0, 0), ("nav bar", "other", 1, 0), ("animasyon", "animation", 2, 0)], "alias string, canonical string, rank int, pos int")
    rows = spark.createDataFrame([(1, ["Nav-Bars", "navbar", "Animasyon", "tool calls", None]), (2, []), (3, None)], "id int, keywords array<string>")
    assert [tuple(r) for r in catalog.normalise_keywords(rows, catalog.keyword_spellings(said)).collect()] == [(1, ["navbar", "animation", "tool call"])]


def test_keywords_take_no_python_and_one_shuffle(spark):
    said = spark.createDataFrame([("view", "page view", 0, 0)], "alias string, canonical string, rank int, pos int")
    rows = spark.createDataFrame([(1, ["Views", None, "ﬁelds", "VIEW", "b", "field"]), (1, ["b", "a"]), (2, ["!"])], "id int, keywords array<string>")
    out = catalog.normalise_keywords(rows, catalog.keyword_spellings(said))
    assert [tuple(r) for r in out.collect()] == [(1, ["b", "page view", "a", "field"])]
    plan = catalog.normalise_keywords(rows, said.selectExpr("alias AS spelling", "canonical"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_choose(spark):
    links = ["/docs/a/b", "/docs", "/components/x", "/components/y/z", "/pricing", "/blog/docs", "/about?x=1", "/guides", "/license", "/logo.png", "/docs"]
    rows = [("https://a.com/", "https://www.a.com" + x, "nav") for x in links] + [("https://a.com/", "https://b.com/docs", "llms"), ("https://e.com", "https://e.com/", "nav"), (None, None, None)]
    got = pages.choose(spark.createDataFrame(rows, "home string, url string, source string")).orderBy("place").collect()
    assert [(r.url.removeprefix("https://www.a.com"), r.bucket) for r in got] == [("/docs", "docs"), ("/components/x", "components"), ("/pricing", "pricing"), ("/license", "license")]
    wide = pages.choose(spark.createDataFrame(rows, "home string, url string, source string"), 6).orderBy("place").collect()
    assert [r.url.removeprefix("https://www.a.com") for r in wide][4:] == ["/guides"]


def test_anchors(spark):
    html = "<main id=main><section id='intro'><div id='deep'><h2>Intro &amp; more</h2></div></section><section id=empty><p>x</p></section><h3 id=api>The <b>API</b></h3><h2 id='radix-1'>no</h2><a href='#api'>dup</a><a href='#faq'>Questions</a><a href='#0123456789abc'>h</a></main>"
    want = [("intro", "Intro & more"), ("deep", "Intro & more"), ("api", "The API"), ("faq", "Questions")]
    assert [(a["id"], a["text"]) for a in pages.anchors_of(html)] == want
    df = spark.createDataFrame([(1, html), (2, None), (3, "<div id=x"), (4, "")], "page_id long, html string")
    assert [(r.anchor, r.text) for r in pages.anchors(df).orderBy("page_id", "pos").collect()] == want


def test_outline(spark):
    md = "# Top\n" + "a" * 300 + "".join(f"\n## H{i}\n{'b' * 300}\n### S{i}\n{'c' * 300}" for i in range(9))
    docs = spark.createDataFrame([(1, md)], "doc long, text string")
    s = sections.split(docs).cache()
    n = s.count()
    for budget, depth in ((7000, 3), (180, 2), (90, 1), (50, 0)):
        r = pages.outline(s, docs, budget, 20).first()
        assert r.depth == depth and len(r.text.encode()) <= budget, (budget, r)
        assert (f"+{n - r.listed} sections" in r.text) == (r.listed < n)


def test_templates(spark):
    vocabulary = spark.createDataFrame(tagging.ALIASES, tagging.SCHEMA)
    slugs = items.element_slugs(spark.createDataFrame([("button", "button", False, 0), ("modal", "modal", False, 1), ("modal", "dialog", True, 0), ("other", "button", True, 0)], "element string, name string, is_alias boolean, pos int"))
    assert {r.slug: r.element for r in slugs.collect()} == {"button": "button", "modal": "modal", "dialog": "modal"}
    urls = [f"/components/{x}" for x in ("button", "modal", "other")] + [f"/blog/p{i}a" for i in range(12)] + [f"/x/button/{i}" for i in range(12)] + [f"/x/{e}/v{i}" for e in ("modal", "button") for i in range("xyz".count("x") * 5)] + ["/components/a.png"]
    df = spark.createDataFrame([("a.com", "https://www.a.com" + u) for u in urls] + [("a.com", "https://b.com/components/button"), (None, None)], "domain string, url string")
    got = {r.template: (r.children, r.element_pct, r.high, r.why) for r in items.suggest_templates(df, slugs, vocabulary).collect()}
    assert got["/components/{name}"] == (3, 67, True, "component prefix")
    assert got["/blog/{name}"] == (12, 0, False, "meta")
    assert got["/x/{element}/{n}"] == (12, 100, True, "elements")
    assert got["/x/{element}/{*}"] == (10, 100, True, "elements")


def test_facts(spark):
    rows = [("p", i, f"n{i}", "page" if i % 2 else "code", "example" if i == 1 else "page", ["button"] if i % 3 else ["card", "button"]) for i in range(31)]
    r = items.registry_facts(spark.createDataFrame(rows, "parent string, pos int, name string, access string, granularity string, elements array<string>"), 2, 15).first()
    assert (r.code, r.gated, r.gallery_examples, r.docs_pages) == (16, 0, 1, 14)
    assert r.item_elements == ["button 31", "card 11"] and r.sample_items == [f"n{i}" for i in range(0, 30, 2)]


def test_links(spark):
    df = spark.createDataFrame([("https://a.com/l", "https://a.com/l?page=2"), ("https://a.com/l", "https://a.com/l?page=3"), ("https://a.com/l?page=2", "https://a.com/l?page=3")], "url string, link string")
    assert {r.url: r.next for r in pages.next_page(df).collect()} == {"https://a.com/l": "https://a.com/l?page=2", "https://a.com/l?page=2": "https://a.com/l?page=3"}
    locs = spark.createDataFrame([("a.com", 0, "/x"), ("a.com", 1, "https://a.com/x"), ("a.com", 2, "https://b.com/"), ("a.com", 3, "https://www.a.com/y")], "domain string, pos int, loc string")
    kept, seen = pages.host_filter(locs, 1)
    assert [r.url for r in kept.collect()] == ["https://a.com/x"] and tuple(seen.first()) == ("a.com", 1, 1, 1, 1)
    assert one(spark, ["https://a.com", "https://a.com/p?q#x", "https://b.com/p?q"], pages.link_paths, "array<string>") == ["/p?q"]
