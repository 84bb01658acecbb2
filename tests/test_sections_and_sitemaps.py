"""Section ranking, query phrases and the sitemap adapter on rows written by hand."""

import math

import pytest

from quarry.operators import items, phrases, sections, sitemaps, tagging


def rows(spark, *made):
    return spark.createDataFrame(made, "doc long, n int, title string, path array<string>, text string")


def test_rank_headed(spark):
    s = rows(
        spark, (1, 1, "Drawer", [], "# Drawer\nopens a drawer"), (1, 2, "Props", ["Drawer"], "## Props\nsize and side"), (1, 3, "Deployment", [], "deployment of things"), (1, 4, "Sheet", [], "a side sheet"),
        (1, 5, "Other", [], "side only"), (1, 6, "Code", [], "text\n```\nsize size size\n```\nmore words"), (1, 7, "漢字", [], "漢字漢字漢字漢字 size"), (2, 1, None, None, None), (3, 1, "", [], ""),
    )
    idf = lambda df, n=7: math.log(1 + (n - df + 0.5) / (df + 0.5))
    got = {(r.doc, r.n): r for r in sections.rank_headed(s, [[{"words": ["drawer"], "tags": [[["drawer"], ["side", "sheet"]]]}]]).collect()}
    assert set(got) == {(1, 1), (1, 4), (1, 2)}  # "side" alone is no sheet; Props has the heading above it
    assert got[1, 2].score == pytest.approx(idf(1))
    assert got[1, 1].score > 2 * idf(1) and got[1, 4].score > got[1, 2].score
    size = {r.n: r.score for r in sections.rank_headed(s, [[{"words": ["size"]}]]).collect()}
    assert set(size) == {2, 6, 7} and size[7] < size[2]
    assert {r.n for r in sections.rank_headed(s, [[{"words": ["deploy"]}]]).collect()} == {3}
    both = {r.n: r.hits for r in sections.rank_headed(s, [[{"words": ["size"]}], [{"words": ["drawer"]}]]).collect()}
    assert both == {1: 1, 2: 2, 6: 1, 7: 1}
    assert sections.rank_headed(s.where("false"), [[{"words": ["size"]}]]).count() == 0


VOCABULARY = phrases.Vocabulary(
    elements={"navbar": ["navbar", "nav menu"], "empty-state": ["no items"]}, variants={("navbar", "mega"): ["mega"]}, synonyms={"animation": ["animation", "motion effect"]},
    categories={"fonts": ["fonts"]}, turkish=[("elements", "navbar", ["gezinme"]), ("categories", "fonts", ["yazı tipi"])],
)


def test_phrases(spark):
    qs = ["the nav menu", "navbars", "mega navbar", "motion effects for buton", "gezinme", "list has no items", "", "mega", "animation motion effect"]
    terms = spark.createDataFrame([("button",), ("motion",)], "term string")
    got = {}
    for r in phrases.analyse(spark.createDataFrame([(q,) for q in [*qs, None]], "q string"), VOCABULARY, terms).collect():
        got.setdefault(r.q, {}).setdefault((r.concept, r.alt), []).append((r.term, r.weight, r.gated))
    assert sorted(t for t, *_ in got["the nav menu"][0, 0]) == ["el:navbar", "menu", "nav"] and len(got["the nav menu"]) == 1
    assert {t for t, *_ in got["navbars"][0, 0]} == {"el:navbar", "navbar"}
    assert {t for ts in got["mega navbar"].values() for t, *_ in ts} == {"el:navbar", "navbar", "va:navbar/mega", "mega"}
    assert [w for _, w, _ in got["motion effects for buton"][0, 1]] == [0.7] and got["motion effects for buton"][1, 1] == [("button", 0.6, False)]
    assert {t for ts in got["gezinme"].values() for t, *_ in ts} == {"gezinme", "navbar", "nav", "menu", "el:navbar"}
    assert any(g for ts in got["list has no items"].values() for *_, g in ts)
    assert got["mega"] == {(0, 0): [("mega", 1.0, False)]}  # a variant needs its element
    assert {c for c, _ in got["animation motion effect"]} == {0} and "" not in got and None not in got


def test_template():
    t = sitemaps.compile_template("/sections/{name}-{element}-{n}")
    assert (t["id_from"], t["name_from"], t["element_from"]) == ([-2], [1, 2, 3], 2)
    t = sitemaps.compile_template("/{author}/text/{*}/{name}")
    assert (t["id_from"], t["name_from"], t["group_from"]) == ([1, -4, 2], [1, 3], [2])


def test_sitemaps(spark):
    compiled = sitemaps.patterns(spark, [{"domain": "a.com", "match": ["/components/{name}", "/x/{element}/{*}"], "exclude": ["/components/index"], "loose_ids": True}, {"domain": "b.com", "match": "/ui/{name}", "attach_only": True, "element": "button"}, {"domain": "c.com", "match": "/{name}", "skip": "no"}])
    found = ["components/button", "components/button/", "components/animated-content", "components/index", "components/alert-dialog", "components/taken", "x/modal/one", "x/modal/two", "components/linked", "other", "components/zig"]
    pages = spark.createDataFrame([("a.com", i, f"https://a.com/{p}") for i, p in enumerate(found)] + [("b.com", 0, "https://b.com/ui/new"), ("b.com", 1, "https://b.com/ui/card"), ("c.com", 0, "https://c.com/x"), (None, 0, None)], "domain string, pos int, url string")
    parents = spark.createDataFrame([("a.com", "a"), ("b.com", "b"), ("c.com", "c")], "domain string, parent string")
    taken = spark.createDataFrame([("a/button", "a", None, "registry"), ("a/animatedcontent", "a", None, "registry"), ("a/taken", "a", "https://a.com/t", "llms"), ("a/else", "a", "https://www.a.com/components/linked", "llms"), ("b/card", "b", None, "registry"), ("a/zi-g", "a", None, "registry"), ("a/z-ig", "a", None, "registry")], "id string, parent string, url string, source string")
    slugs = items.element_slugs(spark.createDataFrame([("modal", "modal", False, 0)], "element string, name string, is_alias boolean, pos int"))
    members = sitemaps.member_links(spark.createDataFrame([("modal", "https://a.com/components/zig")], "element string, link string"), slugs)
    made, attached = sitemaps.adapt(pages, compiled, parents, taken, slugs, spark.createDataFrame(tagging.ALIASES, tagging.SCHEMA), members)
    assert {r.id: r.url for r in attached.collect()} == {"a/button": "https://a.com/components/button", "a/animatedcontent": "https://a.com/components/animated-content", "b/card": "https://b.com/ui/card"}
    got = {r.id: (r.name, r.elements) for r in made.collect()}
    assert got == {"a/alert-dialog": ("Alert Dialog", ["modal"]), "a/modal-one": ("Modal One", ["modal"]), "a/modal-two": ("Modal Two", ["modal"]), "a/zig": ("Zig", ["modal"])}
    assert {r.domain: (r.pages, r.made, r.attached) for r in sitemaps.facts(pages.where("url is not null"), made, attached).collect()}["a.com"] == (11, 4, 2)


def test_catalog_with_vocabulary(spark):
    from quarry.plans.api import Catalog

    entries = spark.createDataFrame([("a", "Alpha", "https://a.com", "a.com", "site", "tools", ["kits"], ["navbar"]), ("b", "Beta", "https://b.com", "b.com", "site", "a nav menu of sorts", ["fonts"], None)], "id string, name string, url string, domain string, kind string, desc string, categories array<string>, elements array<string>")
    items_ = spark.createDataFrame([("a/x", "a", "Bar", {"navbar": ["mega"]}, ["navbar"])], "id string, parent string, name string, variants map<string,array<string>>, elements array<string>")
    contents = spark.createDataFrame([("a", "# Navbar\n" + "x " * 120 + "\n## Props\n" + "y " * 120 + "\n# Other\n" + "z menu " * 60)], "doc string, text string")
    c = Catalog(entries, items_, contents, vocabulary=VOCABULARY)
    assert [r.id for r in c.search("gezinme").collect()][0] == "a"
    assert [r.id for r in c.search("yazı tipi").collect()] == ["b"]
    assert c.search_items("mega navbar").first().id == "a/x"
    assert c.content("a", query="nav menu").first().title == "Navbar"
    assert c.outline("a", 7000).first().listed == 3
    assert c.search("the of").count() == 0
