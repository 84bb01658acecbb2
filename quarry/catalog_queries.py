"""Queries that hold the catalog's gates, keys, verdicts, reports and readers against SQL, over the driver's tables.

Where an operator needs input of a kind that the tables lack (link files, sitemaps, robots files, registry names), the
query first makes it from columns of a whole table, by an expression that Spark and the SQL share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import html, names, text, urls
from quarry.operators import catalog, gates, index, items, pages, quality, reports, search, sections, sitemaps, tagging, validation
from quarry.queries import _ENT, _PL, _U, _V, _drop_sql, table
from quarry.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def rows(spark: SparkSession, d: str, source: str, /, **columns: str) -> DataFrame:
    """A table with columns made by expressions."""
    return table(spark, d, source).select(*[F.expr(e).alias(c) for c, e in columns.items()])


# Gates --------------------------------------------------------------------------------------------------------------

_SHOP = "CASE s_nationkey % 3 WHEN 0 THEN 'x-community' WHEN 1 THEN 'curated' ELSE 'awesome' END"


@query(f"SELECT s_suppkey, {_SHOP} <> 'x-community' OR s_suppkey % 4 >= 2 AS rendered FROM supplier")
def rendered_subset(spark, d):
    s = rows(spark, d, "supplier", s_suppkey="s_suppkey", origins=f"array('x-community', {_SHOP})", mentions="s_suppkey % 4")
    return s.select("s_suppkey", gates.rendered(F.col("origins"), F.col("mentions")).alias("rendered"))


_ASSET = "CASE page_id % 7 WHEN 0 THEN 'https://fonts.gstatic.com/x' WHEN 1 THEN concat('https://a.org/', page_id, '.PNG') WHEN 2 THEN concat('https://youtu.be/', page_id) WHEN 3 THEN 'https://gumroad.com/a/1' WHEN 4 THEN 'https://s3.eu-1.amazonaws.com/z' ELSE url END"


@query(rf"""WITH p AS (SELECT page_id, {_ASSET} AS u FROM pages), x AS (SELECT page_id, lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) AS h, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) AS pa FROM p)
 SELECT page_id, NOT (h IN ('fonts.gstatic.com', 'youtu.be') OR regexp_matches(h, '^s3[.-][a-z0-9-]+\.amazonaws\.com$') OR regexp_matches(lower(pa), '\.(png|jpe?g|gif|webp|svg|mp4|mov|m3u8|pdf|zip|css|js)$') OR starts_with(regexp_replace(h, '^www\.', '') || pa, 'gumroad.com/a/')) AS keeps FROM x""")
def resource_urls(spark, d):
    return rows(spark, d, "pages", page_id="page_id", u=_ASSET).select("page_id", gates.is_resource(F.col("u")).alias("keeps"))


_DOCS = """concat('https://', CASE p_size % 3 WHEN 0 THEN 'www.kit.dev/' WHEN 1 THEN 'kit.dev/' ELSE 'other.dev/' END, CASE p_partkey % 6 WHEN 0 THEN 'components/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'de/components/' WHEN 3 THEN 'blog/ui/' WHEN 4 THEN 'x/y/' ELSE 'docs/forms/' END,
 CASE p_size % 7 WHEN 0 THEN 'index' WHEN 1 THEN '123' WHEN 2 THEN 'buttons' ELSE replace(p_name, ' ', '-') END, CASE WHEN p_partkey % 5 = 0 THEN '.md' ELSE '' END)"""


@query(f"""WITH l AS (SELECT p_partkey, {_DOCS} AS u, p_partkey % 4 = 0 AS tagged FROM part), s AS (SELECT *, [regexp_replace(x, '\\.md$', '') FOR x IN list_filter(string_split(regexp_extract(u, '^https://[^/]+(.*)$', 1), '/'), lambda x: x <> '')] AS s FROM l)
 SELECT p_partkey, CASE WHEN regexp_matches(u, '^https://(www\\.)?kit\\.dev/') AND len(s) >= 2 AND NOT list_has_any(s, ['de', 'blog']) AND regexp_matches(s[-1], '[a-z]') AND s[-1] NOT IN ('index', 'buttons')
 AND (list_has_any(s[:-2], ['components', 'ui', 'forms']) OR (list_contains(s, 'docs') AND tagged)) THEN s[-1] END AS slug FROM s""")
def docs_page_gate(spark, d):
    l = rows(spark, d, "part", p_partkey="p_partkey", u=_DOCS, tagged="p_partkey % 4 = 0")
    return l.select("p_partkey", gates.docs_page(F.col("u"), F.lit("kit.dev"), F.col("tagged")).alias("slug"))


_CATS = "CASE s_nationkey % 4 WHEN 0 THEN 'components' WHEN 1 THEN 'icons' WHEN 2 THEN 'motion' ELSE 'fonts' END"


@query(f"SELECT s_suppkey, {_CATS} IN ('components', 'motion') OR s_suppkey % 5 = 0 AS reads FROM supplier")
def link_file_gate(spark, d):
    s = rows(spark, d, "supplier", s_suppkey="s_suppkey", c=f"array('icons', {_CATS})", r="CASE WHEN s_suppkey % 5 = 0 THEN 'https://x' END")
    return s.select("s_suppkey", gates.reads_links(F.col("c"), F.col("r")).alias("reads"))


_TYPE = "CASE p_size % 6 WHEN 0 THEN 'registry:ui' WHEN 1 THEN 'registry:hook' WHEN 2 THEN 'registry:example' WHEN 3 THEN 'registry:file' WHEN 4 THEN 'registry:block' ELSE NULL END"
_PNAME = "CASE p_partkey % 7 WHEN 0 THEN concat('icons-', replace(p_name, ' ', '-')) WHEN 1 THEN concat('demo-', replace(p_name, ' ', '-')) WHEN 2 THEN concat(replace(p_name, ' ', '_'), '_demos') WHEN 3 THEN 'democracy' ELSE replace(p_name, ' ', '-') END"


@query(f"""WITH i AS (SELECT p_partkey, {_TYPE} AS t, {_PNAME} AS n, p_brand = 'Brand#1' AS asset FROM part) SELECT p_partkey, NOT (coalesce(t, '') IN ('registry:hook', 'registry:file') OR asset OR starts_with(n, 'icons-')) AS taggable,
 coalesce(t = 'registry:example', false) OR regexp_matches(n, '(^|[-_])demos?([-_]|$)') AS demo, regexp_replace(regexp_replace(n, '^demo-', ''), '_demos$', '') AS base FROM i""")
def item_type_gates(spark, d):
    i = rows(spark, d, "part", p_partkey="p_partkey", t=_TYPE, n=_PNAME, asset="p_brand = 'Brand#1'")
    return i.select("p_partkey", gates.is_taggable(F.col("t"), F.col("n"), F.col("asset")).alias("taggable"), F.coalesce(gates.is_demo(F.col("t"), F.col("n")), F.lit(False)).alias("demo"), gates.demo_base(F.col("n")).alias("base"))


_BUILD = "concat(replace(p_name, ' ', '-'), CASE p_size % 5 WHEN 0 THEN '-TS-TW' WHEN 1 THEN '_js_css' WHEN 2 THEN '-TS-CSS' ELSE '' END)"


@query(f"""WITH i AS (SELECT p_brand AS parent, p_partkey AS pos, {_BUILD} AS n, regexp_replace({_BUILD}, '(?i)[-_](ts|js)[-_](tw|css)$', '') AS base, CASE p_size % 5 WHEN 0 THEN 'ts-tw' WHEN 1 THEN 'js-css' WHEN 2 THEN 'ts-css' END AS st FROM part),
 k AS (SELECT *, parent || '/' || base AS id FROM i), s AS (SELECT id, st, min(pos) AS pos FROM k WHERE st IS NOT NULL GROUP BY id, st), n AS (SELECT id, n, min(pos) AS pos FROM k GROUP BY id, n),
 sl AS (SELECT id, list(st ORDER BY pos) AS stacks FROM s GROUP BY id), nl AS (SELECT id, list(n ORDER BY pos) AS names FROM n GROUP BY id)
 SELECT nl.id, regexp_extract(nl.id, '/(.*)$', 1) AS name, coalesce(stacks, []) AS stacks, names FROM nl LEFT JOIN sl USING (id)""")
def stack_builds_merged(spark, d):
    return gates.merge_builds(rows(spark, d, "part", parent="p_brand", pos="p_partkey", name=_BUILD))


@query(rf"WITH {_U} SELECT page_id, regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+') AS words FROM k WHERE list_has_any(regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+'), ['de', 'en', 'item'])")
def needle_pages(spark, d):
    wanted = gates.needles("EN 7 x", "item", ["de"])  # de, en, item
    u = F.col("url")
    return table(spark, d, "pages").where(gates.named_by_path(u, wanted)).select("page_id", gates.path_words(u).alias("words"))


@query(rf"""WITH {_U}, w AS (SELECT regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+') AS w FROM k), c AS (SELECT CASE WHEN len(w) > 1 THEN '/' || array_to_string(w[:-2], '/') WHEN len(w) = 1 THEN '/' || w[1] ELSE '/' END AS prefix, count(*) AS n FROM w GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY n DESC, prefix) AS i FROM c) SELECT prefix, n FROM r WHERE i <= 2 UNION ALL SELECT 'more', count(*) FROM r WHERE i > 2 HAVING count(*) > 0""")
def directory_prefixes(spark, d):
    return gates.directory_counts(table(spark, d, "pages"), 2)


_LOC = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('//shop.org/', page_id) WHEN 2 THEN concat('/p/', page_id % 11) WHEN 3 THEN concat('https:/p/', page_id) ELSE concat('https://www.shop.org/q/', page_id % 13) END"


@query(rf"""WITH l AS (SELECT concat('d', page_id % 3) AS d0, page_id AS pos, {_LOC} AS loc FROM pages), f AS (SELECT 'shop.org' AS domain, pos, loc, CASE WHEN regexp_matches(loc, '^https?://[^/]') THEN loc WHEN starts_with(loc, '//') THEN 'https:' || loc ELSE 'https://shop.org/' || regexp_replace(loc, '^(https?:)?/*', '') END AS u FROM l),
 o AS (SELECT *, regexp_extract(u, '^https?://(www\.)?([^/?#]+)', 2) = 'shop.org' AS own FROM f), g AS (SELECT u, min(pos) AS pos FROM o WHERE own GROUP BY u)
 SELECT count(*) FILTER (NOT own) AS foreign_locs, count(*) FILTER (u <> loc) AS repaired, count(*) FILTER (own) - (SELECT count(*) FROM g) AS repeated, greatest((SELECT count(*) FROM g) - 20, 0) AS truncated, (SELECT sum(pos)::BIGINT FROM (SELECT pos FROM g ORDER BY pos LIMIT 20)) AS kept FROM o""")
def host_locs_repaired(spark, d):
    kept, seen = pages.host_filter(rows(spark, d, "pages", domain="'shop.org'", pos="page_id", loc=_LOC), 20)
    return seen.join(kept.groupBy("domain").agg(F.sum("pos").alias("kept")), "domain").select(F.col("foreign").alias("foreign_locs"), "repaired", "repeated", "truncated", "kept")


_STATUS = "CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 403 WHEN 4 THEN 500 ELSE 200 END"
_BODY = "CASE page_id % 11 WHEN 0 THEN concat('<title>Just a moment</title>', html) WHEN 1 THEN concat('captcha ', html) WHEN 2 THEN '<div id=\"root\"></div>' ELSE html END"
_KIND = "CASE page_id % 10 WHEN 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END"


@query(rf"""WITH b AS (SELECT page_id, {_STATUS} AS st, {_BODY} AS b, {_KIND} AS kind FROM pages), c AS (SELECT *, regexp_matches(regexp_extract(b, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?i)just a moment|attention required|verify you are human|access denied') OR (coalesce(st, 0) IN (403, 503) AND regexp_matches(b[:20000], '(?i)captcha|cf-chl|challenge-platform|are you a robot')) AS ch FROM b)
 SELECT page_id, CASE WHEN st IS NULL THEN 'no-answer' WHEN ch THEN 'challenge' WHEN st = 401 THEN 'login-required' WHEN st = 404 THEN 'dead' WHEN st >= 400 THEN 'http-' || st WHEN kind LIKE '%pdf%' THEN 'not-html' WHEN page_id % 11 = 2 THEN 'thin' END AS reason FROM c""")
def page_readability(spark, d):
    b = rows(spark, d, "pages", page_id="page_id", st=_STATUS, b=_BODY, kind=_KIND)
    return b.select("page_id", html.unreadable(F.col("st"), F.col("kind"), F.col("b")).alias("reason"))


@query(r"SELECT conv_id, turn, turn % 4 = 1 OR regexp_matches(b, '(?i)licen[cs]e|unauthoriz|unauthorized|authentication|\bapi key\b') AS gated FROM (SELECT *, CASE conv_id % 5 WHEN 0 THEN text || ' an API key' WHEN 1 THEN 'Licence ' || text ELSE text END AS b FROM conversations)")
def gated_responses(spark, d):
    c = rows(spark, d, "conversations", conv_id="conv_id", turn="turn", st="CASE WHEN turn % 4 = 1 THEN 401 ELSE 200 END", b="CASE conv_id % 5 WHEN 0 THEN concat(text, ' an API key') WHEN 1 THEN concat('Licence ', text) ELSE text END")
    return c.select("conv_id", "turn", gates.gated(F.col("st"), F.col("b")).alias("gated"))


_HOST = "CASE event_id % 6 WHEN 0 THEN concat(event_id % 256, '.', user_id % 256, '.1.2') WHEN 1 THEN 'a.localhost' WHEN 2 THEN 'nodots' WHEN 3 THEN concat('172.', event_id % 40, '.0.9') WHEN 4 THEN '[fe80::1]' ELSE concat('s', user_id, '.example.com') END"
_GO = f"concat(CASE WHEN event_id % 10 = 7 THEN 'http' ELSE 'https' END, '://', CASE WHEN event_id % 10 = 8 THEN 'u:p@' ELSE '' END, {_HOST}, CASE event_id % 10 WHEN 5 THEN ':443' WHEN 6 THEN ':8080' ELSE '' END, '/x')"


@query(rf"""WITH h AS (SELECT event_id, {_HOST} AS h, event_id % 10 AS m FROM events), n AS (SELECT *, try_cast(regexp_extract(h, '^(\d+)\.', 1) AS INT) AS a, try_cast(regexp_extract(h, '^\d+\.(\d+)\.', 1) AS INT) AS b FROM h),
 p AS (SELECT *, CASE WHEN a IS NOT NULL THEN NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)) ELSE h LIKE 's%.example.com' END AS public FROM n)
 SELECT event_id, public AS is_public, public AND m NOT IN (6, 7, 8) AS follows FROM p""")
def followable_hosts(spark, d):
    e = rows(spark, d, "events", event_id="event_id", h=_HOST, u=_GO)
    own = F.regexp_replace(F.regexp_replace("h", ":.*$", ""), r"^www\.", "")
    return e.select("event_id", urls.is_public(F.col("h")).alias("is_public"), urls.follows(F.regexp_replace("u", ":443/", "/"), own).alias("follows"))


_PATH = "CASE p_size % 7 WHEN 0 THEN concat('../', p_name) WHEN 1 THEN concat('/', p_name) WHEN 2 THEN concat('a/../', p_name) WHEN 3 THEN concat('C:', p_name) WHEN 4 THEN '' ELSE concat('src/', p_name, '..x') END"


@query(f"SELECT p_partkey, p_size % 7 > 4 AS safe FROM (SELECT *, {_PATH} AS f FROM part)")
def safe_paths(spark, d):
    return rows(spark, d, "part", p_partkey="p_partkey", f=_PATH).select("p_partkey", gates.is_safe_path(F.col("f")).alias("safe"))


_ENTRY = {"id": "concat('s', s_suppkey)", "name": "s_name", "url": "concat('https://s', s_suppkey, '.dev')", "domain": "concat('s', s_suppkey, '.dev')", "desc": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE repeat('word ', CAST(s_suppkey % 60 AS INT)) END"}
_CLIP = "CASE WHEN length({0}) > 200 THEN rtrim(substring({0}, 1, 199)) || '…' ELSE {0} END"


@query(f"""WITH e AS (SELECT {', '.join(f'{x} AS "{c}"' for c, x in _ENTRY.items())}, s_suppkey FROM supplier), n AS (SELECT p_partkey % 200 AS k, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, CASE WHEN "desc" = '' THEN domain ELSE "desc" END AS s FROM e)
 SELECT id, name, url, {_CLIP.format('s')} AS summary, coalesce(n, 0) AS pages FROM t LEFT JOIN n ON k = s_suppkey""")
def entry_hits(spark, d):
    e = rows(spark, d, "supplier", **_ENTRY, s_suppkey="s_suppkey")
    n = rows(spark, d, "part", s_suppkey="p_partkey % 200").groupBy("s_suppkey").agg(F.count("*").alias("n"))
    return e.join(n, "s_suppkey", "left").select(gates.hit({c: F.col(c) for c in _ENTRY}, F.col("n")).alias("h")).select("h.*")


@query("""SELECT 'p' || p_partkey AS id, '{"id":"p' || p_partkey || '","parent":"' || p_brand || '","name":"' || p_name || '","access":"code"' || CASE WHEN p_size % 2 = 0 THEN ',"description":"' || p_type || '"' ELSE '' END
 || CASE WHEN p_size % 3 = 0 THEN ',"elements":["' || p_type || '"]' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ',"names":["' || p_name || '","x"]' ELSE '' END || '}' AS record FROM part""")
def item_records(spark, d):
    c = {"id": "concat('p', p_partkey)", "parent": "p_brand", "name": "p_name", "slug": "p_name", "access": "'code'", "description": "CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END", "elements": "CASE WHEN p_size % 3 = 0 THEN array(p_type) ELSE array() END", "names": "CASE WHEN p_size % 5 = 0 THEN array(p_name, 'x') ELSE array(p_name) END"}
    return rows(spark, d, "part", **c).select("id", gates.item_record({k: F.col(k) for k in c}).alias("record"))


@query("""WITH h AS (SELECT s_suppkey, '{"url":"https://s' || s_suppkey || '","kind":"site","name":"' || s_name || '","desc":"d' || s_nationkey || '"' || CASE WHEN s_suppkey % 2 = 0 THEN ',"title":"t' || s_suppkey || '"' ELSE '' END
 || CASE WHEN s_suppkey % 3 = 0 THEN ',"labels":["l"]' ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN ',"note":"n"' ELSE '' END || ',"categories":["c"]}' AS j FROM supplier) SELECT s_suppkey, j AS hints, substring(sha256(j), 1, 16) AS hash FROM h""")
def source_hints(spark, d):
    c = {"url": "concat('https://s', s_suppkey)", "kind": "'site'", "name": "s_name", "desc": "concat('d', s_nationkey)", "title": "CASE WHEN s_suppkey % 2 = 0 THEN concat('t', s_suppkey) ELSE concat('d', s_nationkey) END", "about": "concat('d', s_nationkey)", "labels": "CASE WHEN s_suppkey % 3 = 0 THEN array('l') ELSE array() END", "note": "CASE WHEN s_suppkey % 5 = 0 THEN 'n' ELSE '' END", "categories": "array('c')"}
    j = rows(spark, d, "supplier", s_suppkey="s_suppkey", **c).select("s_suppkey", gates.hints({k: F.col(k) for k in c}).alias("hints"))
    return j.select("s_suppkey", "hints", urls.fingerprint(F.col("hints")).alias("hash"))


@query("""SELECT count(*) FILTER (p_size % 4 = 0) AS resources, count(*) FILTER (p_size % 4 <> 0 AND p_size % 3 <> 0) AS components, count(*) FILTER (p_size % 4 <> 0 AND p_size % 3 = 0 AND p_size % 5 = 0) AS gallery, count(*) FILTER (p_size % 4 <> 0 AND p_size % 3 = 0 AND p_size % 5 <> 0) AS docs FROM part""")
def ranked_group_counts(spark, d):
    return gates.group_counts(rows(spark, d, "part", kind="CASE WHEN p_size % 4 = 0 THEN 'site' ELSE 'item' END", access="CASE WHEN p_size % 3 = 0 THEN 'page' ELSE 'code' END", granularity="CASE WHEN p_size % 5 = 0 THEN 'example' END"))


@query("SELECT s_suppkey, s_acctbal / 10000 < 0.6 OR NOT (s_nationkey % 3 IN (0, 1)) AS review FROM supplier")
def records_to_review(spark, d):
    s = rows(spark, d, "supplier", s_suppkey="s_suppkey", c="s_acctbal / 10000", p="concat('c', s_nationkey % 3)", h="array('c0', 'c1')")
    return s.select("s_suppkey", validation.needs_review(F.col("c"), F.col("p"), F.col("h")).alias("review"))


@query("SELECT s_suppkey, list_filter([CASE WHEN s_nationkey % 3 <> 0 THEN 'c' || s_nationkey % 3 END, CASE WHEN s_suppkey % 2 = 0 AND s_nationkey % 3 <> 2 THEN 'c2' END], lambda x: x IS NOT NULL) AS categories FROM supplier")
def hinted_categories(spark, d):
    s = rows(spark, d, "supplier", s_suppkey="s_suppkey", c="array(concat('c', s_nationkey % 3))", t="CASE WHEN s_suppkey % 2 = 0 THEN array('c2') END")
    return s.select("s_suppkey", gates.hint_categories(F.col("c"), F.col("t"), "c0").alias("categories"))


# Joins --------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'new' || c_custkey END ELSE c_name END AS name FROM customer")
def records_merged(spark, d):
    e = rows(spark, d, "customer", id="c_custkey", name="c_name")
    r = rows(spark, d, "customer", id="c_custkey", name="CASE WHEN c_custkey % 6 = 0 THEN 'Unknown' ELSE concat('new', c_custkey) END", present="array('name')", hit="c_custkey % 3 = 0").where("hit")
    return catalog.merge_records(e, r.drop("hit"), ["name"]).select(F.col("id").alias("c_custkey"), "name")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN 'https://x/' || p_partkey END, CASE WHEN p_size % 3 = 0 THEN 'https://t/' || replace(p_name, ' ', '%20') || '.json' END) AS url FROM part")
def template_urls_filled(spark, d):
    i = rows(spark, d, "part", p_partkey="p_partkey", url="CASE WHEN p_size % 2 = 0 THEN concat('https://x/', p_partkey) END", name="p_name")
    found = rows(spark, d, "part", p_partkey="p_partkey", name="p_name", hit="p_size % 3 = 0").where("hit").select("p_partkey", F.get(urls.candidates(F.col("name"), ["https://t/{name}.json"]), F.lit(0)).alias("found"))
    return i.join(found, "p_partkey", "left").select("p_partkey", F.coalesce("url", "found").alias("url"))


@query("SELECT p_partkey, ['https://t/' || replace(p_name, ' ', '%20') || '.json', 'https://u/' || replace(p_name, ' ', '%20')] AS candidates, 'https://t/no-such-item-zq7.json' AS probe FROM part")
def template_candidates(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", urls.candidates(n, ["https://t/{name}.json", "https://u/{name}"]).alias("candidates"), urls.probe(n, "https://t/{name}.json").alias("probe"))


@query(f"WITH {_U} SELECT DISTINCT key, CASE page_id % 3 WHEN 0 THEN 'button' WHEN 1 THEN 'nav-bar' ELSE 'zzz' END AS element FROM k")
def filter_page_members(spark, d):
    slugs = items.element_slugs(spark.createDataFrame([("button", "Buttons!", True, 0), ("nav-bar", "Nav Bar", False, 1)], "element string, name string, is_alias boolean, pos int"))
    return sitemaps.member_links(rows(spark, d, "pages", element="CASE page_id % 3 WHEN 0 THEN 'buttons' WHEN 1 THEN 'nav bar' ELSE 'zzz' END", link="url"), slugs)


@query("WITH t AS (SELECT p_brand AS tag, min(p_partkey) AS pos FROM part GROUP BY p_brand), e AS (SELECT DISTINCT p_name AS key, p_brand AS tag FROM part) SELECT key, list(tag ORDER BY pos, tag) AS tags FROM e JOIN t USING (tag) GROUP BY key")
def tag_members(spark, d):
    return gates.members_by_tag(table(spark, d, "part").groupBy(F.col("p_brand").alias("tag")).agg(F.min("p_partkey").alias("pos"), F.collect_set("p_name").alias("keys")))


@query("""WITH i AS (SELECT p_brand AS parent, p_brand || '/' || replace(p_name, ' ', '-') || p_partkey % 5 AS id, p_name || p_partkey % 5 AS n FROM part), l AS (SELECT parent, n, max(id) AS id FROM i GROUP BY ALL)
 SELECT p_partkey, coalesce(l.id, CASE WHEN p_brand || '/' || replace(p_name, ' ', '-') || p_size % 6 IN (SELECT id FROM i) THEN p_brand || '/' || replace(p_name, ' ', '-') || p_size % 6 END) AS id
 FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_name || p_size % 6 ELSE replace(p_name, ' ', '-') || p_size % 6 END AS n FROM part) a LEFT JOIN l ON l.parent = p_brand AND l.n = a.n""")
def registry_name_lookup(spark, d):
    i = rows(spark, d, "part", parent="p_brand", id="concat(p_brand, '/', replace(p_name, ' ', '-'), p_partkey % 5)", slug="replace(p_name, ' ', '-')", names="array(concat(p_name, p_partkey % 5))")
    asked = rows(spark, d, "part", p_partkey="p_partkey", parent="p_brand", name="CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, p_size % 6) ELSE concat(replace(p_name, ' ', '-'), p_size % 6) END")
    return gates.lookup(asked, i).select("p_partkey", "id")


_QK = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h, {_QK} AS k FROM pages), l AS (SELECT regexp_replace(h, '^www\\.', '') AS folder, k FROM p WHERE page_id % 2 = 0)
 SELECT page_id FROM p WHERE EXISTS (SELECT 1 FROM l WHERE l.k = p.k AND l.folder IN ('none', p.h, regexp_replace(p.h, '^www\\.', ''), 'www.' || regexp_replace(p.h, '^www\\.', '')))""")
def sitemap_carve_out(spark, d):
    p = table(spark, d, "pages")
    return gates.carved_out(p.select(F.lit("none").alias("domain"), "url", "page_id"), p.where("page_id % 2 = 0").select(urls.site(F.col("url")).alias("domain"), "url")).select("page_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 AND s_suppkey IS NOT NULL THEN 's' || s_suppkey END AS entry FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 40")
def related_entry_ids(spark, d):
    r = rows(spark, d, "customer", id="c_custkey", kind="CASE c_custkey % 3 WHEN 0 THEN 'repo' WHEN 1 THEN 'docs' ELSE 'parent' END", url="concat('HTTP://S', c_custkey % 40, '.dev/')")
    return gates.related_ids(r, rows(spark, d, "supplier", id="concat('s', s_suppkey)", url="concat('https://s', s_suppkey, '.dev')")).select(F.col("id").alias("c_custkey"), "entry")


_REF = "CASE c_custkey % 8 WHEN 0 THEN concat('E', c_custkey % 50) WHEN 1 THEN concat('http://www.d', c_custkey % 50, '.dev/') WHEN 2 THEN concat('d', c_custkey % 50, '.dev') WHEN 3 THEN concat('o/r', c_custkey % 50) WHEN 4 THEN concat('NAME ', c_custkey % 50) WHEN 5 THEN concat('d', c_custkey % 50, '.org') WHEN 6 THEN 'many.org' ELSE 'nothing' END"
_EURL = "CASE s_suppkey % 3 WHEN 0 THEN concat('https://www.d', s_suppkey, '.dev') WHEN 1 THEN concat('https://github.com/o/r', s_suppkey) ELSE concat('https://d', s_suppkey, '.dev') END"
_EDOM = "CASE WHEN s_suppkey % 5 = 0 THEN 'many.org' ELSE concat('d', s_suppkey, '.org') END"
_ENAME = "CASE WHEN s_suppkey % 4 = 0 THEN 'name 3' ELSE concat('Name ', s_suppkey) END"
_EKIND = "CASE WHEN s_suppkey = 10 THEN 'site' ELSE 'page' END"


@query(f"""WITH e AS (SELECT 'e' || s_suppkey AS id, {_EURL} AS url, {_EDOM} AS domain, lower({_ENAME}) AS name, {_EKIND} AS kind FROM supplier), r AS (SELECT DISTINCT {_REF} AS ref FROM customer), k AS (SELECT ref, regexp_replace(regexp_replace(lower(trim(ref)), '^http://', 'https://'), '/+$', '') AS key FROM r),
 n AS (SELECT name, max(id) AS id FROM e GROUP BY name HAVING count(*) = 1), dm AS (SELECT domain, max(id) AS id FROM e GROUP BY domain HAVING count(*) = 1), rt AS (SELECT domain, max(id) AS id FROM e WHERE kind = 'site' GROUP BY domain HAVING count(*) = 1)
 SELECT ref, coalesce(a.id, b.id, c.id, w.id, g.id, n.id, dm.id, rt.id) AS id FROM k LEFT JOIN e a ON a.id = key LEFT JOIN e b ON b.url = key LEFT JOIN e c ON c.url = 'https://' || key LEFT JOIN e w ON w.url = 'https://www.' || key
 LEFT JOIN e g ON regexp_matches(key, '^[\\w.-]+/[\\w.-]+$') AND g.url = 'https://github.com/' || key LEFT JOIN n ON n.name = key LEFT JOIN dm ON dm.domain = key LEFT JOIN rt ON rt.domain = key""")
def references_resolved(spark, d):
    e = rows(spark, d, "supplier", id="concat('e', s_suppkey)", url=_EURL, domain=_EDOM, name=_ENAME, kind=_EKIND)
    return search.resolve(rows(spark, d, "customer", ref=_REF).distinct(), e).select("ref", "id")


@query("SELECT c_custkey, s_name, coalesce(c_custkey % 40 < (SELECT count(*) FROM supplier), false) AS known FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 40")
def items_with_entries(spark, d):
    i = rows(spark, d, "customer", c_custkey="c_custkey", parent="c_custkey % 40")
    return catalog.cached(i, rows(spark, d, "supplier", parent="s_suppkey", s_name="s_name"), rows(spark, d, "supplier", parent="s_suppkey", s_name="s_name").limit(0), "parent", "s_name").select("c_custkey", "s_name", F.col("checked").alias("known"))


# Reports ------------------------------------------------------------------------------------------------------------


@query("SELECT p_type AS dep, min(p_partkey) AS pos, 0 AS k FROM part GROUP BY p_type UNION ALL SELECT p_brand, min(p_partkey), 1 FROM part GROUP BY p_brand")
def dependency_union(spark, d):
    return gates.dependencies(rows(spark, d, "part", pos="p_partkey", deps="array(p_type, p_brand)")).select("dep", "first.pos", "first.k")


@query("""SELECT (SELECT count(*) FROM customer) AS sites, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS with_registry, (SELECT sum(c_nationkey)::BIGINT FROM customer) AS items,
 (SELECT list(c_mktsegment || ' ' || n ORDER BY c_mktsegment) FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)) AS by_type, (SELECT list(s || ' ' || n ORDER BY s) FROM (SELECT 'n' || c_nationkey % 4 AS s, count(*) AS n FROM customer GROUP BY 1)) AS by_status""")
def inventory_totals(spark, d):
    t = gates.totals(rows(spark, d, "customer", type="c_mktsegment", status="concat('n', c_nationkey % 4)", registry="c_custkey % 3 = 0", items="CAST(c_nationkey AS BIGINT)"))
    listed = lambda c: F.transform(F.map_entries(c), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string")))
    return t.select("sites", "with_registry", "items", listed("by_type").alias("by_type"), listed("by_status").alias("by_status"))


@query("""WITH w AS (SELECT lang AS doc, regexp_extract(lower(text), '([\\p{L}\\p{N}]{3,})', 1) AS w FROM documents WHERE lang IS NOT NULL), c AS (SELECT doc, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, w) AS r FROM c) SELECT doc, list(w || ' ' || n ORDER BY r) AS hints FROM r WHERE r <= 15 GROUP BY doc""")
def title_hint_words(spark, d):
    return reports.title_hints(rows(spark, d, "documents", doc="lang", title="text").where("doc is not null"))


@query("WITH e AS (SELECT unnest(list_distinct(['n' || s_nationkey % 3, 'all'])) AS category, CASE WHEN s_suppkey % 2 = 0 THEN 'dead' ELSE 'gated' END AS reason FROM supplier) SELECT category, reason, count(*) AS n FROM e GROUP BY GROUPING SETS ((category, reason), (category))")
def unreachable_groups(spark, d):
    return reports.unreachable(rows(spark, d, "supplier", categories="array(concat('n', s_nationkey % 3), 'all')", reason="CASE WHEN s_suppkey % 2 = 0 THEN 'dead' ELSE 'gated' END"))


@query("SELECT p_type AS element, count(*) AS raw, count(*) FILTER (p_size % 4 = 0) AS demos, count(DISTINCT p_name) AS merged, count(DISTINCT p_brand) AS registries FROM part GROUP BY p_type")
def tag_coverage(spark, d):
    return reports.coverage(rows(spark, d, "part", registry="p_brand", demo="p_size % 4 = 0", slug="p_name", elements="array(p_type)"))


@query("WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS word FROM part WHERE p_size % 2 = 1) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 9")
def untagged_token_counts(spark, d):
    i = rows(spark, d, "part", elements="CASE WHEN p_size % 2 = 0 THEN array('x') ELSE array() END", t="concat(p_name, ' ', lower(p_type))")
    return reports.untagged_tokens(i, F.split("t", " "), 9)


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_nationkey % 3 = 0 THEN 0 WHEN c_nationkey % 3 = 1 THEN 1 ELSE 2 END, c_custkey) AS place FROM customer")
def queue_in_order(spark, d):
    q = gates.queue_order(rows(spark, d, "customer", id="c_custkey", curated="c_nationkey % 3 = 0", readable="c_nationkey % 3 = 1", pos="c_custkey"))
    # The place in the queue: rows of earlier ranks, then those before in the rank.
    sizes = q.groupBy("rank").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.rank") < F.col("a.rank"), "left").groupBy("a.rank").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("rank").orderBy("pos"))
    return q.join(before, "rank").select(F.col("id").alias("c_custkey"), (own + F.col("before")).alias("place"))


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 1.06 WHEN p_size % 3 = 1 THEN 0.94 ELSE 1.0 END::DOUBLE AS score FROM part ORDER BY score DESC, lower(p_name), p_partkey LIMIT 25")
def filter_only_order(spark, d):
    access = F.when(F.col("z") == 0, "code").when(F.col("z") == 1, "gated").otherwise("page")
    none = F.lit(False)
    p = search.prior(F.lit("item"), access, none, none, none, none, none)
    return gates.filter_order(rows(spark, d, "part", id="p_partkey", name="p_name", z="p_size % 3"), p).select("id", "name", "score").limit(25)


@query("SELECT n_regionkey AS region, n_name AS name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 2, r_name FROM region WHERE r_regionkey = 2")
def report_merged(spark, d):
    return reports.replace_touched(rows(spark, d, "nation", region="n_regionkey", name="n_name"), rows(spark, d, "region", region="r_regionkey", name="r_name").where("region = 2"), "region")


@query("SELECT s_suppkey, list_filter(['curated', CASE WHEN s_nationkey % 2 = 0 THEN 'gated' END, CASE WHEN s_suppkey % 3 = 0 THEN 'thin' END], lambda x: x IS NOT NULL) AS flags, list_filter([CASE WHEN s_nationkey % 2 = 0 THEN 'ask for access' END, CASE WHEN s_suppkey % 3 = 0 THEN 'render pages' END, CASE WHEN s_suppkey % 5 = 0 THEN 'use the registry' END], lambda x: x IS NOT NULL) AS advice, CASE WHEN s_suppkey % 5 = 0 THEN 'registry' WHEN s_nationkey % 2 = 0 THEN 'gated' ELSE 'other' END AS type FROM supplier")
def flags_and_advice(spark, d):
    s = rows(spark, d, "supplier", s_suppkey="s_suppkey", g="s_nationkey % 2 = 0", t="s_suppkey % 3 = 0", r="s_suppkey % 5 = 0")
    codes = F.array_compact(F.array(F.when(F.col("g"), "gated"), F.when(F.col("t"), "thin")))
    kind = F.when(F.col("r"), "registry").otherwise("site")
    return s.select("s_suppkey", reports.flags({"curated": F.lit(True), "gated": F.col("g"), "thin": F.col("t")}).alias("flags"), reports.advice(kind, codes).alias("advice"), reports.source_type({"registry": F.col("r"), "gated": F.col("g")}).alias("type"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN NULL ELSE 'https://r/' || p_partkey || '.json' END AS install_url, CASE p_size % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE 'c' END AS build FROM part")
def install_targets(spark, d):
    p = rows(spark, d, "part", p_partkey="p_partkey", n="CAST(p_partkey AS STRING)", g="p_size % 2 = 0", f="p_size % 3 = 0", builds="CASE p_size % 4 WHEN 0 THEN array(struct('ts-tw' AS stack, 'a' AS name), struct('js-css' AS stack, 'b' AS name)) WHEN 1 THEN array(struct('js-tw' AS stack, 'x' AS name), struct('ts-tw' AS stack, 'a' AS name)) ELSE array(struct('js-tw' AS stack, 'c' AS name)) END")
    return p.select("p_partkey", reports.install_url(F.lit("https://r/"), F.col("n"), F.col("g"), F.col("f")).alias("install_url"), reports.stack_build(F.col("builds"), "js-css")["name"].alias("build"))


@query("SELECT lower(replace(p_name, ' ', '-')) AS slug, arg_min(p_type, p_partkey) AS element FROM part GROUP BY 1")
def element_slug_index(spark, d):
    return items.element_slugs(rows(spark, d, "part", element="p_type", name="p_name", is_alias="false", pos="p_partkey"))


@query("SELECT r_regionkey AS grp, array_to_string(list('- ' || n_name || ': ' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'd' || n_nationkey END ORDER BY n_nationkey), chr(10)) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def taxonomy_prompts(spark, d):
    t = rows(spark, d, "nation", group="n_regionkey", pos="n_nationkey", id="n_name", definition="CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('d', n_nationkey) END")
    return reports.taxonomy_prompt(t).select(F.col("group").alias("grp"), "text")


# Verdicts -----------------------------------------------------------------------------------------------------------

_ANS = "CASE s_suppkey % 6 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 404 ELSE NULL END"


@query(f"""WITH a AS (SELECT s_nationkey AS id, {_ANS} AS st, s_suppkey % 6 = 0 AS txt, s_suppkey % 6 = 2 AS g FROM supplier), v AS (SELECT id, coalesce(bool_or(st = 200 AND txt), false) AS ok, coalesce(bool_or(st <> 200 AND g), false) AS w, coalesce(bool_or(st = 403 AND NOT g), false) AS c FROM a GROUP BY id)
 SELECT id, CASE WHEN ok THEN 'ok' WHEN w THEN 'gated' WHEN c THEN 'challenge' ELSE 'no-llms' END AS state FROM v""")
def llms_states(spark, d):
    a = rows(spark, d, "supplier", id="s_nationkey", status=_ANS, type="CASE WHEN s_suppkey % 6 = 0 THEN 'text/plain' ELSE 'text/html' END", body="CASE WHEN s_suppkey % 6 = 0 THEN '# T' ELSE '<html>' END", challenged="false", gated="s_suppkey % 6 = 2")
    return quality.llms_state(a)


_RE = {"corpus": "CASE WHEN c_custkey % 11 = 0 THEN concat('f', c_custkey) END", "repo": "CASE WHEN c_custkey % 7 = 0 THEN 'README.md' END", "registry": "CASE c_nationkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'gated' WHEN 2 THEN 'challenge' END", "llms": "CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'gated' ELSE 'no-llms' END", "home": "CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 503 WHEN 2 THEN NULL ELSE 200 END", "is_repo": "c_custkey % 2 = 0"}


@query(f"""WITH r AS (SELECT c_custkey, {', '.join(f'{x} AS {c}' for c, x in _RE.items())} FROM customer) SELECT c_custkey, CASE WHEN corpus IS NOT NULL THEN 'corpus:' || corpus WHEN repo IS NOT NULL THEN 'repo:' || repo WHEN registry = 'ok' THEN 'registry' WHEN llms = 'ok' THEN 'llms.txt'
 WHEN home IS NULL OR home = 0 OR home >= 500 THEN 'dead' WHEN coalesce(registry = 'gated', false) OR llms = 'gated' THEN 'gated' WHEN coalesce(registry = 'challenge', false) THEN 'bot-walled' WHEN is_repo THEN 'repo-gone' ELSE 'no-endpoint' END AS verdict,
 CASE WHEN is_repo AND c_nationkey % 4 = 0 THEN 'blocked' WHEN is_repo OR c_custkey % 5 = 0 THEN 'partial' ELSE 'ok' END AS digest FROM r JOIN (SELECT c_custkey, c_nationkey FROM customer) USING (c_custkey)""")
def reachability_verdicts(spark, d):
    r = rows(spark, d, "customer", c_custkey="c_custkey", n="c_nationkey % 4", thin="c_custkey % 5 = 0", **_RE)
    return r.select("c_custkey", quality.reachability(*[F.col(c) for c in _RE]).alias("verdict"), quality.digest_status(F.col("is_repo"), F.col("n"), F.col("thin")).alias("digest"))


_ROBOT = "CASE p_partkey % 6 WHEN 0 THEN 'User-agent: *' WHEN 1 THEN concat('Disallow: /', replace(p_name, ' ', '/'), ' # no') WHEN 2 THEN concat('ALLOW:/a', p_partkey) WHEN 3 THEN concat('User-Agent: Bot', p_size % 3) WHEN 4 THEN 'Sitemap: https://x/s.xml' ELSE 'Disallow:' END"


@query(f"""WITH l AS (SELECT p_brand AS host, p_partkey AS pos, lower(trim(regexp_extract({_ROBOT}, '^\\s*([A-Za-z-]+)\\s*:', 1))) AS k, trim(regexp_replace(regexp_extract({_ROBOT}, '^[^:]*:(.*)$', 1), '\\s*#.*$', '')) AS v FROM part), r AS (SELECT * FROM l WHERE k IN ('user-agent', 'allow', 'disallow')),
 b AS (SELECT *, CASE WHEN k = 'user-agent' AND coalesce(lag(k) OVER w <> 'user-agent', true) THEN 1 ELSE 0 END AS b FROM r WINDOW w AS (PARTITION BY host ORDER BY pos)), g AS (SELECT *, sum(b) OVER (PARTITION BY host ORDER BY pos) AS g FROM b)
 SELECT a.host, lower(a.v) AS agent, x.k = 'allow' AS allow, x.v AS rule FROM g a JOIN g x ON a.host = x.host AND a.g = x.g AND a.k = 'user-agent' AND x.k <> 'user-agent'""")
def robots_parsed(spark, d):
    return readers.robots_rules(rows(spark, d, "part", host="p_brand", pos="p_partkey", line=_ROBOT))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'https://s' || s_suppkey || '.dev/mcp' WHEN s_suppkey % 4 = 1 THEN 'https://s' || s_suppkey || '.dev' WHEN s_suppkey % 4 = 2 THEN 'https://mcp.s' || s_suppkey || '.dev/x' END AS url, CASE s_suppkey % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'probe' WHEN 2 THEN 'llms.txt: - MCP server: https://mcp.s' || s_suppkey || '.dev/x?y=1).' END AS evidence FROM supplier")
def mcp_endpoints(spark, d):
    s = rows(spark, d, "supplier", s_suppkey="s_suppkey", u="concat('https://s', s_suppkey, '.dev', CASE WHEN s_suppkey % 4 = 0 THEN '/mcp' ELSE '' END)", p="s_suppkey % 4 = 1", l="CASE WHEN s_suppkey % 4 = 2 THEN concat('https://s.dev/mcp\\nmcp is https://s.dev/a\\n - MCP server: https://mcp.s', s_suppkey, '.dev/x?y=1).\\nmcp https://z/mcp') ELSE 'mcp https://s.dev/a' END")
    m = gates.mcp_endpoint(F.col("u"), F.col("p"), F.replace("l", F.lit("https://s.dev/mcp\n"), F.lit("")))
    return s.select("s_suppkey", m["url"].alias("url"), m["evidence"].alias("evidence"))


_PRICE = "CASE p_size % 5 WHEN 0 THEN concat('$', p_size, ' / month') WHEN 1 THEN concat('from €', p_size, ' per user, free trial') WHEN 2 THEN concat('£', p_size) WHEN 3 THEN concat('$0 today then $', p_size, '/mo') ELSE 'free' END"


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'paid' WHEN 1 THEN 'freemium' WHEN 3 THEN 'freemium' END AS model, CASE p_size % 5 WHEN 0 THEN ['$' || p_size] WHEN 1 THEN ['€' || p_size] WHEN 2 THEN ['£' || p_size] WHEN 3 THEN list_filter(['$0', CASE WHEN p_size <> 0 THEN '$' || p_size END], lambda x: x IS NOT NULL) ELSE [] END AS prices FROM part")
def pricing_models(spark, d):
    p = rows(spark, d, "part", p_partkey="p_partkey", t=_PRICE)
    return p.select("p_partkey", gates.pricing(F.col("t")).alias("model"), html.prices(F.col("t")).alias("prices"))


@query("SELECT p_partkey, list_filter([CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_name LIKE 'cold %' THEN 'name' END], lambda x: x IS NOT NULL) AS wrong FROM part")
def argument_problems(spark, d):
    """The validators of records: values that a vocabulary lacks."""
    r = rows(spark, d, "part", p_partkey="p_partkey", v="array(CASE WHEN p_size > 40 THEN 'size' ELSE 'ok' END, CASE WHEN p_name LIKE 'cold %' THEN 'name' ELSE 'ok' END)")
    bad = validation.unknown_values(r, "p_partkey", "v", spark.createDataFrame([("ok",)], "k string"), "k")
    got = bad.groupBy("p_partkey").agg(F.sort_array(F.collect_list("value"), False).alias("wrong"))
    return r.select("p_partkey").join(got, "p_partkey", "left").select("p_partkey", F.coalesce("wrong", F.array().cast("array<string>")).alias("wrong"))


# Text, names and keys -----------------------------------------------------------------------------------------------


def _clip_sql(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN regexp_replace(substring({c}, 1, {n - 1}), '\\s+$', '') || '…' ELSE {c} END"


@query(rf"""WITH c AS (SELECT conv_id, turn, text, substring(text, 1, 120) AS head, regexp_extract(substring(text, 1, 120), '(?s)^(.*)\n', 1) AS line FROM conversations)
 SELECT conv_id, turn, {_clip_sql('text', 50)} AS clipped, CASE WHEN length(text) <= 120 THEN text WHEN length(line) > 84 THEN line ELSE head END AS cut, '<untrusted>' || chr(10) || text || chr(10) || '</untrusted>' AS wrapped, replace(replace(text, 'the', 'THE'), 'THEa', 'x') AS rewritten, regexp_extract(text, '(?is).{{0,10}}(?:that).{{0,10}}', 0) AS evidence FROM c""")
def text_shortened(spark, d):
    c = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", text.clip(c, 50).alias("clipped"), names.cut_at_line(c, 120).alias("cut"), text.untrusted(c).alias("wrapped"), text.rewrite(c, [("the", "THE"), ("THEa", "x")]).alias("rewritten"), text.evidence(c, "that", 10).alias("evidence"))


@query("SELECT p_partkey, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') AS humanised, CASE WHEN p_size % 3 = 0 THEN 'buttons' WHEN p_size % 3 = 1 THEN 'Other - ' || p_name ELSE '' END AS short, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' - Docs' END AS title, CASE p_size % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'commercial' END AS licence FROM part")
def names_shortened(spark, d):
    p = rows(spark, d, "part", p_partkey="p_partkey", slug="replace(p_name, ' ', '-')", desc="CASE WHEN p_size % 3 = 0 THEN 'Acme — buttons' WHEN p_size % 3 = 1 THEN concat('Other - ', p_name) END", title="CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' - Acme') ELSE concat(p_name, ' - Docs') END", lic="CASE p_size % 4 WHEN 0 THEN 'the MIT licence' WHEN 1 THEN 'Apache License, Version 2.0' WHEN 2 THEN 'a Commercial License' ELSE 'none' END")
    return p.select("p_partkey", text.humanise(F.col("slug")).alias("humanised"), names.short_desc(F.col("desc"), F.lit("Acme Kit"), F.lit("acme.dev")).alias("short"), names.without_site(F.col("title"), ["Acme"]).alias("title"), text.license_of(F.col("lic")).alias("licence"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 90 THEN text ELSE (SELECT max_by(substring(text, 1, k::INT), k) FROM range(20, 88) r(k) WHERE strlen(substring(text, 1, k::INT)) <= 87) || '…' END AS clipped FROM documents WHERE text IS NOT NULL AND length(text) > 60")
def bytes_clipped(spark, d):
    return table(spark, d, "documents").where("text is not null and length(text) > 60").select("doc_id", names.clip_bytes(F.col("text"), 90).alias("clipped"))


_ENC = "CASE p_size % 6 WHEN 0 THEN concat(p_name, ' &amp; x') WHEN 1 THEN concat('&#', 65 + p_size % 26, ';&#x41;', p_name) WHEN 2 THEN '&lt;b&gt; &mdash; &NBSP;&bogus;' WHEN 3 THEN '&amp;lt;' WHEN 4 THEN '&#0;&' ELSE p_name END"


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name || ' & x' WHEN 1 THEN chr(65 + p_size % 26) || 'A' || p_name WHEN 2 THEN '<b> —  &bogus;' WHEN 3 THEN '&lt;' WHEN 4 THEN '&#0;&' ELSE p_name END AS decoded, CASE WHEN p_size % 6 = 2 THEN '<b> &mdash; &NBSP;&bogus;' END AS xml FROM part")
def entities_decoded(spark, d):
    p = rows(spark, d, "part", p_partkey="p_partkey", t=_ENC, z="p_size % 6")
    return p.select("p_partkey", text.entities(F.col("t")).alias("decoded"), F.when(F.col("z") == 2, text.entities(F.col("t"), {})).alias("xml"))


_UK = "concat(CASE WHEN page_id % 2 = 0 THEN 'HTTPS://WWW.' ELSE 'https://' END, 'Site', page_id % 5, '.dev/A%20b/index.html', CASE page_id % 3 WHEN 0 THEN '?q=1' WHEN 1 THEN '#top' ELSE '' END)"


@query("""SELECT page_id, 'https://' || CASE WHEN page_id % 2 = 0 THEN 'www.' ELSE '' END || 'site' || page_id % 5 || '.dev/A%20b/index.html' || CASE WHEN page_id % 3 = 0 THEN '?q=1' ELSE '' END AS listed, 'site' || page_id % 5 || '.dev/A%20b/index.html' || CASE WHEN page_id % 3 = 0 THEN '?q=1' ELSE '' END AS with_query,
 'site' || page_id % 5 || '.dev/a b' AS sitemap, ['A b', 'index.html'] AS segments, 9 AS n_bases, 'https://reg/' || 'r/x' || page_id || '.json' AS first_base FROM pages""")
def url_keys(spark, d):
    u = F.col("u")
    b = urls.item_bases(F.lit("https://reg/"), F.concat(F.lit("x"), F.col("page_id").cast("string")))
    p = rows(spark, d, "pages", page_id="page_id", u=_UK)
    return p.select("page_id", urls.listed_key(u).alias("listed"), urls.query_key(u).alias("with_query"), urls.sitemap_key(u).alias("sitemap"), urls.segments(u).alias("segments"), F.size(b).alias("n_bases"), F.get(b, F.lit(0)).alias("first_base"))


@query("SELECT c_custkey, regexp_replace(lower(trim('HTTP://A.dev/' || c_name || '//')), '^http://', 'https://')[:-3] AS ref, regexp_extract_all(lower(c_name), '[a-z0-9]+') AS words, list_filter(['registry:2 (some gated)', CASE WHEN c_custkey % 2 = 0 THEN 'pages:3' END], lambda x: x IS NOT NULL) AS flags FROM customer")
def reference_words(spark, d):
    c = rows(spark, d, "customer", c_custkey="c_custkey", r="concat(' HTTP://A.dev/', c_name, '// ')", c_name="c_name", f="concat(' `registry:2 (some gated)', CASE WHEN c_custkey % 2 = 0 THEN ' pages:3' ELSE '' END, '` ')")
    return c.select("c_custkey", search.reference(F.col("r")).alias("ref"), gates.words(F.col("c_name")).alias("words"), gates.flag_words(F.col("f")).alias("flags"))


# Readers ------------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_round_trip(spark, d):
    from quarry.sources.readers import json_file, landed

    at = landed(spark, "json")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.json(at)
    return json_file(spark, at, "s_suppkey long, s_name string, s_acctbal double", lines=True)


@query("SELECT s_suppkey, s_name || chr(10) || s_nationkey AS text FROM supplier")
def text_round_trip(spark, d):
    from quarry.sources.readers import landed, text_files, write_files

    at = landed(spark, "text")
    write_files(rows(spark, d, "supplier", name="CAST(s_suppkey AS STRING)", content="concat(s_suppkey, '\\t', s_name, '\\n', s_nationkey, '\\n')"), at)
    f = text_files(spark, at)
    return f.select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("s_suppkey"), F.regexp_replace(F.split_part("value", F.lit("\t"), F.lit(2)), "\n$", "").alias("text"))


@query("SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'curated' ELSE 'other' END AS source_id, CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 4 END AS source_rank, s_name AS name, 'https://s' || s_suppkey AS url FROM supplier")
def source_files_ranked(spark, d):
    item = "named_struct('url', concat('https://s', s_suppkey), 'name', s_name, 'desc', '', 'title', '', 'categories', array('x'), 'labels', array('y'), 'mentions', 1)"
    s = rows(spark, d, "supplier", source_id="CASE WHEN s_nationkey % 2 = 0 THEN 'curated' ELSE 'other' END", schema_version="1", item=item)
    return readers.sources(s.groupBy("source_id", "schema_version").agg(F.collect_list("item").alias("items"))).select("source_id", "source_rank", "name", "url")


@query("SELECT p_brand AS doc, 'Kits ' || p_size % 3 AS category, p_name AS name, 'https://x.dev/' || p_partkey AS url, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS \"desc\" FROM part WHERE p_size % 5 <> 0")
def markdown_table_rows(spark, d):
    l = rows(spark, d, "part", doc="p_brand", p="p_partkey", a="concat('## Kits ', p_size % 3, ' · 9')", b="CASE WHEN p_size % 5 = 0 THEN concat('| ', p_name, ' | none |') ELSE concat('| ', p_partkey, ' | [', p_name, '](https://x.dev/', p_partkey, ') | ', CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END, ' |') END")
    lines = l.select("doc", F.explode(F.array(F.struct((F.col("p") * 2).alias("pos"), F.col("a").alias("line")), F.struct((F.col("p") * 2 + 1).alias("pos"), F.col("b").alias("line")))).alias("x")).select("doc", "x.pos", "x.line")
    return readers.markdown_rows(lines).select("doc", "category", "name", "url", F.coalesce("desc", F.lit("")).alias("desc"))


@query("SELECT s_nationkey AS site, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'https://x.dev/' || s_suppkey ELSE 'https://s.dev/docs/' || s_suppkey || '.md' END AS url, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'about ' || s_suppkey END AS \"desc\" FROM supplier")
def link_file_lines(spark, d):
    l = rows(spark, d, "supplier", site="s_nationkey", line="concat('- [', s_name, '](', CASE WHEN s_suppkey % 2 = 0 THEN concat('https://x.dev/', s_suppkey) ELSE concat('/docs/', s_suppkey, '.md') END, ')', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(': about ', s_suppkey) END)")
    f = l.groupBy("site").agg(F.array_join(F.collect_list("line"), "\n").alias("t")).select("site", F.explode(readers.link_lines(F.col("t"))).alias("x"))
    return f.select("site", "x.title", urls.resolve(F.lit("https://s.dev/"), F.col("x.url")).alias("url"), "x.desc")


@query(f"WITH {_U} SELECT site AS domain, 'https://x.dev/' || page_id || CASE WHEN page_id % 2 = 0 THEN '&z' ELSE '' END AS loc FROM k WHERE page_id % 4 <> 3")
def sitemap_expansion(spark, d):
    p = rows(spark, d, "pages", site="url", page_id="page_id").select(urls.site(F.col("site")).alias("domain"), "page_id")
    loc = F.expr("concat('<url><loc>', CASE WHEN page_id % 2 = 0 THEN concat('<![CDATA[https://x.dev/', page_id, '&z]]>') ELSE concat('https://x.dev/', page_id) END, '</loc><image:image><image:loc>https://i</image:loc></image:image></url>')")
    # One index a site names a map for each remainder of 4; the last of them is broken.
    maps = p.groupBy("domain", (F.col("page_id") % 4).alias("r")).agg(F.array_join(F.collect_list(loc), "").alias("b"))
    maps = maps.select(F.concat(F.lit("https://"), "domain", F.lit("/"), "r").alias("url"), F.when(F.col("r") == 3, F.concat(F.lit("<html>"), "b")).otherwise(F.concat(F.lit("<urlset>"), "b", F.lit("</urlset>"))).alias("text"))
    index = p.groupBy("domain").agg(F.array_join(F.transform(F.collect_set(F.col("page_id") % 4), lambda r: F.concat(F.lit("<sitemap><loc>https://"), F.col("domain"), F.lit("/"), r.cast("string"), F.lit("</loc></sitemap>"))), "").alias("b"))
    index = index.select(F.concat(F.lit("https://"), "domain", F.lit("/index")).alias("url"), F.concat(F.lit("<sitemapindex>"), "b", F.lit("</sitemapindex>")).alias("text"))
    start = p.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/index")).alias("url"))
    return readers.expand(start, index.union(maps))


@query("SELECT p_brand AS registry, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS type FROM part WHERE p_size % 3 <> 0")
def registry_index_items(spark, d):
    i = rows(spark, d, "part", registry="p_brand", j="to_json(named_struct('name', CASE WHEN p_size % 3 <> 0 THEN p_name END, 'type', CASE WHEN p_size % 2 = 0 THEN p_type END))")
    g = i.groupBy("registry").agg(F.array_join(F.collect_list("j"), ",").alias("b"))
    body = F.when(F.length("registry") % 2 == 0, F.concat(F.lit("["), "b", F.lit("]"))).otherwise(F.concat(F.lit('{"items":['), "b", F.lit("]}")))
    return g.select("registry", F.explode(readers.registry_items(body)).alias("x")).select("registry", "x.name", "x.type")


@query("SELECT p_partkey, 'a' || p_size AS path, p_name AS content FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'css', '.x {' || chr(10) || p_name || chr(10) || '}' FROM part WHERE p_size % 3 = 1")
def registry_item_files(spark, d):
    b = "CASE p_size % 3 WHEN 0 THEN concat('{\"files\":[{\"path\":\"a', p_size, '\",\"content\":\"', p_name, '\"},{\"path\":\"../b\",\"content\":\"z\"},{\"path\":\"c\"}]}') WHEN 1 THEN concat('{\"css\":{\".x\":\"', p_name, '\"}}') ELSE 'no json' END"
    return rows(spark, d, "part", p_partkey="p_partkey", b=b).select("p_partkey", F.explode(readers.item_files(F.col("b"))).alias("x")).select("p_partkey", "x.path", "x.content")


@query("SELECT kind, count(*) AS n, sum(length(html))::BIGINT AS bytes FROM (SELECT html, CASE page_id % 5 WHEN 0 THEN 'llms' WHEN 1 THEN 'registry' WHEN 2 THEN 'sitemap' WHEN 3 THEN 'markdown' ELSE 'other' END AS kind FROM pages) GROUP BY kind")
def corpus_manifest(spark, d):
    return readers.manifest(rows(spark, d, "pages", path="CASE page_id % 5 WHEN 0 THEN 'a/LLMS-full.txt' WHEN 1 THEN 'a/registry.json' WHEN 2 THEN 'a/sitemap-1.xml' WHEN 3 THEN 'a/x.md' ELSE 'a/y.html' END", length="CAST(length(html) AS BIGINT)"))


@query("SELECT DISTINCT 'd' || s_nationkey || '.dev' AS domain FROM supplier WHERE s_suppkey % 4 <> 0")
def domain_lists(spark, d):
    return readers.domain_list(rows(spark, d, "supplier", value="CASE WHEN s_suppkey % 4 = 0 THEN '# none' ELSE concat(' D', s_nationkey, '.DEV # ', s_name) END"))


@query(f"WITH {_U} SELECT arg_max(page_id, page_id) AS page_id, site FROM k GROUP BY site")
def renders_read(spark, d):
    from quarry.sources.readers import landed, rendered, write_files

    at = landed(spark, "renders")
    p = table(spark, d, "pages").select(urls.site(F.col("url")).alias("url"), F.array(F.col("page_id").cast("string")).alias("links"), "page_id")
    # One file a page, the names in the order of the ids.
    write_files(p.select(F.lpad(F.col("page_id").cast("string"), 19, "0").alias("name"), F.to_json(F.struct("url", "links")).alias("content")), at)
    got = rendered(spark, at)
    return got.select(F.get("links", F.lit(0)).cast("long").alias("page_id"), F.col("url").alias("site"))


@query(rf"""WITH {_U}, l AS (SELECT site, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["''](/[^"''/#?]*)', 1)) AS prefix FROM k JOIN pages USING (page_id)), c AS (SELECT site, prefix, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, prefix) AS r FROM c),
 g AS (SELECT site, sum(n)::BIGINT AS links, list(prefix || ' ' || n ORDER BY r) FILTER (r <= 3) AS prefixes FROM r GROUP BY site), i AS (SELECT site, sum(len(regexp_extract_all(html, '(?i)<(?:section|article|h[1-4])\b[^>]*\bid\s*=')))::BIGINT AS ids FROM k JOIN pages USING (page_id) GROUP BY site) SELECT site, ids, links, prefixes FROM i LEFT JOIN g USING (site)""")
def page_probe_summary(spark, d):
    return readers.probe_summary(table(spark, d, "pages").select(urls.site(F.col("url")).alias("site"), "url", "html"), 3)


# Pages --------------------------------------------------------------------------------------------------------------

_MD = "concat('# ', p_name, ' *x*\\n\\n```\\ncode ', p_partkey, '\\n```\\n![i](a.png)\\n## Use `it` ##\\n* see [docs](/d) and <b>', p_type, '</b>\\n', CASE WHEN p_size % 2 = 0 THEN '### Deep\\n' ELSE '' END, '<!-- c -->end')"


@query("SELECT p_partkey, p_name || ' x' AS title, [p_name || ' x'] AS h1, ['Use it'] AS h2, CASE WHEN p_size % 2 = 0 THEN ['Deep'] ELSE [] END AS h3, array_to_string(list_filter(['# ' || p_name || ' x', '## Use it ##', '- see docs and ' || p_type, CASE WHEN p_size % 2 = 0 THEN '### Deep' END, 'end'], lambda x: x IS NOT NULL), chr(10)) AS text FROM part")
def markdown_digests(spark, d):
    m = rows(spark, d, "part", p_partkey="p_partkey", m=_MD).select("p_partkey", gates.markdown_digest(F.col("m")).alias("x"))
    return m.select("p_partkey", "x.title", "x.headings.h1", "x.headings.h2", "x.headings.h3", "x.text")


@query(rf"""WITH {_V} SELECT page_id, trim(regexp_replace({_ENT.format("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS title, len(list_distinct(list_filter([trim(x) FOR x IN regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"'']+)["'']', 1)], lambda y: NOT starts_with(y, '#')))) AS n_links, sha256(t) AS text_hash FROM v""")
def page_digest_parts(spark, d):
    p = table(spark, d, "pages").select("page_id", html.digest(F.col("url"), F.col("html")).alias("g"))
    return p.select("page_id", "g.title", F.size("g.links").cast("long").alias("n_links"), F.sha2("g.text", 256).alias("text_hash"))


_MARKED = "regexp_replace(" + _drop_sql("html") + ", '(?is)<h1\\b[^>]*>(.*?)</h1>', chr(10) || '# \\1' || chr(10), 'g')"


@query(rf"""WITH v AS (SELECT page_id, array_to_string(list_filter([trim(regexp_replace(x, '\s+', ' ', 'g')) FOR x IN string_split({_ENT.format("regexp_replace(regexp_replace(" + _MARKED + ", '(?i)</?(" + html.BLOCKS + r")\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")}, chr(10))], lambda y: y <> ''), chr(10)) AS t FROM pages) SELECT page_id, sha256(t) AS text_hash, len(regexp_extract_all(t, '(?m)^# .')) AS n_headings FROM v""")
def pages_as_markdown(spark, d):
    t = html.markdown(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(t, 256).alias("text_hash"), F.regexp_count(t, F.lit("(?m)^# .")).cast("long").alias("n_headings"))


@query("SELECT page_id, 'https://l.dev/list?page=' || (page_id % 7 + 2) AS next FROM pages WHERE page_id % 7 + 2 <= 8")
def next_listing_pages(spark, d):
    p = rows(spark, d, "pages", page_id="page_id", url="concat('https://l.dev/list?page=', page_id % 7 + 1, '#', page_id)", link="explode(transform(sequence(1, 8), x -> concat('https://l.dev/list?page=', x)))")
    return pages.next_page(p).join(p.select("url", "page_id").distinct(), "url").select("page_id", "next")


@query("SELECT s_suppkey, ['/a' || s_suppkey, '/b?x=1'] AS paths FROM supplier")
def capped_link_paths(spark, d):
    s = rows(spark, d, "supplier", s_suppkey="s_suppkey", l="array('https://x.dev/', concat('https://x.dev/a', s_suppkey), 'https://x.dev', 'https://y.dev/b?x=1#z', concat('https://x.dev/a', s_suppkey, '#q'), 'https://x.dev/c')")
    return s.select("s_suppkey", pages.link_paths(F.col("l"), 2).alias("paths"))


@query(r"""SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || h AS target FROM (SELECT page_id, url, unnest([trim(x) FOR x IN regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"'']+)["'']', 1)]) AS h FROM pages) WHERE regexp_matches(h, '^/[A-Za-z]+$')""")
def rooted_links_resolved(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.explode(html.hrefs(F.col("html"))).alias("href")).where("href rlike '^/[A-Za-z]+$'")
    return p.select("page_id", urls.normalize(urls.resolve(F.col("url"), F.col("href"))).alias("target")).distinct()


@query("SELECT 'shops' AS source_id, 'https://s' || s_suppkey AS url, s_name AS name FROM supplier")
def source_written(spark, d):
    at = readers.landed(spark, "source")
    readers.write_source(rows(spark, d, "supplier", url="concat('https://s', s_suppkey)", name="s_name"), at, "shops")
    return readers.read_source(spark, at, "url string, name string").select("source_id", "url", "name")


@query("SELECT 'p' || page_id AS path, CASE WHEN page_id % 4 = 3 OR page_id % 4 = 1 AND length(html) > 3000 THEN '' ELSE html END AS text, CASE WHEN page_id % 2 = 1 AND length(html) > 3000 THEN 'too large' WHEN page_id % 4 = 3 THEN 'corrupt' END AS problem FROM (SELECT page_id, regexp_replace(substring(html, 1, 2000 + (page_id % 3)::INT * 1000), '[^ -~]', '?', 'g') AS html FROM pages)")
def gunzipped_bodies(spark, d):
    """Bodies as they are, gzipped, gzipped beyond the limit, and cut short.

    What is cut off is the trailer, so all of the body is still there to be found too large, as the SQL has it by its length.
    """
    import gzip

    import pyarrow as pa

    def zipped(batches):
        for b in batches:
            out = []
            for k, t in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                raw = t.encode()
                out.append(gzip.compress(raw, mtime=0) if k % 4 == 1 else gzip.compress(raw, mtime=0)[:-8] if k % 4 == 3 else raw)
            yield pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in b.column("page_id").to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    p = rows(spark, d, "pages", page_id="page_id", html="regexp_replace(substring(html, 1, 2000 + CAST(page_id % 3 AS INT) * 1000), '[^ -~]', '?')")
    got = readers.gunzipped(p.mapInArrow(zipped, "path string, content binary"), 3000)
    return got.select("path", F.when(F.col("problem").isNull(), F.col("text")).otherwise("").alias("text"), "problem")


# Tagging ------------------------------------------------------------------------------------------------------------

_VOCAB = [("widget", "widget", False, False), ("bolt", "bolt", False, False), ("gear", "gear", False, False), ("gear", "large gear", False, False)]
_SAID = "concat(p_name, ' ', lower(p_type))"


@query(f"""WITH t AS (SELECT p_partkey AS id, {_SAID} AS s FROM part) SELECT id, 'widget' AS element, 'small' AS variant FROM t WHERE regexp_matches(s, '\\bwidget\\b') AND regexp_matches(s, '\\bsmall\\b')
 UNION ALL SELECT id, 'gear', 'large' FROM t WHERE regexp_matches(replace(s, 'large gear', 'gear'), '\\blarge\\b') AND regexp_matches(s, '\\bgear\\b')
 UNION ALL SELECT id, 'bolt', 'promo' FROM t WHERE regexp_matches(s, '\\bbolt promo\\b')""")
def element_variants(spark, d):
    v = spark.createDataFrame([("widget", "small", "small"), ("gear", "large", "large"), ("bolt", "promo", "bolt promo")], "element string, variant string, alias string")
    t = rows(spark, d, "part", id="p_partkey", text=_SAID)
    found = tagging.variants(t, spark.createDataFrame(_VOCAB, tagging.SCHEMA), v)
    # A variant counts for texts that have its element.
    own = t.select("id", "text")
    return found.join(own, "id").where(F.expr("text rlike concat('\\\\b', element, '\\\\b')")).select("id", "element", "variant")


@query(f"""WITH t AS (SELECT p_partkey AS id, p_name AS name, lower(p_type) AS label, p_size FROM part), e AS (SELECT unnest(['widget', 'bolt', 'gear']) AS element)
 SELECT id, element, regexp_matches(name, '\\b' || element || '\\b') AS strong FROM t JOIN e ON regexp_matches(name, '\\b' || element || '\\b') OR (p_size % 3 = 0 AND element = 'gear') OR (p_size % 2 = 0 AND element = 'bolt')""")
def element_hints(spark, d):
    r = rows(spark, d, "part", id="p_partkey", name="'Kit'", desc="p_name", labels="CASE WHEN p_size % 3 = 0 THEN array('a gear') ELSE array(lower(p_type)) END", categories="CASE WHEN p_size % 2 = 0 THEN array('components') ELSE array('fonts') END", about="'the kit bolt'", note="CAST(NULL AS STRING)")
    return tagging.hints(r, spark.createDataFrame(_VOCAB, tagging.SCHEMA))


@query("SELECT p_partkey AS id, list_filter(['widget', CASE WHEN p_size % 2 = 0 THEN 'gear' END], lambda x: x IS NOT NULL) AS elements, CASE WHEN p_size % 3 = 0 THEN ['large', 'small'] WHEN p_size % 3 = 1 THEN ['small'] ELSE [] END AS kinds FROM part WHERE p_name LIKE '%widget'")
def tags_merged(spark, d):
    p = rows(spark, d, "part", id="p_partkey", e="CASE WHEN p_size % 2 = 0 THEN array('widget', 'gear', 'widget') ELSE array('widget') END", v="CASE WHEN p_size % 3 = 0 THEN array('small', 'large') WHEN p_size % 3 = 1 THEN array('small', 'small') ELSE array() END", n="p_name").where("n like '%widget'")
    each = p.select("id", F.posexplode("e").alias("pos", "element"), "v")
    return tagging.merge(each.select("id", "pos", "element", F.when(F.col("element") == "widget", F.col("v")).alias("variants")))


_STEM = "CASE WHEN length(raw) < 4 OR regexp_matches(raw, '[0-9]') THEN raw WHEN length(p) > 6 AND p LIKE '%ation' THEN regexp_replace(p, 'ation$', '') WHEN length(p) > 5 AND p LIKE '%ing' THEN regexp_replace(p, 'ing$', '') WHEN length(p) > 5 AND p LIKE '%ed' THEN regexp_replace(p, 'ed$', '') ELSE p END"
_FIELDS = f"""w AS (SELECT p_partkey AS doc, unnest(string_split(p_name, ' ')) AS raw, 3.0 AS wt, 1 AS bit FROM part UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(p_brand || ' ' || p_type), '[a-z]+|[0-9]+')), 1.0, 32 FROM part),
 p AS (SELECT *, {_PL.format('raw')} AS p FROM w), t AS (SELECT doc, {_STEM} AS term, wt, bit FROM p), l AS (SELECT doc, sum(wt) AS len FROM t GROUP BY doc), a AS (SELECT greatest(avg(len), 1.0) AS a FROM l),
 post AS (SELECT term, doc, greatest(1, floor(100 * sum(wt) / (0.25 + 0.75 * any_value(len) / any_value(a)) + 0.5))::INT AS tf100, bit_or(bit)::INT AS mask FROM t JOIN l USING (doc), a GROUP BY term, doc),
 idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM part) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term)"""


def _parts(spark, d, tags=()):
    return index.postings(readers.spread(rows(spark, d, "part", id="p_partkey", name="p_name", about="concat(p_brand, ' ', p_type)", noun="array(split(p_name, ' ')[1])")), "id", {"name": "name", "about": "about"}, list(tags))


@query(f"WITH {_FIELDS} SELECT term, doc, tf100, mask, CASE WHEN mask % 2 = 1 THEN 'name' ELSE 'about' END AS field FROM post")
def field_weights(spark, d):
    return _parts(spark, d).select("term", "doc", "tf100", "mask", search.matched_field(F.col("mask")).alias("field"))


@query(f"""WITH {_FIELDS}, s AS (SELECT doc, term, idf * (tf100 / 100.0) * 2.2 / (tf100 / 100.0 + 1.2) AS s FROM post JOIN idf USING (term) WHERE term IN ('widget', 'cold')), g AS (SELECT doc, sum(s) AS s, count(*) AS hits FROM s GROUP BY doc)
 SELECT doc, hits, round(s * (0.35 + 0.65 * (hits / 2.0) * (hits / 2.0)) * CASE WHEN hits = 2 THEN 1.25 ELSE 1 END * CASE doc % 3 WHEN 0 THEN 1.06 WHEN 1 THEN 0.94 ELSE 1.0 END, 5) AS score FROM g""")
def prior_in_scores(spark, d):
    p = _parts(spark, d)
    concepts = search.concepts_of(spark, [("q", 0, 0, "cold", False, 1.0, False), ("q", 1, 0, "widget", False, 1.0, False)])
    no = F.lit(False)
    access = F.when(F.col("doc") % 3 == 0, "code").when(F.col("doc") % 3 == 1, "gated").otherwise("page")
    out = search.score(p, index.idf(p, table(spark, d, "part").count()), concepts, search.prior(F.lit("item"), access, no, no, no, no, no))
    return out.select("doc", "hits", F.round("score", 5).alias("score"))


@query(f"""WITH {_FIELDS}, g AS (SELECT p_partkey AS doc, split_part(p_name, ' ', 2) AS noun FROM part), n AS (SELECT count(*) AS df FROM g WHERE noun = 'widget'), ti AS (SELECT ln(1 + ((SELECT count(*) FROM part) - df + 0.5) / (df + 0.5)) AS idf FROM n),
 l2 AS (SELECT doc, len + 3.0 AS len FROM l), a2 AS (SELECT avg(len) AS a FROM l2), wt2 AS (SELECT term, doc, greatest(1, floor(100 * sum(wt) / (0.25 + 0.75 * any_value(len) / any_value(a)) + 0.5)) AS tf FROM t JOIN l2 USING (doc), a2 WHERE term IN ('cold', 'widget') GROUP BY ALL),
 tg AS (SELECT doc, greatest(1, floor(100 * 3.0 / (0.25 + 0.75 * len / a) + 0.5)) AS tf FROM g JOIN l2 USING (doc), a2 WHERE noun = 'widget'), i2 AS (SELECT term, ln(1 + ((SELECT count(*) FROM part) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM wt2 GROUP BY term),
 c0 AS (SELECT doc, max(s) AS s FROM (SELECT doc, 0.7 * i2.idf * (tf / 100.0) * 2.2 / (tf / 100.0 + 1.2) AS s FROM wt2 JOIN i2 USING (term) WHERE term = 'cold') GROUP BY doc), c1 AS (SELECT doc, ti.idf * (tf / 100.0) * 2.2 / (tf / 100.0 + 1.2) AS s FROM tg, ti),
 u AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1), f AS (SELECT doc, sum(s) AS s, count(*) AS hits FROM u GROUP BY doc)
 SELECT doc, hits, round(s * (0.35 + 0.65 * (hits / 2.0) * (hits / 2.0)) * CASE WHEN hits = 2 THEN 1.25 ELSE 1 END, 5) AS score FROM f""")
def plain_words_beside_tags(spark, d):
    """A plain word weighs 0.7 beside a concept that is a tag."""
    p = _parts(spark, d, [("element", "el", F.col("noun"))])
    concepts = search.concepts_of(spark, [("q", 0, 0, "cold", False, 1.0, False), ("q", 1, 0, "el:widget", True, 1.0, False)])
    out = search.score(p, index.idf(p, table(spark, d, "part").count()), concepts)
    return out.select("doc", "hits", F.round("score", 5).alias("score"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 1.08 WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 0.95 ELSE 0.85 END ELSE 1.08 END::DOUBLE AS prior FROM supplier")
def entry_priors(spark, d):
    s = rows(spark, d, "supplier", s_suppkey="s_suppkey", mapped="s_nationkey % 2 = 0", readable="s_suppkey % 3 <> 0", record="s_suppkey % 2 = 0")
    no = F.lit(False)
    return s.select("s_suppkey", search.prior(F.lit("site"), F.lit(None).cast("string"), no, no, F.col("mapped"), F.col("readable"), F.col("record")).alias("prior"))


_NAV = "CASE c_custkey % 8 WHEN 0 THEN concat('Brand ', c_custkey % 60) WHEN 1 THEN concat('brand', c_custkey % 60, '.com') WHEN 2 THEN concat('kitname', chr(97 + CAST(c_custkey % 20 AS INT))) WHEN 3 THEN concat('repo-', c_custkey % 60) WHEN 4 THEN concat('Old Name', c_custkey % 60) WHEN 5 THEN concat('brond', c_custkey % 60) WHEN 6 THEN 'icon library' ELSE concat('brand', c_custkey % 60, ' icons') END"


@query(f"""WITH e AS (SELECT s_suppkey AS k, 's' || s_suppkey AS doc FROM supplier WHERE s_suppkey % 5 <> 4), ks AS (SELECT doc, 'brand' || k AS key FROM e UNION SELECT doc, 'brand' || k || 'com' FROM e UNION SELECT doc, 'kitname' || chr(97 + (k % 20)::INT) || 'ui' FROM e WHERE k % 5 = 0 UNION SELECT doc, 'repo' || k FROM e WHERE k % 5 = 1),
 q AS (SELECT DISTINCT {_NAV} AS q, c_custkey % 8 AS m, regexp_replace(lower({_NAV}), '[^a-z0-9]', '', 'g') AS w FROM customer WHERE c_custkey % 8 <> 6),
 hit AS (SELECT q, doc FROM q JOIN ks ON key = w OR (m = 2 AND key = w || 'ui') OR (m = 7 AND key = regexp_replace(w, 'icons$', '')) UNION SELECT q, doc FROM q JOIN e ON k % 5 = 2 AND w = 'oldname' || k)
 SELECT q, doc FROM hit UNION SELECT q, doc FROM (SELECT * FROM q ANTI JOIN hit USING (q)) JOIN ks ON length(w) >= 6 AND length(key) >= 6 AND levenshtein(w, key) <= 1""")
def navigational_names(spark, d):
    e = rows(spark, d, "supplier", doc="concat('s', s_suppkey)", name="CASE WHEN s_suppkey % 5 = 0 THEN concat('Kitname', chr(97 + CAST(s_suppkey % 20 AS INT)), ' UI') ELSE concat('Brand ', s_suppkey) END", domain="concat('www.brand', s_suppkey, '.com')", kind="CASE s_suppkey % 5 WHEN 4 THEN 'page' WHEN 1 THEN 'repo' ELSE 'site' END", url="concat('https://github.com/o/repo-', s_suppkey)", desc="CASE WHEN s_suppkey % 5 = 2 THEN concat('A kit, formerly Old Name', s_suppkey, ', and more') ELSE '' END", about="''")
    return search.navigational(rows(spark, d, "customer", q=_NAV).distinct(), e)


# Query API ----------------------------------------------------------------------------------------------------------


def _catalog(spark, d):
    from quarry.plans.api import Catalog

    e = rows(spark, d, "supplier", id="concat('s', s_suppkey)", name="s_name", url="concat('https://s', s_suppkey, '.dev')", domain="concat('s', s_suppkey, '.dev')", kind="'site'", desc="concat('shop ', s_nationkey)", categories="array(concat('c', s_nationkey % 3))", elements="array('widget')")
    i = rows(spark, d, "part", id="concat('s', p_partkey % 10, '/p', p_partkey)", parent="concat('s', p_partkey % 10)", name="p_name", slug="replace(p_name, ' ', '-')", description="p_type", elements="array(split(p_name, ' ')[1])", variants="map(split(p_name, ' ')[1], array(split(p_name, ' ')[0]))", access="CASE p_size % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'gated' ELSE 'page' END", granularity="CASE WHEN p_size % 2 = 0 THEN 'example' ELSE 'page' END", type="CASE WHEN p_size % 4 = 0 THEN 'registry:ui' ELSE 'registry:block' END", install_url="CASE WHEN p_size % 3 = 0 THEN concat('https://r/', p_partkey, '.json') END")
    c = rows(spark, d, "supplier", doc="concat('s', s_suppkey)", text="concat('# One\\n', repeat('first words ', 30), '\\n# Two ', s_suppkey, '\\n', repeat('second words ', 30))")
    return Catalog(e, i, c)


_ALL = """en AS (SELECT 's' || s_suppkey AS id, s_name AS name, NULL AS access, NULL AS gran, 1.08 AS score, 'site' AS kind, 'widget' AS el, NULL AS va FROM supplier), it AS (SELECT 's' || p_partkey % 10 || '/p' || p_partkey AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'gated' ELSE 'page' END AS access, CASE WHEN p_size % 2 = 0 THEN 'example' ELSE 'page' END AS gran,
 CASE p_size % 3 WHEN 0 THEN 1.06 WHEN 1 THEN 0.94 ELSE 1.0 END AS score, 'item' AS kind, split_part(p_name, ' ', 2) AS el, split_part(p_name, ' ', 1) AS va FROM part), al AS (SELECT * FROM en UNION ALL SELECT * FROM it)"""


@query(f"WITH {_ALL} SELECT id, name, score::DOUBLE AS score FROM al WHERE el = 'widget' ORDER BY score DESC, lower(name), id LIMIT 40")
def api_search_resources(spark, d):
    return _catalog(spark, d).search(None, element="widget", limit=40).select("id", "name", "score")


@query(f"WITH {_ALL} SELECT count(*) FILTER (kind <> 'item') AS resources, count(*) FILTER (kind = 'item' AND access <> 'page') AS components, count(*) FILTER (kind = 'item' AND access = 'page' AND gran = 'example') AS gallery, count(*) FILTER (kind = 'item' AND access = 'page' AND gran <> 'example') AS docs FROM al WHERE el = 'widget' AND va = 'cold'")
def api_search_counts(spark, d):
    return _catalog(spark, d).counts(None, element="widget", variant="cold")


@query(f"""WITH {_ALL}, g AS (SELECT *, CASE WHEN kind <> 'item' THEN 'res' WHEN access <> 'page' THEN 'code' WHEN gran = 'example' THEN 'gallery' ELSE 'docs' END AS grp FROM al WHERE el = 'widget'), c AS (SELECT *, row_number() OVER (PARTITION BY grp, CASE WHEN kind = 'item' THEN name ELSE id END ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY grp, CASE WHEN kind = 'item' THEN name ELSE id END) - 1 AS n_also FROM g),
 o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS i FROM c WHERE r = 1), p AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN i <= CASE WHEN grp IN ('res', 'code') THEN 5 ELSE 3 END THEN 1 ELSE 2 END AS pr FROM o), t AS (SELECT * FROM p ORDER BY pr, score DESC, id LIMIT 10)
 SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS place, id, n_also FROM t""")
def api_search_groups(spark, d):
    g = _catalog(spark, d).search_groups(None, element="widget", limit=10)
    return g.select("grp", F.col("place").cast("long").alias("place"), "id", F.coalesce(F.size("also"), F.lit(0)).cast("long").alias("n_also"))


@query(f"WITH {_ALL}, c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY name) - 1 AS n_also FROM it WHERE access = 'code' AND el = 'bolt') SELECT id, name, n_also FROM c WHERE r = 1 ORDER BY score DESC, lower(name), id LIMIT 20")
def api_search_components(spark, d):
    return _catalog(spark, d).search_items(None, element="bolt", access="code").select("id", "name", F.greatest(F.coalesce(F.size("also"), F.lit(0)), F.lit(0)).cast("long").alias("n_also"))


@query(f"WITH {_ALL} SELECT id, name FROM it WHERE starts_with(id, 's3/') ORDER BY score DESC, lower(name), id LIMIT 30 OFFSET 2")
def api_list_pages(spark, d):
    return _catalog(spark, d).list_pages("S3.dev", limit=30, offset=2).select("id", "name")


@query("SELECT 's4' AS id, 'Supplier#000000004' AS name, 'https://s4.dev' AS url, 'shop ' || s_nationkey AS \"desc\" FROM supplier WHERE s_suppkey = 4")
def api_get_resource(spark, d):
    r = F.from_json("record", "id string, name string, url string, desc string")
    return _catalog(spark, d).get("https://www.s4.dev/".replace("www.", ""), 150).select(r.alias("r")).select("r.*")


@query("SELECT 's2/p' || p_partkey AS id FROM part WHERE p_partkey % 10 = 2 AND p_size % 4 = 0 AND (p_name || ' ' || lower(p_type)) LIKE '%e%' AND (p_name || ' ' || lower(p_type)) LIKE '%o%' ORDER BY lower(p_name), id LIMIT 100")
def api_list_components(spark, d):
    return _catalog(spark, d).list_registry("s2", "e O", "ui").select("id")


@query("SELECT 2 AS n, 'Two 5' AS title, '# Two 5' || chr(10) || repeat('second words ', 30) AS part")
def api_get_content(spark, d):
    return _catalog(spark, d).content("s5", section=2).select("n", "title", "part")


@query("SELECT 's1' AS parent, 'kit' AS name, substring('// a' || chr(10) || 'x' || chr(10) || chr(10) || '// b' || chr(10) || s_name, 4, 20) AS part, CASE WHEN length('// a' || chr(10) || 'x' || chr(10) || chr(10) || '// b' || chr(10) || s_name) > 23 THEN 23 END AS next_offset FROM supplier WHERE s_suppkey = 1")
def api_get_component(spark, d):
    s = rows(spark, d, "supplier", k="s_suppkey", parent="concat('s', s_suppkey)", name="'kit'", path="'b'", content="s_name").where("k = 1").drop("k")
    a = s.select("parent", "name", F.lit("a").alias("path"), F.lit("x").alias("content"))
    return _catalog(spark, d).component(a.union(s), "s1", "KIT", 3, 20)


@query("SELECT 's' || p_partkey % 10 || '/p' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'bunx --bun shadcn@latest add https://r/' || p_partkey || '.json' END AS command, CASE p_size % 3 WHEN 1 THEN 'gated' WHEN 2 THEN 'page' END AS skipped FROM part WHERE p_partkey BETWEEN 10 AND 30 UNION ALL SELECT 'zz', NULL, 'unknown'")
def api_install_commands(spark, d):
    return _catalog(spark, d).install_plan([*(f"s{k % 10}/p{k}" for k in range(10, 31)), "zz"], "bun")


@query("SELECT split_part(p_name, ' ', 2) AS element, CASE p_size % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'gated' ELSE 'page' END AS access, CASE WHEN p_size % 2 = 0 THEN 'example' ELSE 'page' END AS granularity, count(*) AS n, count(DISTINCT p_partkey % 10) AS registries FROM part WHERE split_part(p_name, ' ', 2) = 'gear' GROUP BY ALL")
def api_element_facets(spark, d):
    return _catalog(spark, d).facets("gear").select(F.lit("gear").alias("element"), "access", "granularity", "n", "registries")


@query(r"WITH l AS (SELECT page_id, url, regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) AS h FROM pages) SELECT url FROM (SELECT url, page_id FROM l WHERE page_id % 2 = 0 AND list_has_any(regexp_extract_all(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '[\p{L}\p{N}]+'), ['en', 'fr']) ORDER BY page_id LIMIT 50 OFFSET 1)")
def api_site_urls(spark, d):
    p = rows(spark, d, "pages", domain="CASE WHEN page_id % 2 = 0 THEN 's1.dev' ELSE 's2.dev' END", pos="page_id", url="url")
    return _catalog(spark, d).site_urls(p, "s1", "EN x", "fr", limit=50, offset=1)


# Content, freshness and batches -------------------------------------------------------------------------------------


@query("WITH f AS (SELECT count(*) || '-' || sum(('0x' || substring(md5(s_suppkey || chr(1) || s_name), 1, 8))::BIGINT)::VARCHAR || '-' || sum(('0x' || substring(md5(s_suppkey || chr(1) || s_name), 9, 8))::BIGINT)::VARCHAR AS fingerprint FROM supplier) SELECT 3 AS schema_version, fingerprint, true AS fresh FROM f UNION ALL SELECT 2, fingerprint, false FROM f UNION ALL SELECT 3, 'x', false")
def index_freshness(spark, d):
    now = gates.fingerprint(table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), "s_name"), ["k", "s_name"])
    stored = now.select(F.lit(3).alias("schema_version"), "fingerprint").union(now.select(F.lit(2), "fingerprint")).union(spark.createDataFrame([(3, "x")], "schema_version int, fingerprint string"))
    return gates.is_fresh(stored, 3, now)


@query("SELECT doc_id, begin_at, substring(text, begin_at + 1, 160) AS part FROM (SELECT doc_id, text, CASE WHEN nl >= 0 AND fr - nl <= least(20, mid) THEN nl + 1 ELSE fr END AS begin_at FROM (SELECT *, CASE WHEN contains(substring(text, 1, fr + 1), chr(10)) THEN fr + 1 - instr(reverse(substring(text, 1, fr + 1)), chr(10)) ELSE -1 END AS nl FROM (SELECT doc_id, text, n_chars // 2 AS mid, n_chars // 2 - least(20, n_chars // 2) AS fr FROM documents WHERE text IS NOT NULL AND n_chars = length(text))))")
def snippet_windows(spark, d):
    t = table(spark, d, "documents").where("text is not null and n_chars = length(text)")
    w = sections.snapped(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int"), 160)
    return t.select("doc_id", w.alias("w")).select("doc_id", F.col("w.begin").cast("long").alias("begin_at"), "w.part")


@query("""WITH RECURSIVE h AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, '# ' || role AS head, text, greatest(300, least(500, (1500 - 300) // count(*) OVER (PARTITION BY conv_id))) AS per FROM conversations),
 p AS (SELECT doc, 0::BIGINT AS i, '' AS text, 0::BIGINT AS used FROM (SELECT DISTINCT doc FROM h) UNION ALL SELECT h.doc, h.i, p.text || CASE WHEN p.i > 0 THEN chr(10) || chr(10) ELSE '' END || x.part, p.used + strlen(x.part) + 2 FROM p JOIN h ON h.doc = p.doc AND h.i = p.i + 1,
 LATERAL (SELECT 1500 - p.used - strlen(h.head) - 2 AS room) r, LATERAL (SELECT substring(h.text, 1, greatest(200, least(h.per, r.room))::INT) AS piece) q, LATERAL (SELECT h.head || chr(10) || q.piece || CASE WHEN length(h.text) > length(q.piece) THEN chr(10) || '…(' || (length(h.text) - length(q.piece)) || ' more characters)' ELSE '' END AS part) x WHERE p.i = 0 OR r.room >= 300)
 SELECT p.doc, p.i AS shown, h.turn AS next, p.text FROM p LEFT JOIN h ON h.doc = p.doc AND h.i = p.i + 1 WHERE p.i = (SELECT max(i) FROM p z WHERE z.doc = p.doc)""")
def content_packed(spark, d):
    h = rows(spark, d, "conversations", doc="conv_id", rank="turn", head="concat('# ', role)", text="text")
    return sections.pack(h, 1500, 500, 300).select("doc", F.col("shown").cast("long").alias("shown"), "next", "text")


_CP = "concat('https://k.dev/@a', p_size % 5, '/', CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'components' END, '/', replace(p_name, ' ', '-'), CASE p_partkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '?v=1' ELSE '' END)"


@query("SELECT key, 'a' || a AS author, n AS name, 'https://k.dev/@a' || a || '/components/' || n AS url FROM (SELECT DISTINCT 'a' || p_size % 5 || '/' || replace(p_name, ' ', '-') AS key, p_size % 5 AS a, replace(p_name, ' ', '-') AS n FROM part WHERE p_partkey % 3 <> 0)")
def component_page_urls(spark, d):
    return gates.component_pages(rows(spark, d, "part", pos="p_partkey", loc=_CP))


@query("WITH b AS (SELECT n_regionkey AS region, n_nationkey AS id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 3 AS batch FROM nation), p AS (SELECT *, row_number() OVER (PARTITION BY region, batch ORDER BY id) AS i FROM b) SELECT region, batch::INT AS batch, '# Batch ' || (batch + 1) || chr(10) || chr(10) || string_agg(i || '. `' || id || '`', chr(10) ORDER BY i) AS text FROM p GROUP BY region, batch")
def batch_instructions(spark, d):
    return gates.batch_texts(rows(spark, d, "nation", region="n_regionkey", id="n_nationkey"), ["region"], [F.col("id")], 3, "# Batch {n}")


@query("SELECT o_orderkey, o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY AS recent FROM orders")
def recent_rows(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", gates.is_recent(F.col("o_orderdate"), o.agg(F.max("o_orderdate")).scalar()).alias("recent"))


@query(f"""WITH i AS (SELECT p_partkey AS id, p_brand AS registry, {_PNAME} AS name, p_name AS title, {_TYPE} AS t FROM part), k AS (SELECT * FROM i WHERE NOT (coalesce(t, '') IN ('registry:hook', 'registry:file') OR registry = 'Brand#1' OR starts_with(name, 'icons-')) AND name <> 'democracy')
 SELECT id, e AS element FROM k, (SELECT unnest(['widget', 'bolt', 'gear']) AS e) WHERE title LIKE '% ' || e UNION ALL SELECT id, 'fixed' FROM i WHERE name = 'democracy'""")
def items_tagged(spark, d):
    i = rows(spark, d, "part", id="p_partkey", registry="p_brand", name=_PNAME, title="p_name", type=_TYPE, asset="p_brand = 'Brand#1'")
    fixed = table(spark, d, "part").select(F.col("p_brand").alias("registry"), F.lit("democracy").alias("name"), F.array(F.lit("fixed")).alias("elements")).distinct()
    return tagging.tag_items(i, spark.createDataFrame(_VOCAB[:3], tagging.SCHEMA), fixed)
