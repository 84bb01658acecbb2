"""Queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import html, text, urls
from quarry.operators import catalog, index, items, pages, phrases, quality, reports, search, sections, sitemaps, tagging, validation
from quarry.sources import readers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    """A table of long texts, on all cores."""
    return readers.spread(table(spark, d, name))


# URLs ---------------------------------------------------------------------------------------------------------------

_U = r"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^(?i)(https?)://', 1)) AS s, lower(regexp_extract(url, '^(?i)https?://([^/?#\s]+)', 1)) AS h,
 regexp_extract(url, '^(?i)https?://[^/?#\s]+([^?#\s]*)', 1) AS p, array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|ref_src|fbclid|gclid|mc_cid|mc_eid)(=|$)')), '&') AS q FROM pages),
 k AS (SELECT *, s || '://' || h || regexp_replace(p, '/$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS norm, regexp_replace(h, '^www\.', '') AS site,
 regexp_replace(h, '^www\.', '') || regexp_replace(p, '/$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key, regexp_replace(h, '^www\.', '') || regexp_replace(p, '/$', '') AS page FROM u)"""


@query(f"WITH {_U} SELECT page_id, norm, key, page FROM k")
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.normalize(u).alias("norm"), urls.key(u).alias("key"), urls.page_key(u).alias("page"))


@query(f"WITH {_U} SELECT key, min(page_id) AS first_page, count(*) AS n FROM k GROUP BY key")
def url_key_dedupe(spark, d):
    return table(spark, d, "pages").groupBy(urls.key(F.col("url")).alias("key")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query(f"""WITH {_U}, r AS (SELECT page_id, page_id % 3 = 0 AS loose, key AS strict_key, page FROM k),
 b AS (SELECT page, min(page_id) FILTER (NOT loose) AS s, min(page_id) FILTER (loose) AS l FROM r GROUP BY page)
 SELECT r.page_id, CASE WHEN NOT loose OR strict_key IN (SELECT strict_key FROM r WHERE NOT loose) THEN r.strict_key ELSE (SELECT x.strict_key FROM r x WHERE x.page_id = coalesce(b.s, b.l)) END AS merged FROM r JOIN b USING (page)""")
def url_key_strict_vs_loose(spark, d):
    loose = F.col("page_id") % 3 == 0
    p = table(spark, d, "pages").select("page_id", "url", loose.alias("loose"), loose.cast("int").alias("rank"), F.col("page_id").alias("pos"))
    return catalog.loose_keys(p).select("page_id", F.col("key").alias("merged"))


@query(f"WITH {_U} SELECT site, count(*) AS n, count(DISTINCT page) AS pages FROM k GROUP BY site")
def host_page_counts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").groupBy(urls.site(u).alias("site")).agg(F.count("*").alias("n"), F.countDistinct(urls.page_key(u)).alias("pages"))


@query(f"""WITH {_U}, c AS (SELECT coalesce(list_filter(string_split(p, '/'), lambda x: x <> '')[1], '') AS prefix, count(*) AS n FROM k GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY n DESC, prefix) AS i FROM c) SELECT CASE WHEN i <= 8 THEN prefix ELSE 'more' END AS prefix, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def path_prefix_histogram(spark, d):
    return items.prefixes(table(spark, d, "pages"))


@query(f"""WITH {_U} SELECT page_id, CASE WHEN regexp_matches(p, '^/?[^/]+/\\d+/?$') THEN regexp_extract(p, '^/?([^/]+)/\\d+/?$', 1) WHEN regexp_matches(p, '^/?[^/]+/?$') THEN regexp_extract(p, '^/?([^/]+)/?$', 1) END AS name FROM k""")
def template_match(spark, d):
    return table(spark, d, "pages").select("page_id", urls.match(urls.path(F.col("url")), ["/{name}/{n}", "/{name}"]).alias("name"))


@query(f"""WITH {_U}, x AS (SELECT site AS domain, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM k),
 y AS (SELECT domain, '/' || array_to_string(s[1:len(s) - 1], '/') || '/{{name}}' AS dir, s[len(s)] AS name FROM x WHERE len(s) >= 2)
 SELECT domain, dir, count(*) AS n, count(DISTINCT name) AS names, CASE WHEN count(*) >= 3 AND count(DISTINCT name) * 2 >= count(*) THEN 'HIGH' ELSE 'low' END AS verdict FROM y GROUP BY ALL""")
def template_mining(spark, d):
    return items.mine_templates(table(spark, d, "pages").select(urls.site(F.col("url")).alias("domain"), "url"), 3)


@query(f"WITH {_U}, r AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN regexp_replace(p, '/$', '') = '' THEN 0 ELSE 1 END, page_id) AS i FROM k) SELECT site, page_id FROM r WHERE i = 1")
def host_parent_pick(spark, d):
    p = table(spark, d, "pages").select(urls.site(F.col("url")).alias("site"), "page_id", (F.regexp_replace(urls.path(F.col("url")), "/$", "") != "").cast("int").alias("rank"))
    return items.first_per(p, "site", [F.col("rank"), F.col("page_id")]).select("site", "page_id")


@query(f"WITH {_U}, e AS (SELECT page_id, string_split(h, '.') AS a FROM k), s AS (SELECT page_id, unnest([array_to_string(a[i:], '.') FOR i IN range(1, len(a) + 1)]) AS suffix FROM e) SELECT suffix, count(*) AS n FROM s GROUP BY suffix")
def host_suffix_counts(spark, d):
    return table(spark, d, "pages").select(F.explode(urls.suffixes(urls.host(F.col("url")))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT page_id, html FROM pages) SELECT page_id, regexp_replace(url, '[#?].*$', '') || CASE WHEN contains(regexp_replace(url, '[#?].*$', ''), '?') THEN '&' ELSE '?' END || 'page=2' AS next_url FROM pages""")
def page_number_urls(spark, d):
    return table(spark, d, "pages").select("page_id", urls.with_page(F.regexp_replace("url", "[#?].*$", ""), "page", F.lit(2)).alias("next_url"))


# HTML ---------------------------------------------------------------------------------------------------------------

_ENT = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("SELECT page_id, trim(regexp_replace(" + _ENT.format("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)") + r", '\s+', ' ', 'g')) AS title FROM pages")
def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


_H = r"""h AS (SELECT page_id, list_filter([trim(regexp_replace(""" + _ENT.format("regexp_replace(x, '<[^>]+>', ' ', 'g')") + r""", '\s+', ' ', 'g')) FOR x IN regexp_extract_all(html, '(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>', 1)], lambda y: y <> '') AS hs FROM pages)"""


@query(f"WITH {_H} SELECT page_id, len(hs) AS n_headings, coalesce(hs[1], '') AS first_heading FROM h")
def html_headings(spark, d):
    h = html.headings(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(h).cast("long").alias("n_headings"), F.coalesce(F.get(h, F.lit(0)), F.lit("")).alias("first_heading"))


@query("""SELECT page_id, len(list_distinct(list_filter([trim(x) FOR x IN regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref=["'']([^"'']+)["'']', 1)], lambda y: NOT starts_with(y, '#')))) AS n_links FROM pages""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(html.hrefs(F.col("html"))).cast("long").alias("n_links"))


def _drop_sql(c: str) -> str:
    for n in html.DROPPED:
        c = rf"regexp_replace({c}, '(?is)<{n}\b[^>]*>.*?</{n}\s*>', ' ', 'g')"
    return f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"


_V = rf"""v AS (SELECT page_id, html, array_to_string(list_filter([trim(regexp_replace(x, '\s+', ' ', 'g')) FOR x IN string_split({_ENT.format("regexp_replace(regexp_replace(" + _drop_sql("html") + ", '(?i)</?(" + html.BLOCKS + r")\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")}, chr(10))], lambda y: y <> ''), chr(10)) AS t FROM pages)"""


@query(f"WITH {_V} SELECT page_id, sha256(t) AS text_hash, length(t) AS n_chars FROM v")
def html_visible_text(spark, d):
    t = html.visible(F.col("html"))
    return texts(spark, d, "pages").select("page_id", F.sha2(t, 256).alias("text_hash"), F.length(t).cast("long").alias("n_chars"))


@query(rf"WITH {_V} SELECT page_id, len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: x <> '' AND NOT regexp_matches(lower(x), '\bcookies?\b')))) AS n_lines FROM v")
def html_clean_lines(spark, d):
    return texts(spark, d, "pages").select("page_id", F.size(html.clean_lines(html.visible(F.col("html")))).cast("long").alias("n_lines"))


@query(rf"""WITH {_V} SELECT page_id, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) < 40 AND (regexp_matches(html, '(?i)id=["''](root|app|__next|__nuxt)["'']') OR len(regexp_extract_all(html, '(?i)<script\b[^>]*\bsrc=')) >= 3) AS thin FROM v""")
def page_thin_verdict(spark, d):
    words = F.size(F.filter(F.split(html.visible(F.col("html")), r"\s+"), lambda x: x != ""))
    return texts(spark, d, "pages").select("page_id", html.thin(F.col("html"), words).alias("thin"))


@query()
def html_digest(spark, d):
    return texts(spark, d, "pages").select("page_id", html.digest(F.col("url"), F.col("html")).alias("digest"))


@query(r"""WITH l AS (SELECT page_id, url, unnest([trim(x) FOR x IN regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"'']+)["'']', 1)]) AS h FROM pages), a AS (SELECT page_id, CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h ELSE h END AS u FROM l WHERE NOT starts_with(h, '#'))
 SELECT DISTINCT page_id, lower(regexp_extract(u, '^(https?://[^/?#]+)', 1)) || regexp_replace(regexp_extract(u, '^https?://[^/?#]+([^?#\s]*)', 1), '/$', '') AS target FROM a WHERE regexp_matches(u, '^https?://')""")
def links_resolved(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.explode(html.hrefs(F.col("html"))).alias("href"))
    return p.select("page_id", urls.normalize(urls.resolve(F.col("url"), F.col("href"))).alias("target")).where("target is not null").distinct()


# Text and index -----------------------------------------------------------------------------------------------------

_T = r"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents)"""
_PL = "CASE WHEN regexp_matches({0}, '(ss|us|is)$') THEN {0} WHEN {0} LIKE '%ies' THEN regexp_replace({0}, 'ies$', 'y') WHEN regexp_matches({0}, '(ch|sh|x|z|ss)es$') THEN regexp_replace({0}, 'es$', '') WHEN {0} LIKE '%s' THEN regexp_replace({0}, 's$', '') ELSE {0} END"
_ST = f"""w AS (SELECT doc_id, unnest(ws) AS raw FROM t), p AS (SELECT doc_id, raw, {_PL.format("raw")} AS p FROM w),
 st AS (SELECT doc_id, raw, CASE WHEN length(raw) < 4 OR regexp_matches(raw, '[0-9]') THEN raw WHEN length(p) > 6 AND p LIKE '%ation' THEN regexp_replace(p, 'ation$', '') WHEN length(p) > 5 AND p LIKE '%ing' THEN regexp_replace(p, 'ing$', '') WHEN length(p) > 5 AND p LIKE '%ed' THEN regexp_replace(p, 'ed$', '') ELSE p END AS term FROM p)"""
_IDX = f"""{_T}, {_ST}, tf AS (SELECT doc_id AS doc, term, count(*) AS n FROM st GROUP BY ALL), ln AS (SELECT doc, sum(n)::DOUBLE AS len FROM tf GROUP BY doc),
 av AS (SELECT greatest(avg(len), 1.0) AS a FROM ln), post AS (SELECT term, doc, greatest(1, floor(100 * n / (0.25 + 0.75 * len / a) + 0.5))::INT AS tf100 FROM tf JOIN ln USING (doc), av),
 dfs AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term)"""


def _postings(spark, d, only=None):
    return index.postings(texts(spark, d), "doc_id", {"about": "text"}, only=only)


@query(f"WITH {_T} SELECT doc_id, len(ws) AS n_tokens, len(list_distinct(ws)) AS n_distinct FROM t")
def tokenize_counts(spark, d):
    t = text.tokens(F.coalesce("text", F.lit("")))
    return texts(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"WITH {_T}, {_ST} SELECT term, count(*) AS n, count(DISTINCT raw) AS forms FROM st GROUP BY term")
def stem_counts(spark, d):
    w = texts(spark, d).select(F.explode(text.tokens(F.col("text"))).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return w.groupBy(text.stem(F.col("raw")).alias("term")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query(f"WITH {_IDX} SELECT count(*) AS docs, sum(len)::BIGINT AS total, round(avg(len), 4) AS mean FROM ln")
def doc_length_stats(spark, d):
    t = index.lengths(texts(spark, d), "doc_id", "text").where("len > 0")
    return t.agg(F.count("*").alias("docs"), F.sum("len").alias("total"), F.round(F.avg("len"), 4).alias("mean"))


@query(f"WITH {_IDX} SELECT doc, count(*) AS terms, sum(tf100)::BIGINT AS tf100 FROM post GROUP BY doc")
def postings_build(spark, d):
    return _postings(spark, d).groupBy("doc").agg(F.count("*").alias("terms"), F.sum("tf100").alias("tf100"))


@query(f"WITH {_IDX} SELECT term, df, round(idf, 6) AS idf FROM dfs")
def idf_table(spark, d):
    return index.idf(_postings(spark, d), table(spark, d, "documents").count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_IDX}, g AS (SELECT term, doc - coalesce(lag(doc) OVER (PARTITION BY term ORDER BY doc), 0) AS gap FROM post) SELECT term, max(gap) AS widest, count(*) AS n FROM g GROUP BY term")
def posting_deltas(spark, d):
    g = index.delta(_postings(spark, d)).select("term", F.conv("gap36", 36, 10).cast("long").alias("gap"))
    return g.groupBy("term").agg(F.max("gap").alias("widest"), F.count("*").alias("n"))


_Q = [("the energy of light", [(0, 0, "the"), (1, 0, "of"), (2, 0, "that"), (2, 1, "und")]), ("la de", [(0, 0, "la"), (1, 0, "de")]), ("der und", [(0, 0, "der"), (1, 0, "und"), (1, 1, "and")])]
_CROWS = [(q, c, a, t, False, 1.0 if a == 0 else 0.7, False) for q, rows in _Q for c, a, t in rows]
_CSQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', {c}, {a}, '{t}', {w})" for q, c, a, t, _, w, _ in _CROWS) + ") AS v(q, concept, alt, term, weight))"
_SCORE = f"""{_IDX}, {_CSQL}, ci AS (SELECT c.*, coalesce(idf, 0) AS idf FROM c LEFT JOIN dfs USING (term)), ty AS (SELECT q, concept, sum(idf) AS typed FROM ci WHERE alt = 0 GROUP BY ALL),
 s AS (SELECT ci.q, ci.concept, alt, doc, CASE WHEN alt = 0 OR idf = 0 THEN 1.0 ELSE least(1.0, typed / idf) END * weight * idf * (tf100 / 100.0) * 2.2 / (tf100 / 100.0 + 1.2) AS s FROM ci JOIN ty USING (q, concept) JOIN post USING (term)),
 b AS (SELECT q, concept, doc, max(s) AS s FROM s WHERE s > 0 GROUP BY ALL), n AS (SELECT q, count(DISTINCT concept) AS n FROM c GROUP BY q),
 f AS (SELECT q, doc, sum(s) * (0.35 + 0.65 * (count(*) / n) * (count(*) / n)) * CASE WHEN count(*) = n AND n > 1 THEN 1.25 ELSE 1 END AS score, count(*) AS hits FROM b JOIN n USING (q) GROUP BY q, doc, n)"""


def _scored(spark, d):
    concepts = search.concepts_of(spark, _CROWS)
    p = _postings(spark, d, concepts)  # read for the idf and for the scores, shuffled once
    return search.score(p, index.idf(p, table(spark, d, "documents").count()), concepts)


@query(f"WITH {_SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) AS rank FROM f) SELECT q, doc, round(score, 4) AS score, rank FROM r WHERE rank <= 10")
def bm25_top10(spark, d):
    return search.top(_scored(spark, d).withColumn("score", F.round("score", 6)), 10).select("q", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long"))


@query(f"WITH {_SCORE} SELECT q, hits, count(*) AS docs, round(max(score), 4) AS best FROM f GROUP BY ALL")
def bm25_coverage_bonus(spark, d):
    return _scored(spark, d).groupBy("q", "hits").agg(F.count("*").alias("docs"), F.round(F.max("score"), 4).alias("best"))


@query(f"""WITH {_T}, v AS MATERIALIZED (SELECT DISTINCT unnest(ws) AS term FROM t), q AS (SELECT * FROM (VALUES ('energi'), ('nichtt'), ('whatt'), ('nothere'), ('mentelle')) AS x(word)), u AS (SELECT word FROM q ANTI JOIN v ON word = term WHERE length(word) >= 5)
 SELECT word, term FROM u JOIN v ON length(term) >= 4 AND abs(length(term) - length(word)) <= 1 WHERE levenshtein(word, regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g')) <= 1""")
def fuzzy_vocab_match(spark, d):
    v = texts(spark, d).select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return search.fuzzy(spark.createDataFrame([(x,) for x in ("energi", "nichtt", "whatt", "nothere", "mentelle")], "word string"), v)


@query(r"SELECT sha256(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', '', 'g')) AS compact_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def doc_compact_key_dupes(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(text.compact(F.coalesce("text", F.lit(""))), 256).alias("compact_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""WITH l AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc, lower(line) ORDER BY pos) AS i FROM l) SELECT doc, count(*) AS n_lines, count(*) FILTER (i = 1) AS n_fresh FROM r GROUP BY doc""")
def repeated_lines(spark, d):
    l = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = l.groupBy("doc").agg(F.count("*").alias("n_lines"))
    return n.join(sections.fresh_lines(l).groupBy("doc").agg(F.count("*").alias("n_fresh")), "doc")


@query("SELECT doc_id, substring(sha256(coalesce(text, '')), 1, 16) AS fingerprint FROM documents")
def fingerprint_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", urls.fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(substring(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '^https?://', ''), '[^a-z0-9]+', '-', 'g'), '-'), 1, 72), '-+$', ''), '^$', '') AS slug, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens,
 round(CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN 1 - len(regexp_extract_all(text, '\p{Latin}')) / len(regexp_extract_all(text, '\p{L}')) ELSE 0 END, 6) AS non_latin FROM documents""")
def slugs_and_scripts(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.slug(t).alias("slug"), text.estimate_tokens(t).alias("tokens"), F.round(text.non_latin_share(t), 6).alias("non_latin"))


# Answer shapes ------------------------------------------------------------------------------------------------------


@query("SELECT lang, source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY ALL")
def lang_group_facets(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@query("WITH c AS (SELECT lang, source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY chars DESC, source) AS i FROM c) SELECT lang, source, chars FROM r WHERE i <= 3")
def source_topk_per_lang(spark, d):
    c = table(spark, d, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("chars"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("chars"), "source"))
    return c.withColumn("i", r).where("i <= 3").drop("i")


@query("""WITH h AS (SELECT source AS grp, doc_id AS doc, n_chars AS score FROM documents), b AS (SELECT *, score >= (SELECT max(score) FROM h) / 2 AS strong, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc) AS i FROM h),
 p AS (SELECT *, CASE WHEN strong AND i = 1 THEN 0 WHEN strong AND i <= CASE WHEN grp = 'src0' THEN 3 ELSE 2 END THEN 1 ELSE 2 END AS priority FROM b)
 SELECT grp, doc, score, priority FROM p ORDER BY priority, score DESC, doc LIMIT 20""")
def capped_group_fill(spark, d):
    return search.capped_fill(table(spark, d, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("score")), 20, {"src0": 3}, 2)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS i FROM part)
 SELECT p_name, max(p_partkey) FILTER (i = 1) AS p_partkey, count(*) - 1 AS n_also, coalesce(sum(p_partkey) FILTER (i > 1), 0)::BIGINT AS also_sum FROM r GROUP BY p_name""")
def collapse_same_key(spark, d):
    c = search.collapse(table(spark, d, "part"), ["p_name"], [F.desc("p_retailprice"), F.col("p_partkey")], "p_partkey")
    also = F.coalesce("also", F.array().cast("array<bigint>"))
    return c.select("p_name", "p_partkey", F.size(also).cast("long").alias("n_also"), F.aggregate(also, F.lit(0).cast("long"), lambda a, x: a + x).alias("also_sum"))


@query("""WITH r AS (SELECT * FROM (VALUES ('1'), ('FRANCE'), ('nothing'), ('ASIA'), ('3')) AS v(ref)), e AS (SELECT n_nationkey::VARCHAR AS id, lower(n_name) AS name FROM nation)
 SELECT r.ref, coalesce((SELECT id FROM e WHERE id = r.ref), (SELECT min(id) FROM e WHERE name = lower(r.ref) HAVING count(*) = 1)) AS id FROM r""")
def ref_resolution_cascade(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("domain"), F.col("n_name").alias("name"), F.lit("site").alias("kind"))
    return search.resolve(spark.createDataFrame([(x,) for x in ("1", "FRANCE", "nothing", "ASIA", "3")], "ref string"), e).select("ref", "id")


# Tagging ------------------------------------------------------------------------------------------------------------

_ALIASES = [("metal", "steel", False, False), ("metal", "brass", False, False), ("plate", "steel plate", False, False), ("widget", "widget", False, False), ("bolt", "bolt", True, False), ("gear", "gear", False, False), ("gear", "red gear", False, True)]


@query("""WITH t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS s FROM part), m AS (SELECT id, s, regexp_matches(s, '\\bsteel plate\\b') AS plate, regexp_matches(s, '\\bbrass\\b') OR regexp_matches(replace(s, 'steel plate', ''), '\\bsteel\\b') AS metal, regexp_matches(s, '\\bwidget\\b') AS widget, regexp_matches(replace(s, 'red gear', ''), '\\bgear\\b') AS gear FROM t)
 SELECT id, unnest(list_filter([CASE WHEN plate THEN 'plate' END, CASE WHEN metal THEN 'metal' END, CASE WHEN widget THEN 'widget' END, CASE WHEN gear THEN 'gear' END, CASE WHEN regexp_matches(s, '\\bbolt\\b') AND NOT (plate OR metal OR widget OR gear) THEN 'bolt' END], lambda x: x IS NOT NULL)) AS element FROM m""")
def tag_part_elements(spark, d):
    return tagging.elements(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), spark.createDataFrame(_ALIASES, tagging.SCHEMA))


@query("""WITH w AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM part),
 e AS (SELECT id, CASE WHEN list_contains(ws, 'small') THEN 'size' END AS a, ws FROM w) SELECT id, [coalesce(a, CASE WHEN list_contains(ws, 'red') OR list_contains(ws, 'blue') THEN 'colour' END, 'other')] AS categories FROM e""")
def categorize_labels_text_default(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.ascii_tokens(F.col("p_name")).alias("labels"), F.col("p_name").alias("text"))
    return tagging.categorize(p, spark.createDataFrame([("small", "size")], "label string, category string"), spark.createDataFrame([("red", "colour"), ("blue", "colour")], "word string, category string"), "other")


# Catalog ------------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_nationkey AS key, 1 AS rank, c_custkey AS pos, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS descr, 1 AS mentions FROM customer UNION ALL SELECT s_nationkey, 0, s_suppkey, s_name, '', 2 FROM supplier)
 SELECT key, arg_min(name, rank * 10000000 + pos) AS name, arg_min(descr, rank * 10000000 + pos) FILTER (descr <> '') AS "desc", max(mentions) AS mentions, count(*) AS n_sources FROM s GROUP BY key""")
def merge_upsert_sources(spark, d):
    none = F.array().cast("array<string>")
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.lit(1).alias("rank"), F.col("c_custkey").alias("pos"), F.lit("").alias("url"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("desc"), F.lit(1).alias("mentions"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.lit(0).alias("rank"), F.col("s_suppkey").alias("pos"), F.lit("").alias("url"), F.col("s_name").alias("name"), F.lit("").alias("desc"), F.lit(2).alias("mentions"))
    return catalog.merge_upsert(c.union(s).withColumns({"categories": none, "labels": none})).select("key", "name", "desc", "mentions", "n_sources")


@query("SELECT c_custkey, coalesce(CASE WHEN s_acctbal > 5000 THEN s_acctbal END, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def override_coalesce(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")).alias("c_acctbal"))
    return catalog.override(table(spark, d, "customer").select("c_custkey", "c_acctbal"), p, "c_custkey", ["c_acctbal"])


@query("SELECT c_custkey FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 10 = 0) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def blocklist_anti(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("url"), F.col("c_nationkey").cast("string").alias("domain"))
    by_url = c.where("c_custkey % 10 = 0").select(F.lit("url").alias("scope"), "url", F.lit(None).cast("string").alias("domain"))
    by_domain = table(spark, d, "nation").where("n_regionkey = 0").select(F.lit("domain").alias("scope"), F.lit(None).cast("string").alias("url"), F.col("n_nationkey").cast("string").alias("domain"))
    return catalog.blocked(c, by_url.union(by_domain)).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal WHEN c_custkey % 3 = 0 THEN -1.0 END AS v, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS checked FROM customer")
def probe_coalesce_join(spark, d):
    c = table(spark, d, "customer")
    return catalog.cached(c.select("c_custkey"), c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("v")), c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(-1.0).alias("v")), "c_custkey", "v")


@query("SELECT p_partkey, CASE WHEN i = 1 THEN b ELSE b || '-' || i END AS id FROM (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS b, row_number() OVER (PARTITION BY replace(lower(p_name), ' ', '-') ORDER BY p_partkey) AS i FROM part)")
def unique_id_suffix(spark, d):
    return catalog.unique_ids(table(spark, d, "part"), text.slug(F.col("p_name")), [F.col("p_partkey")]).select("p_partkey", "id")


@query("""WITH s AS (SELECT p_partkey, p_name || CASE WHEN count(*) OVER (PARTITION BY p_name) = 1 THEN '' ELSE ' (' || p_brand || ')' END AS shown FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY shown ORDER BY p_partkey) AS i FROM s)
 SELECT p_partkey, CASE WHEN i = 1 THEN shown ELSE shown || ' ' || i END AS display FROM r""")
def name_disambiguation(spark, d):
    return catalog.disambiguate(table(spark, d, "part"), "p_name", "p_brand", [F.col("p_partkey")]).select("p_partkey", "display")


@query("SELECT c_nationkey, count(*) AS n FROM (SELECT c_nationkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS hit FROM customer) GROUP BY c_nationkey HAVING count(*) = count(*) FILTER (hit)")
def domain_whole_test(spark, d):
    f = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return catalog.whole_groups(table(spark, d, "customer").join(f, "c_custkey", "left"), "c_nationkey", F.coalesce("hit", F.lit(False)))


# Items and sets -----------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS demo, coalesce((SELECT min(n_nationkey) FROM nation WHERE lower(n_name) = lower(c_mktsegment)), n.n_nationkey) AS item FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey AND n_regionkey < 3""")
def demo_attach_left_join(spark, d):
    i = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("slug"))
    return items.attach(table(spark, d, "customer").select(F.col("c_custkey").alias("demo"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("slug")), i).select("demo", "item")


@query("WITH u AS (SELECT l_orderkey AS k, 0 AS adapter, l_linenumber AS pos FROM lineitem UNION ALL SELECT o_orderkey, 1, 0 FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY adapter, pos) AS i FROM u) SELECT k, adapter FROM r WHERE i = 1")
def union_precedence_whole(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"))
    return items.union_first([a, table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("pos"))], "k", [F.col("pos")]).select("k", "adapter")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_left_anti(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT unnest([l_returnflag, l_linestatus]) AS label, count(*) AS n FROM lineitem GROUP BY 1")
def multi_label_explode_counts(spark, d):
    return table(spark, d, "lineitem").select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey")
def pivot_bucket_counts(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return p.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("""WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), q AS (SELECT unnest([0.5, 0.9])::DOUBLE AS q)
 SELECT o_orderpriority, q, v AS value FROM r, q WHERE r = floor((n - 1) * q + 0.5)""")
def nearest_rank_percentiles(spark, d):
    return quality.nearest_rank(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.5, 0.9])


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE r % greatest(1, n // 25) = 0")
def systematic_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1).alias("r"), F.count("*").over(Window.partitionBy("o_orderpriority")).alias("n"))
    return o.where(F.col("r") % F.greatest(F.lit(1), F.floor(F.col("n") / 25)) == 0).select("o_orderkey", "o_orderpriority")


# Windows, verdicts, evaluation --------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, event_id AS "at", count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING) AS weight FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, "at") AS i FROM s)
 SELECT user_id, "at", weight FROM r WHERE i = 1""")
def sliding_window_max(spark, d):
    return sections.best_window(table(spark, d, "events").select("user_id", F.col("event_id").alias("at"), F.lit(1).alias("w")), "user_id", "at", "w", 1000)


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM events")
def carry_forward_last(spark, d):
    e = table(spark, d, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return sections.carry(e, "user_id", "event_id", "last_purchase").select("event_id", "last_purchase")


@query("SELECT event_id, CASE WHEN event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL THEN 'code' WHEN event_type = 'error' THEN 'gated' END AS verdict FROM events")
def json_props_access_verdict(spark, d):
    status = F.when(F.col("event_type") == "error", 403).otherwise(200)
    return table(spark, d, "events").select("event_id", quality.json_access(status, F.col("props"), "k").alias("verdict"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id, CASE WHEN event_type = 'signup' THEN 'new' WHEN ts < now - INTERVAL 10 DAY THEN 'stale' WHEN user_id % 7 <> 0 THEN 'hints-changed' END AS reason FROM events, m""")
def stale_queue_reason(spark, d):
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return e.select("event_id", catalog.queue_reason(F.col("event_type") != "signup", F.col("ts"), now, 10, F.lit("0"), (F.col("user_id") % 7).cast("string")).alias("reason"))


_RULES = [("", True, "/"), ("", False, "/fr"), ("", True, "/fr/1"), ("", False, "/*/2$"), ("", False, "/de***/3")]


@query(rf"""WITH {_U}, x AS (SELECT DISTINCT p FROM k), r AS (SELECT * FROM (VALUES (true, '/', '^/'), (false, '/fr', '^/fr'), (true, '/fr/1', '^/fr/1'), (false, '/*/2$', '^/.*/2$'), (false, '/de***/3', '^/de.*/3')) AS v(allow, rule, rx)),
 m AS (SELECT p, allow, row_number() OVER (PARTITION BY p ORDER BY length(rule) DESC, allow DESC) AS i FROM x JOIN r ON regexp_matches(p, rx)) SELECT x.p AS path, coalesce(allow, true) AS allowed FROM x LEFT JOIN m ON m.p = x.p AND i = 1""")
def longest_prefix_rule(spark, d):
    probes = table(spark, d, "pages").select(F.lit("").alias("host"), urls.path(F.col("url")).alias("path")).distinct()
    return quality.robots(probes, spark.createDataFrame(_RULES, "host string, allow boolean, rule string")).select("path", "allowed")


@query("""WITH h AS (SELECT source AS q, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), g AS (SELECT source AS q, doc_id AS id, max(quality) AS grade FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
 d AS (SELECT h.q, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade IS NULL) AS unjudged FROM h LEFT JOIN g ON g.q = h.q AND g.id = h.id WHERE rank <= 5 GROUP BY h.q),
 i AS (SELECT q, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, id) AS r FROM g) WHERE r <= 5 GROUP BY q),
 f AS (SELECT g.q, min(rank) AS first FROM g LEFT JOIN h ON g.q = h.q AND g.id = h.id AND grade = 1 WHERE grade = 1 GROUP BY g.q)
 SELECT i.q, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg, unjudged, (first <= 5)::INT AS recall, round(1 / first, 6) AS rr FROM i JOIN d USING (q) JOIN f USING (q)""")
def labels_recall_mrr_ndcg(spark, d):
    docs = table(spark, d, "documents")
    hits = docs.select(F.col("source").alias("q"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    grades = docs.join(table(spark, d, "labels"), "doc_id").groupBy(F.col("source").alias("q"), F.col("doc_id").alias("id")).agg(F.max("quality").alias("grade"))
    r = quality.recall_mrr(hits, grades.where("grade = 1").select("q", "id"))
    return quality.ndcg(hits, grades).join(r, "q").select("q", F.round("ndcg", 6).alias("ndcg"), "unjudged", "recall", F.round("rr", 6).alias("rr"))


@query(r"""WITH w0 AS (SELECT conv_id AS doc, turn AS n, unnest(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS raw FROM conversations), p AS (SELECT doc, n, raw, """ + _PL.format("raw") + r""" AS p FROM w0), w AS (SELECT doc, n, CASE WHEN length(raw) < 4 OR regexp_matches(raw, '[0-9]') THEN raw WHEN length(p) > 6 AND p LIKE '%ation' THEN regexp_replace(p, 'ation$', '') WHEN length(p) > 5 AND p LIKE '%ing' THEN regexp_replace(p, 'ing$', '') WHEN length(p) > 5 AND p LIKE '%ed' THEN regexp_replace(p, 'ed$', '') ELSE p END AS term FROM p), z AS (SELECT doc, n, count(*) AS len FROM w GROUP BY ALL), a AS (SELECT doc, avg(len) AS av, count(*) AS nn FROM z GROUP BY doc),
 f AS (SELECT doc, n, term, count(*) AS tf FROM w WHERE term IN ('the', 'of') GROUP BY ALL), g AS (SELECT doc, term, count(*) AS df FROM f GROUP BY ALL)
 SELECT f.doc, f.n, count(*) AS hits, round(sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) * CASE WHEN count(*) = 2 THEN 1.25 ELSE 1 END, 5) AS score FROM f JOIN g USING (doc, term) JOIN z USING (doc, n) JOIN a USING (doc) GROUP BY f.doc, f.n""")
def conversation_section_ranking(spark, d):
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), F.lower("text").alias("text"))
    return sections.rank(s, ["the", "of"]).select("doc", "n", "hits", F.round("score", 5).alias("score"))


@query()
def section_split_counts(spark, d):
    s = sections.split(texts(spark, d).select(F.col("doc_id").alias("doc"), "text"))
    return s.groupBy("doc").agg(F.count("*").alias("sections"), F.max(F.col("end") - F.col("start")).alias("longest"))


@query("""WITH c AS (SELECT conv_id AS doc, turn AS part, length(text) AS size, row_number() OVER w AS r, sum(length(text)) OVER w - length(text) AS before, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY length(text), turn)),
 l AS (SELECT *, max((600 - before)::DOUBLE / (n - r + 1)) OVER (PARTITION BY doc) AS level FROM c) SELECT doc, part, size, CASE WHEN total <= 600 THEN size ELSE floor(greatest(0, least(size, level))) END::INT AS given FROM l""")
def budget_split(spark, d):
    return sections.share_budget(table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("part"), F.length("text").alias("size")), 600)


# Reports and selections ---------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS i FROM c) SELECT o_custkey, v AS o_orderpriority FROM r WHERE i = 1")
def most_common_value(spark, d):
    return reports.mode(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("WITH a AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS now, b.v AS before FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def build_diff(spark, d):
    l = table(spark, d, "lineitem")
    count = lambda x: x.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("v"))
    return reports.diff(count(l), count(l.where("l_returnflag <> 'R'")), "k", "v")


@query("SELECT o_orderpriority, batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 40 AS batch FROM orders) GROUP BY ALL")
def batches_of_ids(spark, d):
    b = reports.batches(table(spark, d, "orders"), ["o_orderpriority"], [F.col("o_orderkey")], 40)
    return b.groupBy("o_orderpriority", F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("WITH s AS (SELECT p_brand, p_type, p_partkey, (row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) > 1)::INT AS s FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s, p_partkey) AS i FROM s) SELECT p_brand, p_partkey FROM r WHERE i <= 5")
def shape_diverse_sample(spark, d):
    return reports.diverse(table(spark, d, "part"), ["p_brand"], "p_type", [F.col("p_partkey")], 5).select("p_brand", "p_partkey")


@query("SELECT doc_id, substring(text, 101, 50) AS part, CASE WHEN length(text) > 150 THEN 150 END AS next_offset FROM documents WHERE text IS NOT NULL")
def source_window(spark, d):
    w = table(spark, d, "documents").where("text is not null").select("doc_id", reports.window_of(F.col("text"), 100, 50).alias("w"))
    return w.select("doc_id", "w.part", "w.next_offset")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 1500 THEN text WHEN strlen(substring(text, 1, 500)) <= 1500 THEN substring(text, 1, 500) ELSE substring(text, 1, 100) END AS shown FROM documents WHERE text IS NOT NULL")
def tiered_shrink(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", reports.smallest_tier([t, F.substring(t, 1, 500), F.substring(t, 1, 100)], 1500).alias("shown"))


@query("""WITH d AS (SELECT conv_id, turn, min(length(text)) AS size FROM conversations GROUP BY ALL), p AS (SELECT *, 800 - coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM d)
 SELECT conv_id, turn, least(size, room)::BIGINT AS given FROM p WHERE room >= 100""")
def example_packing(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.length("text")).alias("size"))
    return reports.greedy_pack(c, "conv_id", "turn", "size", 800, 100).select("conv_id", "turn", F.col("given").cast("long").alias("given"))


@query("SELECT source AS kind, count(*) AS n, ceil(count(*) / 20)::BIGINT AS batches, (sum(ceil(n_chars / 4)) + ceil(count(*) / 20) * 5000)::BIGINT AS tokens FROM documents GROUP BY source")
def queue_cost(spark, d):
    q = table(spark, d, "documents").select(F.col("source").alias("kind"), F.ceil(F.col("n_chars") / 4).alias("tokens"))
    return reports.queue_cost(q, 20, 5000)


@query("SELECT event_type, user_id % 5 AS grp, count(*) AS n, floor(count(*) * 1000 / 37 + 0.5)::BIGINT AS estimate FROM events WHERE event_type = 'error' GROUP BY ALL")
def barrier_extrapolation(spark, d):
    f = table(spark, d, "events").where("event_type = 'error'").groupBy("event_type", (F.col("user_id") % 5).alias("grp")).agg(F.count("*").alias("n"))
    return reports.extrapolate(f, "grp", F.lit(37), F.lit(1000))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) SELECT event_type, count(*) AS users, round(sum(value), 4) AS total FROM r WHERE i = 1 GROUP BY event_type")
def usage_last_wins(spark, d):
    return reports.last_by(table(spark, d, "events"), "user_id", "event_id").groupBy("event_type").agg(F.count("*").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH n AS (SELECT s_suppkey, ltrim(regexp_replace(s_name, '[^0-9]', '', 'g'), '0') AS k FROM supplier), o AS (SELECT ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') AS k, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(*) = 1) SELECT s_suppkey, c_custkey FROM n JOIN o USING (k)""")
def loose_name_match(spark, d):
    k = lambda c: F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^0+", "").alias("k")
    return items.loose_match(table(spark, d, "supplier").select("s_suppkey", k("s_name")), table(spark, d, "customer").select(k("c_name"), "c_custkey"), "k").select("s_suppkey", "c_custkey")


@query("""WITH c AS (SELECT s_suppkey AS id, unnest([s_nationkey + 7, s_nationkey + 3, s_nationkey]) AS key, generate_subscripts([1, 2, 3], 1) AS pos FROM supplier), f AS (SELECT id, arg_min(key, pos) AS found FROM c WHERE key IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1) GROUP BY id)
 SELECT s_suppkey AS id, found FROM supplier LEFT JOIN f ON s_suppkey = id""")
def twin_lookup(spark, d):
    k = F.col("s_nationkey")
    known = table(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("key"))
    return items.first_candidate(table(spark, d, "supplier").withColumn("id", F.col("s_suppkey")), known, F.array(k + 7, k + 3, k)).select("id", F.col("found").cast("int").alias("found"))


@query("""WITH e AS (SELECT user_id AS listing, event_id // 500 AS page, event_type AS link FROM events), f AS (SELECT listing, link, min(page) AS page FROM e GROUP BY ALL), n AS (SELECT listing, page, count(*) AS new FROM f GROUP BY ALL),
 p AS (SELECT DISTINCT listing, page FROM e), x AS (SELECT p.listing, p.page, coalesce(new, 0) AS new FROM p LEFT JOIN n ON n.listing = p.listing AND n.page = p.page), s AS (SELECT listing, min(page) AS stop FROM x WHERE new = 0 GROUP BY listing)
 SELECT x.listing, x.page, new FROM x LEFT JOIN s USING (listing) WHERE stop IS NULL OR x.page < stop""")
def listing_stop_rule(spark, d):
    return items.listing_stop(table(spark, d, "events").select(F.col("user_id").alias("listing"), F.floor(F.col("event_id") / 500).alias("page"), F.col("event_type").alias("link")))


@query("SELECT code, count(*) AS n FROM (SELECT DISTINCT user_id, event_type AS code FROM events WHERE event_type <> 'view') GROUP BY code")
def barrier_ranking(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("site")).agg(F.collect_set("event_type").alias("codes"))
    return reports.barriers(s, ["view"])


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'gated' WHEN event_type = 'view' THEN 'empty' WHEN event_type = 'signup' THEN 'dead' ELSE 'ok' END AS state FROM events")
def registry_states(spark, d):
    t = F.col("event_type")
    status = F.when(t == "error", 403).when(t == "signup", 404).otherwise(200)
    return table(spark, d, "events").select("event_id", quality.registry_state(status, F.when(t == "view", 0).otherwise(1), F.lit(True), F.lit(False)).alias("state"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'retry' WHEN event_type = 'signup' THEN 'miss' WHEN user_id % 2 = 0 THEN 'miss' ELSE 'pass' END AS verdict FROM events")
def soft_404_verdicts(spark, d):
    t, u = F.col("event_type"), F.lit("https://a.com/x")
    return table(spark, d, "events").select("event_id", quality.soft_404(F.when(t == "error", 503).when(t == "signup", 404).otherwise(200), u, u, F.when(F.col("user_id") % 2 == 0, 200).otherwise(404), F.lit("t")).alias("verdict"))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT BETWEEN 0 AND 90 THEN [] ELSE ['/k: is out of range'] END AS problems FROM events")
def json_schema_problems(spark, d):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 90}}}
    return validation.validate(table(spark, d, "events"), "event_id", "props", schema, closed=True)


@query("SELECT event_id AS doc_id FROM events WHERE NOT (json_extract_string(props, '$.k')::INT BETWEEN 0 AND 90)")
def json_schema_failures(spark, d):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 90}}}
    return validation.validate(table(spark, d, "events"), "event_id", "props", schema).where(F.size("problems") > 0).select(F.col("event_id").alias("doc_id"))


@query("""WITH e AS (SELECT n_name AS name, n_regionkey, 25 - n_nationkey AS mentions FROM nation), r AS (SELECT n_regionkey, string_agg('- [' || name || '](https://' || name || ')', chr(10) ORDER BY mentions DESC, name) AS t, count(*) AS n FROM e GROUP BY 1)
 SELECT r_regionkey AS category, '## ' || r_name || ' · ' || n || chr(10) || t AS text FROM region JOIN r ON r_regionkey = n_regionkey""")
def router_markdown(spark, d):
    e = table(spark, d, "nation").select(F.array("n_regionkey").alias("categories"), F.col("n_name").alias("name"), F.concat(F.lit("https://"), "n_name").alias("url"), F.lit("").alias("desc"), (25 - F.col("n_nationkey")).alias("mentions"))
    return reports.router(e, table(spark, d, "region").select(F.col("r_regionkey").alias("category"), F.col("r_regionkey").alias("place"), F.col("r_name").alias("label")))


# Names, pages, templates, phrases ---------------------------------------------------------------------------------------

_AL = "element string, name string, is_alias boolean, pos int"


@query("SELECT c_custkey AS id, 'Item ' || c_custkey || ' (Acme)' AS name FROM customer")
def display_names(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("acme.dev").alias("name"), F.lit("page").alias("kind"), F.concat(F.lit("https://acme.dev/p/item-"), F.col("c_custkey").cast("string")).alias("url"), F.lit("acme.dev").alias("domain"), F.concat("c_mktsegment", F.lit(" | Acme")).alias("title"))
    return catalog.name_pages(c).select("id", "name")


@query("SELECT event_id AS id, [CASE WHEN event_type = 'view' THEN 'page view' ELSE event_type END, 'tool ' || user_id] AS keywords FROM events")
def keywords_normalised(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.array(F.concat("event_type", F.lit("s")), F.upper("event_type"), F.concat(F.lit("(Tool_"), F.col("user_id").cast("string"), F.lit(")"))).alias("keywords"))
    return catalog.normalise_keywords(e, catalog.keyword_spellings(spark.createDataFrame([("View", "page view", 0, 0)], "alias string, canonical string, rank int, pos int")))


@query("""WITH c AS (SELECT 'https://h' || user_id % 20 || '.com' AS home, ['docs', 'components', 'pricing', 'about', 'blog'][event_id % 5 + 1] AS bucket, CASE WHEN event_id % 2 = 0 THEN '' ELSE '/' || event_id % 7 END AS tail, [3, 2, 0][event_id % 3 + 1] AS bonus FROM events),
 b AS (SELECT home, bucket, home || '/' || bucket || tail AS url, max(bonus - 2 * (CASE WHEN tail = '' THEN 1 ELSE 2 END) - length('/' || bucket || tail) / 100) AS score FROM c WHERE bucket <> 'blog' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY home, bucket ORDER BY score DESC, url) AS k FROM b),
 p AS (SELECT home, url, bucket, row_number() OVER (PARTITION BY home ORDER BY CASE WHEN k = 1 THEN list_position(['docs', 'components', 'pricing', 'about', 'license'], bucket) ELSE 6 END, score DESC, url) AS place FROM r WHERE k = 1 OR bucket IN ('docs', 'components')) SELECT * FROM p WHERE place <= 6""")
def extra_pages(spark, d):
    home = F.concat(F.lit("https://h"), (F.col("user_id") % 20).cast("string"), F.lit(".com"))
    part = F.element_at(F.array(*[F.lit(x) for x in ("docs", "components", "pricing", "about", "blog")]), (F.col("event_id") % 5 + 1).cast("int"))
    tail = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("event_id") % 7).cast("string")))
    source = F.element_at(F.array(*[F.lit(x) for x in ("llms", "nav", "sitemap")]), (F.col("event_id") % 3 + 1).cast("int"))
    return pages.choose(table(spark, d, "events").select(home.alias("home"), F.concat(home, F.lit("/"), part, tail).alias("url"), source.alias("source")), 6)


@query("SELECT page_id, 0 AS pos, 'section' || page_id AS anchor, url AS text FROM pages")
def page_anchors(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("<div id=top><section id='section"), F.col("page_id").cast("string"), F.lit("'><div><h2>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</h2></div></section></div>")).alias("html"))
    return pages.anchors(p)


@query()
def content_outlines(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return pages.outline(sections.split(docs), docs, 400, 120)


@query("""WITH u AS (SELECT DISTINCT ['components', 'blog', 'x'][p_size % 3 + 1] AS dir, CASE WHEN p_partkey % 2 = 0 THEN 'button-' ELSE '' END || 'k' || p_partkey AS name FROM part), g AS (SELECT dir, count(*) AS n, count(*) FILTER (name LIKE 'button-%') AS t FROM u GROUP BY dir)
 SELECT 'p.com' AS domain, '/' || dir || '/{name}' AS template, n AS children, floor(100 * t / n + 0.5)::INT AS element_pct, dir = 'components' OR (dir = 'x' AND floor(100 * t / n + 0.5) >= 30) AS high, CASE WHEN dir = 'blog' THEN 'meta' WHEN dir = 'components' THEN 'component prefix' WHEN floor(100 * t / n + 0.5) >= 30 THEN 'elements' ELSE 'neither' END AS why FROM g WHERE n >= 10""")
def template_mining_modes(spark, d):
    path = F.concat(F.element_at(F.array(F.lit("components"), F.lit("blog"), F.lit("x")), F.col("p_size") % 3 + 1), F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, "button-").otherwise(""), F.lit("k"), F.col("p_partkey").cast("string"))
    slugs = items.element_slugs(spark.createDataFrame([("button", "button", False, 0)], _AL))
    return items.suggest_templates(table(spark, d, "part").select(F.lit("p.com").alias("domain"), F.concat(F.lit("https://www.p.com/"), path).alias("url")), slugs, spark.createDataFrame(tagging.ALIASES, tagging.SCHEMA))


@query("""WITH i AS (SELECT o_custkey AS parent, o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 'code' WHEN 'O' THEN 'page' ELSE 'gated' END AS access, o_orderpriority AS e FROM orders),
 c AS (SELECT parent, count(*) FILTER (access = 'code') AS code, count(*) FILTER (access = 'gated') AS gated, count(*) FILTER (access = 'page' AND pos % 2 = 0) AS gallery_examples, count(*) FILTER (access = 'page' AND pos % 2 = 1) AS docs_pages, greatest(count(*) // 3, 1) AS step FROM i GROUP BY parent),
 e AS (SELECT parent, e || ' ' || count(*) AS t, row_number() OVER (PARTITION BY parent ORDER BY count(*) DESC, min(pos), e) AS r FROM i GROUP BY parent, e), l AS (SELECT parent, list(t ORDER BY r) AS item_elements FROM e WHERE r <= 2 GROUP BY parent),
 n AS (SELECT parent, pos, row_number() OVER (PARTITION BY parent ORDER BY pos) - 1 AS k FROM i), s AS (SELECT parent, list('o' || pos ORDER BY k) AS sample_items FROM n JOIN c USING (parent) WHERE k % step = 0 AND k < step * 3 GROUP BY parent)
 SELECT parent, code, gated, gallery_examples, docs_pages, item_elements, sample_items FROM c JOIN l USING (parent) JOIN s USING (parent)""")
def registry_fact_sheet(spark, d):
    o = table(spark, d, "orders")
    access = F.when(F.col("o_orderstatus") == "F", "code").when(F.col("o_orderstatus") == "O", "page").otherwise("gated")
    i = o.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), access.alias("access"), F.when(F.col("o_orderkey") % 2 == 0, "example").otherwise("page").alias("granularity"), F.array("o_orderpriority").alias("elements"))
    return items.registry_facts(i, 2, 3)


@query(_SQL["conversation_section_ranking"])
def headed_section_ranking(spark, d):
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), F.col("role").alias("title"), F.array().cast("array<string>").alias("path"), F.lower("text").alias("text"))
    return sections.rank_headed(s, [[{"words": ["the"]}], [{"words": ["of"]}]]).select("doc", "n", "hits", F.round("score", 5).alias("score"))


@query("""WITH e AS (SELECT DISTINCT event_type AS q FROM events), a AS (SELECT q, unnest(CASE q WHEN 'click' THEN [{'alt': 0, 'term': 'el:click', 'is_tag': true, 'weight': 1.0}, {'alt': 0, 'term': 'click', 'is_tag': false, 'weight': 1.0}]
 WHEN 'purchase' THEN [{'alt': 0, 'term': 'purchase', 'is_tag': false, 'weight': 1.0}, {'alt': 1, 'term': 'order', 'is_tag': false, 'weight': 0.7}] WHEN 'signup' THEN [{'alt': 0, 'term': 'signup', 'is_tag': false, 'weight': 1.0}, {'alt': 1, 'term': 'sinup', 'is_tag': false, 'weight': 0.6}]
 ELSE [{'alt': 0, 'term': q, 'is_tag': false, 'weight': 1.0}] END) AS x FROM e) SELECT q, 0 AS concept, x.alt::INT AS alt, x.term AS term, x.is_tag AS is_tag, x.weight::DOUBLE AS weight, false AS gated FROM a""")
def query_concepts(spark, d):
    known = phrases.Vocabulary(elements={"click": ["click"]}, synonyms={"buying": ["purchase", "order"]})
    return phrases.analyse(table(spark, d, "events").select(F.col("event_type").alias("q")).distinct(), known, spark.createDataFrame([("sinup",), ("view",), ("error",)], "term string"))


@query(rf"""WITH {_U}, m AS (SELECT site, page_id, norm, regexp_extract(p, '^/([^/]+)/(\d+)/?$', 1) AS a, regexp_extract(p, '^/([^/]+)/(\d+)/?$', 2) AS n FROM k WHERE regexp_matches(p, '^/([^/]+)/(\d+)/?$')), g AS (SELECT site, a, n, arg_min(norm, page_id) AS url FROM m GROUP BY ALL)
 SELECT site || '/' || a || '-' || n AS id, site AS parent, upper(a[1]) || a[2:] || ' ' || n AS name, url, 'page' AS access FROM g""")
def sitemap_page_items(spark, d):
    p = table(spark, d, "pages").select(urls.site(F.col("url")).alias("domain"), F.col("page_id").alias("pos"), "url")
    sites = p.select("domain").distinct()
    one = sitemaps.patterns(spark, [{"domain": "", "match": "/{*}/{n}"}]).drop("domain")
    row = one.first()  # one pattern, which every site has
    compiled = sites.select("domain", *[F.lit(row[c]).cast(one.schema[c].dataType).alias(c) for c in one.columns])
    made, _ = sitemaps.adapt(p, compiled, sites.select("domain", F.col("domain").alias("parent")), spark.createDataFrame([], "id string, parent string, url string, source string"), items.element_slugs(spark.createDataFrame([], _AL)), spark.createDataFrame(tagging.ALIASES, tagging.SCHEMA))
    return made.select("id", "parent", "name", "url", "access")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarry import catalog_queries

    return _QUERIES | catalog_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from quarry import catalog_queries

    return _SQL | catalog_queries.SQL
