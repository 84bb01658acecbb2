"""Ranking: concepts with alternatives, coverage, priors, boosts; and the shapes that answers take."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import compact, stem, tokens
from quarry.operators.index import FIELDS, K1

#: concept: one unit of a query; alt: one way to say it; a word counts only if all of its alt occur.
CONCEPTS = "q string, concept int, alt int, term string, is_tag boolean, weight double, gated boolean"


def analyse(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Concepts of queries (q). synonyms: (term, alt_terms array<string>), the terms stemmed.

    Each word of a query is a concept; its synonyms are alternatives of weight 0.7.
    """
    words = queries.select("q", F.posexplode(F.transform(F.array_distinct(tokens(F.col("q"))), stem)).alias("concept", "term"))
    typed = words.select("q", "concept", F.lit(0).alias("alt"), "term", F.lit(1.0).alias("weight"))
    other = words.join(synonyms, "term").select("q", "concept", F.posexplode("alt_terms").alias("k", "to")).select("q", "concept", (F.col("k") + 1).alias("alt"), F.explode(F.split("to", " ")).alias("term"), F.lit(0.7).alias("weight"))
    return typed.unionByName(other).select("q", "concept", "alt", "term", F.lit(False).alias("is_tag"), "weight", F.lit(False).alias("gated"))


def fuzzy(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words (of 5 letters or more) that the vocabulary lacks, with the terms one edit away.

    Terms of a length that no such word comes near are left out first; then both sides are expanded to their forms with at most
    one letter deleted and met on these, so there is no cross join.
    """
    forms = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    unknown = words.where(F.length("word") >= 5).join(vocabulary, words.word == vocabulary.term, "left_anti")
    a = unknown.select("word", F.explode(forms(F.col("word"))).alias("form"))
    near = unknown.select(F.explode(F.array(*[F.length("word") + k for k in (-1, 0, 1)])).alias("size")).distinct()
    some = vocabulary.where(F.length("term") >= 4).withColumn("size", F.length("term")).join(near, "size", "left_semi")
    b = some.select("term", F.explode(forms(F.col("term"))).alias("form"))
    return a.join(b, "form").where(F.levenshtein("word", "term", 1) >= 0).select("word", "term").distinct()


def score(postings: DataFrame, idf: DataFrame, concepts: DataFrame, prior: Column | None = None) -> DataFrame:
    """Rows (q, doc, score, hits, mask) from the postings and idf of the concepts' terms at least; others are left aside by the join.

    The idf scale of an alternative is at most that of the words typed; plain words weigh 0.7 beside a tag concept.
    """
    terms = concepts.join(idf, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    typed = terms.where("alt = 0").groupBy("q", "concept").agg(F.sum("idf").alias("typed"))
    alts = terms.groupBy("q", "concept", "alt").agg(F.sum("idf").alias("alt_idf"), F.sum((~F.col("is_tag")).cast("int")).alias("n_words"))
    scale = F.when((F.col("alt") == 0) | (F.col("alt_idf") == 0), 1.0).otherwise(F.least(F.lit(1.0), F.col("typed") / F.col("alt_idf")))
    full = terms.join(alts, ["q", "concept", "alt"]).join(typed, ["q", "concept"], "left").withColumn("scale", scale)
    mixed = concepts.groupBy("q").agg(F.max(F.col("is_tag").cast("int")).alias("mixed"), F.countDistinct("concept").alias("n"))
    hit = postings.join(full, "term")
    tf = F.col("tf100") / 100
    s = F.col("idf") * tf * (K1 + 1) / (tf + K1)
    by_alt = hit.groupBy("q", "concept", "alt", "doc").agg(
        F.sum(F.when(F.col("is_tag"), s).otherwise(0.0)).alias("tag"), F.sum(F.when(~F.col("is_tag"), s * F.col("scale")).otherwise(0.0)).alias("word"),
        F.sum((~F.col("is_tag")).cast("int")).alias("got"), F.max("n_words").alias("n_words"), F.max("weight").alias("weight"), F.max(F.col("gated").cast("int")).alias("gated"), F.max("is_tag").alias("tagged"), F.bit_or("mask").alias("mask"),
    )
    words = F.when((F.col("got") == F.col("n_words")) & ((F.col("gated") == 0) | (F.col("tag") > 0)), F.col("word")).otherwise(0.0)
    by_alt = by_alt.withColumn("s", (F.col("tag") + words) * F.col("weight")).where("s > 0")
    best = by_alt.groupBy("q", "concept", "doc").agg(F.max(F.struct("s", (-F.col("alt")).alias("alt"), "mask", "tagged")).alias("b"))
    best = best.join(F.broadcast(mixed), "q").withColumn("s", F.col("b.s") * F.when((F.col("mixed") == 1) & ~F.col("b.tagged"), 0.7).otherwise(1.0))
    doc = best.groupBy("q", "doc").agg(F.sum("s").alias("s"), F.count("*").alias("hits"), F.max("n").alias("n"), F.bit_or("b.mask").alias("mask"))
    c = F.col("hits") / F.col("n")
    total = F.col("s") * (0.35 + 0.65 * c * c) * F.when((F.col("hits") == F.col("n")) & (F.col("n") > 1), 1.25).otherwise(1.0)
    return doc.select("q", "doc", (total * (prior if prior is not None else F.lit(1.0))).alias("score"), "hits", "mask")


def prior(kind: Column, access: Column, local: Column, auto: Column, mapped: Column, readable: Column, record: Column) -> Column:
    """What a result is worth before the query. The factors."""
    item = F.when(access == "code", 1.06).when(access == "gated", 0.94).otherwise(1.0) * F.when(local, 1.04).otherwise(1.0) * F.when(auto, 0.92).otherwise(1.0)
    entry = F.when(mapped, 1.08).when(~readable, F.when(record, 0.95).otherwise(0.85)).when(readable | (kind == "repo"), 1.08).otherwise(1.0)
    return F.when(kind == "item", item).otherwise(entry)


def matched_field(mask: Column) -> Column:
    """The first field of the mask; listed counts as element."""
    names = F.array(*[F.lit("element" if f == "listed" else f) for f in FIELDS])
    low = F.log2(mask.bitwiseAND(-mask)).cast("int")
    return F.element_at(names, low + 1)


#: Words that a name may carry or drop, and what announces a name that something had before.
GENERIC = ["ui", "icons", "icon", "library", "components", "component", "css", "illustrations", "palette", "kit", "app", "website", "site"]
FORMER = r"\b(?:formerly(?: known as)?|previously(?: known as)?|successor to|renamed from)\s+([A-Z][\w.\-/]*(?:\s+[A-Z][\w.\-/]*){0,2})"


def name_keys(entries: DataFrame) -> DataFrame:
    """(key, doc, former): what entries (doc, name, and where they are known domain, kind, url, desc, about) are called, without spaces and
    marks: name, domain with and without its ending, a repo's name, and names they had. Pages have none: they are about things."""
    e = entries.select("doc", "name", *[(F.col(c) if c in entries.columns else F.lit(None)).cast("string").alias(c) for c in ("domain", "kind", "url", "desc", "about")])
    e = e.where(~F.col("kind").eqNullSafe("page"))
    site = F.regexp_replace(F.coalesce("domain", F.lit("")), r"^www\.", "")
    own = F.when((site != "") & (site != "github.com"), site)
    repo = F.when(F.col("kind") == "repo", F.regexp_extract("url", r"github\.com/[^/]+/([^/#?]+)", 1))
    now = F.array_compact(F.array(compact(F.col("name")), compact(own), compact(F.regexp_replace(own, r"\.[a-z]+$", "")), compact(repo)))
    then = F.transform(F.regexp_extract_all(F.concat_ws(" ", F.coalesce("desc", F.lit("")), F.coalesce("about", F.lit(""))), F.lit(FORMER), F.lit(1)), compact)
    each = e.select("doc", F.explode(now).alias("key"), F.lit(False).alias("former")).union(e.select("doc", F.explode(then), F.lit(True)))
    return each.where(F.length("key") >= 3).distinct()


def navigational(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(q, doc): entries that a query (q) names: as a whole, with "ui" after a single word, or without a generic last word; by a former name
    only as a whole. A query of six letters or more that names none may be one letter off. One of generic words alone names nothing."""
    words = tokens(F.regexp_replace(F.regexp_replace("q", "^https?://", ""), r"^www\.", ""))
    r = queries.select("q").distinct().withColumn("w", words).where((F.size("w") > 0) & (F.size(F.array_except("w", F.array(*[F.lit(g) for g in GENERIC]))) > 0))
    whole = F.array_join("w", "")
    ended = F.when((F.size("w") > 1) & F.element_at("w", -1).isin(GENERIC), F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), ""))
    r = r.withColumn("whole", whole).withColumn("keys", F.array_compact(F.array(whole, F.when(F.size("w") == 1, F.concat(whole, F.lit("ui"))), ended)))
    known = name_keys(entries)
    now = r.select("q", F.explode("keys").alias("key")).join(known.where("not former"), "key").select("q", "doc")
    then = r.join(known.where("former"), F.col("whole") == F.col("key")).select("q", "doc")
    found = now.union(then).distinct()
    # Names one letter off meet on their forms with a letter left out.
    lost = r.where(F.length("whole") >= 6).join(found, "q", "left_anti").select(F.col("whole").alias("word"), "q")
    near = fuzzy(lost.select("word").distinct(), known.where((F.length("key") >= 6) & ~F.col("former")).select(F.col("key").alias("term")).distinct())
    typos = lost.join(near, "word").join(known.where("not former"), F.col("term") == F.col("key")).select("q", "doc")
    return found.union(typos).distinct()


def boost(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits (q, doc, score) in which an entry that the query names stands just above the top."""
    top = hits.groupBy("q").agg(F.max("score").alias("top"))
    named = navigational(hits.select("q"), entries).join(top, "q").withColumnRenamed("top", "_top")
    out = hits.join(named, ["q", "doc"], "full").withColumn("score", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce(F.col("_top") * 1.01, F.lit(0.0))))
    return out.drop("_top")


def answer_group(kind: Column, access: Column, granularity: Column) -> Column:
    """The part of an answer that a hit stands in: res, code, gallery or docs."""
    return F.when(kind != "item", "res").when(access != "page", "code").when(granularity == "example", "gallery").otherwise("docs")


def answer_caps(limit: int) -> dict[str, int]:
    """How many strong hits of a group an answer of so many shows before the rest goes by rank."""
    half, third = max(2, -(-limit // 2)), max(1, math.ceil(limit * 0.3))
    return {"res": half, "code": half, "gallery": third, "docs": third}


def passes(kind=None, category=None, element=None, variant=None, access=None, stack=None, registry=None) -> Column:
    """The conjunction of the filters given; variant, access and stack exclude entries."""
    out = F.lit(True)
    if kind:
        out &= F.col("kind") == kind
    for name, value in (("categories", category), ("elements", element), ("stacks", stack)):
        if value:
            out &= F.array_contains(name, value)
    if variant:
        out &= F.exists(F.map_values("variants"), lambda v: F.array_contains(v, variant))
    if access:
        out &= F.col("access") == access
    if registry:
        out &= (F.col("parent") == registry) | (F.col("domain") == registry)
    return out


def top(hits: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """The ranks offset + 1 .. offset + k of each query, score first, then document."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return hits.withColumn("rank", rank).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def collapse(rows: DataFrame, by: list[str], order: list[Column], ids: str) -> DataFrame:
    """The best row of each key, with the other ids in ``also`` in order."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    also = ranked.where("_r > 1").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(ids).alias("i")))), lambda x: x["i"]).alias("also"))
    return ranked.where("_r = 1").drop("_r").join(also, by, "left")


def capped_fill(hits: DataFrame, limit: int, caps: dict[str, int], default: int) -> DataFrame:
    """limit rows of (grp, doc, score): each group's strong leader, then strong rows within the group's cap, then the rest; shown by rank.

    Strong is half of the best score or more. A group's first rows are ranked within the group, and none beyond its first ``limit`` can be shown.
    """
    order = [F.desc("score"), F.col("doc")]
    r = hits.withColumn("in_group", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("in_group") <= limit)
    r = r.withColumn("strong", F.col("score") >= hits.agg(F.max("score")).scalar() / 2)
    cap = F.lit(default)
    for g, n in caps.items():
        cap = F.when(F.col("grp") == g, n).otherwise(cap)
    p = F.when(F.col("strong") & (F.col("in_group") == 1), 0).when(F.col("strong") & (F.col("in_group") <= cap), 1).otherwise(2)
    return r.withColumn("priority", p).orderBy("priority", *order).limit(limit).select("grp", "doc", "score", "priority")


def facets(items: DataFrame, element: str) -> DataFrame:
    """Counts of an element's items by access and granularity, and in how many registries."""
    of = items.where(F.array_contains("elements", element))
    return of.groupBy("access", "granularity").agg(F.count("*").alias("n"), F.countDistinct("parent").alias("registries"))


def reference(c: Column) -> Column:
    """A reference as keys are compared: lower case, https, no slash at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^http://", "https://"), "/+$", "")


def resolve(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """Each ref's entry by the first way that names one: id, url, url without its scheme, then without www, owner/repo, a name that only one
    entry has, a domain that only one has, the one root site of a domain. (ref, id, how, candidates); entries: id, url, name, domain, kind."""
    asked = refs.select("ref", reference(F.col("ref")).alias("key")).where("key <> ''")
    url = reference(F.col("url"))
    repo = F.when(F.col("key").rlike(r"^[\w.-]+/[\w.-]+$"), F.concat(F.lit("https://github.com/"), F.col("key")))
    ways = [
        ("id", F.col("key"), F.col("id"), False), ("url", F.col("key"), url, False), ("https", F.concat(F.lit("https://"), "key"), url, False), ("www", F.concat(F.lit("https://www."), "key"), url, False),
        ("repo", repo, url, False), ("name", F.col("key"), F.lower("name"), True), ("domain", F.col("key"), F.lower("domain"), True), ("root", F.col("key"), F.when(F.col("kind") == "site", F.lower("domain")), True),
    ]
    found = None
    for k, (how, key, of, alone) in enumerate(ways):
        one = entries.select(of.alias("ref_key"), "id").where("ref_key is not null").groupBy("ref_key").agg(F.max("id").alias("id"), F.count("*").alias("n"))
        met = asked.join(one, key == F.col("ref_key")).select("ref", F.when((F.col("n") == 1) | F.lit(not alone), F.struct(F.lit(k).alias("k"), F.lit(how).alias("how"), "id")).alias("b"), "n")
        found = met if found is None else found.unionByName(met)
    best = found.groupBy("ref").agg(F.min("b").alias("b"), F.max("n").alias("candidates"))
    return refs.join(best, "ref", "left").select("ref", "b.id", "b.how", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def concepts_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CONCEPTS)
