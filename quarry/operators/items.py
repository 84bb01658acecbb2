"""From entries and landed files to items: parents, demos, adapters in order of precedence, template mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.functions.text import slug
from quarry.operators import sizes, tagging

#: Path segments of languages, of pages that are no items, of listings and of components.
LOCALE = r"(?i)^(cn|zh|zh-cn|zh-hans|zh-hant|zh-tw|ja|jp|ko|kr|fr|de|es|pt|pt-br|ru|it|id|tr|vi|th|pl|nl|ar|hi|uk|he|sv|da|fi|no|nb|cs|hu|ro|el|bg|fa|ms|[a-z]{2}-[a-z]{2})$"
SKIPPED = r"(?i)^(blog|posts?|news|changelog|releases?|careers|jobs|legal|privacy|terms|pricing|about|contact|press|showcase|customers|stories|compare|vs|alternatives|glossary|api|reference|llms|guides?|tutorials?|articles|help|support|faq|getting-started|installation|introduction|migration|cli|mcp|theming|themes?)$"
LISTING = r"(?i)^(tags?|categories|category|cat|collections?|topics?)$"
COMPONENT = r"(?i)^(components?|blocks?|ui|sections?|elements|primitives|effects|animations?|backgrounds|text-animations|widgets|patterns|charts|buttons|cards|inputs|layouts?|navigation|overlays?|feedback|forms?|data-display)$"


def first_per(rows: DataFrame, by: str | list[str], order: list[Column]) -> DataFrame:
    by = [by] if isinstance(by, str) else by
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def union_first(sources: list[DataFrame], by: str, order: list[Column]) -> DataFrame:
    """Rows of all adapters; of equal keys the earlier adapter's stays, and in one adapter the first."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("adapter", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return first_per(out, by, [F.col("adapter"), *order])


def attach(demos: DataFrame, items: DataFrame) -> DataFrame:
    """demos (demo, name, slug) with the item (id, name, slug) of the same lower-case name, else of the same slug."""
    by_name = items.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("by_name"))
    by_slug = items.groupBy(F.col("slug").alias("s")).agg(F.min("id").alias("by_slug"))
    return demos.join(by_name, F.lower("name") == F.col("k"), "left").join(by_slug, F.col("slug") == F.col("s"), "left").withColumn("item", F.coalesce("by_name", "by_slug")).drop("k", "s", "by_name", "by_slug")


def loose_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key, where a key that several right rows share matches none."""
    one = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != key]).where("_n = 1").drop("_n")
    return left.join(one, key)


def first_candidate(rows: DataFrame, known: DataFrame, candidates: Column) -> DataFrame:
    """Each row (id) with the first of its candidate keys that is known."""
    each = rows.select("id", F.posexplode(candidates).alias("pos", "key")).join(known.select("key").distinct(), "key")
    return rows.join(each.groupBy("id").agg(F.min_by("key", "pos").alias("found")), "id", "left")


def mine_templates(pages: DataFrame, least: int = 10) -> DataFrame:
    """Directories of (domain, url) with many children: (domain, dir, n, names, verdict)."""
    seg = urls.segments(F.col("url"))
    rows = pages.select("domain", seg.alias("s")).where(F.size("s") >= 2)
    rows = rows.select("domain", F.concat(F.lit("/"), F.array_join(F.slice("s", F.lit(1), F.size("s") - 1), "/"), F.lit("/{name}")).alias("dir"), F.element_at("s", -1).alias("name"))
    g = rows.groupBy("domain", "dir").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))
    return g.withColumn("verdict", F.when((F.col("n") >= least) & (F.col("names") * 2 >= F.col("n")), "HIGH").otherwise("low"))


def element_slugs(names: DataFrame) -> DataFrame:
    """(slug, element) for names (element, name, is_alias, pos): ids win over aliases, earlier elements over later."""
    rows = names.select(slug(F.col("name")).alias("slug"), "element", F.struct("is_alias", "pos").alias("o")).where("slug <> ''")
    return rows.groupBy("slug").agg(F.min_by("element", "o").alias("element"))


def suggest_templates(pages: DataFrame, slugs: DataFrame, aliases: DataFrame, least: int = 10) -> DataFrame:
    """Path templates that the pages (domain, url) of a site suggest: (domain, template, children, element_pct, high, why).

    Three readings of a path: dir/{name}; dir/{name}/{n}, where a number ends it; dir/{name}/{*}, where the middle segment is
    an element. The vocabulary (slugs, aliases) is bounded and broadcast; a directory's distinct names are tagged once.
    """
    p = pages.select("domain", "url", urls.segments(F.col("url")).alias("s")).where((urls.site(F.col("url")) == F.regexp_replace("domain", r"^www\.", "")) & (F.size("s") > 0))
    last, n = F.element_at("s", -1), F.size("s")
    p = p.where((slug(last) != "") & ~last.rlike(r"(?i)\.[a-z0-9]{2,4}$"))
    digits, mid = last.rlike(r"^\d+$"), F.when(n >= 3, F.try_element_at("s", F.lit(-2)))
    head = lambda k: F.array_join(F.slice("s", F.lit(1), F.greatest(n - k, F.lit(0))), "/")
    read = F.array(F.when(~digits, F.struct(F.lit("A").alias("mode"), head(1).alias("dir"), last.alias("name"))), F.when(mid.isNotNull(), F.struct(F.when(digits, "N").otherwise("S").alias("mode"), head(2).alias("dir"), mid.alias("name"))))
    each = p.distinct().select("domain", "url", F.explode(F.array_compact(read)).alias("r")).select("domain", "url", "r.*")
    names = each.groupBy("domain", "mode", "dir", "name").agg(F.count("*").alias("n")).withColumn("slug", slug(F.col("name")))
    names = names.join(sizes.small(slugs), "slug", "left").where("mode <> 'S' or element is not null")
    said = names.select(F.col("name").alias("id"), F.col("name").alias("text")).distinct()
    tagged = tagging.elements(said, aliases).select(F.col("id").alias("name"), F.lit(True).alias("tagged")).distinct()
    names = names.join(tagged, "name", "left")
    g = names.groupBy("domain", "mode", "dir").agg(F.sum("n").alias("children"), F.count("*").alias("names"), F.count_if("tagged").alias("tags"), F.bool_and(F.col("element").isNotNull()).alias("all"))
    slot = F.when(F.col("mode") == "A", "{name}").otherwise(F.concat(F.when(F.col("all"), "{element}").otherwise("{name}"), F.when(F.col("mode") == "N", "/{n}").otherwise("/{*}")))
    literal = F.filter(F.split("dir", "/"), lambda x: x != "")
    g = g.withColumn("template", F.concat(F.lit("/"), "dir", F.when(F.col("dir") != "", "/").otherwise(""), slot)).withColumn("tail", F.try_element_at(literal, F.lit(-1))).withColumn("slug", slug(F.col("tail")))
    g = g.join(sizes.small(slugs.select("slug", F.col("element").alias("is_element"))), "slug", "left")
    like = F.coalesce(F.col("tail").rlike(COMPONENT), F.lit(False)) | F.col("is_element").isNotNull()
    small, pct = F.col("children") < least, F.col("element_pct")
    g = g.withColumn("element_pct", F.floor(100 * F.col("tags") / F.col("names") + 0.5).cast("int")).withColumn("like", like).where(~small | ((F.col("children") >= 3) & like))
    why = (
        F.when(F.exists(literal, lambda x: x.rlike(LOCALE) | x.rlike(SKIPPED)), "meta").when(F.col("tail").isNull(), "no prefix").when(F.col("tail").rlike(LISTING), "listing")
        .when(small & (pct < 60), "few children").when(F.col("like"), "component prefix").when(pct >= 30, "elements").otherwise("neither")
    )
    return g.select("domain", "template", "children", "element_pct", why.isin("component prefix", "elements").alias("high"), why.alias("why"))


def registry_facts(items: DataFrame, k: int = 12, sample: int = 15) -> DataFrame:
    """Per parent of items (parent, pos, name, access, granularity, elements): counts by bucket, the k commonest elements with
    their counts, and every so-manieth name. Counts are partial before the shuffle; only k and `sample` rows a parent are gathered."""
    page = F.col("access") == "page"
    kind = F.when(page & (F.col("granularity") == "example"), "gallery_examples").when(page, "docs_pages").when(F.col("access") == "gated", "gated").otherwise("code")
    counts = items.groupBy("parent").agg(*[F.count_if(kind == b).alias(b) for b in ("code", "gated", "gallery_examples", "docs_pages")])
    els = items.select("parent", "pos", F.explode("elements").alias("e")).groupBy("parent", "e").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    els = els.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("n"), "pos", "e"))).where(F.col("r") <= k)
    listed = els.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "e", F.col("n").cast("string")).alias("t")))), lambda x: x["t"]).alias("item_elements"))
    size = items.groupBy("parent").agg(F.greatest(F.floor(F.count("*") / sample), F.lit(1)).alias("step"))
    place = items.select("parent", "name", (F.row_number().over(Window.partitionBy("parent").orderBy("pos")) - 1).alias("i")).join(size, "parent")
    some = place.where((F.col("i") % F.col("step") == 0) & (F.col("i") < F.col("step") * sample)).groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("sample_items"))
    return counts.join(listed, "parent", "left").join(some, "parent", "left")


def prefixes(pages: DataFrame, k: int = 8) -> DataFrame:
    """The k commonest first segments of paths and how many pages lie elsewhere ("more")."""
    p = pages.select(F.coalesce(F.get(urls.segments(F.col("url")), F.lit(0)), F.lit("")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    first = p.orderBy(F.desc("n"), "prefix").limit(k)
    rest = p.join(first.select("prefix"), "prefix", "left_anti").agg(F.sum("n").alias("n")).where("n is not null")
    return first.union(rest.select(F.lit("more").alias("prefix"), "n")).groupBy("prefix").agg(F.sum("n").alias("n"))


def access(status: Column, gate: Column, body_ok: Column) -> Column:
    """code for a valid answer, gated for a refusal or a gated registry, else null."""
    return F.when(gate, "gated").when((status == 200) & body_ok, "code").when(status.isin(401, 402, 403), "gated")


def listing_stop(links: DataFrame) -> DataFrame:
    """Pages (listing, page, link) up to the last one before the first that adds no new link."""
    first = links.groupBy("listing", "link").agg(F.min("page").alias("page"))
    new = first.groupBy("listing", "page").agg(F.count("*").alias("new"))
    pages = links.select("listing", "page").distinct().join(new, ["listing", "page"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    dead = pages.where("new = 0").groupBy("listing").agg(F.min("page").alias("stop"))
    return pages.join(dead, "listing", "left").where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).select("listing", "page", "new")
