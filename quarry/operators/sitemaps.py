"""Pages of sitemaps to items: templates, identity, attaching to known items, filter pages, names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.functions.text import humanise, slug
from quarry.operators import catalog, tagging
from quarry.operators.sizes import small

_SLOT = re.compile(r"\{(name|author|element|n|\*)\}")


def compile_template(template: str) -> dict:
    """A path template as a regular expression with five groups (unused ones match nothing), and where a page's identity and name
    come from: a positive number is a capture, a negative one a whole path segment, both counted from 1."""
    regex, caps = [], []
    for k, seg in enumerate(template.strip("/").split("/")):
        at, made = 0, ""
        for m in _SLOT.finditer(seg):
            made += re.escape(seg[at : m.start()]) + (r"(\d+)" if m[1] == "n" else "([^/]+)")
            caps.append((m[1], k))
            at = m.end()
        regex.append(made + re.escape(seg[at:]))
    if len(caps) > 5:
        raise ValueError(f"more than five captures: {template}")
    where = lambda kind: next(((i, k) for i, (x, k) in enumerate(caps) if x == kind), None)
    own = next((found[1] for kind in ("name", "element", "*") if (found := where(kind))), len(regex) - 1)
    author = where("author")
    lead = [author[0] + 1] if author and author[1] != own else []
    rest = [i + 1 for i, (kind, k) in enumerate(caps) if k != own and kind not in ("name", "author")]
    inner = [i + 1 for i, (kind, k) in enumerate(caps) if k == own and kind in ("name", "element", "n")]
    after = [i + 1 for i, (kind, k) in enumerate(caps) if k > own and kind in ("*", "n")]
    element = where("element")
    return {
        "regex": "^/?" + "/".join(regex) + "/?$" + "()" * (5 - len(caps)), "id_from": [*lead, -(own + 1), *rest], "name_from": [*lead, *(inner or [-(own + 1)]), *after],
        "group_from": [i + 1 for i, (kind, k) in enumerate(caps) if k < own and kind in ("*", "n")], "base": own + 1, "element_from": element[0] + 1 if element else 0,
    }


def patterns(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """One row a template of the configs {domain, match, exclude, element, access, granularity, attach_only, loose_ids, skip}; a config is a file written by hand, so the table is bounded."""
    rows = []
    for c in configs:
        if not c.get("skip"):
            excluded = "|".join(f"(?:{compile_template(x)['regex']})" for x in c.get("exclude", []))
            for pos, t in enumerate([c["match"]] if isinstance(c["match"], str) else c["match"]):
                t = compile_template(t)
                rows.append((c["domain"], pos, t["regex"], t["id_from"], t["name_from"], t["group_from"], t["base"], t["element_from"], excluded, c.get("element"), c.get("access", "page"), c.get("granularity", "page"), bool(c.get("attach_only")), bool(c.get("loose_ids"))))
    return spark.createDataFrame(rows, "domain string, template int, regex string, id_from array<int>, name_from array<int>, group_from array<int>, base int, element_from int, excluded string, fixed string, access string, granularity string, attach_only boolean, loose_ids boolean")


def matched(pages: DataFrame, compiled: DataFrame, parents: DataFrame) -> DataFrame:
    """Pages (domain, pos, url) that a template of their domain fits, the first template and the first page of equal keys counting,
    with id, name, base and captures. parents (domain, parent)."""
    p = pages.select("domain", "pos", urls.normalize(F.col("url")).alias("url")).where("url is not null").withColumn("key", urls.key(F.col("url")))
    p = p.groupBy("domain", "key").agg(F.min(F.struct("pos", "url")).alias("f")).select("domain", "key", "f.pos", "f.url").withColumn("path", urls.path(F.col("url")))
    fits = p.join(compiled, "domain").where(F.expr("regexp_like(path, regex) and not (excluded <> '' and regexp_like(path, excluded))"))
    first = fits.groupBy("domain", "key").agg(F.min_by(F.struct(*[c for c in fits.columns if c not in ("domain", "key")]), "template").alias("f")).select("domain", "key", "f.*")
    caps = F.array(*[F.expr(f"regexp_extract(path, regex, {i})") for i in range(1, 6)])
    part = lambda froms: F.array_join(F.transform(froms, lambda i: F.when(i > 0, F.get("caps", i - 1)).otherwise(F.get("segs", -i - 1))), "-")
    m = first.withColumn("caps", caps).withColumn("segs", urls.segments(F.col("url"))).join(parents, "domain")
    m = m.withColumn("base_text", F.get("segs", F.col("base") - 1)).withColumn("core", part(F.col("name_from"))).withColumn("grouping", part(F.col("group_from")))
    m = m.withColumn("local", slug(part(F.col("id_from")))).withColumn("id", F.concat("parent", F.lit("/"), "local"))
    return m.withColumn("captured", F.when(F.col("element_from") > 0, slug(F.get("caps", F.col("element_from") - 1)))).drop("caps", "segs", "id_from", "name_from", "group_from", "base", "element_from", "regex", "excluded")


def adapt(pages: DataFrame, compiled: DataFrame, parents: DataFrame, taken: DataFrame, slugs: DataFrame, aliases: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, attached) of sitemap pages. taken (id, parent, url, source): what other adapters made. slugs and aliases: the vocabulary.
    members (key, element): links of filter pages.

    A page whose id a registry item without URL has gives it its URL; with loose_ids also one whose letters and digits are equal, unless
    two items share them. A page with a taken id or URL makes nothing, nor does any page under attach_only. Of pages with one id the first
    makes the item. Elements: the template's, the captured, those of filter pages, else those the path segment tags to.
    attached: (id, url). Joins are on domains, ids and keys; only the vocabulary, which is bounded, is broadcast.
    """
    m = matched(pages, compiled, parents)
    loose = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    bare = taken.where("source = 'registry' and url is null").select("id", "parent", loose(F.expr("substring(id, length(parent) + 2)")).alias("k"))
    twins = bare.groupBy("parent", "k").agg(F.count("*").alias("n"), F.first("id").alias("twin")).where("n = 1").drop("n")
    known = taken.select("id", F.lit(True).alias("known"), ((F.col("source") == "registry") & F.col("url").isNull()).alias("open")).dropDuplicates(["id"])
    r = m.withColumn("k", loose(F.col("local"))).join(known, "id", "left").join(twins, ["parent", "k"], "left")
    to = F.when(F.col("open"), F.col("id")).when(F.col("loose_ids") & (F.col("known").isNull() | ~F.coalesce("open", F.lit(False))), F.col("twin"))
    r = r.withColumn("to", to)
    attached = r.where("to is not null").groupBy(F.col("to").alias("id")).agg(F.min_by("url", "pos").alias("url"))
    held = taken.where("url is not null").select(urls.key(F.col("url")).alias("key")).union(attached.select(urls.key(F.col("url")))).distinct()
    new = r.where("to is null and known is null and not attach_only").join(held, "key", "left_anti")
    new = new.groupBy("id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "id"]), "pos").alias("f")).select("id", "f.*")

    said = new.select(F.col("base_text").alias("id"), F.col("base_text").alias("text")).distinct()
    tags = tagging.elements(said, aliases).groupBy(F.col("id").alias("base_text")).agg(F.collect_set("element").alias("tagged"))
    new = new.join(small(slugs.select(F.col("slug").alias("captured"), F.col("element").alias("by_capture"))), "captured", "left").join(tags, "base_text", "left")
    if members is not None:
        new = new.join(members.groupBy("key").agg(F.collect_set("element").alias("by_page")), "key", "left")
    else:
        new = new.withColumn("by_page", F.lit(None).cast("array<string>"))
    sure = F.array_union(F.array_compact(F.array("fixed", "by_capture")), F.coalesce("by_page", F.array().cast("array<string>")))
    new = new.withColumn("elements", F.sort_array(F.when(F.size(sure) > 0, F.array_distinct(sure)).otherwise(F.coalesce("tagged", F.array().cast("array<string>")))))
    new = new.withColumn("name", F.concat(humanise(F.col("core")), F.when(F.col("fixed").isNotNull(), F.concat(F.lit(" — "), humanise(F.col("fixed")))).otherwise("")))
    new = new.withColumn("grouping", humanise(F.when(F.col("grouping") != "", F.col("grouping")).otherwise(F.col("local")))).withColumn("_name", F.concat_ws("\x01", "parent", "name"))
    named = catalog.disambiguate(new, "_name", "grouping", [F.col("pos"), F.col("id")])
    return named.select("id", "parent", F.regexp_replace("display", "^[^\x01]*\x01", "").alias("name"), "url", "elements", "access", "granularity", F.lit("sitemap").alias("source")), attached


def member_links(listings: DataFrame, slugs: DataFrame) -> DataFrame:
    """(key, element) from links of filter pages (element, link)."""
    return listings.join(small(slugs), slugs.slug == slug(listings.element), "left").select(urls.key(F.col("link")).alias("key"), F.coalesce(slugs.element, listings.element).alias("element")).where("key is not null").distinct()


def facts(pages: DataFrame, made: DataFrame, attached: DataFrame) -> DataFrame:
    """Per domain: pages read, items made, URLs attached, items without an element."""
    by = lambda df: df.select(urls.site(F.col("url")).alias("domain"), *[c for c in df.columns if c == "elements"])
    read = by(pages).groupBy("domain").agg(F.count("*").alias("pages"))
    some = by(made).groupBy("domain").agg(F.count("*").alias("made"), F.count_if(F.size("elements") == 0).alias("unmapped"))
    return read.join(some, "domain", "left").join(by(attached).groupBy("domain").agg(F.count("*").alias("attached")), "domain", "left").na.fill(0)


