"""Reports and selections: samples, batches, shrinking, diffs, histograms, renderers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diverse(rows: DataFrame, by: list[str], shape: str, order: list[Column], k: int) -> DataFrame:
    """k rows a group: the first of each shape, then the others in order."""
    r = F.row_number().over(Window.partitionBy(*by, shape).orderBy(*order))
    first = rows.withColumn("_s", (r > 1).cast("int"))
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_s", *order))).where(F.col("_r") <= k).drop("_s", "_r")


def systematic(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Every floor(n / k)-th row of a group."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("_keep", r % F.greatest(F.lit(1), F.floor(n / k)) == 0).where("_keep").drop("_keep")


def batches(rows: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("int"))


def window_of(c: Column, offset: int, size: int) -> Column:
    """struct(part, next_offset): a piece of a text, and where to go on, null at its end."""
    return F.struct(F.substring(c, offset + 1, size).alias("part"), F.when(F.length(c) > offset + size, F.lit(offset + size)).alias("next_offset"))


def smallest_tier(tiers: list[Column], most: int) -> Column:
    """The first rendering within `most` bytes, else the last."""
    return F.coalesce(*[F.when(F.octet_length(t) <= most, t) for t in tiers], tiers[-1])


def greedy_pack(parts: DataFrame, by: str, order: str, size: str, budget: int, least: int) -> DataFrame:
    """Parts taken in order while room is left, each cut to the room; parts after less than `least` of room are left out."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("room", F.lit(budget) - before).where(F.col("room") >= least).withColumn("given", F.least(F.col(size), F.col("room"))).drop("room")


def mode(rows: DataFrame, by: str, value: str, pos: str) -> DataFrame:
    """The commonest value of each group; the first seen wins ties."""
    c = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(pos).alias("p"))
    return c.groupBy(by).agg(F.max(F.struct("n", (-F.col("p")).alias("p"), F.col(value).alias("v")))["v"].alias(value))


def diff(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value changed, came or went."""
    return now.select(key, F.col(value).alias("now")).join(before.select(key, F.col(value).alias("before")), key, "full").where(~F.col("now").eqNullSafe(F.col("before")))


def last_by(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Of rows with one key, the last."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))).where("_r = 1").drop("_r")


def replace_touched(report: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A report in which the rows of all keys that new has are new's."""
    return report.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def extrapolate(failures: DataFrame, group: str, sampled: Column, missing: Column) -> DataFrame:
    """Counts of failures in a sample, scaled to all that is missing and rounded half up."""
    return failures.withColumn("estimate", F.floor(F.col("n") * missing / sampled + 0.5).cast("long"))


def barriers(sites: DataFrame, benign: list[str]) -> DataFrame:
    """Codes of barriers by how many sites have them, without the benign ones."""
    return sites.select("site", F.explode(F.array_distinct("codes")).alias("code")).where(~F.col("code").isin(benign)).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def queue_cost(entries: DataFrame, per_batch: int, prompt: int) -> DataFrame:
    """(kind, n, batches, tokens) of a queue of (kind, tokens): the digests and one prompt a batch."""
    g = entries.groupBy("kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("digest"))
    return g.select("kind", "n", F.ceil(F.col("n") / per_batch).alias("batches"), (F.col("digest") + F.ceil(F.col("n") / per_batch) * prompt).alias("tokens"))


def untagged_tokens(items: DataFrame, words: Column, k: int = 70) -> DataFrame:
    """The commonest words of items without an element, each item's words once."""
    return items.where(F.size("elements") == 0).select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def router(entries: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, text): a markdown part a category, entries by mentions, then name. categories: (category, place, label)."""
    e = entries.select(F.get("categories", F.lit(0)).alias("category"), "name", "url", "desc", "mentions")
    line = F.concat(F.lit("- ["), F.col("name"), F.lit("]("), F.col("url"), F.lit(")"), F.when(F.coalesce("desc", F.lit("")) != "", F.concat(F.lit(": "), F.col("desc"))).otherwise(""))
    rows = e.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("m"), "name", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return categories.join(rows, "category").orderBy("place").select("category", F.concat(F.lit("## "), F.col("label"), F.lit(" · "), F.size("lines").cast("string"), F.lit("\n"), F.array_join("lines", "\n")).alias("text"))


def flags(e: dict[str, Column]) -> Column:
    """The capabilities that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in e.items()]))


def advice(kind: Column, codes: Column) -> Column:
    """Next actions by rule."""
    rules = {"ask for access": F.array_contains(codes, "gated"), "write a template": F.array_contains(codes, "no-template"), "render pages": F.array_contains(codes, "thin"), "use the registry": kind == "registry"}
    return flags(rules)


def source_type(e: dict[str, Column]) -> Column:
    """The first type whose test holds."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in e.items()], F.lit("other"))


def install_url(base: Column, name: Column, gated: Column, free: Column) -> Column:
    """Where an item is installed from; none for a gated registry unless the item is known to be free."""
    return F.when(gated & ~free, None).otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), name, F.lit(".json")))


def stack_build(names: Column, wanted: str | None, default: str = "ts-tw") -> Column:
    """The build of a component for a stack: the one wanted, else the default, else the first. names: array<struct<stack, name>>."""
    pick = lambda s: F.get(F.filter(names, lambda x: x["stack"] == s), F.lit(0))
    return F.coalesce(*([pick(wanted)] if wanted else []), pick(default), F.get(names, F.lit(0)))


def title_hints(sections: DataFrame, k: int = 15) -> DataFrame:
    """(doc, hints): the commonest first words of three letters or more in the titles of a document's sections, as "word n"."""
    w = sections.select("doc", F.regexp_extract(F.lower("title"), r"([\p{L}\p{N}]{3,})", 1).alias("w")).where("w <> ''").groupBy("doc", "w").agg(F.count("*").alias("n"))
    r = w.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "w"))).where(F.col("r") <= k)
    return r.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "w", F.col("n").cast("string")).alias("t")))), lambda x: x["t"]).alias("hints"))


def coverage(items: DataFrame) -> DataFrame:
    """Per element of items (id, registry, demo, slug, elements): items, demos among them, distinct slugs, registries."""
    each = items.select("registry", "demo", "slug", F.explode("elements").alias("element"))
    return each.groupBy("element").agg(F.count("*").alias("raw"), F.count_if("demo").alias("demos"), F.countDistinct("slug").alias("merged"), F.countDistinct("registry").alias("registries"))


def unreachable(entries: DataFrame) -> DataFrame:
    """(category, reason, n) of unreachable entries (categories, reason); both alone and together, null for all of one."""
    return entries.select(F.explode("categories").alias("category"), "reason").groupingSets([["category", "reason"], ["category"]], "category", "reason").agg(F.count("*").alias("n"))


def taxonomy_prompt(terms: DataFrame) -> DataFrame:
    """(group, text): ids with definitions of terms (group, pos, id, definition), a line each."""
    line = F.concat(F.lit("- "), "id", F.lit(": "), F.coalesce("definition", F.lit("")))
    return terms.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
