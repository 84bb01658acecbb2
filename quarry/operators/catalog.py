"""From sources to entries: merge-upsert, ids, names, overrides, blocklist, caches, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import names, urls
from quarry.operators.sizes import small


def merge_upsert(rows: DataFrame) -> DataFrame:
    """One entry per key. rows: key, rank, pos, url, name, desc, categories, labels, mentions, source_id.

    The first source wins url and name, the first that isn't empty the description; categories and
    labels are joined in order (five labels at most); mentions is the maximum. Aggregates only: partial before the shuffle.
    """
    order = F.struct("rank", "pos")
    joined = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", F.col(c).alias("v")))), lambda x: x["v"])))
    return rows.groupBy("key").agg(
        F.min_by("url", order).alias("url"), F.min_by("name", order).alias("name"), F.min_by("desc", F.when(F.col("desc") != "", order)).alias("desc"),
        joined("categories").alias("categories"), F.slice(joined("labels"), 1, 5).alias("labels"), F.max("mentions").alias("mentions"), F.count("*").alias("n_sources"),
    )


def loose_keys(rows: DataFrame) -> DataFrame:
    """rows (url, loose, rank, pos) with the key they merge under: strict rows their own; a loose row a strict row of the same key, else the first strict row of its page, else the first loose row of the page."""
    k = rows.withColumn("strict_key", urls.key(F.col("url"))).withColumn("page", urls.page_key(F.col("url")))
    strict = k.where("not loose").groupBy("strict_key").agg(F.lit(True).alias("known"))
    by_page = k.groupBy("page").agg(F.min(F.when(~F.col("loose"), F.struct("rank", "pos", "strict_key"))).alias("s"), F.min(F.when(F.col("loose"), F.struct("rank", "pos", "strict_key"))).alias("l"))
    out = k.join(strict, "strict_key", "left").join(by_page, "page")
    return out.withColumn("key", F.when(~F.col("loose") | F.col("known"), F.col("strict_key")).otherwise(F.coalesce("s.strict_key", "l.strict_key"))).drop("s", "l", "known")


def unique_ids(rows: DataFrame, base: Column, order: list[Column]) -> DataFrame:
    """id: base, the second and later rows with -2, -3, ..."""
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*order))
    return rows.withColumn("_base", base).withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))).drop("_base", "_n")


def disambiguate(rows: DataFrame, name: str, group: str, order: list[Column]) -> DataFrame:
    """display: a name that occurs once stays; others get their group in brackets, and a number where that repeats too."""
    shown = F.when(F.count("*").over(Window.partitionBy(name)) == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col(group).cast("string"), F.lit(")")))
    n = F.row_number().over(Window.partitionBy("_shown").orderBy(*order))
    return rows.withColumn("_shown", shown).withColumn("_n", n).withColumn("display", F.when(F.col("_n") == 1, F.col("_shown")).otherwise(F.concat("_shown", F.lit(" "), F.col("_n").cast("string")))).drop("_shown", "_n")


def override(rows: DataFrame, patches: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Patched columns win where they aren't null."""
    p = patches.select(on, *[F.col(c).alias(f"_p_{c}") for c in columns])
    return rows.join(p, on, "left").withColumns({c: F.coalesce(f"_p_{c}", c) for c in columns}).drop(*[f"_p_{c}" for c in columns])


def blocked(rows: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Rows (url, domain) that no entry (scope, url, domain) of the blocklist names."""
    return rows.join(blocklist.where("scope = 'url'").select("url").distinct(), "url", "left_anti").join(blocklist.where("scope <> 'url'").select("domain").distinct(), "domain", "left_anti")


def cached(rows: DataFrame, new: DataFrame, old: DataFrame, on: str, value: str) -> DataFrame:
    """The newer cache's value, else the older one's; checked tells a known null from an unknown."""
    a, b = new.select(on, F.col(value).alias("_new"), F.lit(True).alias("_hn")), old.select(on, F.col(value).alias("_old"), F.lit(True).alias("_ho"))
    return rows.join(a, on, "left").join(b, on, "left").withColumn(value, F.when(F.col("_hn"), F.col("_new")).otherwise(F.col("_old"))).withColumn("checked", F.coalesce("_hn", "_ho", F.lit(False))).drop("_new", "_old", "_hn", "_ho")


def whole_groups(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """Groups all of whose rows are hit."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).where("n = hits").select(group, "n")


def queue_reason(has: Column, at: Column, now: Column, days: int, hash_now: Column, hash_then: Column) -> Column:
    """Why a record must be made again, or null."""
    return F.when(~has, "new").when(at < now - F.expr(f"INTERVAL {days} DAYS"), "stale").when(hash_now != hash_then, "hints-changed")


def merge_records(entries: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Fields present in a record replace the entry's; empty or unknown ones delete it. records: id, present array, columns."""
    r = records.select("id", F.col("present").alias("_present"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    new = {c: F.when(F.array_contains("_present", c), F.when(F.lower(f"_r_{c}").isin("", "unknown"), None).otherwise(F.col(f"_r_{c}"))).otherwise(F.col(c)) for c in columns}
    return entries.join(r, "id", "left").withColumns(new).drop("_present", *[f"_r_{c}" for c in columns])


def name_pages(rows: DataFrame) -> DataFrame:
    """rows (id, name, kind, url, domain, title) with display names; pages of one domain that would share a name go by their path."""
    named = rows.withColumn("name", names.display_name(*[F.col(c) for c in ("name", "kind", "url", "domain", "title")]))
    page = F.col("kind") == "page"
    shared = named.where(page).groupBy("domain", "name").agg(F.count("*").alias("_n")).where("_n > 1").select("domain", "name", F.lit(True).alias("_twice"))
    owner = F.nullif(F.regexp_extract("name", r"\(([^)]+)\)$", 1), F.lit(""))
    by_path = names.path_name(F.col("url"), F.coalesce(owner, "domain"))
    out = named.join(shared, ["domain", "name"], "left")
    return out.withColumn("name", F.when(page & F.col("_twice"), F.coalesce(by_path, "name")).otherwise(F.col("name"))).select(*rows.columns)


def keyword_spellings(said: DataFrame) -> DataFrame:
    """(spelling, canonical) for said (alias, canonical, rank, pos): of equal spellings the first by rank and place counts."""
    return said.select(names.spelling(F.col("alias")).alias("spelling"), "canonical", F.struct("rank", "pos").alias("o")).where("spelling <> ''").groupBy("spelling").agg(F.min_by("canonical", "o").alias("canonical"))


def normalise_keywords(rows: DataFrame, spellings: DataFrame) -> DataFrame:
    """(id, keywords): each cleaned and in its canonical spelling, the first of equal ones; ids without keywords are left out."""
    forms = rows.select("id", F.posexplode("keywords").alias("pos", "k")).select("id", "pos", names.nfkc_native(F.coalesce("k", F.lit(""))).alias("k"))
    each = forms.select("id", "pos", names.keyword_of_form(F.col("k")).alias("clean"))
    each = each.withColumn("spelling", F.regexp_replace("clean", r"[^\p{L}\p{N}]+", "")).join(small(spellings), "spelling", "left")
    # Keywords of an id in their order, the first of equal ones: one shuffle. Empty ones go here; a filter above would clean all of them twice.
    found = F.sort_array(F.collect_list(F.when(F.col("clean") != "", F.struct("pos", F.coalesce("canonical", "clean").alias("k")))))
    return each.groupBy("id").agg(F.array_distinct(F.transform(found, lambda x: x["k"])).alias("keywords")).where(F.size("keywords") > 0)
