"""Verdicts over landed responses, robots rules, percentiles and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_access(status: Column, body: Column, field: str = "name") -> Column:
    """code for 200 with JSON that has a string of that name; gated for 401, 402 and 403; else null."""
    ok = F.get_json_object(body, f"$.{field}").isNotNull() & F.trim(body).startswith("{")
    return F.when((status == 200) & ok, "code").when(status.isin(401, 402, 403), "gated")


def registry_state(status: Column, n_items: Column, is_json: Column, challenged: Column) -> Column:
    return F.when(challenged, "challenge").when(status.isin(401, 402, 403), "gated").when(status.isin(404, 410), "dead").when(status.isNull() | (status != 200), "unreadable").when(~is_json, "unreadable").when(n_items.isNull(), "no-items").when(n_items == 0, "empty").otherwise("ok")


def soft_404(status: Column, final_url: Column, url: Column, probe_status: Column, title: Column) -> Column:
    """pass, miss or retry for a fetched candidate; a site that answers 200 to a made-up page passes nothing by status alone."""
    return F.when(status.isNull() | status.isin(408, 425, 429) | (status >= 500), "retry").when(status != 200, "miss").when(title.rlike(r"(?i)\b(404|not found)\b"), "miss").when((final_url != url) & final_url.rlike("^https?://[^/]+/?$"), "miss").when(probe_status == 200, "miss").otherwise("pass")


def robots_pattern(rule: Column) -> Column:
    """A robots path rule as a regular expression: runs of * are one wildcard, $ at the end anchors."""
    body = F.regexp_replace(F.regexp_replace(rule, r"\*+", "*"), r"\$$", "")
    parts = F.transform(F.split(body, r"\*"), lambda x: F.regexp_replace(x, r"([.\\+?^${}()\[\]|])", r"\\$1"))
    return F.concat(F.lit("^"), F.array_join(parts, ".*"), F.when(rule.endswith("$"), "$").otherwise(""))


def robots(probes: DataFrame, rules: DataFrame) -> DataFrame:
    """probes (host, path) with allowed: the longest rule (host, allow, rule) that matches decides, allow wins ties. Rules are joined by host."""
    r = rules.where("rule <> ''").withColumn("rx", robots_pattern(F.col("rule"))).withColumn("len", F.length("rule"))
    met = probes.join(r, "host").where(F.expr("regexp_like(path, rx)"))
    best = met.groupBy("host", "path").agg(F.max(F.struct("len", "allow")).alias("b"))
    return probes.join(best, ["host", "path"], "left").select("host", "path", F.coalesce("b.allow", F.lit(True)).alias("allowed"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Exact percentiles at rank floor((n - 1) q + 0.5), counted from 0: (by..., q, value).

    Equal values are counted before the shuffle, and the window runs over a group's distinct values.
    """
    c = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("v"))
    r = c.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    each = r.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn("at", F.floor((F.col("n") - 1) * F.col("q") + 0.5))
    return each.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c"))).select(*by, "q", F.col("v").alias("value"))


def recall_mrr(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(q, recall, rr): hits (q, id, rank), expected (q, id); any expected id counts."""
    first = hits.join(expected, ["q", "id"]).groupBy("q").agg(F.min("rank").alias("first"))
    return expected.select("q").distinct().join(first, "q", "left").select("q", (F.coalesce("first", F.lit(1 << 30)) <= k).cast("int").alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def ndcg(hits: DataFrame, grades: DataFrame, k: int = 5) -> DataFrame:
    """(q, ndcg, unjudged): gains 2^grade - 1, discount log2(rank + 1); a hit without a grade scores 0 and is counted."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    got = hits.where(F.col("rank") <= k).join(grades, ["q", "id"], "left")
    dcg = got.groupBy("q").agg(F.sum(gain(F.coalesce("grade", F.lit(0))) / F.log2(F.col("rank") + 1)).alias("dcg"), F.count_if(F.col("grade").isNull()).alias("unjudged"))
    best = grades.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("grade"), "id"))).where(F.col("r") <= k)
    ideal = best.groupBy("q").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("r") + 1)).alias("ideal"))
    return ideal.join(dcg, "q", "left").select("q", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"), F.coalesce("unjudged", F.lit(0)).alias("unjudged"))


def llms_state(answers: DataFrame) -> DataFrame:
    """(id, state) over landed answers (id, status, type, body, challenged, gated) of a site's llms files: ok, gated, challenge or no-llms."""
    text = (F.trim("body") != "") & ~(F.lower("type").contains("html") | F.lower(F.trim("body")).rlike("^<(!doctype html|html)"))
    ok = F.coalesce((F.col("status") == 200) & text, F.lit(False))
    wall = ~ok & (F.col("status") != 200) & F.coalesce("gated", F.lit(False))
    bot = F.coalesce("challenged", F.lit(False)) | ((F.col("status") == 403) & ~F.coalesce("gated", F.lit(False)))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return answers.groupBy("id").agg(F.when(any_(ok), "ok").when(any_(wall), "gated").when(any_(bot), "challenge").otherwise("no-llms").alias("state"))


def reachability(corpus: Column, repo_file: Column, registry: Column, llms: Column, home_status: Column, is_repo: Column) -> Column:
    """How an entry can be read (corpus, repo, registry, llms), else why not: dead, gated, bot-walled, repo-gone or no-endpoint."""
    how = F.when(corpus.isNotNull(), F.concat(F.lit("corpus:"), corpus)).when(repo_file.isNotNull(), F.concat(F.lit("repo:"), repo_file)).when(registry == "ok", "registry").when(llms == "ok", "llms.txt")
    gone = F.coalesce((home_status == 0) | (home_status >= 500), F.lit(True))
    either = lambda s: F.coalesce(registry == s, F.lit(False)) | F.coalesce(llms == s, F.lit(False))
    return F.coalesce(how, F.when(gone, "dead").when(either("gated"), "gated").when(either("challenge"), "bot-walled").when(is_repo, "repo-gone").otherwise("no-endpoint"))


def digest_status(home_blocked: Column, n_pages: Column, thin: Column) -> Column:
    return F.when(home_blocked & (n_pages == 0), "blocked").when(home_blocked | thin, "partial").otherwise("ok")
