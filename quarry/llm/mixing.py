"""Mixing sources to target weights by cube-method balanced sampling.

A source with target t and s words is taken floor(t / s) times whole; the fraction left is an
inclusion probability of each of its documents. The cube method moves these probabilities through the
null space of the balancing constraints (documents and words) until at most as many stay fractional
as there are constraints. It runs in blocks of a source; what stays fractional in a block (two
documents at most) goes to the next level, until one block a source is left, whose two documents are
landed by the choice that comes nearest to the word total.

Cases: null text has no words, null sources form a source of their own (last), documents without
words are balanced by count only and take nothing, an empty table gives an empty result, and rows
that repeat a doc_id are treated as documents of their own. Blocks and random numbers come from a hash of
each document's id, source and text, rows equal in all three being numbered, so reruns agree however the
rows are laid out. Equal rows are numbered in one task. Documents of equal size are taken in the order of that hash; texts of any length
are counted whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import remove, path_of, stored

WORDS = r"[^\x20\x09-\x0D]+"


def mark() -> Column:
    """A hash of doc_id, source and text that tells nulls apart: rows that have it in common can stand for each other."""
    names = ["doc_id", "source", "text"]
    return F.xxhash64(*names, *[F.isnull(c) for c in names])


def targets(sources: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Rows (source, source_size, target) from (source, source_size).

    Weights repeat in code point order of the sources, null last. Sources share the total size; a
    target stops at cap times its source's size and the excess is shared again by weight among the
    others. The table has a row per source, which is what the one ordered window runs over.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # Sorted by most / weight, the full sources come first; the level holds for the first one that isn't full.
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn("weights", F.sum("weight").over(Window.partitionBy()))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("free", F.col("most") > F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("most") / F.col("weight")).alias("at"), "level"))).over(Window.partitionBy())
    s = s.withColumn("at", level)
    return s.select("source", "source_size", F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least("most", F.col("at.level") * F.col("weight"))).alias("target"))


def flight(p: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase: p moved until fewer entries stay fractional than x (constraints by units) has rows, plus one.

    Each step takes the first len(x) + 1 fractional units, finds a direction in the null space of
    their constraints and goes along it, one way or the other, until a unit reaches 0 or 1, with the
    chances that keep p's expectation.
    """
    p, rng, eps = p.copy(), np.random.default_rng(seed), 1e-9
    p[p < eps], p[p > 1 - eps] = 0, 1
    todo = np.flatnonzero((p > 0) & (p < 1))
    k, held, at = x.shape[0], [], 0
    while True:
        while len(held) <= k and at < len(todo):
            held.append(todo[at])
            at += 1
        if len(held) <= k:
            return p
        i = np.array(held)
        a = x[:, i]
        if k == 2:  # the null space of two rows over three units is their cross product
            u = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
            if not np.abs(u).max() > eps * max(1.0, np.abs(a).max() ** 2):
                u = np.linalg.svd(a)[2][-1]
        else:
            u = np.linalg.svd(a)[2][-1]
        q = p[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        q[q < eps], q[q > 1 - eps] = 0, 1
        p[i] = q
        held = [j for j in held if 0 < p[j] < 1]


def landing(p: np.ndarray, size: np.ndarray, goal: float, exchanges: int = 8) -> np.ndarray:
    """The few fractional units of a source, rounded so that words, then documents, come nearest to their expectation.

    goal: the words to take. A large document among the few leaves an error of up to half its size;
    up to ``exchanges`` other units are then flipped, each time the one that lessens the error most.
    """
    i = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    best = min(range(1 << len(i)), key=lambda m: (abs(sum(size[j] * ((m >> b & 1) - p[j]) for b, j in enumerate(i))), abs(sum((m >> b & 1) - p[j] for b, j in enumerate(i)))))
    for b, j in enumerate(i):
        out[j] = best >> b & 1
    for _ in range(exchanges):
        error = out @ size - goal
        after = np.abs(error + size * (1 - 2 * out))
        j = int(np.argmin(after))
        if not after[j] < abs(error):
            break
        out[j] = 1 - out[j]
    return out


def _block(pdf: pd.DataFrame, final: bool) -> pd.DataFrame:
    # Large documents are settled first, so that those left for the landing are small.
    pdf = pdf.sort_values(["size", "mark", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
    size = pdf["size"].to_numpy(float)
    p = pdf["p"].to_numpy(float)
    goal = float(p @ size)
    p = flight(p, np.vstack([np.ones(len(p)), size]), int(pdf["mark"].iloc[0]) & 0x7FFFFFFF)
    return pdf.assign(p=landing(p, size, goal) if final else p).drop(columns="block")


def mix(docs: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = 4000) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words that the mix takes), copies and mark (its mark())."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), mark().alias("mark"))
    number = F.row_number().over(Window.partitionBy("mark").orderBy("doc_id", "source", "size")).cast("long")
    sized = stored(sized.withColumn("row", number), "mix-sizes")
    known = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap, weights), "mix-targets")
    counts = sized.groupBy("source").agg(F.count("*").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = stored(known.join(counts, known.source.eqNullSafe(counts.source)).select(known.source, "source_size", "target", rate.alias("rate"), "n"), "mix-plan")
    of = plan.select(F.col("source").alias("_s"), F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), "n")
    left = sized.join(of, sized.source.eqNullSafe(of._s)).drop("_s")
    left = left.select("doc_id", "row", "source", "size", "p", "mark", F.ceil(F.col("n") / block).alias("blocks"))
    schema = "doc_id long, row long, source string, size long, p double, mark long, blocks long"
    done = None
    while True:
        blocked = left.withColumn("block", F.pmod(F.xxhash64("mark", "row"), F.col("blocks")))
        final = F.col("blocks") <= 1

        def run(key, pdf):
            return _block(pdf, bool(pdf["blocks"].iloc[0] <= 1))

        moved = stored(blocked.groupBy("source", "block").applyInPandas(run, schema), "mix-level")
        settled = moved.where((F.col("p") == 0) | (F.col("p") == 1))
        done = settled if done is None else done.union(settled)
        rest = moved.where((F.col("p") > 0) & (F.col("p") < 1))
        if not rest.limit(1).count():
            break
        again = rest.groupBy("source").agg(F.count("*").alias("n"))
        left = rest.drop("blocks").join(again.select(F.col("source").alias("_s"), F.ceil(F.col("n") / block).alias("blocks")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").select(*left.columns)
    final = done.select("mark", "row", F.col("p").alias("extra"))
    of = plan.select(F.col("source").alias("_s"), "source_size", "target", F.floor("rate").cast("long").alias("whole"))
    out = sized.join(final, ["mark", "row"]).join(of, sized.source.eqNullSafe(of._s))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "mark")
