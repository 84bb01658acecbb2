"""Toxicity by non-negative positive-unlabelled learning (numpy).

Positives are texts labelled toxic; the unlabelled set is drawn from all texts of the training folds.
With the class prior p, the risk p*E_P[l(f)] + max(0, E_U[l(-f)] - p*E_P[l(-f)]) replaces the
risk over labelled negatives. f is linear in the presence of words; the words are those
whose document shares in the two sets differ most (by ``least_z`` standard errors and a factor of ``lift`` or more, ``features`` words at most). Where the second part falls below zero the step goes
against it, as usual for this estimator.

The classifier is fitted on a bounded sample: ``positives`` and ``unlabelled`` documents with the
smallest hashes of their ids. Every whole text is scored.

Cases: null and empty texts get the score of a text without known words; without a positive example
all scores are 0; rows are scored each, repeated or not; a null doc_id belongs to no fold: nothing is learned from it, it is not held
out, and it is scored; words that tie for the last place are taken in the order of their hashes; texts of any length are read
whole, block by block; other columns are ignored, and the score's name gives way to theirs; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.text import STOPS, buffers, slices, words
from quarry.llm.tokens import release


def fold(n: int):
    """crc32 of the doc_id as text, mod n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def held_out(n: int, which: int):
    """Whether the doc_id is in that fold. A null doc_id is in none."""
    return F.coalesce(fold(n) == which, F.lit(False))


@dataclass
class Model:
    """Sorted word hashes, their weights and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, column: pa.Array) -> np.ndarray:
        """Which of the model's words each text holds (rows by words, bool)."""
        data, offsets = buffers(column)
        out = np.zeros((len(offsets) - 1, len(self.words)), bool)
        if not len(self.words):
            return out
        for i, j in slices(offsets):
            _, _, hashes, rows = words(data, offsets[i : j + 1], STOPS)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            out[i + np.searchsorted(rows, hit, "right") - 1, at[hit]] = True
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        z = self.present(column) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = 1500, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier with the smallest non-negative PU risk (logistic loss, full batches).

    Equal rows are taken once, with their share of the set as weight.
    """
    (pos, np_), (unl, nu) = (np.unique(x.astype(np.uint8), axis=0, return_counts=True) for x in (pos, unl))
    pos, unl, ap, au = pos.astype(np.float64), unl.astype(np.float64), np_ / np_.sum(), nu / nu.sum()
    w, b = np.zeros(pos.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    part = lambda g, x: np.append(g @ x, g.sum())
    for t in range(1, rounds + 1):
        zp, zu = pos @ w + b, unl @ w + b
        rest = au @ np.logaddexp(0, zu) - prior * (ap @ np.logaddexp(0, zp))
        negative = part(sig(zu) * au, unl) - prior * part(sig(zp) * ap, pos)
        grad = prior * part((sig(zp) - 1) * ap, pos) + negative if rest >= 0 else -negative
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        kind = batch.column("positive").to_numpy(zero_copy_only=False)
        for i, j in slices(offsets):
            _, _, hashes, rows = words(data, offsets[i : j + 1], STOPS)
            parts = [np.unique(hashes[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(kind[i:j], [len(p) for p in parts]))], ["word", "positive"])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, positives: int = 5000, unlabelled: int = 20_000, features: int = 512, least_z: float = 5.0, lift: float = 2.0) -> Model:
    """Fits on rows whose fold isn't held_out. Broadcast ids: positives + unlabelled at most."""
    marked = labels.where((fold(folds) != held_out) & F.col("toxic").isNotNull())
    prior = marked.agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]
    by = F.xxhash64("doc_id")
    pos = marked.where("toxic = 1").select("doc_id").distinct().orderBy(by, "doc_id").limit(positives).select("doc_id", F.lit(True).alias("positive"))
    unl = docs.where(fold(folds) != held_out).select("doc_id").orderBy(by, "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("positive"))
    ids = stored(pos.union(unl), "tox-ids")
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "tox-sample")
    sizes = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not prior or not sizes.get(True) or not sizes.get(False):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    prior = min(max(prior, 1e-4), 0.95)
    seen = sample.mapInArrow(_word_rows, "word long, positive boolean").groupBy("word").agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
    # How far the share in the positives lies from that in the unlabelled, in standard errors if both were the same.
    sp, su = F.col("p") / sizes[True], (F.col("u") + 0.5) / (sizes[False] + 1)
    z = (sp - su) / F.sqrt(su * (1 - su) * (1 / sizes[True] + 1 / sizes[False]))
    top = seen.where("p >= 3 or u >= 20").where((F.abs(z) >= least_z) & ((sp >= lift * su) | (sp * lift <= su))).orderBy(F.abs(z).desc(), "word").limit(features).select("word").collect()
    model = Model(np.sort(np.array([r.word for r in top], np.int64).view(np.uint64)), np.zeros(len(top)), 0.0)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = np.packbits(model.present(b.column("text")), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array([r.tobytes() for r in packed], pa.binary())], ["positive", "bits"])

    rows = sample.select("text", "positive").mapInArrow(bits, "positive boolean, bits binary").toArrow()
    x = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)[:, : len(top)]
    y = rows["positive"].to_numpy().astype(bool)
    w, b = fit_nnpu(x[y], x[~y], prior)
    return Model(model.words, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a score column (0 to 1), the last one: ``score``, after as many underscores as keep it from docs' own names."""
    names, out = docs.columns, "score"
    while out in [n.lower() for n in names]:
        out = "_" + out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column("text")))], [*names, out])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def score_ids(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
