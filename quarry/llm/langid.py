"""Language proportions of a document by expectation-maximisation over n-gram likelihoods.

Each language is a distribution over hashed byte trigrams (lower-cased), learned from a bounded sample
of labelled documents. A document is a mixture: EM finds the languages' shares. Sets of languages are
compared by the log-likelihood less ``penalty`` * k * log(n) / 2 for k languages and n distinct
trigrams; the nested sets that drop the smallest shares are candidates. The predicted language is that
with the largest share in the chosen set, and the share is its score.

Cases: null text, empty text and text without a letter are ``und`` with score 0, and so is everything
if there is no labelled text; repeated rows are predicted each; a null doc_id belongs to no fold: nothing is learned from it, it is
not held out, and it is predicted; of languages with equal shares the first by name is predicted; texts of any length are read
whole; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.text import LOWER, buffers
from quarry.llm.toxicity import fold

BUCKETS = 1 << 16


def trigrams(data: np.ndarray) -> np.ndarray:
    """The hashed trigrams of a text's bytes, spaces added at both ends."""
    x = np.full(max(3, len(data) + 2), 32, np.uint32)
    x[1 : 1 + len(data)] = LOWER[data]
    x[x < 33] = 32
    return ((x[:-2] * 0x10000 + x[1:-1] * 0x100 + x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # (bucket, language), float32

    def shares(self, column: pa.Array, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
        """(rows, languages): shares in the chosen set, 0 outside it."""
        data, offsets = buffers(column)
        n, k = len(offsets) - 1, len(self.names)
        out = np.zeros((n, k))
        i = 0
        while i < n:
            parts, j, held = [], i, 0
            while j < n and held < 200_000:
                parts.append(np.unique(trigrams(data[offsets[j] : offsets[j + 1]]), return_counts=True))
                held += len(parts[-1][0])
                j += 1
            out[i:j] = self._solve(parts, penalty, rounds)
            i = j
        return out

    def _solve(self, parts: list[tuple[np.ndarray, np.ndarray]], penalty: float, rounds: int) -> np.ndarray:
        size = np.array([len(p[0]) for p in parts])
        logs = self.logs[np.concatenate([p[0] for p in parts])]
        count = np.concatenate([p[1] for p in parts]).astype(np.float32)
        top = logs.max(1)
        like = np.exp(logs - top[:, None])
        k = like.shape[1]

        def em(rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares and log-likelihoods of these rows, each over its allowed languages."""
            pick = np.repeat(rows, size).nonzero()[0] if not rows.all() else slice(None)
            x, c, sz = like[pick], count[pick], size[rows]
            edge = np.concatenate([[0], np.cumsum(sz)[:-1]])
            total = np.add.reduceat(c, edge)
            p = allowed / allowed.sum(1, keepdims=True)
            p = p.astype(np.float32)
            for _ in range(rounds):
                q = x * np.repeat(p, sz, axis=0)
                q *= (c / q.sum(1))[:, None]
                new = np.add.reduceat(q, edge, axis=0) / total[:, None]
                moved = np.abs(new - p).max()
                p = new
                if moved < 1e-3:
                    break
            fit = np.add.reduceat(c * np.log((x * np.repeat(p, sz, axis=0)).sum(1)), edge)
            return p, fit

        edge = np.concatenate([[0], np.cumsum(size)[:-1]])
        single = np.add.reduceat(count[:, None] * np.log(like + 1e-30), edge, axis=0)
        cost = penalty * np.log(np.maximum(size, 2)) / 2
        rows = np.ones(len(size), bool)
        full, fit = em(rows, np.ones((len(size), k)))
        best = np.zeros((len(size), k))
        best[np.arange(len(size)), single.argmax(1)] = 1
        value = single.max(1) - cost
        order = np.argsort(-full, axis=1, kind="stable")
        for m in range(2, k + 1):
            rows = fit - 2 * cost > value if m == 2 else rows & (fit - m * cost > value)
            if not rows.any():
                break
            allowed = np.zeros((int(rows.sum()), k))
            np.put_along_axis(allowed, order[rows][:, :m], 1, axis=1)
            p, f = (full[rows], fit[rows]) if m == k else em(rows, allowed)
            better = f - m * cost[rows] > value[rows]
            at = np.flatnonzero(rows)[better]
            best[at], value[at] = p[better], (f - m * cost[rows])[better]
        return best


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = 1000, alpha: float = 0.5) -> Languages:
    """From per_language documents of each lang (smallest hashes of doc_id) whose fold isn't held_out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(folds) != held_out)).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = stored(known.withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id", F.col("lang").alias("as_lang")), "lang-ids")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "as_lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for k, lang in enumerate(b.column("as_lang").to_pylist()):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(trigrams(data[offsets[k] : offsets[k + 1]]), minlength=BUCKETS)
        for lang, c in sums.items():
            i = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array(i.astype(np.int32)), pa.array(c[i])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    c = np.zeros((BUCKETS, len(names)))
    place = {x: i for i, x in enumerate(names)}
    if names:
        c[rows["bucket"].to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    return Languages(names, np.log((c + alpha) / (c.sum(0) + alpha * BUCKETS)).astype(np.float32))


def predict(docs: DataFrame, model: Languages, penalty: float = 1.0) -> DataFrame:
    """Rows (doc_id, lang_pred, score, shares map)."""
    lettered = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = b.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if model.names:
                p = model.shares(b.column("text"), penalty)
                best = p.argmax(1)
                lang = np.where(ok, np.array(model.names, object)[best], "und")
                score = np.where(ok, np.clip(p.max(1), 0, 1), 0.0)
                held = [[(n, float(x)) for n, x in zip(model.names, r, strict=True) if x > 0] if o else [] for r, o in zip(p, ok, strict=True)]
            else:
                lang, score, held = np.array(["und"] * len(ok), object), np.zeros(len(ok)), [[]] * len(ok)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(held, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return lettered.mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,double>")
