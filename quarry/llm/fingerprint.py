"""Improbable-feature digests of documents.

Every window of ``WINDOW`` bytes has an entropy. How often each entropy occurs over all documents ranks it:
the rarer, the better; windows of nearly constant bytes rank last. A window that is the
leftmost best of enough runs of ``POP`` successive windows is a feature. The features, in text order, go into
chained Bloom filters of 2048 bits, five bits a feature, 160 features a filter. Two fingerprints are compared
by the filters' common bits, less the number expected by chance, over the most there could be; each filter of the
shorter chain takes its best match.

Cases: null text counts as empty and has the empty fingerprint; a text shorter than a window is one
feature; equal fingerprints have likeness 1, an empty one and another 0; repeated rows and null doc_ids
follow one another in doc_id order, nulls first, and by their texts where ids are equal; windows of equal rank: the leftmost counts;
texts of any length are read whole, their comparison taking (filters of one) x (filters of the other); other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import parts_for
from quarry.llm.text import _powers, buffers, mix, slices

WINDOW, POP, POPULAR = 32, 32, 12
BITS, PROBES, PER_FILTER = 2048, 5, 160
BINS = 1024
LAST = np.uint16(65535)
#: round(1024 c log2 c) for c copies of a byte in a window
_G = np.array([0, *[round(1024 * c * np.log2(c)) for c in range(1, WINDOW + 1)]], np.int32)
_TOP = int(_G[WINDOW])
_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_PART = 1 << 16


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy bin of each window of the bytes, len(data) - WINDOW + 1 values; 0 is constant bytes."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for at in range(0, n, _PART):
        x = data[at : min(n, at + _PART + WINDOW)]
        m = min(_PART, n - at)
        for d in range(1, WINDOW):
            same = x[: max(0, min(m, len(x) - d))] == x[d : d + m]
            ahead[at : at + len(same)] += same
            behind[at + d : at + d + len(same)] += same
    step = _G[behind] - _G[behind - 1]
    gone = _G[ahead] - _G[ahead - 1]
    counts = np.bincount(data[:WINDOW], minlength=256)
    s = np.empty(n - WINDOW + 1, np.int64)
    s[0] = _G[counts].sum()
    np.cumsum(step[WINDOW:].astype(np.int64) - gone[: n - WINDOW], out=s[1:])
    s[1:] += s[0]
    return ((_TOP - s) * (BINS - 1) // _TOP).astype(np.int32)


def ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each bin: the rarest first; the lowest eighth of entropies and bins that never occur last."""
    out = np.full(BINS, LAST, np.uint16)
    used = np.flatnonzero(histogram > 0)
    used = used[used >= BINS // 8]
    out[used[np.lexsort((-used, histogram[used]))]] = np.arange(len(used))
    return out


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of each row's bytes, in order, and each row's first feature (rows + 1 values)."""
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    data, offsets = data[base : base + n], offsets - base
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    at = np.zeros(0, np.int64)
    if n >= WINDOW:
        r = np.full(n, LAST, np.uint16)
        r[: n - WINDOW + 1] = rank[entropy_bins(data)]
        cross = np.zeros(n + 1, np.int32)  # windows that run over a row's end
        np.add.at(cross, np.maximum(offsets[:-1], offsets[1:] - WINDOW + 1), 1)
        np.add.at(cross, offsets[1:], -1)
        r[np.cumsum(cross[:n]) > 0] = LAST
        left, right = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for a in range(0, n, _PART):
            b = min(n, a + _PART)
            x = np.full(b - a + 2 * POP, LAST, np.uint16)
            lo, hi = max(0, a - POP), min(n, b + POP)
            x[POP - (a - lo) : POP - (a - lo) + hi - lo] = r[lo:hi]
            own = x[POP : POP + b - a]
            on_l, on_r = np.ones(b - a, bool), np.ones(b - a, bool)
            for d in range(1, POP):
                on_l &= x[POP - d : POP - d + b - a] > own
                on_r &= x[POP + d : POP + d + b - a] >= own
                left[a:b] += on_l
                right[a:b] += on_r
        at = np.flatnonzero((left.astype(np.int16) + right >= POP - 2 + POPULAR) & (r < LAST))
    # The best window of a row in which none is popular stands in for the others.
    row = np.searchsorted(offsets, at, "right") - 1
    bare = np.flatnonzero((np.bincount(row, minlength=len(size)) == 0) & (size >= WINDOW))
    if len(bare):
        at = np.sort(np.concatenate([at, [offsets[k] + int(np.argmin(r[offsets[k] : offsets[k + 1] - WINDOW + 1])) for k in bare]]).astype(np.int64))
    starts = np.sort(np.concatenate([at, offsets[short]]).astype(np.int64))
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(starts + WINDOW, offsets[row + 1]) if len(starts) else starts
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def digest(hashes: np.ndarray) -> np.ndarray:
    """Chained filters (n, BITS / 8) of one row's features; repeated features count once."""
    if not len(hashes):
        return np.zeros((0, BITS // 8), np.uint8)
    _, first = np.unique(hashes, return_index=True)
    h = hashes[np.sort(first)]
    n = -(-len(h) // PER_FILTER)
    out = np.zeros((n, BITS), bool)
    k = np.arange(len(h)) // PER_FILTER
    for i in range(PROBES):
        out[k, (h >> np.uint64(11 * i)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(out, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    pa_, pb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        chance = pa_[i] * pb / BITS
        best[i] = np.max((both - chance) / np.maximum(np.minimum(pa_[i], pb) - chance, 1e-9))
    return float(np.clip(np.average(best, weights=pa_), 0, 1))


def encode(d: np.ndarray) -> str:
    return base64.b85encode(d.tobytes()).decode()


def entropy_histogram(docs: DataFrame) -> np.ndarray:
    """How many windows of all whole texts fall into each entropy bin (BINS numbers a task reach the driver's sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BINS, np.int64)
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                if len(part) >= WINDOW:
                    inside = np.ones(len(part) - WINDOW + 1, bool)
                    for e in offsets[i + 1 : j] - offsets[i]:
                        inside[max(0, e - WINDOW + 1) : e] = False
                    sums += np.bincount(entropy_bins(part)[inside], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(sums)], ["bin", "n"])

    rows = docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BINS, np.int64)
    for r in rows:
        out[r.bin] = r.n
    return out


def _digests(texts: list[str], rank: np.ndarray) -> list[np.ndarray]:
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    out = []
    for i, j in slices(offsets):
        hashes, first = features(data, offsets[i : j + 1], rank)
        out += [digest(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def in_order(docs: DataFrame, per_bucket: int | None = None) -> DataFrame:
    """docs in ascending doc_id order within buckets of consecutive ids: (bucket, look, doc_id, text).

    The row with look = 1 repeats the first row of the following bucket (of the first one after the
    last), so that each row's successor is in its own bucket. One shuffle of the texts.
    """
    parts = parts_for(docs)
    low = -(1 << 63)
    rank = F.coalesce(F.col("doc_id"), F.lit(low))
    n = 6 * parts
    cuts = docs.select(rank.alias("r")).agg(F.percentile_approx("r", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    place = lambda x: np.searchsorted(cuts, x, "right")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(low).to_numpy()
            buckets = place(ids)
            k = np.unique(buckets)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(np.array([ids[buckets == x].min() for x in k], np.int64))], ["bucket", "first"])

    found = docs.select("doc_id").mapInArrow(heads, "bucket long, first long").groupBy("bucket").agg(F.min("first").alias("first")).orderBy("bucket").collect()
    order = [r.bucket for r in found]
    look = {r.first: order[k - 1] for k, r in enumerate(found)}  # a bucket's first id goes to the bucket before it

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").fill_null(low).to_numpy()
            extra = [(k, look[x]) for k, x in enumerate(ids.tolist()) if x in look]
            for rows, buckets, flag in ((pa.array(np.arange(len(ids))), place(ids), 0), (pa.array([k for k, _ in extra], pa.int64()), np.array([x for _, x in extra], np.int64), 1)):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array(np.full(len(rows), flag, np.int32)), b.column("doc_id").take(rows), b.column("text").take(rows)], ["bucket", "look", "doc_id", "text"])

    made = docs.select("doc_id", "text").mapInArrow(assign, "bucket long, look int, doc_id long, text string")
    return made.repartition(parts, "bucket").sortWithinPartitions("bucket", "look", "doc_id", "text")


def fingerprints(docs: DataFrame, chunk_chars: int = 1 << 20) -> DataFrame:
    """Per document its fingerprint, that of the edited text, and the likeness to the edited text and to the next document.

    The edited text: the last quarter of the code points replaced by the first as many of the next
    document in doc_id order (the first document's after the last).
    """
    rank = ranks(entropy_histogram(docs))

    def emit(rows: list[tuple], nxt: tuple | None) -> pa.RecordBatch:
        """rows of a bucket and the row after them."""
        chain = [*rows, nxt if nxt is not None else rows[0]]
        texts = [t or "" for _, t in chain]
        edited = []
        for k in range(len(rows)):
            q = len(texts[k]) // 4
            edited.append(texts[k][: len(texts[k]) - q] + texts[k + 1][:q])
        own, other = _digests(texts, rank), _digests(edited, rank)
        m = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:m]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([encode(x) for x in own[:m]]), pa.array([encode(x) for x in other]), pa.array([likeness(own[k], other[k]) for k in range(m)]), pa.array([likeness(own[k], own[k + 1]) for k in range(m)])],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, size = None, 0
        for b in batches:
            for bucket, look, d, t in zip(b.column("bucket").to_pylist(), b.column("look").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if bucket != now or look:
                    if held:
                        yield emit(held, (d, t) if look and bucket == now else None)
                    held, size, now = [], 0, bucket
                    if look:
                        continue
                if size > chunk_chars and held:
                    yield emit(held, (d, t))
                    held, size = [], 0
                held.append((d, t))
                size += len(t or "")
        if held:
            yield emit(held, None)

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
