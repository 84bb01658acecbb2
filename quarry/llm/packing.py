"""Packing token sequences by non-negative least squares.

Documents are packed unit by unit: as many whole documents of a task as make ``unit`` tokens. Full
windows come off each document first. What is left of it (1 to 4095 tokens) falls into one of 64
length classes; all combinations of at most ``depth`` classes that fill a window are enumerated, NNLS
finds how often each is used so that the class histogram is met, and the counts are rounded
down. Documents that stay over are the filler: they close gaps of at least ``least`` tokens in
the windows, and are then laid end to end. The tail of a unit is cut into sequences whose lengths are
powers of two, which need no padding. Every token lies in exactly one piece.

Cases: null or empty text is a document of the end id alone; documents longer than a unit form one of
their own; repeated rows are packed each; null doc_ids are packed like others, under a null name; documents of equal length are
taken in the order of the table; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.tokens import encoder

CLASSES = 64


@lru_cache
def combinations(depth: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Matrix (class, combination) and the combinations of at most depth classes that sum to a window."""
    found = [c for n in range(1, depth + 1) for c in itertools.combinations_with_replacement(range(1, CLASSES + 1), n) if sum(c) == CLASSES]
    a = np.zeros((CLASSES, len(found)))
    for j, c in enumerate(found):
        for k in c:
            a[k - 1, j] += 1
    return a, found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| with x >= 0, by active sets."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    ata, atb = a.T @ a, a.T @ b
    for _ in range(rounds):
        slope = np.where(used, -np.inf, atb - ata @ x)
        j = int(np.argmax(slope))
        if not slope[j] > 1e-8 * max(1.0, np.abs(b).max(initial=0)):
            break
        used[j] = True
        while used.any():
            k = np.flatnonzero(used)
            s = np.linalg.lstsq(ata[np.ix_(k, k)], atb[k], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[k] = s
                break
            low = s <= 0
            step = np.min(x[k][low] / np.maximum(x[k][low] - s[low], 1e-300))
            x[k] += step * (s - x[k])
            used[k[low & (x[k] <= 1e-9)]] = False
            x[~used] = 0
    return x


def pack(lengths: np.ndarray, window: int = 4096, depth: int = 3, least: int = 32) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each token of the documents once."""
    out, seq = [], 0
    for d in np.flatnonzero(lengths >= window):
        for k in range(int(lengths[d]) // window):
            out.append((int(d), k * window, window, seq, 0))
            seq += 1
    rest = lengths % window
    step = -(-window // CLASSES)
    by: list[list[int]] = [[] for _ in range(CLASSES + 1)]
    for d in np.flatnonzero(rest):
        by[-(-int(rest[d]) // step)].append(int(d))
    a, found = combinations(depth)
    x = nnls(a, np.array([len(c) for c in by[1:]], float))
    gaps: list[tuple[int, int]] = []
    for j in np.argsort(-x, kind="stable"):
        for _ in range(int(x[j] + 1e-6)):
            need = {k: found[j].count(k) for k in found[j]}
            if any(len(by[k]) < n for k, n in need.items()):
                break
            at = 0
            for k in found[j]:
                d = by[k].pop()
                out.append((d, int(lengths[d] - rest[d]), int(rest[d]), seq, at))
                at += int(rest[d])
            if window - at >= least:
                gaps.append((seq, at))
            seq += 1
    left = sorted((d for c in by for d in c), key=lambda d: (-rest[d], d))
    held = [(d, int(lengths[d] - rest[d]), int(rest[d])) for d in left][::-1]

    def take(most: int) -> tuple[int, int, int]:
        """The next piece of the filler, of most tokens at most; a cut never leaves fewer than least tokens if that can be helped."""
        d, start, n = held.pop()
        cut = n if n <= most else most if n - most >= least or most < 2 * least else n - least
        if cut < n:
            held.append((d, start + cut, n - cut))
        return d, start, cut

    for s, at in gaps:
        while held and window - at >= least:
            d, start, n = take(window - at)
            out.append((d, start, n, s, at))
            at += n
    total = sum(n for _, _, n in held)
    while total:
        size = window if total >= window else 1 << (total.bit_length() - 1)
        at = 0
        while at < size:
            d, start, n = held.pop()
            if n > size - at:
                held.append((d, start + size - at, n - size + at))
                n = size - at
            out.append((d, start, n, seq, at))
            at += n
        total -= size
        seq += 1
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, depth: int = 3, least: int = 32, unit: int = 4_000_000) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), packed within each task: no shuffle.

    A sequence_id is the task's partition times 2^36 plus a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer, False).encode, TaskContext.get().partitionId() << 36
        names, tokens, count = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, count
            lengths = np.array([len(t) for t in tokens], np.int64)
            pieces = pack(lengths, window, depth, least)
            cols = np.array(pieces, np.int64).reshape(-1, 5)
            crcs = np.array([zlib.crc32(tokens[d][s : s + n]) for d, s, n, _, _ in pieces], np.int64)
            ids = pa.array(names, pa.int64()).take(pa.array(cols[:, 0]))
            made = pa.RecordBatch.from_arrays([ids, *map(pa.array, (cols[:, 1], cols[:, 2], crcs, lengths[cols[:, 0]], cols[:, 3] + base, cols[:, 4]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base += int(cols[:, 3].max(initial=-1)) + 1
            names.clear()
            tokens.clear()
            count = 0
            return made

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for k in range(0, len(ids), 256):
                for d, x in zip(ids[k : k + 256], encode(texts[k : k + 256]), strict=True):
                    names.append(d)
                    tokens.append(np.append(x, np.uint32(end_id)).astype("<u4"))
                    count += len(x) + 1
                if count >= unit:
                    yield flush()
        if names:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
