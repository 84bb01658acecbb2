"""Substring deduplication: paragraphs, MinHash banding, exact Jaccard, components.

A paragraph ends at a newline and, within a line, after each sentence of ``min_words`` words or more (a
shorter sentence belongs to the one that follows). The cuts depend on nearby words only, so
a passage copied into the middle of other text is cut alike wherever it stands. Paragraphs under
``min_words`` words can't be matched: single sentences and license lines that many documents happen to share are no passages. Five-word shingles of a paragraph fall into ``BANDS`` ranges of
their hash; the least hash of each is a band of one row. With similarity s a pair is missed with
probability (1 - s)^4, 0.0016 at 0.8, and never if the paragraphs are equal. Paragraphs with
the same shingles form a class, so copies cost one row a task. Classes that collide in a band are
candidates; signature trees verify the exact Jaccard similarity, and the components are the clusters. A cluster
that occurs in two documents or more keeps its first paragraph (smallest doc_id, then place).

Exact passages that start and end inside paragraphs are found by runs: of every ``passage`` consecutive words of a document,
whatever their lines and sentences, the part of ``passage // 2`` words with the least hash is a run. So two documents
that share ``passage`` words in a row share a run inside them, always, and runs follow each other within
``passage // 2 + 2`` words. Equal runs are a cluster of their own; they overlap each other and paragraphs.

A class is named by two 64-bit hashes of its shingles, or of a run's words. The first names it in the join; where
two classes share that one, a hash of both does.

Cases: null or empty text has no paragraph; null doc_ids are ignored; rows that repeat a doc_id and a text are one
document; rows that repeat a doc_id with other texts are one document too, which has the paragraphs of each; of equal paragraphs
the first by doc_id, then place, stays; texts of any length are cut whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_by_size, stored
from quarry.llm.jaccard import link_sets, token_pods
from quarry.llm.text import _powers, buffers, mix, slices, words

SHINGLE, BANDS = 5, 4
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SALT, _OTHER = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * j + 1) ** 3 | 1) % (1 << 64) for j in range(SHINGLE)], np.uint64)


def paragraphs(data: np.ndarray, offsets: np.ndarray, min_words: int, found: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """The paragraphs of at least min_words words: row, no, start, end (bytes in the row), words, and first and last + 1 shingle in ``shingle``. found: what words() gives."""
    base = int(offsets[0])
    starts, ends, hashes, rows = found
    n = len(starts)
    empty = {k: np.zeros(0, np.int64) for k in ("row", "no", "start", "end", "words", "a", "b")} | {"shingle": np.zeros(0, np.uint64)}
    if n < max(min_words, SHINGLE):
        return empty
    body = data[base : int(offsets[-1])]
    lines = np.append(0, np.cumsum(body == 10))
    after = np.append(starts[1:], len(body))
    newline = lines[after] > lines[ends]
    newline[rows[1:][rows[1:] > 0] - 1] = True
    sentence = newline | _STOP[body[ends - 1]]
    at = np.flatnonzero(sentence)
    if not len(at) or at[-1] != n - 1:
        at = np.append(at, n - 1)
    size = np.diff(np.append(-1, at))
    cut = at[(size >= min_words) | newline[at] | (at == n - 1)]
    first = np.append(0, cut[:-1] + 1)
    count = cut + 1 - first
    row = np.searchsorted(rows, first, "right") - 1
    no = np.arange(len(first)) - np.searchsorted(row, row)
    ok = count >= max(min_words, SHINGLE)
    if not ok.any():
        return empty
    h = np.zeros(n - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        h += hashes[j : n - SHINGLE + 1 + j] * _FACTORS[j]
    first, cut, row, no, count = first[ok], cut[ok], row[ok], no[ok], count[ok]
    return {"row": row, "no": no, "start": starts[first] - (offsets[row] - base), "end": ends[cut] - (offsets[row] - base), "words": count, "a": first, "b": cut + 2 - SHINGLE, "shingle": mix(h)}


def runs(offsets: np.ndarray, passage: int, found: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """The runs: row, no, start, end (bytes in the row), words and class k. A row's runs are numbered by their first word, from the row's number of words on."""
    starts, ends, hashes, rows = found
    n, size = len(starts), passage // 2
    span = passage - size + 1
    begin = np.flatnonzero(np.arange(n) + passage <= np.repeat(rows[1:], np.diff(rows)))
    if not len(begin):
        return {k: np.zeros(0, np.int64) for k in ("row", "no", "start", "end", "words", "k", "k2")}
    up, down = _powers(n)
    sums = np.append(np.uint64(0), np.cumsum(hashes * up[:n], dtype=np.uint64))
    h = mix((sums[size:] - sums[:-size]) * down[: n - size + 1] + np.uint64(0x632BE59BD9B4E019))
    # The low bits hold the place modulo span: they tell the place again, and of equal runs choose one in a span.
    low = np.uint64((1 << (span - 1).bit_length()) - 1)
    least, width = (h & ~low) | (np.arange(len(h)) % span).astype(np.uint64), 1
    while width < span:
        step = min(width, span - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.unique(begin + ((least[begin] & low).astype(np.int64) - begin) % span)
    row = np.searchsorted(rows, at, "right") - 1
    head = offsets[row] - offsets[0]
    np.cumsum(mix(hashes ^ _OTHER) * up[:n], out=sums[1:])
    other = mix((sums[at + size] - sums[at]) * down[at] + _OTHER)
    return {"row": row, "no": rows[row + 1] - rows[row] + at - rows[row], "start": starts[at] - head, "end": ends[at + size - 1] - head, "words": np.full(len(at), size), "k": h[at].view(np.int64), "k2": other.view(np.int64)}


def classes(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The class of each paragraph, two hashes."""
    if not len(p["a"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = []
    for salt in (_SALT, _OTHER):
        sums = np.append(np.uint64(0), np.cumsum(mix(p["shingle"] ^ salt), dtype=np.uint64))
        out.append(mix(sums[p["b"]] - sums[p["a"]] + p["words"].astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def bands(p: dict[str, np.ndarray], which: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS): the least shingle hash in each range, the largest number where there is none."""
    out = np.full((len(which), BANDS), np.iinfo(np.uint64).max, np.uint64)
    edges = np.stack([p["a"][which], p["b"][which]], 1).ravel()
    h = np.append(p["shingle"], np.iinfo(np.uint64).max)
    part = (h >> np.uint64(62)).astype(np.uint8)
    for k in range(BANDS):
        if len(which):
            out[:, k] = np.minimum.reduceat(np.where(part == k, h, np.iinfo(np.uint64).max), edges)[::2]
    return out


def distinct(p: dict[str, np.ndarray], which: np.ndarray) -> np.ndarray:
    """The number of distinct shingles of each of these paragraphs."""
    size = (p["b"] - p["a"])[which]
    owner = np.repeat(np.arange(len(which)), size)
    at = np.repeat(p["a"][which] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(owner))
    own = np.unique(mix(p["shingle"][at] ^ mix(owner.astype(np.uint64))), return_index=True)[1]
    return np.bincount(owner[own], minlength=len(which)).astype(np.int64)


def _parts(batch: pa.RecordBatch, min_words: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    data, offsets = buffers(batch.column("text"))
    for i, j in slices(offsets):
        at = offsets[i : j + 1]
        yield i, paragraphs(data, at, min_words, words(data, at))


def duplicate_passages(docs: DataFrame, percent: int = 80, min_words: int = 15, passage: int = 50, key_bits: int = 64) -> DataFrame:
    """The paragraphs and runs of clusters that span documents.

    Columns: doc_id, paragraph, start_byte, end_byte, n_words, keep_doc_id, keep_paragraph, copies
    (paragraphs in the cluster) and removed (false for the one that stays). A run is a row like a
    paragraph, its number at least the document's number of words. key_bits: how many bits of a class's
    first hash are used (tests let classes share them).
    """
    docs, mask = docs.select("doc_id", "text").where("doc_id is not null and text is not null"), np.int64((1 << key_bits) - 1 if key_bits < 64 else -1)

    def emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            data, offsets = buffers(b.column("text"))
            for i, j in slices(offsets):
                at = offsets[i : j + 1]
                found = words(data, at)
                p, r = paragraphs(data, at, min_words, found), runs(at, passage, found)
                one, two = classes(p)
                k, k2 = np.append(one, r["k"]) & mask, np.append(two, r["k2"])
                if len(k):
                    row, no, start, end, size = (np.append(p[c], r[c]) for c in ("row", "no", "start", "end", "words"))
                    run = np.arange(len(k)) >= len(p["row"])
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k2), pa.array(ids[i + row]), pa.array(no.astype(np.int32)), pa.array(start), pa.array(end), pa.array(size.astype(np.int32)), pa.array(run)], ["k", "k2", "doc_id", "no", "start", "end", "words", "run"])

    def emit_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for _, p in _parts(b, min_words):
                k, k2 = classes(p)
                names = list(zip((k & mask).tolist(), k2.tolist(), strict=True))
                fresh = {c: w for w, c in enumerate(names) if c not in seen}
                which = np.array(list(fresh.values()), np.int64)
                if not len(which):
                    continue
                if len(seen) > 400_000:
                    seen.clear()  # only bounds memory: a class sent twice changes nothing
                seen.update(fresh)
                x = bands(p, which)
                ok = (x != np.iinfo(np.uint64).max).ravel()
                n = np.repeat(distinct(p, which), BANDS)[ok]
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel()[ok].view(np.int64)), pa.array(n), pa.array(np.repeat((k & mask)[which], BANDS)[ok]), pa.array(np.repeat(k2[which], BANDS)[ok])], ["token", "n", "k", "k2"])

    made = stored(docs.mapInArrow(emit_places, "k long, k2 long, doc_id long, no int, start long, end long, words int, run boolean"), "passages")
    places, parts = made.where("not run").drop("run"), made.where("run").drop("run")
    held = stored(places.groupBy("k", "k2").agg(F.min(F.struct("doc_id", "no", "start", "end", "words")).alias("at"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "passage-classes")
    several = stored(held.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k", F.lit(True).alias("several")), "passage-names", held.count())

    def node(rows: DataFrame) -> DataFrame:
        """rows with the 64-bit name of their class."""
        if several.isEmpty():
            return rows.withColumn("node", F.col("k"))
        return rows.join(several, "k", "left").withColumn("node", F.when(F.col("several"), F.xxhash64("k", "k2")).otherwise(F.col("k"))).drop("several")

    bounds = node(docs.mapInArrow(emit_bands, "token long, n long, k long, k2 long")).select("token", "n", F.col("node").alias("id"))
    pods = stored(token_pods(bounds, percent), "passage-pods")
    held = node(held)
    # Most classes meet no other one. Those that do go on apart, so that all classes are shuffled once more and not for each step.
    met = pods.select(F.col("id").alias("node")).distinct()
    cand = stored(held.join(met.hint("shuffle_hash"), "node", "left_semi"), "passage-candidates")

    def fetch(ids: DataFrame) -> DataFrame:
        spans = cand.join(ids.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("at.doc_id").alias("doc_id"), F.struct("node", "k", "k2", "at.start", "at.end").alias("s"))
        spans = spans.groupBy("doc_id").agg(F.collect_list("s").alias("spans"))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
                data, offsets = buffers(b.column("text"))
                keys, out = [], []
                for r, spans in enumerate(b.column("spans").to_pylist()):
                    for s in spans:
                        start, end = offsets[r] + s["start"], offsets[r] + s["end"]
                        if end > offsets[r + 1]:
                            continue  # another text of that doc_id
                        _, _, hashes, _ = words(data, np.array([start, end]))
                        if len(hashes) < SHINGLE:
                            continue
                        h = np.zeros(len(hashes) - SHINGLE + 1, np.uint64)
                        for j in range(SHINGLE):
                            h += hashes[j : len(hashes) - SHINGLE + 1 + j] * _FACTORS[j]
                        h = mix(h)
                        one, two = classes({"a": np.array([0]), "b": np.array([len(h)]), "shingle": h, "words": np.array([len(hashes)])})
                        if (one[0] & mask, two[0]) == (s["k"], s["k2"]):
                            keys.append(s["node"])
                            out.append(np.unique(h).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["id", "tokens"])

        return docs.join(spans.hint("shuffle_hash"), "doc_id").mapInArrow(sets, "id long, tokens binary")

    near = stored(link_sets(pods, fetch, percent).withColumnRenamed("id", "node"), "passage-links")
    linked = cand.join(near, "node").withColumnRenamed("component", "c")
    alone = held.where(F.col("at.doc_id") < F.col("last")).join(near.select("node"), "node", "left_anti").withColumn("c", F.col("node"))
    clustered = linked.unionByName(alone)
    clusters = clustered.groupBy("c").agg(F.min("at").alias("keep"), F.max("last").alias("last"), F.sum("n").alias("copies")).where(F.col("keep.doc_id") < F.col("last"))
    chosen = stored(clustered.select("k", "k2", "n", "c").join(clusters, "c").select("k", "k2", "n", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.no").alias("keep_paragraph"), "copies"), "passage-clusters")
    equal = parts.groupBy("k", "k2").agg(F.min(F.struct("doc_id", "no")).alias("keep"), F.max("doc_id").alias("last"), F.count("*").alias("copies")).where(F.col("keep.doc_id") < F.col("last"))
    equal = stored(equal.select("k", "k2", F.col("copies").alias("n"), F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.no").alias("keep_paragraph"), "copies"), "passage-runs")
    total = max(1, made.count())
    out = join_by_size(places, chosen, ["k", "k2"], "n", total).union(join_by_size(parts, equal, ["k", "k2"], "n", total)).dropDuplicates(["doc_id", "no", "k", "k2"])
    same = (F.col("doc_id") == F.col("keep_doc_id")) & (F.col("no") == F.col("keep_paragraph"))
    return out.select("doc_id", F.col("no").alias("paragraph"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("words").alias("n_words"), "keep_doc_id", "keep_paragraph", "copies", (~same).alias("removed"))
