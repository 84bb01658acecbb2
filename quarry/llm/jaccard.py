"""Exact similarity self-join of sets by signature trees, in pods.

``link_sets`` is the join proper. It gets pods: groups of sets such that two sets that link share a pod. A
task builds trees: leaves hold some sets, nodes the OR of their token bitmaps and the range of
their sizes. A dual traversal prunes node pairs whose largest possible overlap is too small, and those whose
sets are all one component already; what remains are pairs of leaves, whose sets are compared exactly, all of them by one look-up
of each token. So the links found connect just
what all links connect, without listing all pairs of a group.

A pod of more than ``block`` elements is cut into blocks by size band (sets that link are in the same band or
in neighbouring ones) and by a hash of the id. First each block meets itself and some sets, the hubs, of its band
and of the band below: work in proportion to the pod. That makes a group of near copies one component, however large it is.
Then only the sets outside the pod's largest component meet all of the pod, known components being
joined from the start. So no task is larger than two blocks, and what two passes cost is the
pod plus (sets outside its largest component) x pod. Only a pod of very many sets that share their rarest tokens and still
don't link makes that product large.

``shingle_groups`` builds it for word shingles of documents. Documents with the same set form a class first, named by 128 bits. Candidates
come from prefixes: of all tokens in one order, two sets with 100 * i >= t * u share one among the first
n - ceil(t n / 100) + 1 of each. The order puts tokens in crowded cells of a count sketch over all
documents last, so a passage that very many documents share is no meeting point for them; a token stands out
once its holders are a tenth of what a cell holds on average, and the cells grow with the texts so that this is some ten at any size. A prefix
gets s = min(SPARE, n / EVERY) tokens more. A pair of sets needs
an overlap of o = ceil(t (n + m) / (100 + t)); every token of one prefix that the other lacks counts
against it, so the prefixes must have o - max(ceil(t n / 100) - s(n), ceil(t m / 100) - s(m)) + 1 tokens in common, which is more than s of the smaller set. Tokens
with at most ``FEW`` holders count the pairs for that test; tokens with more holders are counted a set, and a pair is taken to have
in common as many of them as the set with fewer has. So a set with no more of them than s needs no other meeting point. The holders of such a token that have more,
by size, are linked to their neighbours only, as far as the sizes allow a link; that connects
whatever may link without pairs. The components of these candidate edges are the pods.

Cases: null or empty text and text without words has the empty set and links with nothing; null doc_ids keep their row
with a null component and link with nothing; rows that repeat a doc_id are sets of their own: each row of the id links by its own
text, and has the component that its own text belongs to; equal sets, and with them repeated rows, are always one component; a text of any
length is one set; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, few_tasks, fresh_names, join_by_size, stored
from quarry.llm.text import buffers, mix, shingle_sets, slices
from quarry.llm.tokens import release

#: The powers of two that the number of cells is between, and cells or tokens that are counted up together.
CELL_BITS = 20, 25
PART = 1 << 16
#: Sets of a leaf, a bit each, and nodes of a node above.
LEAF, FAN = 32, 8
#: A token with at most so many holders counts their pairs.
FEW = 16
#: A prefix has a token more for every so many of the set, up to SPARE: so many tokens with more holders connect nothing.
EVERY, SPARE = 24, 16
PAIRS = [np.triu_indices(m, 1) for m in range(FEW + 1)]


class Union:
    """Union-find over 0 .. n - 1; the smaller root wins."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class Node:
    __slots__ = ("bitmap", "low", "high", "spare", "items", "kids", "one", "tokens", "held", "sizes")

    def __init__(self, bitmap, low, high, spare, items, kids) -> None:
        self.bitmap, self.low, self.high, self.spare, self.items, self.kids, self.one = bitmap, low, high, spare, items, kids, False
        self.tokens = None

    def whole(self, u: Union) -> int | None:
        """The root that all sets below have in common, else None. Once they have one they keep it."""
        if not self.one:
            if self.kids:
                self.one = all(k.whole(u) is not None for k in self.kids) and len({k.whole(u) for k in self.kids}) == 1
            else:
                self.one = len({u.find(i) for i in self.items}) == 1
            if not self.one:
                return None
        at = self
        while at.kids:
            at = at.kids[0]
        return u.find(at.items[0])

    def spread(self, sets: list[np.ndarray]) -> None:
        """For a leaf, once: its distinct tokens, and for each a bit a set that tells whether the set holds it."""
        if self.tokens is None:
            self.tokens, at = np.unique(np.concatenate([sets[i] for i in self.items]), return_inverse=True)
            self.sizes = np.array([len(sets[i]) for i in self.items])
            held = np.zeros(len(self.tokens), np.uint32)
            for k, end in enumerate(np.cumsum(self.sizes)):
                held[at[end - self.sizes[k] : end]] |= np.uint32(1 << k)
            self.held = held


def tree(sets: list[np.ndarray], which: list[int], words: int) -> Node:
    """A signature tree over these sets; similar sets are neighbours because their smallest tokens are."""
    order = sorted(which, key=lambda i: (int(sets[i][0]), len(sets[i])))
    level = []
    for k in range(0, len(order), LEAF):
        items = order[k : k + LEAF]
        bitmap = np.zeros(words * 64, bool)
        spare = 0
        for i in items:
            bits = np.unique(sets[i] & np.uint64(words * 64 - 1)).astype(np.int64)
            bitmap[bits] = True
            spare = max(spare, len(sets[i]) - len(bits))
        sizes = [len(sets[i]) for i in items]
        level.append(Node(np.packbits(bitmap).view(np.uint64), min(sizes), max(sizes), spare, items, None))
    while len(level) > 1:
        up = []
        for k in range(0, len(level), FAN):
            kids = level[k : k + FAN]
            up.append(Node(np.bitwise_or.reduce([n.bitmap for n in kids]), min(n.low for n in kids), max(n.high for n in kids), max(n.spare for n in kids), None, kids))
        level = up
    return level[0]


def traverse(sets: list[np.ndarray], left: list[int], right: list[int] | None, percent: int, u: Union) -> list[tuple[int, int]]:
    """Links that connect what all links between left and right (or within left) connect."""
    links: list[tuple[int, int]] = []

    def compare(i: int, j: int) -> None:
        a, b = sets[i], sets[j]
        if u.find(i) == u.find(j) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return
        if len(a) < len(b):
            a, b = b, a
        at = np.searchsorted(a, b)
        at[at == len(a)] = 0
        both = int((a[at] == b).sum())
        if 100 * both >= percent * (len(a) + len(b) - both):
            u.join(i, j)
            links.append((i, j))

    def meet(x: Node, y: Node) -> None:
        """Compares all sets of two leaves at once: each token that both have is looked up once and counts for all pairs."""
        x.spread(sets)
        y.spread(sets)
        if len(x.tokens) > len(y.tokens):
            x, y = y, x
        at = np.searchsorted(y.tokens, x.tokens)
        at[at == len(y.tokens)] = 0
        same = np.flatnonzero(y.tokens[at] == x.tokens)
        both = np.zeros((LEAF, LEAF), np.int64)
        for k in range(0, len(same), PART):
            some = same[k : k + PART]
            a, b = (np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, LEAF).astype(np.float32) for h in (x.held[some], y.held[at[some]]))
            both += (a.T @ b).astype(np.int64)
        both = both[: len(x.items), : len(y.items)]
        for k, m in np.argwhere(100 * both >= percent * (x.sizes[:, None] + y.sizes - both)).tolist():
            i, j = x.items[k], y.items[m]
            if u.find(i) != u.find(j):
                u.join(i, j)
                links.append((i, j))

    if right is None and len(left) <= FAN:
        for x, i in enumerate(left):
            for j in left[x + 1 :]:
                compare(i, j)
        return links
    most = max(len(sets[i]) for i in [*left, *(right or [])])
    words = max(64, min(1024, (1 << (4 * most - 1).bit_length()) // 64))
    a = tree(sets, left, words)
    b = a if right is None else tree(sets, right, words)
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
            continue
        if x is not y:
            overlap = int(np.bitwise_count(x.bitmap & y.bitmap).sum()) + min(x.spare, y.spare)
            if 100 * overlap < percent * max(x.low, y.low):
                continue
        w = x.whole(u)
        if w is not None and w == y.whole(u):
            continue
        if x is y:
            if x.kids:
                # The last pushed is done first: each node with itself, then with the others.
                stack += [(k, m) for i, k in enumerate(x.kids) for m in x.kids[i + 1 :]]
                stack += [(k, k) for k in x.kids]
            else:
                meet(x, x)
        elif x.kids and (not y.kids or x.high >= y.high):
            stack += [(k, y) for k in x.kids]
        elif y.kids:
            stack += [(x, k) for k in y.kids]
        else:
            meet(x, y)
    return links


def _tasks(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (pod, i, j, side, id, known, tokens) with equal (pod, i, j) in a row: edges (a, b) that connect what links connect.

    Sets of side 0 meet those of side 1, or each other where there is no side 1. Sets with one
    ``known`` are one component already.
    """

    def links(t: pa.Table) -> list[tuple[int, int]]:
        side, ids, known, tokens = t["side"].to_numpy(), t["id"].to_numpy(), t["known"].to_numpy(), t["tokens"].chunk(0)
        _, keep = np.unique(np.stack([side, ids], 1), axis=0, return_index=True)
        sets, side, names = [np.frombuffer(tokens[k].as_buffer(), np.uint64) for k in keep.tolist()], side[keep], ids[keep]
        u, first = Union(len(sets)), {}
        for k, c in enumerate(known[keep].tolist()):
            u.join(first.setdefault(c, k), k)
        left, right = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
        # A star a component instead of the links themselves: no path is longer than two, which spares rounds later.
        stars: dict[int, set[int]] = {}
        for x, y in traverse(sets, left, right or None, percent, u):
            stars.setdefault(u.find(x), set()).update((int(names[x]), int(names[y])))
        return [(root, x) for held in stars.values() for root in [min(held)] for x in held if x != root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> list[tuple[int, int]]:
            t = pa.Table.from_batches(held).combine_chunks()
            return links(t) if t.num_rows > 1 else []

        for b in batches:
            if not b.num_rows:
                continue
            k = [b.column(c).to_numpy() for c in ("pod", "i", "j")]
            edge = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
            out: list[tuple[int, int]] = []
            for x, y in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows], strict=True):
                key = (k[0][x], k[1][x], k[2][x])
                if held and key != now:
                    out += done()
                    held = []
                now = key
                held.append(b.slice(x, y - x))
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        if held and (out := done()):
            pairs = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _laid(rows: DataFrame, size: Column) -> DataFrame:
    """rows (pod, band, id, n, total) with a block, a number that tells the band and a slot in it, of about ``size`` elements."""
    slots = rows.groupBy("pod", "band", "total").agg(F.sum("n").alias("_n")).select("pod", "band", F.ceil(F.col("_n") / size).alias("_slots"))
    at = F.shiftleft(F.col("band"), 32) + F.pmod(F.xxhash64("id"), F.col("_slots"))
    return rows.join(slots, ["pod", "band"]).withColumn("block", at)


def _meet(tasks: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (pod, i, j, side, id, known) of tasks (pod, i, j): left has the rows of blocks i, right those of blocks j; a block meets itself on one side."""
    one = tasks.join(left.select("pod", F.col("block").alias("i"), "id", "known"), ["pod", "i"]).select("pod", "i", "j", F.lit(0).alias("side"), "id", "known")
    two = tasks.where("i <> j").join(right.select("pod", F.col("block").alias("j"), "id", "known"), ["pod", "j"]).select("pod", "i", "j", F.lit(1).alias("side"), "id", "known")
    return one.union(two)


def link_sets(pods: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, block: int = 1 << 14, wide: int = 1 << 22, tasks: int | None = None) -> DataFrame:
    """Components (id, component) of the sets that link; sets without a link don't appear.

    pods: (pod, id, n), n the size of the set; an id may be in several. fetch: from ids (a DataFrame with
    distinct id) to (id, tokens), the sorted distinct tokens as little-endian 64-bit bytes. block: elements of a
    block in the first pass; in the second a third of the pod, from 4 * block to ``wide``. tasks: how many tasks at most write
    sets or links.
    """
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    rows = stored(pods.withColumn("band", F.floor(F.log("n") / width).cast("long")).withColumn("known", F.col("id")), "pods")
    most = rows.count()
    large = stored(rows.groupBy("pod").agg(F.sum("n").alias("total")).where(F.col("total") > block), "large-pods", most)
    cut = stored(_laid(rows.join(large, "pod"), F.lit(block)), "pod-blocks", most)
    blocks = cut.select("pod", "band", "block").distinct()
    own = blocks.select("pod", F.col("block").alias("i"), F.col("block").alias("j"))
    # About an eighth of a block of each band, by another hash, stands on the other side of its blocks.
    hub = cut.where(F.pmod(F.xxhash64("id", F.lit(1)), 8 * F.col("_slots")) == 0).withColumn("block", -2 - F.col("band"))
    near = hub.select("pod", "band", F.col("block").alias("i")).distinct()
    near = near.select("pod", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "i").join(blocks, ["pod", "band"]).select("pod", "i", F.col("block").alias("j"))
    single = rows.join(large, "pod", "left_anti").select("pod", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).alias("side"), "id", "known")

    # Both passes read the sets, which are made from their texts once.
    sets = stored(fetch(rows.select("id").distinct()), "pod-sets", tasks=tasks)

    def compare(each: DataFrame) -> DataFrame:
        each = stored(each, "pod-tasks", 4 * most)
        dealt = sets.join(each.hint("shuffle_hash"), "id").select("pod", "i", "j", "side", "id", "known", "tokens")
        return stored(dealt.repartition("pod", "i", "j").sortWithinPartitions("pod", "i", "j").mapInArrow(_tasks(percent), "a long, b long"), "set-links", tasks=tasks)

    links = compare(single.union(_meet(own, cut, cut)).union(_meet(near, hub, cut)))
    found = components(links)
    if cut.isEmpty():
        return found
    found = stored(found, "set-components", most)
    cut = cut.drop("block", "known", "_slots").join(found.withColumnRenamed("component", "known"), "id", "left").withColumn("known", F.coalesce("known", "id"))
    cut = stored(cut.select("pod", "band", "id", "n", "total", "known"), "pod-known", most)
    first = cut.groupBy("pod", "known").agg(F.count("*").alias("c")).groupBy("pod").agg(F.max_by("known", F.struct("c", "known")).alias("_first"))
    rest = cut.join(first, "pod").where("known <> _first").drop("_first")
    if rest.isEmpty():
        return found
    size = F.greatest(F.lit(4 * block), F.least(F.lit(wide), F.col("total") / 3))
    left, right = stored(_laid(rest, size), "pod-rest", most), stored(_laid(cut, size), "pod-all", most)
    x = left.select("pod", "band", F.col("block").alias("i")).distinct()
    y = right.select("pod", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("block").alias("j")).distinct()
    # The two sides are numbered apart, so that a block never counts as meeting itself.
    left, each = left.withColumn("block", -2 - F.col("block")), x.join(y, ["pod", "band"]).select("pod", (-2 - F.col("i")).alias("i"), "j")
    more = compare(_meet(each, left, right))
    # What is connected already goes in as a star a component.
    return found if more.isEmpty() else components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))


def cell_bits(size: int) -> int:
    """The power of two of cells for texts of so many bytes: 64 to 128 words a cell, so that what stands out doesn't depend on the size."""
    return min(CELL_BITS[1], max(CELL_BITS[0], round(math.log2(max(1, size) / 600))))


def _portions(b: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Rows of a batch with the sets of their texts, a block of text at a time: a task holds the sets of one, however large batches are."""
    data, offsets = buffers(b.column("text"))
    for i, j in slices(offsets):
        yield b.slice(i, j - i), shingle_sets(data, offsets[i : j + 1], n)


def sketch(docs: DataFrame, n: int, size: int) -> np.ndarray:
    """Fullness of each cell, a log scale in 8 bits: how often tokens of the cell occur in the sets of all documents.

    Each task counts for itself; its counts go by a shuffle in parts of PART cells, clipped to 16 bits, and are added up there. The
    driver gets a byte a cell. size: bytes of all texts.
    """
    spark = docs.sparkSession
    bits = cell_bits(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for _, sets in _portions(b, n):
                np.add.at(sums, np.concatenate([cells_of(s, bits) for s in sets]), np.uint32(1))
        parts = np.minimum(sums, 65535).astype(np.uint16).reshape(-1, PART)
        for k in range(0, len(parts), 16):
            some = [p.tobytes() for p in parts[k : k + 16]]
            yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(some)), pa.int32()), pa.array(some, pa.binary())], ["part", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, c in zip(b.column("part").to_pylist(), b.column("c"), strict=True):
                sums[part] = sums.get(part, np.zeros(PART, np.uint32)) + np.frombuffer(c.as_buffer(), np.uint16)
        full = [np.minimum(255, np.round(8 * np.log2(1 + c.astype(np.float32)))).astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(full, pa.binary())], ["part", "c"])

    # A few tasks a core, however many files there are, and one with large sketches: each one sends a whole sketch.
    tasks = max(1, 4 >> max(0, bits - 22)) * spark.sparkContext.defaultParallelism
    made = docs.select("text").coalesce(tasks).mapInArrow(run, "part int, c binary").repartition("part").mapInArrow(add, "part int, c binary")
    cells = np.zeros(1 << bits, np.uint8)
    for r in made.collect():
        cells[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.c, np.uint8)
    return cells


def cells_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The cells of tokens: their first bits."""
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def prefix(tokens: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    """The tokens by which a set must be found."""
    n = len(tokens)
    if not n:
        return tokens
    k = min(n, n - -(-percent * n // 100) + 1 + min(SPARE, n // EVERY))
    rank = (cells[cells_of(tokens, len(cells).bit_length() - 1)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
    return tokens[np.argpartition(rank, k - 1)[:k]]


def _runs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """From rows (token, n, id) in that order: parts (token, n, id, first) without repeated rows; a part ends with a run
    or, for a run over FEW * 64 rows, anywhere, its last row then beginning the next part.

    first marks the rows that begin a run: another token, or sizes that no longer allow a link.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(k).to_numpy() for k in ("token", "n", "id")]
        if held is not None:
            now = [np.append(x, y) for x, y in zip(held, now, strict=True)]
        t, n, i = now
        new = np.append(True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]))
        t, n, i = t[new], n[new], i[new]
        first = np.append(True, (t[1:] != t[:-1]) | (100 * n[:-1] < percent * n[1:]))
        end = int(np.flatnonzero(first)[-1])
        if len(t) - end > FEW * 64:
            yield t, n, i, first
            end = len(t) - 1
        elif end:
            yield t[:end], n[:end], i[:end], first[:end]
        held = [t[end:], n[end:], i[end:]]
    if held is not None and len(held[0]):
        yield *held, np.append(True, np.zeros(len(held[0]) - 1, bool))


def token_pods(rows: DataFrame, percent: int) -> DataFrame:
    """Pods (pod, id, n) from rows (token, n, id): the holders of each token, split where sizes no longer allow a link.

    Runs that are cut because of their length overlap in one row only, so they get one pod.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pod = None, np.int64(0)
        for t, n, i, first in _runs(batches, percent):
            first = first.copy()
            if last == (t[0], i[0]):
                first[0] = False  # goes on with the run before
            begin = np.flatnonzero(first)
            start = np.searchsorted(begin, np.arange(len(t)), "right") - 1
            names = mix(t[begin].view(np.uint64) ^ mix(n[begin].astype(np.uint64))).view(np.int64) if len(begin) else np.zeros(1, np.int64)
            pods = np.where(start >= 0, names[start], pod)
            size = np.bincount(start + 1, minlength=2)[start + 1]
            keep = (size > 1) | (start < 0)
            if last == (t[0], i[0]):
                keep[0] = False
            last, pod = (t[-1], i[-1]), pods[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(pods[keep]), pa.array(i[keep]), pa.array(n[keep])], ["pod", "id", "n"])

    by = rows.repartition("token").sortWithinPartitions("token", "n", "id")
    return by.mapInArrow(run, "pod long, id long, n long")


def token_edges(rows: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """Candidate edges (a, b) from rows (token, n, id): a shuffle by token, sorted by size within it. tasks: how many at most write a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, na, nb, c) with c tokens of few holders, and (id, token, n, -1, 0) for the holders of any other."""
        last = None
        for t, n, i, first in _runs(batches, percent):
            begin = np.flatnonzero(first)
            size = np.diff(np.append(begin, len(t)))
            cut = last == (t[0], i[0])  # the run was begun before, so it has many holders
            last = (t[-1], i[-1])
            many = np.repeat(size > FEW, size)
            if cut:
                many[: size[0]] = True
            a, b, na, nb, c = [], [], [], [], []
            few = np.flatnonzero((size > 1) & (size <= FEW) & ~many[begin])  # most tokens have one holder
            for m in np.unique(size[few]).tolist():
                at = begin[few[size[few] == m]][:, None]
                x, y = ((at + k).ravel() for k in PAIRS[m])
                ok = 100 * n[x] >= percent * n[y]
                x, y = x[ok], y[ok]
                a.append(i[x])
                b.append(i[y])
                na.append(n[x])
                nb.append(n[y])
                c.append(np.ones(len(x), np.int64))
            out = [np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (a, b, na, nb, c)]
            turn = out[0] > out[1]
            for p, q in ((0, 1), (2, 3)):
                out[p], out[q] = np.where(turn, out[q], out[p]), np.where(turn, out[p], out[q])
            many[0] &= not cut  # it ended the part before
            k = int(many.sum())
            out = [np.append(x, y) for x, y in zip(out, (i[many], t[many], n[many], np.full(k, -1), np.zeros(k, np.int64)), strict=True)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["a", "b", "na", "nb", "c"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours by size of a token's holders."""
        for _, _, i, first in _runs(batches, percent):
            at = np.flatnonzero(~first[1:]) + 1
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(i[at - 1]), pa.array(i[at])], ["a", "b"])

    def must(n: str) -> Column:
        """A set's tokens past those of its prefix, and one."""
        return F.ceil(F.col(n) * percent / 100) - F.least(F.lit(SPARE), F.floor(F.col(n) / EVERY))

    sort = lambda rows: rows.repartition("token").sortWithinPartitions("token", "n", "id")
    found = stored(sort(rows).mapInArrow(run, "a long, b long, na long, nb long, c long"), "token-pairs", tasks=tasks)
    held = found.where("nb < 0").select(F.col("b").alias("token"), F.col("na").alias("n"), F.col("a").alias("id"))
    many = stored(held.groupBy("id", "n").agg(F.count("*").alias("h")), "many-held", tasks=tasks)
    # A set whose smallest partner's spare tokens are as many has, with any partner, a token of few holders in common.
    able = many.where(F.col("h") > F.least(F.lit(SPARE), F.floor(F.ceil(F.col("n") * percent / 100) / EVERY))).select("id")
    chains = sort(held.join(able, "id").select("token", "n", "id")).mapInArrow(chain, "a long, b long")
    pairs = found.where("nb >= 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    for x in "ab":
        pairs = pairs.join(many.select(F.col("id").alias(x), F.col("h").alias("h" + x)), x, "left")
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent)) - F.greatest(must("na"), must("nb"), F.lit(1)) + 1
    both = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    return pairs.where(F.col("c") + both >= need).select("a", "b").union(chains)


def name(tokens: np.ndarray) -> tuple[int, int]:
    """A set's class: 128 bits of a hash of its sorted tokens."""
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def shingle_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    return row_groups(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def row_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, mark (a hash of its text), n (the size of its set), component_id and first.

    first: whether the row is the first of its component, that with the smallest doc_id and, of several with
    that doc_id, the smallest mark; rows equal in both are all first. Rows without a set or a doc_id are.
    """
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = few_tasks(docs.sparkSession, text_bytes)
    cells = sketch(docs, n, text_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(cells)  # a byte a cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in (x for b in batches for x in _portions(b, n)):
            size, one, two, first = [], [], [], []
            for s in sets:
                k1, k2 = name(s)
                size.append(len(s))
                one.append(k1)
                two.append(k2)
                first.append(prefix(s, shared.value, percent).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists], ["doc_id", "mark", "n", "k1", "k2", "prefix"])

    made = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, n long, k1 long, k2 long, prefix array<long>")
    made = stored(made, "shingles")
    classes = made.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.count("*").alias("rows")).withColumn("id", F.col("at.doc_id"))
    # A class is named by its smallest doc_id, or by a hash where several classes have that one (rows that repeat a doc_id).
    several = classes.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id", F.lit(True).alias("several"))
    classes = stored(classes.join(several, "id", "left").select("k1", "k2", "n", "id", "at", "rows", F.when(F.col("several"), F.xxhash64("k1", "k2", "id")).otherwise(F.col("id")).alias("node")), "classes", tasks=tasks)
    firsts = classes.select(F.col("id").alias("doc_id"), "k1", "k2", "node")
    rows = made.where("n > 0").select("doc_id", "k1", "k2", "n", "prefix").join(firsts, ["doc_id", "k1", "k2"])
    edges = token_edges(rows.select(F.explode("prefix").alias("token"), "n", F.col("node").alias("id")), percent, tasks)

    most = classes.count()

    def fetch(ids: DataFrame) -> DataFrame:
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, each in (x for b in batches for x in _portions(b, n)):
                held = list(each)
                # Of rows that repeat a doc_id only those of the class count.
                own = [k for k, want in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True)) if name(held[k]) == want]
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(own, pa.int64())), pa.array([held[k].tobytes() for k in own], pa.binary())], ["id", "tokens"])

        wanted = stored(firsts.join(ids.select(F.col("id").alias("node")), "node", "left_semi"), "wanted-sets", most)
        return docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id").mapInArrow(sets, "id long, tokens binary")

    sizes = classes.select(F.col("node").alias("id"), "n")
    pods = components(edges, tasks=tasks).withColumnRenamed("component", "pod").join(sizes, "id").select("pod", "id", "n")
    groups = link_sets(pods, fetch, percent, tasks=tasks).withColumnRenamed("id", "node")
    both = stored(classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "class-groups")
    least = both.groupBy("component").agg(F.min("at").alias("least"))
    named = both.join(least, "component").select("k1", "k2", "rows", "least")
    total = max(1, made.count())
    part = made.where("n > 0 and doc_id is not null").select("doc_id", "mark", "n", "k1", "k2")
    out = join_by_size(part, named, ["k1", "k2"], "rows", total)
    out = out.select("doc_id", "mark", "n", F.col("least.doc_id").alias("component_id"), ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))).alias("first"))
    return out.union(made.where("n = 0 or doc_id is null").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))).coalesce(tasks)


def drop_near(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component: the one with the smallest doc_id stays (see row_groups).

    Rows without words or without a doc_id stay, all of them; of rows equal in doc_id and text one stays.
    """
    rows = stored(row_groups(docs, n, percent).where("n > 0 and doc_id is not null").select("doc_id", "mark", "first"), "near-rows")
    of = rows.groupBy("doc_id", "mark").agg(F.first("first").alias("first"), F.count("*").alias("c")).where("not first or c > 1")
    names = fresh_names(docs, "mark", "first")
    of = of.select(F.col("doc_id").alias(names[0] + "d"), F.col("mark").alias(names[0]), F.col("first").alias(names[1]))
    each = docs.join(of, (docs["doc_id"] == F.col(names[0] + "d")) & (F.xxhash64(docs["text"]) == F.col(names[0])), "left")
    # What is left of the flagged rows is equal in doc_id and text, and one of each stays.
    again = each.where(F.col(names[1])).dropDuplicates([names[0] + "d", names[0]])
    own = [docs[c] for c in docs.columns]
    return each.where(F.col(names[1]).isNull()).select(*own).union(again.select(*own))
