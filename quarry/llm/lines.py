"""Line deduplication with sharded cuckoo filters backed by exact reference counts.

``LineIndex`` keeps three things a shard of the keys of lines, in the shared folder: the holders (key, doc_id), which are the
exact references; the counts (key, refs, last_doc) of the keys with ``min_docs`` references or more; and a
cuckoo filter of these keys. The filters answer which lines need the exact table at all; they have no false
negatives, and the join with the table removes the false positives. Shards are as many as the number of lines asks for,
about ``shard_lines`` each; the holders of a shard that a very common line makes large lie in several files.

Documents can be inserted and deleted. That reads and writes the shards of their lines alone: their holders change,
keys that reach the limit are inserted into the shard's filter, keys that fall below it are deleted from it. An
update writes a new version of these shards beside the old one, so an index stays as it is while a later
one is made from it, and a lost executor costs only its tasks.

Cases: null or empty text is one empty line; rows that repeat a doc_id are one document for the counts, whether their texts
differ or not, and each keeps or loses its own lines; rows with a null doc_id keep their lines and count nowhere; lines of
any length and number are read whole; of equal lines all but those of the largest doc_id go, also where one document
repeats a line; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import join_by_size, scratch, stored
from quarry.llm.files import open_table, place

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports insert, delete and lookup, all on arrays of 64-bit keys."""

    SLOTS = 4

    def __init__(self, keys: int = 0, table: np.ndarray | None = None) -> None:
        size = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / self.SLOTS / 0.8))))
        self.table = np.zeros((size, self.SLOTS), np.uint16) if table is None else table
        self.rng = np.random.default_rng(7)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys, np.uint64)
        print_ = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = keys % np.uint64(len(self.table))
        return print_, one.astype(np.int64), self._other(one.astype(np.int64), print_)

    def _other(self, place, print_):
        step = (np.asarray(print_).astype(np.int64) * 0x5BD1E995) % len(self.table)
        return np.asarray(place) ^ step

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self._places(keys)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    def _fill(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Puts each print into a free slot of its bucket; which ones found none."""
        order = np.argsort(at, kind="stable")
        p = at[order]
        first = np.append(True, p[1:] != p[:-1])
        rank = np.arange(len(p)) - np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
        free = np.cumsum(self.table[p] == 0, axis=1)
        ok = free[:, -1] > rank
        self.table[p[ok], np.argmax(free[ok] == rank[ok, None] + 1, axis=1)] = prints[order][ok]
        out = np.zeros(len(p), bool)
        out[order] = ~ok
        return out

    def insert(self, keys: np.ndarray) -> None:
        """Adds keys that are not in it: into free slots first, then by moving others on. Raises if it is full."""
        if not len(keys):
            return
        f, a, b = self._places(keys)
        left = np.arange(len(f))
        for at in (a, b):
            left = left[self._fill(at[left], f[left])] if len(left) else left
        for mine, at in zip(f[left], a[left].tolist(), strict=True):
            for _ in range(500):
                k = int(self.rng.integers(self.SLOTS))
                mine, self.table[at, k] = self.table[at, k], mine
                at = int(self._other(at, mine))
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mine
                    break
            else:
                raise OverflowError("the cuckoo filter is full")

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted."""
        for f, a, b in zip(*self._places(keys), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == f)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.save(out, self.table)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.load(io.BytesIO(data)))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        n = len(keys)
        while True:
            try:
                made = cls(n)
                made.insert(keys)
                return made
            except OverflowError:
                n = max(16, n * 2)


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line its 16-byte key, or None if the stripped line is shorter than min_chars."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        s = line.strip(STRIP)
        # bytes.lower() changes A-Z only
        out.append(hashlib.md5(s.encode("utf-8", "surrogatepass").lower(), usedforsecurity=False).digest() if len(s) >= min_chars else None)
    return out


def _shards(keys: list[bytes], shards: int) -> np.ndarray:
    """The shard of each key, from its bytes 8 to 12."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    return raw[:, 8:12].copy().view(">u4").ravel().astype(np.int64) % shards


def _numbers(keys: list[bytes]) -> np.ndarray:
    """The first 8 bytes of each key as a 64-bit number, by which the filters know it."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    return raw[:, :8].copy().view(">u8").ravel().astype(np.uint64)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id) of the distinct keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if d is not None:
                    found = {k for k in line_keys(t, min_chars) if k}
                    keys += found
                    ids += [d] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "key binary, doc_id long")


def _sharded(lines: DataFrame, shards: int) -> DataFrame:
    return lines.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int"))


HOLDERS = "key binary, doc_id long, shard int"
COUNTS = "key binary, refs long, last_doc long, shard int"


@dataclass(frozen=True)
class LineIndex:
    """Exact reference counts and cuckoo filters of the lines of a corpus. versions: the version of each shard that isn't 0."""

    spark: SparkSession
    at: str
    shards: int
    min_docs: int
    min_chars: int
    shard_lines: int
    version: int = 0
    versions: dict[int, int] = field(default_factory=dict)

    @classmethod
    def build(cls, docs: DataFrame, shards: int | None = None, min_docs: int = 3, min_chars: int = 20, shard_lines: int = 1 << 19) -> LineIndex:
        lines = stored(_lines(docs, min_chars), "line-keys")
        shards = shards or max(1, -(-lines.count() // shard_lines))
        made = cls(docs.sparkSession, scratch(docs.sparkSession, "line-index"), shards, min_docs, min_chars, shard_lines)
        made._write_holders(_sharded(lines, shards))
        made._write_counts(made._counted(made._read("holders", HOLDERS)).withColumn("step", F.lit(1)), {})
        return made

    def _read(self, kind: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """A table of all shards, or of some, each in its version."""
        out = None
        for v in sorted({0, *self.versions.values()}):
            rows = self.spark.read.schema(schema).parquet(f"{self.at}/v{v}/{kind}")
            later = [s for s, at in self.versions.items() if at != v]
            rows = rows.where(~F.col("shard").isin(later)) if v == 0 else rows.where(F.col("shard").isin([s for s, at in self.versions.items() if at == v]))
            rows = rows.where(F.col("shard").isin(only)) if only is not None else rows
            out = rows if out is None else out.unionByName(rows)
        return out

    @property
    def counts(self) -> DataFrame:
        """(key, refs, last_doc) of all keys, counted from the holders."""
        return self._read("holders", HOLDERS).groupBy("key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last_doc"))

    @property
    def heavy(self) -> DataFrame:
        """(key, refs, last_doc, shard) of the keys with min_docs references or more, as stored."""
        return self._read("counts", COUNTS)

    def _write_holders(self, rows: DataFrame) -> None:
        """Distinct (key, doc_id) into this version's shards. A task gets about shard_lines rows: a shard with more is dealt by doc_id."""
        sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / self.shard_lines).alias("files"))
        dealt = rows.join(sizes, "shard").withColumn("file", F.pmod(F.xxhash64("doc_id"), F.col("files")))
        dealt = dealt.repartition("shard", "file").dropDuplicates(["shard", "file", "key", "doc_id"])
        dealt.select("key", "doc_id", "shard").write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.at}/v{self.version}/holders")

    def _counted(self, holders: DataFrame) -> DataFrame:
        return holders.groupBy("shard", "key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last_doc")).where(F.col("refs") >= self.min_docs)

    def _write_counts(self, rows: DataFrame, old: dict[int, int]) -> None:
        """Counts and filters of this version's shards from rows (shard, key, refs, last_doc, step).

        step: 1 for a key that is new to the shard's filter, 0 for one that is in it, -1 for one that leaves.
        old: the versions of the filters to begin with; those of other shards begin empty.
        """
        at, version = self.at, self.version

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, keys, steps = None, [], []

            def done() -> None:
                number, step = _numbers(keys), np.array(steps)
                before = open_table(f"{at}/v{old[now]}/filters")(now) if now in old else None
                try:
                    made = CuckooFilter.loads(before) if before is not None else CuckooFilter.of(np.zeros(0, np.uint64)) if now in old else CuckooFilter(len(keys))
                    made.delete(number[step < 0])
                    made.insert(number[step > 0])
                except OverflowError:  # it doubles
                    made = CuckooFilter.of(number[step >= 0])
                place(f"{at}/v{version}/filters", str(now), lambda out: out.write(made.dumps()))

            for b in batches:
                shard = b.column("shard").to_numpy()
                edge = np.flatnonzero(shard[1:] != shard[:-1]) + 1
                for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(shard)], strict=True):
                    if x == y:
                        continue
                    if now is not None and now != shard[x]:
                        done()
                        keys, steps = [], []
                    now = int(shard[x])
                    keys += b.column("key").slice(x, y - x).to_pylist()
                    steps += b.column("step").slice(x, y - x).to_pylist()
                yield b.filter(pa.array(b.column("step").to_numpy() >= 0)).select(["key", "refs", "last_doc", "shard"])
            if now is not None:
                done()

        rows = rows.select("key", "refs", "last_doc", "shard", "step").repartition("shard").sortWithinPartitions("shard", "key")
        rows.mapInArrow(run, COUNTS).write.partitionBy("shard").option("compression", "zstd").parquet(f"{at}/v{version}/counts")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with these documents. References that are there already stay as they are."""
        return self._updated(docs, lambda held, delta: held.unionByName(delta).distinct())

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the references of these documents (doc_id and text as they were inserted)."""
        return self._updated(docs, lambda held, delta: held.join(delta, ["shard", "key", "doc_id"], "left_anti"))

    def _updated(self, docs: DataFrame, change) -> LineIndex:
        delta = stored(_sharded(_lines(docs, self.min_chars), self.shards).distinct(), "line-delta").select("key", "doc_id", "shard")
        touched = sorted(r.shard for r in delta.select("shard").distinct().collect())  # numbers of shards
        if not touched:
            return self
        out = replace(self, version=self.version + 1, versions=self.versions | dict.fromkeys(touched, self.version + 1))
        out._write_holders(change(self._read("holders", HOLDERS, touched), delta))
        keys = delta.select("shard", "key").distinct()
        before = self._read("counts", COUNTS, touched).join(keys.withColumn("hit", F.lit(True)), ["shard", "key"], "left")
        after = out._counted(out._read("holders", HOLDERS, touched).join(keys, ["shard", "key"], "left_semi"))
        after = after.select("shard", "key", F.col("refs").alias("r"), F.col("last_doc").alias("l"))
        both = before.join(after, ["shard", "key"], "full")
        step = F.when(F.col("refs").isNull(), 1).when(F.col("hit") & F.col("r").isNull(), -1).otherwise(0)
        rows = both.select("shard", "key", F.coalesce("r", "refs").alias("refs"), F.coalesce("l", "last_doc").alias("last_doc"), step.alias("step"))
        old = {s: self.versions.get(s, 0) for s in touched}
        out._write_counts(stored(rows, "line-steps"), old)
        return out

    def candidates(self, docs: DataFrame, memory: int = 256 << 20) -> DataFrame:
        """(doc_id, mark, line, key) of the lines that a filter holds; mark tells rows with one doc_id apart.

        A task keeps filters it has read, up to ``memory`` bytes, and rereads those beyond.
        """
        at, min_chars, shards, versions = self.at, self.min_chars, self.shards, self.versions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: OrderedDict[int, CuckooFilter | None] = OrderedDict()
            size = 0

            def filter_of(s: int) -> CuckooFilter | None:
                nonlocal size
                if s not in held:
                    data = open_table(f"{at}/v{versions.get(s, 0)}/filters")(s)
                    held[s] = None if data is None else CuckooFilter.loads(data)
                    size += len(data or b"")
                    while size > memory and len(held) > 1:
                        gone = held.popitem(last=False)[1]
                        size -= gone.table.nbytes if gone else 0
                held.move_to_end(s)
                return held[s]

            for b in batches:
                ids, marks, lines, keys = [], [], [], []
                for d, m, t in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if d is not None:
                        for i, k in enumerate(line_keys(t, min_chars)):
                            if k:
                                ids.append(d)
                                marks.append(m)
                                lines.append(i)
                                keys.append(k)
                if not keys:
                    continue
                number, shard = _numbers(keys), _shards(keys, shards)
                hit = np.zeros(len(keys), bool)
                order = np.argsort(shard, kind="stable")
                edge = np.flatnonzero(np.diff(shard[order])) + 1
                for mine in np.split(order, edge):
                    made = filter_of(int(shard[mine[0]]))
                    if made is not None:
                        hit[mine] = made.contains(number[mine])
                i = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[i], pa.int64()), pa.array(np.array(marks)[i], pa.int64()), pa.array(np.array(lines)[i], pa.int32()), pa.array([keys[j] for j in i], pa.binary())], ["doc_id", "mark", "line", "key"])

        return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, line int, key binary")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs' doc_id with n_lines, n_dropped and the text that stays. Lines with min_docs references lose all their places but those in the largest doc_id."""
        found = stored(self.candidates(docs), "line-candidates")
        total = max(1, docs.count())
        drops = join_by_size(found, self.heavy.select("key", "refs", "last_doc"), ["key"], "refs", total).where(F.col("doc_id") != F.col("last_doc"))
        drops = drops.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("drop"))
        lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
        both = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(drops, ["doc_id", "mark"], "left").withColumn("lines", lines)
        stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
        kept = F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
        return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"), kept.alias("text"))
