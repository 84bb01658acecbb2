"""Exact deduplication with an extendible-hash index on shared files (DataFrame functions only).

The index maps a 64-bit key of a text to a bucket, the range of keys that begin with the same ``depth`` bits. Each
bucket's entries lie together in one file, sorted by key, and one task owns them. An entry is a distinct text: its
key, length, SHA-256, largest doc_id and number of rows. The directory tells each bucket's depth and
number of entries. It starts with as many slots as the number of rows asks for and doubles as long as a bucket
holds more than ``capacity`` entries: such a bucket is split by the next bit of its keys, which
rewrites that bucket's entries alone. A bucket whose entries all have one key can't be split and stays
overfull, so there is no greatest depth but the 64 bits of a key.

Owners chain the entries of one key. Rows meet as one entry if key, length and SHA-256 agree. Where
one key has several entries, that is, where keys collide, the texts themselves are fetched and compared byte by byte.
Texts are shuffled for such keys only. Equal rows are counted before the shuffle, so a group of copies with a
third of all rows adds one row a map task.

Cases: null text counts as empty; null doc_ids sort below all others; of rows that repeat both text
and doc_id exactly one is kept; ties can't occur otherwise, since the largest doc_id stays; texts of any length are hashed
whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh_names, join_by_size, stored

#: Entries in a bucket; 128 Ki of them make about 10 MB.
CAPACITY = 1 << 17
Key = Callable[[Column], Column]


def slot(key: Column, depth: int) -> Column:
    """The first depth bits of a 64-bit key, as an unsigned number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


@dataclass
class Index:
    """directory: (depth, bucket, entries, low, high), low and high the bucket's least and largest key. entries: (depth, bucket, key, chain, sha, length, keep_id, group_size)."""

    directory: DataFrame
    entries: DataFrame


def _rows(docs: DataFrame, key: Key, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", key(body).alias("key"), F.unhex(F.sha2(body, 256)).alias("sha"), F.octet_length(body).alias("length"))


def _bucket_files(entries: DataFrame, depth: int) -> DataFrame:
    """entries in the bucket files of this depth: one task owns a bucket and writes it sorted."""
    placed = entries.withColumn("bucket", slot(F.col("key"), depth)).withColumn("depth", F.lit(depth))
    return stored(placed.repartition("bucket").sortWithinPartitions("bucket", "key", "sha"), "exact-buckets")


def build_index(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", key: Key = F.xxhash64) -> Index:
    """The index of the texts. ``key`` may replace the hash of a text (tests let keys collide)."""
    depth = max(0, math.ceil(math.log2(max(1, docs.count()) / capacity)))
    by = ["bucket", "key", "sha", "length"]
    rows = _rows(docs, key, text).withColumn("bucket", slot(F.col("key"), depth))
    rest = _bucket_files(rows.groupBy(*by).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), depth)
    files, directory = [], []
    while True:
        held = stored(rest.groupBy("depth", "bucket").agg(F.count("*").alias("entries"), F.min("key").alias("low"), F.max("key").alias("high")), "exact-directory")
        over = (F.col("entries") > capacity) & (F.col("low") < F.col("high")) & (F.col("depth") < 64)
        full = held.where(over).select("bucket")
        directory.append(held.where(~over))
        if full.isEmpty():
            files.append(rest)
            break
        files.append(rest.join(full, "bucket", "left_anti"))
        depth += 1
        rest = _bucket_files(rest.join(full, "bucket", "left_semi"), depth)
    entries, slots = files[0], directory[0]
    for more, at in zip(files[1:], directory[1:], strict=True):
        entries, slots = entries.unionByName(more), slots.unionByName(at)
    entries = _compared(docs, entries, key, text)
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha", "length"))
    return Index(slots, entries.join(slots.select("depth", "bucket"), ["depth", "bucket"]).withColumn("chain", chain))


def _compared(docs: DataFrame, entries: DataFrame, key: Key, text: str) -> DataFrame:
    """entries, those of colliding keys told apart by the bytes of their texts."""
    met = stored(entries.groupBy("depth", "bucket", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "exact-collisions")
    if met.isEmpty():
        return entries
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select("doc_id", key(body).alias("key"), body.alias("body")).join(met, "key")
    told = texts.groupBy("depth", "bucket", "key", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    told = told.withColumns({"sha": F.unhex(F.sha2("body", 256)), "length": F.octet_length("body")}).drop("body")
    return entries.join(met, ["depth", "bucket", "key"], "left_anti").unionByName(told)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key: Key = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays."""
    found = stored(build_index(docs, capacity, "text", key).entries, "exact-index")
    # Rows that repeat a doc_id and a text are counted first, so that one of them stays.
    rows = stored(_rows(docs, key, "text").groupBy("key", "sha", "doc_id").agg(F.count("*").cast("int").alias("n")), "exact-rows")
    total = max(1, rows.count())
    each = join_by_size(rows, found.select("key", "sha", "keep_id", "group_size"), ["key", "sha"], "group_size", total)
    each = each.select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, all their columns, through one shuffle of the texts. Rows that repeat the kept doc_id and text are reduced to one."""
    key, sha, keep = fresh_names(docs, "key", "sha", "keep")
    stay = build_index(docs, capacity).entries.select(F.col("key").alias(key), F.col("sha").alias(sha), F.col("keep_id").alias(keep))
    body = F.coalesce(docs["text"], F.lit(""))
    own = docs.withColumn(key, F.xxhash64(body)).withColumn(sha, F.unhex(F.sha2(body, 256)))
    # doc_id is part of the key, so that the copies of one text don't meet in one task.
    kept = own.join(stay.withColumnsRenamed({key: key + "2", sha: sha + "2"}), (F.col(key) == F.col(key + "2")) & (F.col(sha) == F.col(sha + "2")) & docs["doc_id"].eqNullSafe(F.col(keep)), "left_semi")
    return kept.dropDuplicates([key, sha, "doc_id"]).select(*docs.columns)
