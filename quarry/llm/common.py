"""Shared folder, stored intermediates and connected components.

Every intermediate that is read more than once is written as Parquet to the folder that
``spark.checkpoint.dir`` names. Losing an executor then costs only the tasks that it ran.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of small tables that one task writes, and edges whose components one task finds.
FEW_ROWS = 250_000
#: Bytes of text of which one task at most writes what is made from them, where there is more than two tasks a core have.
SHARE = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. There is no other folder that driver and executors are sure to share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def few_tasks(spark: SparkSession, size: int) -> int:
    """How many tasks write what is made from so many bytes of text: two a core, and more where each would have over SHARE."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // SHARE))


def stored(df: DataFrame, name: str, most: int | None = None, tasks: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and is computed once.

    most: how many rows there can be, where that is known. They are then written by a task for each quarter of a million, so that
    small tables are few files; the last stage runs in as many tasks. tasks: how many there are at most, where ``most`` is not known.
    """
    path = scratch(df.sparkSession, name)
    schema = df.schema
    if most is not None:
        df = df.coalesce(max(1, most // FEW_ROWS))
    elif tasks is not None:
        df = df.coalesce(tasks)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders through Hadoop's file system, so that it works for any shared folder."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each after as many underscores as keep all of them apart from df's own columns."""
    have, lead = {c.lower() for c in df.columns}, "_"
    while any(c.startswith(lead + n) for c in have for n in names):
        lead += "_"
    return [lead + n for n in names]


def parts_for(df: DataFrame, target: int = 64 << 20) -> int:
    """How many tasks of about target bytes df makes by Catalyst's estimate, the session's shuffle partitions at least.

    Plans without statistics, such as rows handed over by the driver, are estimated at exabytes; they get the minimum.
    """
    size, least = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 50 else max(least, size // target)


def join_by_size(rows: DataFrame, keyed: DataFrame, on: list[str], size: str, total: int, parts: int = 1000) -> DataFrame:
    """rows joined with keyed on equal columns ``on``, where keyed's column size says how many of the total rows have its key.

    Fewer than ``parts`` keys can hold over total / parts rows each, so those are broadcast, however large the
    tables are, and their rows stay where they are; all others meet by a shuffle.
    """
    hot, rest = (keyed.where(x) for x in (F.col(size) * parts > total, F.col(size) * parts <= total))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest.hint("merge"), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def path_of(df: DataFrame) -> str:
    """The folder of a stored DataFrame."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def connect(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the edges (u, v) connect as stars: every node but the smallest of its component, and that one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up, a, b = np.arange(len(ids)), at[: len(u)], at[len(u) :]
    while len(a):
        # Both ends are roots; of all roots with a smaller neighbour none stays, so at least half of those that have neighbours go.
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    far = np.flatnonzero(up != np.arange(len(ids)))
    return ids[far], ids[up[far]]


def stars(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as stars. Memory is in proportion to its nodes."""
    held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n > limit:
            held = [connect(*map(np.concatenate, zip(*held, strict=True)))]
            n = len(held[0][0])
            limit = max(limit, 2 * n)
    u, v = connect(*map(np.concatenate, zip(*held, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW_ROWS, tasks: int | None = None) -> DataFrame:
    """Connected components of the undirected edges (a long, b long): rows (id, component), component the smallest id.

    Each task first turns the edges that it has into stars. At most ``few`` of them are connected by one task; while there are more,
    large-star and small-star alternate, each a keyed minimum plus a join, on a written table a
    round. Nothing but the number of edges and a checksum reaches the driver. A hub with many
    neighbours is pre-aggregated by the minimum and can be split by AQE in the join. Edges with a
    null end are ignored. Raises if ``rounds`` are not enough (they grow with the logarithm of
    the longest path). tasks: in how many tasks the edges are read at most.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    e = stored((e.coalesce(tasks) if tasks else e).mapInArrow(stars, "u long, v long"), "components")
    n, mark = e.count(), None
    for _ in range(rounds):
        if n <= few:
            last, e = e, stored(e.coalesce(1).mapInArrow(stars, "u long, v long"), "components", n)
            remove(spark, *([path_of(last)] if last.inputFiles() else []))
            break
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        pairs = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        # A round makes no more edges than there were, but for one to its smallest neighbour for each node.
        nxt = stored(pairs.where("u > v").distinct().coalesce(max(1, 2 * n // FEW_ROWS)).mapInArrow(stars, "u long, v long"), "components")
        row = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        remove(spark, *([path_of(e)] if e.inputFiles() else []))
        e, last, mark, n = nxt, mark, (row.n, row.s), row.n
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
