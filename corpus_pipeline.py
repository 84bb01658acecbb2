"""A corpus pipeline of five stages: toxic documents go, exact copies go, one document of each near-duplicate
group stays, sources are mixed to target weights, and what remains is packed into sequences.

Cases, for every stage: columns that documents doesn't have pass through unread, whatever their names, up to the last stage; an
empty table gives an empty result; texts of any length are read whole. Null and empty texts: scored like a text without known
words; equal to each other; near copies of nothing; without words, so the mix takes them by count alone; one end id
when packed. Null doc_ids: scored like others; lowest of equal texts; near copies of nothing; mixed and packed like others. Rows that
repeat a doc_id are told apart by their texts; rows equal in both become one, but for the mix, which takes each as often as its share
says. Ties: the largest doc_id of equal texts stays, and the smallest of near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import exact, jaccard, mixing, packing, toxicity
from quarry.llm.common import fresh_names, scratch
from quarry.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by the classifier stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles with a similarity of 0.8 connect, the smallest doc_id stays."""
    return jaccard.drop_near(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times); words near each source's target."""
    # Rows with one mark are equal in doc_id, source and text; their copies differ by one at most.
    mark, low, more, row, copies, copy = fresh_names(docs, "mark", "low", "more", "row", "copies", "copy")
    least, total = F.min("copies"), F.sum("copies")
    taken = mixing.mix(docs).groupBy(F.col("mark").alias(mark)).agg(least.alias(low), (total - least * F.count("*")).alias(more)).where(f"{low} > 0 or {more} > 0")
    each = docs.withColumn(mark, mixing.mark()).join(taken, mark)
    each = each.withColumn(row, F.row_number().over(Window.partitionBy(mark).orderBy(mark)))
    each = each.withColumn(copies, (F.col(low) + (F.col(row) <= F.col(more)).cast("int")).cast("int")).where(f"{copies} > 0")
    return each.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the packing can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
