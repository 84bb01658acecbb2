"""Inverted index with field weights: postings, lengths and idf as stored columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import stem, tokens
from quarry.operators.sizes import small

K1, B = 1.2, 0.75
#: Weight of a term by field; an item's description weighs 1 and adds no length.
WEIGHTS = {"name": 3.0, "element": 3.0, "variant": 2.0, "description": 2.0, "labels": 2.0, "about": 1.0, "category": 1.0, "domain": 1.0, "keywords": 3.0, "contains": 1.0, "listed": 0.5}
FIELDS = list(WEIGHTS)


def _prefixed(values: Column, prefix: str) -> Column:
    return F.transform(F.array_distinct(values), lambda x: F.concat(F.lit(f"{prefix}:"), x))


def postings(docs: DataFrame, doc: str, fields: dict[str, str], tags: list[tuple[str, str, Column]] = (), only: DataFrame | None = None) -> DataFrame:
    """Postings (term, doc, tf100, mask): length-normalised term frequencies in hundredths, and the fields as bits.

    fields maps a field to its text column; tags are (field, prefix, array column), whole tags that become prefix:tag.
    only: a small table (term) of the terms that are wanted, such as those of a query.

    Documents are tokenized, and their terms counted, where they lie: a row's words are sorted and runs of equal ones added up, so
    nothing is shuffled and no task keeps a table of terms. The averages are a row a kind. Only where documents have several rows
    (looked for by their ids) are counts added up by a shuffle.
    """
    kind = F.col("kind") if "kind" in docs.columns else F.lit("entry")
    own = docs.select(F.col(doc).alias("doc"), kind.alias("kind"), *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t_{f}") for f, c in fields.items()], *[F.coalesce(_prefixed(v, p), F.array().cast("array<string>")).alias(f"g_{f}") for f, p, v in tags])
    note = lambda f: (F.col("kind") == "item") & F.lit(f == "description")
    parts, length, count = [], F.lit(0.0), F.lit(0)
    for f, name, words in [*((f, f"t_{f}", True) for f in fields), *((f, f"g_{f}", False) for f, _, _ in tags)]:
        weight = F.when(note(f) & F.lit(words), 1.0).otherwise(WEIGHTS[f])
        parts.append(_weighed(name, words, weight, 1 << FIELDS.index(f)))
        count = count + F.size(name)
        length = length + F.when(note(f) & F.lit(words), 0.0).otherwise(WEIGHTS[f]) * F.size(name)
    own = own.withColumn("len", length)
    # No filter on what is made from the words: Spark would move it below, and tokenize for it once more.
    average = own.groupBy("kind").agg(F.greatest(F.avg(F.when(count > 0, F.col("len"))), F.lit(1.0)).alias("avg"))
    each = own.select("doc", "kind", "len", F.sort_array(F.concat(*parts)).alias("s")).withColumn("bounds", _bounds(F.col("s")))
    tf = each.select("doc", "kind", "len", F.explode(_runs(F.col("s"), F.col("bounds"))).alias("r")).select("doc", "kind", "len", "r.*")
    if only is not None:
        tf = tf.join(small(only.select("term").distinct()), "term", "left_semi")
    if not docs.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        tf = tf.groupBy("doc", "kind", "len", "term").agg(F.sum("w").alias("w"), F.bit_or("mask").alias("mask"))
    tf = tf.join(F.broadcast(average), "kind")
    norm = 1 - B + B * F.col("len") / F.col("avg")
    return tf.select("term", "doc", F.greatest(F.lit(1), F.floor(100 * F.col("w") / norm + 0.5)).cast("int").alias("tf100"), F.col("mask").cast("int"))


def _weighed(values: str, words: bool, weight: Column, bit: int) -> Column:
    return F.transform(values, lambda x: F.struct((stem(x) if words else x).alias("term"), weight.alias("weight"), F.lit(bit).alias("bit")))


def _bounds(s: Column) -> Column:
    """Where runs of one term begin in sorted structs (term, weight, bit), and the size after the last."""
    at = lambda i: F.get(s, i)["term"]
    return F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | ~at(i).eqNullSafe(at(i - 1)))


def _runs(s: Column, bounds: Column) -> Column:
    """struct(term, w, mask) for each run: weights added up, bits joined."""
    n = F.size(bounds) - 1
    runs = F.zip_with(F.slice(bounds, F.lit(1), n), F.slice(bounds, F.lit(2), n), lambda i, j: F.slice(s, i + 1, j - i))
    w = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y["weight"])
    mask = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a.bitwiseOR(y["bit"]))
    return F.transform(runs, lambda x: F.struct(F.get(x, F.lit(0))["term"].alias("term"), w(x).alias("w"), mask(x).alias("mask")))


def lengths(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, len): words of a text column."""
    return docs.select(F.col(doc).alias("doc"), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("len"))


def idf(postings: DataFrame, n_docs: int) -> DataFrame:
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def delta(postings: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Postings with the gap to the term's previous document, for compact storage.

    Documents are numbers of 0 and more. A window holds a term's documents of one span of ids, so no term is one task; the first of a
    span takes the last document before it from a table with a row for each term and span, made from the same shuffle.
    """
    # The two readers of this shuffle need the same columns and rows of it, or it would be made, and texts tokenized, twice.
    part = postings.where("doc is not null and term is not null").withColumn("span", F.floor(F.col("doc") / span)).repartition("term", "span")
    ends = part.groupBy("term", "span").agg(F.max("doc").alias("last"))
    ends = ends.select(F.col("term").alias("_term"), F.col("span").alias("_span"), F.lag("last").over(Window.partitionBy("term").orderBy("span")).alias("before"))
    prev = F.lag("doc").over(Window.partitionBy("term", "span").orderBy("doc"))
    own = part.withColumn("prev", prev).join(ends, (F.col("term") == F.col("_term")) & (F.col("span") == F.col("_span")), "left")
    gap = F.col("doc") - F.coalesce("prev", "before", F.lit(0))
    return own.select("term", "doc", "tf100", F.lower(F.conv(gap.cast("string"), 10, 36)).alias("gap36"))


def pack(postings: DataFrame) -> DataFrame:
    """(term, packed): a term's postings as text, gap:frequency in base 36, in document order; unpack() gives them back."""
    one = delta(postings).select("term", "doc", F.concat("gap36", F.lit(":"), F.lower(F.conv(F.col("tf100").cast("string"), 10, 36))).alias("p"))
    return one.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", "p"))), lambda x: x["p"]), " ").alias("packed"))


def unpack(packed: DataFrame) -> DataFrame:
    """(term, doc, tf100) of packed postings."""
    each = packed.select("term", F.posexplode(F.split("packed", " ")).alias("pos", "p"))
    each = each.select("term", "pos", F.conv(F.split_part("p", F.lit(":"), F.lit(1)), 36, 10).cast("long").alias("gap"), F.conv(F.split_part("p", F.lit(":"), F.lit(2)), 36, 10).cast("int").alias("tf100"))
    return each.select("term", F.sum("gap").over(Window.partitionBy("term").orderBy("pos")).alias("doc"), "tf100")
