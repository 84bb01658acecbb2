"""Long documents: a splitter, section terms and ranking, windows over hits, line and budget operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import non_latin_share, stem, tokens

_HEAD = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_FENCE = re.compile(r"^\s*(```|~~~)")


def split_text(text: str, small: int = 200, large: int = 12_000, chunk: int = 3000) -> list[dict]:
    """Sections of a document: at headings outside code fences and at --- lines; small ones join the next of the
    same or a deeper level, large ones are cut at line ends into chunks."""
    at, fence, cuts, trail = 0, None, [], []
    source = None
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        f = _FENCE.match(bare)
        if f:
            fence = None if fence == f[1] else fence or f[1]
        elif fence is None:
            if h := _HEAD.match(bare):
                depth = len(h[1])
                trail = [(d, t) for d, t in trail if d < depth] + [(depth, h[2])]
                cuts.append([at, depth, h[2], [t for _, t in trail], source])
            elif bare == "---":
                cuts.append([at, 0, "", [], source])
            elif m := re.match(r"^(?:Source|URL):\s*(\S+)", bare):
                source = m[1]
                if cuts and at - cuts[-1][0] < small:
                    cuts[-1][4] = source
        at += len(line)
    if not cuts or cuts[0][0] > 0:
        cuts.insert(0, [0, 0, "", [], None])
    ends = [c[0] for c in cuts[1:]] + [len(text)]
    merged: list[list] = []
    for c, end in zip(cuts, ends, strict=True):
        if merged and merged[-1][5] - merged[-1][0] < small and (c[1] == 0 or c[1] >= merged[-1][1]):
            merged[-1][5] = end
        else:
            merged.append([*c, end])
    out = []
    for start, depth, title, path, src, end in merged:
        pieces = [(start, end)]
        if end - start > large:
            pieces, a = [], start
            while a < end:
                b = min(end, a + chunk)
                if b < end and (cut := text.rfind("\n", a + 1, b)) > a:
                    b = cut + 1
                pieces.append((a, b))
                a = b
        for a, b in pieces:
            out.append({"n": len(out) + 1, "title": title, "path": path, "source": src, "depth": depth, "start": a, "end": b})
    return out


def split(docs: DataFrame) -> DataFrame:
    """(doc, n, title, path, source, depth, start, end) for docs (doc, text): a state machine over lines, in Arrow batches."""
    kind = pa.list_(pa.struct([("n", pa.int32()), ("title", pa.string()), ("path", pa.list_(pa.string())), ("source", pa.string()), ("depth", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([split_text(t) if t else [] for t in b.column("text").to_pylist()], kind)], ["doc", "s"])

    made = docs.select("doc", "text").mapInArrow(run, "doc long, s array<struct<n:int,title:string,path:array<string>,source:string,depth:int,start:int,end:int>>")
    return made.select("doc", F.explode("s").alias("s")).select("doc", "s.*")


def rank(sections: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of sections (doc, n, text) of each doc for a query's words, x1.25 where all occur: (doc, n, score, hits)."""
    base = sections.select("doc", "n", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t")).where("len > 0")
    per = base.groupBy("doc").agg(F.avg("len").alias("avg"), F.count("*").alias("n_sections"))
    words = base.select("doc", "n", "len", F.explode("t").alias("raw")).select("doc", "n", "len", stem(F.col("raw")).alias("term"))
    tf = words.where(F.col("term").isin(query)).groupBy("doc", "n", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("doc", "term").agg(F.count("*").alias("df"))
    j = tf.join(df, ["doc", "term"]).join(per, "doc")
    idf = F.log(1 + (F.col("n_sections") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    out = j.groupBy("doc", "n").agg(F.sum(s).alias("s"), F.count("*").alias("hits"))
    return out.select("doc", "n", (F.col("s") * F.when(F.col("hits") == len(query), 1.25).otherwise(1.0)).alias("score"), "hits")


def best_window(hits: DataFrame, by: str, at: str, weight: str, size: int) -> DataFrame:
    """(by, at, weight): the earliest place from which `size` positions hold the most weight."""
    w = Window.partitionBy(by).orderBy(at).rangeBetween(0, size - 1)
    sums = hits.select(by, at, F.sum(weight).over(w).alias("weight"))
    return sums.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("weight"), at))).where("_r = 1").drop("_r")


def snapped(text: Column, at: Column, size: int) -> Column:
    """The window of ``size`` characters that shows place ``at`` (from 0): an eighth of it stands before, from the start of a line if one begins there."""
    back = F.least(F.lit(size // 8), at)
    first = at - back
    head = F.substring(text, F.lit(1), first + 1)
    line = F.length(head) - F.instr(F.reverse(head), "\n")  # where the last line end at or before first stands
    begin = F.when((F.instr(head, "\n") > 0) & (first - line <= back) & (line + 1 > 0), line + 1).otherwise(first)
    return F.struct(begin.alias("begin"), F.substring(text, begin + 1, F.lit(size)).alias("part"))


def pack(hits: DataFrame, budget: int, window: int, least: int = 600) -> DataFrame:
    """(doc, shown, next, text): the best sections of a document, hits (doc, rank, head, text), as one answer of about ``budget`` bytes.

    Each gets an even share, ``window`` characters at most and ``least`` at least; a longer one is cut and says how much is left. It ends
    before a section for which there is less room than ``least``; next is its rank. One pass over a document's few hits.
    """
    h = hits.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", "head", "text"))).alias("h"))
    per = F.greatest(F.lit(least), F.least(F.lit(window), F.floor((budget - 300) / F.size("h")).cast("int"))).cast("int")
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("full"), per.alias("per"))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(budget) - acc["used"] - F.octet_length(x["head"]) - 2
        full = acc["full"] | ((F.size(acc["parts"]) > 0) & (room < least))
        size = F.greatest(F.lit(200), F.least(acc["per"], room))
        piece = F.substring(x["text"], F.lit(1), size)
        left = F.length(x["text"]) - F.length(piece)
        part = F.concat(x["head"], F.lit("\n"), piece, F.when(left > 0, F.concat(F.lit("\n…("), left.cast("string"), F.lit(" more characters)"))).otherwise(""))
        return F.when(full, F.struct(acc["parts"].alias("parts"), acc["used"].alias("used"), F.lit(True).alias("full"), acc["per"].alias("per"))).otherwise(F.struct(F.concat(acc["parts"], F.array(part)).alias("parts"), (acc["used"] + F.octet_length(part) + 2).alias("used"), F.lit(False).alias("full"), acc["per"].alias("per")))

    done = h.select("doc", "h", F.aggregate("h", zero, step).alias("a"))
    shown = F.size("a.parts")
    return done.select("doc", shown.alias("shown"), F.get("h", shown)["rank"].alias("next"), F.array_join("a.parts", "\n\n").alias("text"))


def carry(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """value, where null, from the nearest row before."""
    return rows.withColumn(value, F.last(value, True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def fresh_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc, page, pos, line) that no earlier line of the document equals, case aside."""
    r = F.row_number().over(Window.partitionBy("doc", F.lower("line")).orderBy("page", "pos"))
    return lines.withColumn("_r", r).where("_r = 1").drop("_r")


def share_budget(parts: DataFrame, budget: int) -> DataFrame:
    """(doc, part, size, given): water-filling of a budget over a document's parts, smallest first."""
    w = Window.partitionBy("doc").orderBy("size", "part")
    r = parts.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("doc"))).withColumn("before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = (F.lit(budget) - F.col("before")) / (F.col("n") - F.col("r") + 1)
    r = r.withColumn("level", F.min(F.when(F.col("size") > level, F.struct("r", level.alias("x")))).over(Window.partitionBy("doc")))
    return r.select("doc", "part", "size", F.floor(F.when(F.col("level").isNull() | (F.col("r") < F.col("level.r")), F.col("size")).otherwise(F.greatest(F.lit(0.0), F.col("level.x")))).cast("int").alias("given"))


def fits(parts: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Parts in order while their running size is within the budget."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_s", F.sum(size).over(w)).where(F.col("_s") <= budget).drop("_s")


#: Weights of words in code, longer forms, own and parent headings, full matches and other scripts.
IN_CODE, LONGER, LONGER_FROM, OWN, PARENT, ALL, FOREIGN, FOREIGN_FROM = 0.3, 0.8, 4, 2.0, 1.0, 1.25, 0.5, 0.3
_CODE = r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\z)"


def _stems(c, *keep: str):
    """What to explode, and what to stem of it: two steps, so that stemming is plain code and not a function of arrays."""
    return lambda df: df.select(*keep, F.explode(tokens(c)).alias("raw")).select(*keep, stem(F.col("raw")).alias("term"))


def rank_headed(sections: DataFrame, concepts: list[list[dict]], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, n, score, hits) of sections (doc, n, title, path, text) for the concepts of one query.

    A concept is a list of alternatives {weight, words: [term], tags: [[[term, ...], ...]]}; a tag is a list of alias groups.
    An alternative's words count if all occur, a longer form of a word of four letters at 0.8; a tag counts as its best group
    whose words all occur, and its words aren't counted again. A heading that carries what matched adds its idf, twice if it is
    the section's own. A concept that only the headings above carry counts as its idf. All concepts met: x1.25; a section in
    another script: x0.5 for a query in ASCII. The query is a small table and broadcast; the rest is keyed by section.
    """
    rows, asked = [], set()
    for c, alts in enumerate(concepts):
        for a, alt in enumerate(alts):
            held = {t for tag in alt.get("tags", []) for group in tag for t in group}
            words = sorted(set(alt.get("words", [])) - held)
            asked |= held | set(words)
            parts = [(0, k, False, len(words), [w]) for k, w in enumerate(words)] + [(p + 1, g, True, len(set(group)), sorted(set(group))) for p, tag in enumerate(alt.get("tags", [])) for g, group in enumerate(tag)]
            rows += [(c, a, float(alt.get("weight", 1.0)), p, g, tag, size, t) for p, g, tag, size, ts in parts for t in ts]
    spark = sections.sparkSession
    query = F.broadcast(spark.createDataFrame(rows, "c int, a int, weight double, part int, grp int, tag boolean, size int, word string"))
    lengths = sorted({len(r[-1]) for r in rows if not r[5] and len(r[-1]) >= LONGER_FROM})

    here = ["doc", "n"]
    # Sections are read where they lie: a section's length is a matter of array sizes, and only words that the query asks for go on.
    wanted = F.col("term").isin(sorted(asked))
    for k in lengths:
        wanted |= F.substring("term", 1, k).isin([w for w in sorted(asked) if len(w) == k])
    base = sections.select(*here, tokens(F.regexp_replace("text", _CODE, " ")).alias("plain"), tokens(F.array_join(F.regexp_extract_all("text", F.lit(_CODE), F.lit(0)), "\n")).alias("code"))
    length = F.coalesce(F.size("plain"), F.lit(0)) + IN_CODE * F.coalesce(F.size("code"), F.lit(0))
    base = base.withColumn("len", length.cast("double"))
    per = base.groupBy("doc").agg(F.avg("len").alias("avg"), F.count("*").alias("all"))
    each = base.select(*here, "len", F.explode(F.array(F.struct(F.lit(1.0).alias("w"), F.col("plain").alias("t")), F.struct(F.lit(IN_CODE).alias("w"), F.col("code").alias("t")))).alias("x"))
    each = each.select(*here, "len", "x.w", F.explode("x.t").alias("raw")).select(*here, "len", "w", stem(F.col("raw")).alias("term")).where(wanted)
    tf = each.groupBy(*here, "len", "term").agg(F.sum("w").alias("tf"))
    forms = F.array_distinct(F.array("term", *[F.substring("term", 1, k) for k in lengths]))
    tf = tf.withColumn("word", F.explode(forms)).where(F.col("word").isin(sorted(asked)))
    df = tf.select(*here, "term").distinct()
    df = df.groupBy("doc", "term").agg(F.count("*").alias("df")).join(per, "doc")
    df = df.select("doc", "term", "avg", F.log(1 + (F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    s = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = tf.join(df, ["doc", "term"]).withColumn("s", s * F.when(F.col("word") == F.col("term"), 1.0).otherwise(LONGER))

    met = scored.join(query, "word").where("not tag or word = term")
    best = met.groupBy(*here, "c", "a", "weight", "part", "grp", "tag", "size", "word").agg(F.max(F.struct("s", F.col("term"))).alias("m"))
    words = best.where("not tag").groupBy(*here, "c", "a", "weight", "size").agg(F.sum("m.s").alias("s"), F.collect_set("m.term").alias("via")).where("size(via) > 0")
    told = best.where("not tag").groupBy(*here, "c", "a").agg(F.count("*").alias("got"))
    words = words.join(told, [*here, "c", "a"]).where("got = size").select(*here, "c", "a", "weight", "s", "via")
    groups = best.where("tag").groupBy(*here, "c", "a", "weight", "part", "grp", "size").agg(F.sum("m.s").alias("s"), F.sort_array(F.collect_set("m.term")).alias("via")).where("size(via) = size")
    tags = groups.groupBy(*here, "c", "a", "weight", "part").agg(F.max(F.struct("s", "via")).alias("g")).select(*here, "c", "a", "weight", "g.s", "g.via")
    alts = words.unionByName(tags).groupBy(*here, "c", "a", "weight").agg(F.sum("s").alias("s"), F.array_distinct(F.flatten(F.collect_list("via"))).alias("via"))

    own = _stems(F.col("title"), *here)(sections).withColumn("own", F.lit(1))
    above = _stems(F.array_join("path", " "), *here)(sections).withColumn("own", F.lit(0))
    heads = own.unionByName(above).where(wanted).groupBy(*here, "term").agg(F.max("own").alias("own"), F.max(1 - F.col("own")).alias("above")).join(df.select("doc", "term", "idf"), ["doc", "term"])
    bonus = alts.select(*here, "c", "a", F.explode("via").alias("term")).join(heads, [*here, "term"])
    bonus = bonus.groupBy(*here, "c", "a").agg(F.coalesce(F.max(F.when(F.col("own") == 1, F.col("idf") * OWN)), F.max(F.col("idf") * PARENT)).alias("bonus"))
    found = alts.join(bonus, [*here, "c", "a"], "left").groupBy(*here, "c").agg(F.max((F.col("s") + F.coalesce("bonus", F.lit(0.0))) * F.col("weight")).alias("s"))
    trail = heads.where("above = 1").join(query.select("c", F.col("word").alias("term")).distinct(), "term").groupBy(*here, "c").agg(F.max(F.col("idf") * PARENT).alias("trail"))
    each = found.join(trail, [*here, "c"], "full").select(*here, F.coalesce("s", "trail").alias("s"))
    out = each.groupBy(*here).agg(F.sum("s").alias("s"), F.count("*").alias("hits"))
    scale = F.when((F.col("hits") == len(concepts)) & (F.lit(len(concepts)) > 1), ALL).otherwise(1.0)
    if all(t.isascii() for t in asked):
        foreign = sections.select(*here, (non_latin_share(F.col("text")) > FOREIGN_FROM).alias("foreign"))
        out, scale = out.join(foreign, here), scale * F.when(F.col("foreign"), FOREIGN).otherwise(1.0)
    return out.select(*here, (F.col("s") * scale).alias("score"), "hits").where("score > 0")
