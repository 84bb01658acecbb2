"""Query analysis with a vocabulary: elements, variants, synonym groups, categories and words of another language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import stem, tokens
from quarry.operators.search import CONCEPTS, fuzzy

#: Words that never count alone.
STOP = frozenset(
    "a an the and or of for to in on with my our your their its it is are be this that these those from by at as into when what how which who has have no not any some can i we you me show find give get need want looking like".split()
)
#: Weights of synonyms, of the English words for a Turkish one, and of words one edit away.
SYNONYM, TRANSLATED, NEAR = 0.7, 0.9, 0.6
ORDER = {"element": 0, "variant": 1, "synonym": 2, "category": 2, "translated": 2}


@dataclass(frozen=True)
class Phrase:
    """One wording. alts: (terms, weight); a term with a colon is a tag. group: only one phrase of a group counts in a query."""

    kind: str
    words: tuple[str, ...]
    alts: tuple[tuple[tuple[str, ...], float], ...]
    group: str = ""
    needs: str = ""  # a tag that must have been found before


@dataclass
class Vocabulary:
    """A bounded vocabulary; `split` gives a text's words and stems of them, so that phrases meet documents' terms."""

    elements: dict[str, list[str]] = field(default_factory=dict)
    variants: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    turkish: list[tuple[str, str, list[str]]] = field(default_factory=list)  # (elements | categories, id, words)

    def texts(self) -> list[str]:
        lists = [*self.elements.values(), *self.variants.values(), *self.synonyms.values(), *self.categories.values(), *[w for *_, w in self.turkish]]
        return sorted({t for texts in lists for t in texts})

    def phrases(self, split: dict[str, list[tuple[str, str]]]) -> list[Phrase]:
        """All phrases, elements first, then the longest of each pass; the first of equal ones in a kind counts."""
        words = lambda t: tuple(w for w, _ in split[t])
        stems = lambda t: tuple(s for w, s in split[t] if w not in STOP)
        out = [Phrase("element", words(a), ((("el:" + e, *stems(a)), 1.0),), "el:" + e) for e, aliases in self.elements.items() for a in aliases]
        out += [Phrase("variant", words(a), (((f"va:{e}/{v}", *stems(a)), 1.0),), f"va:{e}/{v}", "el:" + e) for (e, v), aliases in self.variants.items() for a in aliases]
        for group, aliases in self.synonyms.items():
            tag = tuple("el:" + p for p in group.split("-") if p in self.elements)[:1]
            out += [Phrase("synonym", words(a), ((stems(a) + tag, 1.0), *[(stems(x) + tag, SYNONYM) for x in aliases if x != a]), "sy:" + group) for a in aliases]
        out += [Phrase("category", words(a), (((*stems(a), "cat:" + c), 1.0),)) for c, aliases in self.categories.items() for a in aliases]
        for target, name, said in self.turkish:
            tag, english = (("cat:" + name, self.categories) if target == "categories" else ("el:" + name, self.elements))
            known = english.get(name, [])[:5]
            out += [Phrase("translated", words(t), ((stems(t), 1.0), *[((*stems(x), tag), TRANSLATED) for x in known], ((tag,), TRANSLATED))) for t in said]
        seen: dict[tuple, Phrase] = {}
        for p in out:
            if p.words and not all(w in STOP for w in p.words):
                seen.setdefault((p.kind, p.words, p.needs), p)
        return sorted(seen.values(), key=lambda p: (ORDER[p.kind], -len(p.words)))


def splits(spark: SparkSession, texts: list[str]) -> dict[str, list[tuple[str, str]]]:
    """Words and stems of each of a vocabulary's texts, by the functions that documents are split with (a row a text)."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", _pairs(F.col("t")).alias("p")).collect()
    return {r.t: [(x.w, x.s) for x in r.p] for r in rows}


def _pairs(c: Column) -> Column:
    return F.transform(tokens(c), lambda w: F.struct(w.alias("w"), stem(w).alias("s")))


def for_sections(concepts: DataFrame, vocabulary: Vocabulary) -> list[list[dict]]:
    """One query's concepts as sections.rank_headed() takes them: a tag stands for all its wordings. A query has few rows."""
    wordings = {"el": vocabulary.elements, "cat": vocabulary.categories, "va": {f"{e}/{v}": a for (e, v), a in vocabulary.variants.items()}}
    split = splits(concepts.sparkSession, sorted({*vocabulary.texts(), *[n for w in wordings.values() for n in w]}))
    out: dict[int, dict[int, dict]] = {}
    for r in concepts.orderBy("concept", "alt").collect():
        alt = out.setdefault(r.concept, {}).setdefault(r.alt, {"weight": r.weight, "words": [], "tags": []})
        if r.is_tag:
            kind, name = r.term.split(":", 1)
            alt["tags"].append([g for t in [name, *wordings[kind].get(name, [])] if (g := [x for _, x in split[t]])])
        else:
            alt["words"].append(r.term)
    return [list(alts.values()) for alts in out.values()]


def read_query(words: list[str], stems: list[str], by_first: dict[str, list[tuple[int, Phrase]]]) -> list[tuple[str, tuple, bool]]:
    """(word, alts, gated) of a query. Phrases that begin at some word are looked up by it and taken in the vocabulary's
    order; each word of the query serves one phrase. What remains are plain words without the stop words."""
    spans = []
    for i, (w, s) in enumerate(zip(words, stems, strict=True)):
        for rank, p in {id(x[1]): x for key in (w, s) for x in by_first.get(key, [])}.values():
            there = list(zip(words[i : i + len(p.words)], stems[i : i + len(p.words)], strict=True))
            if len(there) == len(p.words) and all(x in pair or x == pair[0] for x, pair in zip(p.words, there, strict=True)):
                spans.append((rank, i, p))
    used, groups, out = set(), set(), []
    for _, i, p in sorted(spans, key=lambda x: x[:2]):
        at = range(i, i + len(p.words))
        if used & set(at) or (p.needs and p.needs not in groups):
            continue
        used |= set(at)
        if p.group in groups:
            continue
        groups |= {p.group} - {""}
        out.append((" ".join(words[k] for k in at), p.alts, p.kind == "element" and any(w in STOP for w in p.words)))
    out += [(words[k], (((stems[k],), 1.0),), False) for k in range(len(words)) if k not in used and words[k] not in STOP]
    return out


def analyse(queries: DataFrame, vocabulary: Vocabulary, terms: DataFrame | None = None) -> DataFrame:
    """Concepts (see search.CONCEPTS) of queries (q). The vocabulary is bounded and sent to the workers once; queries are read in
    Arrow batches. terms (term): with it, a plain word of five letters or more that it lacks also means the terms one edit away."""
    spark = queries.sparkSession
    split = splits(spark, vocabulary.texts())
    by_first: dict[str, list[tuple[int, Phrase]]] = {}
    for rank, p in enumerate(vocabulary.phrases(split)):
        by_first.setdefault(p.words[0], []).append((rank, p))
    first_stem = {w: s for p in split.values() for w, s in p}
    for w, ps in list(by_first.items()):
        if first_stem[w] != w:
            by_first.setdefault(first_stem[w], []).extend(ps)
    kind = pa.schema([("q", pa.string()), ("concept", pa.int32()), ("alt", pa.int32()), ("term", pa.string()), ("is_tag", pa.bool_()), ("weight", pa.float64()), ("gated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c, (_, alts, gated) in enumerate(read_query([x["w"] for x in p or []], [x["s"] for x in p or []], by_first)):
                    rows += [(q, c, a, t, bool(re.match("(el|va|cat):", t)), weight, gated) for a, (ts, weight) in enumerate(alts) for t in dict.fromkeys(ts)]
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)

    out = queries.select("q", _pairs(F.col("q")).alias("p")).mapInArrow(run, CONCEPTS)
    if terms is None:
        return out
    lone = out.groupBy("q", "concept").agg(F.count("*").alias("n"), F.max("alt").alias("alts"), F.first("term").alias("word"), F.first("is_tag").alias("tag")).where("n = 1 and alts = 0 and not tag")
    near = fuzzy(lone.select("word").distinct(), terms).withColumn("alt", F.row_number().over(Window.partitionBy("word").orderBy("term")))
    more = lone.join(near, "word").select("q", "concept", "alt", "term", F.lit(False).alias("is_tag"), F.lit(NEAR).alias("weight"), F.lit(False).alias("gated"))
    return out.unionByName(more)
