"""The pipeline's stages against brute force, on a small corpus with planted copies and toxic documents."""

import random
from collections import Counter, defaultdict

import brute
import pytest

import corpus_pipeline as cp
from quarry.llm import mixing
from quarry.llm.queries import tokenizer

BAD = ["vilebad", "nastybad", "foulbad"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    docs, labels = [], []
    for d in range(700):
        t, toxic = text(rng.randint(40, 120)), d % 7 == 0
        if toxic:
            w = t.split()
            for b in BAD:
                w.insert(rng.randrange(len(w)), b)
            t = " ".join(w)
        docs.append((d, t, "en", f"s{d % 4}", len(t)))
        labels.append((d, 1, int(toxic)))
    for d in range(700, 730):
        docs.append((d, docs[d - 699][1], "en", "s1", 0))  # exact copies
    for d in range(730, 760):
        w = docs[d - 639][1].split()
        w[-1] = "changed"
        docs.append((d, " ".join(w), "en", "s2", 0))  # near copies
    docs += [(760, None, None, None, None), (761, "", "en", "s0", 0)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs


def test_stages(spark, corpus):
    at, docs = corpus
    now = spark.read.parquet(f"{at}/documents.parquet")
    columns = now.columns
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in now.collect()]
        now = stage(spark, now, at)
        rows = now.collect()
        if name != "packing":
            assert now.columns == columns
        ids = Counter(r.doc_id for r in rows)
        if name == "toxicity":
            assert sorted(ids) == sorted(d for d, t, *_ in docs if not any(b in (t or "") for b in BAD))
        elif name == "exact_dedup":
            keep = {}
            for d, t, _ in before:
                keep[t or ""] = max(d, keep.get(t or "", -1))
            assert ids == Counter(keep.values())
        elif name == "ngram_jaccard_join":
            groups = brute.groups([(d, t) for d, t, _ in before], 5, 80)
            assert ids == Counter(d for d in groups if groups[d][1] == d)
        elif name == "source_mixing":
            size, by = {d: len(brute.WORD.findall(t or "")) for d, t, _ in before}, defaultdict(int)
            source = {d: s for d, _, s in before}
            for d in size:
                by[source[d]] += size[d]
            got = defaultdict(int)
            for d, n in ids.items():
                assert n <= 3
                got[source[d]] += n * size[d]
            for s, t in brute.mix_targets(dict(by)).items():
                assert abs(got[s] - t) <= 0.02 * t + 1
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
            want = Counter()
            for d, t, _ in before:
                want[d] += len(model.encode(t or "", add_special_tokens=False).ids) + 1
            have = Counter()
            for r in rows:
                have[r.doc_id] += r.length
            assert have == want
    assert sum(r.length for r in cp.run(spark, at).collect()) == sum(have.values())


def test_drop_toxic_keeps_foreign_scores(spark, corpus):
    """A score column of the table is neither read nor changed."""
    at, docs = corpus
    now = spark.read.parquet(f"{at}/documents.parquet")
    want = sorted(r.doc_id for r in cp.drop_toxic(spark, now, at).collect())
    own = now.selectExpr("*", "'text' as Score", "doc_id * 1.0 as _score")
    got = cp.drop_toxic(spark, own, at)
    assert got.columns == own.columns
    assert sorted((r.doc_id, r.Score, r._score) for r in got.collect()) == [(d, "text", d) for d in want]
    assert len(want) < len(docs)


def test_mix_takes_null_and_repeated_ids(spark):
    """Each row is taken as often as the mix says, whatever its doc_id."""
    rows = [(None if d % 3 == 0 else d % 10, " ".join(["w"] * (d + 1)), f"s{d % 3 if d % 2 else 0}") for d in range(300)] + [(5, "equal rows here", "s1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r.doc_id, r["size"], r.source)] += r.copies
    got = Counter((r.doc_id, len(r.text.split()), r.source) for r in cp.mix_sources(spark, docs, "").collect())
    assert got == +want and any(d is None for d, *_ in got)


CLASHES = ["_score", "score", "key", "sha", "_key", "_sha", "keep", "_keep", "mark", "_mark", "first", "low", "_low", "more", "row", "_row", "copies", "_copies", "copy", "n", "size", "p", "block", "id", "text_sha256", "__mark"]


def odd_rows(spark):
    w = " ".join(f"word{k}" for k in range(60))
    rows = [(1, w, "a"), (1, w, "a"), (1, w + " more", "a"), (1, "quite another text with its own words", "b"), (2, w + " end", None), (None, w, "a"), (None, None, None), (3, None, "b"), (4, "", "b"), (5, w, "b"), (6, "something else entirely stands here", "c"), (6, "and a second row of six", "c"), (7, "long " * 60_000, "c")]
    return rows, spark.createDataFrame([(*r, *[f"x{k}"] * len(CLASHES)) for k, r in enumerate(rows)], ", ".join(["doc_id long", "text string", "source string", *[f"{c} string" for c in CLASHES]]))


def test_stages_with_clashing_columns_and_odd_ids(spark, corpus):
    at, _ = corpus
    rows, docs = odd_rows(spark)
    empty = docs.limit(0)
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, at)
        assert got.columns == docs.columns and stage(spark, empty, at).count() == 0
        held = got.collect()
        # Every row that comes out is one that went in, with its own columns.
        assert all((r.doc_id, r.text, r.source) == rows[int(r.copy[1:])] and len({r[c] for c in CLASHES}) == 1 for r in held)
        kept[name] = sorted(int(r.copy[1:]) for r in held)
    assert kept["toxicity"] == list(range(len(rows)))
    # Of rows 0, 1, 5 and 9 (one text) the largest id stays; 6, 7 and 8 are all empty.
    assert kept["exact_dedup"] == [2, 3, 4, 8, 9, 10, 11, 12]
    # Rows 0, 1, 2, 4 and 9 are near copies; the null id among them is no part of it.
    near = kept["ngram_jaccard_join"]
    assert [k for k in near if k not in (0, 1, 2)] == [3, 5, 6, 7, 8, 10, 11, 12] and len(near) == 9
    assert cp.pack_sequences(spark, empty, at).count() == 0
    assert cp.pack_sequences(spark, docs, at).select("doc_id").distinct().count() == 8
