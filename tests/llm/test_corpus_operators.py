"""Each operator against its brute-force version: on the small tables and on awkward rows."""

import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quarry.llm import exact, fingerprint, jaccard, langid, lines, mixing, packing, queries, substring, text, tokenfile, tokens, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n", T.StringType())])
LONG = " ".join(f"w{i}" for i in range(40_000))
PASSAGE = "This first sentence of the passage has quite some words in it. Then another sentence of the passage comes with even more words than before. At last a third one closes the passage with words that nothing else in these rows has."
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, LONG, "en", "a"),
    (4, LONG + " x", None, "b"),
    (5, "the same words here again and again, all the same", "en", "b"),
    (6, "the same words here again and again, all the same", "en", "b"),
    (6, "the same words here again and again, all the same", "en", "b"),
    (7, " \n\t ", "en", None),
    (8, "a line that is long enough\nA LINE that is long enough\t\n\nx", "fr", "c"),
    (9, "A line that is long enough", "fr", "c"),
    (10, "y\na line that is long enough\r\nz", "fr", "c"),
    (11, "ä ö ü ß ​ é̈", "de", "ü"),
    (12, "one\x1ctwo 🙂🙂🙂 three  four\n\nfive <|endoftext|>", "es", "Z"),
    (None, "no id here but words all the same", "en", "a"),
    (13, f"some text before it {PASSAGE} and something quite different after", "en", "a"),
    (14, f"Other words come here. And more of them stand there. {PASSAGE} Nothing follows", "en", "a"),
    (15, "123 456 .,!", "en", "a"),
]


ODD_TEXTS = [(r[0], r[1]) for r in ODD if r[1]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "k", "s", "n") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def pairs(table):
    return [(r[0], r[1]) for r in table]


def key(r):
    return tuple((x is not None, x) for x in r)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_lines(spark, docs, rows, odd, which):
    table, held = (docs, rows) if which == "small" else (odd, pairs(ODD))
    from pyspark.sql import functions as F

    for shards in (5, None):
        got = lines.LineIndex.build(table, shards).dedup(table)
        assert result(got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))) == sorted(brute.line_dedup(held), key=key)


def test_lines_count_documents_and_not_rows(spark):
    """A line in two documents, one of them there twice, stays; rows of one doc_id lose their own lines."""
    line = "this line is long enough to count"
    held = [(1, line), (1, line), (2, line)]
    table = spark.createDataFrame(held, "doc_id long, text string")
    assert {r.n_dropped for r in lines.LineIndex.build(table).dedup(table).collect()} == {0}
    from pyspark.sql import functions as F

    held = [(1, f"x\n{line}"), (1, f"{line}\ny\nz"), (2, line), (3, f"{line}\n{line}"), (None, line)]
    table = spark.createDataFrame(held, "doc_id long, text string")
    got = lines.LineIndex.build(table).dedup(table).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    assert result(got) == sorted(brute.line_dedup(held), key=key)


def files_of(index, kind):
    import os

    root = index.at.removeprefix("file://")
    return {f"{v}/{f}" for v in os.listdir(root) for f in os.listdir(f"{root}/{v}/{kind}") if not f.startswith((".", "_"))}


def held_keys(index):
    """Of each shard, its heavy keys and its filter."""
    from quarry.llm.files import open_table

    out = {}
    for r in index.heavy.collect():
        out.setdefault(r.shard, []).append(bytes(r.key))
    for s, keys in out.items():
        yield s, lines._numbers(keys), lines.CuckooFilter.loads(open_table(f"{index.at}/v{index.versions.get(s, 0)}/filters")(s))


def test_lines_can_be_taken_back(spark, docs):
    part, rest = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    whole = lines.LineIndex.build(docs, 4)
    less = lines.LineIndex.build(rest, 4)
    both = less.insert(part)
    count = lambda x: result(x.counts)
    assert count(both) == count(whole) and result(both.heavy) == result(whole.heavy)
    assert result(both.dedup(docs)) == result(whole.dedup(docs))
    back = both.delete(part)
    assert count(back) == count(less) and result(back.heavy) == result(less.heavy)
    assert result(back.dedup(rest)) == result(less.dedup(rest))
    for index in (both, back):
        for _, keys, made in held_keys(index):
            assert made.contains(keys).all() and (made.table > 0).sum() == len(keys)
    # What was made from it left the first index as it was.
    assert result(less.dedup(rest)) == result(lines.LineIndex.build(rest, 3).dedup(rest))


def test_one_document_touches_its_shards(spark, docs):
    """Inserting and deleting one document writes the shards of its lines and no others, and the filters follow."""
    line = "a line that three documents come to hold"
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(90_001, line), (90_002, f"{line}\nx")], "doc_id long, text string"))
    index = lines.LineIndex.build(table, 16)
    one = spark.createDataFrame([(90_003, f" {line.upper()} ")], "doc_id long, text string")
    more = index.insert(one)
    key_ = lines.line_keys(line, 20)[0]
    shard = int(lines._shards([key_], 16)[0])
    assert more.versions == {shard: 1}
    for kind, name in (("holders", f"shard={shard}"), ("counts", f"shard={shard}"), ("filters", str(shard))):
        assert {f for f in files_of(more, kind) if f.startswith("v1")} == {f"v1/{name}"}
    assert [(r.refs, r.last_doc) for r in more.heavy.where(f"shard = {shard}").collect() if bytes(r.key) == key_] == [(3, 90_003)]
    assert {s: made.contains(lines._numbers([key_]))[0] for s, _, made in held_keys(more) if s == shard} == {shard: True}
    all_ = table.union(one)
    assert {r.doc_id: r.n_dropped for r in more.dedup(all_).where("doc_id > 90000").collect()} == {90_001: 1, 90_002: 1, 90_003: 0}
    less = more.delete(one)
    assert less.versions == {shard: 2} and result(less.heavy) == result(index.heavy)
    assert {r.n_dropped for r in less.dedup(table).where("doc_id > 90000").collect()} == {0}
    assert all((made.table > 0).sum() == len(keys) for _, keys, made in held_keys(less))


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = lines.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.01
    assert (lines.CuckooFilter.loads(f.dumps()).table == f.table).all()


@pytest.mark.parametrize("which", ["small", "odd"])
def test_exact(spark, docs, rows, odd, which):
    table, held = (docs, rows) if which == "small" else (odd, pairs(ODD))
    by = defaultdict(list)
    for d, t in held:
        by[t or ""].append(d)
    want = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            want.append((i, keep, len(ids), left and i == keep, brute.sha(t)))
            left = left and i != keep
    from pyspark.sql import functions as F

    assert result(exact.exact_dedup(table, capacity=20)) == sorted(want, key=key)
    # Nine in ten keys collide: chains and the bytes decide.
    assert result(exact.exact_dedup(table, capacity=20, key=lambda c: F.pmod(F.xxhash64(c), F.lit(97)).cast("long"))) == sorted(want, key=key)
    assert sorted(map(key, ((r.doc_id,) for r in exact.drop_exact(table, capacity=20).collect()))) == sorted(key((w[0],)) for w in want if w[3])


def test_exact_index_chains_and_splits(spark, docs, rows):
    """Buckets are the key ranges that their depths say, cover all keys, and only one that has a single key is overfull."""
    from pyspark.sql import functions as F

    for of, depth in ((F.xxhash64, 6), (lambda c: F.xxhash64(F.length(c)), 1), (lambda c: F.shiftrightunsigned(F.xxhash64(c), 10), 14)):
        got = exact.build_index(docs, capacity=8, key=of)
        slots, held = got.directory.collect(), got.entries.collect()
        assert len(held) == len({t for _, t in rows}) == sum(s.entries for s in slots)
        assert all(s.entries <= 8 or s.low == s.high for s in slots) and max(s.depth for s in slots) >= depth
        assert len({s.depth for s in slots}) > 1
        per = Counter((e.depth, e.bucket) for e in held)
        assert per == {(s.depth, s.bucket): s.entries for s in slots}
        assert all((e.key % (1 << 64)) >> (64 - e.depth) == e.bucket for e in held)
        ranges = sorted((s.bucket << (64 - s.depth), (s.bucket + 1) << (64 - s.depth)) for s in slots)
        assert all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:]))
        chains = defaultdict(list)
        for e in held:
            chains[e.key].append(e.chain)
        assert all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values())


def test_exact_reads_the_directory(spark, docs):
    """A bucket that the directory doesn't name gives no result: the index is what decides."""
    got = exact.build_index(docs, capacity=8)
    assert got.entries.count() == got.entries.join(got.directory.select("depth", "bucket"), ["depth", "bucket"]).count()
    parts = {tuple(x) for x in got.directory.select("depth", "bucket").collect()}
    assert len(parts) > 100


@pytest.mark.parametrize("which", ["small", "odd"])
@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(docs, rows, odd, which, n, percent):
    table, held = (docs, rows) if which == "small" else (odd, pairs(ODD))
    want = brute.groups([(d, t) for d, t in held if d is not None], n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.shingle_groups(table, n, percent).collect() if r.doc_id is not None}
    assert got == want


def test_jaccard_pods_in_blocks(spark):
    """A pod of many near copies, cut into blocks of few elements, gives the same components as brute force."""
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(60)]
    held = []
    for d in range(120):
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(60))] = f"x{rng.integers(1000)}"
        held.append((d, " ".join(w[: int(rng.integers(50, 61))])))
    sets = {d: np.unique(np.array([hash(x) & 0x7FFFFFFFFFFFFFFF for x in brute.shingle_set(t, 4)], np.uint64)) for d, t in held}
    pods = spark.createDataFrame([(0, d, len(s)) for d, s in sets.items()], "pod long, id long, n long")
    made = spark.createDataFrame([(d, bytearray(s.tobytes())) for d, s in sets.items()], "id long, tokens binary")
    got = {r.id: r.component for r in jaccard.link_sets(pods, lambda ids: made.join(ids, "id"), 85, block=500).collect()}
    want = {d: c for d, (_, c) in brute.groups(held, 4, 85).items()}
    assert {d: got.get(d, d) for d in want} == want


def test_jaccard_repeated_ids(spark):
    """Rows of one doc_id are sets of their own: the link of each counts."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    held = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, a), (0, "a few other words here"), (1, "a few other words here"), (5, None)]
    table = spark.createDataFrame(held, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.shingle_groups(table).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (1, 57, 1), (1, 57, 1), (2, 58, 1), (3, 58, 1), (4, 57, 1), (5, 0, 5)]


@pytest.mark.parametrize("block,wide", [(300, 500), (2000, 900), (100_000, 1_000_000)])
def test_jaccard_pods_of_several_groups(spark, block, wide):
    """One pod holds a large group, several small ones and sets that link with nothing; blocks change no result."""
    rng = np.random.default_rng(5)
    held, common = [], [f"c{i}" for i in range(60)]
    for d in range(260):
        g = 0 if d < 150 else d % 7
        w = [*common, *(f"g{g}x{i}" for i in range(0 if d >= 245 else 25))]
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(len(w)))] = f"x{rng.integers(1000)}"
        held.append((d, " ".join(w[: int(rng.integers(len(w) - 8, len(w) + 1))])))
    sets = {d: np.unique(np.array([hash(x) & 0x7FFFFFFFFFFFFFFF for x in brute.shingle_set(t, 2)], np.uint64)) for d, t in held}
    pods = spark.createDataFrame([(0, d, len(s)) for d, s in sets.items()], "pod long, id long, n long")
    made = spark.createDataFrame([(d, bytearray(s.tobytes())) for d, s in sets.items()], "id long, tokens binary")
    got = {r.id: r.component for r in jaccard.link_sets(pods, lambda ids: made.join(ids, "id"), 80, block=block, wide=wide).collect()}
    want = {d: c for d, (_, c) in brute.groups(held, 2, 80).items()}
    assert {d: got.get(d, d) for d in want} == want and 4 < len(set(want.values())) < 100


def test_jaccard_edges_of_sets_that_share_a_passage(spark):
    """Sets that share one token of many holders and nothing else are no candidates; whatever links is connected by candidates."""
    alone = [(1, 240, i) for i in range(40)] + [(100 + i, 240, i) for i in range(40)]
    assert jaccard.token_edges(spark.createDataFrame(alone, "token long, n long, id long"), 85).count() == 0
    rng = np.random.default_rng(7)
    common, held = rng.integers(0, 1 << 62, 200, np.uint64), []
    for d in range(240):
        own = np.random.default_rng(d // 3).integers(0, 1 << 62, 200, np.uint64)[: 20 + d // 3]
        s = np.concatenate([own, common[: 5 * (d // 3 % 40)]])
        held.append(np.unique(np.append(s[rng.random(len(s)) > 0.06], rng.integers(0, 1 << 62, int(rng.integers(3)), np.uint64))))
    cells = np.zeros(1 << 20, np.uint8)
    rows = [(int(t), len(s), d) for d, s in enumerate(held) for t in jaccard.prefix(s, cells, 85)]
    found = jaccard.components(jaccard.token_edges(spark.createDataFrame(rows, "token long, n long, id long"), 85))
    of = {r.id: r.component for r in found.collect()}
    links = [(x, y) for y in range(240) for x in range(y) if 100 * (i := len(np.intersect1d(held[x], held[y]))) >= 85 * (len(held[x]) + len(held[y]) - i)]
    assert len(links) > 100 and all(of.get(x, x) == of.get(y, y) for x, y in links)


def test_jaccard_leaves_meet_at_once(monkeypatch):
    """Copies too far from each other to link, which no bitmap tells apart, are compared by leaves and not pair by pair; links stay exact."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 300, np.uint64)
    held = [np.unique(np.append(base[rng.random(300) > rng.uniform(0.05, 0.2)], rng.integers(0, 1 << 62, 20, np.uint64))) for _ in range(300)]
    calls, look = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *args: calls.append(1) or look(*args))
    for left, right in ((range(300), None), (range(100), range(100, 300))):
        calls.clear()
        u = jaccard.Union(300)
        links = jaccard.traverse(held, list(left), right and list(right), 80, u)
        done = len(calls)
        want = jaccard.Union(300)
        for x in left:
            for y in right or range(x):
                if 100 * (i := len(np.intersect1d(held[x], held[y]))) >= 80 * (len(held[x]) + len(held[y]) - i):
                    want.join(x, y)
        assert [u.find(k) for k in range(300)] == [want.find(k) for k in range(300)]
        assert len(links) == 300 - len({u.find(k) for k in range(300)}) and 20 < len(links) < 250 and done < 200


def test_shingle_sets_by_rows():
    """Each row's sorted distinct shingles, though the block is shingled at once; rows of fewer words are one, empty ones none."""
    texts = ["a b c d e f a b c d e f", None, "a b", "", "c d e f g", " ", "x y z a b"]
    data, offsets = text.buffers(pa.array(texts, pa.string()))
    alone = [text.shingles(text.words(*text.buffers(pa.array([t], pa.string())))[2], 5) for t in texts]
    assert [s.tolist() for s in text.shingle_sets(data, offsets, 5)] == [sorted(set(s.tolist())) for s in alone]


def test_cells_grow_with_the_texts():
    """A cell holds about as many tokens whatever the size, until 8 GB of parquet; large sketches agree with small ones on what stands out."""
    assert [jaccard.cell_bits(x << 30) for x in (0, 1, 11)] == [20, 21, 24]


def test_jaccard_tables_are_few_files(spark, docs, rows):
    """Two tasks a core write a small table, however many shuffle partitions there are; the result is whole."""
    folder, cores = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")), spark.sparkContext.defaultParallelism
    old, held = set(folder.iterdir()), {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        made = jaccard.shingle_groups(docs)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in made.collect()}
        assert made.rdd.getNumPartitions() <= 2 * cores
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.groups(rows, 4, 85)
    files = {p.name: len(list(p.glob("part-*"))) for p in set(folder.iterdir()) - old}
    assert len(files) > 5 and max(files.values()) <= 2 * cores


def test_jaccard_holds_the_sets_of_a_block(spark):
    """What is held of a batch at once are the sets of about a block of text; all rows come, with their own sets."""
    texts = [None, "", *(" ".join(f"{d}w{k}" for k in range(3000)) for d in range(200)), "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = [(b, list(sets)) for b, sets in jaccard._portions(batch, 4)]
    assert [d for b, _ in parts for d in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    alone = list(text.shingle_sets(*text.buffers(batch.column("text")), 4))
    assert all(np.array_equal(x, y) for x, y in zip((s for _, sets in parts for s in sets), alone, strict=True))
    assert len(parts) > 3 and all(sum(len(t or "") for t in b.column("text").to_pylist()) <= text.BLOCK for b, _ in parts)


def test_components_in_few_jobs(spark):
    """A long path is connected by one task; in rounds it gives the same."""
    edges = spark.range(3000).selectExpr("id * 7919 % 3001 a", "(id + 1) * 7919 % 3001 b").union(spark.createDataFrame([(5000, 5001), (None, 5), (6000, 6000)], "a long, b long"))
    want = {i: 0 for i in range(3001)} | {5000: 5000, 5001: 5000}
    spark.sparkContext.setJobGroup("few-jobs", "")
    got = {r.id: r.component for r in jaccard.components(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and jobs <= 8
    assert {r.id: r.component for r in jaccard.components(edges, few=100).collect()} == want


@pytest.mark.parametrize("which", ["small", "odd"])
def test_mixing(docs, odd, which):
    table = docs if which == "small" else odd
    held = [(r.doc_id, r.text, r.source) for r in table.collect()]
    sizes = defaultdict(int)
    for _, t, s in held:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.mix_targets(dict(sizes))
    got = mixing.mix(table, block=200).collect()
    assert len(got) == len(held)
    assert sorted(key((r.doc_id, r["size"])) for r in got) == sorted(key((d, len(brute.WORD.findall(t or "")))) for d, t, _ in held)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    if which == "small":
        for s, t in want.items():
            assert abs(taken[s] - t) <= 0.02 * t
    again = {(r.doc_id, r["size"]): r.taken for r in mixing.mix(table.repartition(5), block=200).collect()}
    if which == "small":
        assert again == {(r.doc_id, r["size"]): r.taken for r in got}


def test_mixing_in_blocks_reruns_alike(spark, docs):
    """Several blocks a source: the physical layout changes nothing, for repeated rows neither."""
    table = docs.select("doc_id", "text", "source").union(docs.selectExpr("null", "text", "source").where("length(text) < 400").crossJoin(spark.range(2)).drop("id"))
    runs = [Counter((r.doc_id, r.source, r["size"], r.copies) for r in mixing.mix(table.repartition(n, by), block=8).collect()) for n, by in ((2, "text"), (7, "doc_id"))]
    assert runs[0] == runs[1]


def test_flight_keeps_constraints():
    rng = np.random.default_rng(2)
    p, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    q = mixing.flight(p, np.vstack([np.ones(500), size]), 5)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum(), abs=1e-3) and q @ size == pytest.approx(p @ size, rel=1e-6)


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(rows, name, spaced):
    from tokenizers import Tokenizer

    e, plain = tokens.Encoder(queries.tokenizer(name), spaced), Tokenizer.from_file(queries.tokenizer(name))
    texts = [t for _, t in rows][:300] + [t for _, t in ODD_TEXTS] + ["", "\n", "a\n", " a", "a ", "a  b", "don't 's", "x\n y", "t\tq", "\nfoo", "a|b | c", "..., !!", "Σας ΟΔΟΣ", "é̈. É.", "İ? İ.", "x <|endoftext|> y", "<|STARTOFTEXT|>"]
    rng = np.random.default_rng(8)
    some = ["a", "B", "é", "e\u0301", "İ", "ß", "Σ", "ŉ", ".", "?", "!", ",", "'s", "<|endoftext|>", "<|", "|>", "|", " ", "  ", "\n", "\t", "1", "中", "🙂", "the", "ªº", "\u0338", "<", "ﬁ", "K", "don't", "<|startoftext|>", "###", "%%%", "'", "(", "\x1c", "\x85", "\u3000", "'S", " "]
    texts += ["".join(rng.choice(some, rng.integers(1, 14))) for _ in range(5000)]
    for k in range(0, len(texts), 500):
        for t, got in zip(texts[k : k + 500], e.encode(texts[k : k + 500]), strict=True):
            assert got.tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["small", "odd"])
def test_token_files(spark, tmp_path, docs, rows, odd, which):
    from tokenizers import Tokenizer

    table, held = (docs, rows) if which == "small" else (odd, pairs(ODD))
    model = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want, at = [], 0
    for d, t in sorted(held, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), brute.crc(ids)))
        at += len(ids)
    shards = tokenfile.write_tokens(table, f"file://{tmp_path}/t", queries.tokenizer("byte_bpe_50k.json"), seq_len=128, shards=3)
    assert sorted(map(tuple, tokenfile.read_index(spark, f"file://{tmp_path}/t", shards).collect()), key=lambda r: r[1]) == want
    s = tokenfile.TokenShard(f"file://{tmp_path}/t", shards[-1][0])
    k = shards[-1][1] - 1
    assert s.document(k).tolist() == [*model.encode(want[-1][0] is not None and dict(held)[want[-1][0]] or "", add_special_tokens=False).ids, 2]
    total = shards[-1][2]
    last = (total - 1) // 128
    assert s.mask(last).to_pylist() == [True] * (total - last * 128) + [False] * (128 - total + last * 128)
    assert not s.sequence(0).flags.owndata


@pytest.mark.parametrize("which", ["small", "odd"])
def test_packing(docs, rows, odd, which):
    from tokenizers import Tokenizer

    table, held = (docs, rows) if which == "small" else (odd, pairs(ODD))
    model = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    want = defaultdict(list)
    for d, t in held:
        want[d].append([*model.encode(t or "", add_special_tokens=False).ids, 2])
    got = packing.pack_documents(table, queries.tokenizer("word_bpe_49k.json"), unit=300_000).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, kept in want.items():
        ids = kept[0]
        assert sum(r.length for r in by[d]) == sum(map(len, kept))
        for r in by[d]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length])
        if len(kept) == 1:
            at = 0
            for r in sorted(by[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    used = room = 0
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
        used += at
        room += at if at & (at - 1) == 0 else 4096
    assert used / room > 0.98


def test_nnls():
    rng = np.random.default_rng(4)
    a = rng.random((20, 8))
    x = np.maximum(0, rng.normal(size=8))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_fingerprints(docs, rows, odd, which):
    table, held = (docs, rows) if which == "small" else (odd, [r for k, r in enumerate(pairs(ODD)) if k != 6])
    want = brute.edited(held)
    got = fingerprint.fingerprints(table if which == "small" else table.dropDuplicates(["doc_id"])).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    prints = defaultdict(set)
    text = dict(held)
    for r in got:
        prints[text[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    if which == "small":
        assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.4


def test_entropy_bins():
    data = np.random.default_rng(6).integers(97, 110, 300).astype(np.uint8)
    got = fingerprint.entropy_bins(data)
    for k in range(0, len(got), 17):
        c = np.bincount(data[k : k + fingerprint.WINDOW])
        s = sum(int(fingerprint._G[x]) for x in c)
        assert got[k] == (fingerprint._TOP - s) * (fingerprint.BINS - 1) // fingerprint._TOP


def test_toxicity(spark):
    """Held-out accuracy on the largest of the small tables; sf0.01 holds only six held-out toxic documents."""
    large = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    got = {r.doc_id: r.score for r in toxicity.score_ids(docs, toxicity.train(docs, labels)).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.where("toxic is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    pos, neg = np.array([s for s, t in held if t]), np.array([s for s, t in held if not t])
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert len(pos) > 50 and auc > 0.95 and (pos >= 0.5).mean() > 0.85 and (neg >= 0.5).mean() < 0.02


def test_toxicity_small(spark, docs):
    """With a handful of examples the scores still tell more than chance."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.score for r in toxicity.score_ids(docs, toxicity.train(docs, labels)).collect()}
    rows = [(got[r.doc_id], r.toxic) for r in labels.where("toxic is not null").collect()]
    assert np.mean([s for s, t in rows if t]) > np.mean([s for s, t in rows if not t]) + 0.3


def test_language(docs):
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.where("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_language_mixture(docs):
    """Half of one language and half of another: both are chosen, with near equal shares."""
    import pyarrow as pa

    model = langid.train(docs)
    by = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}' and n_chars > 2000").limit(2).collect())[:3000] for lang in ("en", "de")}
    p = model.shares(pa.array([by["en"] + by["de"], by["en"]]))
    assert 0.3 < p[0][model.names.index("en")] < 0.7 and 0.3 < p[0][model.names.index("de")] < 0.7
    assert p[1][model.names.index("en")] > 0.9


def test_passages(odd, docs, rows):
    got = substring.duplicate_passages(odd).collect()
    assert {13, 14} <= {r.doc_id for r in got}
    assert {r.doc_id for r in got if r.removed and r.keep_doc_id == 13} == {14}
    # All documents that share an exact run of 60 words must be found, and none that shares no run of 8.
    def runs(t, n):
        w = brute.WORD.findall(t or "")
        return {hash(tuple(w[i : i + n])) for i in range(len(w) - n + 1)}

    long, short = defaultdict(set), defaultdict(set)
    for d, t in rows:
        for h in runs(t, 60):
            long[h].add(d)
        for h in runs(t, 6):
            short[h].add(d)
    must = set().union(*(s for s in long.values() if len(s) > 1))
    may = set().union(*(s for s in short.values() if len(s) > 1))
    found = {r.doc_id for r in substring.duplicate_passages(docs).collect()}
    assert len(must - found) <= 0.02 * len(must) and found <= may


def test_passages_inside_sentences(spark, docs, rows):
    """Every 50 words in a row that two documents share hold a whole reported span, wherever they start, stop and break."""
    rng = np.random.default_rng(3)
    fresh = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    short = [" ".join(f"{x} {y} {z}." for x, y, z in zip(fresh(17), fresh(17), fresh(17), strict=True)).split() for _ in range(5)]
    cases = []
    for shared in [fresh(50) for _ in range(40)] + short + [["same"] * 60, ["two", "words"] * 40]:
        lines = "\n".join(" ".join(shared[k : k + 6]) for k in range(0, len(shared), 6))
        for middle in (" ".join(shared), lines):
            cases.append((len(cases), " ".join([*fresh(rng.integers(5, 40)), middle, *fresh(rng.integers(5, 40))])))
    for table, texts in ((spark.createDataFrame(cases, "doc_id long, text string"), cases), (docs, rows)):
        held, windows = defaultdict(set), []
        for d, t in texts:
            raw = (t or "").encode()
            w = [(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
            for k in range(len(w) - 49):
                key = tuple(x[2] for x in w[k : k + 50])
                held[hash(key)].add(d)
                windows.append((hash(key), d, w[k][0], w[k + 49][1]))
        spans = defaultdict(list)
        for r in substring.duplicate_passages(table).collect():
            spans[r.doc_id].append((r.start_byte, r.end_byte))
        must = [(d, a, b) for h, d, a, b in windows if len(held[h]) > 1]
        assert must and not [m for m in must if not any(m[1] <= x and y <= m[2] for x, y in spans[m[0]])]


def test_passages_of_repeated_words(spark):
    """Paragraphs with the same distinct shingles link, however often they repeat them."""
    table = spark.createDataFrame([(1, "again " * 20), (2, "again " * 75)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.keep_doc_id) for r in substring.duplicate_passages(table).collect()}
    assert {(1, 20, 1), (2, 75, 1)} <= got


def test_passages_when_class_names_collide(spark, docs):
    """With names of few bits most classes share one with others; the second hash and the texts tell them apart."""
    want = result(substring.duplicate_passages(docs))
    assert result(substring.duplicate_passages(docs, key_bits=10)) == want


def test_odd_and_empty_tables(spark, odd, empty):
    """Nothing crashes, and each row has its result."""
    labels = spark.createDataFrame([(5, 1), (8, 0), (9, None), (10, 0), (6, 1), (12, 1), (11, 0)], "doc_id long, toxic int")
    n = len(ODD)
    for table, m in ((odd, n), (empty, 0)):
        assert toxicity.score_ids(table, toxicity.train(table, labels)).count() == m
        assert toxicity.score(table, toxicity.train(table, labels)).count() == m
        got = langid.predict(table, langid.train(table)).collect()
        assert len(got) == m
        assert {r.lang_pred for r in got if r.doc_id in (1, 2, 7, 15)} <= {"und"}
        assert fingerprint.fingerprints(table).count() == m
        assert mixing.mix(table).count() == m
        assert exact.exact_dedup(table).count() == m
        assert jaccard.shingle_groups(table).count() == m
        assert lines.LineIndex.build(table).dedup(table).count() == m
    assert substring.duplicate_passages(empty).count() == 0
    assert packing.pack_documents(empty, queries.tokenizer("word_bpe_49k.json")).count() == 0


def test_language_em_against_plain_python():
    """Shares and chosen sets equal a plain EM over the same likelihoods, for every document."""
    rng = np.random.default_rng(11)
    names = ["a", "b", "c"]
    model = langid.Languages(names, np.log(rng.dirichlet(np.full(langid.BUCKETS, 0.02), 3).T + 1e-7).astype(np.float32))
    texts = ["".join(rng.choice(list("abcdefgh "), rng.integers(5, 400))) for _ in range(40)]
    import pyarrow as pa

    got = model.shares(pa.array(texts), 1.0, 200)
    for t, share in zip(texts, got, strict=True):
        raw = b" " + t.lower().encode() + b" "
        raw = bytes(32 if x < 33 else x for x in raw)
        count = Counter((raw[i] * 0x10000 + raw[i + 1] * 0x100 + raw[i + 2]) * 0x9E3779B1 % (1 << 32) >> 16 for i in range(len(raw) - 2))
        like = {b: np.exp(model.logs[b].astype(float)) for b in count}

        def em(langs):
            p = {k: 1 / len(langs) for k in langs}
            for _ in range(2000):
                new = dict.fromkeys(langs, 0.0)
                for b, n in count.items():
                    total = sum(p[k] * like[b][k] for k in langs)
                    for k in langs:
                        new[k] += n * p[k] * like[b][k] / total
                p = {k: v / sum(count.values()) for k, v in new.items()}
            return p, sum(n * np.log(sum(p[k] * like[b][k] for k in langs)) for b, n in count.items())

        cost = np.log(max(2, len(count))) / 2
        full, _ = em([0, 1, 2])
        order = sorted(range(3), key=lambda k: -full[k])
        tried = [([k], em([k])) for k in range(3)] + [(order[:2], em(order[:2])), (order, em(order))]
        values = sorted(((f - cost * len(s), s, p) for s, (p, f) in tried), key=lambda x: -x[0])
        if values[0][0] - values[1][0] < 0.5:
            continue  # too near to call between two ways of rounding
        assert np.allclose([values[0][2].get(k, 0.0) for k in range(3)], share, atol=0.02)


def test_pu_risk_against_plain_python():
    """The fitted classifier's non-negative risk, computed term by term, is below that of any nearby one and of the trivial ones."""
    rng = np.random.default_rng(12)
    prior, n = 0.2, 600
    toxic = rng.random(n) < prior
    unl = (rng.random((n, 3)) < np.where(toxic[:, None], [0.8, 0.1, 0.5], [0.1, 0.6, 0.5])).astype(bool)
    pos = (rng.random((200, 3)) < [0.8, 0.1, 0.5]).astype(bool)

    def risk(w, b):
        loss = lambda z: float(np.logaddexp(0, -z))
        f = lambda x: sum(v for v, on in zip(w, x, strict=True) if on) + b
        own = prior * sum(loss(f(x)) for x in pos) / len(pos)
        rest = sum(loss(-f(x)) for x in unl) / len(unl) - prior * sum(loss(-f(x)) for x in pos) / len(pos)
        return own + max(0.0, rest)

    w, b = toxicity.fit_nnpu(pos, unl, prior)
    best = risk(w, b)
    assert best < risk(np.zeros(3), np.log(prior / (1 - prior))) and best < risk(np.zeros(3), 0.0)
    for _ in range(30):
        assert best <= risk(w + rng.normal(0, 0.5, 3), b + rng.normal(0, 0.5)) + 2e-3
    assert w[0] > 0 > w[1]
    found = unl @ w + b > 0
    assert found[toxic].mean() > 0.6 and found[~toxic].mean() < 0.15


def test_features_against_plain_python(rows):
    """Features, filters and likeness of whole texts, byte by byte and window by window."""
    f = fingerprint
    texts = [t for _, t in rows if t and len(t) < 900][:25] + ["", "short", "a" * 100, "ab" * 40]
    hist = Counter()
    bins = {}
    for t in texts:
        raw = t.encode()
        own = []
        for i in range(len(raw) - f.WINDOW + 1):
            s = sum(round(1024 * c * np.log2(c)) for c in Counter(raw[i : i + f.WINDOW]).values())
            own.append((f._TOP - s) * (f.BINS - 1) // f._TOP)
        bins[t] = own
        hist.update(own)
    order = sorted((b for b in hist if b >= f.BINS // 8), key=lambda b: (hist[b], -b))
    rank = {b: k for k, b in enumerate(order)}
    table = f.ranks(np.array([hist[b] for b in range(f.BINS)]))
    assert {b: int(table[b]) for b in order} == rank
    want = {}
    for t in texts:
        raw, r = t.encode(), [rank.get(b, 65535) for b in bins[t]]
        points = Counter()
        padded = [65535] * (f.POP - 1) + r + [65535] * (f.POP - 1)
        for i in range(len(padded) - f.POP + 1):
            run = padded[i : i + f.POP]
            points[i + run.index(min(run)) - f.POP + 1] += 1
        starts = [i for i in range(len(r)) if r[i] < 65535 and points[i] >= f.POPULAR]
        if not starts and raw:
            starts = [r.index(min(r))] if r else [0]
        hashes = []
        for i in starts:
            part = raw[i : i + f.WINDOW]
            h = 0
            for k, x in enumerate(part):
                h = (h + int(f._BYTES[x]) * pow(0x9E3779B97F4A7C15, k, 1 << 64)) % (1 << 64)
            hashes.append(int(f.mix(np.array([(h + len(part)) % (1 << 64)], np.uint64))[0]))
        hashes = list(dict.fromkeys(hashes))
        chain = []
        for k in range(0, len(hashes), f.PER_FILTER):
            bits = {(h >> 11 * i) & (f.BITS - 1) for h in hashes[k : k + f.PER_FILTER] for i in range(f.PROBES)}
            chain.append(np.packbits([b in bits for b in range(f.BITS)]))
        want[t] = np.array(chain, np.uint8).reshape(-1, f.BITS // 8)
    got = dict(zip(texts, f._digests(texts, table), strict=True))
    assert all(got[t].shape == want[t].shape and (got[t] == want[t]).all() for t in texts)

    def like(a, b):
        if a.shape == b.shape and (a == b).all():
            return 1.0
        if not len(a) or not len(b):
            return 0.0
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        bits = lambda x: set(np.flatnonzero(np.unpackbits(x)))
        best = []
        for x in a:
            found = []
            for y in b:
                n, m = len(bits(x)), len(bits(y))
                found.append((len(bits(x) & bits(y)) - n * m / f.BITS) / max(min(n, m) - n * m / f.BITS, 1e-9))
            best.append((max(found), len(bits(x))))
        return min(1.0, max(0.0, sum(v * n for v, n in best) / sum(n for _, n in best)))

    for a, b in zip(texts, texts[1:]):
        assert f.likeness(got[a], got[b]) == pytest.approx(like(want[a], want[b]), abs=1e-9)
