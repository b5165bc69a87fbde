"""Fill-in-the-middle, hard negatives and sharding against plain Python, on odd inputs."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallypact.llm import fill_middle, hard_negatives, sharding

rng = random.Random(11)
LONG = "\n".join("é" * rng.randint(0, 200) if rng.random() < 0.9 else "x" * 5000 for _ in range(20_000))
TEXTS = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "ends\n"), (7, "ünï\nçöde 𝄞\n\ntext"), (8, "a <P> b\nc"),
    (9, "x\n<S>"), (10, "<M>"), (11, "< P >\n<P\n>"), (12, LONG), (13, "same\nrow\n"), (13, "same\nrow\n"), (None, "no\nid\nat all"),
    (None, None), (-7, "minus\r\nseven\r\n"), (14, "<\n<P<S\n<M"), (15, "<S\n<\n<P"), (16, "\x00\n\x0b\x85 \n"),
    *[(100 + k, "\n".join("word " * rng.randint(0, 9) for _ in range(k))) for k in range(60)],
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if k % 5 == 0 else ["hot", "hot", "", "b"][k % 4], 0) for k, (i, t) in enumerate(TEXTS)]
    out = spark.createDataFrame(rows, SCHEMA)
    for clash in ("stratum", "h", "n", "slice", "place", "output", "form", "shard", "slot", "total", "all", "fraction"):
        out = out.withColumn(clash, F.lit("clash"))
    return out.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_fill_middle(docs, empty):
    same(fill_middle.digest(docs), brute.op11(TEXTS))
    assert fill_middle.digest(empty).collect() == []


@pytest.mark.parametrize("error", [2, 7, 128, 100_000])
def test_index_is_exact_and_bounded(error):
    raw = LONG.encode()
    places = fill_middle.boundaries(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    want = np.cumsum([0, *map(len, LONG.splitlines(keepends=True))])
    assert places.tolist() == want.tolist()
    index = fill_middle.fit(places, error)
    assert np.abs(index.missed).max() <= error
    assert [fill_middle.find(index, r) for r in range(0, len(places), 97)] == want[::97].tolist()
    assert len(index.rank) < len(places) / 2 or error < 100


def test_index_of_jumps_and_single_places():
    for places in ([0], [0, 1], [0, 0, 0, 0], [0, 1, 2, 3, 10**9, 10**9 + 1], list(range(0, 10**7, 10))[:300_000]):
        index = fill_middle.fit(np.array(places, np.int64), 16)
        assert [fill_middle.find(index, r) for r in range(0, len(places), max(1, len(places) // 50))] == places[::max(1, len(places) // 50)]
        assert np.abs(index.missed).max() <= 16


def test_index_table_finds_the_cuts(docs):
    table = {r["doc_id"]: r for r in fill_middle.boundary_index(docs, 4).collect()}
    for i, text in TEXTS:
        if i in (None, 13):
            continue
        r = table[i]
        lines = brute.re.findall(r"[^\n]*\n|[^\n]+", text or "")
        index = fill_middle.Index(*(np.array([s[c] for s in r["segments"]]) for c in ("rank", "place", "slope")), np.array(r["missed"]))
        assert r["n"] == len(lines)
        assert fill_middle.find(index, len(lines) // 2) == sum(map(len, lines[:len(lines) // 2]))


@pytest.mark.parametrize(("rate", "first"), [(0, 50), (50, 0), (50, 100)])
def test_fill_middle_rates(docs, rate, first):
    got = fill_middle.transform(docs, 7, rate, first)
    want = [r[:6] for r in brute.op11(TEXTS, 7, rate, first)]
    same(got.withColumn("output", F.sha2("output", 256)), want)


def test_restore_every_form():
    for form in ("psm", "spm"):
        for parts in (("", "", ""), ("<", "<P", "<M<"), ("<S", "", "<"), ("a>", "S>", ">P>")):
            if any(s in "".join(parts) for s in ("<P>", "<S>", "<M>")):
                continue
            assert fill_middle.restore(form, fill_middle.arrange(form, *parts)) == "".join(parts)


def test_strassen_is_exact():
    g = np.random.default_rng(3)
    for m, k, n in ((1, 1, 1), (7, 5, 3), (33, 65, 70), (64, 64, 64), (0, 4, 4), (50, 0, 50)):
        a, b = g.integers(-300, 300, (m, k)), g.integers(-300, 300, (k, n))
        assert (hard_negatives.strassen(a, b, 2) == a @ b).all()
    big = g.integers(-(1 << 40), 1 << 40, (9, 9))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in big.T] for r in big]
    wrapped = [[(v + (1 << 63)) % (1 << 64) - (1 << 63) for v in r] for r in want]
    assert hard_negatives.strassen(big, big, 2).tolist() == wrapped


def vectors():
    g = np.random.default_rng(4)
    rows = [(k, [float(x) for x in g.normal(0.3, 0.4, 8)], int(k % 3)) for k in range(0, 450, 2)]
    rows += [(k, rows[3][1], 1) for k in range(901, 915)]
    rows += [(1000, None, 1), (1100, [0.1] * 8, None), (1200, [0.1, None], 1), (1300, [float("nan")] * 8, 1),
             (1400, [float("inf")] * 8, 1), (None, [0.5] * 8, 1), (1500, [], 1), (1600, [0.5, 0.5], 2), (1700, [0.0] * 8, 2),
             (300, [0.2] * 8, 0), (300, [0.2] * 8, 0), (-100, [0.9] * 8, 1), (500, [0.1] * 8, 9), (2100, [0.4] * 8, 9), (77, [1.0] * 8, 9)]
    return rows


@pytest.fixture(scope="module")
def embeddings(spark):
    out = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    for clash in ("block", "bucket", "score", "ids", "parts", "row"):
        out = out.withColumn(clash, F.lit("clash"))
    return out.repartition(3)


def test_hard_negatives(spark, embeddings):
    want = brute.op12(vectors())
    assert len(want) > 50
    same(hard_negatives.digest(embeddings), want)
    assert hard_negatives.digest(spark.createDataFrame([], embeddings.schema)).collect() == []


def test_hard_negatives_in_small_tiles(embeddings):
    got = hard_negatives.mine(embeddings, F.col("vec_id") % 10 == 0, hard_negatives.relabelled(), 3, 4, block=10, anchor_tile=3, row_tile=7, cell=2)
    same(got, brute.op12(vectors(), 10, 3, 4))


def test_heaps_that_let_go_are_merged_the_same():
    g = np.random.default_rng(6)
    key, score, ids = g.integers(0, 40, 4000), g.integers(-9, 9, 4000), g.permutation(4000)
    heaps = hard_negatives._Heaps(3, ("key", "score", "id"), held=64)
    parts = []
    for at in range(0, 4000, 50):
        heaps.add(*(c[at:at + 50] for c in (key, score, ids)))
        parts += heaps.batches()
    parts += heaps.batches(last=True)
    assert len(parts) > 2
    rows = pa.Table.from_batches(parts).to_pylist()
    for k in range(40):
        want = sorted(((-s, i) for s, i in zip(score[key == k].tolist(), ids[key == k].tolist(), strict=True)))[:3]
        assert sorted((-r["score"], r["id"]) for r in rows if r["key"] == k)[:3] == want


def test_sharding(docs, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    same(sharding.digest(docs), brute.op13(rows))
    assert sharding.digest(empty).collect() == []
    got = sharding.interleave(docs, 7, 3, slice_rows=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute.op13(rows, 7, 3), key=repr)


def test_shards_hold_the_mixture(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "rare").otherwise("other").alias("source"))
    rows = sharding.interleave(docs, 20, keep=("source",), slice_rows=100).collect()
    whole, by = Counter(r["__source"] for r in rows), {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert len(by) == 20
    for members in by.values():
        assert len(members) == 150 and sorted(r["slot"] for r in members) == list(range(150))
        for source, n in Counter(r["__source"] for r in members).items():
            assert abs(n - whole[source] / 20) <= 1


def test_dealt_files(spark, docs, tmp_path):
    back = sharding.deal(docs, str(tmp_path / "shards"), 5)
    assert back.count() == len(TEXTS) and {r["shard"] for r in back.select("shard").collect()} == set(range(5))
    assert set(back.columns) == set(docs.columns)
    want = Counter(t for _, t in TEXTS)
    assert Counter(r["text"] for r in back.collect()) == want
