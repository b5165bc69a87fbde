"""Groups of near-duplicates against every pair's Jaccard similarity."""

import random

import corpus_pipeline as pipeline
from brute import jaccard_groups as groups
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallypact.llm import near, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(300)]
    out = [(1, None), (2, " "), (3, "one two"), (4, "ONE  two"), (5, "one three")]
    for n in range(40):
        # Chains of edits: neighbours are near 0.8 on either side, ends are far apart.
        base = list(base)
        for _ in range(rng.choice((3, 6, 9))):
            base[rng.randrange(300)] = rng.choice(words)
        out.append((100 - n, " ".join(base)))
    head = " ".join(rng.choice(words) for _ in range(200))
    return out + [(200 + n, head + " " + " ".join(rng.choice(words) for _ in range(40 + 5 * n))) for n in range(12)]


def test_groups(spark):
    rows = texts()
    out = near.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert 3 < len(set(want.values())) < len(want) - 20


def test_stage_keeps_one_of_edited_copies(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts()]
    docs = spark.createDataFrame(rows + [(None, "alone", "en", "s", 5)], SCHEMA)
    kept = pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted({0, *groups(texts()).values()})


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(set(want.values()))


def test_empty(spark):
    assert near.first_of_group(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_that_share_a_passage_make_no_pairs(spark):
    rng = random.Random(9)
    passage = [f"common{k}" for k in range(60)]
    rows = [(n, " ".join(passage + [f"own{rng.randrange(10**9)}" for _ in range(30)])) for n in range(120)]
    # Edited copies of one of them stay linked.
    rows += [(500 + k, rows[7][1] + f" end{k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = near.marks(docs)
    open_ = marked.select(F.explode("keys").alias("key"), "class", "n", "bits").withColumns(
        {"many": F.count("*").over(W.partitionBy("key")), "ordinal": F.lit(0.0), "root": F.col("class")}).filter("many > 1")
    assert near._met(open_, 0, 1).count() <= 6
    out = near.components(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == groups(rows)


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    """A phrase said many times makes the fingerprint, but few of the distinct shingles."""
    rng = random.Random(2)
    phrase = " ".join(f"said{k}" for k in range(11))
    rows = [(n, " ".join([phrase] * 60 + [f"own{rng.randrange(10**9)}" for _ in range(20)])) for n in (4, 9)] + [(1, "other words")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in simhash.digest(docs).collect()} == {1: 1, 4: 4, 9: 4}
    assert groups(rows) == {1: 1, 4: 4, 9: 9}
    assert {r["doc_id"]: r["component_id"] for r in near.components(docs).collect()} == {1: 1, 4: 4, 9: 4}
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 4]
