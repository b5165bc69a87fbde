"""Scoring of small runs inside a row, and of large runs by joins."""

import random

import pytest

from tallypact.plans import quality

SCHEMA = "run_id long, info_type string, record_no string, item string"


def frames(spark, seed=3):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(12)]

    def rows(types):
        out = [(run, rng.choice(types), f"{n}", " ".join(rng.sample(words, rng.choice((1, 2, 3, 4)))))
               for run in range(12) for n in range(rng.choice((0, 1, 6, 14)))]
        # A line that comes twice, a record without words, a run of one side, rows without run, type or number.
        return out + out[:3] + [(50, "a", "1", "Fee"), (50, None, "2", "word1 word2"), (None, "a", "3", "word1 word2"),
                                (51, "a", None, "word1 word3"), (rng.choice((60, 61)), "a", "4", "word5 word6 word7")]

    return [quality.keyed(spark.createDataFrame(rows(types), SCHEMA), ["item"]) for types in (["a", "b"], ["a", "b", "c"])]


def counted(df):
    return sorted(map(str, df.collect()))


def test_small_and_large_runs_are_scored_alike(spark, monkeypatch):
    want, got = frames(spark)
    want = want.filter("record_no is not null")
    got = got.filter("record_no is not null")
    one = counted(quality.score_runs(want, got, got))
    monkeypatch.setattr(quality, "SMALL", 0)
    assert one == counted(quality.score_runs(want, got, got))
    assert len(one) > 20


@pytest.mark.parametrize("by", [quality.GROUP, ["run_id"]])
def test_candidates_of_small_and_large_groups(spark, monkeypatch, by):
    want, got = frames(spark)
    one = counted(quality.candidate_scores(want, got, 0.5, by))
    monkeypatch.setattr(quality, "SMALL", 0)
    assert one == counted(quality.candidate_scores(want, got, 0.5, by))
    assert len(one) > 5


def test_programs_of_small_and_large_runs(spark, monkeypatch):
    want, got = (f.withColumnRenamed("item", "program") for f in frames(spark))
    one = counted(quality.programs_matched(want, got))
    monkeypatch.setattr(quality, "SMALL", 0)
    assert one == counted(quality.programs_matched(want, got))
    assert len(one) > 5


@pytest.mark.parametrize("scored", [
    lambda want, got: quality.candidate_scores(want, got, 0.5, quality.GROUP),
    lambda want, got: quality.score_runs(want, got, got),
    lambda want, got: quality.programs_matched(want.withColumnRenamed("item", "program"), got.withColumnRenamed("item", "program"))])
def test_small_groups_are_shuffled_once_a_side(spark, scored):
    want, got = (f.filter("run_id < 40") for f in frames(spark))
    plan = scored(want, got)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
