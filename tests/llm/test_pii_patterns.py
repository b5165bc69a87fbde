"""Patterns of candidates beyond what one list can hold."""

from pyspark.sql import functions as F

from tallypact.llm import pii


def features(code):
    """The values of a pattern by its number."""
    out = []
    for size in reversed(pii.RANGES):
        out.append(F.pmod(code, F.lit(size)).cast("int"))
        code = F.floor(code / size)
    return F.array(*reversed(out))


def test_many_patterns(spark):
    # Each 97th pattern: context 2 is always validated, all others never.
    counted = spark.range(0, pii.PATTERNS, 97).select(F.lit(3).alias("kind"), features(F.col("id")).alias("features"))
    good = F.get("features", F.lit(9)) == 2
    counted = counted.select("*", F.lit(10).alias("n"), F.when(good, 10).otherwise(0).alias("n_known"),
                             F.lit(10).alias("m"), F.when(good, 10).otherwise(0).alias("m_known"))
    assert counted.count() > 40_000
    bits = pii.select(counted)
    assert len(bits) <= pii.PATTERNS // 8 + 1
    wrong = counted.filter(pii._selected(F.col("features"), bits) != good)
    assert wrong.count() == 0
    assert counted.filter(good).count() > 1000
