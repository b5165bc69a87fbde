"""What is left on disk: no shuffle files after a write, no columns that nobody reads."""

from pyspark.sql import functions as F

from tallypact import session
from tallypact.plans import corrections, terms
from tallypact.workload import load

load()
from tallypact.workload import agreements, contract_terms  # noqa: E402

SF = "/root/testdata/sf0.001"


def shuffles(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def columns_written(monkeypatch, *modules):
    out, keep = {}, session.cut_lineage
    for module in modules:
        monkeypatch.setattr(module, "cut_lineage", lambda df, name: out.setdefault(name, df.columns) and keep(df, name))
    return out


def test_a_lineage_cut_leaves_no_shuffle(spark):
    spark.conf.unset(session.CLEANUP_KEY)
    before = shuffles(spark)
    df = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    # Files that older queries left may go meanwhile.
    assert shuffles(spark) <= before
    assert {r["count"] for r in df.collect()} == {142, 143}
    assert spark.conf.get(session.CLEANUP_KEY, None) != "true"


def test_folds_write_the_columns_that_are_read(spark, monkeypatch):
    out = columns_written(monkeypatch, terms, contract_terms)
    contract_terms.amount_conflicts(spark, SF)
    assert not {"tier_bands", "citations", "notes", "definition"} & set(out.pop("folded"))
    contract_terms.duplicate_reading_fold(spark, SF)
    assert not {"tier_bands", "citations", "ordinal", "gained"} & set(out.pop("folded"))
    # The report reads folded rows from the same table as what is kept and dropped.
    report = contract_terms.fold_report(spark, SF)
    assert set(out) == {"folded"} and not {"tier_bands", "citations"} & set(out["folded"])
    assert "min_by" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_corrected_terms_write_the_columns_that_are_read(spark, monkeypatch):
    out = columns_written(monkeypatch, corrections)
    agreements.rebuilt_coverage(spark, SF)
    assert "term_key" not in out["corrected"] and {"program", "item", "corrected"} <= set(out["corrected"])
