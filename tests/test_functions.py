"""Column functions against literal cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions import billing, calls, documents, fleet, lifecycle, people, terms, text
from tallypact.operators.records import TIERS, band


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize("wording,calculation,expected", [
    ("pvpm", None, "recurring"), ("$1.00 pvpm", None, "recurring"),
    ("per unit per month", None, "recurring"), ("per card", None, "usage"),
    ("per driver per month", None, "recurring_per_driver"),
    ("per litre; paid quarterly", "rebate on qualifying fuel spend", "credit"),
    ("", "Ten-percent (10%) of charges per transaction", "usage"), (None, None, "usage"),
])
def test_frequency_class(spark, wording, calculation, expected):
    col = billing.frequency_class(F.col("f"), F.col("c")).billing_class
    assert one(spark, [(wording, calculation)], "f string, c string", col) == [(expected,)]


def test_names_that_share_a_key(spark):
    names = ["Fuel Management Program", "Fuel Management",
             "FUEL MANAGEMENT PROGRAM (SECTION 2(B) OF THIS SOW)", "Fuel Management Services"]
    keys = one(spark, [(n,) for n in names], "n string", text.normalise_name(F.col("n")))
    # Brackets inside brackets close at the first one, which leaves the letters in between.
    assert len({k[0] for k in keys}) == 1


def test_slug(spark):
    col = text.slugify(F.col("n"))
    assert one(spark, [("Motor Vehicle Record (MVR) Program",), ("",), (None,)], "n string",
               col) == [("motor-vehicle-record",), ("unnamed",), ("unnamed",)]


def test_heading_is_title_cased_between_letters(spark):
    col = text.clean_heading(F.col("h"))
    rows = [("MVR-POINT  PROGRAM (SECTION 4)",), ("Monthly fee",)]
    assert one(spark, rows, "h string", col) == [("MVR-Point Program",), (None,)]


def test_document_type(spark):
    lease, service = "master lease agreement ", "master services agreement "
    rows = [(lease * 3 + service,), (service + lease,), ("nothing here",), (None,),
            ("Statement of Work",)]
    got = one(spark, rows, "t string", documents.classify_doc_type(F.col("t")).doc_type,
              documents.classify_doc_type(F.col("t")).confidence)
    assert [g[0] for g in got] == ["MLA", "MSA", "UNKNOWN", "UNKNOWN", "MSA"]
    assert got[0][1] > 0.6 and got[1][1] == 0.6 and got[2][1] == 0.0


def test_effective_date(spark):
    rows = [("effective as of January 5, 2024",), ("dated as of 3 March 2022",),
            ("Effective Date: 2021-07-01",), ("effective as of February 30, 2024",),
            ("dated 1 May 1800",)]
    got = one(spark, rows, "t string", documents.effective_date(F.col("t")).cast("string"))
    assert [g[0] for g in got] == ["2024-01-05", "2022-03-03", "2021-07-01", None, None]


def test_scope(spark):
    rows = [(True, True), (True, False), (False, True), (False, False)]
    got = one(spark, rows, "l boolean, s boolean", documents.scope_of(F.col("l"), F.col("s")))
    assert [g[0] for g in got] == ["LEASE_AND_SERVICE", "LEASE_ONLY", "SERVICE_ONLY", None]


def test_effective_fleet(spark):
    rows = [(40, None), (40, 100), (0, None), (0, 0)]
    got = one(spark, rows, "n int, o int", billing.effective_fleet(F.col("n"), F.col("o")))
    assert [g[0] for g in got] == [40, 100, 0, 1]


def test_tier_uses_first_band_in_order(spark):
    tiers = F.array(band(F.lit(1), F.lit(250), F.lit(21.5)), band(F.lit(100), F.lit(None),
                                                                  F.lit(9))).cast(TIERS)
    got = one(spark, [(100,), (251,), (0,)], "f int", billing.tier_amount(tiers, F.col("f")))
    assert [g[0] for g in got] == [Decimal("21.50"), Decimal("9.00"), None]


def test_call_cost(spark):
    price = calls.price_of(F.col("m"))
    cols = [F.col(c) for c in ("i", "o", "r", "w")]
    rows = [("global.anthropic.claude-sonnet-4-6", 3416, 58910, 237161, 47432),
            ("mystery", 1, 1, 1, 1)]
    got = one(spark, rows, "m string, i long, o long, r long, w long",
              calls.call_cost_usd(price, *cols), calls.uncached_cost_usd(price, *cols))
    assert got[0][0] == pytest.approx(1.143, abs=0.002)
    assert got[0][1] == pytest.approx(1.748, abs=0.002)
    assert got[1] == (None, None)


def test_longest_family_wins(spark):
    got = one(spark, [("global.amazon.nova-2-lite-v1:0",)], "m string",
              calls.price_of(F.col("m")).output)
    assert got == [(Decimal("2.950000"),)]


def test_truncated(spark):
    rows = [("end_turn", 10, 5000), ("length", 10, 5000), (None, 4968, 5000), (None, 10, 5000)]
    got = one(spark, rows, "s string, o long, c int", calls.truncated(
        F.lit(False), F.lit(False), F.col("s"), F.col("o"), F.col("c")))
    assert [g[0] for g in got] == [False, True, True, False]


def test_every_status_has_one_stage(spark):
    got = one(spark, [(s,) for s in fv.STATUSES] + [(None,), ("odd",)], "s string",
              lifecycle.stage_of(F.col("s")))
    assert all(g[0] in fv.STAGES for g in got)
    assert got[-1][0] == got[-2][0] == "NEGOTIATIONS"
    assert sum(len(v[1]) for v in fv.STAGES.values()) == len(fv.STATUSES)


def test_groups(spark):
    rows = [("[provider finance]",), ("client,finance",), ('["provider"]',), ("",), (None,)]
    got = one(spark, rows, "c string", people.parse_groups(F.col("c")))
    assert [g[0] for g in got] == [["provider", "finance"], ["client", "finance"],
                                   ["provider"], [], []]


def test_vehicle_rules(spark):
    rows = [("CUSTOMER_OWNED", "IN_STOCK", 1), ("CUSTOMER_OWNED", "ASSIGNED", None),
            ("PROVIDER_OWNED", "IN_STOCK", None)]
    got = one(spark, rows, "o string, s string, c int",
              fleet.vehicle_problem(F.col("o"), F.col("s"), F.col("c")),
              fleet.is_available(F.col("o"), F.col("s")))
    assert got[0][0] and got[1][0] and got[2] == (None, True)


def test_fee_line(spark):
    got = one(spark, [(Decimal("12.50"), Decimal("8.00"))],
              "a decimal(18,2), r decimal(18,2)", billing.fee_line(
                  F.col("a"), F.col("r"), F.lit("cost_plus"), F.lit("per_unit"),
                  F.lit(None).cast("decimal(18,2)"), F.lit(None).cast(TIERS)))
    assert got == [("$12.5 · cost + 8% · per unit",)]


def test_rounded_ratio_is_half_up(spark):
    got = one(spark, [(1, 8), (1, 3), (5, 0)], "p int, w int",
              billing.rounded_ratio(F.col("p"), F.col("w"), 2))
    assert [g[0] for g in got] == [0.13, 0.33, 0.0]


def test_needs_review_threshold_is_inclusive(spark):
    schema = ("info_type string, item string, included boolean, amount decimal(18,2), "
              "calculation string, confidence double, citations array<string>, "
              f"tier_bands {TIERS}, catalog_match string")
    rows = [("definition", None, None, None, None, 0.8, ["q"], None, None),
            ("definition", None, None, None, None, 0.9, ["q"], None, None),
            ("definition", None, None, None, None, 0.9, [], None, None),
            ("pricing_item", "x", False, None, None, 0.9, ["q"], None, "exact"),
            ("pricing_item", "x", True, None, None, 0.9, ["q"], None, "exact"),
            ("pricing_item", "x", True, None, None, 0.9, ["q"], None, "fuzzy")]
    got = one(spark, rows, schema, terms.needs_review())
    assert [g[0] for g in got] == [True, False, True, True, False, True]
