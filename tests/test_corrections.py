"""Corrections carried through: only what a batch touches is looked up, rebuilt or billed again."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallypact.operators.records import TIERS
from tallypact.plans import billing, corrections

PROGRAMS = "program_id string, position string, name string, aliases array<string>"
ITEMS = "program_id string, item_id string, position string, name string, aliases array<string>"
TERMS = ("engagement_id long, document_id long, version int, term_key string, category string, program string, "
         "item string, amount decimal(18,2), calculation string, superseded boolean, program_id string, "
         "item_id string, catalog_match string")
LINES = ("engagement_id long, document_id long, version int, term_key string, program string, item string, "
         f"frequency string, amount decimal(18,2), rate_pct decimal(18,2), tier_bands {TIERS}, superseded boolean, "
         "approved boolean, confidence double, override_amount decimal(18,2), override_class string")


def test_a_correction_moves_its_line_and_the_coverage_of_its_document(spark):
    programs = spark.createDataFrame([("fuel", "a", "Fuel Card", []), ("toll", "b", "Toll Pass", ["Road Pass"])], PROGRAMS)
    items = spark.createDataFrame([("toll", "fee", "a", "Monthly Fee", [])], ITEMS)
    stored = spark.createDataFrame([
        (1, 1, 1, "a", "pricing", "Fuel Card", "Monthly Fee", Decimal(5), None, False, "fuel", None, "exact"),
        (1, 1, 1, "b", "pricing", "Fuel Card", None, None, "x", False, "fuel", None, "exact"),
        (1, 2, 1, "c", "pricing", "Zzz", None, Decimal(1), None, False, "stored", None, "alias"),
        (1, 3, 1, "d", "legal", "Fuel Card", None, None, None, False, None, None, None)], TERMS)
    asked = spark.createDataFrame([("a", "Road Pass", None, Decimal(7)), ("d", "Toll Pass", None, None), ("gone", "x", "y", None)],
                                  "term_key string, program string, item string, amount decimal(18,2)")
    after = corrections.place_again(stored, asked, programs, items)
    got = {r.term_key: (r.program, r.amount, r.program_id, r.item_id, r.catalog_match, r.corrected) for r in after.collect()}
    assert got == {"a": ("Road Pass", Decimal(7), "toll", "fee", "alias", True),
                   "b": ("Fuel Card", None, "fuel", None, "exact", False),
                   "c": ("Zzz", Decimal(1), "stored", None, "alias", False),
                   "d": ("Toll Pass", None, None, None, None, True)}
    before = spark.createDataFrame([(1, 1, 1, "fuel", ["old"], 2), (1, 2, 1, "kept", [], 9)],
                                   "engagement_id long, document_id long, version int, program_id string, "
                                   "item_ids array<string>, priced_items long")
    rows = corrections.rebuild_coverage(before, after).collect()
    assert sorted((r.document_id, r.program_id, list(r.item_ids), r.priced_items) for r in rows) == [
        (1, "fuel", [], 1), (1, "toll", ["fee"], 1), (2, "kept", [], 9)]


def test_overrides_are_decided_and_only_their_engagements_billed(spark):
    def line(engagement, key, amount, override=None, kind=None, superseded=False):
        return (engagement, engagement, 1, key, "P", "i", "per vehicle per month", Decimal(amount), None, None, superseded,
                True, 0.9, override, kind)

    terms = spark.createDataFrame([line(1, "a", 10), line(1, "b", 4, Decimal(6)), line(1, "gone", 4, superseded=True),
                                   line(2, "c", 3), line(3, "d", 3)], LINES)
    in_force = spark.createDataFrame([(e, "MSA", e, 1) for e in (1, 2, 3)],
                                     "engagement_id long, doc_type string, document_id long, version int")
    fleets = spark.createDataFrame([(1, 2), (2, 5), (3, 0)], "engagement_id long, fleet_size long")
    statuses = spark.createDataFrame([(1, "PENDING_BILLING_AUDIT"), (2, "ACTIVE"), (3, None)], "engagement_id long, status string")
    lines = billing.config_lines(billing.billed_lines(terms), in_force)
    asked = spark.createDataFrame(
        [(1, "a", None, "one_time"), (1, "b", Decimal(7), None), (1, "gone", Decimal(1), None), (1, "x", Decimal(1), None),
         (1, "a2", None, "odd"), (2, "c", Decimal(9), None), (3, "d", Decimal(9), None)],
        "engagement_id long, term_key string, new_amount decimal(18,2), new_class string")
    decided = corrections.decide_overrides(asked, lines, statuses)
    assert {r.term_key: r.refused for r in decided.collect()} == {
        "a": None, "b": None, "gone": "no such charge", "x": "no such charge", "a2": "unknown class",
        "c": "not under audit", "d": "not under audit"}
    stored = billing.config_dues(lines, fleets)
    assert {r.engagement_id: r.monthly_recurring for r in stored.collect()} == {1: Decimal(32), 2: Decimal(15), 3: Decimal(0)}
    # What is stored for engagements without an accepted override is kept as it is.
    stored = stored.withColumn("monthly_recurring", F.when(F.col("engagement_id") == 2, Decimal("99.00")).otherwise(F.col("monthly_recurring")))
    out = corrections.rebill(stored, terms, decided.filter("refused is null"), in_force, fleets)
    assert {r.engagement_id: (r.monthly_recurring, r.rebilled) for r in out.collect()} == {
        1: (Decimal(14), True), 2: (Decimal(99), False), 3: (Decimal(0), False)}


def test_bill_makes_schedules_once(spark):
    lines = spark.createDataFrame([(1, (Decimal(2), "per_vehicle_per_month", None)), (1, None)],
                                  f"engagement_id long, fee struct<amount: decimal(18,2), unit_basis: string, tier_bands: {TIERS}>")
    fleets = spark.createDataFrame([(1, 3), (2, 4), (9, 9)], "engagement_id long, fleet_size long")
    engagements = spark.createDataFrame([(1, "quarterly"), (2, "annual")], "engagement_id long, billing_frequency string").withColumn(
        "billing_start", F.lit("2024-01-31").cast("date"))
    bills, rows = billing.bill(engagements, lines, fleets, engagements.filter("engagement_id = 2"))
    assert sorted((r.engagement_id, r.charges, r.monthly_recurring) for r in bills.collect()) == [
        (1, 1, Decimal(6)), (2, 0, Decimal(0))]
    assert {r.engagement_id for r in rows.collect()} == {1} and rows.count() == 4
