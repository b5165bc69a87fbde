"""Tables that batches change, and the continuous jobs over several files."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.operators import ordered
from tallypact.plans import catalog, changes, lifecycle, migrations, review, terms
from tallypact.sources.batch_table import BatchTable
from tallypact.streaming import jobs

DOC = "engagement_id bigint, document_id bigint, version int"
RECORD = f"{DOC}, ordinal int, info_type string, program string, amount double, frequency string, confidence double, " \
         "calculation string, notes string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return BatchTable(spark, str(tmp_path / "t"), "k bigint, n bigint", ["k"], 8)


def add(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))


def batch(spark, rows):
    return spark.createDataFrame(rows, "k bigint, n bigint")


def test_batches_change_touched_buckets_only(spark, table):
    assert rows_of(table.rows()) == []
    table.merge(0, batch(spark, [(k, 1) for k in range(40)]), add)
    before = {f for f in table.rows().inputFiles()}
    table.merge(1, batch(spark, [(3, 5), (99, 7)]), add)
    want = sorted([(k, 6 if k == 3 else 1) for k in range(40)] + [(99, 7)])
    assert rows_of(table.rows()) == want
    after = set(table.rows().inputFiles())
    assert 1 <= len(after - before) <= 2 and len(after & before) >= 6
    # A retried batch reads what was there before it.
    table.merge(1, batch(spark, [(3, 5), (99, 7)]), add)
    assert rows_of(table.rows()) == want


def test_edits_come_between_batches(spark, table):
    table.merge(0, batch(spark, [(1, 1), (2, 1)]), add)
    table.edit(batch(spark, [(1, 10)]), add)
    for _ in range(2):
        table.merge(1, batch(spark, [(1, 100)]), add)
    assert rows_of(table.rows()) == [(1, 111), (2, 1)]


def test_superseded_files_are_deleted(spark, table):
    """What is on disk is the table before the last batch and the table after it, whatever the number of batches."""
    for epoch in range(5):
        table.merge(epoch, batch(spark, [(k, 1) for k in range(40)]), add)
    table.merge(5, batch(spark, [(3, 1)]), add)
    table.merge(5, batch(spark, [(3, 1)]), add)
    assert rows_of(table.rows()) == sorted((k, 6 if k == 3 else 5) for k in range(40))
    kept = {f.parent.parent.name for f in Path(table.path).glob("data/*/bucket=*/*.parquet")}
    assert kept == {"5000", "6000"}


def test_a_bucket_may_become_empty(spark, table):
    table.merge(0, batch(spark, [(1, 1), (2, 1)]), add)
    table.merge(1, batch(spark, [(1, 0)]), lambda old, new: old.join(new, "k", "left_anti"))
    assert rows_of(table.rows()) == [(2, 1)]
    assert rows_of(table.before(2, batch(spark, [(1, 0)]))) in ([], [(2, 1)])


def test_reads_by_key_open_their_bucket_only(spark, table):
    table.merge(0, batch(spark, [(k % 20, k) for k in range(100)]), lambda old, new: new)
    one = table.at(7)
    assert rows_of(one) == [(7, k) for k in range(7, 100, 20)]
    assert len(one.inputFiles()) == 1 < len(table.rows().inputFiles())
    asked = batch(spark, [(3, 0), (3, 1), (50, 0)]).drop("n")
    assert {r.k for r in table.of(asked).collect()} == {3} and table.of(asked).count() == 5
    assert rows_of(table.at(50)) == [] and rows_of(table.at(None)) == []


def test_written_upsert_keeps_untouched_files(spark, tmp_path):
    stored = BatchTable(spark, str(tmp_path), "k bigint, v string", ["k"], 8)
    stored.merge(0, spark.createDataFrame([(k, "base") for k in range(40)] + [(None, "base")], "k bigint, v string"),
                 lambda old, new: new)
    before = set(stored.rows().inputFiles())
    change = spark.createDataFrame([(5, "early", 1), (5, "late", 2), (77, "new", 1), (None, "null", 1)],
                                   "k bigint, v string, at int").withColumn("at", F.timestamp_seconds("at"))
    for _ in range(2):
        changes.upsert_into(stored, 1, change, F.col("at"))
        now = {r.k: r.v for r in stored.rows().collect()}
        assert (now[5], now[77], now[None], now[6]) == ("late", "new", "null", "base") and len(now) == 42
    after = set(stored.rows().inputFiles())
    assert 1 <= len(before - after) <= 3 and before & after


def reading(spark, rows):
    shape = terms.stored_schema(spark.createDataFrame([], RECORD).schema)
    made = {"engagement_id": 1, "category": "pricing", "needs_review": False}
    names = [c.split()[0] for c in shape.split(", ")]
    given = ["document_id", "version", "record_id", "program", "program_id", "amount", "body_hash"]
    return spark.createDataFrame([tuple((made | dict(zip(given, r, strict=True))).get(c) for c in names) for r in rows], shape)


FIRST = [(1, 1, "a", "Fuel", "fuel", 1.0, "h1"), (1, 1, "b", "Toll", "toll", 2.0, "h2"), (1, 1, "c", "Odd", None, 3.0, "h3"),
         (2, 1, "a", "Fuel", "fuel", 1.0, "h1")]
SECOND = [(1, 1, "a", "Fuel", "fuel", 1.0, "h1"), (1, 1, "b", "Toll", "toll", 2.0, "h2x"), (1, 1, "d", "odd", None, 4.0, "h4")]
THIRD = [(1, 1, "b", "Toll", "toll", 2.0, "h2x"), (1, 1, "c", "Odd", None, 3.0, "h3"), (3, 2, "a", "Odd", None, None, "h1")]


def test_three_readings(spark, tmp_path):
    tables = jobs.TermArrival(spark, spark.createDataFrame([], RECORD).schema, str(tmp_path), 4)
    tables.apply(reading(spark, FIRST), 0)
    tables.approve(spark.createDataFrame([(1, 1, 1, r, True) for r in "abc"], f"{DOC}, record_id string, approved boolean"))
    for _ in range(2):
        tables.apply(reading(spark, SECOND), 1)
    now = {(r.document_id, r.record_id): r for r in tables.terms.rows().collect()}
    assert now[1, "a"].approved and not now[1, "a"].superseded
    moved = now[1, "b"]
    assert (moved.approved, moved.needs_review, moved.changed_since_approval, moved.created_in) == (False, True, True, 0)
    assert now[1, "c"].superseded and now[1, "c"].approved
    assert now[1, "d"].created_in == 1 and not now[2, "a"].superseded
    stored = tables.terms.rows()
    want = {r.record_id: r.action for r in terms.merge_terms(
        stored.withColumn("created_at", F.lit(0)), reading(spark, THIRD).withColumn("created_at", F.lit(0)))
        .filter("document_id = 1").collect()}
    assert want == {"a": "supersede", "b": "keep", "c": "restore", "d": "supersede"}
    tables.apply(reading(spark, THIRD), 2)
    now = {(r.document_id, r.record_id): r for r in tables.terms.rows().collect()}
    assert [now[1, r].superseded for r in "abcd"] == [True, False, False, True]
    assert now[1, "c"].approved and len(now) == 6
    # Coverage of a version is that of its last reading.
    covered = {(r.document_id, r.program_id): r.priced_items for r in tables.coverage.rows().collect()}
    assert covered == {(1, "toll"): 1, (2, "fuel"): 1}
    queue = {r.normalised: r for r in tables.unmatched.rows().collect()}
    assert (queue["odd"].seen, queue["odd"].first_seen, queue["odd"].last_seen) == (4, 0, 2)
    assert [e.example for e in queue["odd"].examples] == ["1", "3"]
    filed = spark.createDataFrame([(1, 7, 1, "CURRENT"), (2, 7, 1, "CURRENT"), (3, 8, 1, "CURRENT"), (9, 8, 1, "SUPERSEDED")],
                                  "document_id bigint, engagement_id bigint, current_version int, standing string")
    assert {r.engagement_id: r.all_extracted for r in tables.ready(filed).collect()} == {7: True, 8: False}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_reading_shuffles_terms_once(spark, tmp_path):
    shape = terms.stored_schema(spark.createDataFrame([], RECORD).schema)
    table = BatchTable(spark, str(tmp_path), f"{shape}, {terms.REVIEW_STATE}", ["document_id"], 4)
    blank = (None, 1, "a", "Fuel", "fuel", 1.0, "h1")
    plans = []

    def combine(old, new):
        plans.append(terms.apply_reading(old, new, F.lit(7), ["bucket", "share"]))
        return plans[-1]

    for epoch, rows in enumerate((FIRST + [blank], SECOND + [blank])):
        table.merge(epoch, reading(spark, rows), combine, dealt=True)
    now = rows_of(table.rows().filter("document_id = 1").select("record_id", "superseded", "changed_since_approval"))
    assert now == [("a", False, False), ("b", False, False), ("c", True, False), ("d", False, False)]
    # Terms without a key meet no other; versions that were not read stay.
    assert rows_of(table.rows().filter("document_id is null").select("superseded")) == [(False,), (False,)]
    assert table.rows().filter("document_id = 2 and not superseded").count() == 1
    assert exchanges(plans[-1].sortWithinPartitions("bucket", "document_id")) == 1


def test_queue_keeps_five_examples(spark, tmp_path):
    def seen(rows):
        return catalog.queue_of(spark.createDataFrame(rows, "raw string, example string, seen_at int"))

    first = seen([("Odd name", str(k), 0) for k in range(4)] + [("Odd  name", "3", 0)])
    second = seen([("odd name", str(k), 1) for k in range(2, 9)] + [("other", "x", 1)])
    both = {r.normalised: r for r in catalog.merge_queue(first, second).collect()}
    assert both["odd name"].seen == 12 and [e.example for e in both["odd name"].examples] == ["0", "1", "2", "3", "4"]
    assert both["other"].first_seen == 1 and len(both) == 2


EVENT = "submission_id bigint, ts timestamp, event_id bigint, action string, actor_role string"


def walk(events):
    moves = {(s, a, r): t for s, a, t, roles in fv.TRANSITIONS for r in roles}
    status, out = {}, []
    for sub, _, i, action, role in events:
        was = status.get(sub, "DRAFT")
        status[sub] = moves.get((was, action, role), was)
        out.append((sub, i, was, status[sub] != was or (was, action, role) in moves, status[sub]))
    return sorted(out)


def test_lifecycle_over_late_files(spark, tmp_path, monkeypatch):
    """One submission has a third of all events; the second file brings events older than the first file's."""
    monkeypatch.setattr(ordered, "CHUNK", 16)
    monkeypatch.setattr(lifecycle, "CHUNK", 16)
    rng = random.Random(8)
    actions = sorted({a for _, a, _, _ in fv.TRANSITIONS})
    start = datetime.datetime(2024, 1, 1)
    rows = [(0 if rng.random() < 0.33 else rng.randrange(1, 30), start + datetime.timedelta(minutes=rng.randrange(9000)), k,
             rng.choice(actions), rng.choice(["provider", "client", "system", "finance"])) for k in range(1500)]
    order = lambda part: sorted(part, key=lambda r: (r[0], r[1], r[2]))
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    out = None
    for part in (rows[:700], rows[700:]):
        spark.createDataFrame(part, EVENT).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EVENT).parquet(folder)
        out = jobs.lifecycle_state(stream, state, 4)
    want = walk(order(rows[:700]) + order(rows[700:]))
    assert rows_of(out.select("submission_id", "event_id", "status_before", "accepted", "status_after")) == want
    # Nothing new: nothing changes.
    again = jobs.lifecycle_state(spark.readStream.schema(EVENT).parquet(folder), state, 4)
    assert again.count() == 1500


def test_documents_of_several_files(spark, tmp_path):
    text = "engagement_id bigint, document_id bigint, full_text string, created_ord bigint, client_name string, expected string, " \
           "reupload boolean"
    lease = "MASTER LEASE AGREEMENT effective as of January {}, 2024. Initech"
    parts = [[(1, 10, lease.format(5), 10, "Initech", "MLA", False), (1, 11, lease.format(3), 11, "Initech", "MLA", True)],
             [(1, 12, lease.format(9), 12, "Globex", "MLA", True), (2, 13, "no agreement", 13, "Initech", "MSA", False)],
             [(1, 14, lease.format(5), 14, "Globex", "MSA", False)]]
    folder, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    for part in parts:
        spark.createDataFrame(part, text).write.mode("append").parquet(folder)
        out = jobs.document_arrival(spark.readStream.schema(text).parquet(folder), state, 4)
        seen.append({r.document_id: (r.ranked_standing, r.version_status) for r in out.collect()})
    assert seen[0] == {10: ("CURRENT", "parsed"), 11: ("SUPERSEDED", "parsed")}
    assert seen[2][12] == ("CURRENT", "refused") and seen[2][10] == ("SUPERSEDED", "parsed")
    assert seen[2][13][0] == "CURRENT" and seen[2][14] == ("SUPERSEDED", "parsed")


CYCLE = ("engagement_id int, submission_id int, cycle int, created_at int, status string, document_ids map<string,int>, "
         "msa_document_id int, mla_document_id int")


def test_slots_are_carried_forward(spark):
    cycles = spark.createDataFrame([
        (1, 10, 1, 0, "ACTIVE", {"MSA": 5}, None, 9), (2, 20, 1, 0, "ACTIVE", {}, 7, 8), (3, 30, 1, 0, "ACTIVE", None, None, None),
        (4, 40, 1, 0, "ACTIVE", {"MLA": 3}, None, None), (4, 41, 2, 1, "DRAFT", {}, None, None)], CYCLE)
    opened = {r.engagement_id: r for r in lifecycle.open_amendments(cycles).collect()}
    assert set(opened) == {1, 2, 3}
    assert [opened[e].document_ids for e in (1, 2, 3)] == [{"MSA": 5}, {"MSA": 7, "MLA": 8}, {}]
    assert {(r.amends, r.cycle, r.status) for r in opened.values()} == {(10, 2, "DRAFT"), (20, 2, "DRAFT"), (30, 2, "DRAFT")}
    filled = migrations.fill_slots(cycles)
    assert {r.submission_id for r in filled.filter("filled").collect()} == {20}
    assert migrations.fill_slots(filled).filter("filled").count() == 0


def test_reviews_name_both_sides_and_the_request(spark):
    live = spark.createDataFrame([(1, "MSA", 11, 2), (1, "MLA", 12, 1), (2, "MSA", 21, 1)],
                                 "engagement_id int, doc_type string, document_id int, version int")
    pairs = spark.createDataFrame([(11, 2, 11, 1), (99, 2, 99, 1)],
                                  "document_id int, current_version int, previous_id int, previous_version int")
    lines = spark.createDataFrame([(11, 1, "fuel", "Fuel", "card: $1"), (11, 2, "fuel", "Fuel", "card: $2"),
                                   (11, 2, "toll", "Toll", "tag: $3"), (11, 1, "same", "Same", "x"), (11, 2, "same", "Same", "x")],
                                  "document_id int, version int, program_key string, program string, line string")
    asked = spark.createDataFrame([(1, "cheaper")], "engagement_id int, requested string")
    keys = {}
    for name, requests in (("asked", asked), ("none", asked.limit(0))):
        (header,) = review.reviews(live, pairs, requests).collect()
        assert header.engagement_id == 1 and header.cache_key.startswith("v3::12:1|11:2<11:1::")
        keys[name] = header.cache_key
        items = {r.service: r for r in review.review_items(live, pairs, requests, lines).collect()}
        assert set(items) == {"Fuel", "Toll"} and items["Fuel"].delivered == "card: $1 → card: $2"
        assert items["Toll"].delivered == "(not present) → tag: $3"
        assert items["Toll"].requested == ("cheaper" if name == "asked" else "—")
    assert keys["asked"] != keys["none"]
