"""Work that is done once: texts split, quotes and lines put together, payloads read, classification shared."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact import views
from tallypact.functions import text
from tallypact.operators import containment
from tallypact.plans import citations, corrections, review, terms
from tallypact.sources import payloads
from tallypact.workload import load

load()
from tallypact.workload import agreements, money  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def written(monkeypatch, module):
    names, keep = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df, name: names.append(name) or keep(df, name))
    return names


def key_of(name):
    """The rule of ``normalise_name`` word by word."""
    name = re.sub(r"[^a-z0-9 ]+", " ", re.sub(r"\([^)]*\)", " ", (name or "").lower()))
    words = [w for w in name.strip(" ").split(" ") if w and w not in fv.NAME_STOPWORDS]
    return words, " ".join(w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w for w in words)


def test_names_are_cleaned_without_lambdas(spark):
    rng = random.Random(4)
    pieces = [*fv.NAME_STOPWORDS, "cars", "tolls", "glass", "buses", "s", "ss", "sss", "as", "theme", "9s", "abcds", "(x the) ", "()", "(", "-", "\n",
              "\t", "  ", "É", "Program", "THE", "an-a", "of.of"]
    names = [None, "", " ", "the", "the a an", "A the fuel of", *["".join(
        rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(600)]]
    df = spark.createDataFrame([(n,) for n in names], "name string").select(
        "name", text.normalise_name(F.col("name")).alias("key"), text.slugify(F.col("name")).alias("slug"))
    assert "lambda" not in plan(df)
    for r in df.collect():
        words, key = key_of(r["name"])
        assert (r["key"], r["slug"]) == (key, "-".join(words) or "unnamed"), r["name"]


def test_runs_of_strings_are_one_piece():
    assert len(re.findall(payloads._PIECES, '{"a":"b","c":["d",1]}')) == 3
    assert len(re.findall(payloads._PIECES, '{"a":"b","c')) == 4


def test_payloads_of_every_kind(spark):
    good = '{"info_type":"sla_item","category":"x","amount":"1"}'
    rows = [(1, f"[{good},null,7,[1],{{}}]"), (2, good), (3, '"[1, {\\"info_type\\":\\"pricing_item\\"}]"'), (4, "12"), (5, "null"), (6, '"text"'),
            (7, "[]"), (8, f"[{good},{good},{{\"a\":\"b"), (9, '[{"info_type":"definition","term":"t"}]'), (10, " "), (11, None), (12, '"\\"x\\""'),
            (13, '[{"info_type":"sla_item","category":"x","amount":"no"},{"info_type":"sla_item","category":"x","confidence":2}]')]
    fine, refused = payloads.ingest_records(spark.createDataFrame(rows, "id int, payload string"))
    assert sorted((r.id, r.position, r.salvaged) for r in fine.drop("record").collect()) == [
        (1, 0, False), (2, 0, False), (8, 0, True), (8, 1, True)]
    none = "no records in payload"
    assert sorted((r.id, r.position or 0, r.reason) for r in refused.drop("record").collect()) == [
        (1, 1, "expected an object"), (1, 2, "expected an object"), (1, 3, "expected an object"), (1, 4, "unknown info_type"),
        (3, 0, "expected an object"), (3, 1, "program is required"), (4, 0, none), (5, 0, none), (6, 0, none), (7, 0, none),
        (9, 0, "definition is required"), (12, 0, none), (13, 0, "amount is not a number"), (13, 1, "confidence is out of range")]
    assert plan(refused).count("program is required") == 1 and "schema_of_variant" not in plan(refused)


def test_a_text_is_split_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 1, "a\nb\nc\nd\ne\nf"), (2, 1, ""), (3, 1, None)], "document_id long, engagement_id long, full_text string")
    monkeypatch.setattr(views, "agreements", lambda *_: docs)
    paged = views.document_pages(spark, "")
    assert {r.document_id: r.pages and [(p.page_number, p.lines) for p in r.pages] for r in paged.collect()} == {
        1: [(1, ["a", "b", "c", "d", "e"]), (2, ["f"])], 2: [(1, [""])], 3: None}
    assert plan(paged).count("split(") == 1
    names = written(monkeypatch, citations)
    asked = spark.createDataFrame([("q", 1, "F", 9)], "citation_id string, document_id long, quote string, page_hint int")
    assert [r.page_number for r in citations.locate(asked, paged).collect()] == [2]
    assert {"pages", "asked"} <= set(names)


def test_lines_are_counted_once(spark, monkeypatch):
    names = written(monkeypatch, review)
    lines = spark.createDataFrame([(1, 1, "p", "P", "x"), (1, 2, "p", "P", "x"), (1, 2, "p", "P", "y"), (1, 1, "q", "Q", "z"), (1, 2, "q", "Q", "z")],
                                  "document_id long, version int, program_key string, program string, line string")
    pairs = spark.createDataFrame([(1, 2, 1, 1)], "document_id long, current_version int, previous_id long, previous_version int")
    assert [tuple(r) for r in review.changed_programs(pairs, lines).select("service", "before", "after").collect()] == [("P", "x", "x ; y")]
    assert names == ["counted"]


def test_documents_are_classified_once(spark, monkeypatch):
    calls, keep = [], agreements.docs
    monkeypatch.setattr(agreements, "docs", lambda *a: calls.append(1) or keep(*a))
    agreements.reviewed(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    agreements.rebilled(spark, "/root/testdata/sf0.001")
    assert len(calls) == 2


def test_terms_meet_corrections_once(spark):
    terms = spark.createDataFrame([("a", "legal", "P", "p"), ("b", "legal", "P", "p"), (None, "legal", "P", "p")],
                                  "term_key string, category string, program string, program_id string").selectExpr(
        "*", "'i' as item", "cast(1 as decimal(18,2)) as amount", "'x' as item_id", "'exact' as catalog_match")
    asked = spark.createDataFrame([("a", "Q"), (None, "R")], "term_key string, program string").selectExpr(
        "*", "cast(null as string) as item", "cast(null as decimal(18,2)) as amount")
    programs = spark.createDataFrame([], "program_id string, position string, name string, aliases array<string>")
    items = spark.createDataFrame([], "program_id string, item_id string, position string, name string, aliases array<string>")
    after = corrections.place_again(terms, asked, programs, items)
    assert sorted((r.term_key or "", r.program, r.corrected) for r in after.collect()) == [("", "P", False), ("a", "Q", True), ("b", "P", False)]
    assert "LeftAnti" not in plan(after)


def test_seeds_are_put_out_in_parts():
    texts = ["".join(random.Random(k).choices("abcdefgh0123456789", k=5000)) for k in range(700)] + [None, "", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["document_id", "stream"])
    out = list(containment._seed_batches(iter([batch])))
    assert len(out) == 4 and max(b.num_rows for b in out) < 3 * containment.SEED_LETTERS
    assert sorted({i for b in out for i in b.column(0).to_pylist()}) == [*range(700), 702]


def test_engagement_coverage_counts_without_expanding_rows(spark):
    rows = spark.createDataFrame(
        [(1, 10, 1, "a", ["x", "y"], 2), (1, 10, 2, "a", ["x"], 1), (1, 11, 1, "b", ["x"], 3),
         (1, 12, 1, "gone", ["z"], 9), (2, 20, 1, "a", [], 0), (None, 30, 1, "b", ["x"], 1), (3, None, 1, "a", None, None)],
        "engagement_id long, document_id long, version int, program_id string, item_ids array<string>, priced_items long")
    programs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "program_id string")
    out = terms.engagement_coverage(rows, programs, None)
    assert "Expand" not in plan(out)
    assert {r["engagement_id"]: tuple(r)[1:] for r in out.collect()} == {
        1: (2, 6, 2, 3), 2: (1, 0, 1, 0), None: (1, 1, 1, 0), 3: (1, None, 0, 0)}


def test_dashboard_writes_the_schedule_columns_its_reports_read(spark, monkeypatch):
    made = {}

    def kept(df, purpose):
        made[purpose] = df.columns
        return df

    monkeypatch.setattr(money, "cut_lineage", kept)
    money.finance_dashboard(spark, "/root/testdata/sf0.001")
    assert sorted(made["schedule"]) == ["amount", "due_date", "engagement_id", "status"]
