"""Raw extraction payloads: text to record rows, with a reason for everything refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact import fixed_values as fv
from tallypact.functions.binding import let

# What a payload that does not parse is read as: braces, and runs of strings and of anything else between them (up to 64
# in a piece, which bounds the matcher's stack). A quote that opens no whole string is a piece of its own.
_PIECES = r'((?:"(?:[^"\\]++|\\.)*+"|[^{}"]++){1,64}+|[{}]|")'


def salvage(payload: Column) -> Column:
    """The complete top-level objects of a cut-off array, as texts, however deep they are nested.

    Braces outside strings are counted. Whatever follows a half-written string or object is left.
    """
    pieces = F.regexp_extract_all(payload, F.lit(_PIECES))
    spans = "array<struct<start:int,size:int>>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("at"), F.lit(0).alias("opened"),
                     F.lit(False).alias("broken"), F.array().cast(spans).alias("found"))

    def step(state, piece):
        opens = (piece == "{") & ~state.broken
        closes = (piece == "}") & ~state.broken & (state.depth > 0)
        whole = closes & (state.depth == 1)
        span = F.struct(state.opened.alias("start"), (state.at - state.opened + 1).alias("size"))
        return F.struct(
            F.when(opens, state.depth + 1).when(closes, state.depth - 1).otherwise(state.depth)
            .alias("depth"),
            (state.at + F.length(piece)).alias("at"),
            F.when(opens & (state.depth == 0), state.at).otherwise(state.opened).alias("opened"),
            (state.broken | (piece == '"')).alias("broken"),
            F.when(whole, F.concat(state.found, F.array(span))).otherwise(state.found)
            .alias("found"))

    found = F.aggregate(pieces, start, step, lambda state: state.found)
    return F.transform(found, lambda s: F.substr(payload, s.start, s.size))


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _items(value: Column) -> Column:
    """The elements of an array, or an object by itself; NULL for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(_is_object(value), F.array(value)))


def record_rows(payloads: DataFrame) -> DataFrame:
    """One row per record of each payload: (payload columns, record VARIANT, position, salvaged).

    A payload is an array, an array written as a JSON string, or one object. Text that does not
    parse is salvaged. ``payloads`` has a ``payload`` column.
    """
    # Only a JSON value that is neither may be a string that holds one.
    parsed = let(F.try_parse_json("payload"), lambda outer: F.coalesce(_items(outer), let(
        F.try_parse_json(F.try_variant_get(outer, "$", "string")), _items)))
    rescued = F.transform(salvage(F.col("payload")), F.try_parse_json)
    rescued = F.filter(rescued, lambda v: v.isNotNull())
    rows = payloads.filter("payload is not null and trim(payload) <> ''").withColumn(
        "parsed", parsed).withColumn("salvaged", F.col("parsed").isNull())
    items = F.when(F.col("salvaged"), rescued).otherwise(F.col("parsed"))
    return rows.select(*payloads.columns, "salvaged",
                       F.posexplode_outer(items).alias("position", "record")).drop("payload")


def _problem() -> Column:
    """Why a record is refused, or NULL. Reads ``record``."""
    record = F.col("record")

    def absent(name):
        return F.try_variant_get(record, f"$.{name}", "string").isNull()

    def lacks(fields):
        chain = F.when(absent(fields[0]), f"{fields[0]} is required")
        for name in fields[1:]:
            chain = chain.when(absent(name), f"{name} is required")
        return chain

    def of_kind(kind):
        # What has an info_type is an object.
        chain = (F.when(record.isNull(), "no records in payload")
                 .when(kind.isNull() & ~_is_object(record), "expected an object")
                 .when(kind.isNull() | ~kind.isin(list(fv.REQUIRED_FIELDS)), "unknown info_type"))
        return F.coalesce(chain, *[F.when(kind == info_type, lacks(fields)) for info_type, fields in fv.REQUIRED_FIELDS.items()])

    amount = F.try_variant_get(record, "$.amount", "string")
    confidence = F.try_variant_get(record, "$.confidence", "double")
    wrong = F.when(amount.isNotNull() & F.expr("try_cast(try_variant_get(record, '$.amount', 'string') as double)").isNull(),
                   "amount is not a number").when(
        let(confidence, lambda c: (c < 0) | (c > 1)), "confidence is out of range")
    return F.coalesce(let(F.try_variant_get(record, "$.info_type", "string"), of_kind), wrong)


def ingest_records(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, refused) record rows; refused rows carry a reason and never lose their neighbours."""
    # Exploded, so that neither filter works the reason out again.
    rows = record_rows(payloads).withColumn("reason", F.explode(F.array(_problem())))
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")
