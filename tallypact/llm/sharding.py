"""Proportional stratified interleaving, in DataFrame functions only: every shard has the mixture of the whole.

The rows of each source are put in a seeded random order; the row of rank r among n gets the fraction (2r - 1) / 2n. All
rows sorted by their fractions are cut into shards of equal counts (law ``rows``: counts at most one apart), so any stretch
of the order, and with it any shard, holds each source in its share. Equal texts are dealt like other rows: a
group of copies larger than a shard could not stay together under this law.

No source, however large, is one task. Rows are first counted by (source, slice of the random order), then ranked
inside a slice; what is added is the count of the slices before. Fractions are uniform, so equal slices of them hold
equal numbers of rows of all sources together, and the same two steps give places in the whole order. What one window
orders over is the list of slices, one row for ``SLICE_ROWS`` rows.

Defined results: a null text is empty (its size is the flat 16); a null source is a source of its own; rows that agree in doc_id and
text are interchangeable and keep their number; a null doc_id is a value like others; an empty table gives no rows; other
columns are carried only by ``deal`` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypact.llm.common import written

SHARDS, SEED = 40, 13
#: Bytes that a row costs beside its text.
FLAT = 16
#: Rows of a slice, on average.
SLICE_ROWS = 20_000
ORDER_BITS, SLICE_BITS = 60, 40


def _order(seed: int) -> Column:
    """A row's place in the random order, from its id and text: 60 bits of an MD5 sum."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    return F.conv(F.substring(F.md5(name), 1, ORDER_BITS // 4), 16, 10).cast("long")


def _before(slices: DataFrame, by: list[str]) -> DataFrame:
    """Counts ``n`` of slices -> ``before``, the sum of the slices before, and ``total``, each within ``by``."""
    within = Window.partitionBy(*by)
    earlier = within.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select(*by, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                         F.sum("n").over(within).alias("total"))


def _placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows``, which have a ``slice``, with their ``place`` from 0 within ``by``, and the ``total``."""
    counts = _before(rows.groupBy(*by, "slice").agg(F.count("*").alias("n")), by)
    inside = F.row_number().over(Window.partitionBy(*by, "slice").orderBy(*order))
    return (rows.withColumn("inside", inside).join(counts, [*by, "slice"])
            .withColumn("place", F.col("before") + F.col("inside") - 1).drop("slice", "inside", "before"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source",
               keep: tuple[str, ...] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, stratum and ``keep`` as ``__<name>``, one row per row."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text, F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("")).alias("stratum"),
                       *[F.col(f"`{c}`").alias(f"__{c}") for c in keep])
    rows = written(rows.select(
        "doc_id", "stratum", (F.octet_length("text") + FLAT).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), _order(seed).alias("h"),
        *[f"`__{c}`" for c in keep]), "shuffled")
    n = max(1, rows.count())
    slices = -(-n // slice_rows)
    tie = ["h", "doc_id", "size", "text_crc32"]
    top = F.shiftright("h", ORDER_BITS - SLICE_BITS) * F.lit(slices)
    ranked = _placed(rows.withColumn("slice", F.shiftright(top, SLICE_BITS)), ["stratum"], tie)
    fraction = (2 * F.col("place") + 1) / (2 * F.col("total"))
    ordered = (ranked.withColumn("fraction", fraction).drop("place", "total")
               .withColumn("slice", F.floor(F.col("fraction") * slices)).withColumn("all", F.lit(0)))
    placed = _placed(ordered, ["all"], ["fraction", "stratum", *tie])
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", F.expr(f"place * {shards} div {n}"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    *(["stratum", *[f"`__{c}`" for c in keep]] if keep else [])))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    return interleave(docs)


def deal(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, stratum: str = "source") -> DataFrame:
    """All columns of ``docs`` as Parquet, a folder per shard, rows in the order of their slots; gives the table back.

    Columns called ``shard`` or ``slot`` are replaced by the assignment.
    """
    keep = tuple(c for c in docs.columns if c not in ("shard", "slot"))
    dealt = interleave(docs, shards, seed, stratum, keep).select(
        *[F.col(f"`__{c}`").alias(c) for c in keep], "slot", "shard")
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _crc_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


_TABLE = "[" + ", ".join(f"{_crc_entry(i)}::bigint" for i in range(256)) + "]"
ORACLE = f"""
with sized as (
    select doc_id, coalesce(text, '') as text, coalesce('=' || source, '') as stratum from documents),
ordered as (
    select *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || md5(text)), 1, 15))::bigint as h
    from sized),
ranked as (
    select *, (2 * row_number() over (partition by stratum order by h, doc_id) - 1)
              / (2 * count(*) over (partition by stratum)) as fraction from ordered),
placed as (
    select *, row_number() over (order by fraction, stratum, h, doc_id) - 1 as place, count(*) over () as n from ranked),
sharded as (select *, (place * {SHARDS}) // n as shard from placed)
select doc_id, (octet_length(encode(text)) + {FLAT})::bigint as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
            regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint)),
        lambda c, b: xor(c >> 8, list_extract({_TABLE}, (xor(c, b) & 255) + 1))), 4294967295) as text_crc32,
    'rows' as law, shard::int as shard, (place - (shard * n + {SHARDS - 1}) // {SHARDS})::bigint as slot,
    null::int as grown_shard
from sharded
"""
