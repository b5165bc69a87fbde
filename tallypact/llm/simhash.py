"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint's bit is set if it is set in over half of the XXH64 hashes of the text's word shingles. Equal
fingerprints are one node. Fingerprints within ``RADIUS`` bits agree in two of four blocks of 16 bits, so they meet in
one of six tables keyed by 32 bits. A table's runs are laid out vertically: 64 bit planes with one lane per
fingerprint. Distances of many lanes are counted at once with carry-save counters of two bits, and a block
of queries is given up as soon as every lane is beyond the radius.

A run longer than ``MAX_RUN`` is not compared pair by pair: its fingerprints each name themselves and their 64
neighbours at one bit, and those that name the same value are within two bits of each other. That is exact for
two bits, linear, and no value is named by more than 65 fingerprints.

Defined results: null, blank and empty texts have fingerprint zero and are linked like any other; equal rows are reported
as often as they come; a row with a null doc_id is reported and linked, but lends no component_id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallypact.llm.common import utf8, written
from tallypact.llm.components import roots

SHINGLE = 3
RADIUS = 2
BITS = 64
MAX_RUN = 2048
#: Small runs are compared together in blocks of about so many lanes.
LANES = 512
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Pairs of 16-bit blocks, one table each.
TABLES = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = min(shingle, len(words)) - 1
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n], ends[last:], strict=True)), ">u8", n)
    count = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 15):
        count += np.unpackbits(hashes[a:a + (1 << 15)].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed number)."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            texts = (raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            fp, mark = [], []
            for text in texts:
                fp.append(fingerprint(text, shingle))
                mark.append(xxhash.xxh64_intdigest(text, 42))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(mark, np.uint64).view(np.int64)),
                 pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: 64 rows of words of 64 lanes; idle lanes are zero."""
    lanes = np.zeros(-(-len(values) // 64) * 64, ">u8")
    lanes[:len(values)] = values
    bits = np.unpackbits(lanes.view(np.uint8)).reshape(-1, BITS)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, sliced: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """One row of lane bits per query: set where the distance is at most ``radius`` (below four).

    Two carry-save counters hold the distance of every lane; ``beyond`` keeps lanes that overflowed. After
    every eight planes the block is given up if no lane is left.
    """
    shape = (len(queries), sliced.shape[1])
    ones, twos, beyond = (np.zeros(shape, np.uint64) for _ in range(3))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(BITS):
        bit = (queries >> np.uint64(BITS - 1 - p)) & np.uint64(1)
        diff = sliced[p][None, :] ^ np.where(bit == 1, full, np.uint64(0))[:, None]
        carry = ones & diff
        ones ^= diff
        beyond |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            dead = beyond | _over(ones, twos, radius)
            if (dead == full).all():
                return np.zeros(shape, np.uint64)
    return ~(beyond | _over(ones, twos, radius))


def _over(ones: np.ndarray, twos: np.ndarray, radius: int) -> np.ndarray:
    return [ones | twos, twos, ones & twos, np.zeros_like(ones)][radius]


def local_roots(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of some distinct fingerprints the first one of its linked group among them."""
    sliced, n = planes(values), len(values)
    near = np.concatenate([
        np.unpackbits(np.ascontiguousarray(within(values[a:a + LANES], sliced, radius)).view(np.uint8), axis=1, bitorder="little")[:, :n]
        for a in range(0, n, LANES)]).astype(bool)
    label = np.arange(n, dtype=np.int32)
    while True:
        new = np.concatenate([np.where(near[a:a + LANES], label, n).min(1) for a in range(0, n, LANES)])
        new = new[new]
        if (new == label).all():
            return label
        label = new.astype(np.int32)


def _compare(max_run: int):
    """Sorted (key, fp) rows -> edges (a, b), or (a, null) for a member of a run longer than ``max_run``."""

    def members(fp):
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64())], ["a", "b"])

    def linked(gathered):
        values = np.unique(np.concatenate(gathered))
        root = local_roots(values.view(np.uint64))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[root[moved]])], ["a", "b"])

    def edges(key, fp):
        """Whole runs: long ones by member, the others gathered into blocks of lanes."""
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        gathered, lanes = [], 0
        for at, n in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            if n > max_run:
                yield members(fp[at:at + n])
                continue
            gathered.append(fp[at:at + n])
            lanes += n
            if lanes >= LANES:
                yield linked(gathered)
                gathered, lanes = [], 0
        if gathered:
            yield linked(gathered)

    def run(batches):
        # The last run of a batch may go on; once it is too long it is passed on as it comes.
        rest_key, rest_fp, long_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key = np.concatenate([rest_key, np.asarray(batch.column(0), np.int64)])
            fp = np.concatenate([rest_fp, np.asarray(batch.column(1), np.int64)])
            if long_key is not None:
                n = int(np.searchsorted(key, long_key, "right"))
                yield members(fp[:n])
                key, fp = key[n:], fp[n:]
            if not len(key):
                rest_key, rest_fp = key, fp
                continue
            long_key = None
            start = int(np.searchsorted(key, key[-1]))
            yield from edges(key[:start], fp[:start])
            rest_key, rest_fp = key[start:], fp[start:]
            if len(rest_key) > max_run:
                yield members(rest_fp)
                long_key, rest_key, rest_fp = int(rest_key[-1]), rest_key[:0], rest_fp[:0]
        yield from edges(rest_key, rest_fp)

    return run


def links(nodes: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """Edges that join all fingerprints within the radius into components; ``nodes``: distinct fp."""
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*[
        F.lit(t << 32).bitwiseOR(F.shiftleft(blocks[i].cast("long"), 16)).bitwiseOR(blocks[j]).alias(f"k{t}")
        for t, (i, j) in enumerate(TABLES)])
    keyed = nodes.select(F.explode(keys).alias("key"), "fp")
    found = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(max_run), "a long, b long"),
                    "links")
    hot = found.filter("b is null").select("a").distinct()
    one = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)),
                      lambda i: F.col("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    named = hot.select("a", F.explode(F.concat(F.array("a"), one)).alias("value"))
    least = named.groupBy("value").agg(F.sort_array(F.collect_set("a")).alias("all"))
    star = least.select(F.explode(F.slice("all", 2, BITS + 1)).alias("a"), F.get("all", F.lit(0)).alias("b"))
    return found.filter("b is not null").unionByName(star)


def components(docs: DataFrame, shingle: int = SHINGLE, max_run: int = MAX_RUN) -> DataFrame:
    """doc_id, text_hash, fp, component_id: the smallest doc_id that links lead to."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = roots(links(nodes.select("fp"), max_run))
    rooted = nodes.join(root, nodes["fp"] == root["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id")


def first_of_group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents of which each group of near-duplicates keeps one, all columns unchanged.

    The one with the smallest doc_id stays; of several texts with that id the one with the least hash, of equal
    rows one. Rows without a doc_id are kept as one group each text.
    """
    return kept_of(docs, components(docs, shingle), F.hex("fp"))


def kept_of(docs: DataFrame, found: DataFrame, nameless: Column) -> DataFrame:
    """One document of each group of ``found`` (doc_id, text_hash, component_id); ``nameless`` tells groups without an id apart."""
    # Plain key columns, so that the join and the numbering below share one shuffle.
    keys = ["__id", "__none", "__hash"]
    first = (found.groupBy(F.coalesce(F.col("component_id").cast("string"), nameless).alias("group"))
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
             .select(F.coalesce("k.doc_id", F.lit(0)).alias("__id"), F.col("k.none").alias("__none"),
                     F.col("k.text_hash").alias("__hash")))
    marked = docs.withColumns({
        "__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(),
        "__hash": F.xxhash64(F.coalesce("text", F.lit(""))),
        "__row": F.xxhash64(*[f"`{c}`" for c in docs.columns])})
    place = F.row_number().over(W.partitionBy(*keys).orderBy("__row"))
    return (marked.join(first, keys).withColumn("__place", place).filter("__place = 1")
            .select(*[f"`{c}`" for c in docs.columns]))


def digest(docs: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return components(docs, max_run=max_run).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
