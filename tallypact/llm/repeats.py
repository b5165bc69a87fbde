"""Where windows of a corpus start a second time: the plan that both passage operators share.

A document is a sequence of units (words or bytes). Every window of ``window`` units holds grams of
``gram`` units; the one with the least hash is the window's *seed*. Equal windows have equal seeds, so
seeds decide what has to meet:

0. ``exact_copies``: of equal texts only the one with the smallest doc_id goes through the steps below. The others
   lose every window by definition. Their keys are broadcast behind a check of their number (``max_copies``); beyond
   it, copies simply go the long way too.
1. ``seed_filter``: each batch of documents sends its distinct seed slots, sorted and packed; a slot that
   two documents have is set in a bitmap of fixed size. The bitmap only saves shuffling: a slot that two
   different seeds share lets more candidates through and never loses one, and a full bitmap lets
   all through.
2. Documents are read again. Neighbouring windows with one seed that is set in the bitmap form a phrase;
   each batch sends its distinct phrases by seed.
3. A shard of phrases is compared exactly by the operator (``match``), which returns for every phrase the
   runs of windows that occur elsewhere and the smallest document that has them.
4. Occurrences of phrases are joined with those runs, and the documents with their spans.

A phrase that a third of all documents share is one row per batch in step 2, and many rows of one key in the
join of step 4, which adaptive execution splits. Rows are told apart by doc_id and text hash, so
a doc_id that comes twice keeps its two texts apart; two rows of one doc_id never remove each other's
windows. A null doc_id is no document: nothing is removed from it or because of it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypact.llm.common import chunks, utf8, written

CHUNK_BYTES = 1 << 20
#: Length of a span that covers the whole text.
ALL = -1
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Units:
    """How texts become units: ``cut`` gives units, first unit of each row, and a way to get a slice.

    Seeds are counted in ``2**fine_bits`` slots, dealt to ``parts``, and kept as a bitmap of ``2**slot_bits`` bits. That
    bounds what is broadcast (64 MB) and what a merging task holds (16 MB a part), whatever the input is.
    """

    window: int
    gram: int
    cut: Callable
    fine_bits: int = 33
    slot_bits: int = 29
    parts: int = 128
    #: So many keys of exact copies (16 bytes each) are broadcast at most.
    max_copies: int = 2_000_000

    @property
    def part_bits(self) -> int:
        return self.fine_bits - int(math.log2(self.parts))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & ((1 << self.fine_bits) - 1)


class Seeds:
    """Seed of every window of the rows of one chunk."""

    def __init__(self, units: np.ndarray, first: np.ndarray, window: int, gram: int):
        width = window - gram + 1
        n = len(units) - window + 1
        self.first, self.window = first, window
        if n <= 0:
            self.at = self.hash = self.row = self.seed = np.zeros(0, np.int64)
            return
        code = rolling(units, gram)
        code ^= code >> np.uint64(32)
        code *= MIX
        code ^= code >> np.uint64(29)
        code *= FACTOR
        code &= ~np.uint64(63)
        code |= np.arange(len(code), dtype=np.uint64) & np.uint64(63)
        least = _sliding_min(code, width)[:n]
        size = np.diff(first)
        usable = np.maximum(size - window + 1, 0)
        self.row = np.repeat(np.arange(len(size)), usable)
        before = np.cumsum(usable) - usable
        start = np.arange(len(self.row)) - np.repeat(before, usable) + np.repeat(first[:-1], usable)
        least = least[start]
        self.at = start
        self.hash = (least >> np.uint64(6)).astype(np.int64)
        self.seed = start + (((least & np.uint64(63)).astype(np.int64) - start) & 63)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """First window of each stretch of windows that share a seed: its row and hash."""
        if not len(self.at):
            return self.at, self.hash
        new = np.ones(len(self.at), bool)
        new[1:] = (self.seed[1:] != self.seed[:-1]) | (self.row[1:] != self.row[:-1])
        return self.row[new], self.hash[new]


def rolling(units: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every ``length`` neighbours, put together from powers of two."""
    done, out, block = 0, None, units
    size = 1
    while True:
        if length & size:
            if out is None:
                out = block
            else:
                n = len(units) - done - size + 1
                out = out[:n] * _power(size) + block[done:done + n]
            done += size
        if size * 2 > length:
            return out.copy() if out is units else out
        n = len(units) - 2 * size + 1
        block = block[:n] * _power(size) + block[size:size + n]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), n, 1 << 64))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if width > size:
        out = np.minimum(out[:len(out) - (width - size)], out[width - size:])
    return out


def text_hash(text: bytes) -> int:
    """XXH64 as Spark's ``xxhash64`` gives it."""
    value = xxhash.xxh64_intdigest(text, 42)
    return value - ((value >> 63) << 64)


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash of the documents whose text a document with a smaller doc_id has too."""
    text = F.coalesce("text", F.lit(""))
    marked = docs.filter("doc_id is not null").select(
        "doc_id", F.xxhash64(text).alias("text_hash"), F.md5(text).alias("digest"), F.length(text).alias("size"))
    # Only texts that come again go on, which are few beside the corpus.
    first = (marked.groupBy("digest", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .filter("first < last").drop("last"))
    return marked.join(first, ["digest", "size"]).filter("doc_id > first").select("doc_id", "text_hash").distinct()


class Copies:
    """The broadcast keys of exact copies, sorted by doc_id."""

    def __init__(self, copies: DataFrame, limit: int):
        rows = copies.toPandas() if copies.count() <= limit else None
        self.used = rows is not None and len(rows) > 0
        if self.used:
            rows = rows.sort_values("doc_id")
            self.keys = copies.sparkSession.sparkContext.broadcast(
                (rows["doc_id"].to_numpy(np.int64), rows["text_hash"].to_numpy(np.int64)))

    def among(self, batch: pa.RecordBatch) -> np.ndarray:
        """Which rows of a batch are copies."""
        ids = np.asarray(batch.column(0).fill_null(0), np.int64)
        out = np.zeros(len(ids), bool)
        if self.used:
            known, hashes = self.keys.value
            a, b = np.searchsorted(known, ids), np.searchsorted(known, ids, "right")
            for k in np.flatnonzero(a < b).tolist():
                text = (batch.column(1)[k].as_py() or "").encode()
                out[k] = text_hash(text) in hashes[a[k]:b[k]].tolist()
        return out


def _rows(batch: pa.RecordBatch, units: Units, copies: Copies):
    """Chunks of a batch without exact copies: seeds, slice function, ids and bytes."""
    ids = batch.column(0)
    keep = np.flatnonzero(np.asarray(ids.is_valid()) & ~copies.among(batch))
    if len(keep) < len(ids):
        batch = batch.take(pa.array(keep))
    ids = np.asarray(batch.column(0), np.int64)
    raw, offsets = utf8(batch.column(1))
    for a, b in chunks(offsets, CHUNK_BYTES):
        values, first, piece = units.cut(raw, offsets[a:b + 1])
        yield Seeds(values, first, units.window, units.gram), first, piece, ids[a:b], raw, offsets[a:b + 1]


def _bounded(batches: Iterator[pa.RecordBatch], limit: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), limit):
            yield batch.slice(a, limit)


def seed_filter(docs: DataFrame, units: Units, copies: Copies) -> DataFrame:
    """One packed bitmap per part of the slots; bits are set where two documents have a seed's slot."""
    part_bits, parts = units.part_bits, units.parts

    def send(batches):
        for batch in _bounded(batches, 4096):
            found = []
            for seeds, _, _, ids, _, _ in _rows(batch, units, copies):
                row, hashes = seeds.distinct()
                found.append((units.slots(hashes), ids[row]))
            slot = np.concatenate([x[0] for x in found] or [np.zeros(0, np.int64)])
            if not len(slot):
                continue
            doc = np.concatenate([x[1] for x in found])
            order = np.lexsort((doc, slot))
            slot, doc = slot[order], doc[order]
            at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            twice = doc[at] != doc[np.append(at[1:], len(slot)) - 1]
            slot = slot[at]
            cut = np.searchsorted(slot, np.arange(parts + 1) << part_bits)
            numbers, blobs = [], []
            for p in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[p], cut[p + 1]
                delta = np.diff(slot[a:b] - (p << part_bits), prepend=0)
                numbers.append(p)
                blobs.append(zstandard.compress(_planes((delta * 2 + twice[a:b]).astype(np.uint32)), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["part", "slots"])

    def merge(batches):
        once, twice = {}, {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = _values(zstandard.decompress(blob))
                slot = np.cumsum((packed >> 1).astype(np.int64))
                if part not in once:
                    once[part] = np.zeros(1 << part_bits - 3, np.uint8)
                    twice[part] = np.zeros(1 << part_bits - 3, np.uint8)
                bit = (1 << (slot & 7)).astype(np.uint8)
                first = np.flatnonzero(np.append(True, (slot[1:] >> 3) != (slot[:-1] >> 3)))
                byte = slot[first] >> 3
                new = np.bitwise_or.reduceat(bit, first)
                again = np.bitwise_or.reduceat(np.where((packed & 1) == 1, bit, 0).astype(np.uint8), first)
                twice[part][byte] |= (once[part][byte] & new) | again
                once[part][byte] |= new
        for part, bits in twice.items():
            # The finer slots are folded to the bits of the bitmap.
            fold = np.unpackbits(bits, bitorder="little").reshape(-1, 1 << units.fine_bits - units.slot_bits).any(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()),
                 pa.array([zstandard.compress(np.packbits(fold, bitorder="little").tobytes(), 1)], pa.binary())],
                ["part", "bits"])

    return (docs.mapInArrow(send, "part int, slots binary")
            .repartition(parts, "part").mapInArrow(merge, "part int, bits binary"))


def _planes(values: np.ndarray) -> bytes:
    """The four bytes of the values one plane after the other, which packs better."""
    return values.view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


class Filter:
    """The broadcast bitmap; unpacked once per Python worker."""

    cache: dict = {}

    def __init__(self, rows, spark, units: Units):
        self.units = units
        self.packed = spark.sparkContext.broadcast({r["part"]: bytes(r["bits"]) for r in rows})
        self.key = uuid.uuid4().hex

    def bits(self) -> np.ndarray:
        if self.key not in Filter.cache:
            Filter.cache.clear()
            size = (1 << self.units.slot_bits - 3) // self.units.parts
            bits = np.zeros(size * self.units.parts, np.uint8)
            for part, blob in self.packed.value.items():
                bits[part * size:(part + 1) * size] = np.frombuffer(zstandard.decompress(blob), np.uint8)
            Filter.cache[self.key] = bits
        return Filter.cache[self.key]


def _phrases(seeds: Seeds, bits: np.ndarray, units: Units):
    """Start, number of windows, row and seed hash of each phrase of a chunk."""
    slot = units.slots(seeds.hash) >> (units.fine_bits - units.slot_bits)
    at = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
    if not len(at):
        return None
    begin = np.flatnonzero(np.append(
        True, (at[1:] != at[:-1] + 1) | (seeds.seed[at[1:]] != seeds.seed[at[:-1]])
        | (seeds.row[at[1:]] != seeds.row[at[:-1]])))
    w = at[begin]
    return seeds.at[w], np.diff(np.append(begin, len(at))), seeds.row[w], seeds.hash[w]


def removed_spans(docs: DataFrame, units: Units, match: Callable, per_shard: int) -> DataFrame:
    """Spans of units that a document with a smaller doc_id has too: doc_id, text_hash, spans.

    An exact copy has a span of length ``ALL``.

    ``docs``: doc_id long, text string. ``match(phrases, first, last)`` gets the distinct phrases of a
    shard with their smallest and largest document and yields (phrase, offset, windows, document):
    runs of windows and the smallest document that has them.
    """
    spark = docs.sparkSession
    window = units.window
    found_copies = written(exact_copies(docs), "copies")
    copies = Copies(found_copies, units.max_copies)
    bitmap = Filter(seed_filter(docs, units, copies).collect(), spark, units)

    def dictionary(batches):
        for batch in _bounded(batches):
            low, high = {}, {}
            for seeds, _, piece, ids, _, _ in _rows(batch, units, copies):
                found = _phrases(seeds, bitmap.bits(), units)
                if found is None:
                    continue
                start, count, row, hashes = found
                group = (hashes >> 31).astype(np.int32)
                for text, doc, g in zip(piece(start, count + window - 1), ids[row].tolist(), group.tolist(),
                                        strict=True):
                    k = (g, text)
                    if k not in low:
                        low[k] = high[k] = doc
                    elif doc < low[k]:
                        low[k] = doc
                    elif doc > high[k]:
                        high[k] = doc
            if low:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in low], pa.int32()), pa.array([k[1] for k in low], pa.binary()),
                     pa.array(list(low.values()), pa.int64()), pa.array(list(high.values()), pa.int64())],
                    ["seed", "phrase", "low", "high"])

    def occurrences(batches):
        for batch in _bounded(batches):
            for seeds, first, piece, ids, raw, offsets in _rows(batch, units, copies):
                found = _phrases(seeds, bitmap.bits(), units)
                if found is None:
                    continue
                start, count, row, hashes = found
                digest = xxhash.xxh3_64_intdigest
                key = np.fromiter((digest(x) for x in piece(start, count + window - 1)), np.uint64, len(start))
                mark = np.zeros(len(ids), np.int64)
                for r in np.unique(row).tolist():
                    mark[r] = text_hash(raw[offsets[r]:offsets[r + 1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array((hashes >> 31).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ids[row]),
                     pa.array(mark[row]), pa.array((start - first[row]).astype(np.int32))],
                    ["seed", "key", "doc_id", "text_hash", "start"])

    words = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(12, math.ceil(words / per_shard))

    def compare(shard: pa.Table) -> pa.Table:
        low, high = {}, {}
        for seed, phrase, a, b in zip(*(shard.column(c).to_pylist() for c in ("seed", "phrase", "low", "high")),
                                      strict=True):
            k = (phrase, seed)
            low[k], high[k] = min(low.get(k, a), a), max(high.get(k, b), b)
        keys = list(low)
        out = list(match([k[0] for k in keys], list(low.values()), list(high.values())))
        digest = xxhash.xxh3_64_intdigest
        return pa.table({
            "seed": pa.array([keys[x[0]][1] for x in out], pa.int32()),
            "key": pa.array(np.array([digest(keys[x[0]][0]) for x in out], np.uint64).view(np.int64)),
            "offset": pa.array([x[1] for x in out], pa.int32()),
            "windows": pa.array([x[2] for x in out], pa.int32()),
            "source": pa.array([x[3] for x in out], pa.int64())})

    runs = (docs.mapInArrow(dictionary, "seed int, phrase binary, low long, high long")
            .withColumn("shard", F.pmod("seed", F.lit(shards)))
            .groupBy("shard").applyInArrow(
                lambda t: compare(t), "seed int, key long, offset int, windows int, source long"))
    found = docs.mapInArrow(
        occurrences, "seed int, key long, doc_id long, text_hash long, start int")
    spans = found.join(runs, ["seed", "key"]).filter("source < doc_id").select(
        "doc_id", "text_hash", (F.col("start") + F.col("offset")).alias("start"),
        (F.col("windows") + window - 1).alias("length"))
    whole = found_copies.select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(ALL).alias("length"))
    return (spans.unionByName(whole).groupBy("doc_id", "text_hash")
            .agg(F.collect_list(F.struct("start", "length")).alias("spans")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with their spans; those without any keep a null."""
    marked = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return marked.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")


def mask(n: int, spans, window: int) -> np.ndarray:
    """True where a unit is covered; a span of length ``ALL`` covers every window there is."""
    if any(s["length"] == ALL for s in spans or ()):
        return np.full(n, n >= window)
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["start"] + s["length"]] -= 1
    return np.cumsum(edge[:n]) > 0


def grouped_runs(phrase: np.ndarray, offset: np.ndarray, doc: np.ndarray, high: np.ndarray):
    """Runs (phrase, offset, windows, document) of windows, in order, that a document before ``high`` has too."""
    hit = np.flatnonzero(doc < high[phrase])
    if not len(hit):
        return
    phrase, offset, doc = phrase[hit], offset[hit], doc[hit]
    begin = np.flatnonzero(np.append(True, (phrase[1:] != phrase[:-1]) | (offset[1:] != offset[:-1] + 1)
                                     | (doc[1:] != doc[:-1])))
    count = np.diff(np.append(begin, len(hit)))
    yield from zip(phrase[begin].tolist(), offset[begin].tolist(), count.tolist(), doc[begin].tolist(), strict=True)
