"""Near-duplicates by SimHash fingerprints and by the share of common shingles: MinHash proposes pairs, exact Jaccard decides.

Two texts are linked if their fingerprints are (``simhash``: 3-word shingles, two bits), or if the sets of their five-word shingles
have a Jaccard similarity of at least ``SIMILARITY``; a group is what links of either kind lead to. Texts with the same
lower-case words are one class and one node, with one fingerprint. Groups of fingerprints are found first, and pairs inside one
are not compared any more. A class has ``BANDS`` keys, each made of the least values of its shingles' hashes under ``ROWS`` functions; classes with a common key meet. A pair at the
bound meets with a probability of 0.997, a more similar one more often, one at 0.5 with 0.12 (SimHash distances vary too
much for that: pairs at 0.8 differ in 5 to 11 of 64 bits).

Members of a key are compared in rounds. A round names some members of each key pivots, by their hash and the
key's size, and compares them with the members of other groups under that key; then groups are joined and keys whose
members are all of one group are closed. Each round has ``MORE`` times the pivots of the one before; the last makes
every member of a key that is still open a pivot, so every pair of different groups that meets is compared, while a large
group costs little more than its size. Only texts that meet others are read again for their shingles; which ones is a
bitmap of fixed size, and a full one costs shuffle, never results. Tables are deleted when the next ones are written.

Defined results: null, blank and empty texts are one class; a text of fewer than five words is one shingle; a row with a
null doc_id is linked, but lends no component_id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypact.llm import simhash
from tallypact.llm.common import discard, utf8, written
from tallypact.llm.components import roots
from tallypact.llm.simhash import LOWER

SHINGLE = 5
#: The least Jaccard similarity of a linked pair, as a fraction.
SIMILARITY = (4, 5)
ROWS, BANDS = 8, 32
#: Odd factors of the hash functions.
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
BITMAP_BITS = 25
#: Longs of a class's parity bitmap.
PARITY = 4
#: Pairs that read one copy of a class's shingles; members of a key that meet one copy of its pivots.
SALT = 1000
#: Expected pivots of a key in the first round, and how many times more there are in each further round.
PIVOTS, MORE = 2, 8


def shingles(text: bytes, size: int = SHINGLE) -> tuple[int, np.ndarray]:
    """Hash of a text's lower-case words, and the distinct hashes of its shingles."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words] or [1]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = max(1, len(words) - size + 1)
    last = min(size, len(ends)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n], ends[last:], strict=True)), np.uint64, n)
    return digest(joined, 7), np.unique(hashes)


def keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[a:a + 512, None] * FACTORS).min(0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """One bit per slot, set if an odd number of shingles fall in it: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _texts(batch: pa.RecordBatch, column: int):
    raw, offsets = utf8(batch.column(column))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield raw[a:b].tobytes()


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class, n (distinct shingles), keys, bits (their parity), fp (the fingerprint)."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                text_hash, group, n, found, bits, fp = [], [], [], [], [], []
                for text in _texts(batch, 1):
                    name, hashes = shingles(text)
                    text_hash.append(xxhash.xxh64_intdigest(text, 42))
                    group.append(name)
                    n.append(len(hashes))
                    found.append(keys(hashes))
                    bits.append(parity(hashes))
                    fp.append(simhash.fingerprint(text))
                at_key = np.arange(len(found) + 1, dtype=np.int32) * BANDS
                at_bits = np.arange(len(bits) + 1, dtype=np.int32) * PARITY
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), _signed(text_hash), _signed(group), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at_key), pa.array(np.concatenate(found or [np.zeros(0, np.int64)]))),
                     pa.ListArray.from_arrays(pa.array(at_bits), pa.array(np.concatenate(bits or [np.zeros(0, np.int64)]))),
                     _signed(fp)],
                    ["doc_id", "text_hash", "class", "n", "keys", "bits", "fp"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, text_hash long, class long, n long, keys array<long>, bits array<long>, fp long")


def _bitmap(classes: DataFrame) -> bytes:
    """Bits of the slots of some classes; of fixed size."""

    def run(batches):
        bits = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
        for batch in batches:
            slot = np.asarray(batch.column(0), np.int64) & ((1 << BITMAP_BITS) - 1)
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for row in classes.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, shingles (their hashes) of the wanted classes; ``wanted``: class, doc_id, text_hash of a document."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(
        F.col("doc_id").bitwiseXOR(F.col("text_hash")))))

    def run(batches):
        among = np.frombuffer(bits.value, np.uint8)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = np.asarray(batch.column(0).fill_null(0), np.int64)
                doc_id, mark, group, found = [], [], [], []
                for i, text in zip(ids.tolist(), _texts(batch, 1), strict=True):
                    text_hash = xxhash.xxh64_intdigest(text, 42)
                    slot = ((i & 0xFFFFFFFFFFFFFFFF) ^ text_hash) & ((1 << BITMAP_BITS) - 1)
                    if among[slot >> 3] >> (slot & 7) & 1:
                        name, hashes = shingles(text)
                        doc_id.append(i)
                        mark.append(text_hash)
                        group.append(name)
                        found.append(hashes)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64()), _signed(mark), _signed(group),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "text_hash", "class", "shingles"])

    read = docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, text_hash long, class long, shingles array<long>")
    return (read.join(wanted, ["doc_id", "text_hash", "class"], "left_semi")
            .select("class", "shingles").dropDuplicates(["class"]))


def similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b, and more columns) of classes that are similar enough. A class in many pairs is read in several copies."""
    often = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("copies"))
    salted = pairs.join(often, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")))
    left = (often.join(known.withColumnRenamed("class", "a"), "a")
            .select("a", F.col("shingles").alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt")))
    both = (salted.join(known.select(F.col("class").alias("b"), F.col("shingles").alias("right")), "b")
            .join(left, ["a", "salt"]))
    common = F.size(F.array_intersect("left", "right"))
    over, under = SIMILARITY
    return both.filter(common * (over + under) >= over * (F.size("left") + F.size("right"))).select(*pairs.columns)


def _met(open_: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs (a, b, with root_a, root_b) of classes of different groups: the pivots of a round, whose ordinal is in [least, most), with the rest.

    Those of an ordinal below have been pivots; they and all other members have been compared. Sizes and parity bitmaps leave out
    pairs that differ in too many shingles to be similar, and no others.
    """
    over, under = SIMILARITY
    salts = F.ceil(F.col("many") / SALT)
    rest = open_.filter(F.col("ordinal") >= least)
    pivot = F.col("ordinal") < most
    differ = " + ".join(f"bit_count(x.bits[{i}] ^ y.bits[{i}])" for i in range(PARITY))
    x = rest.filter(pivot).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    y = rest.withColumn("salt", F.pmod(F.xxhash64("class", F.lit(1)), salts)).withColumn("pivot", pivot)
    pairs = x.alias("x").join(y.alias("y"), ["key", "salt"]).filter(
        f"x.root <> y.root and (not y.pivot or x.class < y.class) and least(x.n, y.n) * {under} >= greatest(x.n, y.n) * {over}"
        f" and ({differ}) * {over + under} <= (x.n + y.n) * {under - over}")
    # One with a small hash is often a pivot, so it is the side that is read in several copies.
    first = "xxhash64(x.class) < xxhash64(y.class)"
    return pairs.select(*[F.expr(f"if({first}, {p}.{column}, {q}.{column})").alias(name) for p, q, column, name in (
        ("x", "y", "class", "a"), ("y", "x", "class", "b"), ("x", "y", "root", "root_a"), ("y", "x", "root", "root_b"))]).distinct()


def _moved(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the root that their ``root`` was joined to by ``links`` (node, root)."""
    over = links.select(F.col("node").alias("__node"), F.col("root").alias("__over"))
    return (rows.join(over, F.col("root") == F.col("__node"), "left")
            .select(*[c for c in rows.columns if c != "root"], F.coalesce("__over", "root").alias("root")))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(node, root): classes that fingerprints link, with the least class of their group; ``nodes``: class, fp."""
    joined = roots(simhash.links(nodes.select("fp").distinct()))
    of = nodes.join(joined, F.col("fp") == joined["node"], "left").select("class", F.coalesce("root", "fp").alias("of"))
    least = of.groupBy("of").agg(F.min("class").alias("root"), F.count("*").alias("many")).filter("many > 1")
    return of.join(least, "of").filter("class <> root").select(F.col("class").alias("node"), "root")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of keys whose members are of more than one group."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
    return rows.join(mixed, "key")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class, root (one of the group's classes), component_id: the smallest doc_id that links lead to."""
    marked = written(marks(docs), "marks")
    nodes = written(marked.groupBy("class").agg(
        F.min("doc_id").alias("first"), F.max("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"),
        F.first("fp").alias("fp"),
        F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash")).alias("of")), "classes")
    keyed = nodes.select(F.explode("keys").alias("key"), "class", "n")
    met = keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    ordinal = F.pmod(F.xxhash64("class"), F.lit(1 << 31)) / (1 << 31) * F.col("many")
    merged = [written(_by_fingerprint(nodes.select("class", "fp")), "fingerprints")]
    met_by = (keyed.join(met, "key").join(nodes.select("class", "bits"), "class")
              .withColumn("ordinal", ordinal).withColumn("root", F.col("class")))
    open_ = written(_mixed(_moved(met_by, merged[0])), "open")
    most_members = open_.agg(F.max("many")).first()[0] or 0
    known = written(sets(docs, open_.select("class").distinct().join(nodes, "class").select(
        "class", "of.doc_id", "of.text_hash")), "shingles")
    least, most = 0, PIVOTS
    while least < most_members and not open_.isEmpty():
        pairs = written(_met(open_, least, most), "pairs")
        found = written(similar(pairs, known), "similar")
        # Only groups of the rounds before are joined, not their members.
        merged.append(roots(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
        left = written(_mixed(_moved(open_, merged[-1])), "open")
        discard(pairs, found, open_)
        open_, least, most = left, most, most * MORE
    discard(known)
    rooted = nodes.select("class", "first", F.col("class").alias("root"))
    for links in merged:
        rooted = _moved(rooted, links)
    least_id = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least_id, "root").select("class", "root", "component_id")
    return marked.join(of, "class").select("doc_id", "text_hash", "class", "root", "component_id")


def first_of_group(docs: DataFrame) -> DataFrame:
    """The documents of which each group keeps one, all columns unchanged, chosen as in ``simhash.first_of_group``."""
    return simhash.kept_of(docs, components(docs), F.hex("root"))
