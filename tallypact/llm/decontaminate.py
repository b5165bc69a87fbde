"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Texts are normalised (A-Z to a-z, words are runs of letters, digits and non-ASCII). The automaton holds every
window of ten consecutive words of an item, or the whole item if it has fewer. Its alphabet is the benchmark's
words, coded as characters; any other word is one character that no window has. A text is scanned once, and the
places found are word numbers, which are mapped back to offsets of the original text.

The automaton is broadcast. Its size is checked: a pass takes at most ``MAX_WINDOWS`` windows (about 0.5 kB each),
and a larger benchmark is dealt over several passes of the same scan.

Defined results: null and empty texts have no words and are clean; an item without words has no window; equal items
are found under each id; equal documents are reported as often as they come; an empty benchmark leaves all clean; an
empty table gives no rows; a null item_id is left out of the list of items but its windows still hit.
"""

from __future__ import annotations

import math
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypact.llm.common import utf8

WINDOW = 10
MAX_WINDOWS = 200_000
#: Bytes of separators become spaces, A-Z become a-z; bytes of non-ASCII characters are word bytes.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
SPAN = "struct<start:int,end:int,item_id:string>"
SCHEMA = (f"doc_id long, n_words long, n_hit long, items array<string>, spans array<{SPAN}>")
NO_WORD = "\U0010FFFF"


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (words joined by one space) with the ids of their items."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce("text", F.lit("")), letters, letters.lower())
    words = F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    last = F.greatest(F.size("words") - window + 1, F.lit(1))
    return (items.filter(F.size("words") > 0)
            .select("item_id", F.explode(F.transform(
                F.sequence(F.lit(1), last),
                lambda i: F.array_join(F.slice("words", i, window), " "))).alias("window"))
            .groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")))


class Automaton:
    """Compiled once per Python worker from the broadcast windows."""

    cache: dict = {}

    def __init__(self, spark, rows):
        self.rows = spark.sparkContext.broadcast([(r["window"], list(r["items"])) for r in rows])
        self.key = uuid.uuid4().hex

    def get(self):
        if self.key not in Automaton.cache:
            codes: dict[bytes, str] = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for text, items in self.rows.value:
                words = text.encode().split(b" ")
                for w in words:
                    if w not in codes:
                        n = len(codes) + 1
                        codes[w] = chr(n if n < 0xD800 else n + 0x800)
                automaton.add_word("".join(codes[w] for w in words), (len(words), items))
            if len(automaton):
                automaton.make_automaton()
            if len(Automaton.cache) > 4:
                Automaton.cache.clear()
            Automaton.cache[self.key] = codes, automaton
        return Automaton.cache[self.key]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_spans: bool = True,
         keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_words, n_hit (words inside a window), items (sorted ids) and spans of the original text.

    Spans are code points, end exclusive, one per window found. ``keep`` names columns that come through,
    with two underscores before their names.
    """
    spark = docs.sparkSession
    found = windows(benchmark, window)
    count = found.count()
    passes = max(1, math.ceil(count / MAX_WINDOWS))
    if passes == 1:
        shards = [found.collect()]
    else:
        shards = (found.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == k).collect() for k in range(passes))
    automata = [Automaton(spark, rows) for rows in shards]
    kept = [f for f in docs.schema.fields if f.name in keep]

    def scan(batches):
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.slice(a, 2048)
                raw, offsets = utf8(part.column(1))
                counts, hits, items, spans = [], [], [], []
                for k in range(len(part)):
                    text = raw[offsets[k]:offsets[k + 1]].tobytes()
                    words = text.translate(NORMAL).split()
                    places = []
                    for source in automata:
                        codes, automaton = source.get()
                        if len(automaton):
                            coded = "".join([codes.get(w, NO_WORD) for w in words])
                            places += [(end - n + 1, end + 1, ids) for end, (n, ids) in automaton.iter(coded)]
                    counts.append(len(words))
                    n_hit, ids, original = 0, [], []
                    if places:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for s, e, _ in places:
                            edge[s] += 1
                            edge[e] -= 1
                        n_hit = int((np.cumsum(edge[:-1]) > 0).sum())
                        ids = sorted({i for p in places for i in p[2]})
                        if with_spans:
                            original = _original(text, places)
                    hits.append(n_hit)
                    items.append(ids)
                    spans.append(original)
                arrays = [part.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                          pa.array(items, pa.list_(pa.string())),
                          pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                                              ("item_id", pa.string())])))]
                names = ["doc_id", "n_words", "n_hit", "items", "spans"]
                yield pa.RecordBatch.from_arrays(
                    arrays + [part.column(2 + i) for i in range(len(kept))], names + [f"__{f.name}" for f in kept])

    schema = SCHEMA + "".join(f", `__{f.name}` {f.dataType.simpleString()}" for f in kept)
    return (docs.select("doc_id", F.col("text").alias("text_"),
                        *[F.col(f"`{f.name}`").alias(f"__{f.name}") for f in kept])
            .mapInArrow(scan, schema))


def _original(text: bytes, places) -> list[dict]:
    """Code point spans of word ranges."""
    at = np.array([m.span() for m in WORD_BYTES.finditer(text)], np.int64)
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    return [{"start": int(points[at[s, 0]]), "end": int(points[at[e - 1, 1]]), "item_id": i}
            for s, e, ids in places for i in ids]


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find(docs, benchmark, with_spans=False).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
