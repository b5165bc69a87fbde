"""Suffix-array dedup by prefix-free parsing.

A rolling hash over 20 bytes picks the trigger of every 50-byte window, so phrases between triggers are short
whatever the text is (``repeats``). A phrase runs on over the 49 bytes after its last window start, so no window
is lost at its end. The dictionary of a shard holds each distinct phrase once, with the first and last document of
its parse. ``ranks`` sorts the dictionary's suffixes by doubling to the window's depth: suffixes of equal rank start
with the same 50 bytes. The parse then says in which document, in corpus order, each rank comes first.

Defined results: null and empty texts have no bytes; a text shorter than a window loses none; equal rows are
reported as often as they come and never remove each other's bytes; an empty table gives an empty result; a null
doc_id loses nothing and removes nothing. Other columns are ignored. Bytes are cut wherever windows
end, so what is left of a character may not be valid UTF-8; ``remove_repeats`` therefore returns binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallypact.llm import repeats
from tallypact.llm.common import utf8

WINDOW = 50
GRAM = 20
#: Bytes of corpus text per shard of the dictionary; a shard's suffixes are sorted in one task.
SHARD_BYTES = 2 << 20


#: A fixed random number for every byte value, so that a rolling hash does not see letters in order.
_SCRAMBLED = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def cut_bytes(raw: np.ndarray, offsets: np.ndarray):
    base = int(offsets[0])
    data = raw[base:offsets[-1]]
    text = data.tobytes()

    def piece(start, length):
        return [text[s:s + n] for s, n in zip(start.tolist(), length.tolist(), strict=True)]

    return _SCRAMBLED[data], offsets - base, piece


def ranks(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the ``depth`` bytes from each start on: equal ranks mean equal bytes, by doubling from 8 bytes."""
    if depth < 8:
        codes = np.zeros(len(starts), np.uint64)
        for i in range(depth):
            codes = codes << np.uint64(8) | data[starts + i]
        return np.unique(codes, return_inverse=True)[1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = 8
    # Ranks are needed wherever a later doubling looks, so all places of the dictionary are ranked.
    places = np.arange(len(data))
    codes = np.zeros(len(data), np.uint64)
    for i in range(8):
        codes = codes << np.uint64(8) | padded[places + i]
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    while size * 2 <= depth:
        rank = _join(rank, size, len(data))
        size *= 2
    if size < depth:
        rank = _join(rank, depth - size, len(data))
    return rank[starts]


def _join(rank: np.ndarray, by: int, n: int) -> np.ndarray:
    after = np.zeros(n, np.int64)
    after[:n - by] = rank[by:]
    return np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)


def match_by_rank(window: int):
    def match(phrases: list[bytes], low: list[int], high: list[int]):
        if not phrases:
            return
        data = np.frombuffer(b"".join(phrases), np.uint8)
        size = np.fromiter(map(len, phrases), np.int64, len(phrases))
        first = np.cumsum(size) - size
        count = size - window + 1
        phrase = np.repeat(np.arange(len(phrases)), count)
        offset = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
        rank = ranks(data, first[phrase] + offset, window)
        low, high = np.array(low), np.array(high)
        source = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(source, rank, low[phrase])
        yield from repeats.grouped_runs(phrase, offset, source[rank], high)

    return match


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """doc_id, text, spans: runs of bytes (start, length) that a document with a smaller doc_id has too.

    ``sizes``: those of ``repeats.Units``.
    """
    docs = docs.select("doc_id", "text")
    units = repeats.Units(window, gram, cut_bytes, **sizes)
    return repeats.with_spans(docs, repeats.removed_spans(docs, units, match_by_rank(window), SHARD_BYTES))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: the bytes that stay."""
    return _cut(repeated_spans(docs, window, gram, **sizes), window, "kept binary", lambda kept: kept)


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _cut(repeated_spans(docs, window, gram, **sizes), window, "kept_sha256 string",
                lambda kept: hashlib.sha256(kept).hexdigest())


def _cut(marked: DataFrame, window: int, column: str, finish) -> DataFrame:
    name, kind = column.split()

    def cut(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            out, removed, runs = [], [], []
            for k in range(len(batch)):
                data = raw[offsets[k]:offsets[k + 1]]
                spans = batch.column(2)[k].as_py()
                if spans:
                    gone = repeats.mask(len(data), spans, window)
                    removed.append(int(gone.sum()))
                    runs.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    data = data[~gone]
                else:
                    removed.append(0)
                    runs.append(0)
                out.append(finish(data.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(out, pa.string() if kind == "string" else pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", name])

    return marked.mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, {column}")
