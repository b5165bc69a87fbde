"""Substring dedup: automata of repeated phrases (pyahocorasick).

``repeated_spans`` confirms the passages that come in several documents (``repeats``: candidates by seeds,
compared word by word inside a shard), compiles one Aho-Corasick automaton per shard from the confirmed windows
and streams the phrases of all documents through it, so every occurrence is located. Words are coded as
two characters inside a shard, so a window costs two automaton nodes per word.

Defined results: null, blank and empty texts have no words; a text shorter than a window loses none; equal rows
are reported as often as they come and never remove each other's words; an empty table gives an empty result;
a null doc_id loses nothing and removes nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallypact.llm import repeats
from tallypact.llm.common import utf8

WINDOW = 13
GRAM = 7
#: Bytes of corpus text per shard of phrases; a shard is compared and compiled in one task.
SHARD_BYTES = 2 << 20


#: True for the six ASCII white-space bytes; a random number for every byte, and the base of word hashes.
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SCRAMBLED = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_POWERS = _powers(_BASE, (1 << 20) + 1)
_INVERSES = _powers(pow(_BASE, -1, 1 << 64), (1 << 20) + 1)


def cut_words(raw: np.ndarray, offsets: np.ndarray):
    """Word hashes of consecutive texts, the first word of each, and the joined words from a word on.

    A word's hash is a difference of sums over the bytes, moved to the place zero, so all words are hashed at once.
    """
    data = raw[offsets[0]:offsets[-1]]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets - offsets[0]] = True
    inside = ~_SPACE[data]
    before = np.append(False, inside[:-1]) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.append(inside[1:], False) if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    powers, inverses = (_POWERS, _INVERSES) if n < len(_POWERS) else (
        _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SCRAMBLED[data] * powers[:n], out=sums[1:])
    units = (sums[ends] - sums[starts]) * inverses[starts]
    units ^= units >> np.uint64(32)
    text = data.tobytes()

    def piece(start, length):
        return [b" ".join(text[a:b].split()) for a, b in
                zip(starts[start].tolist(), ends[start + length - 1].tolist(), strict=True)]

    return units, np.searchsorted(starts, offsets - offsets[0]), piece


class _Codes(dict):
    """A number for each word of a shard, from 256 on; lower ones are no words."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 256
        return n


def _as_text(codes: np.ndarray) -> str:
    """Two characters per word, its high and low part, from ranges that do not meet.

    An automaton looks children up one by one, so its nodes must not have a child for each word.
    """
    pairs = np.stack([(codes >> 8) + 1, (codes & 255) + 0xE000], 1).astype("<u4")
    return pairs.tobytes().decode("utf-32-le")


def _window_classes(codes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of equal windows of each start, and the first start of each class; compared word by word."""
    wide = codes.astype(np.uint64) * repeats.MIX
    sums = repeats.rolling(wide, window)[starts]
    sums ^= sums >> np.uint64(31)
    _, first, of = np.unique(sums, return_index=True, return_inverse=True)
    like = starts[first][of]
    same = np.ones(len(starts), bool)
    for i in range(window):
        same &= codes[starts + i] == codes[like + i]
    if not same.all():
        # Two different windows share a hash: class them by their words.
        words = np.stack([codes[starts + i] for i in range(window)], 1)
        _, first, of = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return of.ravel(), starts[first]


def match_with_automaton(window: int):
    """Confirm, compile, stream: for ``repeats.removed_spans``."""

    def match(phrases: list[bytes], low: list[int], high: list[int]):
        if not phrases:
            return
        table = _Codes()
        words = [p.split(b" ") for p in phrases]
        # A zero, which no window has, stands after each phrase.
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = np.fromiter((c for p in words for c in (*map(table.__getitem__, p), 0)), np.uint32, int(size.sum()))
        text = _as_text(codes)
        first, count = np.cumsum(size) - size, size - window
        phrase = np.repeat(np.arange(len(words)), count)
        starts = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + first[phrase]
        low, high = np.array(low), np.array(high)
        of, sample = _window_classes(codes, starts, window)
        source = np.full(len(sample), np.iinfo(np.int64).max)
        latest = np.full(len(sample), np.iinfo(np.int64).min)
        np.minimum.at(source, of, low[phrase])
        np.maximum.at(latest, of, high[phrase])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k in np.flatnonzero(source < latest).tolist():
            at = int(sample[k])
            automaton.add_word(text[2 * at:2 * (at + window)], k)
        if not len(automaton):
            return
        automaton.make_automaton()
        found = np.fromiter((x for pair in automaton.iter(text) for x in pair), np.int64).reshape(-1, 2)
        start = found[:, 0] // 2 - (window - 1)
        phrase = np.searchsorted(first, start, "right") - 1
        yield from repeats.grouped_runs(phrase, start - first[phrase], source[found[:, 1]], high)

    return match


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """doc_id, text, spans: runs of words (start, length) that a document with a smaller doc_id has too.

    ``sizes``: those of ``repeats.Units``.
    """
    docs = docs.select("doc_id", "text")
    units = repeats.Units(window, gram, cut_words, **sizes)
    spans = repeats.removed_spans(docs, units, match_with_automaton(window), SHARD_BYTES)
    return repeats.with_spans(docs, spans)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the text of the words that stay, joined by one space."""
    return _cut(repeated_spans(docs, window, gram, **sizes), window, "kept string", lambda kept: kept.decode())


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return _cut(repeated_spans(docs, window, gram, **sizes), window, "kept_sha256 string",
                lambda kept: hashlib.sha256(kept).hexdigest())


def _cut(marked: DataFrame, window: int, column: str, finish) -> DataFrame:
    def cut(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            ids, n_words, n_removed, out = batch.column(0), [], [], []
            for k in range(len(ids)):
                words = raw[offsets[k]:offsets[k + 1]].tobytes().split()
                spans = batch.column(2)[k].as_py()
                n_words.append(len(words))
                if spans:
                    gone = repeats.mask(len(words), spans, window)
                    n_removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    n_removed.append(0)
                out.append(finish(b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())],
                ["doc_id", "n_words", "n_removed", column.split()[0]])

    return marked.mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {column}")
