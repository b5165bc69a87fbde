"""Fill-in-the-middle: texts are cut at line ends that a piecewise-linear learned index finds.

The boundaries of a text are the places, in code points, where its units begin or end. ``fit`` covers (rank, place) with
linear segments that miss no boundary by more than ``ERROR`` (a cone of slopes is narrowed boundary by boundary
until none is left, then a new segment begins); predictions are integer arithmetic, and what a prediction misses is stored.
``find`` predicts a rank's place and adds what is stored, which is exact. ``boundary_index`` gives the index as
a table, so that later epochs cut the same texts elsewhere without reading lines again; ``transform`` builds it in the scan.

Everything happens in one scan, without a shuffle; a task holds the texts of one small Arrow batch.

Defined results: null and empty texts have no units and stay plain, as do texts with a sentinel; a null doc_id draws its cuts
from an empty number; equal rows are cut alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallypact.llm.common import chunks, utf8

SEED = 7
#: Percent of the texts that are transformed, and of those the percent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points by which a segment may miss a boundary.
ERROR = 128
#: Slopes are multiples of 2**-SLOPE_BITS.
SLOPE_BITS = 20
#: Rows of a step, and bytes of its texts; a longer text is a step of its own.
ROWS, STEP_BYTES = 512, 1 << 23


class Index(NamedTuple):
    """Segments (first rank, place predicted there, slope) and what the prediction of each rank misses."""

    rank: np.ndarray
    place: np.ndarray
    slope: np.ndarray
    missed: np.ndarray


def fit(places: np.ndarray, error: int = ERROR) -> Index:
    """An index of ascending ``places``; every prediction misses by ``error`` at most."""
    n, at, step = len(places), 0, 64
    rank, place, slope = [], [], []
    # One code point is left for the rounding of slopes and predictions.
    room = error - 1
    while at < n:
        low, high, end = 0.0, np.inf, at + 1
        while end < n:
            x = np.arange(end - at, min(end + step, n) - at)
            y = places[end:end + step] - places[at]
            lows = np.maximum.accumulate(np.maximum((y - room) / x, low))
            highs = np.minimum.accumulate(np.minimum((y + room) / x, high))
            wrong = np.flatnonzero((lows > highs) | (x >= 1 << SLOPE_BITS - 2))
            good = int(wrong[0]) if len(wrong) else len(x)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            end += good
            if len(wrong):
                break
        rank.append(at)
        place.append(int(places[at]))
        slope.append(round((low + (high if np.isfinite(high) else low)) / 2 * (1 << SLOPE_BITS)))
        at = end
    rank, place, slope = (np.array(v, np.int64) for v in (rank, place, slope))
    lengths = np.diff(np.append(rank, n))
    predicted = _predict(np.arange(n) - np.repeat(rank, lengths), np.repeat(place, lengths), np.repeat(slope, lengths))
    return Index(rank, place, slope, (places - predicted).astype(np.int32))


def _predict(steps, place, slope):
    return place + (steps * slope + (1 << SLOPE_BITS - 1) >> SLOPE_BITS)


def find(index: Index, rank: int) -> int:
    """The exact place of a rank: predicted by its segment, then corrected."""
    at = int(np.searchsorted(index.rank, rank, "right")) - 1
    steps = rank - int(index.rank[at])
    return _predict(steps, int(index.place[at]), int(index.slope[at])) + int(index.missed[rank])


def boundaries(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text of a UTF-8 buffer the places of its line boundaries in code points, 0 included."""
    character = np.cumsum((raw & 0xC0) != 0x80)
    ends = np.flatnonzero(raw == 10)
    first = np.searchsorted(ends, offsets)
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            out.append(np.zeros(1, np.int64))
            continue
        before = int(character[a - 1]) if a else 0
        lines = character[ends[first[i]:first[i + 1]]] - before
        length = int(character[b - 1]) - before
        tail = [] if len(lines) and lines[-1] == length else [length]
        out.append(np.concatenate([[0], lines, tail]).astype(np.int64))
    return out


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def arrange(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text of an output. Parts hold no sentinel, so each is found where it comes first."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    to = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first):at], output[at + len(second):to], output[to + len(MIDDLE):]
    return one + middle + two if form == "psm" else two + middle + one


def cut(doc_id: int | None, text: str, index: Index, seed: int = SEED, rate: int = RATE,
        suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, str]:
    """form, code points of prefix and middle (null if plain), output."""
    units = len(index.missed) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return "plain", None, None, text
    a, b = sorted((h1 % (units + 1), h2 % (units + 1)))
    a, b = find(index, a), find(index, b)
    form = "spm" if h4 % 100 < suffix_first else "psm"
    return form, a, b - a, arrange(form, text[:a], text[a:b], text[b:])


def _texts(batches):
    """(ids, texts, boundaries) of steps of bounded size."""
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            batch = whole.slice(at, ROWS)
            raw, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, STEP_BYTES):
                part = raw[offsets[a]:offsets[b]]
                at_part = offsets[a:b + 1] - offsets[a]
                texts = [part[i:j].tobytes().decode() for i, j in zip(at_part[:-1].tolist(), at_part[1:].tolist(), strict=True)]
                yield batch.column(0).slice(a, b - a).to_pylist(), texts, boundaries(part, at_part)


def boundary_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """doc_id, n (units), segments (rank, place, slope) and missed (one number per boundary)."""
    segment = pa.struct([("rank", pa.int64()), ("place", pa.int64()), ("slope", pa.int64())])

    def run(batches):
        for ids, _, places in _texts(batches):
            found = [fit(p, error) for p in places]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(p) - 1 for p in places], pa.int64()),
                pa.array([[dict(zip(("rank", "place", "slope"), s, strict=True)) for s in
                           zip(i.rank.tolist(), i.place.tolist(), i.slope.tolist(), strict=True)] for i in found], pa.list_(segment)),
                pa.array([i.missed for i in found], pa.list_(pa.int32()))], ["doc_id", "n", "segments", "missed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, segments array<struct<rank: long, place: long, slope: long>>, missed array<int>")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
              error: int = ERROR) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output."""

    def run(batches):
        for ids, texts, places in _texts(batches):
            rows = [cut(i, t, fit(p, error), seed, rate, suffix_first) for i, t, p in zip(ids, texts, places, strict=True)]
            form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(p) - 1 for p in places], pa.int64()), pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.large_string()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def digest(docs: DataFrame) -> DataFrame:
    """The outputs' digests, and those of the texts rebuilt from output and form."""

    def run(batches):
        for batch in batches:
            form, output = batch.column("form").to_pylist(), batch.column("output").to_pylist()
            kept = [batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([
                *kept, pa.array([hashlib.sha256(o.encode()).hexdigest() for o in output], pa.string()),
                pa.array([hashlib.sha256(restore(f, o).encode()).hexdigest() for f, o in zip(form, output, strict=True)], pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return transform(docs).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


ORACLE = f"""
with lined as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as lines,
        sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (
    select *, len(lines) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
        ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from lined),
formed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}')
                  or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from drawn),
parts as (
    select *, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle,
        array_to_string(lines[b + 1:], '') as suffix from formed)
select doc_id, n::bigint as n, form,
    case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
    case when form <> 'plain' then length(middle) end::bigint as middle_chars,
    sha256(case form when 'plain' then text
        when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
        else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from parts
"""
