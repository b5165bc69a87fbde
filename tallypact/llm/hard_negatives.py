"""Hard negatives: Strassen products of integer tiles, then mergeable heaps of positives and of windows.

A row's components become integers, floor(256 x). Scores of anchors against all rows are products of tiles (a block of
anchors, a block of rows), multiplied by Strassen's recursion: seven products of half the size, sums of int64, zeros
where a tile is not even. Sums of int64 are exact modulo 2^64, and a score fits by the bound on components, so scores
are exact. A leaf is multiplied in float64 only where no sum can reach 2^53, else in int64.

Per anchor a task keeps the best ``POSITIVES`` rows of the same label over all tiles it reads; these heaps are merged by
anchor. In a second pass it keeps, per anchor and positive, the best ``NEGATIVES`` rows of other labels
whose score is in the positive's window. Heaps are shuffled as at most 5 or 50 rows per anchor and task. Which rows are
anchors is stated beforehand, and every row meets every anchor as part of one block product. Nothing is broadcast: tiles and
blocks meet in the cells of a grid, for which a tile is copied once per ``BLOCK`` anchors and a block once per ``CELL`` tiles. A
task that holds heaps of too many anchors lets go of what it has, since heaps of one anchor may be merged in any parts.

Defined results: rows with a null label, vector or component or one that is not finite take no part, nor do rows with a null
vec_id or with an integer component of ``LARGEST`` or more (a score might not fit). Vectors shorter than the longest are
filled with zeros. Of rows that share a vec_id the least (label, components) takes part. Anchors without a
positive, and positives without a negative, give no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypact.llm.common import written

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a hard negative's score lies.
WINDOW = (30, 90)
SCALE = 256
ANCHORS_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: With up to 2^12 components a hundredfold score is below 2^63.
LARGEST = 1 << 22
#: Tiles of at most so many anchors and rows; a side of a product of at most ``LEAF`` is not halved.
ANCHOR_TILE, ROW_TILE, LEAF = 1024, 2048, 32
#: Anchors of a block, which a tile of rows meets as a whole; tiles of a cell of the grid; most partitions of the grid.
BLOCK, CELL, CELLS = 8192, 4, 20_000
#: Heap entries a task holds before it lets go of them.
HELD = 1 << 20


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, exact modulo 2^64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * k
        if largest < 1 << 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    a = np.pad(a, ((0, m & 1), (0, k & 1)))
    b = np.pad(b, ((0, k & 1), (0, n & 1)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def encode(rows: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """vec_id, label, parts (integers) of the rows that take part."""
    label = F.col("label").cast("long") if label is None else label
    part = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST))
    taking = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fits)
    return (taking.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), part.cast("array<int>").alias("parts"))
            .groupBy("vec_id").agg(F.min(F.struct("label", "parts")).alias("row")).select("vec_id", "row.*"))


def relabelled(every: int = RELABEL_EVERY, labels: int = LABELS) -> Column:
    """Labels of every seventh row are moved on by one."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label)


def _tiles(rows: DataFrame, most: int) -> DataFrame:
    """ids, labels, width, parts: blocks of up to ``most`` rows of a partition, their components as bytes."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), most):
                batch = whole.slice(at, most)
                parts = batch.column(2)
                lengths = np.asarray(parts.value_lengths(), np.int64)
                grid = np.zeros((len(batch), int(lengths.max(initial=0))), np.int32)
                grid[np.arange(grid.shape[1]) < lengths[:, None]] = np.asarray(parts.flatten(), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in (0, 1)]
                    + [pa.array([grid.shape[1]], pa.int32()), pa.array([grid.tobytes()], pa.binary())],
                    ["ids", "labels", "width", "parts"])

    return rows.select("vec_id", "label", "parts").mapInArrow(
        run, "ids array<long>, labels array<long>, width int, parts binary")


def _met(blocks: DataFrame, tiles: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Every tile of rows with every block of anchors (columns ``a_...``), a cell of a grid per bucket of blocks and part of tiles."""
    number = {"bucket": buckets, "part": parts}

    def place(rows, column, mine, other):
        of = F.pmod(F.xxhash64(column), F.lit(number[mine])).alias(mine)
        rows = rows.select("*", of)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number[other] - 1).cast("long"))).alias(other)
        return rows.select("*", every).repartition(min(buckets * parts, CELLS), "bucket", "part")

    dealt = place(blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns]), "a_block", "bucket", "part")
    return place(tiles, F.col("ids")[0], "part", "bucket").join(dealt.hint("merge"), ["bucket", "part"])


def _matrix(batch, i: int, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.asarray(batch.column(prefix + c)[i].values, np.int64) for c in ("ids", "labels"))
    parts = np.frombuffer(batch.column(prefix + "parts")[i].as_buffer(), np.int32)
    return ids, labels, parts.reshape(len(ids), batch.column(prefix + "width")[i].as_py()).astype(np.int64)


def _scores(batch, i: int, most: int):
    """Anchors' ids and labels, rows' ids and labels, all scores; up to ``most`` anchors at a time."""
    a_ids, a_labels, a = _matrix(batch, i, "a_")
    ids, labels, b = _matrix(batch, i, "")
    width = min(a.shape[1], b.shape[1])
    b = np.ascontiguousarray(b[:, :width].T)
    for at in range(0, len(a), most):
        yield a_ids[at:at + most], a_labels[at:at + most], ids, labels, strassen(a[at:at + most, :width], b)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of each group, higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    first = np.flatnonzero(np.diff(sorted_group, prepend=sorted_group[:1] - 1)) if len(order) else order
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < most]


def _candidates(ok: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the entries that may be among the first ``most`` of their line: those not below its most-th best."""
    if ok.shape[1] > most:
        masked = np.where(ok, score, np.iinfo(np.int64).min)
        bar = np.partition(masked, ok.shape[1] - most, axis=1)[:, ok.shape[1] - most]
        ok = ok & (score >= bar[:, None])
    return np.nonzero(ok)


class _Heaps:
    """The best entries per key over all tiles a task has seen; a key is a tuple of longs."""

    def __init__(self, most: int, names: tuple[str, ...], held: int = HELD):
        self.most, self.names, self.held = most, names, held
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.floor = 0

    def add(self, *columns: np.ndarray) -> None:
        """Key columns, then score and id."""
        self.parts.append(columns)
        self.size += len(columns[0])

    def shrink(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        *keys, score, ids = columns
        _, group = np.unique(np.stack(keys, 1), axis=0, return_inverse=True)
        keep = _best(group.ravel(), score, ids, self.most)
        self.parts = [tuple(c[keep] for c in columns)]
        self.size = self.floor = len(keep)

    def batches(self, last: bool = False):
        """What is let go: all at the end, or when even the best entries are too many."""
        if self.size and (last or self.size > 2 * self.floor + (self.held >> 2)):
            self.shrink()
            if last or self.size > self.held:
                yield pa.RecordBatch.from_pydict(dict(zip(self.names, map(pa.array, self.parts[0]), strict=True)))
                self.parts, self.size, self.floor = [], 0, 0


class Grid(NamedTuple):
    """Tiles of all rows, blocks of anchors, and by how many buckets and parts they meet."""

    blocks: DataFrame
    tiles: DataFrame
    buckets: int
    parts: int
    anchor_tile: int = ANCHOR_TILE


def positives(grid: Grid, most: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, positive_score: the best other rows of the anchor's label."""
    names = ("anchor_id", "score", "id")
    side = grid.anchor_tile

    def run(batches):
        heaps = _Heaps(most, names)
        for batch in batches:
            for i in range(len(batch)):
                for a_ids, a_labels, ids, labels, scores in _scores(batch, i, side):
                    ok = (a_labels[:, None] == labels) & (a_ids[:, None] != ids)
                    line, column = _candidates(ok, scores, most)
                    heaps.add(a_ids[line], scores[line, column], ids[column])
                    yield from heaps.batches()
        yield from heaps.batches(last=True)

    found = _met(grid.blocks, grid.tiles, grid.buckets, grid.parts).mapInArrow(run, "anchor_id long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= most)
            .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))


def negatives(grid: Grid, found: DataFrame, most: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    low, high = window
    names = ("anchor_id", "positive_id", "positive_score", "score", "id")
    side = grid.anchor_tile
    # Windows travel with the block of their anchor.
    member = grid.blocks.select("block", F.explode("ids").alias("anchor_id"))
    windows = (found.join(member, "anchor_id").groupBy("block").agg(F.array_sort(F.collect_list(
        F.struct("anchor_id", "positive_id", "positive_score"))).alias("windows")))

    def run(batches):
        heaps = _Heaps(most, names)
        for batch in batches:
            for i in range(len(batch)):
                entry = batch.column("a_windows")[i].values
                anchor, positive, bar = (np.asarray(entry.field(c), np.int64) for c in names[:3])
                for a_ids, a_labels, ids, labels, scores in _scores(batch, i, side):
                    order = np.argsort(a_ids)
                    mine = np.flatnonzero(np.isin(anchor, a_ids))
                    line = order[np.searchsorted(a_ids, anchor[mine], sorter=order)]
                    # As many windows at a time as a tile has anchors, so that they need no more room.
                    for at in range(0, len(line), side):
                        part, of = line[at:at + side], mine[at:at + side]
                        score, mark = scores[part], bar[of, None]
                        ok = (a_labels[part, None] != labels) & (low * mark <= 100 * score) & (100 * score <= high * mark)
                        row, column = _candidates(ok, score, most)
                        heaps.add(anchor[of[row]], positive[of[row]], bar[of[row]], score[row, column], ids[column])
                        yield from heaps.batches()
        yield from heaps.batches(last=True)

    mined = _met(grid.blocks.join(windows, "block"), grid.tiles, grid.buckets, grid.parts).mapInArrow(
        run, "anchor_id long, positive_id long, positive_score long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    return (mined.withColumn("rank", rank).filter(F.col("rank") <= most)
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, positives_per_anchor: int = POSITIVES,
         negatives_per_positive: int = NEGATIVES, window: tuple[int, int] = WINDOW, block: int = BLOCK,
         anchor_tile: int = ANCHOR_TILE, row_tile: int = ROW_TILE, cell: int = CELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is over vec_id and label."""
    encoded = written(encode(rows, label), "vectors")
    tiles = written(_tiles(encoded, row_tile), "tiles")
    anchors = encoded.filter(is_anchor)
    buckets = max(1, -(-anchors.count() // block))
    blocks = written(_tiles(anchors.repartition(buckets), block).withColumn("block", F.col("ids")[0]), "blocks")
    grid = Grid(blocks, tiles, buckets, max(1, -(-tiles.count() // cell)), anchor_tile)
    found = written(positives(grid, positives_per_anchor), "positives")
    return negatives(grid, found, negatives_per_positive, window)


def digest(rows: DataFrame) -> DataFrame:
    """Hard negatives of the anchors whose vec_id is divisible by 100, labels of every seventh row moved on."""
    return mine(rows, F.col("vec_id") % ANCHORS_EVERY == 0, relabelled())


ORACLE = f"""
with taking as (
    select vec_id, case when vec_id % {RELABEL_EVERY} = 0 then (label + 1) % {LABELS} else label end as label,
        list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as parts
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id as id, b.label as label,
        list_sum(list_transform(range(1, len(a.parts) + 1), lambda i: a.parts[i] * b.parts[i]))::bigint as score
    from taking a, taking b where a.vec_id % {ANCHORS_EVERY} = 0 and a.vec_id <> b.vec_id),
positives as (
    select anchor_id, anchor_label, id as positive_id, score as positive_score from scored where label = anchor_label
    qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES})
select p.anchor_id, p.positive_id,
    (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id))::int as rank,
    s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> p.anchor_label
    and {WINDOW[0]} * p.positive_score <= 100 * s.score and 100 * s.score <= {WINDOW[1]} * p.positive_score
qualify rank <= {NEGATIVES}
"""
