"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between, hashed to ``2**BITS``
places. Learning takes at most about ``MAX_LABELLED`` labelled rows, chosen by a hash of the id; shards of
``SHARD_ROWS`` of them run FTRL-proximal with per-coordinate rates and L1, and the shards' weights are averaged by feature. L1 leaves
few weights, at most ``2**BITS``, which are broadcast; every document is then scored in one scan.

Defined results: null and empty texts have no features and get the score of the bias; a document that several labels
name is toxic if one of them says so; labels without a doc_id or a verdict are ignored; without any labels, or with one class
only, every score is that class's rate (0.5 without any); equal rows are scored as often as they come; a null
doc_id is scored and not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact.llm.common import utf8
from tallypact.llm.decontaminate import NORMAL

BITS = 20
#: The bound on rows that are learnt from, and how many of them a shard takes.
MAX_LABELLED = 40_000
SHARD_ROWS = 10_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
FOLDS = 5
REMEMBERED = 400_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def features(text: bytes) -> np.ndarray:
    """Places of a text's distinct words, pairs and skip pairs."""
    words = text.translate(NORMAL).split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - BITS)
    pairs = (h[:-1] * _A + h[1:] * _B) * _A
    skips = (h[:-2] * _B + h[2:] * _C) * _A
    return np.unique(np.concatenate([h * _C, pairs, skips]) >> shift).astype(np.int32)


class Ftrl:
    """State of one learner: per coordinate the shifted sum of gradients and the sum of their squares."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias, learnt from labelled documents that are not held out."""
    usable = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total, positive = usable.agg(F.count("*"), F.sum("toxic")).first()
    if not total or positive in (0, total):
        rate = (positive or 0) / total if total else 0.5
        return np.zeros(0, np.int64), np.zeros(0), math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    share = min(1.0, max_labelled / total)
    shards = max(1, round(total * share / SHARD_ROWS))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # The bound makes this side small enough to broadcast: a number and a label per row.
    chosen = usable.filter(order < int(share * (1 << 30)))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("place"))

    def learn(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("place")
        raw, offsets = utf8(shard.column("text").combine_chunks())
        size = 1 << BITS
        rows = [np.append(features(raw[a:b].tobytes()), np.int32(size))
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        learner = Ftrl(size)
        for _ in range(EPOCHS):
            for at, label in zip(rows, shard.column("toxic").to_pylist(), strict=True):
                learner.learn(at, label)
        w = learner.weights(np.arange(size + 1))
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array(at), "weight": pa.array(w[at])})

    learnt = (sample.withColumn("shard", F.pmod(F.hash("place"), F.lit(shards))).groupBy("shard")
              .applyInArrow(learn, "place long, weight double")
              .groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toPandas())
    place, weight = learnt["place"].to_numpy(np.int64), learnt["weight"].to_numpy(np.float64)
    order = np.argsort(place)
    place, weight = place[order], weight[order]
    bias = float(weight[place == 1 << BITS].sum())
    body = place < 1 << BITS
    return place[body], weight[body], bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        place, weight, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[place] = weight
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            scores = [_sigmoid(bias + dense[features(raw[a:b].tobytes())].sum())
                      for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
