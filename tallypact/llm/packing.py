"""Sequence packing: vector bin packing with the dot-product heuristic.

Every document becomes token ids and an end id. Whole sequences are cut off at once; what is left of a document is
an item with three demands: tokens, one segment, and tokens that bear loss. A bin takes, again and again, the
fitting item whose demands have the largest weighted dot product with the room that is left. When nothing fits
whole, the best item is cut to fill the bin. A bin that cannot be filled (segment or loss limit, or the last one
of a task) is laid out as sequences of powers of two, which need no padding.

Packing happens inside the scan: a task keeps at most ``POOL`` items, nothing is shuffled, and only the last few
hundred tokens of a task make short sequences. Sequence ids hold the partition number, so a task that
is run again gives the same rows.

Defined results: a null or empty text is the end id alone; equal rows are packed as often as they come; a null
doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "segments int, loss_tokens long, ids binary")
END_ID = 0
POOL = 2048
END_OF_TEXT = "<|endoftext|>"


def encoder(path: str | None = None):
    """``text -> ids`` for a tokenizer file: ``.tiktoken`` ranks or a ``.json`` of tokenizers.

    The default is the rank file of the byte-level vocabulary ``byte_bpe_50k``; it gives the ids of
    ``byte_bpe_50k.json`` at a third of the time (tested). The end-of-text string is its special id in both.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={END_OF_TEXT: len(ranks)})
    return lambda text: (bpe.encode(text, allowed_special="all") if END_OF_TEXT in text
                         else bpe.encode_ordinary(text))


class Packer:
    """Pool of items of one task. ``emit`` gets (item, start, length, sequence, offset, segments, loss)."""

    def __init__(self, limits: tuple[int, int, int], emit, first_sequence: int):
        self.limits = np.array(limits, np.float64)
        self.emit, self.sequence = emit, first_sequence
        self.items: list = []
        self.demand = np.zeros((0, 3))

    def whole(self, item, start: int, length: int) -> None:
        self.emit(item, start, length, self.sequence, 0)
        self.sequence += 1

    def add(self, items: list) -> None:
        """``items``: (document, start, tokens, loss tokens)."""
        if items:
            self.items += items
            self.demand = np.concatenate([self.demand, np.array([[x[2], 1, x[3]] for x in items], np.float64)])

    def fill(self, last: bool = False) -> None:
        """Close bins while the pool can fill one; with ``last``, until the pool is empty."""
        alive = np.ones(len(self.items), bool)
        size = self.limits[0]
        left = self.demand[:, 0].sum()
        # The mean demand weighs a limit by how scarce it is.
        weight = self.demand.mean(0) / self.limits if len(self.items) else np.ones(3)
        weight = weight / self.limits
        while left >= size or last and left > 0:
            room, taken = self.limits.copy(), []
            while room[0] > 0 and room[1] > 0:
                score = self.demand @ (weight * room)
                score[~alive | (self.demand > room).any(1)] = -1
                k = int(score.argmax()) if len(score) else -1
                if k >= 0 and score[k] > 0:
                    doc, start, n, loss = self.items[k]
                    taken.append((doc, start, n))
                    room -= self.demand[k]
                    alive[k] = False
                    left -= n
                    continue
                # Nothing fits whole: cut the best item to what the bin still takes.
                score = self.demand @ (weight * room)
                score[~alive] = -1
                k = int(score.argmax()) if len(score) else -1
                if k < 0 or score[k] <= 0:
                    break
                doc, start, n, loss = self.items[k]
                free = n - loss  # tokens without loss come first
                cut = int(min(room[0], n, free + room[2]))
                if cut <= 0:
                    break
                taken.append((doc, start, cut))
                rest_loss = loss - max(0, cut - free)
                room -= (cut, 1, max(0, cut - free))
                left -= cut
                if cut == n:
                    alive[k] = False
                else:
                    self.items[k] = (doc, start + cut, n - cut, rest_loss)
                    self.demand[k] = (n - cut, 1, rest_loss)
            self._close(taken)
        self.items = [x for x, a in zip(self.items, alive, strict=True) if a]
        self.demand = self.demand[alive]

    def _close(self, taken: list) -> None:
        total = sum(x[2] for x in taken)
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        if total == int(self.limits[0]):
            sizes = [total]
        at = 0
        for doc, start, n in taken:
            while n:
                piece = min(n, sizes[0] - at)
                self.emit(doc, start, piece, self.sequence, at)
                at, start, n = at + piece, start + piece, n - piece
                if at == sizes[0]:
                    sizes.pop(0)
                    self.sequence += 1
                    at = 0


def pack(docs: DataFrame, tokenizer_path: str | None = None, max_tokens: int = 1024, max_segments: int = 64,
         max_loss_tokens: int = 1024, prompt: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece, with its ids as little-endian 32-bit numbers.

    ``prompt`` names a column of text that comes before ``text`` and bears no loss. Without one, every
    token of a document bears loss.
    """
    limits = (max_tokens, max_segments, max_loss_tokens)
    columns = ["doc_id", "text", *([prompt] if prompt else [])]

    def run(batches):
        encode = encoder(tokenizer_path)
        rows: list = []

        def emit(doc, start, length, sequence, offset):
            doc_id, ids, free = doc
            data = ids[start:start + length].tobytes()
            rows.append((doc_id, start, length, zlib.crc32(data), len(ids), sequence, offset, 1,
                         length - max(0, min(start + length, free) - start), data if with_ids else None))

        def flush():
            nonlocal rows
            done, rows = rows, []
            for a in range(0, len(done), 20_000):
                cols = list(zip(*done[a:a + 20_000], strict=True))
                kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 [x.split()[0] for x in SCHEMA.split(", ")])

        packer = Packer(limits, emit, TaskContext.get().partitionId() << 40)
        direct = max_loss_tokens >= max_tokens
        for batch in batches:
            for a in range(0, len(batch), POOL):
                items = []
                for row in batch.slice(a, POOL).to_pylist():
                    before = encode(row[prompt] or "") if prompt else []
                    ids = np.array([*before, *encode(row["text"] or ""), END_ID], "<u4")
                    doc, start, free = (row["doc_id"], ids, len(before)), 0, len(before)
                    while direct and len(ids) - start >= max_tokens:
                        packer.whole(doc, start, max_tokens)
                        start += max_tokens
                    while start < len(ids):
                        n = min(max_tokens, len(ids) - start)
                        items.append((doc, start, n, n - max(0, min(start + n, free) - start)))
                        start += n
                packer.add(items)
                packer.fill()
                yield from flush()
        packer.fill(last=True)
        yield from flush()

    return docs.select(*columns).mapInArrow(run, SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    """Pieces without their ids."""
    return pack(docs, with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
        F.col("loss_tokens"))
