"""A keyed Parquet table that the batches of a stream change, touched buckets only.

Rows are dealt to buckets by the hash of their key. A batch reads the buckets its keys fall in, combines old and new rows, and
writes those buckets below a folder of its own; a small manifest then says for every bucket which batch wrote it last. Buckets
that a batch does not touch keep their files. A batch that is retried reads the manifest of the batches before it
and overwrites its own folder, so it changes nothing the second time. Changes that come between two batches (``edit``) get
numbers between theirs.

A batch first deletes what the table before it does not name: batches before it are done and are not retried, so that table and
the new one are all that is kept. A table that was read is good until the batch after the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallypact.session import shuffles_dropped

#: Room for edits between two batches.
STEP = 1000
#: Columns by which both sides of a dealt merge are placed, and about how many places a table has.
PLACE = ["bucket", "share"]
PLACES = 512


class BatchTable:
    """``schema`` is the DDL text of a row; ``key`` names the columns whose hash gives the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``PLACE``: their bucket, and their key's share of it."""
        share = F.pmod(F.xxhash64(F.lit(1), *self.key), F.lit(max(1, PLACES // self.buckets))).cast("int")
        return rows.withColumns({"bucket": self._bucket(), "share": share})

    def _buckets_of(self, keys: DataFrame) -> set[int]:
        """Buckets that keys fall in; at most one row per bucket comes to the driver."""
        return {r["bucket"] for r in keys.select(self._bucket().alias("bucket")).distinct().collect()}

    def _folder(self, name: str):
        """A folder of the table and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of the changes that have a manifest."""
        root, fs = self._folder("manifest")
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root)]
        return [int(p.getName()) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _drop_superseded(self, number: int) -> None:
        """Delete what changes before ``number`` wrote and the last of them does not name."""
        named = {(n, f"bucket={b}") for b, n in self.files(number).items()}
        root, fs = self._folder("data")
        for change in fs.listStatus(root) if fs.exists(root) else []:
            at = int(change.getPath().getName())
            if at >= number:
                continue
            if all(n != at for n, _ in named):
                fs.delete(change.getPath(), True)
                continue
            for bucket in fs.listStatus(change.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("bucket=") and (at, name) not in named:
                    fs.delete(bucket.getPath(), True)

    def files(self, before: int | None = None) -> dict[int, int]:
        """Which change wrote each bucket last; at most one entry per bucket."""
        numbers = [n for n in self._numbers() if before is None or n < before]
        if not numbers:
            return {}
        rows = self.spark.read.schema("bucket int, number long").parquet(f"{self.path}/manifest/{max(numbers)}").collect()
        return {r["bucket"]: r["number"] for r in rows}

    def _read(self, at: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/{number}/bucket={bucket}" for bucket, number in sorted(at.items())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def rows(self) -> DataFrame:
        """The table as it is."""
        return self._read(self.files())

    def before(self, epoch: int, keys: DataFrame) -> DataFrame:
        """The rows of the buckets of ``keys`` as they were before batch ``epoch``."""
        touched = self._buckets_of(keys)
        return self._read({b: n for b, n in self.files((epoch + 1) * STEP).items() if b in touched})

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in ``keys``; buckets that none of them falls in are not read."""
        touched = self._buckets_of(keys)
        rows = self._read({b: n for b, n in self.files().items() if b in touched})
        return rows.join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def at(self, *values) -> DataFrame:
        """The rows of one key, given by its values: one bucket, whose row groups the filter prunes (rows are sorted by key)."""
        types = [StructType.fromDDL(self.schema)[c] for c in self.key]
        rows = self.of(self.spark.createDataFrame([values], StructType(types)))
        for name, value in zip(self.key, values, strict=True):
            rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
        return rows

    def _change(self, number: int, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame],
                dealt: bool = False) -> None:
        before = self.files(number)
        touched = self._buckets_of(batch)
        old = self._read({b: n for b, n in before.items() if b in touched})
        folder = f"{self.path}/data/{number}"
        names = old.columns
        if dealt:
            changed = combine(self._placed(old), self._placed(batch)).select(*names, "bucket")
        else:
            changed = combine(old, batch).select(*names).withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        with shuffles_dropped(self.spark):
            changed.sortWithinPartitions("bucket", *self.key).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        # A bucket that came out empty has no folder and no entry.
        kept = self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).select("bucket").distinct().collect()
        now = {b: n for b, n in before.items() if b not in touched} | {r["bucket"]: number for r in kept}
        (self.spark.createDataFrame(sorted(now.items()), "bucket int, number long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/manifest/{number}"))

    def merge(self, epoch: int, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame],
              dealt: bool = False) -> None:
        """Replace the rows of the buckets of ``batch`` by ``combine(old rows, batch)``, as batch ``epoch`` of a stream.

        ``batch`` has the key columns and is read twice, so it should be written out. ``combine`` gets all old rows
        of the touched buckets and returns all rows these are to hold. If ``dealt``, both have the columns of ``PLACE`` too,
        and ``combine`` returns ``bucket`` with rows that it has shuffled by them, so they are not shuffled again.
        """
        self._drop_superseded((epoch + 1) * STEP)
        self._change((epoch + 1) * STEP, batch, combine, dealt)

    def edit(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """The same between two batches, for changes that are not part of the stream."""
        self._change(max(self._numbers(), default=0) + 1, batch, combine)
