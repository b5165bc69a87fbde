"""Session settings and the durable folder that lineage cuts and sinks write to."""

from __future__ import annotations

import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether a query's shuffle files go when it ends, not when the driver happens to collect garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "tallypact", cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", spread: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session.

    ``spread`` deals tables that are single files to so many tasks (``views.SPREAD``).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if spread:
        builder = builder.config("spark.tallypact.spread", str(spread))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``, else below the warehouse.

    Both can be reached by every executor.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/tallypact"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes made inside leave no shuffle files behind: what they wrote is read from then on, and each runs once."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the durable folder and read it back, so lost executors replay a file."""
    path = durable_dir(df.sparkSession, purpose)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``cut_lineage`` that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
