"""Sessions, lineage cuts and size-checked broadcasts shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side of a few longs that may still be broadcast (some 10 MB).
BROADCAST_ROWS = 1_000_000
#: Narrow rows for one task to write.
PART_ROWS = 100_000
#: Rows with a whole text sent to Python at once.
TEXT_ROWS = 1_000


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only in local mode, where none is named."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if where is None:
        where = "file://" + tempfile.mkdtemp(prefix="spark-quire-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    if value != before:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if spark.conf.get(key) != before:
            spark.conf.set(key, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs run inside send Python at most ``rows`` rows at once: a batch stands in the executor's memory and in the worker's."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with _setting(spark, key, before if rows is None or 0 < int(before) <= rows else str(rows)):
        yield


@contextmanager
def compiled_from(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs inside, of about ``rows`` rows, are compiled only from ``PART_ROWS`` on: of few rows that takes longer than the job, and the classes stay in the driver's memory."""
    key = "spark.sql.codegen.wholeStage"
    with _setting(spark, key, "false" if rows is not None and rows < PART_ROWS else spark.conf.get(key)):
        yield


def stored(df: DataFrame, rows: int | None = None, batch: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    ``rows``: about how many there are at most, if that is known; a table of few
    is then written by few tasks, however many partitions a shuffle has, and
    its plan isn't compiled.
    ``batch``: rows sent to Python at once, at most; for columns of whole texts.

    For intermediate results that several later jobs read: the files outlive
    lost executors, and Spark knows their size when it plans joins. The folder
    goes with ``dropped``, or when the session ends.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // PART_ROWS + 1)
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with batches_of(spark, batch), compiled_from(spark, rows):
        df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(*tables: DataFrame | None) -> None:
    """Delete the folders of stored tables that nothing will read again; tables of other kinds stay."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            place, files = _place(table.sparkSession, path)
            files.delete(place, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows, counted here.

    Beyond the bound it is returned as it is, and Spark shuffles both sides.
    Only for narrow tables that are cheap to count, such as stored ones.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
