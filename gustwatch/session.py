"""Session helpers: checkpoint folder, written work tables, size checks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustwatch.settings import LIMITS, Limits


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, for the functions that run in Python there.

    Not needed where the package is installed on all nodes.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="gustwatch-")) / "gustwatch.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for file in sorted(root.rglob("*.py")):
                packed.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(application)
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gustwatch-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the checkpoint folder and read it back.

    Used where two branches must see the very same rows (run numbers from a
    range exchange) and to cut lineage. Survives executor loss, since the data
    lies in the shared folder. The folder is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/work-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """``df``, one row per asset or so, written first so that the planner knows its size.

    Joins then broadcast it when it is small and shuffle when it is not.
    """
    return materialize(df)


def fits(df: DataFrame, limits: Limits = LIMITS, key: str = "asset_id") -> bool:
    """Whether ``df`` may be broadcast for a range test per ``key``; counts no further than needed."""
    counted = df.limit(limits.broadcast_rows + 1).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    most, total = counted.agg(F.max("n"), F.sum("n")).first()
    return (total or 0) <= limits.broadcast_rows and (most or 0) <= limits.candidates_per_key


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into as many partitions as shuffles have, without coalescing.

    For Python work per group: it is heavy for few bytes, so partitions must
    not be merged by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def beside(spark: SparkSession, work: Callable[[], DataFrame]) -> Iterator[Callable[[], DataFrame]]:
    """``work`` in a thread of its own while the block runs; gives a function that waits for its result.

    For work of many short jobs, which leave the executors idle between them.
    Neither side may change the session's settings.
    """
    with ThreadPoolExecutor(1) as pool:
        yield pool.submit(inheritable_thread_target(spark)(work)).result


@contextmanager
def row_by_row(spark: SparkSession) -> Iterator[None]:
    """Jobs started within give Python one row a batch, for rows of some MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)
