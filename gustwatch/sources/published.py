"""Published runs: results appear as a whole, once, under the name of the run that made them.

A run writes its files into a folder of its own attempt, is checked, and only
then named in the next version of the list of runs, a small file that is
created, never changed. Readers follow the latest list, so that a failed
attempt is never seen, and a run that is tried again after it was published
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts to name a run when others publish at the same time.
_TRIES = 20
RUN = "run"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark: SparkSession, path: str) -> list[str]:
    at, files = _file_system(spark, f"{path}/_versions")
    return sorted(f.getPath().toString() for f in files.listStatus(at)) if files.exists(at) else []


def published(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """``run`` and ``folder`` of all published runs, in the order of publishing."""
    known = _versions(spark, path)
    return json.loads(spark.read.text(known[-1], wholetext=True).first()[0]) if known else []


def _create(spark: SparkSession, file: str, text: str) -> bool:
    """Whether the file was created; False when it was there already."""
    at, files = _file_system(spark, file)
    try:
        out = files.create(at, False)
    except Exception as error:  # the class depends on the file system
        if files.exists(at):
            return False
        raise error
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def publish(
    df: DataFrame, path: str, run: str, mode: str = "append", check: Callable[[DataFrame], None] | None = None
) -> bool:
    """Publish ``df`` as ``run`` below ``path``; False when a run of that name is there already.

    ``check`` sees the written rows and raises to withhold them. With
    ``mode="overwrite"`` the run replaces all runs before it.
    """
    spark = df.sparkSession
    if any(r[RUN] == run for r in published(spark, path)):
        return False
    folder = f"runs/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    if check is not None:
        check(spark.read.parquet(f"{path}/{folder}"))
    for _ in range(_TRIES):
        count, known = len(_versions(spark, path)), published(spark, path)
        if any(r[RUN] == run for r in known):
            return False
        named = [*(known if mode == "append" else []), {RUN: run, "folder": folder}]
        if _create(spark, f"{path}/_versions/{count:012d}.json", json.dumps(named)):
            return True
    raise RuntimeError(f"others keep publishing to {path}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """All rows of published runs, with the union of their columns and the name of the ``run``."""
    runs = published(spark, path)
    if not runs:
        raise ValueError(f"nothing published at {path}")
    parts = [spark.read.parquet(f"{path}/{r['folder']}").withColumn(RUN, F.lit(r[RUN])) for r in runs]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows
