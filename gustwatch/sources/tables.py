"""Reading farm files and catalog tables, writing result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustwatch.session import sized

#: Rows of one table partition that one task writes.
ROWS_PER_WRITER = 5_000_000

DELIMITER = ";"

_TELEMETRY = (
    ("asset_id", T.LongType()),
    ("time_stamp", T.TimestampType()),
    ("id", T.LongType()),
    ("train_test", T.StringType()),
    ("status_type_id", T.IntegerType()),
)
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("asset_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("event_label", T.StringType()),
        T.StructField("event_start", T.TimestampType()),
        T.StructField("event_start_id", T.LongType()),
        T.StructField("event_end", T.TimestampType()),
        T.StructField("event_end_id", T.LongType()),
        T.StructField("event_description", T.StringType()),
    ]
)
DESCRIPTION_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("sensor_name", "description", "unit", "is_angle", "is_counter")]
)


def telemetry_schema(sensors: Sequence[str]) -> T.StructType:
    fields = [T.StructField(n, t) for n, t in _TELEMETRY]
    return T.StructType(fields + [T.StructField(s, T.DoubleType()) for s in sensors])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Directory of ``;`` files with header; the schema is given, so no pass is spent on inferring it."""
    return spark.read.schema(schema).option("header", True).option("sep", DELIMITER).csv(path)


def read_csv_as_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same files with every column as text, then cast; unreadable text becomes null."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = read_csv(spark, path, text)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", DELIMITER).csv(path)


def quoted(*parts: str) -> str:
    """Catalog name whose parts may hold hyphens."""
    return ".".join(f"`{p}`" for p in parts)


def read_table(spark: SparkSession, *name: str) -> DataFrame:
    return spark.table(quoted(*name))


def optional_table(spark: SparkSession, *name: str) -> DataFrame | None:
    """The table, or None when the catalog does not have it."""
    return read_table(spark, *name) if spark.catalog.tableExists(quoted(*name)) else None


def table_format(spark: SparkSession) -> str:
    """Delta where the session is set up for it, else Parquet."""
    return "delta" if "io.delta" in (spark.conf.get("spark.sql.extensions", "") or "") else "parquet"


def _gathered(df: DataFrame, partition_by: Sequence[str], rows_per_writer: int) -> DataFrame:
    counted = df.groupBy(*[F.col(c).alias(f"_p_{c}") for c in partition_by]).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_writer)).alias("_writers")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in partition_by]
    salted = df.join(sized(counted), reduce(and_, same)).withColumn(
        "_salt", F.pmod(F.xxhash64(*df.columns), F.col("_writers"))
    )
    return salted.repartition(*partition_by, "_salt").select(*df.columns)


def _merged_into(df: DataFrame, *name: str) -> DataFrame:
    """``df`` with the columns of the table, after the table got the new columns of ``df``."""
    spark = df.sparkSession
    known = spark.table(quoted(*name)).schema
    new = [f for f in df.schema.fields if f.name not in known.names]
    if new:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {quoted(*name)} ADD COLUMNS ({columns})")
    wanted = spark.table(quoted(*name)).schema
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ]
    )


def write_table(
    df: DataFrame,
    *name: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    path: str | None = None,
    rows_per_writer: int = ROWS_PER_WRITER,
) -> None:
    """Save as catalog table. Overwriting replaces the schema, appending merges it.

    Rows are gathered by the partition columns first, so that a partition gets
    few files: one task per ``rows_per_writer`` rows that a count finds in it,
    so that a large partition is written by many tasks and a small one by one.
    Appended rows meet the table by column name: columns the rows lack become
    nulls, columns the table lacks are added to it.
    """
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(quoted(*name)):
        df = _merged_into(df, *name)
    if partition_by:
        df = _gathered(df, partition_by, rows_per_writer)
    writer = df.write.format(table_format(spark)).mode(mode)
    if mode == "overwrite":
        writer = writer.option("overwriteSchema", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(quoted(*name))


def append_files(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Files written by several appends, with the union of their columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


RUN_SCHEMA = "run string, parent string, kind string, key string, value string"


def run_rows(
    spark: SparkSession,
    run: str,
    params: Mapping[str, object] | None = None,
    metrics: Mapping[str, float] | None = None,
    parent: str | None = None,
) -> DataFrame:
    """Parameters and metrics of one run as rows of the run log; child runs name their parent."""
    rows = [(run, parent, "param", k, str(v)) for k, v in (params or {}).items()]
    rows += [(run, parent, "metric", k, repr(float(v))) for k, v in (metrics or {}).items()]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def metric_rows(table: DataFrame, run: str, parent: str | None, keys: Sequence[str]) -> DataFrame:
    """Run-log rows from a table of results, one child run per row of ``run`` values."""
    wide = table.select(F.col(run).cast("string").alias("run"), *[F.col(k).cast("double").alias(k) for k in keys])
    long = wide.unpivot("run", list(keys), "key", "value")
    return long.select(
        "run",
        F.lit(parent).cast("string").alias("parent"),
        F.lit("metric").alias("kind"),
        "key",
        F.col("value").cast("string").alias("value"),
    )
