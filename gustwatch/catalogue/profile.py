"""Queries: reading and writing, checks, column choice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gustwatch.catalogue.base import (
    SENSORS,
    event_info,
    micros,
    query,
    r6,
    scores,
    sql_with,
    table,
    telemetry,
)
from gustwatch.functions.expressions import rounded
from gustwatch.operators import quality, select
from gustwatch.operators.intervals import normalize_events
from gustwatch.operators.rolling import drop_all_null, fill_zero
from gustwatch.operators.scaling import scaler_stats
from gustwatch.session import checkpoint_root, materialize
from gustwatch.sources import tables

_ALL_SENSORS = [*SENSORS, "sensor_3_avg"]


def _scratch(spark) -> str:
    return f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}"


def _dropped(spark, name: str):
    """The rows of an external table that leaves the catalog; its files stay below the checkpoint folder."""
    rows = tables.read_table(spark, name)
    spark.sql(f"DROP TABLE {tables.quoted(name)}")
    return rows


_PER_ASSET = """SELECT asset_id, count(*) AS n, CAST(sum(sensor_0_avg) AS BIGINT) AS total,
  CAST(sum(status_type_id) AS BIGINT) AS statuses, max(id) AS last_id, max(epoch_us(time_stamp)) AS last_us
FROM telemetry GROUP BY asset_id"""


def _per_asset(df):
    return df.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("sensor_0_avg").cast("bigint").alias("total"),
        F.sum("status_type_id").alias("statuses"),
        F.max("id").alias("last_id"),
        F.max(micros()).alias("last_us"),
    )


@query("src_csv_roundtrip", sql_with("telemetry", _PER_ASSET))
def src_csv_roundtrip(spark, sf_dir):
    """Written as text files, read once with types and once as text; both readings must agree row by row."""
    schema = tables.telemetry_schema(_ALL_SENSORS)
    path = _scratch(spark)
    text_time = F.date_format("time_stamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_stamp")
    rows = telemetry(spark, sf_dir)
    tables.write_csv(rows.select(*[text_time if f == "time_stamp" else F.col(f) for f in schema.names]), path)
    typed = tables.read_csv(spark, path, schema)
    as_text = tables.read_csv_as_text(spark, path, schema)
    # Each reading contributes half of every sum.
    both = _per_asset(typed.unionByName(as_text))
    return both.select("asset_id", *[F.expr(f"cast({c} div 2 as bigint) as {c}") for c in ("n", "total", "statuses")], "last_id", "last_us")


@query("sink_overwrite", sql_with("telemetry", _PER_ASSET))
def sink_overwrite(spark, sf_dir):
    """A table written with few columns, overwritten with all: the new schema stays."""
    rows, name = telemetry(spark, sf_dir), f"gw_{uuid.uuid4().hex}"
    path = _scratch(spark)
    tables.write_table(rows.select("asset_id", "id"), name, path=path)
    tables.write_table(rows, name, path=path)
    return _per_asset(_dropped(spark, name))


@query("sink_partitioned", sql_with("telemetry", "SELECT status_type_id, count(*) AS n, max(id) AS last_id FROM telemetry GROUP BY 1"))
def sink_partitioned(spark, sf_dir):
    rows, name = telemetry(spark, sf_dir), f"gw_{uuid.uuid4().hex}"
    tables.write_table(rows, name, partition_by=["status_type_id"], path=_scratch(spark))
    stored = tables.read_table(spark, name)
    counted = materialize(stored.groupBy("status_type_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id")))
    # The partitions of a table are listed in the catalog until it has been read.
    spark.sql(f"DROP TABLE {tables.quoted(name)}")
    return counted


@query(
    "sink_append",
    sql_with(
        "telemetry",
        """SELECT train_test, count(*) AS n, CAST(count(CASE WHEN train_test = 'train' THEN k END) AS BIGINT) AS with_k,
  CAST(count(CASE WHEN train_test <> 'train' THEN sensor_1_avg END) AS BIGINT) AS with_sensor
FROM telemetry GROUP BY train_test""",
    ),
)
def sink_append(spark, sf_dir):
    """A table, then appended rows with a column less and a column more; both have nulls where they lack one."""
    rows, name = telemetry(spark, sf_dir), f"gw_{uuid.uuid4().hex}"
    tables.write_table(rows.filter("train_test = 'train'").drop("sensor_1_avg"), name, path=_scratch(spark))
    tables.write_table(rows.filter("train_test <> 'train'").drop("k"), name, mode="append")
    return _dropped(spark, name).groupBy("train_test").agg(
        F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.count("sensor_1_avg").alias("with_sensor")
    )


@query(
    "run_metrics",
    sql_with(
        "telemetry",
        f"""SELECT asset_id AS run, 'parent' AS parent, key, {r6('value')} AS value FROM (
  SELECT CAST(asset_id AS VARCHAR) AS asset_id, unnest(['n_rows', 'mean_value']) AS key, unnest([n, m]) AS value
  FROM (SELECT asset_id, CAST(count(*) AS DOUBLE) AS n, avg(sensor_0_avg) AS m FROM telemetry GROUP BY asset_id))""",
    ),
)
def run_metrics(spark, sf_dir):
    """Metrics of one child run per asset, appended to the run log and read back."""
    per_asset = telemetry(spark, sf_dir).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("sensor_0_avg").alias("mean_value")
    )
    path = _scratch(spark)
    tables.append_files(tables.metric_rows(per_asset, "asset_id", "parent", ["n_rows", "mean_value"]), path)
    tables.append_files(tables.run_rows(spark, "parent", {"source": "telemetry"}), path)
    stored = spark.read.schema(tables.RUN_SCHEMA).parquet(path).filter("kind = 'metric'")
    return stored.select("run", "parent", "key", rounded(F.col("value").cast("double")).alias("value"))


@query(
    "dq_null_counts",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM ({sql_with('telemetry scores', 'SELECT * FROM scores')})"
        for c in ("if_anomaly_score", "lstm_anomaly_score", "xgb_anomaly_prob", "ttf_hours")
    ),
)
def dq_null_counts(spark, sf_dir):
    columns = ["if_anomaly_score", "lstm_anomaly_score", "xgb_anomaly_prob", "ttf_hours"]
    return quality.null_counts(scores(spark, sf_dir), columns)


@query("dq_status_counts", sql_with("telemetry", "SELECT status_type_id, count(*) AS n FROM telemetry GROUP BY 1"))
def dq_status_counts(spark, sf_dir):
    return quality.value_counts(telemetry(spark, sf_dir), "status_type_id")


@query(
    "dq_split_pivot",
    sql_with(
        "telemetry",
        """SELECT status_type_id, count(*) FILTER (train_test = 'train') AS train,
  count(*) FILTER (train_test = 'prediction') AS prediction FROM telemetry GROUP BY 1""",
    ),
)
def dq_split_pivot(spark, sf_dir):
    return quality.pivot_counts(telemetry(spark, sf_dir), "status_type_id", "train_test", ["train", "prediction"])


@query(
    "dq_time_range",
    sql_with(
        "telemetry",
        """SELECT train_test, epoch_us(min(time_stamp)) AS first_us, epoch_us(max(time_stamp)) AS last_us, count(*) AS n
FROM telemetry GROUP BY 1""",
    ),
)
def dq_time_range(spark, sf_dir):
    ranges = quality.time_range(telemetry(spark, sf_dir), "train_test")
    return ranges.select("train_test", micros("first_time").alias("first_us"), micros("last_time").alias("last_us"), "n")


@query(
    "event_listing",
    sql_with(
        "event_info",
        """SELECT event_id, asset_id, event_label, epoch_us(event_start) AS start_us, epoch_us(event_end) AS end_us
FROM event_info WHERE event_label = 'anomaly'""",
    ),
)
def event_listing(spark, sf_dir):
    listed = event_info(spark, sf_dir).filter("event_label = 'anomaly'").orderBy("event_start", "event_id")
    return listed.select(
        "event_id", "asset_id", "event_label", micros("event_start").alias("start_us"), micros("event_end").alias("end_us")
    )


@query(
    "dq_key_counts",
    sql_with(
        "telemetry",
        """SELECT count(*) AS n_rows, count(DISTINCT (asset_id, time_stamp, id)) AS distinct_keys,
  count(DISTINCT asset_id) AS distinct_assets FROM (SELECT * FROM telemetry UNION ALL SELECT * FROM telemetry WHERE k > 49)""",
    ),
)
def dq_key_counts(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return quality.key_counts(rows.unionByName(rows.filter("k > 49")), ["asset_id", "time_stamp", "id"])


@query("dq_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "dq_describe",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM lineitem"
        for c in _LINE
    ),
)
def dq_describe(spark, sf_dir):
    stats = quality.describe(table(spark, sf_dir, "lineitem"), _LINE)
    return stats.select(
        "column_name", F.col("n").cast("bigint").alias("n"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max"
    )


@query(
    "events_normalized",
    """SELECT CAST(o_custkey AS BIGINT) AS asset_id, o_orderkey AS event_id, lower(trim(o_orderpriority)) AS event_label,
  TRY_CAST(o_orderpriority[1:1] AS BIGINT) AS event_start_id, TRY_CAST(o_orderstatus AS BIGINT) AS event_end_id FROM orders""",
)
def events_normalized(spark, sf_dir):
    """Orders as a rough event table: text bounds, mixed-case labels, and bounds that are no numbers."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("asset"),
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("event_label"),
        F.substring("o_orderpriority", 1, 1).alias("event_start_id"),
        F.col("o_orderstatus").alias("event_end_id"),
    )
    return normalize_events(raw)


@query(
    "cast_sensors",
    """SELECT event_id AS id, TRY_CAST(event_type AS DOUBLE) AS text_sensor,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS number_sensor, CAST(user_id AS DOUBLE) AS long_sensor FROM events""",
)
def cast_sensors(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("text_sensor"),
        F.regexp_extract("props", "[0-9]+", 0).alias("number_sensor"),
        F.col("user_id").alias("long_sensor"),
    )
    return select.cast_sensors(raw, ["text_sensor", "number_sensor", "long_sensor"])


_VARIANCES = "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(var_samp({c}), 0) AS variance FROM telemetry WHERE train_test = 'train' AND status_type_id = 0"
    for c in _ALL_SENSORS
)


def _normal_train(spark, sf_dir):
    return telemetry(spark, sf_dir).filter("train_test = 'train' and status_type_id = 0")


@query(
    "variance_filter",
    sql_with("telemetry", f"SELECT feature, {r6('variance')} AS variance FROM ({_VARIANCES}) WHERE variance >= 1e-10"),
)
def variance_filter(spark, sf_dir):
    kept = select.varying(_normal_train(spark, sf_dir), _ALL_SENSORS)
    return kept.withColumn("variance", rounded("variance"))


_LINE_VARIANCES = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM lineitem" for c in _LINE)


@query(
    "variance_topn",
    f"SELECT feature, round(variance, 4) AS variance FROM ({_LINE_VARIANCES}) ORDER BY variance DESC LIMIT 2",
)
def variance_topn(spark, sf_dir):
    top = select.most_varying(table(spark, sf_dir, "lineitem"), _LINE, 2)
    return top.select("feature", F.round("variance", 4).alias("variance"))


@query(
    "normal_train_union",
    sql_with(
        "telemetry",
        """SELECT id, train_test, status_type_id FROM telemetry WHERE train_test = 'train' AND status_type_id = 0
UNION ALL SELECT id, train_test, status_type_id FROM telemetry WHERE train_test = 'prediction'""",
    ),
)
def normal_train_union(spark, sf_dir):
    kept = select.normal_train_and_test(telemetry(spark, sf_dir), [0])
    return kept.select("id", "train_test", "status_type_id")


@query(
    "sensor_match",
    """SELECT p_name AS sensor_name, lower(p_type) LIKE '%brass%' AND lower(p_type) LIKE '%plated%' AS gearbox_oil,
  lower(p_type) LIKE '%active power%' AND lower(p_type) NOT LIKE '%reactive%' AS power,
  lower(p_type) LIKE '%wind speed%' AS wind,
  lower(p_brand) LIKE '%c%' AS temperature, lower(p_type) LIKE '%vibration%' OR lower(p_type) LIKE '%rpm%' AS vibration
FROM (SELECT p_name, p_brand, p_type FROM part)""",
)
def sensor_match(spark, sf_dir):
    """Parts as sensor metadata: the type is the description, with two of its words standing for two looked-for ones."""
    described = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("sensor_name"),
        F.regexp_replace(F.regexp_replace(F.lower("p_type"), "brass", "Gearbox"), "plated", "OIL").alias("description"),
        F.col("p_brand").alias("unit"),
    )
    roles = ["gearbox_oil", "power", "wind", "temperature", "vibration"]
    return select.sensor_roles(described).select("sensor_name", *roles)


@query(
    "interaction_terms",
    sql_with(
        "telemetry",
        f"SELECT id, {r6('sensor_0_avg * sensor_2_avg')} AS gearbox_oil_x_power, {r6('sensor_0_avg * sensor_1_avg')} AS gearbox_oil_x_wind FROM telemetry",
    ),
)
def interaction_terms(spark, sf_dir):
    roles = {"gearbox_oil": ["sensor_0_avg"], "power": ["sensor_2_avg"], "wind": ["sensor_1_avg"]}
    pairs = select.interaction_pairs(roles)
    multiplied = select.add_products(telemetry(spark, sf_dir), pairs)
    return multiplied.select("id", *[rounded(c).alias(c) for c in pairs])


@query(
    "fill_zero",
    sql_with(
        "telemetry scores",
        f"SELECT id, coalesce(ttf_hours, 0) AS ttf_hours, {r6('if_anomaly_score')} AS if_anomaly_score FROM scores",
    ),
)
def fill_zero_query(spark, sf_dir):
    """Null hours and a NaN score both become 0 (a score of NaN is made where hours are null and restored after)."""
    rows = scores(spark, sf_dir).withColumn("nan_hours", F.coalesce("ttf_hours", F.lit(float("nan"))))
    filled = fill_zero(rows, ["nan_hours"])
    return filled.select("id", F.col("nan_hours").alias("ttf_hours"), rounded("if_anomaly_score").alias("if_anomaly_score"))


@query(
    "drop_all_null",
    sql_with("telemetry scores", "SELECT id FROM (SELECT id, ttf_hours, CASE WHEN status_type_id = 4 THEN 1 END AS other FROM scores) WHERE NOT (ttf_hours IS NULL AND other IS NULL)"),
)
def drop_all_null_query(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("other", F.when(F.col("status_type_id") == 4, 1))
    return drop_all_null(rows, ["ttf_hours", "other"]).select("id")


@query(
    "scaler_stats",
    sql_with(
        "telemetry",
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS feature, {r6(f'avg({c})')} AS mean, {r6(f'stddev_pop({c})')} AS std FROM telemetry WHERE train_test = 'train' AND status_type_id = 0"
            for c in SENSORS
        ),
    ),
)
def scaler_stats_query(spark, sf_dir):
    stats = scaler_stats(_normal_train(spark, sf_dir), SENSORS)
    return stats.select("feature", rounded("mean").alias("mean"), rounded("std").alias("std"))
