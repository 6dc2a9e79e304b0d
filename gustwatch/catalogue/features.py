"""Queries: rolling features, status history, baselines and scaling."""

from __future__ import annotations

from gustwatch.catalogue.base import KINDS, SENSORS, hot_limits, query, r6, sql_with, telemetry
from gustwatch.functions.expressions import rounded
from gustwatch.operators.rolling import add_rolling
from gustwatch.operators.scaling import add_deviation, asset_baseline, scaler_stats, standard_scale
from gustwatch.operators.status import add_status_history


def _rolled(spark, sf_dir, sensors, kinds=None, **options):
    return add_rolling(telemetry(spark, sf_dir), sensors, kinds, **options)


def _show(df, columns):
    return df.select("id", *[rounded(c).alias(c) for c in columns])


def _means_sql(partition="asset_id", hot=False):
    def mean(rows):
        return r6(f"avg(sensor_0_avg) OVER (PARTITION BY {partition} ORDER BY time_stamp, id ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)")

    return sql_with(
        "telemetry",
        f"""SELECT id, {mean(6)} AS sensor_0_avg_roll_mean_1h, {mean(36)} AS sensor_0_avg_roll_mean_6h,
  {mean(144)} AS sensor_0_avg_roll_mean_24h FROM telemetry""",
        hot=hot,
    )


_MEANS = ["sensor_0_avg_roll_mean_1h", "sensor_0_avg_roll_mean_6h", "sensor_0_avg_roll_mean_24h"]


@query("rolling_means", _means_sql())
def rolling_means(spark, sf_dir):
    return _show(_rolled(spark, sf_dir, ["sensor_0_avg"]), _MEANS)


@query("rolling_means_hot_keys", _means_sql(hot=True))
def rolling_means_hot_keys(spark, sf_dir):
    """The same where one asset has a third of all rows and is cut into runs."""
    rows = telemetry(spark, sf_dir, hot=True)
    return _show(add_rolling(rows, ["sensor_0_avg"], limits=hot_limits(rows)), _MEANS)


@query("rolling_by_split", _means_sql("asset_id, train_test"))
def rolling_by_split(spark, sf_dir):
    return _show(_rolled(spark, sf_dir, ["sensor_0_avg"], by_split=True), _MEANS)


_W = "PARTITION BY asset_id ORDER BY time_stamp, id"


@query(
    "rolling_std",
    sql_with("telemetry", f"SELECT id, {r6(f'stddev_samp(sensor_0_avg) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS sensor_0_avg_roll_std_6 FROM telemetry"),
)
def rolling_std(spark, sf_dir):
    return _show(_rolled(spark, sf_dir, ["sensor_0_avg"]), ["sensor_0_avg_roll_std_6"])


@query(
    "step_delta",
    sql_with("telemetry", f"SELECT id, {r6(f'sensor_0_avg - lag(sensor_0_avg) OVER ({_W})')} AS sensor_0_avg_delta FROM telemetry"),
)
def step_delta(spark, sf_dir):
    return _show(_rolled(spark, sf_dir, ["sensor_0_avg"]), ["sensor_0_avg_delta"])


def _angle_mean(part: str, rows: int) -> str:
    return f"avg({part}(radians(sensor_1_avg))) OVER ({_W} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


_ANGLE_COLUMNS = ", ".join(
    f"{r6(f'degrees(atan2({_angle_mean('sin', n)}, {_angle_mean('cos', n)}))')} AS sensor_1_avg_roll_mean_{name}"
    for name, n in (("1h", 6), ("6h", 36), ("24h", 144))
)


@query("circular_mean", sql_with("telemetry", f"SELECT id, {_ANGLE_COLUMNS} FROM telemetry"))
def circular_mean_query(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, ["sensor_1_avg"], KINDS)
    return _show(rolled, [f"sensor_1_avg_roll_mean_{n}" for n in ("1h", "6h", "24h")])


# A single row has length 1 up to rounding; its spread is noise of the size of the square root of that, so it is shown to 4 places.
@query(
    "circular_std",
    sql_with(
        "telemetry",
        f"""SELECT id, round(CASE WHEN n < 2 THEN 0 WHEN r <= 1e-12 THEN 0
  ELSE degrees(sqrt(greatest(0, -2 * ln(greatest(1e-12, r))))) END, 4) + 0.0e0 AS sensor_1_avg_roll_std_6
FROM (SELECT id, sqrt(s * s + c * c) AS r, n FROM (SELECT id, {_angle_mean('sin', 6)} AS s, {_angle_mean('cos', 6)} AS c,
  count(*) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM telemetry))""",
    ),
)
def circular_std_query(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, ["sensor_1_avg"], KINDS)
    return rolled.select("id", rounded("sensor_1_avg_roll_std_6", 4).alias("sensor_1_avg_roll_std_6"))


@query(
    "angle_delta",
    sql_with(
        "telemetry",
        f"""SELECT id, {r6('CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END')} AS sensor_1_avg_delta
FROM (SELECT id, sensor_1_avg - lag(sensor_1_avg) OVER ({_W}) AS d FROM telemetry)""",
    ),
)
def angle_delta(spark, sf_dir):
    return _show(_rolled(spark, sf_dir, ["sensor_1_avg"], KINDS), ["sensor_1_avg_delta"])


@query(
    "counter_rate",
    sql_with(
        "telemetry",
        f"""SELECT id, {r6(f'avg(rate) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS sensor_2_avg_roll_mean_1h,
  {r6(f'stddev_samp(rate) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS sensor_2_avg_roll_std_6,
  {r6(f'rate - lag(rate) OVER ({_W})')} AS sensor_2_avg_delta
FROM (SELECT *, CASE WHEN d IS NULL OR d < 0 THEN 0 ELSE d END AS rate
  FROM (SELECT *, sensor_2_avg - lag(sensor_2_avg) OVER ({_W}) AS d FROM telemetry))""",
    ),
)
def counter_rate(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, ["sensor_2_avg"], KINDS)
    return _show(rolled, ["sensor_2_avg_roll_mean_1h", "sensor_2_avg_roll_std_6", "sensor_2_avg_delta"])


def _share(status: int, seconds: int) -> str:
    return r6(
        f"avg(CASE WHEN status_type_id = {status} THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY asset_id ORDER BY sec RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"
    )


_RANGES = (("24h", 86400), ("7d", 604800), ("30d", 2592000))
_SHARES = ", ".join(
    f"{_share(status, seconds)} AS {kind}_frac_{name}"
    for kind, status in (("downtime", 4), ("derated", 1))
    for name, seconds in _RANGES
)
_SHARE_NAMES = [f"{kind}_frac_{name}" for kind in ("downtime", "derated") for name, _ in _RANGES]


@query("status_fractions", sql_with("telemetry", f"SELECT id, {_SHARES} FROM telemetry"))
def status_fractions(spark, sf_dir):
    return _show(add_status_history(telemetry(spark, sf_dir)), _SHARE_NAMES)


@query("status_fractions_hot_keys", sql_with("telemetry", f"SELECT id, {_SHARES} FROM telemetry", hot=True))
def status_fractions_hot_keys(spark, sf_dir):
    """The same where one asset has a third of all rows, from running totals."""
    rows = telemetry(spark, sf_dir, hot=True)
    return _show(add_status_history(rows, limits=hot_limits(rows)), _SHARE_NAMES)


@query(
    "status_changes",
    sql_with(
        "telemetry",
        f"""SELECT id, sum(changed) OVER (PARTITION BY asset_id ORDER BY sec RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS status_change_count_7d,
  sum(changed) OVER (PARTITION BY asset_id ORDER BY sec RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS status_change_count_30d
FROM (SELECT *, CASE WHEN status_type_id <> lag(status_type_id) OVER ({_W}) THEN 1.0e0 ELSE 0.0e0 END AS changed FROM telemetry)""",
    ),
)
def status_changes(spark, sf_dir):
    history = add_status_history(telemetry(spark, sf_dir))
    return history.select("id", "status_change_count_7d", "status_change_count_30d")


@query(
    "hours_since_downtime",
    sql_with(
        "telemetry",
        f"""SELECT id, {r6(f'(sec - max(CASE WHEN status_type_id = 4 THEN sec END) OVER ({_W} ROWS UNBOUNDED PRECEDING)) / 3600.0e0')} AS hours_since_last_downtime
FROM telemetry""",
    ),
)
def hours_since_downtime(spark, sf_dir):
    return _show(add_status_history(telemetry(spark, sf_dir)), ["hours_since_last_downtime"])


_NORMAL_TRAIN = "train_test = 'train' AND status_type_id = 0"


@query(
    "baseline_deviation",
    sql_with(
        "telemetry",
        f"""SELECT t.id, {r6('t.sensor_0_avg - b.m0')} AS sensor_0_avg_deviation, {r6('t.sensor_2_avg - b.m2')} AS sensor_2_avg_deviation
FROM telemetry t LEFT JOIN (SELECT asset_id, avg(sensor_0_avg) AS m0, avg(sensor_2_avg) AS m2 FROM telemetry WHERE {_NORMAL_TRAIN} GROUP BY 1) b
  ON t.asset_id = b.asset_id""",
    ),
)
def baseline_deviation(spark, sf_dir):
    rows, sensors = telemetry(spark, sf_dir), ["sensor_0_avg", "sensor_2_avg"]
    baseline = asset_baseline(rows.filter(_NORMAL_TRAIN), sensors)
    return _show(add_deviation(rows, baseline, sensors), [f"{s}_deviation" for s in sensors])


_STATS = ", ".join(
    f"coalesce(avg({c}), 0) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in [*SENSORS, "sensor_3_avg"]
)


@query(
    "standard_scale",
    sql_with(
        "telemetry",
        "SELECT t.id, "
        + ", ".join(f"{r6(f'(t.{c} - m_{c}) / s_{c}')} AS {c}" for c in [*SENSORS, "sensor_3_avg"])
        + f" FROM telemetry t, (SELECT {_STATS} FROM telemetry WHERE {_NORMAL_TRAIN})",
    ),
)
def standard_scale_query(spark, sf_dir):
    rows, columns = telemetry(spark, sf_dir), [*SENSORS, "sensor_3_avg"]
    scaled = standard_scale(rows, scaler_stats(rows.filter(_NORMAL_TRAIN), columns))
    return _show(scaled, columns)
