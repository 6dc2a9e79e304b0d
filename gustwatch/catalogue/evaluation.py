"""Queries: scores and alerts against event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustwatch.catalogue.base import SENSORS, event_info, query, r6, scores, sql_with, telemetry
from gustwatch.catalogue.decisions import ALERT_CTES, alert_rows
from gustwatch.catalogue.events import _NEXT_STOP, _STOPS
from gustwatch.functions.expressions import probability_tier, rounded
from gustwatch.operators import evaluate, intervals, labels

_LS = "telemetry event_info scores labelled"
_TAGGED = "telemetry event_info scores tagged"


def _tagged(spark, sf_dir):
    """Every score row with every event whose window holds it."""
    return intervals.event_rows(scores(spark, sf_dir), event_info(spark, sf_dir))


def _round(df, keep, columns):
    return df.select(*keep, *[rounded(c).alias(c) for c in columns])


@query(
    "score_by_label",
    sql_with(_TAGGED, f"SELECT event_label, {r6('avg(xgb_anomaly_prob)')} AS mean_score, {r6('stddev_samp(xgb_anomaly_prob)')} AS std_score, count(*) AS n FROM tagged GROUP BY 1"),
)
def score_by_label(spark, sf_dir):
    return _round(evaluate.score_by(_tagged(spark, sf_dir), "xgb_anomaly_prob", "event_label"), ["event_label", "n"], ["mean_score", "std_score"])


@query(
    "score_by_fault",
    sql_with(_TAGGED, f"SELECT event_description, {r6('avg(if_anomaly_score)')} AS mean_score, {r6('stddev_samp(if_anomaly_score)')} AS std_score, count(*) AS n FROM tagged WHERE event_label = 'anomaly' GROUP BY 1"),
)
def score_by_fault(spark, sf_dir):
    anomalies = _tagged(spark, sf_dir).filter("event_label = 'anomaly'")
    by_fault = evaluate.score_by(anomalies, "if_anomaly_score", "event_description")
    return _round(by_fault.orderBy(F.desc("mean_score")), ["event_description", "n"], ["mean_score", "std_score"])


_SCORES = ["if_anomaly_score", "lstm_anomaly_score", "xgb_anomaly_prob"]


@query(
    "score_separation",
    sql_with(
        _TAGGED,
        "SELECT score, {}, {}, {}, CASE WHEN a - n > 0 THEN 'OK' ELSE 'WRONG' END AS direction FROM ({})".format(
            f"{r6('n')} AS normal_mean",
            f"{r6('a')} AS anomaly_mean",
            f"{r6('a - n')} AS separation",
            " UNION ALL ".join(
                f"SELECT '{s}' AS score, avg({s}) FILTER (event_label = 'anomaly') AS a, avg({s}) FILTER (event_label = 'normal') AS n FROM tagged"
                for s in _SCORES
            ),
        ),
    ),
)
def score_separation(spark, sf_dir):
    compared = evaluate.separation(_tagged(spark, sf_dir), _SCORES)
    return _round(compared, ["score", "direction"], ["normal_mean", "anomaly_mean", "separation"])


_FEATURES = [*SENSORS, "sensor_3_avg"]
_MEMBER = "t.asset_id = e.asset_id AND t.id BETWEEN e.event_start_id AND e.event_end_id"
_TAGGED_ROWS = f"tagged_rows AS (SELECT t.*, e.event_label FROM telemetry t JOIN event_info e ON {_MEMBER})"
_PRE = "pre_rows AS (SELECT t.* FROM telemetry t JOIN next_stop s ON t.id = s.id WHERE t.status_type_id = 0 AND s.hours > 0 AND s.hours <= 168)"


@query(
    "feature_separation",
    sql_with(
        "telemetry event_info",
        "SELECT feature, {}, {}, {}, {}, {} FROM ({})".format(
            f"{r6('a')} AS anomaly_window_mean",
            f"{r6('n')} AS normal_window_mean",
            f"{r6('p')} AS pre_transition_mean",
            f"{r6('a - n')} AS separation_anomaly_minus_normal",
            f"{r6('p - n')} AS separation_pre_minus_normal",
            " UNION ALL ".join(
                f"SELECT '{c}' AS feature, avg({c}) FILTER (event_label = 'anomaly') AS a, avg({c}) FILTER (event_label = 'normal') AS n, (SELECT avg({c}) FROM pre_rows) AS p FROM tagged_rows"
                for c in _FEATURES
            ),
        ),
        _TAGGED_ROWS,
        _STOPS,
        _NEXT_STOP,
        _PRE,
    ),
)
def feature_separation(spark, sf_dir):
    rows, events = telemetry(spark, sf_dir), event_info(spark, sf_dir)
    horizon = labels.add_downtime_horizon(labels.add_event_horizon(rows, events), events, rows, [4])
    tagged = intervals.event_rows(rows, events)
    names = [
        "anomaly_window_mean",
        "normal_window_mean",
        "pre_transition_mean",
        "separation_anomaly_minus_normal",
        "separation_pre_minus_normal",
    ]
    return _round(evaluate.feature_separation(tagged, horizon, _FEATURES), ["feature"], names)


@query(
    "feature_separation_topn",
    sql_with(
        "telemetry event_info",
        "SELECT feature, {}, {}, {} FROM ({}) ORDER BY a - n DESC, feature LIMIT 3".format(
            f"{r6('a')} AS anomaly_mean",
            f"{r6('n')} AS normal_mean",
            f"{r6('a - n')} AS separation_score",
            " UNION ALL ".join(
                f"SELECT '{c}' AS feature, avg(trunc({c})) FILTER (event_label = 'anomaly') AS a, avg(trunc({c})) FILTER (event_label = 'normal') AS n FROM tagged_rows"
                for c in _FEATURES
            ),
        ),
        _TAGGED_ROWS,
    ),
)
def feature_separation_topn(spark, sf_dir):
    tagged = intervals.event_rows(telemetry(spark, sf_dir), event_info(spark, sf_dir))
    top = evaluate.top_separating(tagged, _FEATURES, n=3, as_integer=True)
    return _round(top, ["feature"], ["anomaly_mean", "normal_mean", "separation_score"])


_COVERAGE = """coverage AS (SELECT e.event_id, e.asset_id, e.event_label, e.event_description AS fault_type, count(*) AS window_rows,
    CAST(sum(a.alert_triggered) AS BIGINT) AS alerts_triggered,
    CASE WHEN e.event_label = 'anomaly' THEN sum(a.alert_triggered) / count(*)::DOUBLE END AS coverage,
    CASE WHEN e.event_label = 'anomaly' THEN (max(a.sec) - min(CASE WHEN a.alert_triggered = 1 THEN a.sec END)) / 3600.0e0 END AS earliness_h
  FROM alerts a JOIN event_info e ON a.asset_id = e.asset_id AND a.id BETWEEN e.event_start_id AND e.event_end_id GROUP BY 1, 2, 3, 4)"""


@query(
    "event_coverage",
    sql_with(
        _LS,
        f"SELECT event_id, asset_id, event_label, fault_type, window_rows, alerts_triggered, {r6('coverage')} AS coverage, {r6('earliness_h')} AS earliness_h FROM coverage",
        *ALERT_CTES,
        _COVERAGE,
    ),
)
def event_coverage(spark, sf_dir):
    covered = evaluate.event_coverage(alert_rows(spark, sf_dir), event_info(spark, sf_dir))
    return _round(covered, ["event_id", "asset_id", "event_label", "fault_type", "window_rows", "alerts_triggered"], ["coverage", "earliness_h"])


@query(
    "reliability",
    sql_with(
        _LS,
        f"""SELECT count(*) AS normal_rows, {r6('1 - sum(a.alert_triggered) / count(*)::DOUBLE')} AS reliability
FROM alerts a JOIN event_info e ON a.asset_id = e.asset_id AND a.id BETWEEN e.event_start_id AND e.event_end_id WHERE e.event_label = 'normal'""",
        *ALERT_CTES,
    ),
)
def reliability(spark, sf_dir):
    covered = evaluate.event_coverage(alert_rows(spark, sf_dir), event_info(spark, sf_dir))
    return _round(evaluate.reliability(covered), ["normal_rows"], ["reliability"])


@query(
    "coverage_by_fault",
    sql_with(
        _LS,
        f"""SELECT fault_type, {r6('avg(coverage)')} AS mean_coverage, {r6('avg(earliness_h)')} AS mean_earliness_h, count(*) AS events FROM (
  SELECT * FROM coverage WHERE event_label = 'anomaly' UNION ALL SELECT * REPLACE ('(all)' AS fault_type) FROM coverage WHERE event_label = 'anomaly') GROUP BY 1""",
        *ALERT_CTES,
        _COVERAGE,
    ),
)
def coverage_by_fault(spark, sf_dir):
    covered = evaluate.event_coverage(alert_rows(spark, sf_dir), event_info(spark, sf_dir))
    return _round(evaluate.coverage_by_fault(covered), ["fault_type", "events"], ["mean_coverage", "mean_earliness_h"])


@query(
    "fault_detection",
    sql_with(
        _TAGGED,
        f"""SELECT event_description, {r6('avg(flag)')} AS detection_rate, CAST(sum(flag) AS BIGINT) AS flagged, count(*) AS n
FROM (SELECT *, CASE WHEN xgb_anomaly_prob > 0.6 THEN 1 ELSE 0 END AS flag FROM tagged WHERE event_label = 'anomaly') GROUP BY 1""",
    ),
)
def fault_detection(spark, sf_dir):
    flagged = _tagged(spark, sf_dir).withColumn("flag", (F.col("xgb_anomaly_prob") > 0.6).cast("int"))
    return _round(evaluate.fault_detection(flagged, "flag"), ["event_description", "flagged", "n"], ["detection_rate"])


@query(
    "tier_in_window",
    sql_with(
        _TAGGED,
        """SELECT event_label, CASE WHEN xgb_anomaly_prob <= 0.3 THEN 'low' WHEN xgb_anomaly_prob <= 0.6 THEN 'medium'
  WHEN xgb_anomaly_prob <= 0.9 THEN 'high' ELSE 'critical' END AS tier, count(*) AS n FROM tagged GROUP BY 1, 2""",
    ),
)
def tier_in_window(spark, sf_dir):
    tiers = _tagged(spark, sf_dir).select("event_label", probability_tier("xgb_anomaly_prob").alias("tier"))
    return tiers.groupBy("event_label", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flag_rate_by_asset",
    sql_with(
        "telemetry scores",
        f"""SELECT asset_id, CAST(sum(flag) AS BIGINT) AS flagged, {r6('avg(flag)')} AS flag_rate, {r6('avg(xgb_anomaly_prob)')} AS mean_score
FROM (SELECT *, CASE WHEN xgb_anomaly_prob > 0.6 THEN 1 ELSE 0 END AS flag FROM scores) GROUP BY 1""",
    ),
)
def flag_rate_by_asset(spark, sf_dir):
    flagged = scores(spark, sf_dir).withColumn("flag", (F.col("xgb_anomaly_prob") > 0.6).cast("int"))
    return _round(evaluate.flag_rate(flagged, "flag", "xgb_anomaly_prob"), ["asset_id", "flagged"], ["flag_rate", "mean_score"])


@query(
    "fold_rmse",
    sql_with(
        "telemetry scores",
        f"""SELECT fold, n, {r6('rmse')} AS rmse, {r6('avg(rmse) OVER ()')} AS rmse_mean, {r6('stddev_pop(rmse) OVER ()')} AS rmse_std FROM (
  SELECT xgb_fault_type AS fold, count(*) AS n, sqrt(avg((ttf_hours - 100 * xgb_anomaly_prob) * (ttf_hours - 100 * xgb_anomaly_prob))) AS rmse
  FROM scores WHERE ttf_hours IS NOT NULL GROUP BY 1)""",
    ),
)
def fold_rmse(spark, sf_dir):
    """Error of a fixed predictor per fold with mean and population deviation over the folds."""
    predicted = scores(spark, sf_dir).filter("ttf_hours is not null").withColumn("prediction", F.col("xgb_anomaly_prob") * 100)
    folds = evaluate.fold_rmse(predicted, "xgb_fault_type", "ttf_hours", "prediction")
    summary = evaluate.rmse_summary(folds).first()
    return folds.select(
        F.col("xgb_fault_type").alias("fold"),
        "n",
        rounded("rmse").alias("rmse"),
        rounded(F.lit(summary["rmse_mean"])).alias("rmse_mean"),
        rounded(F.lit(summary["rmse_std"])).alias("rmse_std"),
    )
