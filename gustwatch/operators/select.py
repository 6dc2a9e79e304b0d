"""Choosing, casting and combining sensor columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustwatch.functions.expressions import text_to_bigint, text_to_double
from gustwatch.settings import META_COLUMNS, MIN_VARIANCE

# Statistics columns of a sensor that are not features, and label columns.
IGNORED_SUFFIXES = ("_max", "_min", "_std")
LABEL_COLUMNS = (
    "next_anomaly_event_id",
    "hours_to_next_anomaly",
    "risk_score",
    "is_usable_supervised_next",
    "hours_to_anomaly_linked_downtime",
    "risk_score_anomaly_linked_downtime",
    "hours_to_next_operator_warning",
    "risk_score_operator_warning",
    "in_anomaly_window",
    "if_fit_eligible",
)


def sensor_columns(columns: Sequence[str], meta: Sequence[str] = META_COLUMNS) -> list[str]:
    """Sensor columns: neither metadata nor maximum, minimum or deviation columns; sorted."""
    return sorted(c for c in columns if c not in meta and not c.endswith(IGNORED_SUFFIXES))


def feature_columns(columns: Sequence[str], excluded: Sequence[str] = ()) -> list[str]:
    """Model inputs: everything but keys, metadata and labels."""
    hidden = {*META_COLUMNS, *LABEL_COLUMNS, *excluded}
    return [c for c in columns if c not in hidden]


def cast_sensors(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """All sensors as double in one projection; unreadable text becomes null."""
    types = dict(df.dtypes)

    def cast(name: str) -> Column:
        column = F.col(name)
        if types[name] == "string":
            return text_to_double(column).alias(name)
        return column if types[name] == "double" else column.cast("double").alias(name)

    return df.select(*[cast(c) if c in sensors else F.col(c) for c in df.columns])


def cast_meta(df: DataFrame) -> DataFrame:
    """Key and status columns that were read as text in their proper types."""
    proper = {
        "asset_id": text_to_bigint("asset_id"),
        "id": text_to_bigint("id"),
        "status_type_id": text_to_bigint("status_type_id").cast("int"),
        "time_stamp": F.try_to_timestamp("time_stamp"),
    }
    types = dict(df.dtypes)
    return df.withColumns({c: v for c, v in proper.items() if types.get(c) == "string"})


def variances(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Rows ``(feature, variance)`` from one aggregate; a missing variance counts 0."""
    one = df.agg(*[F.coalesce(F.var_samp(c), F.lit(0.0)).alias(c) for c in sensors])
    return one.unpivot([], list(sensors), "feature", "variance")


def varying(df: DataFrame, sensors: Sequence[str], floor: float = MIN_VARIANCE) -> DataFrame:
    """Sensors that vary at all, most varying first."""
    kept = variances(df, sensors).filter(F.col("variance") >= floor)
    return kept.orderBy(F.desc("variance"), "feature")


def most_varying(df: DataFrame, sensors: Sequence[str], n: int) -> DataFrame:
    return varying(df, sensors).limit(n)


def pick_sensors(df: DataFrame, sensors: Sequence[str], n: int | None = None) -> list[str]:
    """Names of the varying sensors, at most ``n``; one small row per sensor reaches the driver."""
    ranked = varying(df, sensors) if n is None else most_varying(df, sensors, n)
    return [r.feature for r in ranked.collect()]


def normal_train_and_test(df: DataFrame, normal_status: Sequence[int], test_split: str = "prediction") -> DataFrame:
    """Normal rows of the train split and all rows of the test split, in one pass."""
    train = (F.col("train_test") == "train") & F.col("status_type_id").isin(*normal_status)
    return df.filter(train | (F.col("train_test") == test_split))


# Texts that identify a sensor's role in its description.
ROLE_TEXTS = {
    "gearbox_oil": (("gearbox", "oil"), ()),
    "power": (("active power",), ("reactive",)),
    "wind": (("wind speed",), ()),
}
AMBIENT = "ambient"
# Sensors that have a role when no description names one.
FALLBACK_SENSORS = {
    "gearbox_oil": ("sensor_12",),
    "power": ("sensor_29", "sensor_30"),
    "wind": ("sensor_3", "sensor_4"),
}


def _says(*texts: str) -> Column:
    found = F.lit(True)
    for text in texts:
        found &= F.coalesce(F.lower("description").contains(text), F.lit(False))
    return found


def sensor_roles(descriptions: DataFrame) -> DataFrame:
    """Metadata rows with the roles ``temperature``, ``vibration``, ``gearbox_oil``, ``power``, ``wind``."""
    roles = {
        name: _says(*wanted) & (~_says(*unwanted) if unwanted else F.lit(True))
        for name, (wanted, unwanted) in ROLE_TEXTS.items()
    }
    celsius = F.coalesce(F.lower("unit").contains("c"), F.lit(False))
    roles["temperature"] = (_says("temp") | celsius) & ~_says(AMBIENT)
    roles["vibration"] = _says("vibration") | _says("rpm")
    return descriptions.select("*", *[condition.alias(name) for name, condition in roles.items()])


def resolve(sensor: str, columns: Sequence[str]) -> str | None:
    """Column of a sensor: its bare name or its average."""
    return next((c for c in (sensor, f"{sensor}_avg") if c in columns), None)


def sensors_by_role(descriptions: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns per role, by the number in the sensor's name, then the name; the metadata table has one row per sensor.

    Roles of :data:`FALLBACK_SENSORS` that no description names get their first fallback among ``columns``.
    """
    names = ["gearbox_oil", "power", "wind", "temperature", "vibration"]
    found: dict[str, list[str]] = {name: [] for name in names}
    number = F.regexp_extract("sensor_name", r"(\d+)", 1).try_cast("bigint")
    for row in sensor_roles(descriptions).orderBy(number, "sensor_name").collect():
        column = resolve(row.sensor_name, columns)
        for name in names:
            if column and row[name]:
                found[name].append(column)
    for name, sensors in FALLBACK_SENSORS.items():
        if not found[name]:
            found[name] = [c for c in (resolve(s, columns) for s in sensors) if c][:1]
    return found


def sensor_kinds(descriptions: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Kind (counter, angle) per column; flags may be booleans or text."""
    kinds = {}
    counter, angle = (F.col(c).cast("string").try_cast("boolean") for c in ("is_counter", "is_angle"))
    kind = F.when(counter, "counter").when(angle, "angle")
    for row in descriptions.select("sensor_name", kind.alias("kind")).filter("kind is not null").collect():
        column = resolve(row.sensor_name, columns)
        if column:
            kinds[column] = row.kind
    return kinds


def add_products(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Interaction terms: one product column per entry."""
    return df.select(
        "*", *[(F.col(a).cast("double") * F.col(b).cast("double")).alias(n) for n, (a, b) in pairs.items()]
    )


def interaction_pairs(roles: Mapping[str, list[str]], which: str = "gearbox") -> dict[str, tuple[str, str]]:
    """Pairs to multiply: ``gearbox`` oil by power and wind, or temperature by ``vibration``, as the farm's settings say."""
    def first(name):
        return roles[name][0] if roles.get(name) else None

    if which not in ("gearbox", "vibration"):
        raise ValueError(f"no set of interactions called {which}")
    pairs = {}
    if which == "gearbox":
        for name, other in (("gearbox_oil_x_power", "power"), ("gearbox_oil_x_wind", "wind")):
            if first("gearbox_oil") and first(other):
                pairs[name] = (first("gearbox_oil"), first(other))
    elif first("temperature") and first("vibration"):
        pairs["oil_x_vib"] = (first("temperature"), first("vibration"))
        pairs["temp_x_rpm"] = (first("temperature"), roles["vibration"][:2][-1])
    return pairs
