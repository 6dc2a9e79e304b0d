"""Settings shared by the operators.

``Limits`` bounds what one task or one broadcast may hold. ``FarmSettings``
holds what differs between farms; there is no code per farm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

KEY = ("asset_id", "time_stamp", "id")
META_COLUMNS = KEY + ("train_test", "status_type_id")


@dataclass(frozen=True)
class Limits:
    #: Rows of one key that a single task may sort; above it the key is cut into runs.
    task_rows: int = 5_000_000
    #: Rows a broadcast side may have; above it the join is done another way.
    broadcast_rows: int = 100_000
    #: Rows of one key a broadcast side may have, since each row is tested against all of its key.
    candidates_per_key: int = 500
    #: Rows per group handed to one Python call when scoring.
    python_rows: int = 200_000
    #: Packed bytes of learned rows that one task may hold and take through all rounds; above it a job per level adds up blocks.
    block_bytes: int = 40_000_000


LIMITS = Limits()

# Fixed values of the feature, label and alert definitions.
ROLLING_ROWS = {"1h": 6, "6h": 36, "24h": 144}
STD_ROWS = 6
STATUS_RANGES = {"24h": 86_400, "7d": 604_800, "30d": 2_592_000}
FEATURE_SUFFIXES = (
    "_roll_mean_1h",
    "_roll_mean_6h",
    "_roll_mean_24h",
    "_roll_std_6",
    "_delta",
    "_deviation",
)
RISK_TIERS = ((24, 1.0), (72, 0.9), (168, 0.6), (336, 0.3))
PROBABILITY_TIERS = ((0.3, "low"), (0.6, "medium"), (0.9, "high"), (1.01, "critical"))
STATUS_THRESHOLDS = {0: 0.65, 1: 0.70, 2: 0.70, 3: 0.85, 4: 0.90, 5: 0.75}
DEFAULT_STATUS_THRESHOLD = 0.65
URGENCY_HOURS = ((24, "CRITICAL"), (72, "HIGH"))
SWEEP_PERCENTILES = (90, 92, 94, 95, 96, 97, 98, 99)
MIN_VARIANCE = 1e-10
MIN_RECALL = 0.75
POSITIVE_WEIGHT_CAP = 6.0
WEIGHT_FLOOR = 1e-6
FLAG_PERCENTILE = 95
CONTAMINATIONS = (0.01, 0.03, 0.05)


@dataclass(frozen=True)
class FarmSettings:
    """One farm's parameters."""

    normal_status: tuple[int, ...] = (0,)
    downtime_status: tuple[int, ...] = (4,)
    derated_status: tuple[int, ...] = (1,)
    #: Roll within (asset, split) instead of within the asset.
    roll_by_split: bool = False
    #: Rows before this instant (UTC) may be used to fit.
    fit_cutoff: str = "2024-01-15 00:00:00"
    #: Keep only this many sensors, by variance; None keeps all.
    top_sensors: int | None = None
    #: Products to add: "gearbox" (oil by power and wind) or "vibration" (temperature by vibration).
    interactions: str = "gearbox"
    #: Keep normal train rows and all rows of ``test_split`` only, before anything is rolled (the older track).
    normal_train_and_test: bool = False
    test_split: str = "prediction"
    #: Scale by all train rows instead of the normal ones.
    scale_by_all_train: bool = False
    #: Event ids usable for supervised learning; empty means none.
    usable_events: tuple[int, ...] = ()
    sensor_kinds: dict[str, str] = field(default_factory=dict)
