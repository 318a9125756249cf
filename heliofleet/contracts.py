"""Column contracts, thresholds and configuration records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

PLANT = "id_planta"
TS = "timestamp"
RADIATION = "radiation"
POWER = "power"
TEMPERATURE = "T_ambiente"
TARGET = "power_pu"
NOMINAL = "p_nominal_kw"

STEP_SECONDS = 15 * 60
STEPS_PER_DAY = 96

# Column names of the data model.
REQUIRED_COLUMNS = ("timestamp", "radiation", "power", "T_ambiente")
NON_FEATURE_COLUMNS = (
    "power_pu", "timestamp", "power", "p_nominal_kw", "id_planta", "Mes", "season",
)

# Labels, in their natural order.
SEASONS = ("Invierno", "Primavera", "Verano", "Otono")
REGIMES = ("noche", "baja", "media", "alta")
RAMPS = ("Bajada", "Estable", "Subida")
IRRADIANCE_EDGES = (0.0, 100.0, 300.0, 600.0, 1000.0, 2000.0)
IRRADIANCE_LABELS = ("<100", "100-300", "300-600", "600-1000", ">1000")
# The features whose share is followed from horizon to horizon.
TRACKED_FEATURES = ("power_pu_lag_1", "delta_power_pu_1", "radiation", "radiation_sq", "cos_day", "sin_hour", "T_ambiente")
PRODUCTION_EDGES = (0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)
PRODUCTION_LABELS = ("0-10%", "10-20%", "20-40%", "40-60%", "60-80%", "80-100%")
PERSISTENT = "Persistente (posible fallo/suciedad)"
SPORADIC = "Esporádica (nube, sombra)"

# Three distinct notions of "daylight" are in use; each has its own name.
DAYLIGHT_RADIATION = 20.0  # W/m2, the model feature
PRODUCING = 0.0            # p.u., metrics
PRODUCING_RESIDUAL = 0.01  # p.u., residual diagnostics

RELATIVE_EPS = 1e-6
SENTINEL = 999.0


# Groups of features that come from the row itself.
ROW_GROUPS = frozenset({"daylight", "interactions", "plant"})


@dataclass(frozen=True)
class Features:
    """What the feature plan derives: memory of any reading, in steps, and groups of columns of the row itself."""

    lags: Mapping[str, Sequence[int]] = field(default_factory=lambda: {TARGET: (1, 2, 4), RADIATION: (1, 2)})
    windows: Mapping[str, Sequence[int]] = field(default_factory=lambda: {TARGET: (4, 8), RADIATION: (4,)})
    groups: frozenset[str] = ROW_GROUPS
    complete_rows: bool = True  # leave out rows with a NULL in a reading or a memory column

    def __post_init__(self):
        if unknown := set(self.groups) - ROW_GROUPS:
            raise ValueError(f"unknown feature groups: {', '.join(sorted(unknown))}")

    @property
    def reach(self) -> int:
        """Steps that a row looks back."""
        return max((n for steps in (*self.lags.values(), *self.windows.values()) for n in steps), default=0)

    def without_memory(self) -> Features:
        return replace(self, lags={}, windows={})


@dataclass(frozen=True)
class SplitDates:
    """Cut dates of the time-by-plant split; a date means its midnight."""

    train_end: str
    val_start: str
    val_end: str
    test_start: str
    test_end: str


@dataclass(frozen=True)
class MonitorConfig:
    """Persistent-anomaly monitor: trailing window over producing rows and alert threshold."""

    window: int = 96
    min_rows: int = 24
    threshold: float = 0.15
    min_hours: float = 2.0
    step_hours: float = 0.25


def require_columns(df: DataFrame, names: Iterable[str] = REQUIRED_COLUMNS) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
