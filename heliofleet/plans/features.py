"""The feature plan: every lag, rolling and calendar column behind one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import scalar as S
from ..operators.categories import CategoryIndex, add_one_hot_vector
from ..operators.chunks import PLANT_ORDER, Order, halo_window
from ..operators.series import add_deltas, lag_columns, rolling_columns


def plant_names(df: DataFrame) -> list[str]:
    """Distinct plants in their order; each becomes a column of the plan."""
    return sorted(r[0] for r in df.select(C.PLANT).filter(F.col(C.PLANT).isNotNull()).distinct().collect())


def build_features(
    df: DataFrame, config: C.Features = C.Features(), plants: Sequence[str] | CategoryIndex | None = None,
    order: Order = PLANT_ORDER,
) -> DataFrame:
    """Model inputs from readings with a per-unit target.

    Pass ``plants`` to declare the one-hot columns; otherwise one small job finds them. A fleet too large for a
    column a plant passes ``category_index(df, "id_planta")`` and gets the columns ``plant_index`` and, sparse, ``plant_vector``;
    its names never reach the driver. Rows with a NULL in a reading or feature are dropped if the configuration says so; other columns of the
    input do not count.
    """
    C.require_columns(df, (*C.REQUIRED_COLUMNS, C.TARGET, C.PLANT))
    ts, radiation, out = F.col(C.TS), F.col(C.RADIATION), df
    memory = {}
    for column, steps in config.lags.items():
        memory |= lag_columns(column, steps)
    for column, sizes in config.windows.items():
        memory |= rolling_columns(column, sizes)
    if memory:
        out = halo_window(out, memory, config.reach, order=order)
    if config.complete_rows:
        out = out.dropna("any", subset=[C.PLANT, *C.REQUIRED_COLUMNS, C.TARGET, *memory])
    # Columns of the row itself come after the windows, so that the shuffles stay narrow. They are
    # complete wherever the columns above are.
    out = add_deltas(out).withColumns(S.calendar(ts) | S.cyclic_calendar(ts))
    if "daylight" in config.groups:
        out = out.withColumn("is_daylight", S.daylight(radiation))
    if "interactions" in config.groups:
        out = out.withColumns(S.interactions(radiation, F.col(C.TEMPERATURE)))
    out = out.withColumns(S.one_hot(S.regime(radiation), C.REGIMES, "regime"))
    if "plant" in config.groups:
        if isinstance(plants, CategoryIndex):
            return add_one_hot_vector(out, C.PLANT, plants, "plant")
        names = plants if plants is not None else plant_names(df)
        out = out.withColumns(S.one_hot(F.col(C.PLANT), sorted(names), "plant"))
    return out


def feature_columns(df: DataFrame, horizons: bool = False) -> list[str]:
    """Columns a model may see; with ``horizons`` the shifted targets are left out too."""
    names = [c for c in df.columns if c not in C.NON_FEATURE_COLUMNS and c not in ("split", "estacion")]
    if horizons:
        prefix = f"{C.TARGET}_h"
        names = [c for c in names if not (c.startswith(prefix) and c[len(prefix):].isdigit())]
    return names
