"""Predictors that need no training library: last value, same slot yesterday, a fitted line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..operators.series import time_exact_lag
from ..operators.chunks import PLANT_ORDER, Order, halo_window, with_scalars


def persistence(df: DataFrame, target: str = C.TARGET, order: Order = PLANT_ORDER) -> DataFrame:
    """Prediction = previous row of the plant; rows without one are dropped."""
    return halo_window(df, {"y_pred": lambda w: F.lag(target, 1).over(w)}, 1, order=order).withColumn(
        "y_true", F.col(target)
    ).filter(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())


def same_slot_yesterday(df: DataFrame, target: str = C.TARGET) -> DataFrame:
    """Prediction = the value exactly 96 slots earlier."""
    return time_exact_lag(df, target, C.STEPS_PER_DAY, "y_pred").withColumn("y_true", F.col(target)).filter(
        F.col("y_pred").isNotNull() & F.col("y_true").isNotNull()
    )


def linear_predictions(df: DataFrame, target: str = C.TARGET, driver: str = C.RADIATION) -> DataFrame:
    """Least-squares line of the target on one driver, fitted on the train split in one aggregate."""
    line = df.filter(F.col("split") == "train").agg(
        F.regr_slope(target, driver).alias("_slope"), F.regr_intercept(target, driver).alias("_intercept")
    )
    return with_scalars(df, line).withColumn(
        "y_pred", F.col("_intercept") + F.col("_slope") * F.col(driver)
    ).withColumn("y_true", F.col(target)).drop("_slope", "_intercept").filter(
        F.col("y_pred").isNotNull() & F.col("y_true").isNotNull()
    )
