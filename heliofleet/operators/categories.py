"""Categories of any number: a stored index of distinct values, and one-hot rows as sparse vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .chunks import with_scalars


@dataclass(frozen=True)
class CategoryIndex:
    """A table (category, position) in ascending order of category, positions from 0, and the number of its rows."""

    table: DataFrame
    size: int


def category_index(df: DataFrame, column: str) -> CategoryIndex:
    """Distinct values of ``column``, numbered in their order; NULL is no category.

    Range partitions are sorted each on its own and written; a partition's rows go on from the count of those before it. Only one
    number, the size, reaches the driver.
    """
    found = df.select(F.col(column).alias("category")).filter(F.col("category").isNotNull()).distinct()
    ordered = cut_lineage(found.orderBy("category").withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = with_scalars(counts.select("_part"), counts.agg(F.map_from_entries(F.collect_list(F.struct("_part", "_n"))).alias("_all"))).select(
        "_part", F.aggregate(F.map_entries(F.map_filter("_all", lambda k, _: k < F.col("_part"))), F.lit(0).cast("long"),
                             lambda s, e: s + e["value"]).alias("_before"))
    table = ordered.select("category", part.alias("_part"), row.alias("_row")).join(before, "_part").select(
        "category", (F.col("_before") + F.col("_row")).alias("position"))
    return CategoryIndex(cut_lineage(table), ordered.count())


def add_one_hot_vector(df: DataFrame, column: str, index: CategoryIndex, prefix: str, drop_first: bool = False) -> DataFrame:
    """``<prefix>_index`` (NULL for a value outside the index) and ``<prefix>_vector``, sparse, all zero for such a value.

    With ``drop_first`` the first category is all zero too and the vector is one shorter. A vector of no slots is left out.
    """
    first = 1 if drop_first else 0
    size = max(index.size - first, 0)
    at = f"{prefix}_index"
    known = index.table.select(F.col("category").alias(column), F.col("position").cast("int").alias(at))
    slot = F.when(F.col(at) >= first, F.col(at) - first).otherwise(size)  # the slot behind the last one is left out below
    out = df.join(known, column, "left").withColumn(f"{prefix}_slot", slot.cast("double"))
    if not size:
        return out.drop(f"{prefix}_slot")
    ends = df.sparkSession.range(1).select(F.lit(float(size)).alias(f"{prefix}_slot"))
    encoder = OneHotEncoder(inputCols=[f"{prefix}_slot"], outputCols=[f"{prefix}_vector"], dropLast=True).fit(ends)
    return encoder.transform(out).drop(f"{prefix}_slot")
