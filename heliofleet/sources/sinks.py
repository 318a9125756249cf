"""Tables, sidecars and models on shared storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions.scalar import rounded


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (C.PLANT,), mode: str = "overwrite") -> None:
    """Parquet, partitioned; rows of a partition value stay spread over many files."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, digits: int = 2, mode: str = "overwrite") -> None:
    rounded(df, digits).write.mode(mode).option("header", "true").csv(path)


def materialise(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Run a stage only if its output is complete (has the committer's ``_SUCCESS``), and read it back."""
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write_table(df, path, partition_by)
    return spark.read.parquet(path)


def write_feature_list(spark: SparkSession, names: Sequence[str], path: str, **metadata: str) -> None:
    """Feature names (and notes such as the best model) as one JSON row."""
    row = spark.range(1).select(
        F.array(*[F.lit(n) for n in names]).alias("features"), *[F.lit(v).alias(k) for k, v in metadata.items()]
    )
    row.coalesce(1).write.mode("overwrite").json(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    return list(spark.read.json(path).select("features").first()[0])


def write_predictions(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_table(predictions, path, ("scenario",), mode)


def cache_ranking(ranking: DataFrame, path: str) -> DataFrame:
    """Station ranking, computed once."""
    return materialise(ranking.select(C.PLANT, "rank", "station"), path)


def save_models(spark: SparkSession, models: Mapping[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    index = spark.createDataFrame([(n,) for n in models], "name string")
    index.coalesce(1).write.mode("overwrite").json(f"{path}/_index_of_models")


def load_model(spark: SparkSession, path: str, name: str) -> tuple[str, PipelineModel]:
    """The named model, or the first one there is; the name tells which."""
    known = sorted(r["name"] for r in spark.read.json(f"{path}/_index_of_models").collect())
    if not known:
        raise FileNotFoundError(f"no models under {path}")
    chosen = name if name in known else known[0]
    return chosen, PipelineModel.load(f"{path}/{chosen}")
