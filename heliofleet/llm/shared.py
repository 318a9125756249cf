"""What the operators here share: tables in the cluster's shared folder, row identity, slices of Arrow text."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_BYTES = 1 << 20  # text handled at once by the numpy kernels; a longer document is a slice of its own


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only in a local session without one, a folder under its warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage is cut, a lost executor costs its own tasks."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_see_package(spark: SparkSession) -> None:
    """Python workers on this machine import the package from where the driver has it; a cluster gets it by --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), home) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and the ``n + 1`` bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of about ``most`` bytes of text, each with its bytes and bounds."""
    data, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i]
        i = j


def fresh(names: list[str], wanted: str) -> str:
    """A column name that clashes with none of ``names``."""
    while wanted.lower() in {n.lower() for n in names}:
        wanted += "_"
    return wanted


def with_text_columns(df: DataFrame, compute, fields: T.StructType, keep: list[str]) -> DataFrame:
    """``keep`` of ``df`` and new columns that ``compute(rows, bytes, bounds)`` derives from the column ``text``; no shuffle."""
    workers_see_package(df.sparkSession)
    df = df.select(*dict.fromkeys([*keep, "text"]))
    out = T.StructType([df.schema[c] for c in keep] + list(fields))
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch):
                new = [pa.array(x, type=kind) if not isinstance(x, pa.Array) else x
                       for x, kind in zip(compute(rows, data, bounds), arrow.types, strict=True)]
                old = [rows.column(rows.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*keep, *arrow.names])
    return df.mapInArrow(run, out)

