"""Exact duplicates by Grace hashing: records are partitioned to spill files until each bucket fits an open-addressing table.

1. Every task puts the rows it reads through a table of its own: rows of one text become one record that holds the text once and
   the doc_ids of its rows. Records are written to a table in the shared folder, the first spill.
2. Buckets are digits of the text's hash. Sizes of the buckets are measured; those that fit are shuffled to tasks, sorted by
   bucket, and each goes through an open-addressing table with linear probing. Records meet only if their complete texts are equal.
3. Records of buckets that do not fit are spilled again and partitioned by another digit, until all fit.
4. The decision for a record is joined to its doc_ids by the record's number; texts are not read again.

Scale: a text is written once and shuffled once. Copies within a task are one record, so a text that a third of all rows holds
sends one record a task (a record holds at most ``MOST_IDS`` rows, a task's table at most ``HELD`` bytes; beyond that another record
begins). A bucket of one hash that stays too large is a text with many records: the table holds it once and the records
stream past. Recovery: what the next step reads is a written table.

Null text is empty. Of equal texts the row with the largest doc_id stays (null is smaller than any); of repeated rows with that
id exactly one. Texts of any length are compared whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, table, workers_see_package

FITS = 16 << 20  # bytes of text in a bucket
HELD = 32 << 20  # bytes of text in the table of a reading task
MOST_IDS = 1 << 16
ROW_BYTES = 100  # what a record takes beside its text


class OpenTable:
    """Distinct texts by open addressing with linear probing; a text's number is the order of its arrival."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.size = 0  # bytes of text

    def place(self, key: int, text: bytes) -> int:
        """Number of the text, which is new to the table if it is the largest number."""
        mask = len(self.slots) - 1
        i = key & mask
        while (known := self.slots[i]) >= 0:
            if self.hashes[known] == key and self.texts[known] == text:
                return known
            i = (i + 1) & mask
        self.slots[i] = len(self.texts)
        self.hashes.append(key)
        self.texts.append(text)
        self.size += len(text)
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return len(self.texts) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for number, key in enumerate(self.hashes):
            i = key & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = number


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, hash) as records of one text and the doc_ids of its rows, largest first."""
    number = TaskContext.get().partitionId() << 33
    held, ids = OpenTable(), []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, held, ids
        at = 0
        while at < len(ids):
            until, size = at, 0
            while until < len(ids) and size <= 4 << 20:
                size += len(held.texts[until]) + 8 * len(ids[until])
                until += 1
            lists = [sorted(x, key=lambda i: (i is None, -i if i is not None else 0)) for x in ids[at:until]]
            n = until - at
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + n)), pa.array(held.hashes[at:until], pa.int64()),
                pa.array(held.texts[at:until], pa.binary()), pa.array(lists, pa.list_(pa.int64())),
                pa.array([len(t) for t in held.texts[at:until]], pa.int64())], names=["record", "hash", "content", "ids", "size"])
            number, at = number + n, until
        held, ids = OpenTable(), []

    for batch in batches:
        for doc_id, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer()
            k = held.place(key, raw.to_pybytes() if raw is not None else b"")
            if k == len(ids):
                ids.append([])
            ids[k].append(doc_id)
            if held.size > HELD or len(ids[k]) >= MOST_IDS:
                yield from flush()
    yield from flush()


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by bucket, each with the decision for its text: the largest doc_id, the number of rows, whether it holds the
    row that stays, the SHA-256."""
    bucket, held, which, records, counts, best = None, OpenTable(), [], [], [], []

    def flush() -> Iterator[pa.RecordBatch]:
        total, top = [0] * len(held.texts), [None] * len(held.texts)
        for r, k in enumerate(which):
            total[k] += counts[r]
            rank = (best[r] is not None, best[r] or 0, -records[r])
            if top[k] is None or rank > top[k]:
                top[k] = rank
        digest = [hashlib.sha256(t).hexdigest() for t in held.texts]
        yield pa.RecordBatch.from_arrays([
            pa.array(records, pa.int64()), pa.array([top[k][1] if top[k][0] else None for k in which], pa.int64()),
            pa.array([total[k] for k in which], pa.int64()), pa.array([top[k][2] == -r for r, k in zip(records, which, strict=True)], pa.bool_()),
            pa.array([digest[k] for k in which], pa.string())], names=["record", "keep_id", "group_size", "keeper", "text_sha256"])

    for batch in batches:
        content = batch.column(3)
        for i, (own, record, key, n, most) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True)):
            if own != bucket:
                if which:
                    yield from flush()
                bucket, held, which, records, counts, best = own, OpenTable(), [], [], [], []
            which.append(held.place(key, content[i].as_buffer().to_pybytes()))
            records.append(record)
            counts.append(n)
            best.append(most)
    if which:
        yield from flush()


DECISION = "record long, keep_id long, group_size long, keeper boolean, text_sha256 string"


def _decisions(spill: DataFrame, fits: int, level: int = 0) -> DataFrame:
    """Decisions for all records of the spill, bucket by bucket."""
    size = F.sum(F.col("size") + ROW_BYTES)
    total = spill.agg(size).first()[0] or 0
    buckets = 2 * (total // fits) + 1  # about half full on average
    digit = F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(buckets))
    cut = spill.withColumn("bucket", digit)
    measured = stored(cut.groupBy("bucket").agg(size.alias("bytes"), (F.min("hash") == F.max("hash")).alias("one")), "buckets")
    large = measured.filter((F.col("bytes") > fits) & ~F.col("one")).select("bucket")
    any_large = bool(large.head(1))
    ready = cut.join(large, "bucket", "left_anti") if any_large else cut
    tasks = max(spill.sparkSession.sparkContext.defaultParallelism, min(buckets, 100_000))
    ready = ready.select("bucket", "record", "hash", "content", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("best"))
    done = ready.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_decided, DECISION)
    if not any_large:
        return done
    again = stored(cut.join(large, "bucket", "left_semi").drop("bucket"), f"spill{level + 1}")
    return done.unionByName(_decisions(again, fits, level + 1))


def exact_duplicates(docs: DataFrame, fits: int = FITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    workers_see_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.withColumn("hash", F.xxhash64("text")).mapInArrow(_records, "record long, hash long, content binary, ids array<long>, size long")
    spill = stored(made, "spill")
    decided = stored(_decisions(spill, fits), "decisions")
    out = spill.select("record", "ids").join(decided, "record").select("*", F.posexplode("ids").alias("place", "doc_id"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("place") == 0)).alias("kept"), "text_sha256")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
