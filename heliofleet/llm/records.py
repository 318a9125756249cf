"""Token-id output as length-delimited binary records with a separate offset index.

A shard ``NNNNNNNN.records`` is a run of frames: length (u64), masked CRC-32 of the length (u32), payload, masked CRC-32 of the
payload (u32), all little-endian. A payload is doc_id (i64), a byte that is 1 if doc_id is null, and the ids as unsigned
integers of 2 bytes if all fit, else 4 (another byte tells). ``<shard>.index`` holds 24 bytes a record: frame offset, frame length and
number of ids (u64 each), so readers can visit records of any shard in any order. Shards follow each other in ascending doc_id
order (null first; equal ids in the order they are read).

Texts are encoded where they are read, and packed ids are shuffled once, to shards of even size by ranges of (doc_id, row number).
Tasks write through Arrow's file systems into a folder that all executors share, under a name of the attempt, and rename when
a shard is complete; a task that runs again replaces its own shard with the same bytes. Memory is bounded: frames are written
and read as a stream. Every length and checksum is verified on reading.

Null text is empty: one end id. Repeated rows are records of their own.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, slices, stored, table, workers_see_package
from .tokens import default_vocabulary, encoder

END = np.array([0], "<u4").tobytes()
MASK = 0xA282EAD8
SHARD_ROWS = 20_000
LEAST = -(1 << 63)


def masked(data: bytes) -> int:
    """CRC-32 rotated by 15 bits plus a constant, so that checksums of data that hold checksums stay good."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> bytes | None:
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record")
    return body[:size]


def packed_ids(ids: np.ndarray) -> bytes:
    """A byte that is 1 if an id needs 4 bytes, then the ids."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([wide]) + ids.astype("<u4" if wide else "<u2").tobytes()


def payload_of(doc_id: int | None, packed: bytes) -> bytes:
    return struct.pack("<q?", doc_id or 0, doc_id is None) + packed


def read_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, missing, wide = struct.unpack("<q??", payload[:10])
    return None if missing else doc_id, np.frombuffer(payload, "<u4" if wide else "<u2", offset=10).astype("<u4")


def qualified(spark, folder: str) -> str:
    """The folder with its file system, as Spark resolves it; a worker would take a bare path for its own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _file_system(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _shard_starts(keys: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First (doc_id, row) of each shard of about ``rows`` rows, from a range partitioning of these two numbers; two numbers a shard."""
    shards = max(keys.sparkSession.sparkContext.defaultParallelism, keys.count() // rows + 1)
    dealt = keys.repartitionByRange(shards, "key", "row").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "row")).alias("first"))
    firsts = sorted((r["first"]["key"], r["first"]["row"]) for r in dealt.collect()) or [(LEAST, 0)]
    return np.array([f[0] for f in firsts]), np.array([f[1] for f in firsts])


def _shard_of(key: np.ndarray, row: np.ndarray, starts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Last shard that starts at or before each (key, row); the first shard takes what comes before."""
    order = np.lexsort((np.concatenate((row, starts[1])), np.concatenate((key, starts[0]))))
    is_start = order >= len(key)
    # A row equal to a start sorts before it here (lexsort is stable): it belongs to the shard before, which keeps the order.
    out = np.empty(len(key), np.int64)
    out[order[~is_start]] = np.cumsum(is_start)[~is_start]
    return np.maximum(out - 1, 0)


def encoded(keyed: DataFrame, vocabulary: str, starts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Shard, doc_id, key, row, packed ids and their number, encoded where the text is read."""
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for rows, _, _ in slices(batch):
                ids = [np.frombuffer(x + END, "<u4") for x in enc.ids([t or "" for t in rows.column(1).to_pylist()])]
                part = _shard_of(rows.column(2).to_numpy(), rows.column(3).to_numpy(), starts)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), rows.column(0), rows.column(2), rows.column(3), pa.array([packed_ids(x) for x in ids], pa.binary()),
                                                  pa.array([len(x) for x in ids], pa.int64())], names=["part", "doc_id", "key", "row", "packed", "n"])
    return keyed.mapInArrow(run, "part int, doc_id long, key long, row long, packed binary, n long")


def write_records(docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Encode ``docs`` and write shards into ``folder``; a table of shard, number of records and number of ids."""
    folder = qualified(docs.sparkSession, folder)
    workers_see_package(docs.sparkSession)
    # Null sorts first: it and the smallest number share a key, and the flag sorts them.
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LEAST)).alias("key"), F.monotonically_increasing_id().alias("row"))
    starts = _shard_starts(keyed.select("key", "row"), SHARD_ROWS)
    ordered = encoded(keyed, vocabulary, starts).repartitionById(len(starts[0]), "part").sortWithinPartitions(
        F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("row")).select("doc_id", "packed", "n")

    def run(batches):
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name, attempt = f"{root}/{shard:08d}.records", uuid.uuid4().hex
        at, records, total = 0, 0, 0
        with files.open_output_stream(f"{name}.{attempt}") as out, files.open_output_stream(f"{name}.index.{attempt}") as index:
            for batch in batches:
                for low in range(0, batch.num_rows, 1000):
                    some, framed, places = batch.slice(low, 1000), [], []
                    for doc_id, packed, n in zip(*(some.column(c).to_pylist() for c in range(3)), strict=True):
                        framed.append(frame(payload_of(doc_id, packed)))
                        places.append(struct.pack("<QQQ", at, len(framed[-1]), n))
                        at, total = at + len(framed[-1]), total + n
                    out.write(b"".join(framed))
                    index.write(b"".join(places))
                    records += some.num_rows
        files.move(f"{name}.{attempt}", name)
        files.move(f"{name}.index.{attempt}", f"{name}.index")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "records": pa.array([records], pa.int64()),
                                          "ids": pa.array([total], pa.int64())})
    return stored(ordered.mapInArrow(run, "shard long, records long, ids long"), "shards")


def read_records(shards: DataFrame, folder: str) -> DataFrame:
    """Every record of the shards in file order: doc_id, start (ids of all records before it), n_tokens, ids_crc32."""
    folder = qualified(shards.sparkSession, folder)
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    places = shards.withColumn("before", F.coalesce(before, F.lit(0)))
    places = places.repartition(max(1, shards.sparkSession.sparkContext.defaultParallelism), "shard")

    def run(batches):
        files, root = _file_system(folder)
        for batch in batches:
            for shard, records, start in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                name = f"{root}/{shard:08d}.records"
                rows, seen = [], 0
                with files.open_input_stream(name, buffer_size=1 << 20) as stream, files.open_input_stream(f"{name}.index") as index:
                    while (payload := unframe(stream)) is not None:
                        doc_id, ids = read_payload(payload)
                        _, length, count = struct.unpack("<QQQ", index.read(24))
                        if count != len(ids) or length != len(payload) + 16:
                            raise ValueError("index and records differ")
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start, seen = start + len(ids), seen + 1
                        if len(rows) == 10_000:
                            yield _table(rows)
                            rows = []
                if seen != records:
                    raise ValueError("records are missing")
                yield _table(rows)
    return places.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_records(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document, written as binary records in doc_id order and read back."""
    folder = new_path(spark, "records")
    shards = write_records(table(spark, sf_dir, "documents"), folder, vocabulary or default_vocabulary())
    return read_records(shards, folder)
