"""Exact top-k inner products with a pivot-distance index.

Components become floor(1024 x). A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, a query gets
0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest inner products are the nearest vectors, and the triangle inequality holds.
Vectors are keyed by their nearest pivot and the distance to it, sorted by that key, and stored in chunks of at most ``CHUNK``
rows: rings around the pivots. Each query first takes the rings nearest to its own distance until they hold k vectors; its k-th
score there bounds the radius of the search. It then expands to the rings of each pivot that meet [d(q, p) - r, d(q, p) + r] and
to no others. Scores are exact integers; a ring keeps only what reaches the bound, ties included.

Scale: pivots are a fixed number from a bounded sample (any choice gives exact results). Rings are cut by range partitioning on
(pivot, distance, vec_id), so thousands of equal vectors are split by vec_id. Queries travel in blocks of at most
``BLOCK``; rings and query blocks meet by pivot where the distances that the bounds leave open touch the ring.

Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as padded with zeros. Rows that
repeat a vec_id are candidates of their own, except for queries of the same id; as queries each has its own ranks. A null vec_id is a candidate that comes last
among ties, and no query. Scores are exact while they stay below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, table, workers_see_package

PIVOTS = 16
CHUNK = 2048
BLOCK = 128
SAMPLE = 4096
ROWS = 1 << 10  # numbers kept for the queries of a block
LAST = np.iinfo(np.int64).max


def _whole(vectors: DataFrame) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    return vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")).filter(
        "x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))").select(
        F.coalesce("vec_id", F.lit(int(LAST))).alias("vec_id"), F.transform("x", lambda v: F.floor(v * 1024).cast("double")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(column)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distances(x: np.ndarray, tail: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1) + tail * tail
    found = square[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots[:, :-1].T + tail[:, None] * pivots[:, -1][None])
    return np.sqrt(np.maximum(found, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k best candidates of each query row."""
    spark = vectors.sparkSession
    workers_see_package(spark)
    points, asked = _whole(vectors), _whole(queries)
    widest = points.agg(F.max(F.size("x")).alias("width"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("norm")).first()
    width, top = int(widest["width"] or 0), float(widest["norm"] or 0.0)
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("x").combine_chunks()
    base = _matrix(sample, width)
    tails = np.sqrt(np.maximum(top - (base * base).sum(1), 0))
    base = np.concatenate([base, tails[:, None]], 1)
    chosen = [0] if len(base) else []
    while len(chosen) < min(pivots, len(base)):  # each next pivot is the sampled vector farthest from those before
        chosen.append(int(_distances(base[:, :-1], base[:, -1], base[chosen]).min(1).argmax()))
    centres = base[chosen] if len(base) else np.zeros((1, width + 1))

    def keyed(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            far = _distances(x, np.sqrt(np.maximum(top - (x * x).sum(1), 0)), centres)
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near])],
                                             names=["vec_id", "x", "pivot", "far"])

    def rings(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                pivot = batch.column(2).to_numpy()
                if held and (held[0].column(2)[0].as_py() != pivot[0] or sum(map(len, held)) >= chunk):
                    yield _ring(held, width)
                    held = []
                n = min(int(np.searchsorted(pivot, pivot[0], "right")), chunk - sum(map(len, held)))
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
        if held:
            yield _ring(held, width)

    parts = max(1, spark.sparkContext.defaultParallelism)
    ordered = points.mapInArrow(keyed, "vec_id long, x array<double>, pivot int, far double").repartitionByRange(
        parts, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")
    index = stored(ordered.mapInArrow(rings, "pivot int, low double, high double, n int, ids binary, xs binary"), "rings")
    index = stored(index.withColumn("ring", F.monotonically_increasing_id()), "rings")

    def packed(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for i in range(0, len(batch), block):
                some = batch.slice(i, block)
                x = _matrix(some.column(1), width)
                far = _distances(x, np.zeros(len(x)), centres)
                count = len(centres)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * count, pa.int64()), pa.array(np.arange(count, dtype=np.int32)),
                    pa.array([some.column(0).to_numpy().astype("<i8").tobytes()] * count, pa.binary()),
                    pa.array([x.tobytes()] * count, pa.binary()), pa.array([np.ascontiguousarray(far[:, p]).tobytes() for p in range(count)], pa.binary()),
                    pa.array(far.min(0)), pa.array(far.max(0))], names=["block", "pivot", "qids", "qs", "fars", "least", "most"])
                number += 1
    blocks = stored(asked.filter(F.col("vec_id") < int(LAST)).mapInArrow(
        packed, "block long, pivot int, qids binary, qs binary, fars binary, least double, most double"), "blocks")

    def radii(r, bounds):
        q = np.frombuffer(r["qs"]).reshape(len(bounds), -1)
        return np.sqrt(np.maximum((q * q).sum(1) + top - 2 * bounds, 0)) + 1e-3

    def search(bounded):
        def run(batches):
            for batch in batches:
                found = [[], [], [], []]
                for r in batch.to_pylist():
                    qids, ids = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                    bounds = np.frombuffer(r["bounds"]) if bounded else np.full(len(qids), -np.inf)
                    fars = np.frombuffer(r["fars"])
                    q = np.frombuffer(r["qs"]).reshape(len(qids), -1)
                    radius = radii(r, bounds)
                    live = np.flatnonzero((fars - radius <= r["high"]) & (fars + radius >= r["low"]))
                    if not len(live):
                        continue
                    scores = q[live] @ np.frombuffer(r["xs"]).reshape(len(ids), -1).T
                    for s, i in zip(scores, live, strict=True):
                        ok = np.flatnonzero((ids != qids[i]) & (s >= bounds[i]))
                        ok = ok[_best(s[ok], ids[ok], k)]
                        found[0].append(np.full(len(ok), r["block"] * ROWS + i))
                        found[1].append(np.full(len(ok), qids[i]))
                        found[2].append(ids[ok])
                        found[3].append(s[ok].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in found],
                                                 names=["query", "query_id", "vec_id", "score"])
        return run

    hits, best = "query long, query_id long, vec_id long, score long", Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # First annuli: for every block the ring of each pivot whose distances are nearest to the block's own.
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("most"), F.col("least") - F.col("high"))
    near = blocks.select("block", "pivot", "least", "most").join(index.select("pivot", "ring", "low", "high"), "pivot").groupBy("block", "pivot").agg(
        F.min_by("ring", gap).alias("ring"))
    first = blocks.join(near, ["block", "pivot"]).join(index.drop("pivot"), "ring")
    kth = first.mapInArrow(search(False), hits).groupBy("query").agg(
        F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("s")).select("query", F.get("s", F.lit(0)).alias("s"))
    kth = stored(kth.filter("s is not null").withColumn("block", F.floor(F.col("query") / ROWS)), "bounds")

    def with_bounds(left, right):
        """Bounds of the block's queries, and how far from each pivot they reach."""
        known = dict(zip(right.column("query").to_pylist(), right.column("s").to_pylist(), strict=True))
        rows = []
        for r in left.to_pylist():
            fars = np.frombuffer(r["fars"])
            bounds = np.array([known.get(r["block"] * ROWS + i, -(2**62)) for i in range(len(fars))], float)
            radius = radii(r, bounds)
            rows.append((r["block"], r["pivot"], bounds.tobytes(), float((fars - radius).min()), float((fars + radius).max())))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "pivot", "bounds", "inner", "outer"])
    reach = blocks.select("block", "pivot", "qs", "fars").groupBy("block").cogroup(kth.groupBy("block")).applyInArrow(
        with_bounds, "block long, pivot int, bounds binary, inner double, outer double")
    # Rings meet the blocks whose annuli they touch. A pivot's rings are dealt to several keys, so that no pivot is one task.
    deal = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(centres)))
    ready = blocks.join(reach, ["block", "pivot"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    dealt = index.withColumn("deal", F.pmod(F.xxhash64("ring"), F.lit(deal)).cast("int"))
    touching = (F.col("high") >= F.col("inner")) & (F.col("low") <= F.col("outer"))
    every = ready.join(dealt, ["pivot", "deal"]).filter(touching).mapInArrow(search(True), hits)
    out = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.nullif("vec_id", F.lit(int(LAST))).alias("vec_id"), "score")


def _ring(held: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, far = rows.column("vec_id").to_numpy(), rows.column("far").to_numpy()
    x = _matrix(rows.column("x").combine_chunks(), width)
    return pa.RecordBatch.from_pydict({
        "pivot": pa.array([held[0].column(2)[0].as_py()], pa.int32()), "low": pa.array([far[0]]), "high": pa.array([far[-1]]),
        "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "xs": pa.array([x.tobytes()], pa.binary())})


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
