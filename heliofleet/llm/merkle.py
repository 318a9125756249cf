"""Merkle manifest of a table: a leaf for every row, a tree for every group, one root over the groups.

``H`` is the lowercase hex SHA-256 of its inputs, put together. Leaves of a group ascend by the key; while several nodes remain, each
two neighbours (at the end perhaps one) become their ``H``. The roots of the groups, in bytewise order of the group with null first,
make one more tree. What leads from a row to the root is its path: the sibling at each level, or nothing where the node stood alone.

A level of ``2 ** LEVELS`` neighbouring nodes, aligned, is one string of 64-digit hex digests in one row. Substrings of fixed width
are hashed into the string of the level above until one digest is left, and the substring beside a node is its sibling. The digests
that are left are the nodes of the next round, up to the root; the paths then come down again, from round to round, by a join on
the block, so that a round joins 1/256 of the rows of the round below.

Scale: texts are hashed where they are read and never move. Leaves are sorted by range partitioning on (group, key, leaf), with a
number of the row against ties, so neither a group that holds most rows nor a repeated key ends in one task. Places in a group come
from counts per task. No row holds more than 256 leaves, and nothing but one number a round reaches the driver.

Null group: a group of its own, first in order. Null key: first in its group and, for the query, never tampered with. Rows that
repeat a key are leaves of their own, by ascending leaf. A null field is ``-``, so it differs from an empty text (``0:``). A text of
any length is one leaf. An empty table has no rows and no root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_fold, stored, table

LEVELS = 8
BLOCK = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Levels of a block from ``level0``, the digests of its nodes one after the other; ``depth`` says how many more there are.
_UP = """aggregate(array_repeat(0, depth), array(level0), (levels, _) -> concat(levels, array(array_join(
    transform(sequence(0, (length(element_at(levels, -1)) - 1) div 128),
              i -> sha2(substring(element_at(levels, -1), 128 * i + 1, 128), 256)), ''))))"""
# Siblings of the node at place ``x.idx`` of the block, from the lowest level.
_BESIDE = """transform(slice(levels, 1, depth), (level, l) -> struct(
    substring(level, 64 * (shiftright(x.idx, l) ^ 1) + 1, 64) AS sibling, shiftright(x.idx, l) % 2 = 1 AS on_left))"""
_DEPTH = f"least({LEVELS}, if(n <= 1, 0, length(bin(n - 1))))"
_FOLD = "aggregate(path, {}, (h, s) -> sha2(if(s.on_left, concat(s.sibling, h), concat(h, s.sibling)), 256))"
_PROOF = "sha2(array_join(transform(path, s -> s.sibling), ''), 256)"
_NO_PATH = "cast(array() AS array<struct<sibling: string, on_left: boolean>>)"


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of the values: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """Text that sorts bytewise as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 among the rows of ``grp`` in the given order, and ``n``, the number of these rows."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col("grp"), *order, F.col("tie")]
    sorted_rows = (stored(rows, "leaves").withColumn("tie", F.monotonically_increasing_id())
                   .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie"))
    # The number of a row is its task's number, 33 bits up, plus its place in the task.
    sorted_rows = stored(sorted_rows.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "order")
    runs = sorted_rows.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("grp")  # at most one row a task
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stored(runs.select("grp", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(group).alias("n")), "runs")
    return sorted_rows.join(runs, ["grp", "part"]).withColumn("pos", F.expr("place - first + before")).drop("place", "part", "first", "before")


def climb(nodes: DataFrame, carried: Sequence[str], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Paths of ``nodes`` (``grp``, ``pos``, ``n``, ``node`` and the ``carried`` columns).

    ``finish`` gets the last digest of every group, as ``grp`` and ``node``, and gives what lies above it: ``grp``, ``path`` and any
    columns that all nodes of the group shall have. The result has these columns, ``node``, the carried ones and the whole ``path``.
    """
    item = F.struct(F.expr(f"int(pos % {BLOCK})").alias("idx"), "node", *carried)
    blocks = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    blocks = blocks.withColumn("depth", F.expr(_DEPTH)).withColumn("level0", F.array_join("items.node", "")).withColumn("levels", F.expr(_UP))
    blocks = stored(blocks.drop("level0"), "blocks")
    tops = blocks.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.element_at("levels", -1).alias("node"))
    if (blocks.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        above = finish(tops.select("grp", "node")).withColumn("block", F.lit(0).cast("long"))
    else:
        above = climb(tops, ["pos"], finish).drop("node").withColumnRenamed("pos", "block")
    shared = [c for c in above.columns if c not in ("grp", "block", "path")]
    each = ", ".join(f"x.{c} AS {c}" for c in ["node", *carried])
    return blocks.join(above.withColumnRenamed("path", "rest"), ["grp", "block"]).selectExpr(
        "grp", *shared, f"inline(transform(items, x -> struct({each}, concat({_BESIDE}, rest) AS path)))")


def _over_groups(tops: DataFrame) -> DataFrame:
    """One tree over the digests of all groups."""
    roots = placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), [F.col("name")])
    up = climb(roots, ["name"], lambda top: top.select("grp", F.expr(_NO_PATH).alias("path"), F.col("node").alias("root")))
    return up.select(F.col("name").alias("grp"), "path", F.col("node").alias("subroot"), "root")


def manifest(rows: DataFrame, key: str, group: str, fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: ``key``, leaf, subroot, root, ``path`` (sibling digests with their side, from the leaf up), the digest of the
    path, and the root that the row leads to when the columns in ``changed`` have these values instead, with its comparison."""
    changed = changed or {}
    leaves = rows.select(F.col(key).alias("key"), group_key(F.col(group)).alias("grp"), leaf_of([F.col(c) for c in fields]).alias("node"),
                         leaf_of([changed.get(c, F.col(c)) for c in fields]).alias("now"))
    nodes = placed(leaves, [F.col("key").asc_nulls_first(), F.col("node")])
    out = climb(nodes, ["key", "now"], _over_groups).withColumn("folded_root", F.expr(_FOLD.format("now")))
    return out.select(F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", "root", "path", F.expr(_PROOF).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language, and its check of rows of which every seventh, by crc32 of the id, has another n_chars."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 7) == 0)
    return manifest(docs, "doc_id", "lang", changed={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).drop("path")


OP12_SQL = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS n))),
rows AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 7 = 0 AS hit FROM documents, crc),
values AS (SELECT doc_id, coalesce('=' || lang, '') AS g, text, lang, source, n_chars, n_chars + CASE WHEN hit THEN 1 ELSE 0 END AS n_now FROM rows),
parts AS (SELECT doc_id, g,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS b, coalesce(strlen(CAST(n_now AS VARCHAR)) || ':' || n_now, '-') AS b_now,
    coalesce(strlen(text) || ':' || text, '-') AS c FROM values),
hashed AS (SELECT doc_id, g, sha256(a || b || c) AS leaf, sha256(a || b_now || c) AS now FROM parts),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS r FROM hashed),
tree AS (SELECT g, 0 AS l, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY g UNION ALL
  SELECT g, l + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE len(nodes) = 1),
top AS (SELECT 0 AS l, list(subroot ORDER BY pos) AS nodes FROM subroots UNION ALL
  SELECT l + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM top WHERE len(nodes) > 1),
steps AS (SELECT r, 0 AS part, l, CASE WHEN (pos >> l) % 2 = 1 THEN '<' ELSE '>' END || coalesce(nodes[xor(pos >> l, 1) + 1], '') AS s
  FROM leaves JOIN tree USING (g) WHERE len(nodes) > 1 UNION ALL
  SELECT r, 1, l, CASE WHEN (p >> l) % 2 = 1 THEN '<' ELSE '>' END || coalesce(nodes[xor(p >> l, 1) + 1], '')
  FROM (SELECT r, s.pos AS p FROM leaves JOIN subroots s USING (g)), top WHERE len(nodes) > 1),
paths AS (SELECT r, list(s ORDER BY part, l) AS path FROM steps GROUP BY r),
folded AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce([now] || coalesce(path, []), lambda h, s: sha256(CASE WHEN s[1] = '<' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root
  FROM leaves JOIN subroots USING (g) LEFT JOIN paths USING (r), (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1))
SELECT *, folded_root = root AS verified FROM folded
"""
