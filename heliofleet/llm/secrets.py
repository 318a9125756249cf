"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give leftmost non-overlapping matches; their places follow from the lengths of the matches and of the text between
them. The hash of every candidate is then counted over the whole corpus by distinct repositories and distinct owners: a
candidate that ``EXAMPLE_OWNERS`` or more owners share is a widely copied example, any other is taken for live.

Scale: texts are read once and not shuffled; a narrow table with the matches of each document goes on. Counting is by (candidate,
owner) first, so a candidate that holds a third of all matches is combined before it moves.

Null or empty text has no spans. Null owners and repositories count as one each. Repeated rows are scanned each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, table

# Kind, pattern, group that is the secret, least length of the secret; in the order of the kinds.
BASE = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
FURTHER = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27),
)
KINDS = tuple(k[0] for k in BASE + FURTHER)
EXAMPLE_OWNERS = 3


def _matches(text: Column) -> Column:
    """Of each kind that occurs: its number, the matches, the secrets in them, and the lengths of the text before each."""
    found = []
    for number, (_, pattern, group, _) in enumerate(BASE + FURTHER):
        p = F.lit(pattern)
        whole = F.regexp_extract_all(text, p, 0)
        value = F.regexp_extract_all(text, p, group) if group else whole
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
        found.append(F.when(text.rlike(pattern), F.struct(
            F.lit(number).alias("kind"), F.arrays_zip(F.transform(whole, lambda x: F.char_length(x)).alias("size"), value.alias("value"),
                                                      F.slice(gaps, 1, F.size(whole)).alias("gap")).alias("each"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def scan(docs: DataFrame, owner: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as ``(row, doc_id)`` and their spans: kind, start, end, value, owners, repositories, live."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).cast("string").alias("owner"),
                              F.col(repository).cast("string").alias("repository"), _matches(text).alias("found")), "matches")
    each = rows.filter(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f"))
    each = each.select("row", "owner", "repository", F.col("f.kind").alias("kind"), F.posexplode("f.each").alias("i", "m"))
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(so_far)).select(
        "row", "owner", "repository", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end", F.col("m.value").alias("value"))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in BASE + FURTHER]), F.col("kind") + 1)
    spans = stored(spans.filter(F.char_length("value") >= least).withColumn("secret", F.xxhash64("value")), "spans")
    def distinct(what):
        return spans.groupBy("secret", what).agg(F.lit(1).alias("one")).groupBy("secret").agg(F.sum("one").alias(f"n_{what}"))
    counted = spans.join(distinct("owner"), "secret").join(distinct("repository"), "secret").select(
        "row", "kind", "start", "end", "value", F.col("n_owner").alias("owners"), F.col("n_repository").alias("repositories"))
    return rows.select("row", "doc_id"), counted.withColumn("live", F.col("owners") < EXAMPLE_OWNERS)


def redacted(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``docs`` with every live-looking secret replaced by ``[secret]`` and ``n_chars`` counted anew; all rows and columns stay."""
    rows, spans = scan(docs, owner, repository)
    # Spans are found by doc_id and text, as rows have no number of their own in ``docs``.
    live = spans.filter("live").join(rows, "row").groupBy("doc_id").agg(F.array_distinct(F.collect_list("value")).alias("secrets_"))
    text = F.expr("aggregate(array_sort(secrets_, (x, y) -> length(y) - length(x)), text, (t, s) -> replace(t, s, '[secret]'))")
    changed = docs.join(live, docs["doc_id"].eqNullSafe(live["doc_id"]), "left").drop(live["doc_id"])
    changed = changed.withColumn("text", F.when(F.col("secrets_").isNull(), F.col("text")).otherwise(text))
    return changed.withColumn("n_chars", F.when(F.col("secrets_").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))).select(docs.columns)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    rows, spans = scan(table(spark, sf_dir, "documents"), "source", "doc_id")
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = spans.withColumn("at", F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span")))
    base = F.col("kind") < len(BASE)
    def number(kind):
        return F.count(F.when(F.col("kind") == KINDS.index(kind), 1))
    by_row = spans.groupBy("row").agg(
        *[number(k[0]).alias(f"n_{k[0]}") for k in BASE], F.sort_array(F.collect_list(F.when(base, F.col("at")))).alias("b"),
        F.sort_array(F.collect_list("at")).alias("a"), F.count_if("live").alias("n_live"), F.max("owners").alias("most_owners"))
    def joined(c):
        return F.array_join(F.coalesce(F.transform(F.col(c), lambda x: x["span"]), F.array().cast("array<string>")), ",")
    return rows.join(by_row, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k[0]}", F.lit(0)).cast("long").alias(f"n_{k[0]}") for k in BASE],
        F.sha2(joined("b").cast("binary"), 256).alias("base_sha256"), joined("a").alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"))


def _sql_kind(number: int) -> str:
    kind, pattern, group, least = (BASE + FURTHER)[number]
    p = pattern.replace("'", "''")
    return f"""SELECT r, doc_id, source, {number} AS kind, '{kind}' AS name, i, len(m[i]) AS size, v[i] AS value, len(g[i]) AS gap, {least} AS least FROM (
      SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT r, doc_id, source, regexp_extract_all(text, '{p}') AS m,
      regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}')))"""


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(_sql_kind(k) for k in range(len(KINDS)))}),
p AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM m),
s AS (SELECT *, name || ':' || CAST(e - size AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM p WHERE len(value) >= least),
o AS (SELECT value, count(DISTINCT source) AS owners FROM s GROUP BY value),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  string_agg(span, ',' ORDER BY e - size, kind) FILTER (kind < 3) AS b, string_agg(span, ',' ORDER BY e - size, kind) AS a,
  count(*) FILTER (owners < {EXAMPLE_OWNERS}) AS n_live, max(owners) AS most FROM s JOIN o USING (value) GROUP BY r)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live,
  CAST(coalesce(most, 0) AS BIGINT) AS most_owners
FROM d LEFT JOIN a USING (r)
"""
