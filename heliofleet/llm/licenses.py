"""License scan by diagonal voting, in DataFrame operations only.

Every rolling three-word gram of every document is joined by hash to the places of the same gram in license templates (the
words are compared too, so a hash collision counts for nothing). A hit at document word i and template word j votes for the
diagonal i - j. Diagonals of one document and template that lie at most ``SLACK`` apart are merged, so a few inserted or
missing words do not break a match, and a merged span is accepted if it holds ``COVERAGE`` of the template's grams within a
span of a fitting length. Base phrases are templates that must be hit in full on one diagonal.

Scale: the template table is fixed text of this module (a few hundred rows), so its broadcast is bounded. Documents are not
shuffled: grams are exploded and joined in one stage and only hits, and one row a document, go on.

Null or empty text has no words and no label, score 0. Repeated rows are scanned each on its own (by row, not by doc_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

K = 3
SLACK = 2
COVERAGE = 0.8

# Phrases of the base scan and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Opening sentences of widely used licenses, lower-cased and without punctuation.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
)
_MARK = 0x5EED0FD0C5  # stands for the document itself among the gram hashes


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else that could become an ASCII letter; null is empty."""
    text = F.coalesce(text, F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[Kİ]"), F.translate(text, letters, letters.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def _gram_hash(a, b, c) -> Column:
    return F.xxhash64(a, b, c)


def _template_rows(spark: SparkSession, phrases, templates) -> DataFrame:
    rows = []
    for base, group in ((True, phrases), (False, templates)):
        for label, text in group:
            w = text.split()
            rows += [(label, base, len(w), len(w) - K + 1, j, *w[j: j + K], text) for j in range(len(w) - K + 1)]
    made = spark.createDataFrame(rows, "label string, base boolean, t_words int, t_grams int, t_at int, a string, b string, c string, template string")
    return made.withColumn("h", _gram_hash("a", "b", "c"))


def license_hits(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """A row for each document (template null) and each of its template diagonals: votes and the first and last hit."""
    w = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    def word(k):
        return F.get("words", F.col("at") - 1 + k)
    exploded = w.select("row", "doc_id", "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "first_word"))
    exploded = exploded.withColumn("h", F.when(F.col("at") == 0, F.lit(_MARK).cast("long")).otherwise(
        _gram_hash(F.col("first_word"), word(1), word(2))))
    known = _template_rows(docs.sparkSession, phrases, templates)
    mark = docs.sparkSession.range(1).select(
        *[F.lit(None).cast(t).alias(c) for c, t in known.dtypes if c != "h"], F.lit(_MARK).cast("long").alias("h")).select(known.columns)
    same = F.when(F.col("template").isNull(), F.col("at") == 0).otherwise(
        (F.col("first_word") == F.col("a")) & (word(1) == F.col("b")) & (word(2) == F.col("c")))
    hits = exploded.join(F.broadcast(known.union(mark)), "h").filter(same)
    return hits.groupBy("row", "doc_id", F.size("words").alias("n"), "label", "base", "template", "t_words", "t_grams",
                        (F.col("at") - 1 - F.col("t_at")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("t_at").alias("first"), F.max("t_at").alias("last"))


def license_spans(hits: DataFrame) -> DataFrame:
    """Base places, merged and verified template spans, and one bare row per document; words [begin, end)."""
    order = Window.partitionBy("row", "base", "template").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK), 1).otherwise(0)
    merged = hits.withColumn("group", F.sum(apart).over(order)).groupBy(
        "row", "doc_id", "n", "label", "base", "template", "t_words", "t_grams", "group").agg(
        F.least(F.sum("votes"), F.max("t_grams")).alias("votes"), F.min(F.col("diagonal") + F.col("first")).alias("begin"),
        F.max(F.col("diagonal") + F.col("last") + K).alias("end"))
    coverage = F.coalesce(F.col("votes") / F.col("t_grams"), F.lit(0.0))
    fits = F.col("end") - F.col("begin") <= F.col("t_words") * 3 / 2
    good = F.when(F.col("base"), F.col("votes") == F.col("t_grams")).otherwise((coverage >= COVERAGE) & fits)
    return merged.withColumn("coverage", coverage).withColumn("accepted", F.coalesce(good, F.lit(False)))


def op3_license(spark, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    spans = license_spans(license_hits(table(spark, sf_dir, "documents").select("doc_id", "text")))
    place = F.when(F.col("base") & F.col("accepted"), F.col("begin"))
    def labels(keep):
        return F.array_join(F.array_sort(F.collect_set(F.when(keep & F.col("accepted"), F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n").agg(
        F.count(place).alias("n_base"), F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.lit(True)).alias("labels"), F.max("coverage").alias("score"),
    ).select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_VALUES = ", ".join(f"({base}, '{label}', '{text}')" for base, group in (("TRUE", PHRASES), ("FALSE", TEMPLATES)) for label, text in group)
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT *, string_split(template, ' ') AS tw FROM (VALUES {_VALUES}) AS v(base, label, template)),
tg AS (SELECT base, label, template, len(tw) AS t_words, len(tw) - 2 AS t_grams, unnest(generate_series(0, len(tw) - 3)) AS t_at, tw FROM t),
g AS (SELECT r, w, unnest(generate_series(0, len(w) - 3)) AS i FROM d WHERE len(w) >= 3),
hits AS (SELECT r, base, label, template, t_words, t_grams, i - t_at AS diagonal, count(*) AS votes, min(t_at) AS first, max(t_at) AS last
  FROM g JOIN tg ON w[i + 1] = tw[t_at + 1] AND w[i + 2] = tw[t_at + 2] AND w[i + 3] = tw[t_at + 3] GROUP BY ALL),
cut AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER o > {SLACK} THEN 1 ELSE 0 END AS apart FROM hits
  WINDOW o AS (PARTITION BY r, base, template ORDER BY diagonal)),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY r, base, template ORDER BY diagonal) AS grp FROM cut),
merged AS (SELECT r, base, label, template, t_words, t_grams, grp, least(sum(votes), max(t_grams)) AS votes, min(diagonal + first) AS b,
  max(diagonal + last + 3) AS e FROM grouped GROUP BY r, base, label, template, t_words, t_grams, grp),
judged AS (SELECT *, CASE WHEN base THEN votes = t_grams ELSE votes / t_grams >= {COVERAGE} AND e - b <= t_words * 1.5 END AS ok FROM merged),
sums AS (SELECT r, count(*) FILTER (base AND ok) AS n_base, min(b) FILTER (base AND ok) AS f, max(b) FILTER (base AND ok) AS l,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND ok) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS al,
  max(votes / t_grams) AS score FROM judged GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word,
  CAST(l AS BIGINT) AS last_word, coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN sums USING (r)
"""
