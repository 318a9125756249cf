"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Every stage takes all its predecessor kept. Filters keep every column of documents; the secret stage changes ``text`` and
``n_chars`` where it replaces a live-looking secret and keeps every row; the last returns pieces with their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliofleet.llm import decontaminate, neardup, packing, quality, secrets
from heliofleet.llm.shared import fresh, new_path, table
from heliofleet.llm.tokens import default_vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored below the threshold by the pairwise ranking model."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "score")
    return quality.scored(docs, model, docs.columns, score).filter(F.col(score) >= 0.5).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of every group of near copies; repeated rows are kept once."""
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    found, (n_words, hit, _) = decontaminate.contamination(docs, decontaminate.windows_of(table(spark, sf_dir, "benchmark")), docs.columns)
    return found.filter(~decontaminate.is_contaminated(n_words, hit)).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking secrets in the text."""
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences."""
    return packing.pack(docs, default_vocabulary())


STAGES = [("quality classifier", keep_quality), ("near-duplicates", keep_one_of_near_copies), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack_sequences)]

ORACLE_SQL = None  # scores and packing are not expressible in SQL; the tests hold the run against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
