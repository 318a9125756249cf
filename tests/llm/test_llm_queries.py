"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

import math

import duckdb
import pytest

import corpus_pipeline
from heliofleet.llm import neardup, quality
from heliofleet.llm.queries import ORACLES, QUERIES
from heliofleet.llm.shared import table

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, D)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(names).collect())


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = table(spark, D, "documents")
    everything = {r.doc_id for r in docs.collect()}
    model = quality.train(docs, table(spark, D, "labels"))
    low = {r.doc_id for r in quality.scored(docs, model, ["doc_id"]).filter("score < 0.5").collect()}
    good = corpus_pipeline.keep_quality(spark, docs, D)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == everything - low
    one = corpus_pipeline.keep_one_of_near_copies(spark, good, D)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in neardup.near_duplicates(good).collect() if r.kept} and one.columns == docs.columns
    hits = {r.doc_id for r in QUERIES["op7_decontaminate"](spark, D).collect() if r.contaminated}
    clean = corpus_pipeline.drop_contaminated(spark, one, D)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - hits
    safe = corpus_pipeline.redact_secrets(spark, clean, D)
    assert safe.columns == docs.columns and {r.doc_id for r in safe.collect()} == {r.doc_id for r in clean.collect()}
    packed = corpus_pipeline.pack_sequences(spark, safe, D).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    assert len({r.sequence_id for r in packed}) <= math.ceil(1.05 * sum(r.length for r in packed) / 2048) + 1
    assert len(corpus_pipeline.run(spark, D).collect()) == len(packed)


def test_stages_on_no_documents(spark):
    docs = table(spark, D, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0
