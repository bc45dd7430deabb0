"""What a worker holds at once does not follow the number of rows; and the sample of labelled rows is the same for it."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallypost.llm import toxicity
from tallypost.llm.staging import BATCH_BYTES, prepared


def test_batches_are_bound_in_bytes(spark):
    prepared(spark)
    rows = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("some words "), 400).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    n = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(n) > 8000 * 4400 and max(n) < BATCH_BYTES + 10_000


def test_a_bound_of_the_session_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1000000")
    try:
        prepared(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)


def test_memory_of_scoring_and_counting():
    text = "plain w0rds and s.o.m.e words (which hide) nothing at all, " * 20
    batch = pa.record_batch([pa.array([text] * 3500)], names=["_text"])
    model = toxicity.character_model(np.zeros(toxicity._SYMBOLS**3))
    classifier = toxicity.Classifier(np.zeros(1, np.uint64), ["loser"], np.ones(1), 1.0, 0.0, 0.0)
    for run in (toxicity._trigrams, toxicity._scored(model, classifier)):
        list(run([batch.slice(0, 500)]))  # tables that stay
        tracemalloc.start()
        try:
            out = list(run([batch]))
            _, peak = tracemalloc.get_traced_memory()
        finally:
            tracemalloc.stop()
        assert out and peak < 24e6, (run, peak)


def test_first_rows(spark):
    rows = [(h, t, f"{h}") for h in (-5, 3, 3, 3, 3, 9, -5, 7) for t in (0, 1)]
    table = spark.createDataFrame(rows, "_hash long, toxic int, _text string").repartition(3).localCheckpoint()
    for most in range(len(rows) + 2):
        first = toxicity.first_rows(table, most)
        assert sorted(tuple(r) for r in first.collect()) == sorted(rows)[:most], most


def test_sample_is_cut_at_repeated_rows(spark, docs):
    """One id with many rows: the words of the sample's rows count as often as before, and no text is sorted."""
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, toxic int")
    rows = docs([(i, f"{'loser ' if i % 2 else ''}text {i % 7}") for i in range(1, 41) for _ in range(1 + 9 * (i == 7))])
    _, whole = toxicity.train(rows, marks, "doc_id", "text", "toxic", 1000)
    _, cut = toxicity.train(rows, marks, "doc_id", "text", "toxic", 32)
    known = [i for i in range(1, 41) if rows.sparkSession.range(1).select(~toxicity.held_out(F.lit(i))).first()[0]]
    assert len(known) > 32 - 9 and "loser" in whole.words
    chosen = marks.where(F.col("doc_id").isin(known)).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(32)
    kept = rows.join(chosen, "doc_id").select("toxic", "text").orderBy(F.xxhash64("text"), "toxic").limit(32).collect()
    toxic, p, n = sum(r["toxic"] and "loser" in r["text"] for r in kept), sum(r["toxic"] for r in kept), len(kept)
    assert cut.words == ["loser"]
    assert np.allclose(cut.weights, toxicity.word_weight(np.array([float(toxic)]), np.zeros(1), p, n))
