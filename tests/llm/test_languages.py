"""The string kernel against its definition, and languages of held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallypost.llm import languages as L
from tallypost.llm.queries import QUERIES


def plain_runs(text):
    """Runs of 1 to 4 signs; what is no letter or mark is one gap."""
    import unicodedata

    signs = [" "]
    for c in text + " ":
        if unicodedata.category(c)[0] in "LM":
            signs.append(c.lower() if len(c.lower()) == 1 else c)
        elif signs[-1] != " ":
            signs.append(" ")
    return {tuple(signs[i : i + n]) for n in range(1, L.ORDERS + 1) for i in range(len(signs) - n + 1)} - {(" ",)}


TEXTS = ["Über die Straße, geht es!", "the cat; THE dog 12 sat", "él niño está aquí", "中文 和 English", "", " 123 ", "a", "é" * 9, "x́y"]


@pytest.mark.parametrize("piece", [1 << 18, 7, 3])
def test_spectrum(monkeypatch, piece):
    """As many runs as by the definition, alike where those are, wherever a text is cut."""
    monkeypatch.setattr(L, "_PIECE", piece)
    plain = [plain_runs(t) for t in TEXTS]
    found = [set(L.spectrum(t.encode()).tolist()) for t in TEXTS]
    assert [len(s) for s in found] == [len(s) for s in plain]
    assert [[len(a & b) for b in found] for a in found] == [[len(a & b) for b in plain] for a in plain]


def test_known_runs_are_found_once():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc de") for _ in range(rnd.randrange(3000))).encode() for _ in range(30)]
    known = np.unique(np.concatenate([L.spectrum(t) for t in texts[:5]]))
    find = L.Runs(known)
    for t in texts:
        numbers, letters = find.present(t)
        assert len(set(numbers.tolist())) == len(numbers) and letters == any(65 <= c for c in t)
        assert set(known[numbers].tolist()) == set(known.tolist()) & set(L.spectrum(t).tolist())
    assert len(L.Runs(np.zeros(0, np.uint64)).numbers(known)) == 0


def test_folded_product_is_the_kernel_expansion():
    """Scores are the sum over landmarks of coefficient times kernel."""
    rng = np.random.default_rng(1)
    presence = (rng.random((400, 12)) < 0.2).astype(np.float32)
    norms = np.sqrt(presence.sum(axis=0))
    rows = [np.flatnonzero(rng.random(400) < 0.1) for _ in range(20)] + [np.zeros(0, np.int64)]
    coefficients = rng.normal(size=(12, 3))
    model = L.Classifier(["a", "b", "c"], np.arange(400, dtype=np.uint64), (presence @ (coefficients / norms[:, None])).astype(np.float32))
    values = L.kernel(rows, presence, norms)
    assert np.allclose(model.outputs(rows), values @ coefficients, atol=1e-4)
    for i, r in enumerate(rows):
        for j in range(12):
            own = set(np.flatnonzero(presence[:, j]).tolist())
            assert np.isclose(values[i, j], len(own & set(r.tolist())) / np.sqrt(max(1, len(r)) * len(own)), atol=1e-6)


def test_regression_fits_separable_classes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 5)) + 4 * np.eye(5)[k] for k in range(3)])
    y = np.repeat(np.eye(3), 40, axis=0)
    grams = x[::10] @ x[::10].T
    out = (x @ x[::10].T) @ L.regress(x @ x[::10].T, grams, y)
    assert (out.argmax(axis=1) == y.argmax(axis=1)).mean() > 0.95


def test_held_out_rows(spark, table):
    folder = "/root/testdata/sf0.1"
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in table("documents", folder)}
    rows = QUERIES["op11_language_id"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]][0] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in held) >= 0.97 * len(held) > 1000


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "ab ba abba " * 3 if i % 2 else "xy yx xyyx " * 3, ("one", "two")[i % 2]) for i in range(60)]
    held = [(i, "pq qp " * 5, "three") for i in range(60, 400) if zlib.crc32(str(i).encode()) % 4 == 2]
    out = L.identify(spark.createDataFrame(rows + held, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in out} <= {"one", "two"}
    assert all(r["lang_pred"] == r["lang"] for r in out if r["doc_id"] < 60)


def test_awkward_documents(spark, awkward, docs):
    out = L.identify(awkward.withColumn("lang_pred", F.lit(7)))
    assert out.count() == 11 and out.columns.count("lang_pred") == 1
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3))
    assert all(by_id[i]["lang_pred"] == "en" for i in (4, 5, 6, 7, 8, 9)) and by_id[6]["n_words"] == "own"
    assert by_id[None]["lang_pred"] == "en" and by_id[None]["held_out"] is False
    assert L.identify(docs([])).count() == 0
    unknown = L.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}


def test_a_language_with_a_third_of_all_rows_in_copies(spark):
    rows = [(i, "copy of one text", "en") for i in range(500)]
    rows += [(i, f"quelques mots {i} encore", "fr") for i in range(500, 700)] + [(i, f"ein paar wörter {i}", "de") for i in range(700, 705)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = L.sample(df, 30).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in chosen} == {"en": 1, "fr": 10, "de": 5}
    assert all(r["lang_pred"] == r["lang"] for r in L.identify(df, fit_rows=60, landmarks=9).collect())
