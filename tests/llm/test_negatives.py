"""Hard negatives against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from check_queries import compare
from tallypost.llm import negatives as N

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("rank", T.StringType()),
])


def plain(rows, every, positives=5, negatives=10, low=30, high=90):
    used = [
        (i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q, label in used:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j, other) for j, v, other in used if len(v) == len(q)))
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fits = [x for x in scored if x[2] != label and -low * s <= -100 * x[0] <= -high * s][:negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every, **kw):
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
    out = N.hard_negatives(df.repartition(3), F.col("vec_id") % every == 0, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def vectors(n, dims, seed, labels=3, scale=1.0):
    """Rows around a few directions, so that windows hold rows; coarse values, so that scores tie."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    v = np.float32(np.round((centres[rng.integers(0, 4, n)] + rng.normal(size=(n, dims))) * scale * 16) / 256)
    return [(int(i), [float(x) for x in v[i]], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("block, portion", [(8192, 16 << 20), (32, 4000), (7, 1)])
def test_equals_all_products(spark, monkeypatch, block, portion):
    monkeypatch.setattr(N, "BLOCK", max(8, block))
    monkeypatch.setattr(N, "PORTION_BYTES", portion)
    rows = vectors(300, 20, 1)
    expected = plain(rows, 10 if portion > 1 else 60)
    assert len(expected) > 100
    assert mined(spark, rows, 10 if portion > 1 else 60) == expected


def test_awkward_rows(spark):
    rows = vectors(60, 6, 2, labels=2)
    nan, inf = float("nan"), float("inf")
    rows += [
        (None, [1.0] * 6, 1), (200, None, 1), (201, [1.0] * 6, None), (202, [nan] + [1.0] * 5, 1), (203, [inf] + [1.0] * 5, 0),
        (204, [None] + [1.0] * 5, 0), (205, [], 0), (205, [], 1), (210, [], 0), (211, [0.5, 0.25], 0), (220, [0.5, 0.25], 0),
        (212, [0.25, 0.25], 1), (213, [0.0] * 6, 1), (214, [-0.001] * 6, 1), (-10, [0.3] * 6, 1), rows[3], rows[3], rows[20],
    ]
    assert mined(spark, rows, 10) == plain(rows, 10)
    assert mined(spark, rows, 10, positives=2, negatives=3, low=-50, high=100) == plain(rows, 10, 2, 3, -50, 100)


def test_nothing_to_mine(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)], 10) == []
    assert mined(spark, [(10, [1.0], 0), (2, [1.0], 1)], 10) == []


def test_scores_that_do_not_fit_are_an_error(spark):
    rows = [(10, [3e20, 1.0], 0), (11, [3e20, 1.0], 0)]
    with pytest.raises(Exception, match="does not fit into a long"):
        mined(spark, rows, 10)


def test_bounds_only_drop_rows_that_cannot_matter():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(500, 32)) * 40).astype(np.int64)
    block = N.Block(np.arange(500), np.zeros(500, np.int64), v.min(axis=0), v.max(axis=0), list(np.ascontiguousarray(v.T)))
    q = np.floor(rng.normal(size=32) * rng.choice([1, 30], 32)).astype(np.int64)
    exact = v @ q
    for wanted in ([(int(np.sort(exact)[-5]), None)], [(-50, 100), (2000, 2500)], [(None, -3000)], [(None, None)]):
        rows, scores = N.scan(block, q, np.arange(0, 500, 2), wanted)
        assert (scores == exact[rows]).all()
        fits = {
            int(i) for i in range(0, 500, 2)
            if any((lo is None or exact[i] >= lo) and (hi is None or exact[i] <= hi) for lo, hi in wanted)
        }
        assert set(rows.tolist()) == fits  # after the last column the bounds are the scores


def test_whole_table_equals_sql(spark):
    assert compare(spark, "op12_hard_negatives", "/root/testdata/sf0.01") is None
