"""Cover trees against all cosines: planted links, many levels, many numbers of components."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallypost.llm import covertree as C

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows, threshold):
    unit = {}
    for i, v, label in rows:
        if v and label is not None and i is not None and any(v):
            unit.setdefault((label, len(v)), []).append((i, np.array(v) / np.linalg.norm(v)))
    root, links = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for group in unit.values():
        points = np.array([p for _, p in group])
        for k, (i, _) in enumerate(group):
            for m in np.flatnonzero(points @ points[k] >= threshold).tolist():
                if m != k:
                    links[i] = links.get(i, 0) + 1
                    a, b = find(i), find(group[m][0])
                    root[max(a, b)] = min(a, b)
    return {i: (links.get(i, 0), find(i)) for i, _, _ in rows}


def planted(n, dim, seed, labels=("a", "b")):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dim))
    v = centres[rng.integers(0, len(centres), n)] + rng.choice([0.0, 0.02, 0.1, 0.4], n)[:, None] * rng.normal(size=(n, dim))
    return [(int(i), v[i].tolist(), labels[int(rng.integers(0, len(labels)))]) for i in range(n)]


@pytest.mark.parametrize("block, fan", [(1024, 64), (64, 4), (16, 3)])
def test_equals_all_cosines(spark, monkeypatch, block, fan):
    monkeypatch.setattr(C, "FAN", fan)
    rows = planted(1500, 12, 3)
    expected = plain(rows, 0.98)
    assert sum(n for n, _ in expected.values()) > 1000 and sum(i != r for i, (_, r) in expected.items()) > 300
    out = C.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_nodes_split_level_by_level(spark, monkeypatch):
    """Leaves are small, cover their vectors, and far ones do not meet."""
    monkeypatch.setattr(C, "FAN", 3)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 6))
    v = centres[rng.integers(0, 40, 1200)] + 0.01 * rng.normal(size=(1200, 6))
    df = spark.createDataFrame([(i, 1, 6, x.tolist(), "t", 2.0) for i, x in enumerate(v)], "id long, copies long, dim int, vector array<double>, node string, away double")
    placed, pairs = C._traversed(C.written(df, "test-nodes"), 0.2, 20)
    sizes = {r["node"]: r["n"] for r in placed.groupBy("node").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 1200 and max(node.count(".") for node in sizes) >= 3
    met = {(r["node1"], r["node2"]) for r in pairs.collect()}
    assert all((n, n) in met for n in sizes) and len(met) < len(sizes) * (len(sizes) + 1) / 4


def test_vectors_too_close_to_part(spark):
    """More distinct vectors around one point than a block holds: blocks by hash."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=5)
    rows = [(i, (base + 1e-9 * i).tolist(), "a") for i in range(150)] + [(1000 + i, (-base * (i + 1)).tolist(), "a") for i in range(3)]
    out = C.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == plain(rows, 0.98)


def test_more_numbers_of_components_than_a_thousand(spark):
    rows = [(3 * d + k, [float(k == 0 or i % 7) for i in range(d)], "a") for d in range(1, 1102) for k in range(2)]
    out = C.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == plain(rows, 0.98)


def test_repeated_ids_have_the_links_of_all_their_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (2, [0.0, 1.0], "a"), (3, [0.01, 1.0], "a"), (4, [-1.0, 0.0], "a")]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in C.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1] == (1, 1) and out[3] == (1, 1) and out[2][1] == 1 and out[4] == (0, 4)


def test_nearest_child_is_found_over_batches():
    """Centres come once, before the vectors of their node and salt, whatever batches they come in."""
    rng = np.random.default_rng(0)
    points, centres = rng.normal(size=(9, 3)), rng.normal(size=(2, 3))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [{"id": None, "copies": None, "dim": 3, "vector": None, "node": "n", "away": None, "salt": 0, "centres": centres.tobytes()}]
    rows += [{"id": i, "copies": 1, "dim": 3, "vector": p.tolist(), "node": "n", "away": 2.0, "salt": 0, "centres": None} for i, p in enumerate(points)]
    rows += [{"id": 9, "copies": 1, "dim": 3, "vector": [1.0, 0.0, 0.0], "node": "o", "away": 0.5, "salt": 0, "centres": None}]
    kinds = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("dim", pa.int32()), ("vector", pa.list_(pa.float64())),
                       ("node", pa.string()), ("away", pa.float64()), ("salt", pa.int32()), ("centres", pa.binary())])
    for size in (1, 4, 20):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], kinds) for i in range(0, len(rows), size)]
        out = [r for b in C._children(iter(batches)) for r in b.to_pylist()]
        unit = points / np.linalg.norm(points, axis=1)[:, None]
        best = np.argmax(unit @ centres.T, axis=1)
        assert [r["node"] for r in out] == [*(f"n.{k}" for k in best), "o"] and out[-1]["away"] == 0.5
