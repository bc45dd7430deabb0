"""Signatures of the set similarity join against what they must find, on random sets."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from tallypost.llm.setjoin import Rule, _fine, coarse_signatures, fine_signatures, link_components


def links(rule, small, large):
    """All ways to take `small` and `large` apart that still link, as (shared, only left, only right)."""
    for both in range(small + 1):
        if 100 * both >= rule.percent * (small + large - both):
            yield both, small - both, large - both


@pytest.mark.parametrize("n, percent, sizes, tries", [
    (5, 80, [(11, 13)], 20_000), (5, 80, [(s, b) for s in range(4, 26) for b in range(s, s * 5 // 4 + 1)], 150),
    (3, 90, [(s, b) for s in range(9, 42) for b in range(s, s * 10 // 9 + 1)], 150),
])
def test_linking_sets_share_a_coarse_signature(n, percent, sizes, tries):
    rule, rng, missed = Rule(n, percent), np.random.default_rng(7), []
    for small, large in sizes:
        for both, left, right in links(rule, small, large):
            if left + right == 0:
                continue
            for _ in range(tries):
                tokens = rng.integers(0, 1 << 64, both + left + right, np.uint64, endpoint=False)
                x, y = tokens[: both + left], np.concatenate([tokens[:both], tokens[both + left :]])
                if not np.intersect1d(coarse_signatures(rule, x), coarse_signatures(rule, y)).size:
                    missed.append((small, large, both))
    assert not missed


def test_fine_rows_of_a_huge_set():
    rule, rng = Rule(3, 90), np.random.default_rng(7)
    tokens = rng.integers(-(1 << 63), 1 << 63, 4_600_000, np.int64)
    schemes = fine_signatures(rule, tokens.view(np.uint64))
    assert [s[0] for s in schemes] == [128, 127]
    batch = pa.record_batch([pa.array([5], pa.int64()), pa.array([tokens], pa.list_(pa.int64()))], names=["id", "tokens"])
    (out,) = _fine(rule)([batch])
    assert out.schema.types == [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    at = 0
    for band, _, need, taken, named, _ in schemes:
        rows = out.slice(at, len(taken))
        assert pa.compute.unique(rows.column("band")).to_pylist() == [band]
        assert pa.compute.unique(rows.column("record")).to_pylist() == [need << 32 | len(taken)]
        assert (rows.column("sig").to_numpy().view(np.uint64) == named).all()
        at += len(taken)
    assert at == out.num_rows


def test_texts_and_the_same_with_two_words_more(spark):
    rows = []
    for i in range(2000):
        own = [f"w{i}x{k}" for k in range(17)]
        rows += [(2 * i, " ".join(own[:15])), (2 * i + 1, " ".join(own))]
    out = link_components(spark.createDataFrame(rows, "doc_id long, text string"), Rule(5, 80)).collect()
    assert len(out) == len(rows)
    assert [r.doc_id for r in out if r.component_id != r.doc_id - r.doc_id % 2] == []


def test_hot_segments_and_blocks_lose_no_link(spark):
    """Small limits send sets through neighbourhoods and several blocks: the components stay the same."""
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(8, 60))] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(50)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = Rule(3, 90)
    sets = {i: {tuple(t.split()[k : k + rule.n]) for k in range(len(t.split()) - rule.n + 1)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= rule.percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    expected = {i: find(i) for i in sets}
    assert any(i != r for i, r in expected.items())
    for hot, block in ((32, 512), (1, 3)):
        assert {r["doc_id"]: r["component_id"] for r in link_components(docs, rule, hot=hot, block=block).collect()} == expected
