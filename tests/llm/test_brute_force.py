"""Every operator query against a plain computation over the small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tallypost.llm.queries import QUERIES
from tallypost.llm.setjoin import Rule, link_components
from tallypost.llm.tokens import BYTE_BPE, WORD_BPE, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return text.encode().split()


def got(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in sorted(rows, key=lambda r: r["doc_id"])}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return lambda name: Tokenizer.from_file(tokenizer_path(name))


def test_substrings(spark, texts):
    first, expected = {}, {}
    for i, row in texts.items():
        w = words(row["text"])
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), i) < i:
                gone[p : p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        expected[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    rows = got(spark, "op1_substring_dedup")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == expected
    assert any(x[1] for x in expected.values())


def test_token_file(spark, texts, library):
    model, start, expected = library(BYTE_BPE), 0, {}
    for i, row in texts.items():
        ids = [*model.encode(row["text"], add_special_tokens=False).ids, 2]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = got(spark, "op3_token_file")
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == expected


def test_embedding_pairs(spark, table):
    rows = table("embeddings")
    by_label = collections.defaultdict(list)
    for r in rows:
        by_label[r["label"]].append(r)
    expected = {}
    for group in by_label.values():
        v = np.array([r["embedding"] for r in group], float)
        norm = np.linalg.norm(v, axis=1)
        near = (v @ v.T) / np.outer(norm, norm) >= 0.98
        np.fill_diagonal(near, False)
        comp = np.array([r["vec_id"] for r in group])
        for _ in range(len(comp)):
            new = np.array([min([comp[k], *comp[near[k]]]) for k in range(len(comp))])
            if (new == comp).all():
                break
            comp = new
        for k, r in enumerate(group):
            expected[r["vec_id"]] = (int(near[k].sum()), int(comp[k]), bool(comp[k] == r["vec_id"]))
    rows = got(spark, "op4_embedding_pairs")
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows} == expected


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, texts):
    sizes = collections.Counter()
    for row in texts.values():
        sizes[row["source"]] += len(words(row["text"]))
    target, taken = targets(sizes), collections.Counter()
    rows = got(spark, "op5_mixing")
    assert len(rows) == len(texts)
    for r in rows:
        row = texts[r["doc_id"]]
        assert r["size"] == len(words(row["text"])) and r["source_size"] == sizes[row["source"]]
        assert r["target"] == pytest.approx(target[row["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[row["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, got(spark, "op5_mixing")))


def test_token_counts(spark, texts, library):
    model = library(WORD_BPE)
    expected = {}
    for i, row in texts.items():
        n = len(model.encode(row["text"], add_special_tokens=False).ids)
        expected[i] = (len(row["text"].encode()), n, n > 2048)
    rows = got(spark, "op6_token_counts")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == expected


def test_licences(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in got(spark, "op7_licence_scan"):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]]["text"].encode().translate(FOLD))
        places = [
            (k, label) for k in range(len(w)) for p, label in phrases.items()
            if w[k : k + len(p.split())] == p.encode().split()
        ]
        starts, labels = [k for k, _ in places], {label for _, label in places}
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_packing(spark, texts, library):
    model = library(BYTE_BPE)
    ids = {i: [*model.encode(row["text"], add_special_tokens=False).ids, 0] for i, row in texts.items()}
    rows = got(spark, "op8_packing")
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for parts, end in [*((p, len(ids[i])) for i, p in by_doc.items()), *((p, None) for p in by_sequence.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == end if end else at <= 1024
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= total / 1024 * 1.02 + 2


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, texts, n, percent):
    sets = {}
    for i, row in texts.items():
        w = row["text"].encode().translate(FOLD).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = link_components(spark.read.parquet(f"{FOLDER}/documents.parquet"), Rule(n, percent)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(sets[i]), find(i)) for i in sets}
    assert any(find(i) != i for i in sets)


def test_quality(spark, texts):
    for r in got(spark, "op10_quality_rules"):
        text = texts[r["doc_id"]]["text"]
        w = words(text)
        runs = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        expected = (
            len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(twice), len(w) < 10 or 100 * len(twice) > 20 * len(w),
        )
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected
        assert r["kept"] == (not r["base_failed"] and not r["failed_rules"])


def test_toxicity_on_held_out_rows(spark, table):
    folder = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in table("labels", folder)}
    rows = QUERIES["op2_toxicity"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    found = sum(t and p for t, p in held) / sum(t for t, _ in held)
    assert found >= 0.9 and not any(p for t, p in held if not t)
