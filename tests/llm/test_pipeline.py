"""The stages against a brute-force version of what they promise."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F
from tallypost.llm.staging import written

FOLDER = "/root/testdata/sf0.001"


def grams(text, n):
    w = text.lower().encode().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_stages(spark, table):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.columns == columns
        kept[name] = docs.collect()
    before = {r["doc_id"]: r["text"] for r in kept["toxicity"]}
    labels = {r["doc_id"]: r["toxic"] for r in table("labels")}
    assert all(i in before for i, toxic in labels.items() if toxic == 0)

    ids = sorted(before)
    sets = {i: grams(before[i], 5) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == [i for i in ids if find(i) == i]

    first, expected = {}, {}
    for i, text in sorted((r["doc_id"], r["text"]) for r in kept["near_duplicates"]):
        w = text.encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), i) < i:
                gone[p : p + 50] = [True] * 50
        expected[i] = " ".join(x.decode() for x, g in zip(w, gone) if not g) if any(gone) else text
    assert {r["doc_id"]: r["text"] for r in kept["substrings"]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substrings"])

    sizes, mixed = collections.Counter(), collections.Counter()
    for r in kept["substrings"]:
        sizes[r["source"]] += len(r["text"].encode().split())
    for r in kept["mixing"]:
        mixed[r["source"]] += len(r["text"].encode().split())
    from test_brute_force import targets

    assert {s: mixed[s] for s in sizes} == {s: round(t) for s, t in targets(sizes).items()}

    pieces = corpus_pipeline.packing(spark, docs, FOLDER)
    whole = pieces.where("start = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in whole} == collections.Counter(r["doc_id"] for r in kept["mixing"])


def test_stages_on_awkward_documents(spark, awkward, docs):
    """Nulls, empty and long texts, repeated rows, rows without id, clashing names; and no rows at all."""
    for rows in (awkward, docs([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns, n = rows.columns, rows.count()
            rows = written(stage(spark, rows, FOLDER), f"awkward-{name}")
            assert rows.columns == columns and (name == "mixing" or rows.count() <= n), name
            if name == "near_duplicates" and n:
                ids = [r["doc_id"] for r in rows.collect()]
                # 7 has the text of 6; rows of one id are one document; texts without words link with nothing
                assert sorted(ids, key=str) == sorted([1, 2, 3, None, 4, 4, 5, 6, 8, 9], key=str)
            if name == "mixing" and n:
                kept = {(r["doc_id"], r["score"], r["n_words"]) for r in rows.collect()}
                assert all(s == w == "own" for _, s, w in kept)
        pieces = corpus_pipeline.packing(spark, rows, FOLDER)
        assert pieces.where("length < 1").count() == 0 and (pieces.count() >= rows.count())
