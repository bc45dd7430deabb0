"""Nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from tallypost.llm import ans, covertree, packing, rules, toxicity
from tallypost.llm.components import components
from tallypost.llm.counting import count_tokens, huge_count
from tallypost.llm.covertree import near_duplicates
from tallypost.llm.licences import scan_licences
from tallypost.llm.mixing import mix_sources, mixed_rows, word_count
from tallypost.llm.packing import pack
from tallypost.llm.rules import quality_rules
from tallypost.llm.setjoin import Rule, link_components
from tallypost.llm.substrings import substring_dedup
from tallypost.llm.text import slices
from tallypost.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, blank_units, tokenizer_path, word_units
from tallypost.llm.toxicity import score_toxicity


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def runs(spark, docs):
    """Each operator over documents, by name."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    return {
        "substrings": substring_dedup(docs), "toxicity": score_toxicity(docs, labels(spark)),
        "mixing": mix_sources(sized), "counts": count_tokens(docs), "licences": scan_licences(docs),
        "packing": pack(docs), "jaccard": link_components(docs, Rule(3, 90)), "quality": quality_rules(docs, labels(spark)),
    }


def test_no_documents(spark, docs):
    for name, out in runs(spark, docs([])).items():
        assert out.count() == 0, name


def test_awkward_documents(spark, awkward):
    n = awkward.count()
    out = {name: df.collect() for name, df in runs(spark, awkward).items()}
    for name, rows in out.items():
        assert name == "packing" or len(rows) == n, name
    by_id = {r["doc_id"]: r for r in out["substrings"]}
    assert by_id[7]["n_removed"] == 40_000 and by_id[7]["text"] == "" and by_id[6]["n_removed"] == 0
    assert by_id[1]["text"] is None and by_id[4]["n_removed"] == 0 and by_id[None]["n_removed"] == 0
    assert by_id[6]["n_words"] == 40_000 and by_id[6]["score"] == "own"
    links = {r["doc_id"]: r["component_id"] for r in out["jaccard"]}
    assert links[7] == 6 and links[2] == 2 and links[1] == 1 and links[None] is None and links[4] == 4
    assert {r["doc_id"]: r["n_tokens"] for r in out["counts"]}[1] == 0
    assert not any(r["predicted"] for r in out["toxicity"])
    assert all(r["base_failed"] for r in out["quality"] if r["doc_id"] in (1, 2, 3, 4, 9))
    assert all(r["n_words"] == 0 and r["labels"] == "" for r in out["licences"] if r["doc_id"] in (1, 2, 3))
    assert sum(r["doc_tokens"] == 1 for r in out["packing"]) == 2
    assert sum(r["taken"] for r in out["mixing"]) == sum(r["size"] for r in out["mixing"])


def test_token_file_round_trip(spark, awkward, tmp_path):
    path = f"file://{tmp_path}/tokens"
    ans.write_token_file(awkward, path)
    rows = sorted(ans.read_token_file(spark, path).collect(), key=lambda r: r["start"])
    model = Encoder(tokenizer_path(BYTE_BPE))._tokenizer
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    at = 0
    for r in rows:
        ids = [*model.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    assert [r["doc_id"] for r in rows][:3] == [None, 1, 2] and len(rows) == 11


def test_token_file_of_nothing(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    ans.write_token_file(docs([]), path)
    assert ans.read_token_file(spark, path).count() == 0


def test_mix_of_rows_that_share_or_lack_ids(spark, docs):
    """Rows of one id, or of none, share a key: each is told apart by its size, and targets are met to the word."""
    rows = [(None, "w " * 40)] * 6 + [(7, "w " * k) for k in (3, 3, 50, 0)] + [(i, "w " * 5) for i in range(20, 40)]
    df = docs(rows).withColumn("source", F.when(F.col("doc_id") < 30, "a")).withColumn("size", word_count(F.col("text")))
    for n in (4, 1 << 20):
        mixed = mix_sources(df, rows=n)
        assert mixed.count() == len(rows)
        by_source = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 3 * F.col("size")).alias("m")).collect()
        assert all(r["t"] == round(r["g"]) and r["m"] <= 0 for r in by_source)


@pytest.mark.parametrize("n", [0, 1, 1023, 1025, 5000])
def test_segment_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=50_256).astype(np.uint32)
    row = {"part": 0, "segment": 0, **ans.encode_segment(ids, block=2048, lanes=64)}
    assert ans.decode_segment(row).tolist() == ids.tolist()


def test_damaged_block_is_seen():
    row = {"part": 0, "segment": 0, **ans.encode_segment(np.arange(3000, dtype=np.uint32) % 7, block=1024, lanes=16)}
    row["checksums"] = [row["checksums"][0] ^ 1, *row["checksums"][1:]]
    with pytest.raises(ValueError, match="checksum"):
        ans.decode_segment(row)


def test_units_give_the_ids_of_the_whole_text():
    pieces = ["word", " ", "\n", "\t ", " ", " ", "it's", "é́", "中", "12", "...", "<|endoftext|>", "\x1c", "\x85"]
    for name, units in ((BYTE_BPE, blank_units), (WORD_BPE, word_units)):
        model, rng = Encoder(tokenizer_path(name)), random.Random(1)
        texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)]
        for s in slices(pa.array(texts)):
            flat, counts = model.ids(s, units(s))
            for text, ids in zip(texts[s.row :], np.split(flat, np.cumsum(counts)[:-1])):
                assert ids.tolist() == model._tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_letters_end_before_stops():
    """A word is learned once whatever sign follows it, and the ids are those of the whole text."""
    model, rng = Encoder(tokenizer_path(BYTE_BPE)), random.Random(4)
    pieces = ["a", "Ö", "ñ", "×", "÷", "ж", "ª", "\u0300", " ", " ", "\n", "'", "'s", "1", *".,;:!?#$%&*", "<|endoftext|>", "|"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)] + [None, "", ".", "é."]
    for s in slices(pa.array(texts)):
        flat, counts = model.ids(s, model.units(s))
        for text, ids in zip(texts[s.row :], np.split(flat, np.cumsum(counts)[:-1])):
            assert ids.tolist() == model._tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
    model = Encoder(tokenizer_path(BYTE_BPE))
    [s] = slices(pa.array([" señor señor, señor. señor!", " señor señor? señor;"]))
    model.ids(s, model.units(s))
    assert len(model._first) - 1 == 6  # the word and five signs
    assert Encoder(tokenizer_path(WORD_BPE))._stop is None


def test_chunks_of_huge_texts():
    model, rng = Encoder(tokenizer_path(WORD_BPE)), random.Random(2)
    for _ in range(40):
        text = " ".join("abé中"[rng.randint(0, 3)] * rng.randint(1, 90) for _ in range(rng.randint(0, 60)))
        whole = len(model._tokenizer.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((50, 4), (200, 30)):
            assert huge_count(model, text, chunk, overlap) == whole


HUGE = {
    "letters": lambda rng: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)),
    "one letter": lambda rng: "z" * 300_000,
    "two letters": lambda rng: "ab" * 150_000,
    "ideographs": lambda rng: "".join(rng.choice("中文字符没有空白的很长文本") for _ in range(100_000)),
    "base64": lambda rng: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000)),
    "contractions": lambda rng: "'" .join(rng.choice(["don", "t", "s", "re", "'ll", "it", " we", "X"]) for _ in range(60_000)),
    "marks": lambda rng: "".join(rng.choice(["é", "e\u0301", "İ", "Σ", "🙂", "👨\u200d👩", "ß", " "]) for _ in range(60_000)),
    "special": lambda rng: "".join(rng.choice(["<|endoftext|>", "<|endoftext", "|>", "word ", "<|startoftext|>"]) for _ in range(30_000)),
    "blanks": lambda rng: "a" + " \n" * 100_000 + "b" + "\t" * 70_000,
}


@pytest.mark.parametrize("kind", HUGE)
def test_chunks_agree_with_the_library(kind):
    """Texts without blanks, and such as a cut changes most: as many ids as the library gives for the whole."""
    model, text = Encoder(tokenizer_path(WORD_BPE)), HUGE[kind](random.Random(3))
    whole = len(model.encode(text).ids)
    assert huge_count(model, text) == whole
    assert huge_count(model, text[:20_000], 700, 20) == len(model.encode(text[:20_000]).ids)


def test_ten_megabytes_without_blanks():
    """Chunks begin at id boundaries, so that a chunk is encoded about once."""
    model, text = Encoder(tokenizer_path(WORD_BPE)), "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzéß", k=10_000_000))
    sizes = []
    encode = model.encode
    model.encode = lambda t: (sizes.append(len(t)), encode(t))[1]
    n = huge_count(model, text)
    assert sum(sizes) < 1.2 * len(text) and max(sizes) < 100_000
    half = text.index("z", 5_000_000)
    assert abs(n - huge_count(model, text[:half]) - huge_count(model, text[half:])) <= 8


def test_overlap_is_widened_until_there_is_a_run(monkeypatch):
    """A run longer than the overlap holds makes it grow, up to the text's end if need be."""
    from tallypost.llm import counting

    model, text = Encoder(tokenizer_path(WORD_BPE)), " ".join(f"word{i}" for i in range(3000))
    whole = len(model.encode(text).ids)
    for run in (8, 300, 100_000):
        monkeypatch.setattr(counting, "RUN", run)
        assert huge_count(model, text, 1000, 10) == whole


def test_packing_plan_holds_what_is_asked():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        demand = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 1025, n), return_counts=True))}
        made = {}
        for pattern, times in packing.plan(demand):
            assert sum(k * v for k, v in pattern.items()) <= 1024
            for k, v in pattern.items():
                made[k] = made.get(k, 0) + v * times
        assert made == demand


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500 + i, 7) for i in range(50)] + [(None, 3), (4, 4)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 161)}, **{500 + i: 7 for i in range(50)}, 7: 7}


@pytest.mark.parametrize("nodes, links, chunk", [(300, 150, 7), (300, 290, 64), (60, 400, 1), (2000, 2100, 1 << 18)])
def test_components_of_random_graphs(spark, nodes, links, chunk):
    rnd = random.Random(nodes + links)
    edges = [(rnd.randrange(nodes) - 50, rnd.randrange(nodes) - 50) for _ in range(links)]
    edges += [(b, a) for a, b in edges[::5]] + [(5000 + i, 4000 + i % 3) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(5), chunk=chunk).collect()
    assert sorted((r["node"], r["root"]) for r in rows) == sorted((x, find(x)) for x in list(root))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_take_few_tasks(spark):
    """Stars that share nodes, over many shuffle partitions: each half of a round deals the edges out once."""
    edges = [(100 + i, i % 4) for i in range(300)] + [(100 + i, 4 + i % 4) for i in range(0, 300, 50)]
    rows = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "1g"}
    before = {key: spark.conf.get(key, None) for key in held}
    tracker = spark.sparkContext.statusTracker()
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        spark.sparkContext.setJobGroup("few-tasks", "components")
        components(rows)
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few-tasks")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    stages = {s for j in jobs for s in j.stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert 64 < tasks < 8 * 64


def test_vectors(spark):
    kind = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()), T.StructField("n_links", T.StringType()),
    ])
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
        (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [1.0, float("nan")], 1), (10, [], 1),
        (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [0.0, 1.0], 1),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], kind)
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[3] == (2, 1, False)
    assert all(out[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and out[None][:2] == (0, None)
    assert near_duplicates(df.limit(0)).count() == 0


def test_dual_traversal_finds_all_pairs():
    rng = np.random.default_rng(5)
    for n, noise in ((1, 0.1), (300, 0.02), (300, 0.3)):
        base = rng.normal(size=(max(1, n // 20), 16))
        points = base[rng.integers(0, len(base), n)] + noise * rng.normal(size=(n, 16))
        points /= np.linalg.norm(points, axis=1)[:, None]
        p, q = covertree.close_pairs(points, points[: n // 2 + 1], 0.98)
        assert set(zip(p.tolist(), q.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(points @ points[: n // 2 + 1].T >= 0.98))))


def test_mix_has_whole_epochs_and_one_cut(spark, docs):
    rows = docs([(i, "w " * (i % 7)) for i in range(60)]).withColumn("source", F.when(F.col("doc_id") < 3, "a").when(F.col("doc_id") < 40, "b"))
    mixed = mix_sources(rows.withColumn("size", word_count(F.col("text"))), rows=8).cache()
    by_source = {r["source"]: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    assert all(r["t"] == round(r["g"]) for r in by_source.values()) and set(by_source) == {"a", "b", None}
    out = mixed_rows(mixed)
    assert out.select(F.sum(word_count(F.col("text")))).first()[0] == sum(r["t"] for r in by_source.values())
    assert "epochs" in out.columns


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10, 0.1), (3, 100, 0.1), (0, 5000, 0.01), (30, 5000, 0.01), (60, 5000, 0.01), (0, 0, 0.5), (5, 5, 0.5)]
    for k, n, p in cases:
        exact = 1.0 if n == 0 or k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def test_rules_need_enough_good_documents(spark, docs):
    good = docs([(i, f"plain words {i} and some more of them to be long enough here") for i in range(50)])
    out = quality_rules(good, labels(spark, [(i, 1, 0) for i in range(50)]))
    assert out.where("kept").count() == 50


def test_the_verdict_keeps_its_promise(spark):
    """Over many draws of labels the steps taken reject more than alpha of the good no more often than delta."""
    alpha, delta, draws, size = 0.05, 0.1, 400, 300
    rng = np.random.default_rng(8)
    # how likely it is that a good document is rejected by a step for the first time
    share = np.array([0.0] * 6 + [0.004] * 10 + [0.01] * 14)
    true = np.cumsum(share)
    steps = rng.choice(31, size=(draws, size), p=[*share, 1 - share.sum()])
    rows = [(f"s{d}", None if x == 30 else int(x), d * size + i) for d in range(draws) for i, x in enumerate(steps[d].tolist())]
    good = spark.createDataFrame(rows, "lang string, step int, text long")
    held = rules.controlled_steps(good, "lang", "step", "text", alpha, delta, strata=1).collect()
    over = sum(true[r["step"]] > alpha for r in held) / draws
    assert over <= delta + 0.03 and len(held) > draws / 2 and np.mean([true[r["step"]] for r in held]) > 0.01
    # all draws as the strata of one table: the chance that any is over is below delta
    held = rules.controlled_steps(good, "lang", "step", "text", alpha, delta).collect()
    assert sum(true[r["step"]] > alpha for r in held) == 0


def test_steps_against_a_plain_computation(spark):
    from math import comb

    rng = np.random.default_rng(2)
    rows = [(lang, None if x > 29 else int(x), i) for lang, n in (("a", 900), ("b", 60), (None, 400)) for i, x in enumerate(rng.integers(0, 2000, n))]
    rows += rows[:500]  # copies are no trials
    held = {r["stratum"]: (r["step"], r["n_good"], r["n_rejected"]) for r in rules.controlled_steps(
        spark.createDataFrame(rows, "lang string, step int, text long"), "lang", "step", "text", 0.02, 0.05).collect()}
    expected = {}
    for lang in ("a", "b", None):
        own = {t: s for stratum, s, t in rows if stratum == lang}
        n, best = len(own), None
        for step in range(30):
            k = sum(s is not None and s <= step for s in own.values())
            tail = 1.0 if k >= n * 0.02 else sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))
            if tail * 3 <= 0.05:
                best = (step, n, k)
        if best:
            expected[lang or ""] = best
    assert held == expected and "a" in held and "b" not in held


def test_first_steps_follow_the_order(spark):
    columns = {"word_chars": 100, "n_symbols": 0, "n_capitals": 0, "n_repeat_words": 0, "n_words": 20, "n_dup_lines": 0, "n_lines": 10}
    df = spark.createDataFrame([tuple(columns.values()), (100, 60, 0, 0, 20, 0, 10), (100, 4, 25, 0, 20, 0, 10), (0, 0, 0, 0, 0, 0, 0), (400, 0, 0, 3, 20, 0, 10)],
                               ", ".join(f"{c} long" for c in columns))
    got = [tuple(r) for r in df.select(*[c.alias(r) for r, c in rules.first_steps().items()]).collect()]
    assert got == [(None,) * 5, (0, None, None, None, None), (None, 26, None, None, None), (None,) * 5, (None, None, 27, None, 24)]


def test_disguises_are_read(spark, docs):
    rng = random.Random(4)
    plain = "the and that with loser idiot trash moron clown stupid pathetic there where other".split()
    texts = [" ".join(rng.choices(plain, k=30)) for _ in range(300)]
    model, _ = toxicity.train(docs(list(enumerate(texts))), labels(spark), "doc_id", "text", "toxic", 100)
    restorer = toxicity.Restorer(model, ["loser", "idiot", "trash", "moron", "clown", "stupid", "pathetic", "中文"])
    hidden = {
        "1d10t": "idiot", "l0ser": "loser", "m o r o n": "moron", "clooooown": "clown", "$tup1d": "stupid", "p-a-t-h-e-t-1-c": "pathetic",
        "st*pid": "stupid", "iidiott": "idiot", "st0p1d": "stupid", "mmoorroonn": "moron", "you-1diot": "you-idiot", "(idi0t)": "(idiot)",
        "m  o  r\no  n": "moron", "a m o r o n b": "a moron b", "st.upid": "stupid", "t*r*a*s*h": "trash", "tra$h": "trash", "id1ot!!": "idiot!!",
        "m.o.r.o.n": "moron", "cl0wn.": "clown.", "st**id": "stupid", "lo$er": "loser", "1D1OT": "idiot",
    }
    for token, word in hidden.items():
        assert restorer.text(f"the {token} there") == f"the {word} there", token
    for plain in ("the 2024 a a a von!! x", "", "*", "a * b", "€", "loser", "中文", "10 0 1 2", "other there"):
        assert restorer.text(plain) == plain


def test_contradicting_null_and_lone_labels(spark, docs):
    """An id with both labels is learned as both; null labels and labels of nothing teach nothing."""
    rows = [(i, f"some plain words number {i} " + ("nasty scum here" if i % 2 else "and a nice day")) for i in range(1, 120)]
    marks = [(i, 1, i % 2) for i in range(1, 120)] + [(5, 1, 0), (6, 1, None), (7, 1, 7), (9999, 1, 1), (None, 1, 1), (8, 1, 0), (8, 1, 0)]
    out = {r["doc_id"]: r for r in score_toxicity(docs(rows), labels(spark, marks)).collect()}
    assert sum(r["predicted"] == i % 2 for i, r in out.items()) >= 118
    every = score_toxicity(docs(rows), labels(spark, [(i, 1, 1) for i in range(1, 120)]))
    assert {r["predicted"] for r in every.collect()} == {1}


def test_a_row_does_not_testify_for_itself():
    toxic, other = np.array([4.0, 1.0]), np.array([0.0, 0.0])
    with_, without = toxicity.word_weight(toxic, other, 10, 100), toxicity.word_weight(toxic - 1, other, 9, 99)
    assert (with_ > without).all() and (without >= 0).all()


def test_character_counts_are_by_word():
    """Texts and words do not run into each other; a word begins behind two gaps."""
    out = next(toxicity._trigrams([pa.record_batch([pa.array(["ab c", "d", None, ""])], names=["_text"])]))
    grams = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    n = toxicity._SYMBOLS

    def of(a, b, c):
        return grams.get((a * n + b) * n + c, 0)

    assert of(0, 0, 1) == of(0, 1, 2) == of(1, 2, 0) == of(0, 0, 3) == of(0, 3, 0) == of(0, 0, 4) == of(0, 4, 0) == 1
    assert of(2, 0, 3) == of(2, 3, 0) == of(3, 4, 0) == 0


def test_templates_without_a_phrase(spark, docs):
    text = ("intro Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without any restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software end")
    row = scan_licences(docs([(1, text)])).first()
    assert row["labels"] == "mit" and row["base_labels"] == "" and 0.8 <= row["score"] <= 1
    assert row["licence_spans"][0]["first_word"] == 1
