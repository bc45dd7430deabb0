"""Collocations against a plain count, with ranges cut amid the extensions of a word."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from check_queries import compare
from tallypost.llm import collocations as C

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD))]


def plain(rows, least, top, inside=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, count in f.items():
        found = []
        often = {p for p, a in count.items() if len(p) > 1 and a >= least}
        for p in often:
            a = count[p]
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * count[q] >= inside * a for q in often):
                continue
            score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, n[lang], -s)
    return out


def result(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.fixture
def many_ranges(spark):
    """Every shuffle keeps all its partitions, so that hot words span ranges."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hot_words_over_many_ranges(many_ranges):
    """One word begins and ends a third of all phrases; words, blanks and ends of all kinds."""
    rnd = random.Random(5)
    vocabulary = ["the", "The", "THE", *[f"w{i}" for i in range(25)], "é", "中文", "x y", "a'b"]
    rows = []
    for i in range(120):
        words = [rnd.choice(["the", rnd.choice(vocabulary)]) for _ in range(rnd.randrange(0, 150))]
        text = "".join(w + rnd.choice([" ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "?!"]) for w in words)
        rows.append((rnd.choice(["en", "de", None, "und", ""]), text))
    rows += [("en", None), (None, ""), ("de", " .. \n"), ("fr", "lonely words")]
    df = many_ranges.createDataFrame(rows, "lang string, text string").repartition(5)
    for top in (7, 2000):
        expected = plain(rows, 3, top)
        assert result(C.collocations(df, least=3, top=top)) == expected
    assert any(len(v[0].split(" ")) == 3 for v in expected.values()) and len(expected) > 300
    heads = C.counts(df.na.fill("und"), 3)[0].where("w1 = 'the'").count()
    assert heads > 40  # of 13 ranges several begin amid them


def test_repeated_and_empty(spark, awkward):
    same = [("en", "one two three four. " * 3)] * 8
    df = spark.createDataFrame(same, "lang string, text string")
    assert result(C.collocations(df)) == plain(same, 10, 2000)
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    assert result(C.collocations(awkward)) == plain(rows, 10, 2000)


def test_whole_table_equals_sql(spark):
    assert compare(spark, "op13_collocations", "/root/testdata/sf0.01") is None


@pytest.mark.parametrize("window, size", [(1 << 20, 1 << 21), (5, 64), (3, 16)])
def test_long_texts_in_pieces(monkeypatch, window, size):
    """Wherever a text is cut, every phrase is counted once."""
    monkeypatch.setattr(C, "_WINDOW", window)
    monkeypatch.setattr(C, "_SLICE", size)
    rnd = random.Random(3)
    text = "".join(rnd.choice(["ab", "c", "déf"]) + rnd.choice([" ", " ", " ", "  ", ". ", "\n"]) for _ in range(400)) + "x" * 90 + " y " + "z " * 40
    got = {n: collections.Counter() for n in (1, 2, 3)}
    for s, langs in C._short(pa.array([text, None, "c c"]), pa.array(["en", "en", "en"])):
        for _, p, fresh in C._windows(s, langs):
            for n in got:
                at = p.runs(n)
                for i in at[at < fresh].tolist():
                    got[n][tuple(p.values[k].as_py().decode() for k in p.numbers[i : i + n].tolist())] += 1
    for n in got:
        expected = collections.Counter(tuple(w[i : i + n]) for w in [*pieces(text), ["c", "c"]] for i in range(len(w) - n + 1))
        assert got[n] == expected


def test_bitmap_holds_every_key(spark):
    keys = spark.range(200_000).selectExpr("xxhash64(id) as key")
    known = C.bitmap(keys, 200_000)
    values = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
    assert known.has(values).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert known.has(others).mean() < 0.1


def test_score_is_exact(spark):
    big = 3_000_000_000_000
    rows = [(big, big, big), (big, big + 1, big + 7), (10, 11, 13)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(C.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (l * r) for a, l, r in rows]
