"""Collocations: phrases of two or three words that occur together more than their parts suggest.

1. Words are counted, then pairs of frequent words by hash: no phrase occurs more often than a
   part of it, so a phrase of frequent parts only can be frequent. Both answers become bitmaps
   of bounded size. A bitmap may let too much through, never too little, and what passes the
   second one is counted by its words, exactly.
2. The counts of frequent words, pairs and triples are one stream, kept in two orders: by words
   from the left (prefix order) and from the right (suffix order). In prefix order a phrase
   stands directly before all that begin with it, in suffix order before all that end with it.
   Each order is cut into ranges; a range that begins amid the extensions of a phrase gets a
   copy of that phrase's count, so a word with very many phrases may fill many ranges.
3. One pass in lockstep over a range gives every phrase the counts of its beginnings (in suffix
   order: endings), and every pair the largest count of a triple that extends it. No table of
   counts is built or looked up.
4. Both results meet by phrase, in a sort-merge join.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import dropped, prepared, written
from .text import LOWER, U, Slice, mix, slices, span_hashes, table, words

LEAST = 10
TOP = 2000
INSIDE_PERCENT = 50
# Bits of a bitmap per frequent entry, and bits at most: 64 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29

_PIECE_ENDS = ((0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
# Words as `[^\x20\x09]+` of pieces that end at `[.,;:!?\x0A-\x0D]`.
_WORD = table((0x20, 0x20), (0x09, 0x09), *_PIECE_ENDS)
_ENDS = ~table(*_PIECE_ENDS)
_SLICE = 1 << 21  # bytes of text at a time
_WINDOW = 1 << 20  # words that are numbered together: three numbers fit into 64 bits
_KEY = ["lang", "w1", "w2", "w3"]


class _Pieces:
    """The words of one language in a slice: distinct values, the number of each word, where runs end."""

    def __init__(self, values: pa.Array, numbers: np.ndarray, hashes: np.ndarray, together: np.ndarray):
        self.values, self.numbers, self.hashes, self.together = values, numbers, hashes, together

    def runs(self, n: int) -> np.ndarray:
        """First words of the runs of n words inside one piece."""
        count = len(self.numbers) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64)
        keep = np.ones(count, bool)
        for k in range(n - 1):
            keep &= self.together[k : k + count]
        return np.flatnonzero(keep)


def _short(column: pa.Array, langs: pa.Array) -> Iterator[tuple[Slice, list[str]]]:
    """Slices and the language of each text; a longer text is cut where a piece ends, as no phrase spans it."""
    for s in slices(column, _SLICE):
        names = langs.slice(s.row, s.n).to_pylist()
        if len(s.data) <= 2 * _SLICE:
            yield s, names
            continue
        at = 0
        while at < len(s.data):
            ends = np.flatnonzero(_ENDS[s.data[at + _SLICE : at + 2 * _SLICE]])
            stop = at + _SLICE + int(ends[0]) + 1 if len(ends) else at + 2 * _SLICE
            while stop < len(s.data) and not len(ends):  # no end so near: look on
                ends = np.flatnonzero(_ENDS[s.data[stop : stop + _SLICE]])
                stop += int(ends[0]) + 1 if len(ends) else _SLICE
            stop = min(stop, len(s.data))
            yield Slice(s.row, s.data[at:stop], np.array([0, stop - at])), names
            at = stop


def _windows(s: Slice, langs: list[str]) -> Iterator[tuple[str, _Pieces, int]]:
    """The words by language, in windows, and how many of a window's words are its own.

    The words behind those begin the next window; here they only complete phrases.
    """
    low = LOWER[s.data]
    w = words(Slice(s.row, low, s.offsets), _WORD)
    piece = np.concatenate([[0], np.cumsum(_ENDS[s.data])])
    text = w.text_of()
    hashes = span_hashes(low, w.start, w.end)
    # the bytes of all words, one after the other
    inside = _WORD[low]
    lengths = w.end - w.start
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[inside]))]
    )
    together = np.zeros(len(text), bool)
    together[:-1] = (text[1:] == text[:-1]) & (piece[w.start[1:]] == piece[w.start[:-1]])
    by_lang: dict[str | None, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    for lang, rows in by_lang.items():
        if len(by_lang) == 1:
            chosen = np.arange(len(text))
        else:
            mine = np.zeros(s.n, bool)
            mine[rows] = True
            chosen = np.flatnonzero(mine[text])
        for at in range(0, len(chosen), _WINDOW):
            some = chosen[at : at + _WINDOW + 2]
            coded = column.take(pa.array(some)).dictionary_encode()
            numbers = coded.indices.to_numpy().astype(np.int64)
            first = np.zeros(len(coded.dictionary), np.int64)
            first[numbers[::-1]] = some[::-1]
            yield lang, _Pieces(coded.dictionary, numbers, hashes[first], together[some]), min(_WINDOW, len(some))


def _word_key(hashes: np.ndarray, lang: str) -> np.ndarray:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return mix(hashes ^ (span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)])) * U(0x9E3779B97F4A7C15)))


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U(0xD6E8FEB86659FD93) + second)


class Bitmap:
    """Hashes that were seen, by their low bits; others may seem seen, none of them not seen."""

    def __init__(self, bits: int, data: np.ndarray):
        self._mask, self._data = U(bits - 1), data

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & self._mask).astype(np.int64)
        return (self._data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def bitmap(keys: DataFrame, n: int) -> Bitmap:
    """A bitmap of the column `key` of n rows. Its size is bounded; buckets of it come to the driver."""
    bits = 1 << int(np.clip(n * BITS_EACH, LEAST_BITS, MOST_BITS) - 1).bit_length()
    at = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1  # buckets count from 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    data = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        bucket = np.frombuffer(r["bits"], np.uint8)
        low = (r["bucket"] - 1) * len(bucket)
        data[low : low + len(bucket)] = bucket
    return Bitmap(bits, data)


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s, langs in _short(b.column("text"), b.column("lang")):
            for lang, p, fresh in _windows(s, langs):
                n = np.bincount(p.numbers[:fresh], minlength=len(p.values))
                keys = _word_key(p.hashes, lang)
                yield pa.record_batch(
                    [pa.array([lang] * len(n), pa.string()), p.values.cast(pa.binary()), pa.array(n), pa.array(keys.view(np.int64))],
                    names=["lang", "w1", "f", "key"],
                )


def _pair_counts(frequent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Bitmap = frequent.value
        for b in batches:
            for s, langs in _short(b.column("text"), b.column("lang")):
                for lang, p, fresh in _windows(s, langs):
                    keys = _word_key(p.hashes, lang)
                    good = known.has(keys)
                    at = p.runs(2)
                    at = at[(at < fresh) & good[p.numbers[at]] & good[p.numbers[at + 1]]]
                    pair, n = np.unique(_pair_key(keys[p.numbers[at]], keys[p.numbers[at + 1]]), return_counts=True)
                    yield pa.record_batch([pa.array(pair.view(np.int64)), pa.array(n)], names=["key", "f"])

    return run


def _phrase_counts(frequent):
    """Pairs that may be frequent, and triples of two such pairs, by their words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Bitmap = frequent.value
        for b in batches:
            for s, langs in _short(b.column("text"), b.column("lang")):
                for lang, p, fresh in _windows(s, langs):
                    keys, v = _word_key(p.hashes, lang), len(p.values)
                    two = p.runs(2)
                    a, c = p.numbers[two], p.numbers[two + 1]
                    hit = known.has(_pair_key(keys[a], keys[c]))
                    good = np.zeros(len(p.numbers) + 1, bool)
                    good[two[hit]] = True
                    three = p.runs(3)
                    three = three[good[three] & good[three + 1] & (three < fresh)]
                    two = two[hit & (two < fresh)]
                    pairs, n2 = np.unique(p.numbers[two] * v + p.numbers[two + 1], return_counts=True)
                    triples, n3 = np.unique(
                        (p.numbers[three] * v + p.numbers[three + 1]) * v + p.numbers[three + 2], return_counts=True
                    )
                    values = p.values.cast(pa.binary())
                    w1 = values.take(pa.array(np.concatenate([pairs // v, triples // (v * v)])))
                    w2 = values.take(pa.array(np.concatenate([pairs % v, triples // v % v])))
                    w3 = values.take(pa.array(np.concatenate([np.zeros(len(pairs), np.int64), triples % v]),
                                              mask=np.arange(len(pairs) + len(triples)) < len(pairs)))
                    yield pa.record_batch(
                        [pa.array([lang] * len(w1), pa.string()), w1, w2, w3, pa.array(np.concatenate([n2, n3]))],
                        names=[*_KEY, "f"],
                    )

    return run


def counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, f) of all phrases of one to three words with f >= least; (lang, n) of all words."""
    context = docs.sparkSession.sparkContext
    texts = docs.select("lang", "text").where("text is not null")
    single = written(
        texts.mapInArrow(_word_counts, "lang string, w1 binary, f long, key long")
        .groupBy("lang", "w1").agg(F.sum("f").alias("f"), F.min("key").alias("key")), "words",
    )
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    often = single.where(F.col("f") >= least)
    known = context.broadcast(bitmap(often.select("key"), often.count()))
    pairs = written(
        texts.mapInArrow(_pair_counts(known), "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
        .where(F.col("f") >= least).select("key"), "pairs",
    )
    known_pairs = context.broadcast(bitmap(pairs, pairs.count()))
    longer = (
        texts.mapInArrow(_phrase_counts(known_pairs), "lang string, w1 binary, w2 binary, w3 binary, f long")
        .groupBy(*_KEY).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    )
    nothing = F.lit(None).cast("binary")
    grams = written(longer.unionAll(often.select("lang", "w1", nothing.alias("w2"), nothing.alias("w3"), "f")), "phrases")
    dropped(pairs)
    return grams, totals


class _Above:
    """The last count at a depth of the stream so far, carried over batches."""

    def __init__(self):
        self.last = 0

    def fill(self, here: np.ndarray, f: np.ndarray) -> np.ndarray:
        at = np.maximum.accumulate(np.where(here, np.arange(len(f)), -1))
        out = np.where(at >= 0, f[np.maximum(at, 0)], self.last)
        if len(out):
            self.last = out[-1]
        return out


def _lockstep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order: one pass that keeps the counts of the phrases that the current one extends.

    Of a pair comes also the largest count of its extensions; where they go on in the next
    batch or range, more than one such row.
    """
    one, two = _Above(), _Above()
    pair: pa.RecordBatch | None = None  # the pair that is being extended
    for b in batches:
        if not b.num_rows:
            continue
        f = b.column("f").to_numpy()
        depth = 1 + b.column("k2").is_valid().to_numpy(zero_copy_only=False).astype(int)
        depth += b.column("k3").is_valid().to_numpy(zero_copy_only=False)
        p1, p2 = one.fill(depth == 1, f), two.fill(depth == 2, f)
        # extensions of each pair in this batch, those of the pair before at first
        starts = np.flatnonzero(depth == 2)
        longest = np.where(depth == 3, f, 0)
        ext = np.zeros(len(f), np.int64)
        if len(starts):
            ext[starts] = np.maximum.reduceat(longest, starts)
        first = int(starts[0]) if len(starts) else len(f)
        more = longest[:first].max(initial=0)
        if more and pair is not None:
            yield pa.record_batch(
                [*(pair.column(c) for c in ("lang", "k1", "k2", "k3")), pa.array([0]), pa.array([0]), pa.array([0]), pa.array([more])],
                names=["lang", "k1", "k2", "k3", "f", "p1", "p2", "ext"],
            )
        if len(starts):
            pair = b.slice(int(starts[-1]), 1)
        carried = b.column("carried").to_numpy(zero_copy_only=False)
        keep = (depth == 3) | ((depth == 2) & (~carried | (ext > 0)))
        own = np.where(carried, 0, f)
        yield pa.record_batch(
            [*(b.column(c) for c in ("lang", "k1", "k2", "k3")), pa.array(own), pa.array(np.where(carried, 0, p1)),
             pa.array(np.where(depth == 3, p2, 0)), pa.array(ext)],
            names=["lang", "k1", "k2", "k3", "f", "p1", "p2", "ext"],
        ).filter(pa.array(keep))


def _reversed(rows: DataFrame, key: list[str]) -> list[Column]:
    """The words from the right, for a key in prefix order, and the other way round."""
    _, a, b, c = key
    return [F.coalesce(c, b, a), F.when(F.col(c).isNotNull(), F.col(b)).when(F.col(b).isNotNull(), F.col(a)),
            F.when(F.col(c).isNotNull(), F.col(a))]


def _ordered(grams: DataFrame, backward: bool) -> DataFrame:
    """(phrase, f, p1, p2, ext): the lockstep pass over the counts in prefix or in suffix order."""
    k = ["lang", "k1", "k2", "k3"]
    keys = _reversed(grams, _KEY) if backward else [F.col(c) for c in _KEY[1:]]
    stream = grams.select("lang", *[c.alias(n) for c, n in zip(keys, k[1:])], "f")
    # ranges of the order; the rows of one are a file or more, in any order: they are sorted where they are read
    cut = written(stream.repartitionByRange(*k).withColumn("part", F.spark_partition_id()), "stream")
    heads = cut.groupBy("part").agg(F.min(F.struct(*k)).alias("head")).select(
        F.col("part").alias("_to"), *[F.col(f"head.{c}").alias(f"h_{c}") for c in k]
    )
    # a row per range, and a range holds its share of the shuffle partitions' rows
    heads = F.broadcast(heads)
    same = (F.col("lang") == F.col("h_lang")) & (F.col("k1") == F.col("h_k1"))
    above = cut.where("k2 is null").join(heads.where("h_k2 is not null"), same)
    above = above.unionAll(
        cut.where("k2 is not null and k3 is null").join(heads.where("h_k3 is not null"), same & (F.col("k2") == F.col("h_k2")))
    )
    whole = cut.withColumn("carried", F.lit(False)).unionAll(
        above.select(*k, "f", F.col("_to").alias("part"), F.lit(True).alias("carried"))
    )
    passed = (
        whole.repartition("part").sortWithinPartitions("part", *k)
        .mapInArrow(_lockstep, "lang string, k1 binary, k2 binary, k3 binary, f long, p1 long, p2 long, ext long")
    )
    words_ = _reversed(passed, k) if backward else [F.col(c) for c in k[1:]]
    return passed.select("lang", *[c.alias(n) for c, n in zip(words_, _KEY[1:])], "f", "p1", "p2", "ext").groupBy(*_KEY).agg(
        *[F.max(c).alias(c) for c in ("f", "p1", "p2", "ext")]
    )


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)), exactly: the products have up to 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", (wide[0] * wide[0]).cast("decimal(31,0)") * million, wide[1] * wide[2])


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hang together most.

    Words are lower-cased in A-Z; a phrase has two or three words of one piece, pieces end at
    `. , ; : ! ?` and line ends. `a` is how often the phrase occurs, at least `least`; `l` and
    `r` how often the two parts of its worst cut do, `n` how many words the language has. A
    phrase inside a longer one of at least `inside_percent` % of its count is left out. The
    first `top` of each language come, by score, count and phrase.

    Rows without a language are the language `und`, together with rows that say so. Null and
    empty texts have no words; a repeated row counts again. Other columns are not looked at.
    Phrases that are no valid UTF-8 cannot come out of a text. No documents give no rows.
    """
    spark = prepared(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    grams, totals = counts(texts, least)
    left, right = _ordered(grams, False), _ordered(grams, True)
    # both hold every phrase, in the same key order
    meet = left.hint("merge").join(
        right.select(*[F.col(c).alias(f"s_{c}") for c in _KEY], F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.col("ext").alias("s_ext")),
        (F.col("lang") == F.col("s_lang")) & (F.col("w1") == F.col("s_w1")) & (F.col("w2") == F.col("s_w2")) & F.col("w3").eqNullSafe(F.col("s_w3")),
    ).where("f > 0")
    a, triple = F.col("f"), F.col("w3").isNotNull()
    # cuts: after the first word, and of a triple after the second
    first = score(a, F.col("p1"), F.when(triple, F.col("s2")).otherwise(F.col("s1")))
    second = F.when(triple, score(a, F.col("p2"), F.col("s1")))
    by_second = F.coalesce(F.col("second") < F.col("first"), F.lit(False))
    longer = F.greatest("ext", "s_ext")
    scored = meet.where(longer * 100 < a * inside_percent).withColumns({"first": first, "second": second}).select(
        "lang", F.concat_ws(" ", *[F.col(c).cast("string") for c in _KEY[1:]]).alias("phrase"), a.alias("a"),
        F.when(by_second, F.col("p2")).otherwise(F.col("p1")).alias("l"),
        F.when(by_second | ~triple, F.col("s1")).otherwise(F.col("s2")).alias("r"),
        F.when(by_second, F.col("second")).otherwise(F.col("first")).alias("score"),
    )
    # the best of each share of a language first, so that a large language is not one task's work
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    few = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order)))
    few = few.where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
