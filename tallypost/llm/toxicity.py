"""Toxicity of texts after undoing what hides words: a noisy channel and a classifier.

1. A character trigram model is counted over all words of the corpus, word by word.
2. Which words speak for toxicity is learned from a sample of at most `SAMPLE` labelled rows.
3. A token is a lattice: a sign may stand for some letters, a star for any, a letter may be drawn
   out, gaps may stand between letters; its plain letters are one path among others. Viterbi
   decoding under the character model picks the reading. Only tokens with a reading that has a
   weight need decoding, as any other restored word changes no score; such tokens are found by
   skeletons, in which all that a channel can confuse is the same.
4. The restored text is scored by its words' weights: log odds of a word among toxic and other
   rows, of which a logistic model makes a probability.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .staging import dropped, packed, prepared, unpacked, written
from .text import LOWER, U, Slice, slices, span_hashes, table, words

SAMPLE = 32768  # labelled rows that the classifier is fitted on, at most
MOST_FEATURES = 4096
LEAST_DOCS, LEAST_CHI2 = 4, 30.0
LONGEST_RUN = 24  # letters of a word that stand one by one
PART_BYTES = 1 << 18  # of texts that are worked on at once; arrays of eight bytes a byte stand beside them

# What a sign may stand for.
STANDS_FOR = {
    "0": "ou", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_GAP, _OTHER, _SYMBOLS = 0, 27, 28
_SYMBOL_OF = np.zeros(256, np.int32)
_SYMBOL_OF[0x61:0x7B] = np.arange(1, 27)
_SYMBOL_OF[0x80:] = _OTHER
_SYMBOL_OF[0x30:0x3A] = _OTHER

_SWAP, _REPEAT = math.log(0.2), math.log(0.3)  # channel: a letter is swapped for a sign, is repeated

WORDS = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_BLANK = table((0x20, 0x20), (0x09, 0x0D))
# Tokens are looked for in three ways: between blanks; between all but letters, digits and the
# signs in the middle of words; as words.
_CUTS = (_BLANK, WORDS | np.isin(np.arange(256), [ord(c) for c in "$@"]), WORDS)


def _classes() -> np.ndarray:
    """By byte: the same number for all that may stand for one another, 0 for what is left out."""
    group = {c: c for c in _LETTERS}

    def root(c: str) -> str:
        while group[c] != c:
            c = group[c]
        return c

    for sign, letters in STANDS_FOR.items():
        group[sign] = letters[0]
        for other in letters[1:]:
            group[root(other)] = root(letters[0])
    out = np.where(np.arange(256) >= 0x80, np.arange(256), 0).astype(np.uint8)
    for c in group:
        if ord(c) < 128:
            out[ord(c)] = ord(root(c))
    return out


_CLASS = _classes()
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[0x61:0x7B] = True
_SIGN_BYTE = np.zeros(256, bool)
_SIGN_BYTE[[ord(c) for c in STANDS_FOR if ord(c) < 128]] = True
_APART = _BLANK & ~np.isin(np.arange(256), [ord(c) for c in "._-*"])


def _with_signs(low: Slice) -> tuple[Slice, np.ndarray]:
    """The tokens between blanks that have a sign, or anything but word bytes between word bytes.

    They come as one slice of their own, with the place of each of its bytes.
    """
    data = low.data
    inside = WORDS[data]
    special = ~inside & (_SIGN_BYTE[data] | (data == 0xE2))
    special |= inside & (data == 0xE2)
    between = ~inside & _BLANK[data]
    between[1:-1] &= inside[:-2] & inside[2:]
    between[:1] = between[-1:] = False
    counts = np.concatenate([[0], np.cumsum(special | between)])
    w = words(low, _BLANK)
    chosen = np.flatnonzero(counts[w.end] > counts[w.start])
    if not len(chosen):
        return Slice(low.row, np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, np.int64)
    # each token and the byte behind it, which is a blank or begins another text
    lengths = w.end[chosen] - w.start[chosen] + 1
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1]) + np.repeat(w.start[chosen] - (ends - lengths), lengths)
    part = data[np.minimum(place, len(data) - 1)]
    part[ends - 1] = 0x20
    return Slice(low.row, part, np.array([0, len(part)])), place


class Model(NamedTuple):
    """log P(next | two before) by symbol, flat."""

    log: np.ndarray

    def of(self, a: int, b: int, c: int) -> float:
        return self.log[(a * _SYMBOLS + b) * _SYMBOLS + c]


def character_model(counts: np.ndarray) -> Model:
    n = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(float)
    pairs, single = n.sum(axis=2), n.sum(axis=(0, 1))
    base = (single + 1) / (single + 1).sum()
    middle = n.sum(axis=0)
    two = (middle + 5 * base) / (middle.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (pairs[:, :, None] + 5)
    return Model(np.log(three).ravel())


def _trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of all words of a task, two gaps before each word and one behind it."""
    total = np.zeros(_SYMBOLS**3, np.int64)
    for b in batches:
        for s in slices(b.column("_text"), PART_BYTES):
            w = words(s, WORDS)
            lengths = w.end - w.start
            # the words one after the other, each behind two gaps
            inside = WORDS[s.data]
            at = np.flatnonzero(inside)
            place = np.arange(len(at)) + 2 * np.repeat(np.arange(1, len(lengths) + 1), lengths)
            symbols = np.zeros(len(at) + 2 * len(lengths) + 1, np.int32)
            symbols[place] = _SYMBOL_OF[LOWER[s.data[at]]]
            grams = (symbols[:-2] * _SYMBOLS + symbols[1:-1]) * _SYMBOLS + symbols[2:]
            total += np.bincount(grams, minlength=_SYMBOLS**3)
    kept = np.flatnonzero(total)
    yield pa.record_batch([kept.astype(np.int32), total[kept]], names=["gram", "n"])


def decode(token: str, model: Model) -> str:
    """The most likely plain word behind a token, by Viterbi over pairs of letters.

    A token of letters may be its own reading; drawn-out letters compete with doubled ones. A
    star stands for any letter.
    """
    # by (letter before last, last letter): the best score, and the letters as a linked list
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for sign in token:
        readings = sign if sign in _LETTERS else _LETTERS if sign == "*" else STANDS_FOR.get(sign, "")
        price = 0.0 if sign in _LETTERS else _SWAP - math.log(max(1, len(readings)))
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, letters) in best.items():
            for letter in readings:
                c = _LETTERS.index(letter) + 1
                offers = [((b, c), score + price + model.of(a, b, c), (letters, letter))]
                if c == b and sign != "*":  # one more of the same: the letter is drawn out
                    offers.append(((a, b), score + price + _REPEAT, letters))
                for node, offered, path in offers:
                    if node not in following or offered > following[node][0]:
                        following[node] = (offered, path)
        if not following:
            return token
        best = following
    _, path = max(((s + model.of(a, b, _GAP), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
    out: list[str] = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


class _Skeletons(NamedTuple):
    """Hashes of the skeletons of tokens, and the byte spans of the tokens."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray


def skeletons(low: Slice, cut: np.ndarray) -> _Skeletons:
    """Tokens between the bytes that `cut` leaves out: classes of their letters and signs, runs of one class as one."""
    tokens = words(low, cut)
    kind = _CLASS[low.data]
    euro = np.flatnonzero((low.data[:-2] == 0xE2) & (low.data[1:-1] == 0x82) & (low.data[2:] == 0xAC)) if len(low.data) > 2 else []
    if len(euro):
        kind[euro], kind[euro + 1], kind[euro + 2] = ord("e"), 0, 0
    at = np.flatnonzero((kind > 0) & cut[low.data])
    begins = np.zeros(len(low.data), np.int32)
    begins[tokens.start] = 1
    token = np.cumsum(begins, dtype=np.int32)[at] - 1
    kind = kind[at]
    new = np.ones(len(at), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (token[1:] != token[:-1])
    kind, token = kind[new], token[new]
    first = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens.start)))])
    return _Skeletons(span_hashes(kind, first[:-1], first[1:]), tokens.start, tokens.end)


def _one(text: str) -> Slice:
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return Slice(0, raw, np.array([0, len(raw)]))


def _shape(word: bytes) -> bytes:
    """The skeleton of a word of letters and signs."""
    kinds = word.translate(_CLASS.tobytes())
    return bytes(k for i, k in enumerate(kinds) if k and (i == 0 or k != kinds[i - 1]))


class Restorer:
    """Finds the tokens of a text that may hide a word of a list, and reads them."""

    def __init__(self, model: Model, known: list[str]):
        self._known = set(known)
        self._decode = lru_cache(maxsize=1 << 16)(lambda token: decode(token, model))
        plain = [w for w in known if w and set(w) <= set(_LETTERS)]
        self._skeletons = np.unique(np.concatenate([skeletons(_one(w), _BLANK).hashes for w in plain])) if plain else np.zeros(0, np.uint64)
        self._shapes = {_shape(w.encode()) for w in plain}
        self._by_length: dict[int, list[str]] = {}
        for w in plain:
            self._by_length.setdefault(len(w), []).append(w)

    def _among(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._skeletons, hashes), len(self._skeletons) - 1)
        return np.flatnonzero(self._skeletons[at] == hashes)

    def hidden(self, low: Slice) -> list[tuple[int, int, str]]:
        """(start, end, reading) of tokens whose reading is a word of the list, and not what stands there."""
        if not len(self._skeletons) or not len(low.data):
            return []
        raw = low.data
        found: dict[tuple[int, int], str] = {}

        def read(start: int, end: int, stars: str = "") -> None:
            token = raw[start:end].tobytes().decode(errors="replace")
            bare = "".join(c for c in token if c in _LETTERS or c in STANDS_FOR or c in stars or ord(c) > 127)
            if token in self._known:
                return
            reading = self._decode(bare)
            if reading in self._known:
                found[start, end] = reading

        s = skeletons(low, WORDS)
        for i in self._among(s.hashes).tolist():
            read(int(s.start[i]), int(s.end[i]))
        # other cuts give other tokens only where a sign or a gap is part of one
        part, place = _with_signs(low)
        if part.n:
            for cut in _CUTS:
                s = skeletons(part, cut)
                for i in self._among(s.hashes).tolist():
                    read(int(place[s.start[i]]), int(place[s.end[i] - 1]) + 1)
        for start, end in self._starred(low):
            read(start, end, "*")
        for start, end in self._spread(low):
            read(start, end)
        return [(a, e, word) for (a, e), word in sorted(found.items())]

    def _starred(self, low: Slice) -> Iterator[tuple[int, int]]:
        """Words with stars between letters that a word of the list fits."""
        star = low.data == ord("*")
        letter = _LETTER_BYTE[low.data]
        if not (star[:-1] & letter[1:]).any():
            return
        w = words(low, WORDS | (np.arange(256) == ord("*")))
        stars, letters = (np.concatenate([[0], np.cumsum(x)]) for x in (star, letter))
        some = (stars[w.end] > stars[w.start]) & (letters[w.end] > letters[w.start]) & letter[w.start] & letter[w.end - 1]
        for i in np.flatnonzero(some).tolist():
            start, end = int(w.start[i]), int(w.end[i])
            token = low.data[start:end].tobytes().decode(errors="replace")
            if any(all(a in ("*", b) for a, b in zip(token, k)) for k in self._by_length.get(len(token), [])):
                yield start, end

    def _spread(self, low: Slice) -> Iterator[tuple[int, int]]:
        """Runs of single letters or signs with gaps between them that spell a word of the list."""
        t = words(low, _APART)
        single = (t.end - t.start == 1) & (_LETTER_BYTE | _SIGN_BYTE)[low.data[t.start]]
        near = np.zeros(len(single), bool)
        near[1:] = single[1:] & single[:-1] & (t.start[1:] - t.end[:-1] <= 3)
        text = t.text_of()
        near[1:] &= text[1:] == text[:-1]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
            # tokens first - 1 .. last - 1 stand one by one
            kinds = _CLASS[low.data[t.start[first - 1 : last]]].tolist()
            for i in range(len(kinds)):
                shape = bytearray()
                for j in range(i, min(len(kinds), i + LONGEST_RUN)):
                    if not shape or shape[-1] != kinds[j]:
                        shape.append(kinds[j])
                    if j >= i + 2 and bytes(shape) in self._shapes:
                        yield int(t.start[first - 1 + i]), int(t.end[first - 1 + j])

    def text(self, text: str) -> str:
        """The text in lower case, hidden words replaced by their readings."""
        low = _one(text)
        raw, out, at = low.data.tobytes(), [], 0
        for start, end, word in self.hidden(low):
            if start >= at:
                out += [raw[at:start], word.encode()]
                at = end
        return b"".join([*out, raw[at:]]).decode(errors="replace")


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and the text of each."""
    w = words(s, WORDS)
    return span_hashes(s.data, w.start, w.end), w.text_of()


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text, by hash, and how many words it has."""
    for b in batches:
        toxic = b.column("toxic")
        for s in slices(b.column("_text"), PART_BYTES):
            low = Slice(s.row, LOWER[s.data], s.offsets)
            hashes, owner = features(low)
            size = np.bincount(owner, minlength=s.n)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            hashes, owner = hashes[first], owner[first]
            bounds = np.searchsorted(owner, np.arange(s.n + 1))
            yield pa.record_batch(
                [toxic.slice(s.row, s.n), pa.array(size.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))],
                names=["toxic", "size", "features"],
            )


def _words_of(known: np.ndarray):
    """The words that have one of the known hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("_text"), PART_BYTES):
                low = LOWER[s.data]
                w = words(Slice(s.row, low, s.offsets), WORDS)
                h = span_hashes(low, w.start, w.end)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                _, first = np.unique(h[hit], return_index=True)
                raw = low.tobytes()
                texts = [raw[w.start[i] : w.end[i]].decode(errors="replace") for i in hit[first].tolist()]
                yield pa.record_batch([pa.array(h[hit][first].view(np.int64)), pa.array(texts, pa.string())], names=["f", "word"])

    return run


class Classifier(NamedTuple):
    known: np.ndarray  # sorted hashes
    words: list[str]  # in the same order
    weights: np.ndarray
    slope: float  # of the sum of weights
    by_size: float  # of log(1 + number of words)
    bias: float

    def scores(self, s: Slice, restorer: Restorer) -> np.ndarray:
        """Each word counts once per text, plain or hidden."""
        low = Slice(s.row, LOWER[s.data], s.offsets)
        hashes, owner = features(low)
        size = np.bincount(owner, minlength=s.n)
        total = np.zeros(s.n)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = np.flatnonzero(self.known[at] == hashes)
            numbers, owners = at[hit], owner[hit]
            hidden = restorer.hidden(low)
            if hidden:
                place = {w: i for i, w in enumerate(self.words)}
                numbers = np.concatenate([numbers, [place[word] for _, _, word in hidden]])
                owners = np.concatenate([owners, np.searchsorted(low.offsets, [a for a, _, _ in hidden], "right") - 1])
            pair = np.unique(owners.astype(np.int64) * len(self.known) + numbers.astype(np.int64))
            np.add.at(total, pair // len(self.known), self.weights[pair % len(self.known)])
        margin = self.slope * total + self.by_size * np.log1p(size) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a logistic model and its constant, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 0]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def word_weight(toxic: np.ndarray, other: np.ndarray, p: float, n: float) -> np.ndarray:
    """Log odds of a word in toxic rows against other rows; never below 0."""
    return np.maximum(0, np.log((toxic + 0.5) / (p + 1) / ((other + 0.5) / (n - p + 1))))


def _known_numbers(known: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("features"):
                h = x.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out.append(at[known[at] == h].astype(np.int64))
            yield pa.record_batch(
                [b.column("toxic"), b.column("size"), pa.array(out, pa.list_(pa.int64()))], names=["toxic", "size", "numbers"]
            )

    return run


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first rows by _hash and toxic, `most` at most. Only these numbers are sorted, no texts."""
    if rows.count() <= most:
        return rows
    keys = rows.select("_hash", "toxic").orderBy("_hash", "toxic").limit(most)
    last = keys.groupBy("_hash", "toxic").count().orderBy(F.desc("_hash"), F.desc("toxic")).first()
    if last is None:
        return rows.limit(0)
    same = F.col("_hash") == last["_hash"]
    before = rows.where((F.col("_hash") < last["_hash"]) | same & (F.col("toxic") < last["toxic"]))
    return before.union(rows.where(same & (F.col("toxic") == last["toxic"])).limit(last["count"]))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[Model, Classifier]:
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # 28^3 sums at most
    grams = texts.select("_text").mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_SYMBOLS**3, np.int64)
    for r in grams:
        counts[r["gram"]] = r["n"]
    model = character_model(counts)

    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
    marked = marked.where(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("_id")))
    # an id that is marked again is the same label
    chosen = marked.distinct().orderBy(F.xxhash64("_id"), "_id", "toxic").limit(sample)
    # `sample` pairs of numbers at most; and as many rows of documents, whatever ids repeat there
    found = written(
        texts.join(F.broadcast(chosen), "_id").select("toxic", "_text", F.xxhash64("_text").alias("_hash")).hint("rebalance"), "toxic-sample"
    )
    rows = first_rows(found, sample).select("toxic", "_text")
    seen = written(rows.mapInArrow(_feature_rows, "toxic int, size long, features array<long>"), "toxic-features")
    totals = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    n, p = float(totals["n"]), float(totals["p"])
    empty = Classifier(np.zeros(0, np.uint64), [], np.zeros(0), 0.0, 0.0, -40.0)
    if p == 0:
        return model, empty
    if p == n:
        return model, empty._replace(bias=40.0)
    by_feature = seen.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(
        F.count("*").cast("double").alias("df"), F.sum("toxic").cast("double").alias("tf")
    )
    expected = F.col("df") * (p / n)
    variance = expected * (1 - p / n) * (1 - F.col("df") / n)
    chi2 = (F.col("tf") - expected) ** 2 / F.when(variance > 0, variance)
    best = (
        by_feature.where((F.col("tf") >= LEAST_DOCS) & (F.col("tf") > expected)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.col("chi2").desc(), "f").limit(MOST_FEATURES).select("f", "df", "tf").collect()
    )
    if not best:
        return model, empty._replace(bias=math.log(p / (n - p)))
    best.sort(key=lambda r: r["f"] % (1 << 64))
    known = np.array([r["f"] for r in best], np.int64).view(np.uint64)
    toxic, other = (np.array(x, float) for x in zip(*((r["tf"], r["df"] - r["tf"]) for r in best)))
    spelled = {r["f"]: r["word"] for r in rows.select("_text").mapInArrow(_words_of(known), "f long, word string").groupBy("f").agg(F.min("word").alias("word")).collect()}
    # of each row the numbers of its known words
    marks = seen.mapInArrow(_known_numbers(known), "toxic int, size long, numbers array<long>").orderBy("toxic", "size", "numbers").collect()
    dropped(seen)
    dropped(found)
    # a row does not testify for itself: its words weigh what they do without it
    without = {y: word_weight(toxic - y, other - (1 - y), p - y, n - 1) for y in (0, 1)}
    x = np.array([(without[r["toxic"]][r["numbers"]].sum(), math.log1p(r["size"])) for r in marks])
    slope, by_size, bias = fit(x, np.array([r["toxic"] for r in marks], float))
    names = [spelled.get(r["f"], "") for r in best]
    return model, Classifier(known, names, word_weight(toxic, other, p, n), float(slope), float(by_size), float(bias))


def _scored(model: Model, classifier: Classifier):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, classifier.words)
        for b in batches:
            scores = [classifier.scores(s, restorer) for s in slices(b.column("_text"), PART_BYTES)]
            out = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "score"])

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE,
) -> DataFrame:
    """All rows and columns of `docs`, with held_out, score (0 to 1) and predicted (1 from 0.5).

    `labels` marks some ids as toxic (1) or not (0); ids whose crc32, as text, is divisible
    by five are held out and never learned from. Null and empty texts get the score of no
    evidence. Rows with one id are scored each for itself and learned from each; an id with
    both labels is learned as both; a label without a row, or null, teaches nothing. Without
    toxic labels every score is near 0. Very long texts are scored whole. The
    added columns replace input columns of the same name.
    """
    prepared(docs.sparkSession)
    model, classifier = train(docs, labels, id_col, text_col, label_col, sample)
    rows = packed(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "_rest", F.col(text_col).alias("_text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(_scored(model, classifier), schema)
    out = out.withColumn("held_out", held_out(F.col("_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return unpacked(out, docs, ["held_out", "score", "predicted"], **{id_col: "_id", text_col: "_text"})
