"""Language of texts by a string kernel: blended spectrum, Nystroem landmarks, ridge regression.

1. A text is the sequence of its letters in lower case, everything else being one gap. Its
   spectrum is the set of all runs of 1 to `ORDERS` signs of it: presence, not counts.
2. The kernel of two texts is the number of runs in both, over the geometric mean of how many
   each has. Runs are those that a landmark has; others count for no kernel value.
3. Landmarks are some labelled texts of each language. The kernel values of a text with all of
   them are its Nystroem coordinates, up to a linear map, and a ridge regression in the
   landmarks' span tells each language (1) from the rest (0).
4. With presence rows P, landmark presences G and coefficients A, the outputs P G A / norm are
   computed as P (G A): a matrix product per batch of texts with a table of one row per run
   and one column per language. A text is read whole; its runs are marked piece by piece.

The classifier is fitted on a bounded sample (`FIT_ROWS` texts, `LANDMARKS` of them landmarks);
everything else is a map over the documents.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import lru_cache
from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .staging import dropped, packed, prepared, unpacked, written
from .text import U, mix

ORDERS = 4
LANDMARKS = 256  # over all languages
FIT_ROWS = 2048  # over all languages; landmarks among them
FIT_BYTES = 16384  # longer texts are not fitted on
RIDGE = 1e-3
MOST_LANGUAGES = 1024
UNKNOWN = "und"
_PIECE = 1 << 18  # signs of a text at a time
_GROUP = 64  # texts in one matrix product
_HASH, _LENGTH = U(0x9FB21C651E98DF25), 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 if no letter or mark, else the code point of its lower case; whether it is a letter."""
    out, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        char = chr(c)
        kind = unicodedata.category(char)[0]
        if kind in "LM":
            low = char.lower()
            out[c], letter[c] = ord(low) if len(low) == 1 else c, kind == "L"
    return out, letter


def _pieces(text: bytes) -> Iterator[tuple[np.ndarray, bool]]:
    """The signs of a text, gaps as 0, in pieces that overlap by the longest run but one; whether it has letters so far."""
    points = np.frombuffer(text.decode(errors="replace").encode("utf-32-le", errors="replace"), np.uint32)
    sign, letter = _signs()
    letters = False
    tail = np.zeros(1, np.uint32)
    for at in range(0, len(points), _PIECE):
        signs = sign[points[at : at + _PIECE]]
        letters = letters or bool(letter[points[at : at + _PIECE]].any())
        signs = np.concatenate([tail, signs] if at + _PIECE < len(points) else [tail, signs, np.zeros(1, np.uint32)])
        keep = np.ones(len(signs), bool)
        keep[1:] = (signs[1:] > 0) | (signs[:-1] > 0)
        signs = signs[keep]
        yield signs, letters
        tail = signs[-(ORDERS - 1) :]


def runs(signs: np.ndarray, orders: int = ORDERS) -> Iterator[np.ndarray]:
    """Hashes of the runs of each length, but the gap alone."""
    code = signs.astype(np.uint64)
    total = np.zeros(len(code), np.uint64)
    for n in range(1, orders + 1):
        if len(code) < n:
            return
        total = total[: len(code) - n + 1] * _HASH + code[n - 1 :] + U(1)
        yield mix((total if n > 1 else total[code > 0]) + U(n * _LENGTH % (1 << 64)))


def spectrum(text: bytes) -> np.ndarray:
    """All distinct runs of a text, for texts that are fitted on."""
    parts = [r for signs, _ in _pieces(text) for r in runs(signs)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


class Runs:
    """Numbers of the known runs, by a table of slots that are looked through in order."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(10, int(4 * len(known)).bit_length())
        self._shift = U(64 - bits)
        # runs sorted by value: a slot is a range of leading bits
        self._from = np.searchsorted(known, np.arange((1 << bits) + 1, dtype=np.float64) * 2.0 ** (64 - bits)).astype(np.int32)
        self._most = int(np.diff(self._from).max(initial=0))
        self._mark = np.zeros(len(known), np.int32)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the known ones among the hashes."""
        if not len(self.known):
            return np.zeros(0, np.int64)
        slot = (hashes >> self._shift).astype(np.int64)
        at, end = self._from[slot].astype(np.int64), self._from[slot + 1]
        found = []
        for _ in range(self._most):
            live = np.flatnonzero(at < end)
            if not len(live):
                break
            hashes, at, end = hashes[live], at[live], end[live]
            found.append(at[self.known[at] == hashes])
            at = at + 1
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def present(self, text: bytes) -> tuple[np.ndarray, bool]:
        """Numbers of the known runs of a text, each once; whether it has a letter."""
        parts, letters = [], False
        for signs, letters in _pieces(text):
            for hashes in runs(signs):
                parts.append(self._once(self.numbers(hashes)))
        if not parts:
            return np.zeros(0, np.int64), letters
        return self._once(np.concatenate(parts)), letters

    def _once(self, numbers: np.ndarray) -> np.ndarray:
        self._mark[numbers] = np.arange(len(numbers))
        return numbers[self._mark[numbers] == np.arange(len(numbers))]


def product(rows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Presence rows times a table, over the columns that a row has."""
    columns = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    presence = np.zeros((len(rows), len(columns)), table.dtype)
    for i, r in enumerate(rows):
        presence[i, np.searchsorted(columns, r)] = 1
    return presence @ table[columns]


def kernel(rows: list[np.ndarray], presence: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Kernel values of texts with landmarks, whose presences are columns."""
    own = np.sqrt(np.maximum(1, [len(r) for r in rows]))
    return product(rows, presence) / own[:, None] / norms[None, :]


class Classifier(NamedTuple):
    languages: list[str]
    known: np.ndarray  # sorted hashes of runs
    weights: np.ndarray  # a row per run, a column per language

    def outputs(self, rows: list[np.ndarray]) -> np.ndarray:
        own = np.sqrt(np.maximum(1, [len(r) for r in rows]))
        return product(rows, self.weights) / own[:, None]


def regress(values: np.ndarray, landmarks: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of the landmarks: least squares of y with the kernel norm as penalty.

    Each language weighs as much as any other, however many texts it has.
    """
    weight = (1 / np.maximum(1, y.sum(axis=0)))[np.argmax(y, axis=1)]
    left = values.T @ (values * weight[:, None]) + ridge * landmarks + 1e-9 * np.eye(len(landmarks))
    return np.linalg.solve(left, values.T @ (y * weight[:, None]))


def _spectra(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        yield pa.record_batch([b.column("lang"), pa.array([spectrum(t).tobytes() for t in texts], pa.binary())], names=["lang", "runs"])


def _kernel_rows(sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, presence, norms = sent.value
        find = Runs(known)
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), _GROUP):
                values = kernel([find.present(t)[0] for t in texts[at : at + _GROUP]], presence, norms)
                yield pa.record_batch(
                    [b.column("lang").slice(at, _GROUP), pa.array([v.tobytes() for v in values], pa.binary())], names=["lang", "row"]
                )

    return run


def held_out(id_: Column) -> Column:
    """Rows that nothing is learned from; a null id is as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(texts: DataFrame, fit_rows: int) -> DataFrame:
    """(lang, text, place): up to the same number of distinct texts of each language, by hash, written."""
    usable = texts.where(F.col("lang").isNotNull() & (F.octet_length("text") <= FIT_BYTES) & F.col("text").rlike(r"\p{L}"))
    hashed = usable.withColumn("h", F.xxhash64("text"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max(1, fit_rows // max(1, len(sizes)))
    # twice as many as wanted, as their number is an estimate; of a language with few all
    share = F.lit(float(2 * each)) / F.col("texts")
    near = (F.col("h").cast("double") / 2.0**64 + 0.5) < share
    by_lang = F.broadcast(hashed.sparkSession.createDataFrame([(r["lang"], r["texts"]) for r in sizes], "lang string, texts long"))
    some = hashed.join(by_lang, "lang").where(near).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return written(some.withColumn("place", place).where(F.col("place") <= each).drop("h"), "language-sample")


def train(texts: DataFrame, landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS) -> Classifier:
    """Fitted on rows (lang, text) that may be learned from."""
    context = texts.sparkSession.sparkContext
    chosen = sample(texts, fit_rows)
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not languages:
        return Classifier([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    each = max(1, math.ceil(landmarks / len(languages)))
    # `each` texts of at most FIT_BYTES a language
    spectra = [np.frombuffer(r["runs"], np.uint64) for r in chosen.where(F.col("place") <= each).mapInArrow(_spectra, "lang string, runs binary").orderBy("lang", "runs").collect()]
    known = np.unique(np.concatenate(spectra))
    presence = np.zeros((len(known), len(spectra)), np.float32)
    for j, s in enumerate(spectra):
        presence[np.searchsorted(known, s), j] = 1
    norms = np.sqrt(np.maximum(1, presence.sum(axis=0)))
    sent = context.broadcast((known, presence, norms))
    # `fit_rows` rows of one number per landmark
    rows = chosen.select("lang", "text").mapInArrow(_kernel_rows(sent), "lang string, row binary").orderBy("lang", "row").collect()
    dropped(chosen)
    values = np.array([np.frombuffer(r["row"], np.float64) for r in rows])
    y = np.array([[float(r["lang"] == lang) for lang in languages] for r in rows])
    grams = presence.T.astype(np.float64) @ presence.astype(np.float64) / norms[:, None] / norms[None, :]
    coefficients = regress(values, grams, y)
    weights = presence @ (coefficients / norms[:, None]).astype(np.float32)
    return Classifier(languages, known, weights)


def _predicted(sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = sent.value
        find = Runs(model.known)
        for b in batches:
            names, scores = [], []
            texts = b.column("_text").cast(pa.binary())
            for at in range(0, b.num_rows, _GROUP):
                found = [find.present(t.as_py() or b"") for t in texts.slice(at, _GROUP)]
                if model.languages:
                    out = model.outputs([numbers for numbers, _ in found])
                    best = np.argmax(out, axis=1)
                    names += [model.languages[k] if letters else UNKNOWN for k, (_, letters) in zip(best.tolist(), found)]
                    scores += [float(np.clip(o[k], 0, 1)) if letters else 0.0 for o, k, (_, letters) in zip(out, best, found)]
                else:
                    names += [UNKNOWN] * len(found)
                    scores += [0.0] * len(found)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"]
            )

    return run


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """All rows and columns of `docs`, with held_out, lang_pred and score (0 to 1).

    Learned from the texts and languages of rows whose id, as text, has a crc32 that is not 2
    modulo 4 (a null id is as an empty text), whose language is known and whose text has a letter
    and at most `FIT_BYTES` bytes: of those the same number for each language, `fit_rows` in all,
    copies once. A language with none such is not learned. The score is the least-squares output for the predicted language, which estimates
    how likely it is, cut to 0 to 1; equal outputs go to the smaller name. Null texts, texts
    without a letter, and all texts when nothing could be learned, are `und` with score 0.
    Repeated rows are scored each for itself. The added columns replace those of the same name.
    More than `MOST_LANGUAGES` languages are an error.
    """
    spark = prepared(docs.sparkSession)
    learned = docs.where(~held_out(F.col(f"`{id_col}`"))).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")
    )
    model = train(learned, landmarks, fit_rows)
    rows = packed(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), "_rest", F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(_predicted(spark.sparkContext.broadcast(model)), schema).withColumn("held_out", held_out(F.col("_id")))
    return unpacked(out, docs, ["held_out", "lang_pred", "score"], **{id_col: "_id", text_col: "_text"})
