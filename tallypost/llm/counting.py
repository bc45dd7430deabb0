"""Token counts of whole texts; huge ones by overlapping chunks.

A text of more than `chunk` bytes is encoded by the library in chunks, with the place of every
id. The next chunk begins at an id boundary of the one before, `overlap` characters ahead of
its end. The two are spliced where both have the same ids at the same places for a run of
`RUN` ids that keeps clear of the left chunk's end.

Why such a boundary is stable: byte-pair merging gives a list of ids for a piece exactly if it
gives each two neighbours of it for their own text. Up to the splice the neighbours are the
left chunk's, behind it the right chunk's, and the two at the splice stand side by side in
the left chunk, as both go on with the same id. What a cut did to the right chunk's first
and the left chunk's last ids lies outside the run. Where no run is found, the overlap is
doubled, up to the whole chunk, and then the left chunk grows.
"""

from __future__ import annotations

from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .staging import packed, prepared, unpacked
from .text import Slice, slices
from .tokens import WORD_BPE, Encoder, encoder, tokenizer_path, word_units

CHUNK, OVERLAP, LIMIT = 1 << 15, 1 << 10, 2048
RUN = 8


class Chunk(NamedTuple):
    """Ids of text[low:high] and the places of each, in characters of the text."""

    low: int
    high: int
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def clean(self) -> np.ndarray:
        """Ids that begin where the one before has ended: bytes of one character share its place."""
        out = np.ones(len(self.ids), bool)
        out[1:] = (self.start[1:] >= self.end[:-1]) & (self.start[1:] > self.start[:-1])
        return np.flatnonzero(out)


def encoded(model: Encoder, text: str, low: int, high: int) -> Chunk:
    got = model.encode(text[low:high])
    places = np.array(got.offsets, np.int64).reshape(-1, 2) + low
    return Chunk(low, high, np.array(got.ids, np.int64), places[:, 0], places[:, 1])


def splice(left: Chunk, right: Chunk, end: int) -> tuple[int, int] | None:
    """Numbers of the ids, in the left and in the right chunk, at the first stable boundary."""
    clean = left.clean()
    last = len(left.ids) if left.high == end else len(left.ids) - 1
    for i in clean[left.start[clean] >= right.low].tolist():
        if i + RUN > last:
            return None
        j = int(np.searchsorted(right.start, left.start[i]))
        if j + RUN > len(right.ids):
            return None
        same = (
            np.array_equal(left.ids[i : i + RUN], right.ids[j : j + RUN])
            and np.array_equal(left.start[i : i + RUN], right.start[j : j + RUN])
            and np.array_equal(left.end[i : i + RUN], right.end[j : j + RUN])
        )
        if same:
            return i, j
    return None


def huge_count(model: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Ids of one text, holding the encoding of two chunks at most."""
    end, total = len(text), 0
    left, begin = encoded(model, text, 0, min(end, chunk + overlap)), 0
    while left.high < end:
        width, found = overlap, None
        while found is None and left.high < end:
            clean = left.clean()
            ahead = clean[(left.start[clean] <= left.high - width) & (clean >= begin)]
            low = int(left.start[ahead[-1]] if len(ahead) else left.start[begin] if begin < len(left.ids) else left.high)
            if low > left.low:
                right = encoded(model, text, low, min(end, low + chunk + overlap))
                found = splice(left, right, end) if right.high > left.high else None
            if found is None and width < left.high - left.low:
                width *= 2
            elif found is None:  # the whole chunk does not do: it grows to the right
                at = left.start[begin] if begin < len(left.ids) else left.high
                left = encoded(model, text, left.low, min(end, left.high + 2 * (left.high - left.low)))
                begin, width = int(np.searchsorted(left.start, at)), overlap
        if found is None:
            break
        total += found[0] - begin
        left, begin = right, found[1]
    return total + len(left.ids) - begin


def _counted(path: str, chunk: int, overlap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for b in batches:
            sizes, counts = [], []
            for s in slices(b.column("_text")):
                lengths = np.diff(s.offsets)
                huge = lengths > chunk
                small = _without(s, huge)
                units = word_units(small)
                n = np.diff(np.concatenate([[0], np.cumsum(model.counts(small, units))])[units.first])
                for i in np.flatnonzero(huge):
                    text = s.data[s.offsets[i] : s.offsets[i + 1]].tobytes().decode(errors="replace")
                    n[i] = huge_count(model, text, chunk, overlap)
                sizes.append(lengths)
                counts.append(n)
            more = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, counts)]
            base = b.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays(
                [*base.columns, *(pa.array(x, pa.int64()) for x in more)],
                names=[*base.schema.names, "n_bytes", "n_tokens"],
            )

    return run


def _without(s: Slice, gone: np.ndarray) -> Slice:
    """The slice with those texts emptied."""
    if not gone.any():
        return s
    keep = np.repeat(~gone, np.diff(s.offsets))
    lengths = np.where(gone, 0, np.diff(s.offsets))
    return Slice(s.row, s.data[keep], np.concatenate([[0], np.cumsum(lengths)]))


def count_tokens(
    docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """All rows of `docs` without the text, and n_bytes (UTF-8), n_tokens and over_limit.

    `vocabulary` is the path of a tokenizers file whose pre-tokenizer drops white space; no
    special ids are added, and special strings inside a text count as the file's default
    has them. Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each
    for itself. The added columns replace input columns of the same name.
    """
    prepared(docs.sparkSession)
    path = vocabulary or tokenizer_path(WORD_BPE)
    rows = packed(docs, text_col).select("_rest", F.col(text_col).alias("_text"))
    schema = T.StructType(
        [rows.schema["_rest"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    out = rows.mapInArrow(_counted(path, chunk, overlap), schema)
    out = out.withColumn("over_limit", F.col("n_tokens") > limit)
    return unpacked(out, docs.drop(text_col), ["n_bytes", "n_tokens", "over_limit"])
