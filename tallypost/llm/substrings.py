"""Removal of long passages that an earlier document already holds.

Seed and extend. Winnowing picks seeds (runs of `seed` words) so that every run of `window`
words holds one that depends on its words alone; documents are joined on seeds that occur
in more than one text. Around each shared seed the match is extended to both sides: each
run of `window` words over the seed meets, by a 128-bit hash, the smallest document id that
holds it. Neighbouring runs found so merge into the maximal repeat. Comparing with the
smallest id instead of with each other document keeps the work linear in a group of copies.
"""

from __future__ import annotations

import hashlib
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .staging import packed, prepared, unpacked, written
from .text import U, Slice, Words, gram_hashes, inside_text, slices, sliding, span_hashes, words

WINDOW, SEED = 50, 20
_NO_ID = -(1 << 63)


def _seeds(s: Slice, window: int, seed: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the slice, indices of the words that begin a seed, and the seeds' hashes."""
    w = words(s)
    grams = gram_hashes(span_hashes(s.data, w.start, w.end), seed)
    span = window - seed + 1
    least = sliding(grams, span, np.minimum)
    least = np.where(inside_text(w.first, window)[: len(least)], least, U(0))
    around = np.zeros(len(grams) + span - 1, np.uint64)
    around[span - 1 : span - 1 + len(least)] = least
    chosen = (sliding(around, span, np.maximum) == grams) & inside_text(w.first, seed)
    at = np.flatnonzero(chosen)
    return w, at, grams[at]


def _seed_keys(window: int, seed: int):
    schema = pa.schema([("seed", pa.int64()), ("_key", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("_key").to_numpy(zero_copy_only=False)
            known = b.column("_id").to_numpy(zero_copy_only=False) != _NO_ID
            for s in slices(b.column("_text")):
                w, at, hashes = _seeds(s, window, seed)
                row = s.row + w.text_of()[at]
                ok = known[row]
                yield pa.record_batch([pa.array(hashes[ok].view(np.int64)), pa.array(keys[row[ok]])], schema=schema)

    return run


def _seed_places(window: int, seed: int):
    names = ["seed", "_id", "_key", "place"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("_key").to_numpy(zero_copy_only=False)
            ids = b.column("_id").to_numpy(zero_copy_only=False)
            for s in slices(b.column("_text")):
                w, at, hashes = _seeds(s, window, seed)
                text = w.text_of()[at]
                ok = ids[s.row + text] != _NO_ID
                at, hashes, text = at[ok], hashes[ok], text[ok]
                row = s.row + text
                place = (at - w.first[text]).astype(np.int32)
                yield pa.record_batch([hashes.view(np.int64), ids[row], keys[row], place], names=names)

    return run


def _covered(places: np.ndarray, before: int, after: int, most: int) -> np.ndarray:
    """Sorted positions in [0, most] at distance [-before, after] of some place."""
    if most < 0:
        return np.zeros(0, np.int64)
    change = np.zeros(most + 2, np.int64)
    low = np.clip(places - before, 0, most + 1)
    high = np.clip(places + after + 1, 0, most + 1)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def _windows(window: int, seed: int):
    names = ["h1", "h2", "_id", "_key", "place"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("_key").to_numpy(zero_copy_only=False)
            ids = b.column("_id").to_numpy(zero_copy_only=False)
            places = b.column("places")
            for s in slices(b.column("_text")):
                w = words(s)
                h = span_hashes(s.data, w.start, w.end)
                one, two = gram_hashes(h, window, 0), gram_hashes(h, window, 1)
                for i in range(s.n):
                    count = int(w.first[i + 1] - w.first[i])
                    near = places[s.row + i].values.to_numpy(zero_copy_only=False)
                    at = _covered(near, window - seed, 0, count - window)
                    g = at + w.first[i]
                    row = s.row + i
                    yield pa.record_batch(
                        [one[g].view(np.int64), two[g].view(np.int64), np.full(len(at), ids[row]),
                         np.full(len(at), keys[row]), at.astype(np.int32)], names=names,
                    )

    return run


def _kept(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            starts, whole = b.column("starts"), b.column("whole").to_pylist()
            counts, removed, spans, texts, digests = [], [], [], [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                parts = (text or "").encode().split()
                n = len(parts)
                if whole[i]:
                    gone = [(0, n)] if n >= window else []
                elif starts[i].is_valid:
                    at = _covered(starts[i].values.to_numpy(zero_copy_only=False), 0, window - 1, n - 1)
                    cuts = np.flatnonzero(np.diff(at) > 1)
                    gone = list(zip(at[np.r_[0, cuts + 1]].tolist(), (at[np.r_[cuts, len(at) - 1]] + 1).tolist()))
                else:
                    gone = []
                left, last = [], 0
                for a, e in gone:
                    left += parts[last:a]
                    last = e
                kept = b" ".join(left + parts[last:] if gone else parts)
                counts.append(n)
                removed.append(sum(e - a for a, e in gone))
                spans.append([{"start": a, "end": e} for a, e in gone])
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append((kept.decode() if gone else text))
            more = {
                "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, span), "_left": pa.array(texts, pa.string()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
            base = b.drop_columns(["starts", "whole", "_text", "_id", "_key"])
            yield pa.RecordBatch.from_arrays([*base.columns, *more.values()], names=[*base.schema.names, *more])

    return run


_ADDED = ["n_words", "n_removed", "spans", "kept_sha256"]
_SPANS = T.StructField("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))


def repeated_starts(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """(_id, _key, starts, whole): windows of each text that a smaller id holds, and exact copies.

    `rows` has _id (no nulls), _key (a hash of the text) and _text.
    """
    lean = rows.select("_id", "_key", "_text")
    shared = (
        lean.mapInArrow(_seed_keys(window, seed), "seed long, _key long")
        .groupBy("seed").agg(F.min("_key").alias("low"), F.max("_key").alias("high"))
        .where("low <> high").select("seed")
    )
    # A text equal to that of a smaller id goes as a whole and takes no part below.
    prints = rows.where(F.col("_id") != _NO_ID).select("_id", "_key", F.unhex(F.md5("_text")).alias("print"))
    first = prints.groupBy("print").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high")
    copies = written(
        prints.join(first, "print").where("_id > low").select("_id", "_key").distinct(), "copies"
    )
    places = written(
        lean.mapInArrow(_seed_places(window, seed), "seed long, _id long, _key long, place int")
        .join(shared, "seed").join(copies, ["_id", "_key"], "left_anti")
        .groupBy("_id", "_key").agg(F.collect_set("place").alias("places")), "seed-places",
    )
    around = rows.join(places, ["_id", "_key"]).select("_id", "_key", "_text", "places")
    found = around.mapInArrow(_windows(window, seed), "h1 long, h2 long, _id long, _key long, place int")
    earliest = found.groupBy("h1", "h2").agg(F.min("_id").alias("low"))
    starts = (
        found.join(earliest, ["h1", "h2"]).where("_id > low")
        .groupBy("_id", "_key").agg(F.collect_set("place").alias("starts"))
    )
    nowhere = F.lit(None).cast("array<int>")
    return starts.select("_id", "_key", "starts", F.lit(False).alias("whole")).unionByName(
        copies.select("_id", "_key", nowhere.alias("starts"), F.lit(True).alias("whole"))
    )


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """All rows and columns of `docs`; the text is what is left of it.

    A word goes when a run of `window` words over it also begins in a text with a smaller
    id; runs are judged on the input. A text that loses nothing stays as it is, else it is
    the kept words joined by one space. Added: n_words, n_removed, spans (word ranges that
    went), kept_sha256 (of the kept words joined by one space). They replace input columns
    of the same name.

    Null and empty texts have no words. A row without id keeps its text and removes nothing
    elsewhere. Rows with one id are not earlier than each other, so repeated rows all keep
    or all lose the same words. Ids are whole numbers.
    """
    prepared(docs.sparkSession)
    rows = packed(docs, id_col, text_col).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"),
        F.col(text_col).alias("_text"), F.col(id_col).alias("_own_id"), "_rest",
    )
    gone = repeated_starts(rows, window, seed)
    joined = rows.join(gone, ["_id", "_key"], "left").select(*rows.columns, "starts", "whole")
    schema = T.StructType(
        [joined.schema["_own_id"], joined.schema["_rest"], T.StructField("n_words", T.LongType()),
         T.StructField("n_removed", T.LongType()), _SPANS, T.StructField("_left", T.StringType()),
         T.StructField("kept_sha256", T.StringType())]
    )
    kept = joined.select("_own_id", "_rest", "_id", "_key", "_text", "starts", "whole").mapInArrow(_kept(window), schema)
    return unpacked(kept, docs, _ADDED, **{id_col: "_own_id", text_col: "_left"})
