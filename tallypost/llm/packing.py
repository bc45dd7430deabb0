"""Packing of token ids into sequences of one length, by column generation.

Each document's ids are cut into full sequences and a remainder. How remainders share
sequences is a cutting-stock problem over the histogram of their lengths, which has fewer
bins than a sequence has ids however many documents there are: a linear program over
patterns (how many remainders of each length go into one sequence), whose columns a knapsack
dynamic program prices. Patterns are used as often as the rounded-down solution says; the
few remainders left over, fewer than patterns times their items, are packed best fit first.
Remainders are ranked within their length, and ranges of ranks are dealt to the patterns, so
that a document finds its sequence and place by arithmetic.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .staging import prepared, written
from .text import slices
from .tokens import BYTE_BPE, encoder, tokenizer_path

CAPACITY = 1024
GAP, MOST_ROUNDS = 1e-3, 600
MOST_SENT = 1 << 20  # rows of three numbers that are sent to every task; more are joined by a shuffle

Pattern = dict[int, int]


def _best_pattern(prices: np.ndarray) -> tuple[float, Pattern]:
    """The dearest pattern under prices[length]; by dynamic programming over the room."""
    room = len(prices) - 1
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        values = best[c - 1 :: -1] + prices[1 : c + 1]
        at = int(np.argmax(values))
        if values[at] > best[c - 1]:
            best[c], last[c] = values[at], at + 1
        else:
            best[c] = best[c - 1]
    pattern: Pattern = {}
    c = room
    while c > 0:
        if last[c]:
            pattern[int(last[c])] = pattern.get(int(last[c]), 0) + 1
            c -= int(last[c])
        else:
            c -= 1
    return float(best[room]), pattern


def _first_patterns(demand: dict[int, int], capacity: int) -> tuple[list[Pattern], list[float], list[int]]:
    """Patterns that fill greedily from the longest length left, how often, and what each exhausts.

    A length is in no pattern after the one that exhausts it, so as columns the patterns are
    triangular: a basis to start from.
    """
    left = {length: float(n) for length, n in sorted(demand.items())}
    open_lengths = sorted(left)
    patterns, times, exhausts = [], [], []
    while open_lengths:
        pattern: Pattern = {}
        room, i = capacity, len(open_lengths)
        while i:
            i = bisect_left(open_lengths, room + 1, 0, i)
            if i:
                length = open_lengths[i - 1]
                pattern[length] = pattern.get(length, 0) + 1
                room -= length
        gone = min(pattern, key=lambda length: (left[length] / pattern[length], -length))
        n = left[gone] / pattern[gone]
        for length, copies in pattern.items():
            left[length] = max(0.0, left[length] - n * copies)
        patterns.append(pattern), times.append(n), exhausts.append(gone)
        open_lengths.remove(gone)
    return patterns, times, exhausts


def fractional_patterns(
    demand: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, most_rounds: int = MOST_ROUNDS
) -> list[tuple[Pattern, float]]:
    """A solution of the linear program within `gap` of its bound, as (pattern, times used).

    Revised simplex with an explicit inverse; its size is the number of different lengths.
    """
    lengths = sorted(demand)
    m = len(lengths)
    row = {length: i for i, length in enumerate(lengths)}
    basis, times, exhausts = _first_patterns(demand, capacity)
    # triangular, so inverted by substitution over its few entries
    inverse = np.zeros((m, m))
    holds: dict[int, list[tuple[int, int]]] = {length: [] for length in lengths}
    for column, pattern in enumerate(basis):
        for length, copies in pattern.items():
            holds[length].append((column, copies))
    for column, length in enumerate(exhausts):
        inverse[column, row[length]] = 1.0
        for earlier, copies in holds[length][:-1]:
            inverse[column] -= copies * inverse[earlier]
        inverse[column] /= holds[length][-1][1]
    used = np.array(times)
    bound = sum(length * n for length, n in demand.items()) / capacity
    at = np.array(lengths, np.int64)
    for _ in range(most_rounds if m else 0):
        dual = inverse.sum(axis=0)
        prices = np.full(capacity + 1, -1.0)
        prices[at] = dual
        value, pattern = _best_pattern(prices)
        total = used.sum()
        bound = max(bound, total / value)
        if value <= 1 + 1e-9 or total <= bound * (1 + gap) or np.ceil(total - 1e-6) <= np.ceil(bound - 1e-6):
            break
        items = [row[length] for length in pattern]
        step = inverse[:, items] @ np.array(list(pattern.values()), float)
        falls = np.flatnonzero(step > 1e-9)
        ratios = used[falls] / step[falls]
        out = int(falls[np.argmin(ratios)])
        times = float(ratios.min())
        used = np.maximum(used - times * step, 0)
        used[out] = times
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    return [(p, float(t)) for p, t in zip(basis, used) if t > 0]


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequences for single items, longest first, each into the fullest one it fits."""
    rooms: list[tuple[int, int]] = []
    made: list[Pattern] = []
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            i = bisect_left(rooms, (length, -1))
            room, number = rooms.pop(i) if i < len(rooms) else (capacity, len(made))
            if number == len(made):
                made.append({})
            made[number][length] = made[number].get(length, 0) + 1
            if room > length:
                insort(rooms, (room - length, number))
    return made


def plan(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, times) that hold exactly the demanded pieces."""
    short = {length: n for length, n in demand.items() if length < capacity}
    out = [(p, int(t + 1e-9)) for p, t in fractional_patterns(short, capacity)]
    left, whole = dict(short), []
    for pattern, times in out:
        # rounding noise must not use more than there is
        times = min([times, *(left[length] // n for length, n in pattern.items())])
        for length, n in pattern.items():
            left[length] -= n * times
        if times:
            whole.append((pattern, times))
    whole += [(p, 1) for p in best_fit({k: n for k, n in left.items() if n}, capacity)]
    if demand.get(capacity):
        whole.append(({capacity: 1}, demand[capacity]))
    return whole


def allotments(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, copies per sequence, first sequence, offset)."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern.items():
            first = taken.get(length, 0)
            taken[length] = first + copies * times
            rows.append((length, first, taken[length], copies, sequence, offset))
            offset += copies * length
        sequence += times
    return rows


def _pieces(path: str, end_id: int, capacity: int):
    names = ["part", "doc_id", "start", "length", "doc_tokens", "number", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc_ids = b.column("doc_id")
            for s in slices(b.column("text")):
                flat, counts = model.ids(s, model.units(s))
                ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                sizes = counts + 1
                per_doc = -(-sizes // capacity)
                doc = np.repeat(np.arange(s.n), per_doc)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                start = number * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                # how many of that length this task had before
                order = np.argsort(length, kind="stable")
                kinds, first, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64) * 4
                blobs = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(length), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.tobytes())]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), doc_ids.take(pa.array(s.row + doc)),
                     pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)),
                     pa.array(sizes[doc].astype(np.int64)), pa.array(rank), blobs], names=names,
                )

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and `end_id`; `start` counts its ids before the
    piece, `ids` are little-endian uint32 (left out without `with_ids`), `ids_crc32` their checksum. Within a sequence pieces lie gapless from offset
    0. Null and empty texts are one piece of one id. Rows with null or repeated ids are
    packed each for itself; other columns are not carried. No documents, no pieces.
    """
    spark = prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _pieces(vocabulary or tokenizer_path(BYTE_BPE), end_id, capacity),
            f"part int, doc_id {kind}, start long, length long, doc_tokens long, number long, ids binary",
        ), "pieces",
    )
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = counts.select(
        "part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base")
    )
    # at most `capacity` rows, whatever the input
    demand = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # bounded by patterns times items: thousands of rows of six numbers
    dealt = spark.createDataFrame(
        allotments(plan(demand, capacity)),
        "length long, first long, stop long, copies long, sequence long, place long",
    )
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    kept = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"]
    if not with_ids:
        kept.remove("ids")
    base = written(base, "bases")
    if base.count() <= MOST_SENT:  # else both sides are shuffled
        base = F.broadcast(base)
    ranked = pieces.select("part", "number", *kept).join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("number"))
    within = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(dealt), "length")
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
        .select(
            *kept,
            (F.col("sequence") + F.expr("(rank - first) div copies")).alias("sequence_id"),
            (F.col("place") + (within % F.col("copies")) * F.col("length")).alias("offset"),
        )
    )
