"""Hard negatives by a vertical scan: dimension by dimension, until bounds settle a row.

Rows are kept in blocks of columns, one per dimension, with the least and the largest value of
each. An anchor reads the columns in the order of its own components, largest magnitude first.
After each step the columns not read yet can add to the score of a row no more than the sum of
component times least or largest value allows. Rows that can no longer reach what is asked for
leave the anchor's candidates; the others are read to the end, so the scores are exact.

Two scans over the blocks: the first asks for the best rows of the anchor's label (its
positives), the second for the best rows of other labels inside each positive's window.
Anchors come in portions of bounded size, each sent to all tasks; every task answers with its
own best rows for each question, which a window over the question then merges.
"""

from __future__ import annotations

from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import prepared, written

BLOCK = 8192  # rows of a block
PORTION_BYTES = 16 << 20  # anchors that are sent to the tasks at a time
STEP = 8  # dimensions between two looks at the bounds
_SAFE = 1 << 62

_BLOCKS = "dims int, n int, ids binary, labels binary, least binary, largest binary, columns array<binary>"


def _blocks(rows: int):
    """Blocks of rows with equally many components, in columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def made(dims: int) -> pa.RecordBatch:
            parts = open_.pop(dims)
            ids, labels = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            columns = np.ascontiguousarray(np.concatenate([p[2] for p in parts]).T)
            least, largest = (columns.min(axis=1), columns.max(axis=1)) if dims else (columns[:, 0], columns[:, 0])
            return pa.record_batch(
                [pa.array([dims], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([labels.tobytes()]),
                 pa.array([least.tobytes()]), pa.array([largest.tobytes()]),
                 pa.array([[c.tobytes() for c in columns]], pa.list_(pa.binary()))],
                names=["dims", "n", "ids", "labels", "least", "largest", "columns"],
            )

        for b in batches:
            lengths = b.column("v").value_lengths().to_numpy()
            flat = b.column("v").flatten().to_numpy()
            start = np.concatenate([[0], np.cumsum(lengths)])
            ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
            for dims in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dims)
                values = flat[(start[mine][:, None] + np.arange(dims)[None, :]).ravel()].reshape(len(mine), dims)
                for at in range(0, len(mine), rows):
                    some = slice(at, at + rows)
                    open_.setdefault(dims, []).append((ids[mine[some]], labels[mine[some]], values[some]))
                    if sum(len(p[0]) for p in open_[dims]) >= rows:
                        yield made(dims)
        for dims in list(open_):
            yield made(dims)

    return run


class Block(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    least: np.ndarray
    largest: np.ndarray
    columns: list[np.ndarray]


def _read(b: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    def numbers(raw) -> np.ndarray:
        return np.frombuffer(raw.as_py(), np.int64)

    for i in range(b.num_rows):
        cell = {name: b.column(name)[i] for name in b.schema.names}
        yield cell["dims"].as_py(), Block(
            *(numbers(cell[c]) for c in ("ids", "labels", "least", "largest")),
            [np.frombuffer(c, np.int64) for c in cell["columns"].as_py()],
        )


class Anchors(NamedTuple):
    """A portion of anchors of equally many components."""

    numbers: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # a row each


class Best:
    """The best rows so far for one question: higher scores first, then smaller ids."""

    def __init__(self, most: int):
        self.most, self.scores, self.ids = most, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def enough(self) -> int | None:
        """The score that a row must reach to matter; None while any does."""
        return int(self.scores[-1]) if len(self.scores) >= self.most else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]


def scan(block: Block, q: np.ndarray, rows: np.ndarray, wanted: list[tuple[int | None, int | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows among `rows` that lie in one of the `wanted` score ranges (both ends in), and their exact scores.

    An end that is None is open.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    a, b = q * block.least, q * block.largest
    # what the dimensions behind position k of the order can add
    low = np.concatenate([np.cumsum(np.minimum(a, b)[order][::-1])[::-1], [0]])
    high = np.concatenate([np.cumsum(np.maximum(a, b)[order][::-1])[::-1], [0]])
    score = np.zeros(len(rows), np.int64)
    for at in range(0, len(order) if len(rows) else 0, STEP):
        for d in order[at : at + STEP]:
            score += q[d] * (block.columns[d] if len(rows) == len(block.ids) else block.columns[d][rows])
        k = min(at + STEP, len(order))
        able = np.zeros(len(rows), bool)
        for least, most in wanted:
            fits = np.ones(len(rows), bool)
            if least is not None:
                fits &= score >= least - high[k]
            if most is not None:
                fits &= score <= most - low[k]
            able |= fits
        if not able.all():
            rows, score = rows[able], score[able]
            if not len(rows):
                break
    return rows, score


def _safe(block: Block, vectors: np.ndarray) -> None:
    """Products and their sums must not overflow."""
    reach = np.maximum(np.abs(block.least), np.abs(block.largest)).astype(float)
    if len(vectors) and (np.abs(vectors).astype(float) @ reach).max() >= _SAFE:
        raise ArithmeticError("a score does not fit into a long")


def _positives(portion, most: int):
    """(anchor, id, score): the best rows of the anchor's label in this task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: dict[int, Anchors] = portion.value
        best: dict[int, Best] = {}
        for b in batches:
            for dims, block in _read(b):
                if dims not in anchors:
                    continue
                a = anchors[dims]
                _safe(block, a.vectors)
                by_label = {int(x): np.flatnonzero(block.labels == x) for x in np.unique(a.labels)}
                for number, id_, label, q in zip(a.numbers.tolist(), a.ids, a.labels.tolist(), a.vectors):
                    rows = by_label[label]
                    rows = rows[block.ids[rows] != id_]
                    mine = best.setdefault(number, Best(most))
                    rows, scores = scan(block, q, rows, [(mine.enough, None)])
                    mine.add(scores, block.ids[rows])
        for number, mine in best.items():
            yield pa.record_batch(
                [pa.array([number] * len(mine.ids), pa.int64()), pa.array(mine.ids), pa.array(mine.scores)],
                names=["anchor", "id", "score"],
            )

    return run


def _negatives(portion, asked, most: int, low: int, high: int):
    """(anchor, positive, id, score): the best rows of other labels in each window, in this task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: dict[int, Anchors] = portion.value
        positives: dict[int, list[tuple[int, int]]] = asked.value  # anchor -> (rank, score)
        best: dict[tuple[int, int], Best] = {}
        for b in batches:
            for dims, block in _read(b):
                if dims not in anchors:
                    continue
                a = anchors[dims]
                others = {int(x): np.flatnonzero(block.labels != x) for x in np.unique(a.labels)}
                for number, label, q in zip(a.numbers.tolist(), a.labels.tolist(), a.vectors):
                    # low p <= 100 n <= high p, in whole numbers
                    windows = [(rank, -(-low * p // 100), high * p // 100) for rank, p in positives.get(number, [])]
                    windows = [w for w in windows if w[1] <= w[2]]
                    if not windows:
                        continue
                    wanted = []
                    for rank, least, most_ in windows:
                        enough = best.setdefault((number, rank), Best(most)).enough
                        wanted.append((least if enough is None else max(least, enough), most_))
                    rows, scores = scan(block, q, others[label], wanted)
                    ids = block.ids[rows]
                    for (rank, _, _), (least, most_) in zip(windows, wanted):
                        fits = (scores >= least) & (scores <= most_)
                        best[number, rank].add(scores[fits], ids[fits])
        for (number, rank), mine in best.items():
            yield pa.record_batch(
                [pa.array([number] * len(mine.ids), pa.int64()), pa.array([rank] * len(mine.ids), pa.int32()), pa.array(mine.ids), pa.array(mine.scores)],
                names=["anchor", "positive", "id", "score"],
            )

    return run


def _merged(rows: DataFrame, most: int, *question: str) -> DataFrame:
    order = Window.partitionBy(*question).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _anchor_portions(blocks: DataFrame) -> Iterator[dict[int, Anchors]]:
    """Anchors by number of components, read from the written blocks, a bounded number at a time."""
    held: dict[int, list[Block]] = {}
    size, number = 0, 0

    def portion() -> dict[int, Anchors]:
        nonlocal number
        out = {}
        for dims, parts in held.items():
            n = sum(len(p.ids) for p in parts)
            vectors = np.concatenate([np.array(p.columns, np.int64).reshape(dims, len(p.ids)).T for p in parts])
            out[dims] = Anchors(
                np.arange(number, number + n), np.concatenate([p.ids for p in parts]),
                np.concatenate([p.labels for p in parts]), np.ascontiguousarray(vectors),
            )
            number += n
        return out

    for row in blocks.toLocalIterator():
        ids, labels, least, largest = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "least", "largest"))
        held.setdefault(row["dims"], []).append(Block(ids, labels, least, largest, [np.frombuffer(c, np.int64) for c in row["columns"]]))
        size += len(row["ids"]) * (row["dims"] + 2)
        if size >= PORTION_BYTES:
            yield portion()
            held, size = {}, 0
    if held:
        yield portion()


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(256 x). The positives of an anchor are the best
    `positives` rows of its label with another id; for each, the best `negatives` rows of
    another label whose score is between `low` and `high` % of the positive's. Higher scores
    come first, ties by smaller id.

    Rows with a null id, label or vector, or a component that is null or not finite, take no
    part. Vectors meet only those with as many components. Each row with an anchor's id is an
    anchor of its own, and a repeated row counts as often as it is there. A positive score below
    zero has no window. No rows, or no anchors, give no rows. A score beyond 62 bits is an error.
    """
    spark = prepared(rows.sparkSession)
    context = spark.sparkContext
    vector = F.col(f"`{vector_col}`")
    used = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & usable(vector)).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        whole(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    blocks = written(used.drop("anchor").mapInArrow(_blocks(BLOCK), _BLOCKS), "vector-blocks")
    anchors = written(used.where("anchor").drop("anchor").mapInArrow(_blocks(BLOCK // 8), _BLOCKS), "anchor-blocks")

    out: DataFrame | None = None
    for portion in _anchor_portions(anchors):
        sent = context.broadcast(portion)
        found = written(_merged(blocks.mapInArrow(_positives(sent, positives), "anchor long, id long, score long"), positives, "anchor"), "positives")
        asked: dict[int, list[tuple[int, int]]] = {}
        for r in found.collect():  # `positives` rows per anchor of the portion
            asked.setdefault(r["anchor"], []).append((r["rank"], r["score"]))
        best = blocks.mapInArrow(
            _negatives(sent, context.broadcast(asked), negatives, low, high), "anchor long, positive int, id long, score long"
        )
        names = spark.createDataFrame(
            pa.table({
                "anchor": np.concatenate([a.numbers for a in portion.values()]),
                "anchor_id": np.concatenate([a.ids for a in portion.values()]),
            })
        )
        mined = _merged(best, negatives, "anchor", "positive").select(
            "anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
        )
        of = found.select("anchor", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        mined = written(
            mined.join(of, ["anchor", "positive"]).join(names, "anchor").select(
                "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
            ), "negatives",
        )
        out = mined if out is None else out.unionAll(mined)
    if out is None:
        nothing = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], nothing)
    return out
