"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .staging import dropped, prepared, written

MOST_ROUNDS = 60
CHUNK = 1 << 18


def _forest(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Each node but the smallest of its component here, that smallest, and whether this differs from the edges."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]], bool((root[a] != b).any())


def _contracted(chunk: int):
    """The edges of a task as stars, a bounded number at a time: a node is `hi` once in each."""
    names = ["hi", "lo", "moved"]

    def star(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(edges)
        hi, lo, moved = _forest(table.column("hi").to_numpy(), table.column("lo").to_numpy())
        return pa.record_batch([pa.array(hi), pa.array(lo), pa.array(np.full(len(hi), moved))], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk:
                yield star(held)
                held, rows = [], 0
        if rows:
            yield star(held)

    return run


def _tied(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them; one row for each (hi, lo) of `edges`.

    A node has as many rows as there are chunks that hold it as `hi`, however many neighbours it has.
    """
    of_node = Window.partitionBy("hi").orderBy("lo", F.col("moved").desc())
    seen = edges.select("hi", "lo", "moved", F.first("lo").over(of_node).alias("m"), F.lag("lo").over(of_node).alias("before"))
    return seen.where("before is null or before <> lo").select(
        F.when(F.col("before").isNull(), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"),
        (F.col("moved") | F.col("before").isNotNull()).alias("moved"),
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge to another.

    Each round ties the neighbours of a node to their smallest one, first the larger, then
    the smaller neighbours; the rounds needed grow with the logarithm of the graph's size.
    Tasks make stars of the edges they read, a chunk at a time, so that no node has more smaller
    neighbours than there are chunks. Minima are combined before the shuffle and joined back,
    so that a node with many larger neighbours is no group in one task. Edges with a null end
    are no edges.
    """
    prepared(edges.sparkSession)

    def stars(rows: DataFrame) -> DataFrame:
        return rows.select("hi", "lo").mapInArrow(_contracted(chunk), "hi long, lo long, moved boolean")

    given = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")
    )
    current = written(_tied(stars(given)), "edges")
    for _ in range(MOST_ROUNDS):
        rows = stars(current)
        least = rows.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), "m")
        large = rows.join(least, rows.lo == least.node, "left").select(
            "hi", F.coalesce("m", "lo").alias("lo"), (F.col("moved") | F.col("m").isNotNull()).alias("moved")
        )
        before, current = current, written(_tied(large), "edges")
        dropped(before)
        # where nothing moved, each node had one smaller neighbour, and that one none
        if not current.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionAll(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
