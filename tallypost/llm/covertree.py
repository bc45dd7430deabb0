"""Exact near-duplicate pairs of embeddings by a dual traversal of cover trees.

Cosine similarity t is distance sqrt(2 - 2t) between unit vectors. All vectors of a label and a
number of components are the root of a tree. A node of more than `BLOCK` vectors is split: a
farthest-first order of a bounded sample of it gives centres, each vector goes to the nearest
one, and the farthest vector of a centre is its covering radius; so it goes on, level by level,
with one join per level, until nodes are small. The same levels are traversed in pairs: the
children of two nodes meet only if their centres are not further apart than both covering radii
and the distance sought. Inside a task two small nodes become nested nets of halving radii down
to the vectors, and node pairs are compared the same way. Whatever is pruned cannot link, so
the pairs found are all there are.
"""

from __future__ import annotations

import math
from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .staging import dropped, prepared, written

THRESHOLD = 0.98
BLOCK = 1024
SAMPLE = 1000  # vectors of a node that its centres are chosen from, at most
FAN = 64  # children of a node, at most
SALTS = 64  # tasks that the vectors of one node may be spread over while it is split
MOST_LEVELS = 60
_SLACK = 1e-7


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """Numbers of points, each the farthest from those before it."""
    if not len(points):
        return np.zeros(0, np.int64)
    order, nearest = [0], np.full(len(points), np.inf)
    while len(order) < min(most, len(points)):
        nearest = np.minimum(nearest, 2 - 2 * points @ points[order[-1]])
        at = int(np.argmax(nearest))
        if nearest[at] <= _SLACK:
            break
        order.append(at)
    return np.array(order)


class Level(NamedTuple):
    centres: np.ndarray  # numbers of points
    parent: np.ndarray  # number of the node in the level above
    radius: np.ndarray  # to the farthest descendant


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def levels(points: np.ndarray, finest: float) -> list[Level]:
    """Nested nets of halving radii, from one node down to the points themselves."""
    out = [Level(np.array([0]), np.array([0]), np.array([_distances(points, points[:1]).max(initial=0.0)]))]
    node = np.zeros(len(points), np.int64)  # of each point, in the level above
    radius = 1.0
    while radius > finest and len(out[-1].centres) < len(points) / 2:
        # a net inside each node: its points in order become centres when no centre is near
        centres, parents, own = [], [], np.empty(len(points), np.int64)
        for k in range(len(out[-1].centres)):
            left = np.flatnonzero(node == k)
            while len(left):
                d = _distances(points[left], points[left[:1]])[:, 0]
                near = d <= radius
                own[left[near]] = len(centres)
                centres.append(left[0])
                parents.append(k)
                left = left[~near]
            if len(centres) > len(points) / 2:
                break
        if len(centres) > len(points) / 2:
            break
        reach = np.zeros(len(centres))
        np.maximum.at(reach, own, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", points, points[np.array(centres)[own]]))))
        out.append(Level(np.array(centres), np.array(parents), reach))
        node, radius = own, radius / 2
    out.append(Level(np.arange(len(points)), node, np.zeros(len(points))))
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of unit vectors with cosine >= threshold."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    x, y = levels(a, reach), levels(b, reach)
    near = np.ones((1, 1), bool)
    for k in range(1, max(len(x), len(y))):
        # the shallower tree waits at its last level but one, the points come last in both
        i, j = x[min(k, len(x) - 2)], y[min(k, len(y) - 2)]
        rows = i.parent if k < len(x) - 1 else np.arange(len(i.centres))
        columns = j.parent if k < len(y) - 1 else np.arange(len(j.centres))
        near = near[np.ix_(rows, columns)]
        d = _distances(a[i.centres], b[j.centres])
        near &= d <= i.radius[:, None] + j.radius[None, :] + reach + _SLACK
    near = near[np.ix_(x[-1].parent, y[-1].parent)]
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    linked = (a[rows] @ b[columns].T >= threshold) & near[np.ix_(rows, columns)]
    p, q = np.nonzero(linked)
    return rows[p], columns[q]


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _centres(block: int):
    """Of a sample of a node, the centres of its children, as one row."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim, n = int(t.column("dim")[0].as_py()), int(t.column("n")[0].as_py())
        points = _unit(t.column("vector").chunk(0), dim)
        chosen = points[farthest_first(points, min(FAN, 2 * -(-n // block)))]
        return pa.table({
            "node": t.column("node").slice(0, 1), "dim": pa.array([dim], pa.int32()), "fan": pa.array([len(chosen)], pa.int32()),
            "centres": pa.array([chosen.tobytes()], pa.binary()),
        })

    return run


def _children(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors, those of split nodes in the child with the nearest centre.

    Rows come in order of (node, salt); the centres of a node, if it is split, before its vectors.
    """
    held: tuple[str, int, np.ndarray | None] | None = None
    names = ["id", "copies", "dim", "vector", "node", "away"]
    for b in batches:
        nodes, salts = b.column("node").to_pylist(), b.column("salt").to_numpy()
        is_vector = b.column("centres").is_null().to_numpy(zero_copy_only=False)
        away = b.column("away").fill_null(0.0).to_numpy().copy()
        edges = [0, *(i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1] or salts[i] != salts[i - 1]), len(nodes)]
        for low, high in zip(edges[:-1], edges[1:]):
            if low == high:
                continue
            key, dim = (nodes[low], int(salts[low])), int(b.column("dim")[low].as_py())
            if not is_vector[low]:
                held = (*key, np.frombuffer(b.column("centres")[low].as_py(), np.float64).reshape(-1, dim))
            elif held is None or held[:2] != key:
                held = (*key, None)
            rows = low + np.flatnonzero(is_vector[low:high])
            if held[2] is None or not len(rows):
                continue
            d = _distances(_unit(b.column("vector").take(pa.array(rows)), dim), held[2])
            away[rows] = d.min(axis=1)
            for i, child in zip(rows.tolist(), d.argmin(axis=1).tolist()):
                nodes[i] = f"{key[0]}.{child}"
        out = [*(b.column(c) for c in names[:4]), pa.array(nodes, pa.string()), pa.array(away)]
        yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(is_vector))


def _apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes with the distance of their centres; 0 where one has none."""
    for b in batches:
        left, right = b.column("centre1"), b.column("centre2")
        known = left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False)
        apart = np.zeros(b.num_rows)
        for i in np.flatnonzero(known).tolist():
            x, y = (np.frombuffer(c[i].as_py(), np.float64) for c in (left, right))
            apart[i] = np.sqrt(max(0.0, 2 - 2 * float(x @ y)))
        kept = ["node1", "node2", "radius1", "radius2"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(apart)], names=[*kept, "apart"])


def _pairs(threshold: float):
    """Links between two blocks: per vector how many, and those that join components here."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim = int(t.column("dim")[0].as_py())
        ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
        own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
        points = _unit(t.column("vector").chunk(0), dim)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n_links = np.zeros(len(ids), np.int64)
        joined: list[tuple[int, int]] = []
        if len(left) and len(right):
            # a dual traversal inside the task
            p, q = close_pairs(points[left], points[right], threshold)
            p, q = left[p], right[q]
            if i[0] == j[0]:
                keep = p < q
                p, q = p[keep], q[keep]
            np.add.at(n_links, p, copies[q])
            np.add.at(n_links, q, copies[p])
            parent = np.arange(len(ids))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for a, b in zip(p.tolist(), q.tolist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[y] = x
                    joined.append((int(ids[a]), int(ids[b])))
        has = np.flatnonzero(n_links)
        none = [None] * len(has)
        return pa.table({
            "id": pa.array([*ids[has].tolist(), *[None] * len(joined)], pa.int64()),
            "n": pa.array([*n_links[has].tolist(), *[None] * len(joined)], pa.int64()),
            "a": pa.array([*none, *[x[0] for x in joined]], pa.int64()),
            "b": pa.array([*none, *[x[1] for x in joined]], pa.int64()),
        })

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; named after `id_col`.

    Vectors link within one label (not null) and one number of components. Null, zero and
    empty vectors, and those with null or non-finite components, link with nothing and are
    their own component; so are rows without id, whose component is null. Exact copies link
    with each other and are compared once. Rows with one id count as one vector that has the
    links of all of them. `kept` marks the smallest id of each component. An empty table
    gives an empty result; other columns are not carried.
    """
    spark = prepared(vectors.sparkSession)
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("vector"),
        F.coalesce(
            (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(),
            F.lit(False),
        ).alias("valid"),
        F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"),
    )
    valid = rows.where("valid")
    classes = written(
        valid.groupBy("label", "h1", "h2").agg(
            F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")
        ).withColumn("dim", F.size("vector")), "vector-classes",
    )
    root = F.concat_ws("/", F.hex(F.xxhash64("label", "dim")), F.col("label").cast("string"), F.col("dim"))
    placed = written(classes.select("id", "copies", "dim", "vector", root.alias("node"), F.lit(2.0).alias("away")), "vector-nodes")
    placed, pairs = _traversed(placed, math.sqrt(max(0.0, 2 - 2 * threshold)), block)

    # what is still large holds vectors too close to part: its blocks are a hash's
    parts = placed.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    both = pairs.unionAll(pairs.where("node1 <> node2").select(F.col("node2").alias("node1"), F.col("node1").alias("node2")))
    meets = both.join(parts.select(F.col("node").alias("node2"), "parts"), "node2").select(
        F.col("node1").alias("node"), "node2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2")
    )
    own_part = placed.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    name = lambda node, part: F.concat_ws("-", node, part)
    dealt = own_part.join(meets, "node").select(
        "dim", "id", "copies", "vector", name("node", "part").alias("own"), name("node2", "part2").alias("other")
    ).select("dim", "id", "copies", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = written(dealt.groupBy("i", "j").applyInArrow(_pairs(threshold), "id long, n long, a long, b long"), "vector-links")
    dropped(placed)
    comps = components(found.where("a is not null").select("a", "b"))
    totals = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    by_class = (
        classes.join(totals, "id", "left").join(comps, classes.id == comps.node, "left")
        .select(
            "label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "id").alias("root"),
        )
    )
    # rows that link with nothing stay out of the join: they would share a key
    nothing = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root"))
    linked = rows.where("valid").join(by_class, ["label", "h1", "h2"], "left").select("id", "n_links", "root")
    return linked.unionAll(nothing).select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
        F.coalesce(F.coalesce("root", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def _traversed(placed: DataFrame, reach: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The vectors in the leaves of their trees, and the pairs of leaves (node1 <= node2) that may hold links.

    `placed` (id, copies, dim, vector, node, away) is written, and has a root node per tree.
    """
    columns = ["id", "copies", "dim", "vector", "node", "away"]
    roots = placed.select("node").distinct()
    nodes = written(roots.select("node", F.lit(2.0).alias("radius"), F.lit(None).cast("binary").alias("centre")), "nodes")
    pairs = written(roots.select(F.col("node").alias("node1"), F.col("node").alias("node2")), "node-pairs")
    whole: DataFrame | None = None  # nodes that cannot be split
    for _ in range(MOST_LEVELS):
        sizes = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        large = sizes.where((F.col("n") > block) & (F.col("radius") > reach / 2)).select("node", "n")
        large = written(large if whole is None else large.join(whole, "node", "left_anti"), "large-nodes")
        if large.isEmpty():
            break
        # a bounded sample of each node, the same in every run
        order = Window.partitionBy("node").orderBy(F.xxhash64("id"), "id")
        sample = placed.join(large, "node").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= SAMPLE)
        centres = written(
            sample.select("node", "dim", "n", "vector").groupBy("node")
            .applyInArrow(_centres(block), "node string, dim int, fan int, centres binary"), "node-centres",
        )
        # the vectors of a node are spread over salts, and each salt has its centres
        salted = placed.select(*columns, F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("centres"))
        ahead = centres.select(
            *[F.col(c) if c in ("dim", "node") else F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in columns],
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "centres",
        )
        following = written(
            salted.unionAll(ahead).repartition("node", "salt").sortWithinPartitions("node", "salt", F.col("centres").isNull())
            .mapInArrow(_children, "id long, copies long, dim int, vector array<double>, node string, away double"), "vector-nodes",
        )
        # a node with one centre has no two vectors apart in its sample
        single = centres.where("fan = 1").select(F.concat_ws(".", "node", F.lit(0)).alias("node"))
        whole = written(single if whole is None else whole.unionAll(single), "whole-nodes")
        nodes, pairs = _met(pairs, nodes, centres, following, reach)
        for old in (placed, large, centres):
            dropped(old)
        placed = following
    return placed, pairs


def _met(pairs: DataFrame, nodes: DataFrame, centres: DataFrame, following: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, radius, centre) and pairs of the next level; a node that was not split is its own child."""
    width = F.col("dim") * 8
    kids = centres.select(F.col("node").alias("parent"), "dim", "centres", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("child")).select(
        "parent", F.concat_ws(".", "parent", "child").alias("node"), F.substring("centres", F.col("child") * width + 1, width).alias("centre")
    )
    radii = following.groupBy("node").agg(F.max("away").alias("radius"))
    same = nodes.join(centres.select("node"), "node", "left_anti").select(F.col("node").alias("parent"), "node", "radius", "centre")
    every = written(kids.join(radii, "node").select("parent", "node", "radius", "centre").unionAll(same), "children")
    one, two = (every.select(*[F.col(c).alias(f"{c}{i}") for c in every.columns]) for i in (1, 2))
    offered = (
        pairs.select(F.col("node1").alias("parent1"), F.col("node2").alias("parent2")).join(one, "parent1").join(two, "parent2")
        .where((F.col("parent1") < F.col("parent2")) | (F.col("node1") <= F.col("node2")))
    )
    apart = offered.select("node1", "node2", "radius1", "radius2", "centre1", "centre2").mapInArrow(
        _apart, "node1 string, node2 string, radius1 double, radius2 double, apart double"
    )
    near = apart.where((F.col("node1") == F.col("node2")) | (F.col("apart") <= F.col("radius1") + F.col("radius2") + reach + 1e-6))
    met = written(near.select(F.least("node1", "node2").alias("node1"), F.greatest("node1", "node2").alias("node2")), "node-pairs")
    left = written(every.drop("parent"), "nodes")
    for old in (every, nodes, pairs):
        dropped(old)
    return left, met
