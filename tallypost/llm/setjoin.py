"""Documents whose shingle sets are alike, by partitions of the universe of shingles.

Two sets of Jaccard similarity t or more differ in at most H shingles, where H follows from
the size of the smaller one. Sets are put in bands of size; a band's scheme hashes the
universe into m > H segments, so a pair that links agrees in at least m - H of them. A set is
indexed under the scheme of its own band and under that of the band below.

1. Coarse schemes (m a little over H) find the sets that agree with another one anywhere.
2. Among those, fine schemes (m about twice H) are indexed. Any choice of segments worth
   H + 1 finds all partners, where a segment taken exactly is worth 1 and one taken with its
   one-deletion neighbourhood is worth 2. Each set takes its cheapest segments, by how many
   sets share them; one that gets there with segments nobody shares has no partner. Sets that
   would have to take a much shared segment choose again among each other, with neighbourhoods.
3. Members of a shared segment are verified exactly against its smallest id, and what links
   is one component from then on. Only segments that still hold several components are
   verified in full, in blocks of bounded size, and only links between components are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .staging import dropped, prepared, written
from .text import LOWER, U, Slice, gram_hashes, inside_text, mix, slices, span_hashes, words

HOT = 32
BLOCK = 512
_COLUMNS = 4096
_WIDE, _WIDE_LOOSE = 200, 150  # largest size of a coarse band, in percent of the smallest
_ONE, _TWO, _PART, _DEL = U(0x51ED270B_0F2A7C55), U(0x2545F491_4F6CDD1D), U(0x632BE59B_D9B4E019), U(0x85EBCA6B_C2B2AE35)


@dataclass(frozen=True)
class Rule:
    """Shingles of `n` words; pairs link when 100 * intersection >= percent * union."""

    n: int
    percent: int

    def band(self, size: int) -> tuple[int, int, int]:
        """Number, smallest and largest size of the band that holds `size`."""
        low, number = 1, 0
        while True:
            high = low * 100 // self.percent
            if size <= high:
                return number, low, high
            low, number = high + 1, number + 1

    def most_differ(self, size: int) -> int:
        return size * (100 - self.percent) // self.percent

    @lru_cache(maxsize=1 << 16)
    def coarse_schemes(self, size: int) -> list[tuple[int, int, int, int]]:
        """(band, segments, how many of them to index, most empty ones to leave out) of wide bands.

        Of a scheme a set indexes the first segments only: enough for differences with any
        set not smaller, and some more. Of two sets the smaller one's are the ones both have,
        and one more than its surplus agree. If all of these are empty, both sets must name
        them: a set leaves out as many empty ones as the smallest set it can link with has
        for surplus. The scheme below is for sets that a smaller one of that band can still be like.
        """
        def some(most: int) -> tuple[int, int]:
            extra = max(1, -(-3 * (most + 1) // 10))
            return most + 1 + extra, extra

        def left_out(smallest: int) -> int:
            # sets that differ from no other have no scheme
            smallest = max(smallest, -(-size * self.percent // 100), -(-self.percent // (100 - self.percent)))
            return some(self.most_differ(smallest))[1]

        low, number, widest = 1, 0, _WIDE if self.percent >= 90 else _WIDE_LOOSE
        while True:
            high = max(low, low * widest // 100)
            if size <= high:
                break
            low, number = high + 1, number + 1
        out = []
        if self.most_differ(size) > 0:
            out.append((number, some(self.most_differ(high))[0], some(self.most_differ(size))[0], left_out(low)))
        below = low - 1
        if number and size * self.percent <= below * 100 and self.most_differ(below) > 0:
            m, _ = some(self.most_differ(below))
            out.append((number - 1, m, m, left_out(1)))
        return out

    @lru_cache(maxsize=1 << 16)
    def schemes(self, size: int) -> list[tuple[int, int, int]]:
        """(band, H of the band, H of a set of this size in it); none where H is 0."""
        number, low, high = self.band(size)
        out = [(number, self.most_differ(high), self.most_differ(size))]
        if number:
            below = self.most_differ(low - 1)
            out.append((number - 1, below, below))
        return [s for s in out if s[2] > 0]


def shingle_sets(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a slice, and where each text's begin.

    A text with fewer than n words has its whole sequence as the only one.
    """
    low = Slice(s.row, LOWER[s.data], s.offsets)
    w = words(low)
    h = span_hashes(low.data, w.start, w.end)
    inside = inside_text(w.first, n)
    grams, text = gram_hashes(h, n)[inside], w.text_of()[: len(inside)][inside]
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < n))
    if len(short):
        count = w.counts()
        own = np.concatenate([
            gram_hashes(h[w.first[i] : w.first[i + 1]], int(count[i])) + mix(count[i : i + 1].astype(np.uint64))
            for i in short
        ])
        text = np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        grams, text = np.concatenate([grams, own])[order], text[order]
    # equal within a text, wherever they stand: neighbours once sorted by (hash, text)
    order = np.argsort(grams + mix(text.astype(np.uint64) + _PART))
    again = (grams[order[1:]] == grams[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    keep = np.ones(len(grams), bool)
    keep[order[1:][again]] = False
    return grams[keep], np.searchsorted(text[keep], np.arange(s.n + 1))


def digests(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart, whatever their order."""
    out = []
    for salt in (_ONE, _TWO):
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ salt), out=sums[1:])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _segments(tokens: np.ndarray, band: int, m: int) -> np.ndarray:
    salt = mix(np.array([band * 1_000_003 + m], np.uint64))[0]
    return ((mix(tokens ^ salt) >> U(32)) * U(m) >> U(32)).astype(np.int64)


def _contents(tokens: np.ndarray, segment: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the sum that stands for its tokens, and their number."""
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, segment, mix(tokens ^ _DEL))
    return sums, np.bincount(segment, minlength=m)


def _named(sums: np.ndarray, segment: np.ndarray, band: int, m: int) -> np.ndarray:
    return mix(sums + mix(segment.astype(np.uint64) + U(band) * U(1 << 32) + U(m)))


def coarse_signatures(rule: Rule, tokens: np.ndarray) -> np.ndarray:
    out = []
    for band, m, indexed, left_out in rule.coarse_schemes(len(tokens)):
        sums, count = (x[:indexed] for x in _contents(tokens, _segments(tokens, band, m), m))
        named = _named(sums, np.arange(indexed), band, m)
        # of the segments that agree with a set not all are empty, unless more than `left_out` are
        out.append(named if (count == 0).sum() > left_out else named[count > 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fine_signatures(rule: Rule, tokens: np.ndarray) -> list[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, m, need, segment numbers, names, sums) per scheme."""
    out = []
    for band, most, own in rule.schemes(len(tokens)):
        m, need = 2 * (most + 1), own + 1
        sums, count = _contents(tokens, _segments(tokens, band, m), m)
        taken = np.flatnonzero(count > 0)
        if len(taken) < need:
            taken = np.arange(m)
        out.append((band, m, need, taken, _named(sums[taken], taken, band, m), sums))
    return out


def _prints(n: int):
    names = ["doc_id", "n_shingles", "d1", "d2"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                tokens, first = shingle_sets(s, n)
                d1, d2 = digests(tokens, first)
                yield pa.record_batch([b.column("doc_id").slice(s.row, s.n), np.diff(first).astype(np.int64), d1, d2], names=names)

    return run


def _coarse(rule: Rule):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set that comes again in this task has no need to
        for b in batches:
            for s in slices(b.column("text")):
                tokens, first = shingle_sets(s, rule.n)
                d1, _ = digests(tokens, first)
                new = []
                for i, x in enumerate(d1.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                found = [coarse_signatures(rule, tokens[first[i] : first[i + 1]]) for i in new]
                if found:
                    repeated = np.repeat(d1[new], [len(x) for x in found])
                    yield pa.record_batch([np.concatenate(found).view(np.int64), repeated], names=["sig", "d1"])

    return run


def scheme_sizes(rule: Rule, tokens: np.ndarray) -> list[dict[str, int]]:
    """Of each fine scheme its band, how many segments a set needs and how many it indexes."""
    out = []
    for band, most, own in rule.schemes(len(tokens)):
        m, need = 2 * (most + 1), own + 1
        filled = int(np.count_nonzero(np.bincount(_segments(tokens, band, m), minlength=m)))
        out.append({"band": band, "need": need, "taken": filled if filled >= need else m})
    return out


def _sets(rule: Rule):
    names = ["id", "size", "tokens", "schemes"]
    sizes = pa.list_(pa.struct([("band", pa.int64()), ("need", pa.int64()), ("taken", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, want = b.column("id"), (b.column("d1").to_numpy(), b.column("d2").to_numpy())
            for s in slices(b.column("text")):
                tokens, first = shingle_sets(s, rule.n)
                d1, d2 = digests(tokens, first)
                same = np.flatnonzero((d1 == want[0][s.row : s.row + s.n]) & (d2 == want[1][s.row : s.row + s.n]))
                own = [np.sort(tokens[first[i] : first[i + 1]]).view(np.int64) for i in same]
                yield pa.record_batch(
                    [ids.take(pa.array(s.row + same)), pa.array([len(x) for x in own], pa.int64()),
                     pa.array(own, pa.list_(pa.int64())),
                     pa.array([scheme_sizes(rule, x.view(np.uint64)) for x in own], sizes)], names=names,
                )

    return run


def _fine(rule: Rule):
    """`record` packs need and number of signatures, both below 2^31."""
    names = ["id", "band", "record", "sig"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for id_, tokens in zip(b.column("id").to_pylist(), b.column("tokens")):
                tokens = tokens.values.to_numpy().view(np.uint64)
                for band, _, need, taken, named, _ in fine_signatures(rule, tokens):
                    row = [np.full(len(taken), id_), np.full(len(taken), band, np.int32)]
                    row += [np.full(len(taken), need << 32 | len(taken), np.int64), named.view(np.int64)]
                    for c, x in zip(columns, row):
                        c.append(x)
            if columns[0]:
                yield pa.record_batch([np.concatenate(c) for c in columns], names=names)

    return run


def _neighbourhoods(rule: Rule):
    """Exact contents and one-deletion variants of the segments of the bands asked for."""
    names = ["id", "band", "need", "segment", "exact", "sig"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for id_, asked, tokens in zip(b.column("id").to_pylist(), b.column("bands").to_pylist(), b.column("tokens")):
                tokens = tokens.values.to_numpy().view(np.uint64)
                for band, m, need, taken, named, sums in fine_signatures(rule, tokens):
                    if band not in asked:
                        continue
                    segment = _segments(tokens, band, m)
                    without = _named(sums[segment] - mix(tokens ^ _DEL), segment, band, m)
                    seg, sig = np.concatenate([taken, segment]), np.concatenate([named, without])
                    exact = np.arange(len(seg)) < len(taken)
                    row = [np.full(len(seg), x, np.int64) for x in (id_, band, need)]
                    for c, x in zip(columns, [*row, seg.astype(np.int64), exact, sig.view(np.int64)]):
                        c.append(x)
            if columns[0]:
                yield pa.record_batch([np.concatenate(c) for c in columns], names=names)

    return run


def _verified(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("left"), b.column("right")
            links = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (c[i].values.to_numpy().view(np.uint64) for c in (left, right))  # sorted as such
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                links[i] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(np.flatnonzero(links))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], names=["a", "b"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of bounded slices of 0/1 columns."""
    tokens = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), _COLUMNS):
        a, e = np.searchsorted(column, [low, low + _COLUMNS])
        bits = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        bits[owner[a:e], column[a:e] - low] = 1
        out += bits[: len(left)] @ bits[len(left) :].T
    return out.astype(np.int64)


def _block_links(percent: int):
    """Links between components among the rows of two blocks; only those that merge some."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("tokens")]
        own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        rows = np.flatnonzero(own == i), np.flatnonzero(own == j)
        left, right = [sets[k] for k in rows[0]], [sets[k] for k in rows[1]]
        pairs: list[tuple[int, int]] = []
        if left and right:
            both = _overlaps(left, right)
            sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
            linked = (100 * both >= percent * (sizes - both)) & (comp[rows[0]][:, None] != comp[rows[1]][None, :])
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = parent.get(parent[x], parent[x])
                    x = parent[x]
                return x

            for p, q in np.argwhere(linked):
                a, b = int(rows[0][p]), int(rows[1][q])
                x, y = root(int(comp[a])), root(int(comp[b]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    pairs.append((int(ids[a]), int(ids[b])))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _members(sets: DataFrame, rule: Rule, hot: int) -> DataFrame:
    """(sig, id, chosen, low), written: who shares which signature, who relies on it, and the smallest of them."""
    # one shuffle serves the counts and the join with them: no name in common, or the plan is made twice
    # the many rows are kept small: a set's two schemes, of neighbouring bands, are told apart by one bit
    fine = (
        sets.select(F.col("number").alias("id"), "tokens").mapInArrow(_fine(rule), "id long, band int, record long, sig long")
        .select((F.col("id") * 2 + F.col("band") % 2).alias("slot"), "sig")
        .where("slot is not null and sig is not null").repartition("sig")
    )
    # asks for both columns, or the plan would shuffle once more for the counts alone
    shared = fine.groupBy("sig").agg(F.count("*").alias("f"), F.max("slot").alias("m")).where("f > 1 and m >= 0").select(F.col("sig").alias("s"), "f")
    slots = sets.select("id", "number", F.explode("schemes").alias("x")).select(
        "id", (F.col("number") * 2 + F.col("x.band") % 2).alias("slot"), "x.band", "x.need", "x.taken"
    )
    # at most as many rows of a set as it has segments
    chosen = (
        fine.join(shared, fine.sig == shared.s).groupBy("slot")
        .agg(F.sort_array(F.collect_list(F.struct("f", "sig"))).alias("all"))
        .join(slots, "slot").select("id", "band", "need", "taken", "all")
        .withColumn("lacks", F.expr("need - (taken - size(all))"))
        .where("lacks > 0")
        .withColumn("last", F.expr("all[least(lacks, size(all)) - 1].f"))
    )
    chosen = written(chosen, "allocation")
    rows = chosen.select("id", "band", "lacks", "last", F.posexplode("all").alias("k", "x"))
    exact = rows.select(
        F.col("x.sig").alias("sig"), "id",
        ((F.col("k") < F.col("lacks")) & (F.col("last") <= hot)).alias("chosen"),
    )
    # those that rely on a much shared segment choose again, among each other
    again = chosen.where(F.col("last") > hot).groupBy("id").agg(F.collect_set("band").alias("bands"))
    near = written(
        sets.join(again, "id").select("id", "bands", "tokens").mapInArrow(
            _neighbourhoods(rule), "id long, band long, need long, segment long, exact boolean, sig long"
        ), "neighbourhoods",
    )
    counts = near.groupBy("sig").agg(
        F.sum(F.col("exact").cast("long")).alias("n_exact"), F.sum((~F.col("exact")).cast("long")).alias("n_deleted")
    )
    counted = near.join(counts, "sig")
    costs = counted.groupBy("id", "band", "segment", "need").agg(
        F.max(F.when(F.col("exact"), F.col("n_exact") - 1)).alias("c1"),
        F.sum(F.when(F.col("exact"), F.col("n_exact") - 1 + F.col("n_deleted")).otherwise(F.col("n_exact"))).alias("c2"),
    )
    steps = costs.select(
        "id", "band", "segment", "need",
        F.explode(F.array(
            F.struct(F.col("c1").alias("cost"), F.lit(1).alias("level")),
            F.struct(F.greatest(F.col("c1"), F.col("c2") - F.col("c1")).alias("cost"), F.lit(2).alias("level")),
        )).alias("s"),
    )
    taken = steps.groupBy("id", "band", "need").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("s.cost", "s.level", "segment"))), 1, F.max("need").cast("int")).alias("best")
    )
    levels = (
        taken.select("id", "band", F.explode("best").alias("x")).where("x.cost > 0 or x.level = 2")
        .groupBy("id", "band", F.col("x.segment").alias("segment"))
        .agg(F.max("x.level").alias("level"), F.max("x.cost").alias("cost"))
    )
    again_rows = near.join(levels, ["id", "band", "segment"], "left").select(
        "sig", "id",
        F.coalesce((F.col("cost") > 0) & (F.col("exact") | (F.col("level") == 2)), F.lit(False)).alias("chosen"),
    )
    everyone = exact.unionByName(again_rows)
    useful = everyone.groupBy("sig").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.max("chosen").alias("any")
    ).where("low < high and any")
    members = written(everyone.join(useful.select("sig", "low"), "sig"), "members")
    dropped(chosen)
    dropped(near)
    return members


def link_components(docs: DataFrame, rule: Rule, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id long, text).

    A text without words, or null, has no shingles and links with nothing. Rows with one id
    count as one document that has the sets of all of them. Rows without id link with nothing
    and have no component. Equal sets are one class from the start.
    """
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(docs.mapInArrow(_prints(rule.n), "doc_id long, n_shingles long, d1 long, d2 long"), "prints")
    filled = prints.where("n_shingles > 0 and doc_id is not null")
    classes = written(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "classes")

    known = docs.where("doc_id is not null")
    # never null; said before the shuffle, or the joins say it on one side only and shuffle twice
    coarse = known.mapInArrow(_coarse(rule), "sig long, d1 long").where("sig is not null and d1 is not null").repartition("sig")
    shared = coarse.groupBy("sig").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select(F.col("sig").alias("s"))
    # written, so that the signatures' shuffle is gone before the texts are moved
    candidates = written(coarse.join(shared, coarse.sig == shared.s).select("d1").distinct().join(classes, "d1"), "candidates")
    # the texts move at every size: candidates grow with them
    sets = written(
        known.join(candidates.hint("merge"), known.doc_id == candidates.id).select("id", "d1", "d2", "text")
        .mapInArrow(_sets(rule), "id long, size long, tokens array<long>, schemes array<struct<band: long, need: long, taken: long>>")
        .withColumn("number", F.monotonically_increasing_id()), "sets",
    )
    dropped(candidates)
    members = _members(sets, rule, hot)
    stars = (
        members.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    )
    links = written(_verify(stars, sets, rule), "links")
    comps = components(links)

    placed = members.join(comps, members.id == comps.node, "left").select(
        "sig", "id", "low", F.coalesce("root", "id").alias("comp")
    )
    several = placed.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig")
    open_rows = written(placed.join(several, "sig").select("id", "low", "comp").distinct(), "open")
    dropped(members)
    more = _across(open_rows, sets, rule, block)
    dropped(open_rows)
    dropped(sets)
    final = components(links.unionByName(more))
    dropped(links)
    dropped(more)

    by_class = classes.join(final, classes.id == final.node, "left").select(
        "d1", "d2", F.coalesce("root", "id").alias("root")
    )
    return (
        prints.join(by_class, ["d1", "d2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("root")))
                .otherwise(F.col("doc_id")).alias("component_id"))
    )


def _verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    sized = sets.select(F.col("id"), "size", "tokens")
    p = rule.percent
    both = (
        pairs.join(sized.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("tokens").alias("left")), "a")
        .join(sized.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("tokens").alias("right")), "b")
        .where((F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * p))
    )
    return both.select("a", "b", "left", "right").mapInArrow(_verified(p), "a long, b long")


def _across(open_rows: DataFrame, sets: DataFrame, rule: Rule, block: int) -> DataFrame:
    """Links between different components inside the groups that signatures hold together, written."""
    groups = components(open_rows.select(F.col("id").alias("a"), F.col("low").alias("b")))
    docs = open_rows.select("id", "comp").distinct().join(groups, F.col("id") == F.col("node")).select(
        "id", "comp", F.col("root").alias("grp")
    )
    sizes = docs.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.expr(f"(n + {block} - 1) div {block}").cast("int").alias("blocks"))
    placed = docs.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.select(
        "grp", "id", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("grp", "id", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = written(dealt, "dealt")  # of known size: the join need not move all sets for a few rows
    more = written(
        dealt.join(sets.select("id", "tokens"), "id").select("grp", "i", "j", "own", "id", "comp", "tokens")
        .groupBy("grp", "i", "j").applyInArrow(_block_links(rule.percent), "a long, b long"), "more-links",
    )
    dropped(dealt)
    return more
