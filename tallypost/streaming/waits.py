"""Waits for an event, each with its own bound, that may also be cancelled.

Waits, cancellations and events of an id meet in keyed state, in any order. What ends a wait
is decided by the times the rows carry, not by when they come in: a timer stands at the
earliest time that could end the wait, and when the watermark has reached it, nothing older
can come any more. So results do not depend on arrival order, and a wait ends as soon as the
watermark allows. The entry of an id goes when its wait ends; an event that nobody waits for
goes `keep` after it came.

Rows of one id meet in one task. Repeats are folded before the shuffle, per Arrow batch.
Ids are handed out in sequence, so rows are packed by blocks of neighbouring ids, state is kept
by blocks, and packs travel and a task asks Spark for a list and a timer by groups of
neighbouring blocks, not by ids. Entries stay each on their own: columns of numbers that are
settled together. A row is late when the watermark has reached its time.
"""

from __future__ import annotations

from typing import Iterable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..schemas import WAIT_SECONDS
from ..session import ship

DELAY = "3 minutes"
KEEP_SECONDS = 3600

MET, EXPIRED, CANCELLED = "met", "expired", "cancelled"
WAIT, CANCEL, EVENT = 0, 1, 2  # kinds of row

_INPUT = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("at", T.TimestampType()),
    T.StructField("seconds", T.IntegerType()), T.StructField("log_offset", T.LongType()), T.StructField("content", T.StringType()),
])
# Columns of so many rows, in little room, and the contents one behind the other.
_COLUMNS = [T.StructField("rows", T.IntegerType()), T.StructField("numbers", T.BinaryType()), T.StructField("content", T.BinaryType())]
# What is known of a block of ids: when the first entry is due, and the row of each id and kind that counts.
_BLOCK = T.StructType([T.StructField("timer", T.LongType()), *_COLUMNS])
# What ended in a group of blocks: for each wait id, result, start, end, length of the content.
_ENDED = T.StructType(_COLUMNS)
_RESULT = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("result", T.StringType()), T.StructField("waited_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()), T.StructField("content", T.StringType()),
])
ENTRY = "entry"  # name of the state variable
BLOCK_BITS = 8
# Blocks of so many ids share a list and a timer. A batch that touches one of them writes the list anew, some 100 KB.
GROUP_BITS = 12
# A task packs what it holds at this many rows or bytes.
PACK_ROWS, PACK_BYTES = 1 << 18, 1 << 25
# Rows of a block: the name of the block, the latest time, and for each row id, kind, time, seconds, offset as 64-bit numbers.
_PACK = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("at", T.TimestampType()),
    T.StructField("numbers", T.BinaryType()), T.StructField("content", T.ArrayType(T.StringType())),
])
# The packs of a group as one: the name of the group, the latest time, the rows.
_GROUP = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("at", T.TimestampType()), *_COLUMNS])
_LZ4 = pa.Codec("lz4_raw")
NEVER = np.iinfo(np.int64).max
# How waits end. At one moment an event comes before a cancellation, and either before the end of the bound.
HOW = (MET, CANCELLED, EXPIRED)


class Columns(NamedTuple):
    """Columns of 64-bit numbers, the last the length of a content in bytes (-1: null), and the contents."""

    numbers: np.ndarray
    content: np.ndarray

    def stored(self) -> tuple[int, bytes, bytes]:
        """In little room: steps from row to row, bytes of one weight together, compressed."""
        steps = np.ascontiguousarray(np.diff(self.numbers, axis=1, prepend=0))
        weights = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
        return self.numbers.shape[1], _LZ4.compress(weights, asbytes=True), _LZ4.compress(np.ascontiguousarray(self.content), asbytes=True)

    @classmethod
    def of(cls, stored, width: int = 6) -> Columns:
        rows, numbers, content = (stored[c.name] for c in _COLUMNS)
        weights = np.frombuffer(_LZ4.decompress(numbers, decompressed_size=width * rows * 8, asbytes=True), np.uint8)
        columns = np.cumsum(np.ascontiguousarray(weights.reshape(8, -1).T).view(np.int64).reshape(width, rows), axis=1)
        size = int(np.maximum(columns[-1], 0).sum())
        return cls(columns, np.frombuffer(_LZ4.decompress(content, decompressed_size=size, asbytes=True) if size else b"", np.uint8))

    def take(self, at: np.ndarray) -> Columns:
        """The rows at these positions, with their contents."""
        sizes = np.maximum(self.numbers[-1], 0)
        starts = np.cumsum(sizes) - sizes
        taken = sizes[at]
        shift = starts[at] - (np.cumsum(taken) - taken)
        return Columns(self.numbers[:, at], self.content[np.repeat(shift, taken) + np.arange(taken.sum())])

    def cut(self, firsts: np.ndarray) -> list[Columns]:
        """The rows from each of these positions to the next."""
        cuts = [*firsts.tolist(), self.numbers.shape[1]]
        bounds = np.append(0, np.cumsum(np.maximum(self.numbers[-1], 0)))[cuts].tolist()
        return [
            Columns(self.numbers[:, a:b], self.content[x:y]) for a, b, x, y in zip(cuts, cuts[1:], bounds, bounds[1:])
        ]

    @classmethod
    def joined(cls, parts: list[Columns]) -> Columns:
        if len(parts) == 1:
            return parts[0]
        return cls(np.concatenate([p.numbers for p in parts], axis=1), np.concatenate([p.content for p in parts]))


def _changes(names: np.ndarray) -> np.ndarray:
    """Where a run of one name begins."""
    return np.flatnonzero(np.append(True, names[1:] != names[:-1]))


def _first(rows: Columns) -> Columns:
    """The row of each id and kind that counts, in order of ids and kinds.

    Of several waits the earliest, then the one that ends first; of cancellations the
    earliest; of events the first.
    """
    ids, kinds, at, seconds, offsets, _ = rows.numbers
    order = np.lexsort((offsets, np.maximum(seconds, 0), at, kinds, ids))
    ids, kinds = ids[order], kinds[order]
    counts = np.ones(len(order), bool)
    counts[1:] = (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])
    return rows.take(order[counts])


def _ends(rows: Columns, keep: int) -> tuple[np.ndarray, ...]:
    """By the rows that count: their entries as numbers from 0; per entry start of the wait (NEVER: none), end, how, due, row of the event (-1).

    A cancellation before the wait is no other than one at its start. An entry is due at the
    watermark in milliseconds at which it can be settled: its end, or `keep` after what nobody waits for.
    """
    ids, kinds, at, seconds, _, _ = rows.numbers
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    entry = np.cumsum(new) - 1
    times = np.full((3, entry[-1] + 1), NEVER)
    times[kinds, entry] = at
    bound = np.full(times.shape[1], NEVER)
    bound[entry[kinds == WAIT]] = (at + np.maximum(seconds, 0) * 1_000_000)[kinds == WAIT]
    event = np.full(times.shape[1], -1)
    event[entry[kinds == EVENT]] = np.flatnonzero(kinds == EVENT)
    waited, cancelled, arrived = times[WAIT], times[CANCEL], times[EVENT]
    offered = np.stack([np.maximum(arrived, waited), np.maximum(cancelled, waited), bound])  # in the order of HOW
    how = offered.argmin(axis=0)
    end = offered.min(axis=0)
    # without a wait: after the last that is known
    alone = np.where(cancelled == NEVER, arrived, np.where(arrived == NEVER, cancelled, np.maximum(arrived, cancelled)))
    due = -(-np.where(waited == NEVER, alone + keep * 1_000_000, end) // 1000)
    return entry, waited, end, how, due, event


class Waits(StatefulProcessor):
    """Entries of a group of blocks, under the largest id of the group."""

    def __init__(self, keep: int):
        self._keep = keep

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getListState(ENTRY, _BLOCK)

    def _known(self) -> tuple[int | None, Columns | None]:
        blocks = [dict(zip(_BLOCK.names, b)) for b in self._state.get()]
        if not blocks:
            return None, None
        return min(b["timer"] for b in blocks), Columns.joined([Columns.of(b) for b in blocks])

    def _store(self, rows: Columns, due: np.ndarray, before: int | None) -> None:
        """By rows in order of ids and the time each is due. One timer, at the earliest time that could end an entry of the group."""
        timer = int(due.min())
        if before != timer:
            if before is not None:
                self._handle.deleteTimer(before)
            self._handle.registerTimer(timer)
        firsts = _changes(rows.numbers[0] >> BLOCK_BITS)
        timers = np.minimum.reduceat(due, firsts).tolist()
        self._state.put([(t, *block.stored()) for t, block in zip(timers, rows.cut(firsts))])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, known = self._known()
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        parts, held, changed = [] if known is None else [known], 0, False
        for pack in rows:
            part = Columns.of(pack)
            late = part.numbers[2] <= reached
            if late.any():
                part = part.take(np.flatnonzero(~late))
            if len(part.numbers[0]):
                parts.append(part)
                held, changed = held + len(part.numbers[0]), True
            if held >= PACK_ROWS:
                parts, held = [_first(Columns.joined(parts))], 0
        if changed:
            rows = _first(Columns.joined(parts))
            entry, _, _, _, due, _ = _ends(rows, self._keep)
            self._store(rows, due[entry], before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        timer, rows = self._known()
        if timer is None or timer > now:
            return  # an older timer
        # what the watermark has reached goes at once, so that no timer is set behind it
        now = max(now, timerValues.getCurrentWatermarkInMs())
        entry, waited, end, how, due, event = _ends(rows, self._keep)
        left = due > now
        if left.any():
            stay = np.flatnonzero(left[entry])
            self._store(rows.take(stay), due[entry[stay]], None)  # Spark drops the timer that has expired
        else:
            self._state.clear()
        over = np.flatnonzero(~left & (waited != NEVER))
        if len(over):
            met = how[over] == HOW.index(MET)
            ids = rows.numbers[0, np.searchsorted(entry, over)]
            events = rows.take(event[over[met]])
            lengths = np.full(len(over), -1)
            lengths[met] = events.numbers[-1]
            ended = Columns(np.stack([ids, how[over], waited[over], end[over], lengths]), events.content)
            yield Row(**dict(zip(_ENDED.names, ended.stored())))

    def close(self) -> None:
        pass


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each id and kind the earliest row of a batch; waits of one time in order of their bounds."""
    for b in batches:
        table = pa.Table.from_batches([b])
        order = pc.sort_indices(table, [(c, "ascending") for c in ("id", "kind", "at", "seconds", "log_offset")]).to_numpy()
        ids, kinds = (b.column(c).to_numpy()[order] for c in ("id", "kind"))
        first = np.ones(len(order), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])
        yield b.take(pa.array(np.sort(order[first])))


def _pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row per block of ids. A block goes by its largest id: those of negative ids are negative."""
    b = next(_folded(pa.Table.from_batches(batches).combine_chunks().to_batches()))
    columns = [b.column("at").cast(pa.int64()) if c == "at" else b.column(c) for c in ("id", "kind", "at", "seconds", "log_offset")]
    numbers = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
    order = np.argsort(numbers[:, 0], kind="stable")
    numbers = np.ascontiguousarray(numbers[order])
    blocks = numbers[:, 0] | ((1 << BLOCK_BITS) - 1)
    first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    bounds = np.append(first, len(blocks)).astype(np.int32)
    packed = pa.Array.from_buffers(
        pa.binary(), len(first), [None, pa.py_buffer(bounds * numbers.itemsize * numbers.shape[1]), pa.py_buffer(numbers)]
    )
    latest = pa.array(np.maximum.reduceat(numbers[:, 2], first)).cast(b.schema.field("at").type)
    content = pa.ListArray.from_arrays(pa.array(bounds), b.column("content").take(pa.array(order)))
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks[first].astype(np.int32)), latest, packed, content], names=_PACK.names
    )


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= PACK_ROWS or sum(h.nbytes for h in held) >= PACK_BYTES:
            yield _pack(held)
            held = []
    if held:
        yield _pack(held)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packs of a group as one, as columns."""
    for b in _packed(batches):
        groups = b.column("id").to_numpy() | ((1 << GROUP_BITS) - 1)
        firsts = _changes(groups)
        texts = pc.cast(b.column("content").values, pa.binary())
        lengths = pc.fill_null(pc.binary_length(texts), -1).to_numpy().astype(np.int64)
        numbers = np.frombuffer(_bytes(b.column("numbers")), np.int64).reshape(-1, 5)
        rows = Columns(np.vstack([numbers.T, lengths]), np.frombuffer(_bytes(texts), np.uint8))
        bounds = b.column("content").offsets.to_numpy()[firsts]
        columns = zip(*[group.stored() for group in rows.cut(bounds)])
        latest = np.maximum.reduceat(b.column("at").cast(pa.int64()).to_numpy(), firsts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(groups[firsts]), pa.array(latest).cast(b.schema.field("at").type),
             *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))]], names=_GROUP.names
        )


def _bytes(column: pa.Array) -> pa.Buffer:
    """All values of a binary column, one behind the other."""
    _, offsets, data = column.buffers()
    first, last = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]].tolist()
    return data.slice(first, last - first) if last > first else pa.py_buffer(b"")


def _ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per wait of what ended, of so many groups at a time that their rows are a small batch."""
    results = pa.array(HOW)
    step = (1 << 16) >> GROUP_BITS
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            rows = Columns.joined([Columns.of(group, 5) for group in batch.slice(i, step).to_pylist()])
            ids, how, waited, end, lengths = rows.numbers
            offsets = np.append(0, np.cumsum(np.maximum(lengths, 0))).astype(np.int32)
            known = pa.py_buffer(np.packbits(lengths >= 0, bitorder="little"))
            content = pa.Array.from_buffers(
                pa.string(), len(ids), [known, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows.content))]
            )
            times = (pa.array(t).cast(pa.timestamp("us", "UTC")) for t in (waited, end))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int32)), results.take(pa.array(how)), *times, content], names=_RESULT.names
            )


def _open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, waited_at, deadline) of the waits in blocks of the state."""
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.concatenate([Columns.of(block).numbers for block in b.to_pylist()], axis=1)
        ids, _, at, seconds, _, _ = rows[:, rows[1] == WAIT]
        times = (pa.array(t).cast(pa.timestamp("us", "UTC")) for t in (at, at + np.maximum(seconds, 0) * 1_000_000))
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *times], names=["id", "waited_at", "deadline"])


def _filled(batches: Iterable[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    """The columns that all kinds of row have: numbers a kind has not are 0, a content is null."""
    for b in batches:
        n = b.num_rows
        have = {"kind": pa.array(np.full(n, kind, np.int32)), "seconds": pa.array(np.zeros(n, np.int32)),
                "log_offset": pa.array(np.zeros(n, np.int64)), "content": pa.nulls(n, pa.string())}
        have |= dict(zip(b.schema.names, b.columns))
        yield pa.RecordBatch.from_arrays([have[c] for c in _INPUT.names], names=_INPUT.names)


def _side(df: DataFrame, kind: int, at: str, *columns: str) -> DataFrame:
    """Packs of one kind of row. Only the columns it has go to Python."""
    typed = {c: F.col(c).cast(_INPUT[c].dataType) for c in columns}
    rows = df.where(F.col("id").isNotNull() & F.col(at).isNotNull()).select(
        F.col("id").cast("int").alias("id"), F.col(at).cast("timestamp").alias("at"),
        *[(value if c == "content" else F.coalesce(value, F.lit(0))).alias(c) for c, value in typed.items()],
    )
    return rows.mapInArrow(lambda batches: _grouped(_filled(batches, kind)), _GROUP)


def waits_stream(
    waits: DataFrame, events: DataFrame, cancellations: DataFrame | None = None, delay: str = DELAY,
    keep: int = KEEP_SECONDS, default_seconds: int = WAIT_SECONDS,
) -> DataFrame:
    """(id, result, waited_at, ended_at, content) of every wait: met, expired or cancelled.

    `waits` has id, waited_at and wait_seconds (null: `default_seconds`), `events` id,
    delivered_at, log_offset and content, `cancellations` id and cancelled_at. The first event
    of an id meets its wait if it comes no later than the bound, also one that came up to
    `keep` seconds before the wait. Rows without an id or a time take no part. `delay` is how
    far out of order rows may come in.
    """
    ship(waits.sparkSession)
    sides = [
        _side(waits.withColumn("seconds", F.coalesce("wait_seconds", F.lit(default_seconds))), WAIT, "waited_at", "seconds"),
        _side(events, EVENT, "delivered_at", "log_offset", "content"),
    ]
    if cancellations is not None:
        sides.append(_side(cancellations, CANCEL, "cancelled_at"))
    # packed before the watermark, as Python functions drop its mark
    sides = [side.withWatermark("at", delay) for side in sides]
    together = sides[0]
    for side in sides[1:]:
        together = together.unionByName(side)
    ended = together.groupBy("id").transformWithState(Waits(keep), _ENDED, "Append", "EventTime")
    return ended.mapInArrow(_ended, _RESULT)


def waiting(spark, checkpoint: str, operator: int = 0) -> DataFrame:
    """(id, waited_at, deadline) of the waits that had not ended when the stream stopped.

    Read from the state in its checkpoint; the stream need not run.
    """
    ship(spark)
    state = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", ENTRY).load(checkpoint)
    return state.select("list_element.*").mapInArrow(_open, "id int, waited_at timestamp, deadline timestamp")
