"""Waits with their own bounds: every order of arrival gives the result of the times."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallypost.session import prepare
from tallypost.streaming import waits as W
from tallypost.streaming.run import append_sink, read_sink, run_available

START = datetime(2024, 1, 1)


def s(seconds):
    return START + timedelta(seconds=seconds)


# id: wait (at, bound), cancellations, events (at, offset, content) -> result, end, content
CASES = {
    1: (((0, 30), [], [(10, 1, "a")]), ("met", 10, "a")),
    2: (((0, 30), [], []), ("expired", 30, None)),
    3: (((0, 30), [12], []), ("cancelled", 12, None)),
    4: (((0, 30), [12], [(10, 1, "a")]), ("met", 10, "a")),
    5: (((0, 30), [10], [(12, 1, "a")]), ("cancelled", 10, None)),
    6: (((20, 15), [], [(5, 1, "early")]), ("met", 20, "early")),
    7: (((0, 15), [], [(16, 1, "late")]), ("expired", 15, None)),
    8: (((0, 15), [], [(15, 1, "just")]), ("met", 15, "just")),
    9: (((0, 15), [15], [(15, 1, "both")]), ("met", 15, "both")),
    10: (((20, 30), [3], []), ("cancelled", 20, None)),
    11: (((0, 60), [], [(40, 2, "second"), (40, 1, "first"), (59, 3, "again"), (100, 4, "redelivered")]), ("met", 40, "first")),
    12: (((0, 0), [], [(0, 1, "at once")]), ("met", 0, "at once")),
    13: (((0, None), [], [(60, 1, "default")]), ("met", 60, "default")),
    14: (((0, 30), [31], [(32, 1, "x")]), ("expired", 30, None)),
    15: ((None, [], [(5, 1, "nobody waits")]), None),
    16: ((None, [5], []), None),
}


def rows():
    waits, cancels, events = [], [], []
    for id_, ((wait, cancelled, arrived), _) in CASES.items():
        if wait:
            waits.append((id_, s(wait[0]), wait[1]))
        cancels += [(id_, s(c)) for c in cancelled]
        events += [(id_, s(a), o, c) for a, o, c in arrived]
    waits += [(None, s(1), 5), (50, None, 5)]
    events += [(None, s(1), 1, "x"), (51, None, 1, "x")]
    return waits, cancels, events


def expected():
    return {i: e for i, (_, e) in CASES.items() if e}


class Feed:
    def __init__(self, spark, root, delay="1 hour", keep=3600):
        prepare(spark)
        self.spark, self.root = spark, root
        self.kinds = {
            "waits": "id int, waited_at timestamp, wait_seconds int", "cancels": "id int, cancelled_at timestamp",
            "events": "id int, delivered_at timestamp, log_offset long, content string",
        }
        for name, schema in self.kinds.items():
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
        streams = [spark.readStream.schema(schema).parquet(f"{root}/{name}") for name, schema in self.kinds.items()]
        self.out = W.waits_stream(streams[0], streams[2], streams[1], delay=delay, keep=keep)

    def send(self, **rows):
        for name, some in rows.items():
            self.spark.createDataFrame(some, self.kinds[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        run_available(append_sink(self.out, f"{self.root}/out", f"{self.root}/cp"))

    def end(self, hours=3):
        """Rows that move all watermarks; their own entries are those of id -1."""
        at = START + timedelta(hours=hours)
        self.send(waits=[(-1, at, 1)], cancels=[(-2, at)], events=[(-3, at, 1, "end")])

    def results(self):
        got = read_sink(self.spark, f"{self.root}/out", self.out).where("id > 0").collect()
        assert len({r["id"] for r in got}) == len(got)
        return {r["id"]: (r["result"], (r["ended_at"] - START).total_seconds(), r["content"]) for r in got}


@pytest.mark.parametrize("order", ["reversed", "mixed"])
def test_results_do_not_depend_on_arrival(spark, tmp_path, order):
    feed = Feed(spark, str(tmp_path))
    flat = [(kind, r) for kind, some in zip(("waits", "cancels", "events"), rows()) for r in some]
    flat.sort(key=lambda x: (str(x[1][1]), str(x)))
    if order == "reversed":
        flat.reverse()
    if order == "mixed":
        random.Random(1).shuffle(flat)
    for part in (flat[: len(flat) // 2], flat[len(flat) // 2 :]):
        feed.send(**{k: [r for kind, r in part if kind == k] for k in feed.kinds if any(kind == k for kind, _ in part)})
    assert feed.results() == {}  # nothing is sure before the watermark
    feed.end(hours=3)
    assert feed.results() == expected()
    left = spark.read.format("statestore").option("stateVarName", W.ENTRY).load(f"{tmp_path}/cp")
    assert left.where("key.id > 0").count() == 0


def test_who_is_waiting(spark, tmp_path):
    """Waits that had not ended when the stream stopped, with their deadlines."""
    feed = Feed(spark, str(tmp_path), delay="10 seconds")
    feed.send(waits=[(1, s(0), 15), (2, s(0), 600), (3, s(0), 900)], events=[(1, s(3), 1, "a"), (4, s(5), 2, "b")])
    feed.send(waits=[(5, s(100), 600)], events=[(9, s(100), 3, "c")], cancels=[(9, s(100))])
    assert feed.results() == {1: ("met", 3, "a")}
    got = {r["id"]: r["deadline"] for r in W.waiting(spark, f"{tmp_path}/cp").collect()}
    assert got == {2: s(600), 3: s(900), 5: s(700)}


def test_repeats_are_folded_before_the_shuffle(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([
        {"id": 1, "kind": W.EVENT, "at": s(9), "seconds": 0, "log_offset": 5, "content": "b"},
        {"id": 1, "kind": W.EVENT, "at": s(3), "seconds": 0, "log_offset": 6, "content": "a"},
        {"id": 1, "kind": W.CANCEL, "at": s(4), "seconds": 0, "log_offset": 0, "content": None},
        {"id": 2, "kind": W.WAIT, "at": s(4), "seconds": 9, "log_offset": 0, "content": None},
        {"id": 2, "kind": W.WAIT, "at": s(4), "seconds": 3, "log_offset": 0, "content": None},
    ])
    out = next(W._folded([batch])).to_pylist()
    assert [(r["id"], r["kind"], r["content"], r["seconds"]) for r in out] == [(1, 2, "a", 0), (1, 1, None, 0), (2, 0, None, 3)]


def test_neighbouring_ids_share_state_but_not_results(spark, tmp_path):
    """State has an entry per block of ids, each wait in it ends by itself, and a late row in a pack takes no part."""
    feed = Feed(spark, str(tmp_path), delay="10 seconds")
    ids = [*range(1, 600), 2**31 - 1]
    feed.send(waits=[(i, s(0), 100 + i % 7) for i in ids], events=[(i, s(3), 1, "a") for i in ids[::50]])
    state = spark.read.format("statestore").option("stateVarName", W.ENTRY).load(f"{tmp_path}/cp")
    assert state.where("key.id > 0").count() == 4  # 1 to 255, 256 to 511, 512 to 599, the last
    assert W.waiting(spark, f"{tmp_path}/cp").count() == len(ids)
    feed.send(waits=[(-1, s(60), 1)], events=[(-2, s(60), 1, "x")], cancels=[(-3, s(60))])
    assert feed.results() == {i: ("met", 3, "a") for i in ids[::50]}
    # ids[0] again, late, beside a wait of the same block that is not
    feed.send(waits=[(ids[0], s(0), 100), (700, s(70), 30)])
    feed.end(hours=3)
    want = {i: ("expired", 100 + i % 7, None) for i in ids} | {i: ("met", 3, "a") for i in ids[::50]}
    assert feed.results() == want | {700: ("expired", 100, None)}


def test_rows_of_a_block_travel_as_one(spark):
    import pyarrow as pa

    def batch(ids):
        return pa.RecordBatch.from_pylist([
            {"id": i, "kind": W.EVENT, "at": s(i), "seconds": 0, "log_offset": i, "content": f"c{i}" if i % 2 else None} for i in ids
        ])

    [out] = W._packed([batch([300, -1, 5]), batch([9]).slice(1), batch([7, 5, -300])])
    rows = {r["id"]: r for r in out.to_pylist()}
    assert {k: (r["at"], r["content"]) for k, r in rows.items()} == {
        -257: (s(-300), [None]), -1: (s(-1), ["c-1"]), 255: (s(7), ["c5", "c7"]), 511: (s(300), [None]),
    }
    assert len(rows[255]["numbers"]) == 2 * 5 * 8


def by_rule(waits, cancels, events):
    """What ends each wait, one after the other."""
    ended = {}
    for id_ in {i for i, _, _ in waits}:
        at, bound = min((a, a + timedelta(seconds=max(0, n))) for i, a, n in waits if i == id_)
        ends = [(bound, 2, "expired", None)] + [(max(c, at), 1, "cancelled", None) for i, c in cancels if i == id_]
        arrived = sorted((a, o, c) for i, a, o, c in events if i == id_)
        ends += [(max(a, at), 0, "met", c) for a, _, c in arrived[:1]]
        end, _, how, content = min(ends, key=lambda e: e[:2])
        ended[id_] = (how, (end - START).total_seconds(), content)
    return ended


def test_columns_of_a_group_give_what_each_wait_gives(spark, tmp_path):
    """Ids of many blocks and groups, repeats, ties, bounds below zero, contents of all kinds, split over three batches."""
    rng = random.Random(7)
    ids = [*range(4000, 4200), *rng.sample(range(5000, 60_000), 150), 2**31 - 1]
    some = lambda share: [i for i in ids for _ in range(rng.choice([1, 1, 3])) if rng.random() < share]
    waits = [(i, s(rng.randrange(40)), rng.choice([-5, 0, 15, 30])) for i in some(0.9)]
    cancels = [(i, s(rng.randrange(60))) for i in some(0.4)]
    events = [(i, s(rng.randrange(60)), n, rng.choice(["", "a", "é→𝄞", "x" * 3000, f"n{n}"])) for n, i in enumerate(some(0.7))]
    events += [(i, s(0), 10**12, None) for i in ids[::20]]
    feed = Feed(spark, str(tmp_path))
    for k in range(3):
        feed.send(waits=waits[k::3], cancels=cancels[k::3], events=events[k::3])
    want = by_rule(waits, cancels, [e for e in events if e[3] is not None] + [(i, a, o, "none") for i, a, o, c in events if c is None])
    assert len({how for how, _, _ in want.values()}) == 3
    waiting = {r["id"]: (r["waited_at"], r["deadline"]) for r in W.waiting(spark, f"{tmp_path}/cp").collect()}
    assert waiting == {i: min((a, a + timedelta(seconds=max(0, n))) for j, a, n in waits if j == i) for i in want}
    feed.end(hours=3)
    assert feed.results() == {i: (how, at, None if content == "none" else content) for i, (how, at, content) in want.items()}


def test_neighbouring_blocks_share_a_key(spark, tmp_path):
    """A task asks for the state of 4,096 ids at once: keys grow with ids / 4096, also where ids leave gaps."""
    feed = Feed(spark, str(tmp_path))
    feed.send(waits=[(i, s(0), 30) for i in range(1, 12_000, 5)])
    state = spark.read.format("statestore").option("stateVarName", W.ENTRY).load(f"{tmp_path}/cp")
    assert state.select("key").distinct().count() == 3
    assert W.waiting(spark, f"{tmp_path}/cp").count() == len(range(1, 12_000, 5))
