"""Token ids in files coded with static range asymmetric numeral systems.

Documents are put in id order by a range shuffle and cut into segments of whole documents,
of about `SEGMENT_IDS` ids. A segment has one frequency table, shared by its blocks. A block
is coded on its own: `LANES` coder states take turns over its ids. Block starts are the
checkpoints: the file keeps the coder states, the place of the words and a checksum for each,
so that blocks can be decoded in any order and by any number of readers.

The container is Parquet, one row per segment, so that any store Spark can write to will do:

    part, segment       order of the segments: by part, then by segment
    doc_ids, sizes      documents of the segment and their numbers of ids
    symbols, weights    ids that occur (uint16/uint32 bytes) and their shares of 2^SCALE_BITS
    block_ids           ids per block
    words, word_counts  renormalisation words of all blocks (uint32), and how many each has
    states              final coder states of all blocks (uint64)
    checksums           crc32 of each block's ids as little-endian uint32
"""

from __future__ import annotations

import zlib
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .staging import prepared
from .text import slices
from .tokens import BYTE_BPE, encoder, tokenizer_path

SCALE_BITS = 20
SEGMENT_IDS, BLOCK_IDS, LANES = 1 << 20, 1 << 17, 1024
_U, _LOW = np.uint64, np.uint64(1 << 31)
_WORD, _WORD_MASK = np.uint64(32), np.uint64(0xFFFFFFFF)


def weights(counts: np.ndarray) -> np.ndarray:
    """Shares of 2^SCALE_BITS in proportion to the counts, each at least 1."""
    total = 1 << SCALE_BITS
    if len(counts) > total:
        raise ValueError("more symbols than the scale can tell apart")
    share = np.maximum(1, (counts * (total / counts.sum())).astype(np.int64))
    excess = int(share.sum()) - total
    while excess:
        # the largest shares feel a change least
        order = np.argsort(-share, kind="stable")
        if excess > 0:
            take = np.minimum(share[order] - 1, max(1, excess // len(order) + 1))
            take = np.minimum(take, np.maximum(0, excess - np.concatenate([[0], np.cumsum(take)[:-1]])))
            share[order] -= take
        else:
            share[order[0]] -= excess
        excess = int(share.sum()) - total
    return share


def encode_block(symbols: np.ndarray, share: np.ndarray, below: np.ndarray, lanes: int = LANES):
    """Coder states and words of one block; `symbols` are row numbers of the table."""
    n = len(symbols)
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    bits = _U(SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        s = symbols[step * lanes : (step + 1) * lanes]
        f, c, x = share[s], below[s], state[: len(s)]
        full = x >= ((_LOW >> bits) << _WORD) * f
        out = x[full]
        words.append((out & _WORD_MASK).astype(np.uint32))
        x = x.copy()
        x[full] = out >> _WORD
        q = x // f
        state[: len(s)] = (q << bits) + (x - q * f) + c
    words.reverse()
    return state, np.concatenate(words) if words else np.zeros(0, np.uint32)


def decode_block(
    n: int, state: np.ndarray, words: np.ndarray, symbol_at: np.ndarray, share: np.ndarray, below: np.ndarray
) -> np.ndarray:
    lanes, place = len(state), 0
    state = state.copy()
    out = np.empty(n, np.int64)
    bits, mask = _U(SCALE_BITS), _U((1 << SCALE_BITS) - 1)
    for begin in range(0, n, lanes):
        size = min(lanes, n - begin)
        x = state[:size]
        slot = x & mask
        s = symbol_at[slot]
        out[begin : begin + size] = s
        x = share[s] * (x >> bits) + slot - below[s]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _WORD) | words[place : place + len(low)].astype(np.uint64)
        place += len(low)
        state[:size] = x
    if place != len(words):
        raise ValueError("words are left over: the block is damaged")
    return out


def encode_segment(ids: np.ndarray, block: int = BLOCK_IDS, lanes: int = LANES) -> dict:
    symbols, rows, counts = np.unique(ids, return_inverse=True, return_counts=True)
    share = weights(counts) if len(counts) else np.zeros(0, np.int64)
    wide, below = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
    states, words, sizes, sums, lengths = [], [], [], [], []
    for begin in range(0, len(ids), block):
        part = ids[begin : begin + block]
        state, out = encode_block(rows[begin : begin + block], wide, below, lanes)
        states.append(state)
        words.append(out)
        sizes.append(len(part))
        lengths.append(len(out))
        sums.append(zlib.crc32(part.astype("<u4").tobytes()))
    joined = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes() if parts else b""
    return {
        "symbols": symbols.astype("<u4").tobytes(), "weights": share.astype("<u4").tobytes(),
        "block_ids": sizes, "words": joined(words, "<u4"), "word_counts": lengths,
        "states": joined(states, "<u8"), "checksums": sums,
    }


def decode_segment(row: dict) -> np.ndarray:
    """All ids of a segment, each block checked against its checksum."""
    symbols, share = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["weights"], "<u4").astype(np.int64)
    symbol_at = np.repeat(np.arange(len(share), dtype=np.int32), share)
    wide, below = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
    blocks = len(row["block_ids"])
    words = np.split(np.frombuffer(row["words"], "<u4"), np.cumsum(row["word_counts"])[:-1]) if blocks else []
    states = np.frombuffer(row["states"], "<u8").reshape(blocks, -1) if blocks else ()
    out = []
    for i, n in enumerate(row["block_ids"]):
        ids = symbols[decode_block(n, states[i], words[i], symbol_at, wide, below)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != row["checksums"][i]:
            raise ValueError(f"checksum of block {i} of segment {row['part']}/{row['segment']} does not match")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


FILE = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()),
     T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())),
     T.StructField("symbols", T.BinaryType()), T.StructField("weights", T.BinaryType()),
     T.StructField("block_ids", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()),
     T.StructField("word_counts", T.ArrayType(T.LongType())), T.StructField("states", T.BinaryType()),
     T.StructField("checksums", T.ArrayType(T.LongType()))]
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("symbols", pa.binary()), ("weights", pa.binary()), ("block_ids", pa.list_(pa.int64())), ("words", pa.binary()),
    ("word_counts", pa.list_(pa.int64())), ("states", pa.binary()), ("checksums", pa.list_(pa.int64())),
])


def _encoded(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, number = encoder(path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        sizes: list[int] = []

        def segment() -> pa.RecordBatch:
            row = {"part": part, "segment": number, "doc_ids": list(docs), "sizes": list(sizes)}
            row |= encode_segment(np.concatenate(ids))
            ids.clear(), docs.clear(), sizes.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            names = b.column("doc_id").to_pylist()
            for s in slices(b.column("text")):
                flat, counts = model.ids(s, model.units(s))
                ends = np.cumsum(counts)
                # the end id goes behind each document's own
                ids.append(np.insert(flat, ends, end_id))
                docs += names[s.row : s.row + s.n]
                sizes += (counts + 1).tolist()
                if sum(map(len, ids)) >= SEGMENT_IDS:
                    yield segment()
                    number += 1
        if docs:
            yield segment()

    return run


def write_token_file(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, end_id: int = 2,
) -> None:
    """Encode all texts, each with `end_id` behind it, in ascending order of the ids.

    Null texts count as empty: the end id alone. Rows without id come first; rows with one id
    follow each other in an order given by their texts. Other columns are not stored.
    """
    spark = prepared(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(_encoded(vocabulary or tokenizer_path(BYTE_BPE), end_id), FILE).write.parquet(path)


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            ids = decode_segment(row).astype("<u4")
            ends = np.cumsum(row["sizes"], dtype=np.int64)
            begins = ends - row["sizes"]
            offsets = np.concatenate([begins[:1], ends]).astype(np.int64) * 4
            blobs = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(ends), pa.int32()), pa.array([row["segment"]] * len(ends), pa.int32()),
                 pa.array(row["doc_ids"], pa.int64()), pa.array(begins, pa.int64()),
                 pa.array(row["sizes"], pa.int64()), blobs],
                names=["part", "segment", "doc_id", "within", "n_tokens", "ids"],
            )


def decode_token_file(spark, path: str) -> DataFrame:
    """part, segment, doc_id, within (ids of the segment before), n_tokens, ids (little-endian uint32 bytes)."""
    prepared(spark)
    return spark.read.schema(FILE).parquet(path).mapInArrow(
        _decoded, "part int, segment int, doc_id long, within long, n_tokens long, ids binary"
    )


def with_starts(decoded: DataFrame, path: str) -> DataFrame:
    """Replace part, segment and within by start: the ids of all documents before in the file."""
    file = decoded.sparkSession.read.schema(FILE).parquet(path)
    totals = file.select("part", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part")
    )  # one row per part
    before = totals.join(before_part, "part").select(
        "part", "segment",
        (F.col("before_part") + F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")).alias("before"),
    )
    rest = [c for c in decoded.columns if c not in ("part", "segment", "doc_id", "within")]
    return decoded.join(before, ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), *rest
    )


def read_token_file(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian uint32 bytes)."""
    return with_starts(decode_token_file(spark, path), path)
