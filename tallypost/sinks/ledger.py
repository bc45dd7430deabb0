"""Ids for several writers: blocks of ids, each taken by one writer, noted per (stream, batch).

A block is taken by creating its file, which only one writer can do; then the batch is noted
with its blocks. A batch that is repeated finds its note and gets the same ids. A writer that
dies in between leaves blocks nobody uses: ids are unique, gaps are allowed. What a batch
leaves of its last block the next batch of the stream goes on with.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ingest import as_int, numbered
from . import files

BLOCK = 4096


class Reserved(NamedTuple):
    """Row number p of a batch has the id at place `skip + p` of its blocks."""

    blocks: list[int]
    skip: int
    count: int
    size: int

    def id_of(self, number: Column) -> Column:
        """The id of a row number that counts from 0."""
        place = number + F.lit(self.skip).cast("long")
        block = F.element_at(F.array(*[F.lit(b).cast("long") for b in self.blocks or [0]]), (F.floor(place / self.size) + 1).cast("int"))
        return as_int(block * self.size + place % self.size + 1)

    @property
    def left(self) -> int:
        return len(self.blocks) * self.size - self.skip - self.count


class IdLedger:
    def __init__(self, spark: SparkSession, root: str, size: int = BLOCK):
        self.spark, self.root, self.size = spark, root.rstrip("/"), size
        self._next = 0

    def _note(self, stream: str, batch: int) -> str:
        return f"{self.root}/batches/{stream}/{batch}.json"

    def _block(self, number: int) -> str:
        return f"{self.root}/blocks/{number:010d}"

    def noted(self, stream: str, batch: int) -> Reserved | None:
        text = files.read(self.spark, self._note(stream, batch)) if batch >= 0 else None
        return Reserved(**json.loads(text)) if text else None

    def _take(self) -> int:
        if not self._next:
            taken = files.names(self.spark, f"{self.root}/blocks")
            self._next = int(taken[-1]) + 1 if taken else 0
        while not files.claim(self.spark, self._block(self._next)):
            self._next += 1
        self._next += 1
        return self._next - 1

    def reserve(self, stream: str, batch: int, count: int) -> Reserved:
        """Ids for the rows of a batch; batches of one stream follow each other."""
        known = self.noted(stream, batch)
        if known:
            if known.count != count:
                raise RuntimeError(f"batch {batch} of {stream} came back with {count} rows instead of {known.count}")
            return known
        before = self.noted(stream, batch - 1)
        blocks, skip = [], 0
        if before and before.left and before.size == self.size:
            blocks, skip = [before.blocks[-1]], self.size - before.left
        while len(blocks) * self.size - skip < count:
            blocks.append(self._take())
        reserved = Reserved(blocks, skip, count, self.size)
        files.publish(self.spark, self._note(stream, batch), json.dumps(reserved._asdict()))
        return reserved

    def assign(self, messages: DataFrame, stream: str, batch: int) -> DataFrame:
        """Give every row of a batch an id that no other row has, in whatever stream.

        A repeated batch gets the ids it had, row by row: its numbered rows are kept.
        """
        rows = numbered(messages, f"{self.root}/numbered/{stream}/{batch}")
        reserved = self.reserve(stream, batch, rows.count())
        return rows.select(reserved.id_of(F.col("_number")).alias("id"), *messages.columns)
