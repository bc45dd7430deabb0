"""Log of dispatch tries in batches, and outbox state from a snapshot and the batches after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.outbox import finished_state, merged_state, partial_state
from ..schemas import ATTEMPT, OUTBOX_MAX_ATTEMPTS
from ..sinks.batches import BatchStore

TRIES, STATES = "tries", "states"


class AttemptLog:
    """Tries arrive in batches; a snapshot holds the merged state of all batches up to one.

    A batch that is appended again is the batch that is there: its tries count once.
    """

    def __init__(self, store: BatchStore, schema: T.StructType = ATTEMPT):
        self.store, self.schema = store, schema

    def append(self, tries: DataFrame, batch: int) -> None:
        if self.store.facts(batch) is None:
            before = self.store.facts_before(batch)
            self.store.put(tries.select(self.schema.fieldNames()), TRIES, batch)
            self.store.commit(batch, snapshot=before["snapshot"] if before else -1)

    def _snapshot(self) -> int:
        last = self.store.last_batch()
        return self.store.facts(last)["snapshot"] if last >= 0 else -1

    def merged(self) -> DataFrame:
        """State per row: the last snapshot and the tries of later batches, which are all it reads."""
        upto = self._snapshot()
        later = self.store.table(TRIES, self.schema).where(F.col("batch_id") > upto)
        partial = partial_state(later)
        if upto < 0:
            return partial
        return merged_state(self.store.batch(STATES, upto, partial.schema).unionByName(partial))

    def snapshot(self) -> None:
        """Fold all batches so far; the marker of the last one then names the snapshot."""
        last = self.store.last_batch()
        if last >= 0 and self._snapshot() < last:
            self.store.put(self.merged(), STATES, last)
            self.store.commit(last, snapshot=last)

    def state(self, rows: DataFrame, max_attempts: int = OUTBOX_MAX_ATTEMPTS) -> DataFrame:
        return finished_state(rows, self.merged(), max_attempts=max_attempts)
