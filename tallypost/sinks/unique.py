"""Unique keys on append: a bitmap index of the stored ids, checked before a batch is visible.

The index holds a bitmap per 32,768 ids. A batch reads and writes only those its ids fall in,
never the stored table. As a database would, a batch may be refused as a whole, or its
conflicting rows may be set aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .batches import BatchStore

INDEX, ROWS, CONFLICTS = "index", "rows", "conflicts"
WHOLE_EVERY = 32  # batches between two that write the whole index

_INDEX = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])
CONFLICT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("refused", T.LongType()), T.StructField("stored", T.BooleanType()),
])


class NotUnique(ValueError):
    """Ids of a batch that are stored already or come more than once."""


def has_bit(bits: Column, id_: Column) -> Column:
    """Whether a bitmap holds an id of its bucket."""
    at = F.bitmap_bit_position(id_)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1


class UniqueTable:
    """A table of batches whose ids do not repeat."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, order: str):
        """`order` names the column whose lowest value wins among rows of one id in a batch."""
        self.spark, self.schema, self.order = spark, schema, order
        self.store = BatchStore(spark, root)

    def index(self, batch: int) -> DataFrame:
        """The bitmaps after a batch: the last whole index and what changed since."""
        if batch < 0:
            return self.spark.createDataFrame([], _INDEX)
        whole = self.store.facts(batch)["whole"]
        rows = self.store.table(INDEX, _INDEX).where(F.col("batch_id").between(whole, batch))
        # a changed bitmap holds what it held before
        return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def append(self, rows: DataFrame, batch: int, refuse: bool = False) -> DataFrame:
        """Store a batch; (id, refused, stored) of its conflicts, which are not stored.

        `refused` says how many rows of the id were left out, `stored` whether an earlier batch
        holds it. With `refuse`, a conflict raises and nothing of the batch becomes visible. A null
        id is no key and is refused too. A batch that was stored before is left as it is.
        """
        if self.store.facts(batch) is None:
            before = self.store.facts_before(batch)
            known = self.index(batch - 1)
            rest = [c for c in self.schema.fieldNames() if c not in ("id", self.order)]
            # combined before the shuffle: an id that repeats without end is a row per task
            firsts = rows.groupBy("id").agg(F.count("*").alias("_n"), F.min(F.struct(self.order, *rest)).alias("_first"))
            bucket = F.bitmap_bucket_number(F.col("id").cast("long"))
            seen = firsts.withColumn("_bucket", bucket).join(known, F.col("_bucket") == F.col("bucket"), "left")
            stored = F.coalesce(has_bit(F.col("bits"), F.col("id").cast("long")), F.lit(False))
            judged = seen.select("id", "_n", "_first", stored.alias("_stored"))
            fresh = F.col("id").isNotNull() & ~F.col("_stored")
            left_out = F.col("_n") - fresh.cast("long")
            self.store.put(
                judged.where(left_out > 0).select(F.col("id").cast("long").alias("id"), left_out.alias("refused"), F.col("_stored").alias("stored")),
                CONFLICTS, batch,
            )
            if refuse:
                found = self.store.batch(CONFLICTS, batch, CONFLICT).agg(F.count("*"), F.sum("refused")).first()
                if found[0]:
                    raise NotUnique(f"batch {batch}: {found[1]} rows of {found[0]} ids conflict")
            self.store.put(judged.where(fresh).select("id", "_first.*").select(self.schema.fieldNames()), ROWS, batch)
            self._reindex(batch, before, known)
        return self.store.batch(CONFLICTS, batch, CONFLICT)

    def _reindex(self, batch: int, before: dict | None, known: DataFrame) -> None:
        id_ = F.col("id").cast("long")
        added = self.store.batch(ROWS, batch, self.schema).groupBy(F.bitmap_bucket_number(id_).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(id_)).alias("bits")
        )
        whole = batch if before is None or batch - before["whole"] >= WHOLE_EVERY else before["whole"]
        if whole == batch:
            added = added.unionByName(known).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        self.store.put(added, INDEX, batch)
        self.store.commit(batch, whole=whole)

    def rows(self) -> DataFrame:
        return self.store.table(ROWS, self.schema).drop("batch_id")

    def conflicts(self) -> DataFrame:
        """Conflicts of all stored batches, with `batch_id`."""
        return self.store.table(CONFLICTS, CONFLICT)
