"""Tables that a stream writes batch by batch, several of them as one unit.

Each table keeps a folder per batch. A commit marker, a small file, is written last;
readers see only batches up to the last marker. A batch that is repeated before its marker
overwrites its own folders; after it, its rows are visible and stay as they are.
Batches of one stream are numbered in order and never run at the same time, so the
last marker vouches for all before it.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import files

_COMMITS = "commits"


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


class BatchStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def put(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(table, batch_id))

    def clear(self, batch_id: int, *tables: str) -> None:
        """Remove what a try at a batch left that did not reach its marker."""
        for table in tables:
            files.delete(self.spark, self._folder(table, batch_id))

    def _marker(self, batch_id: int) -> str:
        return f"{self.root}/{_COMMITS}/{batch_id:012d}.json"

    def commit(self, batch_id: int, **facts: Any) -> None:
        files.publish(self.spark, self._marker(batch_id), json.dumps({"batch": batch_id, **facts}))

    def facts(self, batch_id: int) -> dict[str, Any] | None:
        """What the marker of a batch says, or None without one."""
        text = files.read(self.spark, self._marker(batch_id))
        return json.loads(text) if text else None

    def facts_before(self, batch_id: int) -> dict[str, Any] | None:
        """The marker of the batch before; None only for the first batch."""
        marker = self.facts(batch_id - 1) if batch_id > 0 else None
        if batch_id > 0 and marker is None:
            raise RuntimeError(f"{self.root} holds no batch {batch_id - 1}: store and checkpoint do not belong together")
        return marker

    def last_batch(self) -> int:
        """Number of the last committed batch, -1 when there is none."""
        markers = [n for n in files.names(self.spark, f"{self.root}/{_COMMITS}") if n.endswith(".json") and n[0] != "."]
        return int(markers[-1].removesuffix(".json")) if markers else -1

    def batch(self, table: str, batch_id: int, schema: T.StructType) -> DataFrame:
        """Rows of one batch; none when the folder does not exist."""
        try:
            return self.spark.read.schema(schema).parquet(self._folder(table, batch_id))
        except AnalysisException as e:
            if not _missing(e):
                raise
            return self.spark.createDataFrame([], schema)

    def table(self, table: str, schema: T.StructType) -> DataFrame:
        """Rows of all committed batches; the batch filter prunes folders."""
        with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        try:
            rows = self.spark.read.schema(with_batch).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if not _missing(e):
                raise
            return self.spark.createDataFrame([], with_batch)
        return rows.where(F.col("batch_id") <= self.last_batch())
