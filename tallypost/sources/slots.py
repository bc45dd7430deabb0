"""Change log with slots: a streaming source that knows its position and acknowledges it.

The log is a folder of sorted files, each with a range of log positions, and an index of them.
A slot is a name under which a reader's acknowledged position is kept: a new stream begins
there, and the position moves once a batch has been handled, so it is never ahead of what the
sink holds. Ranges of positions are the partitions of a batch.

The files are read with Arrow's file systems (local, HDFS, S3 and the like).
"""

from __future__ import annotations

import json
from typing import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import CHANGE
from ..session import ship
from ..sinks import files

FORMAT = "change_slot"


def append_changes(changes: DataFrame, path: str) -> int:
    """Append changes to a log, which must all lie behind its end; returns the new end."""
    spark = changes.sparkSession
    index = files.names(spark, f"{path}/index")
    number = len(index)
    folder = f"{path}/data/{number:08d}"
    changes.select(CHANGE.fieldNames()).repartitionByRange("wal_end").sortWithinPartitions("wal_end").write.mode("overwrite").parquet(folder)
    # a row per file
    found = spark.read.schema(CHANGE).parquet(folder).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("wal_end").alias("low"), F.max("wal_end").alias("high"), F.count("*").alias("rows")
    ).orderBy("low").collect()
    end = _end(spark, path)
    if found and found[0]["low"] <= end:
        raise ValueError(f"position {found[0]['low']} is not behind the end of the log, {end}")
    entries = [{"file": f"data/{number:08d}/{r['file']}", "low": r["low"], "high": r["high"], "rows": r["rows"]} for r in found]
    files.publish(spark, f"{path}/index/{number:08d}.json", json.dumps(entries))
    return entries[-1]["high"] if entries else end


def _end(spark: SparkSession, path: str) -> int:
    ends = [0]
    for name in files.names(spark, f"{path}/index"):
        ends += [e["high"] for e in json.loads(files.read(spark, f"{path}/index/{name}"))]
    return max(ends)


def acknowledged(spark: SparkSession, path: str, slot: str) -> int:
    """The position up to which a slot's changes have been handled."""
    known = files.names(spark, f"{path}/slots/{slot}")
    return int(known[-1]) if known else 0


class _Range(InputPartition):
    """Changes of one file behind `low`, up to `high`."""

    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class _SlotReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self._path, self._slot = options["path"].rstrip("/"), options["slot"]
        self._schema = to_arrow_schema(schema)
        self._index: dict[str, list[dict]] = {}

    def _files(self):
        fs, root = pyarrow.fs.FileSystem.from_uri(self._path)
        return fs, root

    def _entries(self) -> list[dict]:
        """Files in order; index files are read once, as they do not change."""
        fs, root = self._files()
        for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/index", allow_not_found=True)):
            if info.base_name.endswith(".json") and not info.base_name.startswith(".") and info.base_name not in self._index:
                with fs.open_input_stream(info.path) as f:
                    self._index[info.base_name] = json.loads(f.read())
        return [e for name in sorted(self._index) for e in self._index[name]]

    def initialOffset(self) -> dict:
        fs, root = self._files()
        known = [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/slots/{self._slot}", allow_not_found=True))]
        return {"wal": max([int(n) for n in known if not n.startswith(".")], default=0)}

    def latestOffset(self) -> dict:
        """The end of the log; a slot that is ahead of an empty log stays where it is."""
        return {"wal": max([e["high"] for e in self._entries()], default=self.initialOffset()["wal"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [
            _Range(e["file"], max(start["wal"], e["low"] - 1), min(end["wal"], e["high"]))
            for e in self._entries() if e["high"] > start["wal"] and e["low"] <= end["wal"]
        ]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, root = self._files()
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            for b in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(columns=self._schema.names):
                at = b.column("wal_end")
                b = b.filter(pc.and_(pc.greater(at, partition.low), pc.less_equal(at, partition.high)))
                if b.num_rows:
                    columns = [b.column(c.name).cast(c.type) for c in self._schema]
                    yield pa.RecordBatch.from_arrays(columns, names=self._schema.names)

    def commit(self, end: dict) -> None:
        """Called once the batch up to `end` has been handled."""
        fs, root = self._files()
        fs.create_dir(f"{root}/slots/{self._slot}", recursive=True)
        with fs.open_output_stream(f"{root}/slots/{self._slot}/{end['wal']:020d}") as f:
            f.write(b"")


class ChangeSlot(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return CHANGE

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _SlotReader(dict(self.options), schema)


def slot_stream(spark: SparkSession, path: str, slot: str) -> DataFrame:
    """The changes of a log behind the acknowledged position of a slot, as a stream.

    A batch takes all there is, a partition per file. A stream that goes on from a
    checkpoint goes on where its last batch ended, which may be ahead of the slot: a batch is
    acknowledged when the next one begins.
    """
    ship(spark).dataSource.register(ChangeSlot)
    return spark.readStream.format(FORMAT).option("path", path).option("slot", slot).load()
