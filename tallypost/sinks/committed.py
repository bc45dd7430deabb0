"""Topic sink with commit and abort: a batch's records become visible together.

Tasks write their records to files nobody reads yet and report them; the commit of a batch
lists them, and readers read what is listed. A task that fails half way leaves no record, and
a batch that is written again adds nothing once it is listed.

The files are written with Arrow's file systems (local, HDFS, S3 and the like).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..schemas import MESSAGE_TOPIC, TOPIC_RECORD
from ..session import ship
from . import files
from .topics import addressed, file_records

FORMAT = "committed_topic"


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self._path = options["path"].rstrip("/")

    def _files(self):
        return pyarrow.fs.FileSystem.from_uri(self._path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = self._files()
        name, rows, sink = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                if sink is None:
                    fs.create_dir(f"{root}/data", recursive=True)
                    sink = pq.ParquetWriter(f"{root}/data/{name}", b.schema, filesystem=fs, coerce_timestamps="us")
                sink.write_batch(b)
                rows += b.num_rows
        except BaseException:
            if sink is not None:
                sink.close()
                fs.delete_file(f"{root}/data/{name}")
            raise
        if sink is not None:
            sink.close()
        return _Written(name if sink is not None else None, rows)

    def _remove(self, messages) -> None:
        fs, root = self._files()
        for m in messages:
            if m is not None and m.file is not None:
                fs.delete_file(f"{root}/data/{m.file}")

    def commit(self, messages, batchId: int) -> None:
        fs, root = self._files()
        listed = f"{root}/commits/{batchId:012d}.json"
        if fs.get_file_info(listed).type != pyarrow.fs.FileType.NotFound:
            self._remove(messages)  # written before, and listed then
            return
        fs.create_dir(f"{root}/commits", recursive=True)
        part = f"{root}/commits/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(json.dumps([m.file for m in messages if m is not None and m.file is not None]).encode())
        fs.move(part, listed)

    def abort(self, messages, batchId: int) -> None:
        self._remove(messages)


class CommittedTopic(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return TOPIC_RECORD

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Writer(dict(self.options))


def committed_topic(records: DataFrame, path: str, checkpoint: str, topic: str = MESSAGE_TOPIC) -> DataStreamWriter:
    """Write a stream of records to a topic, each batch all or none of it."""
    ship(records.sparkSession).dataSource.register(CommittedTopic)
    out = file_records(addressed(records, topic))
    return out.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint)


def committed_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all batches that were committed."""
    listed = [n for n in files.names(spark, f"{path}/commits") if n.endswith(".json") and n[0] != "."]
    found = [f"{path}/data/{f}" for n in listed for f in json.loads(files.read(spark, f"{path}/commits/{n}"))]
    return spark.read.schema(TOPIC_RECORD).parquet(*found) if found else spark.createDataFrame([], TOPIC_RECORD)
