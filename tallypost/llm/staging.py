"""Tables between the steps of an operator, kept in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship, workspace

# While a table is written: its shuffle files go once it is complete, and Python gets as many rows
# at a time, which bounds the memory of a worker when texts are long.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
}

# Python gets as many bytes at a time, and one row more. A batch stands in the executor and in its worker, on the way
# there and back, and neither returns all of the memory that the largest one took.
BATCH_BYTES = 4 << 20
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepared(spark: SparkSession) -> SparkSession:
    """Workers know this package, and batches are bound in bytes, unless the session has a bound of its own.

    The bound stays with the session: a result is computed when its caller asks for it.
    """
    if spark.conf.get(_BATCH_BYTES_KEY, None) is None:
        spark.conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))
    return ship(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` and read it back: cuts lineage, fixes its rows, survives lost executors.

    Once the table is complete the shuffle files of the write serve nobody, and go.
    """
    spark = df.sparkSession
    path = workspace(spark, label)
    before = {key: spark.conf.get(key, None) for key in _WHILE_WRITING}
    try:
        for key, value in _WHILE_WRITING.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by `written`, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, *named: str, into: str = "_rest") -> DataFrame:
    """The named columns, and all others as one struct, so that no name can clash."""
    rest = [c for c in docs.columns if c not in named]
    other = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("_none"))
    return docs.select(*[F.col(f"`{c}`") for c in named], other.alias(into))


def unpacked(rows: DataFrame, docs: DataFrame, added: list[str], into: str = "_rest", **made: str) -> DataFrame:
    """The columns of `docs` in order, then the added ones, which win over the same name.

    `made` gives, for a column of `docs`, the column of `rows` that now holds it.
    """
    out = []
    for c in docs.columns:
        if c in added:
            continue
        if c in made:
            out.append(F.col(made[c]).alias(c))
        elif c in rows.columns:
            out.append(F.col(f"`{c}`"))
        else:
            out.append(F.col(f"{into}.`{c}`"))
    return rows.select(*out, *added)
