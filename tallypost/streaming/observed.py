"""Totals gathered in passing: measures observed on a stream, kept per batch from its progress.

Each batch reports its measures once it is done; they are kept in a small file per batch, so a
batch that reports again after a restart counts once, and totals need no second pass over data.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import metrics as M
from ..sinks import files

_SUM, _MIN, _MAX = "sum", "min", "max"


def route_measures(routes: tuple[str, ...]) -> dict[str, Column]:
    """What a report needs of request samples, per route, by measure and how it adds up."""
    out = {}
    for i, route in enumerate(routes):
        here = F.col("endpoint") == route
        start, end = F.unix_micros(F.col("started_at").cast("timestamp")), M.ended_at_micros()
        out |= {
            f"{i}:requests:{_SUM}": F.count_if(here),
            f"{i}:check_passes:{_SUM}": F.count_if(here & (F.col("status_code") == M.CREATED)),
            f"{i}:failed_requests:{_SUM}": F.count_if(here & M.failed()),
            f"{i}:iterations:{_SUM}": F.count_if(here & ~F.col("warmup")),
            f"{i}:vus_min:{_MIN}": F.min(F.when(here, F.col("vus"))),
            f"{i}:vus_max:{_MAX}": F.max(F.when(here, F.col("vus"))),
            f"{i}:first_start:{_MIN}": F.min(F.when(here, start)),
            f"{i}:last_end:{_MAX}": F.max(F.when(here, end)),
        }
    return out


def observed(df: DataFrame, name: str, measures: dict[str, Column]) -> DataFrame:
    return df.observe(name, *[c.alias(n) for n, c in measures.items()])


class ProgressTotals(StreamingQueryListener):
    """Keeps what the batches of streams report under a name."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self._spark, self._root, self._name = spark, root.rstrip("/"), name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self._name)
        if seen is not None:
            self.keep(str(progress.id), progress.batchId, seen.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def keep(self, query: str, batch: int, measures: dict) -> None:
        """A batch that reports nothing new, as an idle one does, must not replace what it reported."""
        path = f"{self._root}/{query}/{batch:012d}.json"
        if any(v for k, v in measures.items() if k.endswith(_SUM)) or not files.exists(self._spark, path):
            files.publish(self._spark, path, json.dumps(measures))

    def batches(self, query: str) -> list[int]:
        """Batches that have reported; one that is missing ended with a driver that was lost."""
        return [int(n.removesuffix(".json")) for n in files.names(self._spark, f"{self._root}/{query}") if n[0] != "."]

    def totals(self) -> dict[str, int | None]:
        """All measures added up, over all queries and batches; by name without the way of adding."""
        ways = {_SUM: sum, _MIN: min, _MAX: max}
        values: dict[str, list] = {}
        for query in files.names(self._spark, self._root):
            for name in files.names(self._spark, f"{self._root}/{query}"):
                if name[0] == ".":
                    continue
                for k, v in json.loads(files.read(self._spark, f"{self._root}/{query}/{name}")).items():
                    values.setdefault(k, []).extend([] if v is None else [v])
        return {k.rpartition(":")[0]: ways[k.rpartition(":")[2]](v) if v else None for k, v in values.items()}


def run_counted(writer: DataStreamWriter, totals: ProgressTotals) -> StreamingQuery:
    """Run over what is available, and wait until the batches have reported."""
    spark = totals._spark
    spark.streams.addListener(totals)
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(totals)
    return query


def route_report(spark: SparkSession, totals: dict[str, int | None], routes: tuple[str, ...]) -> DataFrame:
    """The counters and rates of a report from totals: a row per route."""
    rows = []
    for i, route in enumerate(routes):
        of = lambda k: totals.get(f"{i}:{k}")
        if not of("requests"):
            continue
        span = (of("last_end") - of("first_start")) / 1e6
        rows.append((
            route, of("requests"), of("check_passes"), of("requests") - of("check_passes"), of("failed_requests"),
            of("failed_requests") / of("requests"), of("iterations"), of("vus_min"), of("vus_max"),
            of("requests") / span if span else None,
        ))
    return spark.createDataFrame(
        rows, "endpoint string, requests long, check_passes long, check_fails long, failed_requests long, "
        "failed_rate double, iterations long, vus_min int, vus_max int, per_second double",
    )
