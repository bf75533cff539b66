"""Counters of the operators of a stream: observed on the rows that pass, gathered by a listener, kept as a table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROW = "query string, batch long, operator string, counter string, value long"


def counted(df: DataFrame, operator: str, **counters: Column) -> DataFrame:
    """df, with the rows that pass `operator` counted: `rows`, and for each counter those for which it holds.

    The counts are made where the rows are, in the stages that are there; no row is moved for them.
    """
    return df.observe(operator, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counters.items()])


class Counters(StreamingQueryListener):
    """Counts of each batch: what `counted` observes, and the rows that stateful operators drop behind the watermark."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        found = [(name, p.batchId, operator, c, int(v)) for operator, row in p.observedMetrics.items() for c, v in row.asDict().items() if v is not None]
        found += [(name, p.batchId, s.operatorName, "dropped_late", int(s.numRowsDroppedByWatermark)) for s in p.stateOperators]
        with self.lock:
            self.rows += found

    def table(self, spark: SparkSession) -> DataFrame:
        """query, batch, operator, counter, value: the counts so far, a few for each batch. A batch that is reported again counts once."""
        with self.lock:
            rows = list(self.rows)
        return spark.createDataFrame(rows, ROW).groupBy("query", "batch", "operator", "counter").agg(F.max("value").alias("value"))

    def totals(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).groupBy("query", "operator", "counter").agg(F.sum("value").alias("value"))

    def flush(self, spark: SparkSession, path: str) -> None:
        """Append the counts so far to a table and forget them."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(path)
