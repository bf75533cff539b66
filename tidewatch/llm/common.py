"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.graph import components as connected_components  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be any that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where it is unset, as in tests, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again.

    A lost executor then costs its running tasks only. checkpoint() would run the last stage twice.
    """
    path = f"{shared_dir(df.sparkSession)}/tidewatch-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value):
    """A function that gives value in any task. Broadcast: value must be of a bounded size."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))  # classes of this package go by value

    return lambda: pickle.loads(held.value)


def size_within(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; looks at no more than one row beyond them."""
    return df.limit(rows + 1).count() <= rows
