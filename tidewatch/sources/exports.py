"""Sorted exports with a manifest of row ranges: any page is read from the files that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sorted_export(df: DataFrame, path: str, order: list[Column], files: int | None = None, most: int = 1_000_000) -> int:
    """Write df in the given order as Parquet files of at most `most` rows; gives the number of rows.

    order should be total, else rows that are equal in it stand in any order. One shuffle by ranges sorts all; the manifest
    (file, first, n: a row for each file) is small, and its running sum is the only step in one task.
    """
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{path}/rows")
    back = df.sparkSession.read.parquet(f"{path}/rows")
    sizes = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
    # names begin with the number of the range, then of the file in it
    place = F.concat(F.substring("file", 1, 10), F.regexp_extract("file", r"(c\d+)\.", 1))
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page(spark: SparkSession, path: str, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """(rows, total): `limit` rows from `offset` on, with row, their number from 0. Files without such rows are not opened."""
    manifest = spark.read.parquet(f"{path}/manifest")
    total = manifest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = manifest.where((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset)).select("file", "first").collect()
    rows = spark.read.parquet(f"{path}/rows")
    if not wanted:
        return rows.withColumn("row", F.lit(None).cast("long")).where("false"), total
    own = spark.read.schema(rows.schema).parquet(*[f"{path}/rows/{r['file']}" for r in wanted])
    starts = F.create_map(*[x for r in wanted for x in (F.lit(r["file"]), F.lit(r["first"]))])
    own = own.withColumn("row", starts[F.col("_metadata.file_name")] + F.col("_metadata.row_index"))
    return own.where(F.col("row").between(offset, offset + limit - 1)).orderBy("row"), total
