"""A keyed table of Parquet folders: buckets by key, snapshots by a manifest that appears at once, clean-up behind it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "version long, bucket int, folder string, n long"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark can write. Only clean-up needs this; it has no DataFrame form."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def maybe(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet table, or None where nothing has been written yet. All other errors are raised."""
    try:
        read = spark.read if schema is None else spark.read.schema(schema)
        return read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


@dataclass(frozen=True)
class KeyedTable:
    """The latest row of each key.

    path/data/v=<batch>/bucket=<b>: rows of the buckets that a batch changed. path/manifest/version=<batch>: one file with
    the folder of each bucket; a version is there when its file is, which is one rename. A batch that fails before it
    changes nothing, and one that is run again writes its folders anew, or, if it was published, does nothing. A batch reads
    and writes the buckets of its keys only. The number of buckets is fixed when the table is made; a bucket should fit a task.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    version: str
    buckets: int = BUCKETS
    keep: int = 2

    def manifest(self, before: int | None = None) -> DataFrame | None:
        """Rows of the newest version, or of the newest below `before`."""
        every = maybe(self.spark, f"{self.path}/manifest", MANIFEST)
        if every is None:
            return None
        own = every if before is None else every.where(F.col("version") < before)
        last = own.agg(F.max("version")).first()[0]
        return None if last is None else every.where(F.col("version") == last)

    def published(self) -> int | None:
        last = self.manifest()
        return None if last is None else last.first()["version"]

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table as of its newest version, or the newest below `before`; only: some of its buckets."""
        held = self.manifest(before)
        folders = [] if held is None else [r["folder"] for r in held.where("n > 0").collect() if only is None or r["bucket"] in only]
        return self.spark.read.parquet(*folders) if folders else None

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch: int) -> list[int]:
        """Write the data of a batch without publishing it; gives the buckets that it changes."""
        rows = rows.withColumn("bucket", self.bucket())
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # a number for each bucket at most
        old = self.read(batch, touched)
        names = [c for c in rows.columns if c != "bucket"]
        both = rows.withColumn("_new", F.lit(1))
        if old is not None:
            both = old.select(*names).withColumns({"bucket": self.bucket(), "_new": F.lit(0)}).unionByName(both)
        rest = [c for c in names if c not in self.keys]
        # of equal versions the newer batch's row counts, and within a batch one that its values decide
        order = F.struct(self.version, "_new", F.xxhash64(*rest))
        best = both.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select("bucket", *self.keys, "x.*")
        best.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={batch}")
        return touched

    def publish(self, batch: int, touched: list[int]) -> None:
        old = self.manifest(batch)
        held = {} if old is None else {r["bucket"]: (r["folder"], r["n"]) for r in old.collect()}
        counts = maybe(self.spark, f"{self.path}/data/v={batch}") if touched else None
        n = {} if counts is None else {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        held |= {b: (f"{self.path}/data/v={batch}/bucket={b}", n.get(b, 0)) for b in touched}
        rows = [(batch, b, *x) for b, x in sorted(held.items())] or [(batch, 0, "", 0)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.path}/manifest")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Take a batch in: all or nothing, once. Batches come in order; one at or below the published version is done."""
        last = self.published()
        if last is not None and batch <= last:
            return
        rows = rows.persist()
        try:
            self.publish(batch, self.write(rows, batch))
        finally:
            rows.unpersist()

    def clean(self) -> list[int]:
        """Remove all but the newest `keep` versions and the data that none of these has; gives the versions whose data went."""
        every = maybe(self.spark, f"{self.path}/manifest", MANIFEST)
        data = maybe(self.spark, f"{self.path}/data")
        if every is None or data is None:
            return []
        versions = sorted({r[0] for r in every.select("version").distinct().collect()})
        rows = every.where(F.col("version").isin(versions[-self.keep :])).select("folder").distinct().collect()
        used = {r["folder"] for r in rows}
        gone = []
        for r in data.select(F.col("v").cast("long").alias("v"), F.col("bucket").cast("int").alias("bucket")).distinct().collect():
            folder = f"{self.path}/data/v={r['v']}/bucket={r['bucket']}"
            if r["v"] <= versions[-1] and folder not in used:  # later data is that of a batch at work
                delete(self.spark, folder)
                gone.append(r["v"])
        for v in versions[: -self.keep]:
            delete(self.spark, f"{self.path}/manifest/version={v}")
        return sorted(set(gone))
