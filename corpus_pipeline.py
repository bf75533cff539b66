"""The corpus pipeline: each stage takes the documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, lines, minhash, packing, toxicity
from tidewatch.llm.common import materialize, table
from tidewatch.llm.labelled import crc

REJECTED = 0.3  # toxicity from which on a document goes


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the limit, as they were.

    Whole texts are rated, however long; null and empty texts are rated as empty ones. Rows equal in text are rated alike.
    The scorer is fitted on labelled rows of docs, whose doc_ids may be null or repeated. An empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc() % 4 != 2)
    return docs.where(toxicity.rating(docs, model) < REJECTED)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines, n_chars counted anew; those of which nothing is left go.

    Null, empty and blank texts lose no line and stay. Rows equal in doc_id and text are one document, so they stay or go
    together; a null doc_id comes first among those that have a line. Other columns stay as they are, whatever their names.
    """
    rest = [c for c in docs.columns if c != "text"]
    out = lines.dedup(docs.select("doc_id", "text", F.struct(*rest).alias("rest"))).where("not (n_dropped > 0 and trim(text) = '')")
    own = {c: F.col("rest").getField(c) for c in rest} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[own[c].alias(c) for c in docs.columns])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest doc_id (ties: by a hash of its text).

    A document is a doc_id with a text: rows equal in both stay or go together, texts that share a doc_id are compared
    like any others. Rows without a doc_id take no part and all stay.
    """
    # rows get numbers where they stand, so texts are not moved for them; one document's rows are equal in id and hash
    own = materialize(docs.withColumns({"__n": F.monotonically_increasing_id(), "__row": _row()}), "numbered")
    named = own.where("doc_id is not null")
    found = minhash.components(named.select(F.col("__n").alias("doc_id"), "text")).select(F.col("doc_id").alias("__m"), "component_id")
    # written, as it is read twice below: the driver would hold the plan of all that made it twice over, anew at each stage's end
    found = materialize(found.join(named.select(F.col("__n").alias("__m"), F.struct("doc_id", "__row").alias("document")), "__m"), "members")
    first = found.groupBy("component_id").agg(F.min("document").alias("document"))
    kept = found.join(first, ["component_id", "document"]).select("__m")
    out = named.join(kept.hint("shuffle_hash"), F.col("__n") == F.col("__m"), "left_semi")
    return out.unionByName(own.where("doc_id is null")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Rows are told apart by doc_id, null or not, and text.

    Null and empty texts have no words and stay; very long texts are searched in parts that overlap by a window. Rows equal
    in doc_id and text stay or go together. An empty table, or an empty benchmark, leaves all as they are.
    """
    hit = decontaminate.row_hits(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    names = docs.withColumn("__own", _row())
    return names.join(hit.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__row")), "left_anti").select(*docs.columns)


def _row():
    """The hash that tells rows of one doc_id apart; no text counts as an empty one, as in the operators."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left and their places in the sequences.

    A null text is an empty one: a piece of the end token alone. Rows that repeat a doc_id are packed each. Long texts are cut
    into pieces of a whole sequence and one that may be shorter. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# The learned toxicity scorer and the greedy plan of the packing can't be said in SQL; tests/llm holds each stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written as Parquet in the shared folder and read again.

    A stage that keeps nothing gives an empty table, which the next takes. Columns beyond those of documents stay up to the
    packing.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
