"""License scan: MinHash bands over overlapping windows find templates, exact shingle containment decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, table
from tidewatch.llm.notices import NOTICES

SHINGLE = 5
CONTAINED = 0.75
MISSED = 1e-6  # probability that no band of a window that holds a template collides, at most

def words(text: Column) -> Column:
    """Runs of letters and digits in small letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(own: Column, width: int) -> Column:
    """64-bit hashes of the word shingles, by place."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(own) - width), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(width)]))
    return F.when(F.size(own) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def least(own: Column, seed: Column) -> Column:
    """MinHash of shingles under one of a family of functions."""
    return F.array_min(F.transform(own, lambda x: F.xxhash64(x, seed)))


def bands(m: int, stride: int, contained: float = CONTAINED) -> int:
    """Bands of one row each, so many that a window with the template collides but for the probability MISSED."""
    need = math.ceil(contained * m)
    jaccard = need / (m + stride - 1 + m - need)
    return 1 if jaccard >= 1 else math.ceil(math.log(MISSED) / math.log(1 - jaccard))


def shape(n_words: int) -> tuple[int, int, int]:
    """(shingle width, stride, shingles of a window) for a template of so many words."""
    width = min(SHINGLE, n_words)
    m = n_words - width + 1
    stride = max(1, m // 4)
    return width, stride, m + stride - 1


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license_id, containment (the best), first_word (of the first window), n_windows for each license found.

    A license is found in a window of a text if it holds this share of the template's distinct five-word shingles, or,
    for a template of fewer words, the template. Windows of a template have its length and a quarter more and start at
    every quarter; a shorter text is one window. Null and empty texts have no windows; documents without a license have
    no row. Rows that repeat a doc_id are one document. Other columns are ignored.

    A band of a window collides with the template's only if both have the same least shingle. So a text that lacks the
    least shingles of all bands of all templates cannot collide; such texts are left out before their windows are made.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame(sorted(notices.items()), "license_id string, text string").select("license_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    docs = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    sizes = {r["license_id"]: r["n"] for r in given.select("license_id", F.size("words").alias("n")).collect()}  # of the fixed list
    if not sizes:
        return docs.select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_windows")).where("false")
    kinds = sorted({shape(n) for n in sizes.values()})
    kind = [F.when(F.col("license_id").isin([i for i, n in sizes.items() if shape(n) == k]), F.lit(at)) for at, k in enumerate(kinds)]
    column = lambda f: F.element_at(F.array(*[F.lit(f(*k)) for k in kinds]), F.col("kind") + 1)
    shapes = {"width": column(lambda w, s, h: w), "stride": column(lambda w, s, h: s), "held": column(lambda w, s, h: h), "bands": column(lambda w, s, h: bands(h - s + 1, s, contained))}
    widths = sorted({w for w, _, _ in kinds})
    own = lambda words_: F.coalesce(*[F.when(F.col("width") == w, shingles(words_, w)) for w in widths])
    seeds = F.sequence(F.lit(0), F.col("bands") - 1)
    # templates: their shingles, the value of each band, and for each the shingle that gives it
    t = given.withColumn("kind", F.coalesce(*kind)).withColumns(shapes).withColumn("shingles", own(F.col("words")))
    t = t.select("license_id", "kind", "shingles", "words", "width", F.explode(seeds).alias("band")).withColumn("value", least(F.col("shingles"), F.col("band")))
    lead = F.filter("shingles", lambda x: F.xxhash64(x, F.col("band")) == F.col("value"))[0]
    t = t.withColumn("lead", lead)
    lead_words = F.slice("words", F.array_position("shingles", F.col("lead")).cast("int"), F.col("width"))
    by_length = F.transform(F.array_sort(F.transform(F.array_distinct(lead_words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    leads = t.select("kind", "lead", by_length.alias("words")).distinct().collect()  # of the fixed list
    rows = t.select("license_id", "kind", "band", "value", F.array_distinct("shingles").alias("template"))
    # a collision needs a least shingle, and so all its words: the longest is looked for first
    many = lambda lists: F.array(*[F.array(*[F.lit(w) for w in x]) for x in lists])
    texts = sorted({tuple(r["words"]) for r in leads})
    near = docs.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted({x[0] for x in texts})])))
    common = F.array_intersect("words", F.array(*[F.lit(w) for w in sorted({w for x in texts for w in x})]))
    # as a lambda's argument the words in common are worked out once a row
    near = near.where(F.exists(F.array(common), lambda c: F.exists(many(texts), lambda x: F.forall(x, lambda w: F.array_contains(c, w)))))
    near = materialize(near.select("doc_id", *[shingles(F.col("words"), w).alias(f"of_{w}") for w in widths]), "marked")
    marks = F.element_at(many([sorted({r["lead"] for r in leads if r["kind"] == k}) for k in range(len(kinds))]), F.col("kind") + 1)
    at = near.withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1)))).withColumns(shapes | {"marks": marks})
    at = at.withColumn("all", F.coalesce(*[F.when(F.col("width") == w, F.col(f"of_{w}")) for w in widths])).where(F.arrays_overlap("all", "marks"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - 1), F.col("stride"))
    wins = at.select("doc_id", "kind", "bands", "marks", "held", "all", F.explode(starts).alias("start"))
    wins = wins.select("doc_id", "kind", "bands", "marks", "start", F.slice("all", F.col("start") + 1, F.col("held")).alias("window")).where(F.arrays_overlap("window", "marks"))
    keyed = wins.select("doc_id", "kind", "start", "window", F.explode(seeds).alias("band")).withColumn("value", least(F.col("window"), F.col("band")))
    # the templates are a fixed list, a row for each band
    hits = keyed.join(F.broadcast(rows), ["kind", "band", "value"])
    share = F.size(F.array_intersect("template", "window")) / F.size("template")
    out = hits.select("doc_id", "license_id", "start", share.alias("share")).where(F.col("share") >= contained)
    # a window can collide in several bands, and stands for one
    return out.distinct().groupBy("doc_id", "license_id").agg(F.round(F.max("share"), 6).alias("containment"), F.min("start").cast("long").alias("first_word"), F.count_distinct("start").alias("n_windows"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(notices: dict[str, str] = NOTICES, contained: float = CONTAINED) -> str:
    """The same by plain SQL: every window of every text against every template."""
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(notices.items()))
    split = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
with n(license_id, text) as (values {quoted}),
t0 as (select license_id, {split.format("text")} w from n),
t1 as (select license_id, w, least({SHINGLE}, len(w)) width, len(w) - least({SHINGLE}, len(w)) + 1 m from t0 where len(w) > 0),
t as (select license_id, width, greatest(1, m // 4) stride, m + greatest(1, m // 4) - 1 held,
    list_distinct(list_transform(range(m), lambda i: array_to_string(w[i + 1:i + width], ' '))) own from t1),
d as (select doc_id, {split.format("coalesce(text, '')")} w from documents),
p as (select doc_id, width, w, unnest(range(len(w) - width + 1)) i from d, (select distinct width from t)),
s as (select doc_id, width, i, array_to_string(w[i + 1:i + width], ' ') x, len(w) - width + 1 n from p),
h as (select doc_id, license_id, i, x, stride, held, n, m
    from s join (select license_id, width, stride, held, len(own) m, unnest(own) x from t) using (width, x)),
c as (select doc_id, license_id, start * stride start, count(distinct x) / m share
    from (select *, unnest(range(greatest(0, (i - held) // stride), i // stride + 1)) start from h)
    where start * stride <= i and i < start * stride + held group by doc_id, license_id, start, stride, m)
select doc_id, license_id, round(max(share), 6) containment, min(start)::bigint first_word, count(distinct start)::bigint n_windows
from c where share >= {contained} group by doc_id, license_id
"""
