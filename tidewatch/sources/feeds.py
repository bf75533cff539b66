"""Feeds as DataFrames: sanctions XML and CSV, pipe-separated cells, JSON lists, policies and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "entry_id string, name string, aliases array<string>, country string, kind string"


def un_xml(spark: SparkSession, path: str) -> DataFrame:
    """Individuals and entities of a sanctions list; those without a name are left out."""
    person = "DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, INDIVIDUAL_ALIAS array<struct<ALIAS_NAME: string>>, NATIONALITY struct<VALUE: string>"
    body = "DATAID string, FIRST_NAME string, ENTITY_ALIAS array<struct<ALIAS_NAME: string>>, ENTITY_ADDRESS array<struct<COUNTRY: string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    names = lambda col: F.filter(F.transform(F.coalesce(col, F.array()), lambda x: F.trim(x["ALIAS_NAME"])), lambda x: F.coalesce(x, F.lit("")) != "")
    a = read("INDIVIDUAL", person).select(F.col("DATAID").alias("entry_id"), F.trim(F.concat_ws(" ", "FIRST_NAME", "SECOND_NAME", "THIRD_NAME")).alias("name"), names(F.col("INDIVIDUAL_ALIAS")).alias("aliases"), F.col("NATIONALITY.VALUE").alias("country"), F.lit("individual").alias("kind"))
    b = read("ENTITY", body).select(F.col("DATAID").alias("entry_id"), F.trim("FIRST_NAME").alias("name"), names(F.col("ENTITY_ALIAS")).alias("aliases"), F.get(F.col("ENTITY_ADDRESS.COUNTRY"), F.lit(0)).alias("country"), F.lit("entity").alias("kind"))
    return a.unionByName(b).where("coalesce(name, '') <> ''")


def ofac_csv(spark: SparkSession, path: str) -> DataFrame:
    """Twelve columns without a header; vessels and aircraft are left out; the nationality stands in the remarks."""
    cols = "ent_num sdn_name sdn_type program title call_sign vess_type tonnage grt vess_flag vess_owner remarks"
    raw = spark.read.option("nullValue", "-0-").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path, schema=", ".join(f"{c} string" for c in cols.split()))
    kind = F.lower(F.coalesce("sdn_type", F.lit("")))
    own = raw.where(~kind.isin("vessel", "aircraft") & F.coalesce(F.col("sdn_name"), F.lit("")).rlike(r"\S"))
    nation = F.nullif(F.regexp_extract(F.coalesce("remarks", F.lit("")), r"(?i)nationality ([A-Za-z ]+)", 1), F.lit(""))
    return own.select(F.col("ent_num").alias("entry_id"), F.trim("sdn_name").alias("name"), F.array().cast("array<string>").alias("aliases"), nation.alias("country"), F.when(kind == "individual", "individual").otherwise("entity").alias("kind"))


def piped(column: str):
    """Cells like 'a | b' as arrays without empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def generic_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    have = lambda c, default: F.col(c) if c in raw.columns else F.lit(default)
    arrays = piped("aliases") if "aliases" in raw.columns else F.array().cast("array<string>")
    return raw.select(have("entry_id", None).cast("string").alias("entry_id"), F.trim("name").alias("name"), arrays.alias("aliases"), have("country", None).cast("string").alias("country"), F.coalesce(have("kind", None), F.lit("individual")).alias("kind")).where("coalesce(name, '') <> ''")


def json_list(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ENTRY).option("multiLine", True).json(path)
    return raw.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "kind": F.coalesce("kind", F.lit("individual"))}).where("coalesce(trim(name), '') <> ''")


def import_counts(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of an import by reason."""
    return accepted.select(F.lit("accepted").alias("reason")).unionByName(rejected.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Folders of <locale>.json, flat objects of templates, as locale, key, template."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("locale"), F.from_json("value", "map<string, string>").alias("m"))
    return raw.select("locale", F.explode("m").alias("key", "template"))


def policy(path: str):
    """The rules and the default of a YAML policy."""
    import yaml

    from tidewatch.operators.policy import from_dict

    with open(path) as f:
        return from_dict(yaml.safe_load(f))
