"""JSON sources of vectors, references and labelled records, and the tag table; all strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """vector, from a list or {"vector": list}."""
    t = _text(spark, path)
    plain, named = F.from_json("value", "array<double>"), F.from_json("value", "struct<vector:array<double>>")["vector"]
    v = F.coalesce(named, plain)
    return t.select(F.when(F.size(v) > 0, v).otherwise(F.raise_error(F.lit("a vector must be a list of numbers"))).alias("vector"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """label, vector, from {label: [[...], ...]} or {label: [...]}."""
    parts = _text(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "raw"))
    many = F.from_json("raw", "array<array<double>>")
    good = F.exists(many, lambda v: v.isNotNull())
    return parts.select("label", F.explode(F.when(F.coalesce(good, F.lit(False)), many).otherwise(F.array(F.from_json("raw", "array<double>")))).alias("vector"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """id (its place where none is given), label (or null), vector, from a list of records."""
    rows = _text(spark, path).select(F.posexplode(F.from_json("value", "array<struct<label:string,vector:array<double>,id:string>>")).alias("n", "r"))
    vector = F.when(F.size("r.vector") > 0, F.col("r.vector")).otherwise(F.raise_error(F.lit("a record needs a vector")))
    return rows.select(F.coalesce(F.col("r.id"), F.col("n").cast("string")).alias("id"), "r.label", vector.alias("vector"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """name, category in file order; a blank name is an error."""
    tags = spark.read.option("header", True).csv(path)
    name = F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.col("name")).otherwise(F.raise_error(F.lit("every tag needs a name")))
    return tags.withColumn("name", name)
