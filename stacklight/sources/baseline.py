"""Baselines of earlier moves: CSV exports whose headers vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import paths

# The header names that earlier exports use for each field, first match first.
ALIASES = {
    "kind": ("kind", "type", "asset_kind"),
    "source_path": ("source", "source_path", "path", "source_file"),
    "old_bucket": ("bucket", "old_bucket", "status", "state"),
    "baseline_sha256": ("sha256", "source_sha256", "hash"),
    "destination_path": ("destination", "destination_path", "target"),
    "source_engine": ("source_engine", "engine", "model"),
    "entity": ("entity", "ip", "project"),
    "subject": ("subject", "character", "name"),
    "source_size": ("size", "source_size", "bytes"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark before the first header goes."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if not raw.columns:
        raise ValueError("a baseline needs a header row")
    return raw.toDF(*(c.lstrip("﻿") for c in raw.columns))


def fields(raw: DataFrame) -> DataFrame:
    """One column for each field of ALIASES."""
    return raw.select(*(paths.alias_column(raw.columns, *names).alias(field) for field, names in ALIASES.items()))


def normalised(raw: DataFrame, images_only: bool = True) -> DataFrame:
    """Typed baseline rows: image rows outside excluded places, digests that are digests, sizes that are numbers, and the two derived flags."""
    f = fields(raw).where(F.col("source_path").isNotNull() & ~paths.is_excluded("source_path"))
    if images_only:
        f = f.where((F.lower("kind") == "image") & paths.is_image("source_path"))
    sha = paths.valid_sha256("baseline_sha256")
    f = f.withColumns({"old_bucket": F.coalesce("old_bucket", F.lit(paths.PENDING_STATE)), "baseline_sha256": sha, "source_size": paths.integer_or_null("source_size")})
    return f.withColumns({"audit_locked": paths.is_posted("old_bucket"), "baseline_identity_unverifiable": F.col("baseline_sha256").isNull(), "occurrence_id": paths.occurrence_id("source_path")})


def repeated_paths(rows: DataFrame) -> DataFrame:
    """Paths that occur more than once; a run must not start with any."""
    return rows.groupBy("source_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
