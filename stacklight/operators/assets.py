"""Content identity: an asset is its bytes, a path is one occurrence of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(rows: DataFrame, path: str, content: str | Column) -> DataFrame:
    """rows with source_path and asset_id, the SHA-256 of the content."""
    content = F.col(content) if isinstance(content, str) else content
    return rows.withColumns({"source_path": F.col(path), "asset_id": F.sha2(content, 256)})


def assets(occ: DataFrame, order: str = "source_path") -> DataFrame:
    """asset_id, source_path (the first by `order`), n_occurrences: one partial aggregation."""
    return occ.groupBy("asset_id").agg(F.min_by("source_path", F.struct(order, "source_path")).alias("source_path"), F.count(F.lit(1)).alias("n_occurrences"))


def with_first(occ: DataFrame, order: str = "source_path") -> DataFrame:
    """occ with first_path and n_occurrences of its asset.

    The join has a second key, the digest's length, so that the aggregated side is shuffled
    anew and adaptive execution may split an asset that very many paths share.
    """
    own = occ.withColumn("__length", F.length("asset_id"))
    groups = own.groupBy("asset_id").agg(F.min_by("source_path", F.struct(order, "source_path")).alias("first_path"), F.count(F.lit(1)).alias("n_occurrences"), F.any_value("__length").alias("__length"))
    return own.join(groups, ["asset_id", "__length"]).drop("__length")


def scan_counts(occ: DataFrame, known: DataFrame | None = None, failed: Column | None = None) -> DataFrame:
    """discovered, enqueued (assets not yet known), duplicates, errors (counted in discovered)."""
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    own = occ.select("asset_id", bad.alias("bad"))
    fine = own.where(~F.col("bad")).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    if known is not None:
        fine = fine.join(known.select("asset_id", F.lit(True).alias("seen")).distinct(), "asset_id", "left")
    else:
        fine = fine.withColumn("seen", F.lit(None).cast("boolean"))
    sums = fine.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fine"), F.coalesce(F.sum(F.when(F.col("seen").isNull(), 1)), F.lit(0)).cast("bigint").alias("enqueued"))
    errors = own.agg(F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("errors"))
    return sums.join(F.broadcast(errors)).select((F.col("fine") + F.col("errors")).alias("discovered"), "enqueued", (F.col("fine") - F.col("enqueued")).alias("duplicates"), "errors")


def inventory(occ: DataFrame) -> DataFrame:
    """assets, occurrences."""
    return occ.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("assets"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))


def enqueue(known: DataFrame, found: DataFrame) -> DataFrame:
    """The found assets that aren't known yet, each once."""
    return assets(found).join(known.select("asset_id"), "asset_id", "left_anti")


def latest(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The last row of each key by `order`, by a partial aggregation."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, *(c for c in others if c != order))).alias("row")).select(*keys, "row.*")


def unique_assets(frozen: DataFrame) -> DataFrame:
    """asset_id, paths (sorted) of stable occurrences: what inference runs on, once for each content."""
    stable = frozen.where(F.col("status").isin("processed", "baseline_identity_unverifiable") & F.col("asset_id").isNotNull())
    return stable.groupBy("asset_id").agg(F.array_sort(F.collect_list("source_path")).alias("paths"))
