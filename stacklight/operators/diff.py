"""Path-level differences between a frozen run and its decisions, review strata and the review queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STABLE = ("processed", "baseline_identity_unverifiable")
PENDING_BUCKET = "待复核"


_TAGS = "array<struct<name:string,score:double>>"


def status_of(occurrence_state: Column, item_state: Column, unverifiable: Column) -> Column:
    return (
        F.when((occurrence_state == "PROCESSED") | (item_state == "COMPLETE"), F.when(unverifiable, STABLE[1]).otherwise(STABLE[0]))
        .when(item_state == "FAILED", "error")
        .when(item_state.isin("PENDING", "LEASED", "RETRYABLE_FAILED"), F.lower(item_state))
        .otherwise(F.lower(occurrence_state))
    )


def diff_rows(frozen: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each path of frozen (source_path, asset_id, status, old_bucket, audit_locked, reason) with its decision (asset_id, proposed_bucket, identity, confidence, reasons)."""
    both = frozen.join(decisions.withColumn("__decided", F.lit(True)), "asset_id", "left")
    stable, undecided = F.col("status").isin(*STABLE), F.col("__decided").isNull()
    nothing = F.array().cast("array<string>")
    why = F.concat(F.coalesce("reasons", nothing), F.when(~stable, F.array("status")).otherwise(nothing), F.when(stable & undecided, F.array(F.lit("decision_missing"))).otherwise(nothing))
    return both.select(
        F.sha2("source_path", 256).alias("occurrence_id"), "source_path", "asset_id", "status",
        F.when(stable, "processed").otherwise(F.col("status")).alias("processing_state"), "old_bucket", "proposed_bucket",
        F.when(F.col("audit_locked"), F.col("old_bucket")).otherwise(F.col("proposed_bucket")).alias("effective_bucket"),
        "identity", "confidence", "audit_locked", F.when(~F.col("audit_locked"), "candidate_only").alias("action"),
        F.array_sort(F.array_distinct(why)).alias("review_reasons"), "reason", *(c for c in ("evidence",) if c in frozen.columns),
    )


def run_states(occ: DataFrame, items: DataFrame) -> DataFrame:
    """A run's paths (source_path, asset_id, occurrence_state, baseline_identity_unverifiable, ...) with the status that its item (asset_id, state) gives them, and the evidence of the item's features."""
    own = items.select("asset_id", F.col("state").alias("__item"), F.col("features").alias("__features") if "features" in items.columns else F.lit(None).cast("string").alias("__features"))
    both = occ.join(own, "asset_id", "left")
    status = status_of(F.col("occurrence_state"), F.col("__item"), F.col("baseline_identity_unverifiable"))
    return both.withColumns({"status": status, "evidence": F.when(F.col("__features").isNotNull(), evidence(F.col("__features")))}).drop("__item", "__features")


def run_diff(occ: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """The diff rows of a run: statuses, decisions, evidence, strata for review, and unidentified paths held back."""
    frozen = run_states(occ, items)
    frozen = frozen if "reason" in frozen.columns else frozen.withColumn("reason", F.lit(None).cast("string"))
    rows = diff_rows(frozen, decisions)
    e = lambda name: F.col(f"evidence.{name}")
    unidentified = (F.col("processing_state") == "processed") & (F.coalesce("identity", F.lit("")) == "")
    found = strata(F.col("audit_locked"), e("explicit_score"), e("rating_explicit"), e("rating_sensitive"), e("rating_questionable"), e("quality_boundary"), unidentified)
    return held_back(rows.withColumn("review_strata", found))


def with_paths(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """The review queue with the path of each occurrence; the queue is the small side."""
    return rows.select("occurrence_id", "source_path").join(F.broadcast(queue), "occurrence_id")


def summary(rows: DataFrame) -> DataFrame:
    """occurrences, audit_locked, review_required: one aggregation."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("occurrences"), n(F.col("audit_locked")).alias("audit_locked"), n(F.size("review_reasons") > 0).alias("review_required"))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """column, n without nulls."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def evidence(features: Column) -> Column:
    """struct of what review needs from an asset's features (JSON text); a missing measure doesn't raise a flag."""
    get = lambda path, kind="double": F.get_json_object(features, path).cast(kind)
    low = F.coalesce(get("$.technical.entropy_bits"), F.lit(9.0)) < 2
    dark = F.coalesce(get("$.technical.dark_clip_ratio"), F.lit(0.0)) > 0.1
    bright = F.coalesce(get("$.technical.bright_clip_ratio"), F.lit(0.0)) > 0.1
    ratings = [get(f"$.analysis.wd14_moat.rating_{r}").alias(f"rating_{r}") for r in ("general", "sensitive", "questionable", "explicit")]
    tags = F.slice(F.coalesce(F.from_json(F.get_json_object(features, "$.analysis.wd14_moat.top_tags"), _TAGS), F.array().cast(_TAGS)), 1, 8)
    scores = (F.coalesce(get(f"$.analysis.nudenet.{name}"), F.lit(0.0)).alias(name) for name in ("explicit_score", "covered_score"))
    return F.struct(*ratings, tags.alias("top_tags"), *scores, (low | dark | bright).alias("quality_boundary"))


def strata(locked: Column, explicit_score: Column, rating_explicit: Column, rating_sensitive: Column, rating_questionable: Column, quality_boundary: Column, unidentified: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = F.array_compact(
        F.array(
            F.when(locked, "published_lock"),
            F.when((zero(explicit_score) > 0) | (zero(rating_explicit) >= 0.1), "safety_signal"),
            F.when((zero(rating_sensitive) >= 0.2) | (zero(rating_questionable) >= 0.1), "safety_boundary"),
            F.when(F.coalesce(quality_boundary, F.lit(False)), "quality_boundary"),
            F.when(unidentified, "unknown_identity"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("source_outcome")))


def strata_of_reasons(reasons: Column) -> Column:
    """Where no strata are given: the kinds that reasons begin with, else general."""
    kinds = ("safety", "identity", "quality", "source", "baseline")
    begins = lambda kind: F.exists(reasons, lambda r: F.lower(r).startswith(kind))
    found = F.array_compact(F.array(*(F.when(begins(k), k) for k in kinds)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def held_back(rows: DataFrame) -> DataFrame:
    """Processed, unlocked paths without an identity wait for review."""
    waits = (F.col("processing_state") == "processed") & (F.coalesce("identity", F.lit("")) == "") & ~F.col("audit_locked")
    more = F.array(F.lit("identity_reference_decision_pending"), F.lit("status_policy_not_calibrated"))
    return rows.withColumns({
        "proposed_bucket": F.when(waits, PENDING_BUCKET).otherwise(F.col("proposed_bucket")),
        "effective_bucket": F.when(waits, PENDING_BUCKET).otherwise(F.col("effective_bucket")),
        "review_reasons": F.when(waits, F.array_sort(F.array_distinct(F.concat("review_reasons", more)))).otherwise(F.col("review_reasons")),
    })


def review_rank(seed: str, identifier: str | Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(identifier) if isinstance(identifier, str) else identifier), 256)


def review_queue(rows: DataFrame, limit: int = 500, seed: str = "review-v1", identifier: str = "occurrence_id", review_strata: str = "review_strata") -> DataFrame:
    """identifier, stratum, review_id of at most `limit` rows, the same on every run.

    Strata take turns, each giving its next row by a seeded hash that isn't taken yet. A
    cursor only passes rows that are taken, and at most `limit` rows are taken, so the first
    `limit` rows of each stratum decide. They are cut by a ranking window (limited before its
    shuffle) over salted strata, then once more, and only those rows take turns.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    each = rows.select(F.col(identifier).alias("id"), F.explode(review_strata).alias("stratum")).where("id is not null").distinct().withColumn("rank", review_rank(seed, "id"))
    first = F.row_number().over(Window.partitionBy("stratum", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("rank", "id"))
    second = F.row_number().over(Window.partitionBy("stratum").orderBy("rank", "id"))
    few = each.withColumn("n", first).where(F.col("n") <= limit).drop("n").withColumn("n", second).where(F.col("n") <= limit)

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = {s: list(zip(g["rank"], g["id"], strict=True)) for s, g in pdf.sort_values(["rank", "id"]).groupby("stratum")}
        cursor, taken = dict.fromkeys(sorted(lists), 0), {}
        while len(taken) < limit:
            before = len(taken)
            for s in cursor:
                while cursor[s] < len(lists[s]):
                    rank, key = lists[s][cursor[s]]
                    cursor[s] += 1
                    if key not in taken:
                        taken[key] = (s, rank)
                        break
                if len(taken) >= limit:
                    break
            if len(taken) == before:
                break
        return pd.DataFrame([(k, s, r) for k, (s, r) in taken.items()], columns=[identifier, "stratum", "review_id"])

    return few.groupBy(F.lit("all")).applyInPandas(turns, f"{identifier} string, stratum string, review_id string")
