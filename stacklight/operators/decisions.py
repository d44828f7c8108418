"""Decision runs over a finished feature run: created once, results kept by decision and asset, joined to paths.

decision_runs: decision_id, run_id, config_fingerprint, reference_fingerprint, labels_fingerprint, status.
results: decision_id, asset_id, proposed_bucket, identity, confidence, decision_state, reasons, event_seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.operators.assets import latest

FINGERPRINTS = ("run_id", "config_fingerprint", "reference_fingerprint", "labels_fingerprint")


def created(known: DataFrame, asked: DataFrame) -> DataFrame:
    """The decision runs of asked that aren't known yet, one for each id (the first by its fingerprints): rows to append."""
    rest = [c for c in asked.columns if c != "decision_id"]
    new = asked.groupBy("decision_id").agg(F.min(F.struct(*rest)).alias("__first")).select("decision_id", "__first.*")
    return new.join(known.select("decision_id"), "decision_id", "left_anti").withColumn("status", F.lit("CREATED"))


def reuse(known: DataFrame, asked: DataFrame) -> DataFrame:
    """decision_id, outcome for each asked run: new; resumed or complete, where an equal one is known; refused, where its inputs differ or it failed."""
    own = known.select("decision_id", F.struct(*FINGERPRINTS, "status").alias("__known"))
    equal = F.lit(True)
    for c in FINGERPRINTS:
        equal = equal & F.col(f"__known.{c}").eqNullSafe(F.col(c))
    status = F.col("__known.status")
    outcome = F.when(F.col("__known").isNull(), "new").when(equal & (status == "COMPLETE"), "complete").when(equal & (status == "CREATED"), "resumed").otherwise("refused")
    return asked.join(own, "decision_id", "left").select("decision_id", outcome.alias("outcome"))


def members(decision_runs: DataFrame, items: DataFrame) -> DataFrame:
    """decision_id, asset_id of all assets in each decision's run; there are few runs of decisions for a run."""
    return items.select("run_id", "asset_id").join(decision_runs.select("decision_id", "run_id"), "run_id").select("decision_id", "asset_id").distinct()


def strangers(results: DataFrame, decision_runs: DataFrame, items: DataFrame) -> DataFrame:
    """Results whose asset is no part of their decision's run."""
    return results.join(members(decision_runs, items), ["decision_id", "asset_id"], "left_anti")


def recorded(results: DataFrame, decision_runs: DataFrame, items: DataFrame) -> DataFrame:
    """The last result of each decision and asset; a result whose asset is no part of its decision's run is an error."""
    inside = members(decision_runs, items).withColumn("__inside", F.lit(True))
    last = latest(results, ["decision_id", "asset_id"], "event_seq").join(inside, ["decision_id", "asset_id"], "left")
    checked = F.when(F.col("__inside").isNull(), F.raise_error(F.concat(F.lit("not part of the decision's run: "), "asset_id"))).otherwise(F.col("asset_id"))
    return last.withColumn("asset_id", checked).drop("__inside")


def effective(locked: Column, old: Column, proposed: Column) -> Column:
    """A locked path keeps its bucket."""
    return F.when(locked, old).otherwise(proposed)


def decision_diffs(occ: DataFrame, decision_runs: DataFrame, results: DataFrame) -> DataFrame:
    """A row for every path of each decision's run (run_id, source_path, asset_id, old_bucket, audit_locked, occurrence_state) with its result, if any."""
    runs = decision_runs.select("decision_id", "run_id")
    both = occ.join(runs, "run_id").join(results, ["decision_id", "asset_id"], "left")
    return both.select(
        "decision_id", "source_path", "asset_id", "old_bucket", "audit_locked", "occurrence_state", "proposed_bucket", "identity", "confidence", "decision_state", "reasons",
        effective(F.col("audit_locked"), F.col("old_bucket"), F.col("proposed_bucket")).alias("effective_bucket"),
    )
