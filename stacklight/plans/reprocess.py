"""Runs from end to end: processing open items, and deciding from calibrated references.

Processing is one Spark job for each attempt; the driver only appends and looks at gates between them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.functions.paths import PENDING_STATE
from stacklight.operators import inference, openset, runs
from stacklight.sources.tables import RunTables

_EVENT = ("run_id", "asset_id", "event_seq", "state", "attempts", "lease_owner", "lease_token", "lease_expires_at", "outcome", "error", "features", "evidence", "embedding")


def start(tables: RunTables, run_id: str, assets: DataFrame) -> int:
    """Adds the assets (asset_id, source_path) that the run doesn't have yet as pending items; the number added."""
    new = assets.select("asset_id").distinct()
    if not tables.missing("items"):
        new = new.join(tables.events("items").where(F.col("run_id") == run_id).select("asset_id").distinct(), "asset_id", "left_anti")
    empty = {"event_seq": F.lit(0).cast("bigint"), "state": F.lit("PENDING"), "attempts": F.lit(0), "lease_expires_at": F.lit(None).cast("timestamp"), "embedding": F.lit(None).cast("array<double>")}
    rows = new.withColumn("run_id", F.lit(run_id)).withColumns({c: empty.get(c, F.lit(None).cast("string")) for c in _EVENT if c not in ("run_id", "asset_id")}).select(*_EVENT)
    n = rows.count()
    tables.append("items", rows, "run_id")
    return n


def items(tables: RunTables, run_id: str) -> DataFrame:
    return tables.current("items", ["run_id", "asset_id"]).where(F.col("run_id") == run_id)


def process(tables: RunTables, run_id: str, files: DataFrame, factory: Callable[[], Any], key: str, limit: int | None = None, gate: Callable[[], str | None] | None = None) -> dict[str, Any]:
    """Works off the run's open items, or the first `limit` of them, against files (asset_id, source_path, content and pixels): counts by state, status and why it paused.

    One Spark job analyses all of them and appends how they ended; what may be tried again is
    another job, three at most. Input and output errors retry up to three attempts, bad images
    end, lost providers and failed adapters pause the run, and a second out-of-memory of an
    item pauses it too. `gate` may say before each job why the run must wait.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    paused, done = None, 0
    for _ in range(runs.MOST_ATTEMPTS):
        if gate is not None and (paused := gate()):
            break
        own = items(tables, run_id)
        seq = (own.agg(F.max("event_seq")).first()[0] or 0) + 1
        left = runs.recover_leases(own, F.current_timestamp()).where(F.col("state").isin(*runs.CLAIMABLE))
        left = left if limit is None else left.orderBy("asset_id").limit(limit - done)
        left = left.select("run_id", "asset_id", (F.col("attempts") + 1).alias("attempts"))
        first = files.join(left.select("asset_id"), "asset_id", "left_semi").groupBy("asset_id").agg(F.min("source_path").alias("source_path"))
        results = inference.analyzed(files.join(first, ["asset_id", "source_path"], "left_semi"), factory, key)
        both = left.join(results, "asset_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("SOURCE_CHANGED")))
        nothing = {c: F.lit(None).cast("string") for c in ("lease_owner", "lease_token")} | {"lease_expires_at": F.lit(None).cast("timestamp")}
        ended = both.withColumns({"state": runs.retry_state(F.col("outcome"), F.col("attempts")), "event_seq": F.lit(seq).cast("bigint")} | nothing)
        tables.append("items", ended.select(*_EVENT), "run_id")
        events = tables.events("items").where(F.col("run_id") == run_id)
        ooms = events.where(F.col("outcome") == "OOM").groupBy("asset_id").agg(F.count(F.lit(1)).alias("ooms"))
        written = events.where(F.col("event_seq") == seq).join(ooms, "asset_id", "left")
        why = runs.pause_reason(F.col("outcome"), F.coalesce("ooms", F.lit(0)))
        said = written.agg(F.count(F.lit(1)).alias("n"), F.min(why).alias("why"), F.sum((F.col("state") == "RETRYABLE_FAILED").cast("int")).alias("again")).first()
        done, paused = done + said["n"], said["why"]
        if paused or not said["again"] or limit is not None and done >= limit:
            break
    counts = {r["state"]: r["n"] for r in items(tables, run_id).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    still_open = any(counts.get(s) for s in ("PENDING", "LEASED", "RETRYABLE_FAILED"))
    if paused is None and still_open and limit is not None and done >= limit:
        paused = "invocation_limit_reached"
    return {"run_id": run_id, "status": "PAUSED" if paused or still_open else "COMPLETE", "paused_reason": paused or ("active_leases" if counts.get("LEASED") else None), "claimed": done, "items": counts}


def decide(vectors: DataFrame, records: DataFrame, references: DataFrame, similarities=openset.SIMILARITIES, margins=openset.MARGINS, top_k: int = 3, gates: openset.Gates = openset.STRICT) -> tuple[dict[str, Any], DataFrame | None]:
    """(report, decisions): thresholds calibrated on records (label, vector), then a decision for each of vectors (asset_id, vector).

    Without a pair of thresholds that passes the gates there are no decisions. Accepted
    identities still wait for review.
    """
    grid = openset.calibrate(records, references, similarities, margins, top_k)
    candidates = [r.asDict() for r in grid.orderBy("min_similarity", "min_margin").collect()]
    best = openset.recommend(grid, gates).collect()
    report = {"candidates": candidates, "recommended": best[0].asDict() if best else None, "status": "COMPLETE" if best else "FAILED"}
    if not best:
        return report, None
    said = openset.classify(vectors, references, openset.OpenSet(best[0]["min_similarity"], best[0]["min_margin"], top_k))
    state = F.when(F.col("state") == "accepted", "ACCEPTED").otherwise("UNKNOWN")
    reasons = F.array(F.when(F.col("state") == "accepted", "status_policy_not_calibrated").otherwise("identity_unknown"))
    return report, said.select("asset_id", state.alias("decision_state"), F.lit(PENDING_STATE).alias("proposed_bucket"), F.col("predicted").alias("identity"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("confidence"), reasons.alias("reasons"))
