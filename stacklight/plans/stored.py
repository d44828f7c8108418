"""Runs kept as tables: created from a baseline, decided once for each decision, compared, pruned.

Tables of a RunTables root: runs (statistics), occurrences (by run_id), items (events, by run_id), decision_runs (events) and
decisions (by decision_id). What is written a second time replaces its own partition alone, so a
step that was interrupted is simply called again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import digests, paths
from stacklight.operators import decisions, diff, openset, runs
from stacklight.plans import outputs, reprocess
from stacklight.sources import baseline, files, walk
from stacklight.sources.shared import once
from stacklight.sources.tables import RunTables

#: Frozen statuses and the states that occurrences are kept in.
KEPT_AS = {"processed": "FROZEN", "baseline_identity_unverifiable": "FROZEN", "missing": "MISSING", "source_changed": "SOURCE_CHANGED", "added_deferred": "ADDED_DEFERRED"}
_OCCURRENCE = ("run_id", "source_path", "asset_id", "old_bucket", "audit_locked", "baseline_identity_unverifiable", "occurrence_state", "reason", "size", "mtime_ns", "sha256")
_PAYLOADS = ("features", "evidence", "embedding")


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows whose next action also counts, in the same job, how often each condition holds."""
    seen = Observation(name)
    return rows.observe(seen, *(F.count_if(c).alias(k) for k, c in counts.items())), seen


def occurrences(tables: RunTables, run_id: str) -> DataFrame:
    """The run's paths as they stand now: those of finished or changed assets follow their items."""
    own = tables.events("occurrences").where(F.col("run_id") == run_id)
    return runs.cascaded(own, reprocess.items(tables, run_id).select("asset_id", "state"))


def create(tables: RunTables, run_id: str, rows: DataFrame, cutoff: Column, now: Column, stable_seconds: int = 120, root: str | None = None) -> dict[str, Any]:
    """Freezes the baseline rows that the run doesn't have yet, adds what else lies below `root` as deferred, and starts items for the frozen assets: counts by state.

    A run that stopped half-way is created again: paths that it has stay as they are and count as resumed.
    """
    if repeated := baseline.repeated_paths(rows).limit(1).collect():
        raise ValueError(f"a baseline must list each path once: {repeated[0]['source_path']}")
    spark, resumed = tables.spark, 0
    known = spark.createDataFrame([], "source_path string")
    if not tables.missing("occurrences"):
        known = once(tables.events("occurrences").where(F.col("run_id") == run_id).select("source_path"))
        resumed = known.count()
    kept_as = F.create_map(*(F.lit(x) for pair in KEPT_AS.items() for x in pair))
    frozen = runs.freeze_files(rows.join(known, "source_path", "left_anti"), cutoff, now, stable_seconds)
    new = frozen.withColumns({"run_id": F.lit(run_id), "occurrence_state": F.coalesce(kept_as[F.col("status")], F.lit("SOURCE_CHANGED"))}).select(*_OCCURRENCE)
    if root is not None:
        every = rows.select("source_path").union(known)
        found = runs.added_deferred(walk.inventory(spark, root), every, paths.is_excluded("source_path"))
        late = {"run_id": F.lit(run_id), "audit_locked": F.lit(False), "baseline_identity_unverifiable": F.lit(True), "occurrence_state": F.lit("ADDED_DEFERRED")}
        late |= {c: F.lit(None).cast(new.schema[c].dataType) for c in _OCCURRENCE if c not in late and c not in found.columns}
        new = new.union(found.withColumns(late).select(*_OCCURRENCE))
    states = sorted({*KEPT_AS.values()})
    new, seen = observed(new, f"create-{run_id}", **{s: F.col("occurrence_state") == s for s in states})
    tables.append("occurrences", new, "run_id")
    own = tables.events("occurrences").where((F.col("run_id") == run_id) & (F.col("occurrence_state") == "FROZEN"))
    started = reprocess.start(tables, run_id, own.select("asset_id", "source_path"))
    out = {"run_id": run_id, "counts": {s.lower(): n for s, n in seen.get.items()}, "resumed": resumed, "assets": started}
    _keep_statistics(tables, run_id, out)
    return out


def _keep_statistics(tables: RunTables, run_id: str, said: Mapping[str, Any]) -> None:
    """Another entry of what was counted when a run was made or taken up again."""
    seq = 0 if tables.missing("runs") else tables.events("runs").where(F.col("run_id") == run_id).count()
    tables.append("runs", tables.spark.createDataFrame([(run_id, seq, json.dumps(said, sort_keys=True))], "run_id string, event_seq bigint, statistics string"))


def status(tables: RunTables, run_id: str) -> dict[str, Any]:
    """Counts of a run's items and paths by state, and the statistics of each time it was made or taken up."""
    counts: dict[str, dict[str, int]] = {"item": {}, "occurrence": {}}
    own = occurrences(tables, run_id)
    for r in runs.run_counts(reprocess.items(tables, run_id), own).collect():
        counts[r["kind"]][r["state"]] = r["n"]
    kept = [] if tables.missing("runs") else tables.events("runs").where(F.col("run_id") == run_id).orderBy("event_seq").collect()
    return {"run_id": run_id, "items": counts["item"], "occurrences": counts["occurrence"], "statistics": [json.loads(r["statistics"]) for r in kept]}


def scanned(spark: SparkSession, roots: str | Sequence[str], suffixes: Sequence[str] = paths.IMAGE_SUFFIXES, follow_symlinks: bool = False) -> DataFrame:
    """source_path, asset_id, size, mtime_ns, error of the files below the roots; a file that can't be read has an error and no digest."""
    found = walk.library(spark, roots, suffixes, follow_symlinks=follow_symlinks).withColumn("read", files.digests("source_path"))
    return found.select("source_path", F.col("read.sha256").alias("asset_id"), "size", "mtime_ns", F.col("read.error").alias("error"))


def take_up(tables: RunTables, run_id: str, found: DataFrame) -> int:
    """Adds what scanned() found, and the run doesn't have, as frozen paths with their items; the number of new assets."""
    new = found.where("asset_id is not null")
    if not tables.missing("occurrences"):
        new = new.join(tables.events("occurrences").where(F.col("run_id") == run_id).select("source_path"), "source_path", "left_anti")
    flags = {"run_id": F.lit(run_id), "old_bucket": F.lit(None).cast("string"), "audit_locked": F.lit(False), "baseline_identity_unverifiable": F.lit(True), "occurrence_state": F.lit("FROZEN"), "reason": F.lit(None).cast("string"), "sha256": F.col("asset_id")}
    tables.append("occurrences", new.withColumns(flags).select(*_OCCURRENCE), "run_id")
    return reprocess.start(tables, run_id, tables.events("occurrences").where((F.col("run_id") == run_id) & (F.col("occurrence_state") == "FROZEN")))


def process(tables: RunTables, run_id: str, roots: str | Sequence[str], factory: Callable[[], Any], key: str, limit: int | None = None) -> dict[str, Any]:
    """Works off a run's open items with an adapter. Contents and pixels of the run's frozen paths alone are joined; a file whose digest isn't its asset's any more has changed."""
    spark = tables.spark
    frozen = tables.events("occurrences").where((F.col("run_id") == run_id) & (F.col("occurrence_state") == "FROZEN")).select("source_path", "asset_id")
    contents = files.discover(spark, roots).select(files.local_path("path").alias("source_path"), "content")
    own = contents.join(frozen, "source_path").withColumn("expected_sha256", F.col("asset_id"))
    pixels = files.decoded(spark, roots).join(frozen.select("source_path"), "source_path", "left_semi")
    return reprocess.process(tables, run_id, files.with_pixels(own, pixels), factory, key, limit)


def fingerprint(rows: DataFrame) -> str:
    """A digest of rows in any order: their number and the sums of two hashes."""
    columns = sorted(rows.columns)
    hashed = rows.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)").alias("b"))
    said = hashed.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256(",".join(map(str, said)).encode()).hexdigest()


def _append_decision(tables: RunTables, asked: Mapping[str, str], status: str) -> None:
    seq = 0 if status == "CREATED" else 1
    row = tables.spark.createDataFrame([(*asked.values(), status, seq)], ", ".join(f"{k} string" for k in asked) + ", status string, event_seq bigint")
    tables.append("decision_runs", row)


def decide(tables: RunTables, run_id: str, decision_id: str, records: DataFrame, references: DataFrame, similarities: Sequence[float] = openset.SIMILARITIES, margins: Sequence[float] = openset.MARGINS, top_k: int = 3, gates: openset.Gates = openset.STRICT) -> dict[str, Any]:
    """Decides every analysed asset of a run under one decision_id, once: status, thresholds and number of decisions.

    The same call again finds the decision complete and writes nothing; after an interruption it
    replaces what was half written; with other inputs it is refused.
    """
    config = {"similarities": sorted(similarities), "margins": sorted(margins), "top_k": top_k, "gates": vars(gates)}
    asked = {"decision_id": decision_id, "run_id": run_id, "config_fingerprint": digests.config_fingerprint(config), "reference_fingerprint": fingerprint(references), "labels_fingerprint": fingerprint(records)}
    left = reprocess.items(tables, run_id).where(F.col("state").isin("PENDING", "LEASED", "RETRYABLE_FAILED")).limit(1).count()
    if left:
        raise ValueError(f"the run {run_id} has open items, so nothing is decided")
    outcome = "new"
    if not tables.missing("decision_runs"):
        known = tables.current("decision_runs", "decision_id")
        outcome = decisions.reuse(known, tables.spark.createDataFrame([tuple(asked.values())], list(asked))).first()["outcome"]
    if outcome == "refused":
        raise ValueError(f"the decision {decision_id} was made from other inputs, or failed")
    if outcome != "complete":
        if outcome == "new":
            _append_decision(tables, asked, "CREATED")
        items = reprocess.items(tables, run_id).where("state = 'COMPLETE' and embedding is not null")
        report, said = reprocess.decide(items.select("asset_id", F.col("embedding").alias("vector")), records, references, similarities, margins, top_k, gates)
        if said is None:
            _append_decision(tables, asked, "FAILED")
            return report | {"decision_id": decision_id, "decisions": 0}
        tables.replace("decisions", said.withColumn("decision_id", F.lit(decision_id)), "decision_id")
        _append_decision(tables, asked, "COMPLETE")
    n = tables.events("decisions").where(F.col("decision_id") == decision_id).count()
    return {"decision_id": decision_id, "status": "COMPLETE", "resumed": outcome != "new", "decisions": n}


def diff_report(tables: RunTables, run_id: str, decision_id: str, out: str, limit: int = 500, seed: str = "review-v1") -> dict[str, Any]:
    """Diff rows of a run under a decision, with their report files in `out`; the decision must be complete and of that run."""
    state = None if tables.missing("decision_runs") else tables.current("decision_runs", "decision_id").where((F.col("decision_id") == decision_id) & (F.col("run_id") == run_id)).first()
    if state is None or state["status"] != "COMPLETE":
        raise ValueError(f"{decision_id} is no complete decision of {run_id}")
    said = tables.events("decisions").where(F.col("decision_id") == decision_id).drop("decision_id")
    rows = once(diff.run_diff(occurrences(tables, run_id), reprocess.items(tables, run_id), said))
    return outputs.run_report(rows, out, limit, seed)


def prune(tables: RunTables, run_id: str, dry_run: bool = False) -> dict[str, Any]:
    """Empties the payloads of a run's items, by a rewrite of its partition alone; refused while a decision of the run is open. A dry run only counts."""
    own = tables.events("items").where(F.col("run_id") == run_id)
    size = sum((F.coalesce(F.size(c) * 8 if c == "embedding" else F.octet_length(c), F.lit(0)) for c in _PAYLOADS), F.lit(0))
    full = own.where(" or ".join(f"{c} is not null" for c in _PAYLOADS)).agg(F.count_distinct("asset_id").alias("items"), F.coalesce(F.sum(F.greatest(size, F.lit(0)).cast("bigint")), F.lit(0)).alias("bytes")).first()
    if not dry_run:
        made = None if tables.missing("decision_runs") else tables.current("decision_runs", "decision_id").where(F.col("run_id") == run_id)
        tables.replace("items", runs.prune(own, *_PAYLOADS, decision_runs=made), "run_id")
    return {"run_id": run_id, "items": full["items"], "derived_bytes": full["bytes"], "dry_run": dry_run}

