"""Versioned runs as pure DataFrame functions.

State is an append-only log of events; the current row of an item is its last event. Claims,
transitions and switches take the current rows and the moment, and return the events to
append. Only the driver appends, so a lost executor only repeats pure work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.functions.paths import casefold
from stacklight.operators.assets import latest
from stacklight.sources.files import hashed, looked_at

ITEM_STATES = ("PENDING", "LEASED", "RETRYABLE_FAILED", "COMPLETE", "SOURCE_CHANGED", "FAILED")
OCCURRENCE_STATES = ("FROZEN", "PROCESSED", "MISSING", "SOURCE_CHANGED", "ADDED_DEFERRED")
TERMINAL_OCCURRENCES = ("PROCESSED", "MISSING", "SOURCE_CHANGED", "ADDED_DEFERRED")
CLAIMABLE = ("PENDING", "RETRYABLE_FAILED")
MOST_ATTEMPTS = 3


def current(events: DataFrame, key: str | list[str] = "asset_id", order: str = "event_seq") -> DataFrame:
    return latest(events, key, order)


def recover_leases(items: DataFrame, now: Column) -> DataFrame:
    """Items whose lease has run out are pending again."""
    expired = (F.col("state") == "LEASED") & (F.col("lease_expires_at") <= now)
    return items.withColumns({"state": F.when(expired, "PENDING").otherwise(F.col("state")), "lease_expires_at": F.when(~expired, F.col("lease_expires_at"))})


def claim(items: DataFrame, limit: int, lease_seconds: int, now: Column, worker: str, token: str) -> DataFrame:
    """The next claimable items by asset_id, leased: attempts up by one, one token for the batch. A top-k: no total sort."""
    if limit < 1 or lease_seconds < 1:
        raise ValueError("limit and lease must be positive")
    free = recover_leases(items, now).where(F.col("state").isin(*CLAIMABLE)).orderBy("asset_id").limit(limit)
    lease = now + F.make_interval(secs=F.lit(lease_seconds))
    return free.withColumns({"state": F.lit("LEASED"), "attempts": F.col("attempts") + 1, "lease_owner": F.lit(worker), "lease_token": F.lit(token), "lease_expires_at": lease})


def transition(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes (asset_id, lease_token, state) of items leased under that token; every other outcome is stale and comes back as accepted = false."""
    own = items.select("asset_id", F.col("state").alias("held"), F.col("lease_token").alias("held_token"))
    accepted = (F.col("held") == "LEASED") & F.col("held_token").eqNullSafe(F.col("lease_token"))
    return outcomes.join(own, "asset_id", "left").withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("held", "held_token")


def ended(items: DataFrame, outcomes: DataFrame, payloads: tuple[str, ...] = ("features", "evidence", "embedding")) -> DataFrame:
    """items after outcomes (asset_id, lease_token, state, error and payloads): an item leased under the token takes the state and loses its lease; what an outcome doesn't bring is emptied, so a failure keeps no payload. Stale outcomes change nothing."""
    brought = [c for c in (*payloads, "error") if c in outcomes.columns]
    said = transition(items, outcomes).where("accepted").select("asset_id", F.struct("state", *brought).alias("__said"))
    own = items.join(said, "asset_id", "left")
    hit = F.col("__said").isNotNull()
    new = {c: F.when(hit, F.col(f"__said.{c}") if c in brought else F.lit(None)).otherwise(F.col(c)) for c in (*payloads, "error") if c in items.columns}
    lease = {c: F.when(~hit, F.col(c)) for c in ("lease_owner", "lease_token", "lease_expires_at") if c in items.columns}
    return own.withColumns({"state": F.when(hit, F.col("__said.state")).otherwise(F.col("state"))} | new | lease).drop("__said")


def cascaded(occ: DataFrame, outcomes: DataFrame) -> DataFrame:
    """occ after accepted outcomes (asset_id, state): the frozen paths of a finished asset are processed, those of a changed one are changed; a retry or a failure leaves them frozen."""
    said = outcomes.where(F.col("state").isin("COMPLETE", "SOURCE_CHANGED")).select("asset_id", F.when(F.col("state") == "COMPLETE", "PROCESSED").otherwise("SOURCE_CHANGED").alias("__to")).distinct()
    own = occ.join(said, "asset_id", "left")
    return own.withColumn("occurrence_state", F.when((F.col("occurrence_state") == "FROZEN") & F.col("__to").isNotNull(), F.col("__to")).otherwise(F.col("occurrence_state"))).drop("__to")


def marked(occ: DataFrame, marks: DataFrame) -> DataFrame:
    """occ with path-level outcomes (source_path, mark) of the kinds MISSING, SOURCE_CHANGED and ADDED_DEFERRED; any other kind and an unknown path are errors."""
    bad = F.raise_error(F.concat(F.lit("not a path-level outcome: "), F.coalesce("mark", F.lit("null"))))
    said = marks.select("source_path", F.when(F.col("mark").isin("MISSING", "SOURCE_CHANGED", "ADDED_DEFERRED"), F.col("mark")).otherwise(bad).alias("__mark"))
    both = occ.withColumn("__known", F.lit(True)).join(said, "source_path", "full")
    known = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown occurrence: "), "source_path"))).otherwise(F.coalesce("__mark", "occurrence_state"))
    return both.withColumn("occurrence_state", known).drop("__known", "__mark")


def retry_state(kind: Column, attempts: Column, most: int = MOST_ATTEMPTS) -> Column:
    """The state after an outcome: input and output errors retry until `most` attempts; bad images and unknown errors end; provider, memory and start-up trouble retries."""
    return (
        F.when(kind == "COMPLETE", "COMPLETE")
        .when(kind == "SOURCE_CHANGED", "SOURCE_CHANGED")
        .when((kind == "IO_RETRYABLE") & (attempts < most), "RETRYABLE_FAILED")
        .when(kind.isin("OOM", "CUDA_PROVIDER_LOST", "ADAPTER_INIT_FAILED"), "RETRYABLE_FAILED")
        .otherwise("FAILED")
    )


def error_kind(message: Column) -> Column:
    """What an error's text says of its cause: OOM, CUDA_PROVIDER_LOST or null."""
    text = F.lower(message)
    lost = text.contains("cudaexecutionprovider") | text.contains("cuda") & text.contains("provider")
    return F.when(text.contains("out of memory") | text.contains("cuda_error_out_of_memory"), "OOM").when(lost, "CUDA_PROVIDER_LOST")


def occurrences_of(occ: DataFrame, asset_ids: DataFrame) -> DataFrame:
    """The paths of some assets (asset_id), in order of asset and path."""
    return occ.join(asset_ids.select("asset_id").distinct(), "asset_id", "left_semi").orderBy("asset_id", "source_path")


def pause_reason(kind: Column, ooms: Column) -> Column:
    return F.when(kind == "CUDA_PROVIDER_LOST", "cuda_provider_unavailable").when(kind == "ADAPTER_INIT_FAILED", "adapter_initialization_failed").when((kind == "OOM") & (ooms >= 2), "gpu_oom_after_single_worker_retry")


def switch_duplicates(changed: DataFrame, occ: DataFrame) -> DataFrame:
    """For assets whose current path changed (asset_id, source_path): the next frozen path and RETRYABLE_FAILED, or no path and SOURCE_CHANGED."""
    frozen = occ.where(F.col("occurrence_state") == "FROZEN").select("asset_id", F.col("source_path").alias("other"))
    other = changed.select("asset_id", "source_path").join(frozen, "asset_id", "left").where(F.col("other").isNull() | (F.col("other") != F.col("source_path")))
    best = other.groupBy("asset_id").agg(F.min("other").alias("next_path"))
    return changed.select("asset_id").distinct().join(best, "asset_id", "left").withColumn("state", F.when(F.col("next_path").isNull(), "SOURCE_CHANGED").otherwise("RETRYABLE_FAILED"))


def run_status(items: DataFrame, key: str = "run_id", state: str = "state") -> DataFrame:
    """run_id, n, states map: counts by state."""
    counts = items.groupBy(key, state).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(state, "n")))).alias("states"))


def run_counts(items: DataFrame, occ: DataFrame) -> DataFrame:
    """run_id, kind (item or occurrence), state, n: what a run's status reports."""
    of = lambda rows, state, kind: rows.groupBy("run_id", F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n")).select("run_id", F.lit(kind).alias("kind"), "state", "n")
    return of(items, "state", "item").union(of(occ, "occurrence_state", "occurrence"))


def create_counts(frozen: DataFrame, deferred: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """state, n: what creating a run reports: statuses of frozen (status) and deferred paths, and those of `prior` (occurrence_state), which an earlier attempt left, as resumed too."""
    new = frozen.select(F.upper("status").alias("state")).union(deferred.select(F.upper("status")))
    if prior is not None:
        new = new.union(prior.select("occurrence_state")).union(prior.select(F.lit("RESUMED")))
    return new.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def violations(items: DataFrame, occ: DataFrame) -> DataFrame:
    """kind, n for each broken rule: repeated keys, occurrences without their asset, unknown states."""
    repeated = items.groupBy("asset_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_asset").alias("kind"), "n")
    paths = occ.groupBy("source_path").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_path").alias("kind"), "n")
    orphans = occ.where("asset_id is not null").join(items.select("asset_id"), "asset_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan_occurrence").alias("kind"), "n")
    states = items.where(~F.col("state").isin(*ITEM_STATES)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_state").alias("kind"), "n")
    return repeated.union(paths).union(orphans).union(states)


def _by_rules(rules: list[tuple[Column, str, str | None]], otherwise: Column) -> Column:
    """struct(status, reason) of the first rule that holds."""
    out = otherwise
    for test, state, why in reversed(rules):
        out = F.when(test, F.struct(F.lit(state).alias("status"), F.lit(why).cast("string").alias("reason"))).otherwise(out)
    return out


def before_reading(cutoff: Column, now: Column, stable_seconds: int, listed: Column) -> Column:
    """struct(status, reason) that a stat alone (modified, regular) decides, else null: only what is null is worth reading."""
    if stable_seconds < 0:
        raise ValueError("stable_seconds must not be negative")
    recent = F.col("modified") > now - F.make_interval(secs=F.lit(stable_seconds))
    rules = [
        (~listed, "missing", "missing_or_unreadable"),
        (~F.coalesce("regular", F.lit(False)), "missing", "not_a_regular_file"),
        (F.col("modified") > cutoff, "added_deferred", "modified_after_cutoff"),
        (recent, "source_changed", "not_stable_for_required_interval"),
    ]
    return _by_rules(rules, F.lit(None).cast("struct<status:string,reason:string>"))


def after_reading() -> Column:
    """struct(status, reason) by digests (sha256, steady, baseline_sha256)."""
    rules = [
        (~F.coalesce("steady", F.lit(True)) | F.col("sha256").isNull(), "source_changed", "changed_while_hashing"),
        (F.col("baseline_sha256") != F.col("sha256"), "source_changed", "baseline_sha256_mismatch"),
        (F.col("baseline_sha256").isNull(), "baseline_identity_unverifiable", None),
    ]
    return _by_rules(rules, F.struct(F.lit("processed").alias("status"), F.lit(None).cast("string").alias("reason")))


def _frozen(rows: DataFrame, early: Column) -> DataFrame:
    out = rows.withColumn("__state", F.coalesce(early, after_reading())).withColumns({"status": F.col("__state.status"), "reason": F.col("__state.reason")})
    return out.withColumn("asset_id", F.when(F.col("status").isin("processed", "baseline_identity_unverifiable"), F.col("sha256"))).drop("__state")


def freeze(baseline: DataFrame, files: DataFrame, cutoff: Column, now: Column, stable_seconds: int = 120) -> DataFrame:
    """baseline (source_path, baseline_sha256) with status and reason, from the listing files (source_path, size, modified, sha256, regular, steady).

    The rules apply in order: not a regular file, later than the cutoff, not stable long
    enough, changed while it was read, another digest, no digest to compare with.
    """
    both = baseline.join(files.withColumn("__listed", F.lit(True)), "source_path", "left")
    return _frozen(both, before_reading(cutoff, now, stable_seconds, F.col("__listed").isNotNull())).drop("__listed")


def freeze_files(baseline: DataFrame, cutoff: Column, now: Column, stable_seconds: int = 120) -> DataFrame:
    """freeze() of files on a shared mount, in two stages and without a join: stats decide first, and only what they leave open is read. A file that can't be read then has changed."""
    early = before_reading(cutoff, now, stable_seconds, F.lit(True))
    looked = looked_at(baseline).withColumn("__early", F.when(F.col("error").isNotNull(), F.struct(F.lit("missing").alias("status"), F.lit("missing_or_unreadable").alias("reason"))).otherwise(early))
    return _frozen(hashed(looked, F.col("__early").isNull()), F.col("__early")).drop("__early")


def added_deferred(found: DataFrame, baseline: DataFrame, excluded: Column) -> DataFrame:
    """Discovered paths outside the baseline, compared without case, each once; excluded ones don't count."""
    known = baseline.select(casefold("source_path").alias("key")).distinct()
    new = found.where(~excluded).select("source_path", casefold("source_path").alias("key")).distinct()
    return new.join(known, "key", "left_anti").select("source_path", F.lit("added_deferred").alias("status"), F.lit("not_in_baseline").alias("reason"))


def prune_statistics(items: DataFrame, *payloads: str) -> DataFrame:
    """rows, payload_chars of the items that still carry a payload."""
    size = sum((F.coalesce(F.length(p), F.lit(0)) for p in payloads), F.lit(0))
    return items.where(size > 0).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("payload_chars"))


def prune(items: DataFrame, *payloads: str, decision_runs: DataFrame | None = None) -> DataFrame:
    """items without payloads; refused while a run of decisions (status) isn't finished."""
    if decision_runs is not None and decision_runs.where(F.col("status") == "CREATED").limit(1).count():
        raise ValueError("a decision run is unfinished, so nothing is pruned")
    return items.withColumns({p: F.lit(None).cast(items.schema[p].dataType) for p in payloads})
