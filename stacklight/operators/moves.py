"""Move plans: destinations, collisions, readiness and the decision what a rename would do. Planning never touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.functions import paths
from stacklight.operators.assets import latest
from stacklight.operators.runs import TERMINAL_OCCURRENCES

STATES = ("PLANNED", "MOVED", "SOURCE_CHANGED", "COLLISION", "FAILED", "MISSING")


def planned(rows: DataFrame, root: str, target: str) -> DataFrame:
    """rows (source_path, entity, subject, engine, old_bucket, sha256, mtime_ns) with destination_path and target_state; names that clash get a digest, the first by `place` (or by path) keeping its own; a clash that stays and paths outside root are errors."""
    outside = paths.relative("source_path", root).isNull()
    checked = rows.withColumn("source_path", F.when(outside, F.raise_error(F.lit("a path lies outside the authorized root"))).otherwise(F.col("source_path"))) if not rows.isStreaming else rows
    own = checked.where(~paths.is_excluded("source_path"))
    own = own.withColumn("__c", paths.nested_context("source_path", root, "entity", "subject", "engine"))
    own = own.withColumn("__d", paths.destination("source_path", root, target, F.col("__c.entity"), F.col("__c.subject"), F.col("__c.engine"), paths.is_posted("old_bucket"), "mtime_ns"))
    own = own.withColumns({"destination_path": F.col("__d.path"), "target_state": F.col("__d.state")}).drop("__c", "__d")
    return unresolved(renamed(own, "place" if "place" in own.columns else "source_path"))


def selected(rows: DataFrame, root: str, directories: DataFrame | None = None, existing: DataFrame | None = None, processed: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """The rows (source_path, place, ...) of a baseline that a plan takes up, each path once, the first by `place`; paths compare without case.

    Left out are excluded paths, directories that aren't in `directories` (directory), sources
    that the journal `existing` (source_path) has, images that `processed` (source_path) lacks,
    and paths whose listed source_size or mtime_ns differ from the known snapshot (source_path,
    size, mtime_ns, sha256), whose digest the others get. A path outside root is an error.
    """
    outside = paths.relative("source_path", root).isNull()
    own = rows.where(~paths.is_excluded("source_path"))
    own = own.withColumn("source_path", F.when(outside, F.raise_error(F.lit("a path lies outside the authorized root"))).otherwise(F.col("source_path")))
    own = own.withColumn("__key", paths.casefold("source_path"))
    keyed = lambda other, *more: other.select(paths.casefold("source_path").alias("__key"), *more)
    if directories is not None:
        own = own.withColumn("directory", paths.source_directory("source_path", root)).join(directories.select("directory").distinct(), "directory", "left_semi").drop("directory")
    if existing is not None:
        own = own.join(keyed(existing), "__key", "left_anti")
    if processed is not None:
        own = own.join(keyed(processed, F.lit(True).alias("__done")).distinct(), "__key", "left").where(F.col("__done") | ~paths.is_image("source_path")).drop("__done")
    if snapshots is not None:
        known = keyed(snapshots, F.struct("size", "mtime_ns", F.col("sha256").alias("sha")).alias("__known")).groupBy("__key").agg(F.max("__known").alias("__known"))
        same = (F.col("__known.size") == F.col("source_size")) & (F.col("__known.mtime_ns") == F.col("mtime_ns"))
        own = own.join(known, "__key", "left").where(F.col("__known").isNull() | same).withColumn("sha256", F.coalesce("__known.sha", "sha256")).drop("__known")
    first = F.row_number().over(Window.partitionBy("__key").orderBy("place"))
    return own.withColumn("__n", first).where("__n = 1").drop("__n", "__key")


def appended(plan: DataFrame, journal: DataFrame) -> DataFrame:
    """The moves of plan that the journal doesn't have yet, by source; a destination that the journal gives to another source is an error."""
    held = journal.select("destination_path", F.col("source_path").alias("__holder")).distinct()
    own = plan.join(held, "destination_path", "left").withColumn("source_path", F.when(F.col("__holder").isNotNull() & (F.col("__holder") != F.col("source_path")), F.raise_error(F.concat(F.lit("destination collision: "), "destination_path"))).otherwise(F.col("source_path"))).drop("__holder")
    return own.join(journal.select("source_path").distinct(), "source_path", "left_anti")


def unresolved(plan: DataFrame) -> DataFrame:
    """plan, which fails where two sources still have one destination."""
    n = F.count(F.lit(1)).over(Window.partitionBy(paths.casefold("destination_path")))
    return plan.withColumn("__n", n).withColumn("destination_path", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("unresolvable target collision: "), "destination_path"))).otherwise(F.col("destination_path"))).drop("__n")


def renamed(plan: DataFrame, order: str = "source_path") -> DataFrame:
    """The first source of a destination by `order` keeps the name; later ones get the first 12 digits of their digest before the suffix."""
    nth = F.row_number().over(Window.partitionBy(paths.casefold("destination_path")).orderBy(order))
    folder = F.regexp_extract("destination_path", r"^(.*/)?[^/]*$", 1)
    other = F.concat(folder, paths.stem("destination_path"), F.lit("__"), F.substring("sha256", 1, 12), paths.suffix("destination_path"))
    return plan.withColumn("__n", nth).withColumn("destination_path", F.when(F.col("__n") == 1, F.col("destination_path")).otherwise(other)).drop("__n")


def clashes(plan: DataFrame) -> DataFrame:
    """Destinations that more than one source still has; a plan with any must not run."""
    return plan.groupBy(paths.casefold("destination_path").alias("destination")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def open_moves(journal: DataFrame, limit: int | None = None) -> DataFrame:
    """The last row of each move in a journal (source_path, state, event_seq, ...) that is PLANNED or FAILED, the first `limit` by path, or all."""
    left = latest(journal, "source_path", "event_seq").where(F.col("state").isin("PLANNED", "FAILED"))
    return left if limit is None else left.orderBy("source_path").limit(limit)


def state_counts(journal: DataFrame) -> DataFrame:
    """state, n of a journal's moves."""
    return latest(journal, "source_path", "event_seq").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def ready_directories(occ: DataFrame, directory: Column) -> DataFrame:
    """Directories in which every occurrence is settled."""
    settled = F.coalesce(F.col("occurrence_state").isin(*TERMINAL_OCCURRENCES), F.lit(False))
    return occ.groupBy(directory.alias("directory")).agg(F.bool_and(settled).alias("ready"), F.count(F.lit(1)).alias("n")).where("ready").select("directory", "n")


def outcome(source_sha: Column, source_same: Column, destination_exists: Column, destination_sha: Column, expected: Column) -> Column:
    """What executing a planned move would find: struct(state, reason); PLANNED means that it may be renamed. Absent files have null digests."""
    there, here = F.coalesce(destination_sha == expected, F.lit(False)), source_sha.isNotNull()
    same = F.coalesce(source_same & (source_sha == expected), F.lit(False))
    result = lambda state, why=None: F.struct(F.lit(state).alias("state"), F.lit(why).cast("string").alias("reason"))
    return (
        F.when(there & ~here, result("MOVED"))
        .when(there & (source_sha == expected), result("COLLISION", "both_source_and_destination_exist"))
        .when(~here, result("MISSING", "source_missing"))
        .when(~same, result("SOURCE_CHANGED", "source_identity_changed"))
        .when(F.coalesce(destination_exists, F.lit(False)), result("COLLISION", "destination_exists_with_different_content"))
        .otherwise(result("PLANNED"))
    )
