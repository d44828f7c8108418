"""The only code that changes a source: executing a move plan, file by file, when told to.

``run`` keeps a journal: outcomes are appended to the table of moves, and only rows whose last
outcome is PLANNED or FAILED are taken up, so that calls with a limit work through a plan.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.operators.moves import outcome
from stacklight.sources.tables import RunTables

#: What names a move in the journal: a new file at an old path is a new move.
KEY = ["source_path", "destination_path", "sha256"]

_LOOKED = "source_path string, destination_path string, sha256 string, source_size bigint, mtime_ns bigint, source_sha string, source_same boolean, destination_exists boolean, destination_sha string"


def _digest(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return None


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            same = None
            if os.path.isfile(r.source_path) and not os.path.islink(r.source_path):
                info = os.stat(r.source_path)
                same = info.st_size == r.source_size and info.st_mtime_ns == r.mtime_ns
            rows.append((*r, _digest(r.source_path) if same is not None else None, same, os.path.exists(r.destination_path), _digest(r.destination_path)))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in _LOOKED.split(", ")])


def examined(plan: DataFrame) -> DataFrame:
    """plan (source_path, destination_path, sha256, source_size, mtime_ns) with state and reason of what a move would find now, on a mount that all workers share."""
    looked = plan.select("source_path", "destination_path", "sha256", "source_size", "mtime_ns").mapInPandas(_look, _LOOKED)
    return looked.withColumn("o", outcome(F.col("source_sha"), F.col("source_same"), F.col("destination_exists"), F.col("destination_sha"), F.col("sha256"))).select("source_path", "destination_path", "sha256", "o.*")


def _rename(source: str, destination: str, sha256: str) -> tuple[str, str | None]:
    try:
        os.makedirs(os.path.dirname(destination), exist_ok=True)
        if os.path.lexists(destination):
            return "COLLISION", "destination_exists_with_different_content"
        os.rename(source, destination)
        return ("MOVED", None) if _digest(destination) == sha256 else ("FAILED", "post_rename_hash_mismatch")
    except OSError as e:
        return "FAILED", type(e).__name__


def _renamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(*r[:3], *(_rename(*r[:3]) if r.state == "PLANNED" else r[3:])) for r in batch.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=batch.columns)


def run(plan: DataFrame, tables: RunTables, limit: int | None = None, execute: bool = False) -> DataFrame:
    """state, n: outcomes of the moves whose last outcome is PLANNED or FAILED, the first `limit` of them by path, or all.

    Spark tasks examine and rename. With execute=True each outcome is an event of the table
    `moves`; a task that runs again finds its renames done. Otherwise nothing is renamed or kept.
    """
    seq, left = 1, plan
    if not tables.missing("moves"):
        seq = tables.events("moves").agg(F.max("event_seq")).first()[0] + 1
        left = plan.join(tables.current("moves", KEY).where(~F.col("state").isin("PLANNED", "FAILED")).select(KEY), KEY, "left_anti")
    if limit is not None:
        left = left.orderBy("source_path").limit(limit)
    found = examined(left.repartition("source_path"))
    if execute:
        done = found.select(*KEY, "state", "reason").mapInPandas(_renamed, "source_path string, destination_path string, sha256 string, state string, reason string")
        tables.append("moves", done.withColumn("event_seq", F.lit(seq).cast("bigint")))
        found = tables.events("moves").where(F.col("event_seq") == seq)
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("n"))

