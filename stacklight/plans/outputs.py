"""Report files: small JSON written atomically by the driver, and tables as one CSV with nested cells in JSON."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacklight.functions import paths
from stacklight.operators import diff
from stacklight.sources import one_csv

#: Values of a column whose counts a summary lists; more are written as a table beside it.
MOST_COUNTS = 10_000


def write_json(value: Any, path: str) -> None:
    """Sorted keys, two spaces, a newline at the end; the file appears whole or not at all."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def flat(rows: DataFrame) -> DataFrame:
    """Columns in name order, nested ones as JSON text: what a CSV can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return rows.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)))


def write_csv(rows: DataFrame, path: str) -> None:
    """One UTF-8 file with a byte-order mark, in the order of rows; it appears whole or not at all."""
    one_csv.save(flat(rows), path)


def run_report(rows: DataFrame, out: str, limit: int = 500, seed: str = "review-v1") -> dict[str, Any]:
    """Writes out/diff.csv, out/review-queue.json (at most `limit` rows) and out/summary.json; returns the summary."""
    os.makedirs(out, exist_ok=True)
    summary = diff.summary(rows).first().asDict()
    for kind, column in (("by_status", "status"), ("by_effective_bucket", "effective_bucket")):
        counts = diff.counts_by(rows, column)
        found = counts.orderBy(column).limit(MOST_COUNTS + 1).collect()
        if len(found) > MOST_COUNTS:  # too many for a summary: whole, as a table
            write_csv(counts.orderBy(column), os.path.join(out, f"{kind}.csv"))
            summary[kind] = {"table": f"{kind}.csv"}
        else:
            summary[kind] = {r[0]: r[1] for r in found}
    queue = diff.review_queue(rows, limit, seed)
    own = rows.select("occurrence_id", "source_path", "status", "proposed_bucket", "identity", "confidence", "review_reasons")
    chosen = own.join(F.broadcast(queue), "occurrence_id").orderBy("review_id")  # the queue has at most `limit` rows
    write_csv(paths.in_order(rows), os.path.join(out, "diff.csv"))
    write_json([r.asDict(recursive=True) for r in chosen.collect()], os.path.join(out, "review-queue.json"))
    write_json(summary, os.path.join(out, "summary.json"))
    return summary
