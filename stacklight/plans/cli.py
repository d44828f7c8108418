"""Command line: python -m stacklight.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import paths
from stacklight.operators import assets, inference, moves, openset, runs
from stacklight.plans import apply, outputs, stored
from stacklight.sources import baseline, files, vectors
from stacklight.sources.shared import once
from stacklight.sources.tables import RunTables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stacklight")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor", help="which optional dependencies are there")
    c = sub.add_parser("scan", help="fingerprint a library and report its counts")
    c.add_argument("root", nargs="+")
    c.add_argument("--out")
    c.add_argument("--extension", nargs="+", default=list(paths.IMAGE_SUFFIXES))
    c.add_argument("--follow-symlinks", action="store_true")
    c = sub.add_parser("verify-source", help="fingerprints of a library")
    c.add_argument("root")
    c.add_argument("--out")
    c = sub.add_parser("status", help="counts by state of a table of item events, or of a stored run")
    c.add_argument("events", nargs="?")
    c.add_argument("--tables")
    c.add_argument("--run")
    extract = sub.add_parser("extract", help="scan folders into a run and analyse what is new")
    work = sub.add_parser("process", help="analyse the open items of a run")
    for own in (extract, work):
        own.add_argument("root", nargs="+")
        own.add_argument("--adapter", help="module:factory")
        own.add_argument("--tagger", help="ONNX model, with --tags, in place of an adapter")
        own.add_argument("--tags", help="CSV with a column `name`")
        own.add_argument("--detector")
        own.add_argument("--provider", nargs="+", default=["CPUExecutionProvider"])
        own.add_argument("--dimensions", type=int, default=1024)
        own.add_argument("--limit", type=int)
    c = sub.add_parser("classify", help="open-set decision of one vector")
    for a in ("vector", "references"):
        c.add_argument(f"--{a}", required=True)
    c = sub.add_parser("calibrate", help="metrics of a threshold grid and a recommendation")
    for a in ("labelled", "references"):
        c.add_argument(f"--{a}", required=True)
    c.add_argument("--similarity", type=float, nargs="+", default=list(openset.SIMILARITIES))
    c.add_argument("--margin", type=float, nargs="+", default=list(openset.MARGINS))
    c.add_argument("--strict", action="store_true")
    c = sub.add_parser("freeze", help="states of a baseline's paths")
    c.add_argument("baseline")
    c.add_argument("--cutoff", required=True)
    c.add_argument("--stable-seconds", type=int, default=120)
    c.add_argument("--out", required=True)
    c = sub.add_parser("create", help="a run from a baseline: frozen paths, deferred ones below a root, items")
    c.add_argument("baseline")
    c.add_argument("--cutoff", required=True)
    c.add_argument("--stable-seconds", type=int, default=120)
    c.add_argument("--root")
    decide = sub.add_parser("decide", help="decisions of a run's analysed assets, kept under one id")
    for a in ("labelled", "references"):
        decide.add_argument(f"--{a}", required=True)
    decide.add_argument("--similarity", type=float, nargs="+", default=list(openset.SIMILARITIES))
    decide.add_argument("--margin", type=float, nargs="+", default=list(openset.MARGINS))
    decide.add_argument("--top-k", type=int, default=3)
    compare = sub.add_parser("diff", help="report of a run under a decision")
    compare.add_argument("--out", required=True)
    compare.add_argument("--review-limit", type=int, default=500)
    compare.add_argument("--seed", default="review-v1")
    away = sub.add_parser("prune", help="empty the payloads of a run's items")
    away.add_argument("--dry-run", action="store_true")
    for own in (c, decide, compare, away, extract, work):
        own.add_argument("--tables", required=True, help="folder of the run tables")
        own.add_argument("--run", required=True)
    for own in (decide, compare):
        own.add_argument("--decision", required=True)
    c = sub.add_parser("report", help="summary, differences and review queue of diff rows")
    c.add_argument("rows")
    c.add_argument("--out", required=True)
    c.add_argument("--review-limit", type=int, default=500)
    c.add_argument("--seed", default="review-v1")
    c = sub.add_parser("migrate", help="plan moves; rename only with --execute")
    c.add_argument("action", choices=("create", "sync", "status", "apply"))
    c.add_argument("--plan", required=True)
    c.add_argument("--baseline")
    c.add_argument("--root")
    c.add_argument("--target")
    c.add_argument("--features", help="a feature run's paths: only its ready directories and processed images are planned")
    c.add_argument("--directory", nargs="+", help="only these directories below the root")
    c.add_argument("--journal", help="folder of the run tables that keep outcomes; beside the plan by default")
    c.add_argument("--limit", type=int)
    c.add_argument("--execute", action="store_true")
    return p


def _moves(args: argparse.Namespace, spark: SparkSession, known: DataFrame | None) -> DataFrame:
    """The plan of a baseline's rows that a journal doesn't have: chosen by path first, so that nothing else is looked at."""
    rows = baseline.normalised(baseline.read_csv(spark, args.baseline), images_only=False).withColumn("place", F.monotonically_increasing_id())
    directories = done = snapshots = None
    if args.features:
        occ = spark.read.parquet(args.features)
        directories = moves.ready_directories(occ, paths.source_directory("source_path", args.root))
        done = occ.where(F.col("occurrence_state") == "PROCESSED")
        snapshots = done.where("size is not null and mtime_ns is not null and sha256 is not null")
    if args.directory:
        asked = spark.createDataFrame([(d,) for d in args.directory], "directory string")
        directories = asked if directories is None else directories.join(asked, "directory", "left_semi")
    own = moves.selected(rows, args.root, directories, known, done)
    facts = files.listing(own).where("regular").select("source_path", "sha256", F.col("size").alias("source_size"), "mtime_ns")
    own = own.withColumn("engine", F.col("source_engine")).drop("source_size").join(facts, "source_path")
    return moves.planned(moves.selected(own, args.root, snapshots=snapshots), args.root, args.target)


def _factory(args: argparse.Namespace) -> tuple[Callable[[], Any], str]:
    """What makes the adapter in each worker, and a key that names it."""
    if bool(args.adapter) == bool(args.tagger) or bool(args.tagger) != bool(args.tags):
        raise ValueError("name either an adapter (module:factory) or a tagger with its tags")
    if args.adapter:
        return partial(inference.load_adapter, args.adapter), args.adapter
    made = partial(inference.OnnxAdapter.from_paths, args.tagger, args.tags, args.detector, providers=tuple(args.provider), dimensions=args.dimensions)
    return made, json.dumps([args.tagger, args.tags, args.detector, args.provider, args.dimensions])


def run(args: argparse.Namespace, spark: SparkSession) -> Any:
    if args.command == "scan":
        found = once(stored.scanned(spark, args.root, args.extension, args.follow_symlinks))
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        return assets.scan_counts(found, failed=F.col("error").isNotNull()).first().asDict()
    if args.command == "verify-source":
        found = files.snapshots(files.discover(spark, args.root))
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        return assets.inventory(found).first().asDict()
    if args.command == "status" and args.tables:
        return stored.status(RunTables(spark, args.tables), args.run)
    if args.command == "status":
        items = runs.current(spark.read.parquet(args.events))
        return {r["state"]: r["n"] for r in items.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if args.command == "classify":
        out = openset.classify(vectors.read_vector(spark, args.vector), vectors.read_references(spark, args.references))
        return out.drop("vector").first().asDict(recursive=True)
    if args.command == "calibrate":
        rows = openset.calibrate(vectors.read_labelled(spark, args.labelled), vectors.read_references(spark, args.references), args.similarity, args.margin)
        best = openset.recommend(rows, openset.STRICT if args.strict else openset.Gates()).collect()
        return {"recommended": best[0].asDict() if best else None, "candidates": [r.asDict() for r in rows.orderBy("min_similarity", "min_margin").collect()]}
    if args.command == "freeze":
        rows = baseline.normalised(baseline.read_csv(spark, args.baseline))
        if repeated := baseline.repeated_paths(rows).limit(5).collect():
            raise ValueError(f"a baseline must list each path once: {repeated[0]['source_path']}")
        frozen = runs.freeze_files(rows, F.to_timestamp(F.lit(args.cutoff)), F.current_timestamp(), args.stable_seconds)
        frozen, seen = stored.observed(frozen, "freeze", **{s: F.col("status") == s for s in stored.KEPT_AS})
        frozen.write.mode("overwrite").parquet(args.out)
        return {s: n for s, n in seen.get.items() if n}
    if args.command in ("create", "extract", "process", "decide", "diff", "prune"):
        tables = RunTables(spark, args.tables)
        if args.command in ("extract", "process"):
            factory, key = _factory(args)
            new = stored.take_up(tables, args.run, stored.scanned(spark, args.root)) if args.command == "extract" else 0
            return {"new": new} | stored.process(tables, args.run, args.root, factory, key, args.limit)
        if args.command == "create":
            rows = baseline.normalised(baseline.read_csv(spark, args.baseline))
            return stored.create(tables, args.run, rows, F.to_timestamp(F.lit(args.cutoff)), F.current_timestamp(), args.stable_seconds, args.root)
        if args.command == "decide":
            return stored.decide(tables, args.run, args.decision, vectors.read_labelled(spark, args.labelled), vectors.read_references(spark, args.references), args.similarity, args.margin, args.top_k)
        if args.command == "diff":
            return stored.diff_report(tables, args.run, args.decision, args.out, args.review_limit, args.seed)
        return stored.prune(tables, args.run, args.dry_run)
    if args.command == "report":
        return outputs.run_report(spark.read.parquet(args.rows), args.out, args.review_limit, args.seed)
    if args.command == "migrate":
        if args.action == "create":
            _moves(args, spark, None).write.mode("overwrite").parquet(args.plan)
            return {"planned": spark.read.parquet(args.plan).count()}
        if args.action == "sync":
            known = spark.read.parquet(args.plan)
            new = moves.appended(_moves(args, spark, known), known)
            before = known.count()
            new.select(known.columns).write.mode("append").parquet(args.plan)
            return {"appended": spark.read.parquet(args.plan).count() - before}
        plan = spark.read.parquet(args.plan)
        if args.action == "status":
            return {r["state"]: r["n"] for r in apply.examined(plan).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        tables = RunTables(spark, args.journal or args.plan.rstrip("/") + "-journal")
        return {r["state"]: r["n"] for r in apply.run(plan, tables, args.limit, args.execute).collect()}
    raise ValueError(args.command)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "doctor":
        out: Any = {m: importlib.util.find_spec(m) is not None for m in ("numpy", "pandas", "pyarrow", "onnxruntime", "pyspark")}
    else:
        out = run(args, SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    print(json.dumps(out, sort_keys=True, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
