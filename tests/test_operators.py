import datetime as dt
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stacklight.functions import paths
from stacklight.operators import assets, detect, diff, inference, moves, openset, runs
from stacklight.plans import apply, cli, outputs
from stacklight.sources import baseline, files, tables, vectors
from stacklight.streaming import scan as streaming


def png(width, height, color=(10, 200, 30), text=None):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + bytes(color) * width for _ in range(height))
    middle = chunk(b"tEXt", text) if text else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + middle + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


# --- open set


def refs(spark, **classes):
    return spark.createDataFrame([(k, v) for k, vs in classes.items() for v in vs], "label string, vector array<double>")


def test_score_and_rejection(spark):
    v = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    r = refs(spark, alpha=[[1.0, 0.0], [0.0, 1.0]])
    got = openset.classify(v, r, openset.OpenSet(top_k=1)).first()
    assert abs(got["score"] - 0.8535533905932737) < 1e-15 and got["state"] == "accepted" and abs(got["margin"] - 1.8535533905932737) < 1e-12
    close = openset.classify(v, refs(spark, a=[[1.0, 0.0]], b=[[1.0, 0.01]])).first()
    assert close["state"] == "unknown" and close["predicted"] is None and close["nearest"] == "a"
    for bad in (refs(spark, unknown=[[1.0]]), refs(spark, **{" ": [[1.0]]}), refs(spark, a=[[1.0]]).limit(0)):
        with pytest.raises(ValueError):
            openset.classify(v, bad)
    with pytest.raises(ValueError):
        openset.OpenSet(min_similarity=2)


def test_calibration(spark):
    records = spark.createDataFrame([("alpha", [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, -1.0])], "label string, vector array<double>")
    rows = openset.calibrate(records, refs(spark, alpha=[[1.0, 0.0]]), [0.8], [0.05])
    m = rows.first()
    assert (m["coverage"], m["accepted_accuracy"], m["unknown_false_accept"], m["unknown_false_accept_rate"]) == (2 / 3, 0.5, 1, 0.5)
    assert openset.recommend(rows).count() == 0 and openset.recommend(rows, openset.Gates(0.5, 0.5, 1, 1)).count() == 1
    assert openset.calibrate(records, refs(spark, alpha=[[1.0, 0.0]]), [0.999], [3.0]).first()["accepted_accuracy"] is None
    said = {(r["actual"], r["predicted"]): r["n"] for r in openset.outcomes(openset.scores(records, refs(spark, alpha=[[1.0, 0.0]])), openset.grid(spark, [0.8], [0.05])).collect()}
    assert said == {("alpha", "alpha"): 1, ("unknown", "alpha"): 1, ("unknown", "unknown"): 1}


# --- scans, baselines, freezing


@pytest.fixture
def library(tmp_path):
    (tmp_path / "lib/nested").mkdir(parents=True)
    (tmp_path / "lib/first.jpg").write_bytes(b"same bytes")
    (tmp_path / "lib/nested/duplicate.png").write_bytes(b"same bytes")
    (tmp_path / "lib/notes.txt").write_text("ignored")
    return tmp_path


def test_scan_and_rescan(spark, library):
    found = files.snapshots(files.discover(spark, str(library / "lib")))
    assert assets.scan_counts(found).first().asDict() == {"discovered": 2, "enqueued": 1, "duplicates": 1, "errors": 0}
    assert assets.scan_counts(found, found).first().asDict() == {"discovered": 2, "enqueued": 0, "duplicates": 2, "errors": 0}
    assert assets.inventory(found).first().asDict() == {"assets": 1, "occurrences": 2}
    before = spark.createDataFrame(found.collect(), found.schema)
    (library / "lib/first.jpg").write_bytes(b"other bytes")
    changed = files.verified(files.discover(spark, str(library / "lib")), before)
    assert {r["source_path"].rsplit("/", 1)[1]: r["outcome"] for r in changed.collect()} == {"first.jpg": "changed", "duplicate.png": "same"}


def test_streaming_scan_only_adds_what_is_new(spark, library):
    out, mark = str(library / "out"), str(library / "mark")
    run = lambda: streaming.scan(spark, str(library / "lib"), out, mark).awaitTermination()
    run()
    count = lambda t: spark.read.parquet(f"{out}/{t}").count()
    assert (count("assets"), count("occurrences")) == (1, 2)
    run()
    assert (count("assets"), count("occurrences")) == (1, 2)
    (library / "lib/third.png").write_bytes(b"new bytes")
    (library / "lib/fourth.png").write_bytes(b"same bytes")
    run()
    assert (count("assets"), count("occurrences")) == (2, 4)


def test_baseline_and_freeze(spark, library):
    lib = library / "lib"
    sha = __import__("hashlib").sha256(b"same bytes").hexdigest()
    (library / "b.csv").write_text(f"﻿Source,kind,BUCKET,sha256,size\n{lib}/first.jpg,image,Published,{sha},10\n{lib}/nested/duplicate.png,Image, ,zz,x\n{lib}/gone.png,image,draft,,\n{lib}/notes.txt,sidecar,,,\n{lib}/tests/t.png,image,,,\n", encoding="utf-8")
    normal = baseline.normalised(baseline.read_csv(spark, str(library / "b.csv")))
    rows = normal.orderBy("source_path").collect()
    assert [(r["old_bucket"], r["audit_locked"], r["baseline_identity_unverifiable"], r["source_size"]) for r in rows] == [("Published", True, False, 10), ("draft", False, True, None), ("待复核", False, True, None)]
    own = spark.createDataFrame(rows, normal.schema)
    now, later = F.current_timestamp() + F.expr("INTERVAL 1 DAY"), F.current_timestamp() + F.expr("INTERVAL 2 DAY")
    states = {r["source_path"].rsplit("/", 1)[1]: (r["status"], r["reason"]) for r in runs.freeze(own, files.listing(own), later, now).collect()}
    assert states == {"first.jpg": ("processed", None), "duplicate.png": ("baseline_identity_unverifiable", None), "gone.png": ("missing", "not_a_regular_file")}
    early = runs.freeze(own, files.listing(own), F.lit("2000-01-01").cast("timestamp"), now).where("source_path like '%first%'").first()
    assert (early["status"], early["reason"]) == ("added_deferred", "modified_after_cutoff")
    fresh = runs.freeze(own, files.listing(own), later, F.current_timestamp()).where("source_path like '%first%'").first()
    assert fresh["reason"] == "not_stable_for_required_interval"
    assert assets.unique_assets(runs.freeze(own, files.listing(own), later, now)).count() == 1


# --- runs


ITEMS = "asset_id string, state string, attempts int, lease_owner string, lease_token string, lease_expires_at timestamp"


def test_claims_and_leases(spark):
    at = lambda s: F.lit(f"2024-01-01 00:00:{s:02d}").cast("timestamp")
    items = spark.createDataFrame([("a", "PENDING", 0, None, None, None)], ITEMS)
    one = runs.claim(items, 5, 10, at(0), "w", "t1")
    assert one.first()["attempts"] == 1
    assert runs.claim(one, 5, 10, at(5), "w", "t2").count() == 0
    two = runs.claim(one, 5, 10, at(11), "w", "t2")
    assert two.first()["attempts"] == 2
    said = spark.createDataFrame([("a", "t1", "COMPLETE"), ("b", "t2", "COMPLETE")], "asset_id string, lease_token string, state string")
    assert not any(r["accepted"] for r in runs.transition(two, said).collect())
    assert runs.transition(two, said.withColumn("lease_token", F.lit("t2"))).where("accepted").count() == 1
    with pytest.raises(ValueError):
        runs.claim(items, 0, 10, at(0), "w", "t")


def test_retry_policy(spark):
    rows = spark.createDataFrame([("IO_RETRYABLE", 2), ("IO_RETRYABLE", 3), ("OOM", 9), ("DECODE_OR_INVALID", 1), ("COMPLETE", 1)], "k string, n int")
    assert [r[0] for r in rows.select(runs.retry_state(F.col("k"), F.col("n"))).collect()] == ["RETRYABLE_FAILED", "FAILED", "RETRYABLE_FAILED", "FAILED", "COMPLETE"]


def test_run_tables(spark, tmp_path):
    t = tables.RunTables(spark, str(tmp_path / "t"))
    row = lambda n, s: spark.createDataFrame([("r", "a", n, s)], "run_id string, asset_id string, event_seq bigint, state string")
    assert t.missing("items")
    t.append("items", row(1, "PENDING"), "run_id")
    t.append("items", row(2, "COMPLETE"), "run_id")
    assert [r["state"] for r in t.current("items", ["run_id", "asset_id"]).collect()] == ["COMPLETE"]
    spark.createDataFrame([(tables.VERSION + 1,)], "version int").write.mode("append").parquet(str(tmp_path / "t/_version"))
    with pytest.raises(ValueError):
        tables.RunTables(spark, str(tmp_path / "t"))


# --- differences and review


def test_locked_paths_keep_their_bucket(spark):
    frozen = spark.createDataFrame([("/a", "x", "processed", "draft", False, None), ("/b", "x", "processed", "published", True, None), ("/c", None, "missing", "draft", False, "gone")], "source_path string, asset_id string, status string, old_bucket string, audit_locked boolean, reason string")
    said = spark.createDataFrame([("x", "keep", "id", 0.9, ["safety_x"])], "asset_id string, proposed_bucket string, identity string, confidence double, reasons array<string>")
    rows = diff.diff_rows(frozen, said)
    got = {r["source_path"]: (r["effective_bucket"], r["action"], r["review_reasons"]) for r in rows.collect()}
    assert got == {"/a": ("keep", "candidate_only", ["safety_x"]), "/b": ("published", None, ["safety_x"]), "/c": (None, "candidate_only", ["missing"])}
    assert diff.summary(rows).first().asDict() == {"occurrences": 3, "audit_locked": 1, "review_required": 3}
    kinds = [r[0] for r in rows.orderBy("source_path").select(diff.strata_of_reasons(F.col("review_reasons"))).collect()]
    assert kinds == [["safety"], ["safety"], ["general"]]


def slow_queue(rows, limit, seed):
    import hashlib

    rank = lambda i: (hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i)
    lists = {}
    for i, strata in rows:
        for s in strata:
            lists.setdefault(s, []).append(i)
    for own in lists.values():
        own.sort(key=rank)
    taken, moved = {}, True
    while len(taken) < limit and moved:
        moved = False
        for s in sorted(lists):
            while lists[s]:
                i = lists[s].pop(0)
                if i not in taken:
                    taken[i], moved = s, True
                    break
            if len(taken) >= limit:
                break
    return taken


@pytest.mark.parametrize("limit", [1, 7, 40, 500])
def test_review_queue(spark, limit):
    rng = random.Random(limit)
    rows = [(f"id{i}", rng.sample(["a", "b", "c", "d"], rng.randint(1, 3))) for i in range(120)]
    df = spark.createDataFrame(rows, "occurrence_id string, review_strata array<string>")
    assert {r["occurrence_id"]: r["stratum"] for r in diff.review_queue(df, limit, "s").collect()} == slow_queue(rows, limit, "s")


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("o1", "/a", "processed", "keep", "keep", "x", 0.5, False, ["safety"])], "occurrence_id string, source_path string, status string, proposed_bucket string, effective_bucket string, identity string, confidence double, audit_locked boolean, review_reasons array<string>")
    rows = rows.withColumn("review_strata", diff.strata_of_reasons(F.col("review_reasons")))
    summary = outputs.run_report(rows, str(tmp_path / "out"), 5, "s")
    assert summary["by_status"] == {"processed": 1} and (tmp_path / "out/review-queue.json").read_text().endswith("\n")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/diff.csv")).columns == sorted(rows.columns)


# --- detections, images, moves


def test_suppression(spark):
    box = F.struct(*(F.col(c) for c in "xywh"))
    rows = spark.createDataFrame([(1, "A", 0.9, 1, 0.0, 0.0, 10.0, 10.0), (1, "A", 0.8, 2, 1.0, 1.0, 10.0, 10.0), (1, "B", 0.7, 3, 1.0, 1.0, 10.0, 10.0), (1, "A", 0.1, 4, 50.0, 50.0, 9.0, 9.0)], "i int, l string, s double, q long, x double, y double, w double, h double")
    kept = detect.suppressed(rows, "i", "l", "s", "q", box)
    assert sorted(r["seq"] for r in kept.collect()) == [1, 3]
    s = detect.summaries(kept, ("B",), ("A",)).first()
    assert (s["explicit_score"], s["covered_score"], s["class_maxima"], len(s["detections"])) == (0.7, 0.9, {"A": 0.9, "B": 0.7}, 2)
    every = detect.summaries(kept, ("B",), ("A",), images=spark.createDataFrame([(1,), (2,)], "image int")).orderBy("image").collect()
    assert [(r["image"], r["n"], r["explicit_score"], r["class_maxima"]) for r in every] == [(1, 2, 0.7, {"A": 0.9, "B": 0.7}), (2, 0, 0.0, {})]


class Stub:
    name = "stub"

    def embed(self, content, path):
        if b"cuda" in content:
            raise RuntimeError("CUDA provider lost")
        return [3.0, 4.0]


def test_analysis_outcomes(spark, tmp_path):
    good = png(3, 2, text=b"prompt\0secret")
    for name, content in (("a.png", good), ("b.png", b"no image"), ("c.png", good)):
        (tmp_path / name).write_bytes(content)
    found = files.discover(spark, str(tmp_path)).select(files.local_path("path").alias("source_path"), "content")
    rows = files.with_pixels(found, files.decoded(spark, str(tmp_path))).withColumn("asset_id", paths.stem("source_path"))
    rows = rows.withColumn("expected_sha256", F.when(F.col("asset_id") == "c", "0" * 64))
    got = {r["asset_id"]: r for r in inference.analyzed(rows, Stub, "stub-1").collect()}
    assert got["a"]["outcome"] == "COMPLETE" and got["a"]["embedding"] == [0.6, 0.8] and '"width": 3' in got["a"]["features"]
    assert "secret" not in got["a"]["evidence"] and "prompt" in got["a"]["evidence"]
    assert got["b"]["outcome"] == "DECODE_OR_INVALID" and got["b"]["error"].startswith("ValueError:message_sha256=")
    assert got["c"]["outcome"] == "SOURCE_CHANGED"

    def broken():
        raise RuntimeError("no model")

    assert {r["outcome"] for r in inference.analyzed(rows, broken, "broken-1").collect()} == {"ADAPTER_INIT_FAILED"}
    assert inference.kind_of(MemoryError()) == "OOM" and inference.kind_of(RuntimeError("CUDA provider lost")) == "CUDA_PROVIDER_LOST" and inference.kind_of(OSError()) == "IO_RETRYABLE"


def test_jvm_decode(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(4, 3))
    row = files.decoded(spark, str(tmp_path)).first()
    assert (row["width"], row["height"]) == (4, 3)
    assert inference.rgb_of(row["height"], row["width"], row["nChannels"], row["data"]).tolist() == [[[10, 200, 30]] * 4] * 3


def test_jpeg_gif_and_bmp_are_analysed(spark, tmp_path):
    """The JVM writes them here, as it reads them there."""
    io, image = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.awt.image.BufferedImage(5, 4, 1)
    for kind in ("jpg", "gif", "bmp"):
        assert io.write(image, kind, spark._jvm.java.io.File(str(tmp_path / f"x.{kind}")))
    found = files.discover(spark, str(tmp_path)).select(files.local_path("path").alias("source_path"), "content", F.sha2("content", 256).alias("asset_id"))
    got = inference.analyzed(files.with_pixels(found, files.decoded(spark, str(tmp_path))), Stub, "stub-jvm").collect()
    assert len(got) == 3 and all(r["outcome"] == "COMPLETE" and '"width": 5' in r["features"] for r in got)


class Detector:
    name = "nudenet"

    def analyze(self, rgb, content, path):
        box = [50.0, 50.0, 40.0, 40.0]
        rows = [box + [0.0, 0.9] + [0.0] * 16, box + [0.0, 0.8] + [0.0] * 16, box + [0.7] * 18, box + [0.0] * 18]
        return inference.Analysis(features={"rows": [rows]})


def test_raw_detections_become_a_summary(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(4, 3))
    found = files.discover(spark, str(tmp_path)).select(files.local_path("path").alias("source_path"), "content", F.lit("a").alias("asset_id"))
    results = inference.analyzed(files.with_pixels(found, files.decoded(spark, str(tmp_path))), Detector, "detector-1")
    row = inference.with_detections(results.withColumn("features", F.regexp_replace("features", '"rows"', '"nudenet_rows"'))).first()["detections"]
    assert row["class_maxima"] == {"FACE_FEMALE": 0.9, "FEMALE_GENITALIA_COVERED": 0.7} and row["covered_score"] == 0.7 and row["explicit_score"] == 0.0
    assert [(d["label"], d["confidence"], d["x"], d["w"]) for d in row["detections"]] == [("FACE_FEMALE", 0.9, 30.0, 40.0), ("FEMALE_GENITALIA_COVERED", 0.7, 30.0, 40.0)]


def test_moves(spark, tmp_path):
    root = tmp_path / "output"
    (root / "flux").mkdir(parents=True)
    (root / "flux/a.png").write_bytes(b"one")
    (root / "flux/b.png").write_bytes(b"two")
    rows = spark.createDataFrame([(str(root / "flux/a.png"), "Hero", "Mage", "Flux", "draft")] * 1 + [(str(root / "flux/b.png"), "Hero", "Mage", "Flux", "posted")], "source_path string, entity string, subject string, engine string, old_bucket string")
    facts = files.listing(rows).select("source_path", "sha256", F.col("size").alias("source_size"), "mtime_ns")
    plan = moves.planned(rows.join(facts, "source_path"), str(root), str(tmp_path / "sorted"))
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    assert moves.clashes(plan).count() == 0
    journal = tables.RunTables(spark, str(tmp_path / "journal"))
    states = lambda execute=False: {r["state"]: r["n"] for r in apply.run(plan, journal, execute=execute).collect()}
    assert states() == {"PLANNED": 2} and (root / "flux/a.png").exists()
    (root / "flux/b.png").write_bytes(b"changed")
    assert states(execute=True) == {"MOVED": 1, "SOURCE_CHANGED": 1}
    assert not (root / "flux/a.png").exists() and (root / "flux/b.png").read_bytes() == b"changed"
    assert states(execute=True) == {}
    twice = plan.union(plan.withColumn("source_path", F.concat("source_path", F.lit("x"))))
    assert moves.renamed(twice).select("destination_path").distinct().count() == 4
    with pytest.raises(Exception):
        moves.planned(rows.join(facts, "source_path"), "/elsewhere", "/t").collect()


def test_moves_go_on_behind_a_limit(spark, tmp_path):
    names = ["a", "b", "c", "d"]
    for name in names:
        (tmp_path / name).write_bytes(name.encode())
    rows = spark.createDataFrame([(str(tmp_path / n), str(tmp_path / "sorted" / n)) for n in names], "source_path string, destination_path string")
    facts = files.listing(rows).select("source_path", "sha256", F.col("size").alias("source_size"), "mtime_ns")
    rows.join(facts, "source_path").write.parquet(str(tmp_path / "plan"))
    call = lambda *more: cli.run(cli.parser().parse_args(["migrate", "apply", "--plan", str(tmp_path / "plan"), *more]), spark)
    assert call() == {"PLANNED": 4} and (tmp_path / "a").exists()
    assert call("--execute", "--limit", "1") == {"MOVED": 1} and (tmp_path / "b").exists()
    assert call("--execute", "--limit", "2") == {"MOVED": 2} and not (tmp_path / "c").exists()
    (tmp_path / "d").write_bytes(b"changed")
    assert call("--execute") == {"SOURCE_CHANGED": 1} and call("--execute") == {}
    assert sorted(p.name for p in (tmp_path / "sorted").iterdir()) == ["a", "b", "c"]


def test_moves_of_a_feature_run_and_sync(spark, tmp_path):
    root, call = tmp_path / "lib", lambda *more: cli.run(cli.parser().parse_args(["migrate", *more]), spark)
    for folder, name in (("flux", "a.png"), ("flux", "b.png"), ("flux", "b.txt"), ("other", "c.png"), ("late", "d.png")):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / name).write_bytes(name.encode())
    every = sorted(str(p) for p in root.rglob("*.*"))
    lines = [f"{p},{'image' if p.endswith('png') else 'sidecar'},Hero,Mage,Flux,draft" for p in [*every, every[0].upper()[:0] + every[0]]]
    (tmp_path / "b.csv").write_text("\n".join(["source,kind,entity,subject,source_engine,bucket", *lines]))
    listed = files.listing(spark.createDataFrame([(p,) for p in every], "source_path string")).select("source_path", "size", "mtime_ns", "sha256")

    def features(name, open_folder):
        state = F.when(F.col("source_path").contains(f"/{open_folder}/"), "FROZEN").when(F.col("source_path").endswith("b.png"), "MISSING").otherwise("PROCESSED")
        listed.withColumn("occurrence_state", state).write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    same = ["--plan", str(tmp_path / "plan"), "--baseline", str(tmp_path / "b.csv"), "--root", str(root), "--target", str(tmp_path / "sorted")]
    assert call("create", *same, "--features", features("f1", "late"), "--directory", "flux", "late") == {"planned": 2}  # a.png and the sidecar
    assert call("sync", *same, "--features", features("f2", "none")) == {"appended": 2}  # c.png and d.png
    assert call("sync", *same, "--features", str(tmp_path / "f2")) == {"appended": 0}
    names = [r["source_path"].rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "plan")).collect()]
    assert sorted(names) == ["a.png", "b.txt", "c.png", "d.png"]


def test_manifests_and_providers():
    good = inference.manifest("wd14", "1", {"model": "0" * 64}, ["CPUExecutionProvider"])
    assert inference.checked_manifest(good) is good
    for bad in (good | {"version": ""}, good | {"artifacts": [{"role": "model", "sha256": "0" * 64, "path": "/x"}]}, good | {"artifacts": [{"role": "m", "sha256": "1"}]}, good | {"providers": ["a", "a"]}):
        with pytest.raises(ValueError):
            inference.checked_manifest(bad)
    inference.check_providers({"a": [{"providers": ["CUDAExecutionProvider", "CPUExecutionProvider"]}], "b": 1})
    with pytest.raises(RuntimeError) as e:
        inference.check_providers({"a": [{"providers": ["CPUExecutionProvider"]}]})
    assert inference.kind_of(e.value) == "CUDA_PROVIDER_LOST"


# --- JSON sources and the command line


def test_json_sources_and_commands(spark, tmp_path, capsys):
    (tmp_path / "v.json").write_text('{"vector": [1, 0]}')
    (tmp_path / "r.json").write_text('{"a": [[1, 0], [0.9, 0.1]], "b": [0, 1]}')
    (tmp_path / "l.json").write_text('[{"label": "a", "vector": [1, 0]}, {"label": null, "vector": [0, -1], "id": "x"}]')
    assert sorted(r["label"] for r in vectors.read_references(spark, str(tmp_path / "r.json")).collect()) == ["a", "a", "b"]
    assert [(r["id"], r["label"]) for r in vectors.read_labelled(spark, str(tmp_path / "l.json")).collect()] == [("0", "a"), ("x", None)]
    assert cli.main(["classify", "--vector", str(tmp_path / "v.json"), "--references", str(tmp_path / "r.json")]) == 0
    assert '"predicted": "a"' in capsys.readouterr().out
    assert cli.main(["calibrate", "--labelled", str(tmp_path / "l.json"), "--references", str(tmp_path / "r.json")]) == 0
    assert cli.main(["doctor"]) == 0
    (tmp_path / "bad.json").write_text('{"vector": "x"}')
    with pytest.raises(Exception):
        vectors.read_vector(spark, str(tmp_path / "bad.json")).collect()
