"""The directory source, two-stage freezing, stored runs, the CSV sink, and blocks of references."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.functions import boxes, digests, vectors
from stacklight.operators import assets, openset, runs
from stacklight.plans import cli, outputs, stored
from stacklight.sources import baseline, files, one_csv, tables, walk
from stacklight.streaming import scan as streaming


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "pictures"
    for name in ("a.png", "deep/b.JPG", "deep/er/c.webp", "deep/er/est/d.gif", "deep/notes.txt", "Tests/t.png", "deep/.SEEKMETA/x.png", "~$lock.png", "late.png.part", ".png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    (root / "link.png").symlink_to(root / "a.png")
    (root / "loop").symlink_to(root)
    (root / "broken.png").symlink_to(root / "gone.png")
    (tmp_path / "aside").mkdir()
    (tmp_path / "aside/e.png").write_bytes(b"e")
    (root / "linked").symlink_to(tmp_path / "aside")
    return root


def found(df, root):
    return sorted(os.path.relpath(r["source_path"], root) for r in df.collect())


@pytest.mark.parametrize("tasks", [1, 2, 64])
def test_library_source(spark, tree, tasks):
    plain = ["Tests/t.png", "a.png", "deep/.SEEKMETA/x.png", "deep/b.JPG", "deep/er/c.webp", "deep/er/est/d.gif", "~$lock.png"]
    assert found(walk.library(spark, str(tree), tasks=tasks), tree) == plain
    assert found(walk.inventory(spark, str(tree), tasks), tree) == ["a.png", "deep/b.JPG", "deep/er/c.webp", "deep/er/est/d.gif"]
    assert found(walk.library(spark, str(tree), ["txt"], tasks=tasks), tree) == ["deep/notes.txt"]
    followed = found(walk.library(spark, str(tree), follow_symlinks=True, tasks=tasks), tree)
    assert followed == sorted([*plain, "link.png", "linked/e.png"])
    assert found(walk.library(spark, [str(tree / "deep"), str(tree.parent / "aside")], tasks=tasks), tree) == ["../aside/e.png", "deep/.SEEKMETA/x.png", "deep/b.JPG", "deep/er/c.webp", "deep/er/est/d.gif"]
    row = walk.library(spark, str(tree), tasks=tasks).where("source_path like '%/a.png'").first()
    assert (row["size"], row["mtime_ns"], row["regular"], row["linked"]) == (5, (tree / "a.png").stat().st_mtime_ns, True, False)


def test_no_folder_is_refused(spark, tree):
    for bad in (tree / "a.png", tree / "nowhere"):
        with pytest.raises(Exception, match="no folder to walk"):
            walk.library(spark, str(bad)).count()


def test_excluded_folders_are_never_opened(tree):
    opened = []

    def scan(folder):
        opened.append(os.path.relpath(folder, tree))
        return os.scandir(folder)

    rules = walk.Rules(frozenset([".png"]), frozenset(["tests", ".seekmeta"]))
    subtrees = walk.planned([str(tree)], rules, 3, scan)
    rows = [r for s in subtrees for r in walk.walked(s, rules, scan)]
    assert sorted(os.path.basename(r[0]) for r in rows) == ["a.png"]
    assert set(opened) == {".", "deep", "deep/er", "deep/er/est"}


def test_excluded_root_is_empty(spark, tree):
    assert walk.inventory(spark, str(tree / "Tests")).count() == 0


def test_only_survivors_are_read(tree, monkeypatch):
    read = []
    real = open
    monkeypatch.setattr("builtins.open", lambda path, *a, **k: read.append(str(path)) or real(path, *a, **k))
    assert files._digest_of(None)["sha256"] is None and files._stat_of(str(tree / "a.png"))["size"] == 5 and read == []
    assert files._digest_of(str(tree / "a.png"))["sha256"] == __import__("hashlib").sha256(b"a.png").hexdigest() and read == [str(tree / "a.png")]


def test_two_stages_freeze_as_one(spark, tree):
    sha = __import__("hashlib").sha256(b"a.png").hexdigest()
    rows = spark.createDataFrame([(str(tree / "a.png"), sha), (str(tree / "deep/b.JPG"), "0" * 64), (str(tree / "deep/er/c.webp"), None), (str(tree / "link.png"), None), (str(tree / "gone.png"), None)], "source_path string, baseline_sha256 string")
    day = lambda n: F.current_timestamp() + F.expr(f"INTERVAL {n} DAY")
    for cutoff, now in ((day(2), day(1)), (day(-1), day(1)), (day(2), day(0))):
        one = runs.freeze(rows, files.listing(rows), cutoff, now).select("source_path", "status", "asset_id")
        two = runs.freeze_files(rows, cutoff, now)
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.select("source_path", "status", "asset_id").collect()), key=str)
    early = runs.freeze_files(rows, day(-1), day(1))
    assert early.where("sha256 is not null").count() == 0 and early.where("status = 'added_deferred'").count() == 3
    assert {r["reason"] for r in two.where("source_path like '%gone%'").collect()} == {"missing_or_unreadable"}


def test_streamed_scan_counts_as_it_goes(spark, tree, tmp_path):
    counters = streaming.Counters()
    spark.streams.addListener(counters)
    try:
        out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
        (tree / "copy.png").write_bytes(b"a.png")
        streaming.scan(spark, str(tree), out, mark, per_batch=2).awaitTermination()
        own = spark.read.parquet(f"{out}/occurrences")
        want = assets.scan_counts(own).first()
        assert spark.read.parquet(f"{out}/assets").count() == want["enqueued"]
        for _ in range(100):
            if counters.sums.get("assets", {}).get("enqueued") == want["enqueued"]:
                break
            __import__("time").sleep(0.1)
        assert counters.sums["scan"]["discovered"] == want["discovered"] and counters.sums["assets"]["enqueued"] == want["enqueued"]
    finally:
        spark.streams.removeListener(counters)


def test_one_csv(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    rows = spark.range(1000).select("id", F.concat(F.lit('say "hi", é\n'), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("list"))
    outputs.write_csv(rows.repartition(7).orderBy(F.desc("id")), path)
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfid,list,text\r\n") and os.listdir(tmp_path) == ["out.csv"]
    got = list(__import__("csv").reader(open(path, encoding="utf-8-sig", newline="")))
    assert [r[0] for r in got[1:]] == [str(k) for k in range(999, -1, -1)] and got[2] == ["998", "[998]", 'say "hi", é\n998']
    with pytest.raises(Exception):
        one_csv.save(rows.select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id")), str(tmp_path / "bad.csv"))
    assert os.listdir(tmp_path) == ["out.csv"] and open(path, "rb").read() == raw
    outputs.write_csv(rows.limit(0), path)
    assert open(path, "rb").read() == b"\xef\xbb\xbfid,list,text\r\n"


def test_normalize_is_linear_in_the_dimensions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 700))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    got = np.array([r[0] for r in df.select(vectors.normalize("v")).collect()])
    assert np.allclose(got, x / np.linalg.norm(x, axis=1, keepdims=True), atol=1e-12)
    plan = df.select(vectors.normalize("v").alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_blocks_of_references(spark):
    rng = np.random.default_rng(1)
    refs = spark.createDataFrame([(f"c{k % 5}", rng.normal(size=6).tolist()) for k in range(60)] + [("alone", rng.normal(size=6).tolist())], "label string, vector array<double>")
    own = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(40)], "id bigint, vector array<double>")
    shown = lambda df: {r["id"]: [(x["label"], round(x["minus"], 9)) for x in r["ranked"]] for r in df.collect()}
    whole = shown(openset.scores(own, refs))
    for most in (366, 100, 30, 6):
        assert shown(openset.scores(own, refs, key="id", most=most)) == whole
    with pytest.raises(ValueError, match="name a key"):
        openset.scores(own, refs, most=30)


def test_nested_evidence(spark):
    one, two = '{"b": {"y": [1, {"q": null, "a": "x"}], "x": 2}, "a": "secret"}', '{"a":"secret","b":{"x":2,"y":[1,{"a":"x","q":null}]}}'
    rows = spark.createDataFrame([(one,), (two,), ("[1]",), ("{",), (None,), ("{}",)], "t string")
    got = [r["e"] for r in rows.select(digests.nested_evidence("t").alias("e")).collect()]
    assert got[0] == got[1] and got[0]["keys"] == ["a", "b"] and got[0]["n"] == 2 and got[0]["sha256"] == __import__("hashlib").sha256(two.encode()).hexdigest()
    assert got[2:5] == [None, None, None] and got[5]["n"] == 0


def test_model_rows_layouts():
    rows = np.arange(66.0).reshape(3, 22)
    for layout in (rows, rows.T, rows[None], rows.T[None], rows[:, None, :]):
        assert (boxes.model_rows(layout) == rows).all()
    square = np.arange(484.0).reshape(22, 22)
    assert (boxes.model_rows(square) == square).all()
    assert boxes.model_rows(np.zeros((5, 30))).shape == (5, 30) and boxes.model_rows(np.arange(22.0)).shape == (1, 22) and boxes.model_rows([]).shape == (0, 22)
    for bad in (np.zeros((3, 5)), np.zeros((2, 3, 22))):
        with pytest.raises(ValueError):
            boxes.model_rows(bad)


# --- stored runs


@pytest.fixture
def run(spark, tree, tmp_path):
    sha = __import__("hashlib").sha256(b"a.png").hexdigest()
    lines = [f"{tree}/a.png,image,draft,{sha}", f"{tree}/deep/b.JPG,image,posted,", f"{tree}/gone.png,image,draft,"]
    (tmp_path / "base.csv").write_text("source,kind,bucket,sha256\n" + "\n".join(lines) + "\n", encoding="utf-8")
    rows = baseline.normalised(baseline.read_csv(spark, str(tmp_path / "base.csv")))
    return tables.RunTables(spark, str(tmp_path / "tables")), rows


def day(n):
    return F.current_timestamp() + F.expr(f"INTERVAL {n} DAY")


def files_of(root):
    return {os.path.join(d, f): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def finished(t, run_id):
    """The run's items, as processing leaves them."""
    items = t.current("items", ["run_id", "asset_id"]).where(F.col("run_id") == run_id)
    done = items.withColumns({"state": F.lit("COMPLETE"), "event_seq": F.col("event_seq") + 1, "features": F.lit('{"width": 1}'), "embedding": F.array(F.lit(1.0), F.lit(0.0))})
    t.append("items", t.spark.createDataFrame(done.collect(), done.schema), "run_id")


def test_create_resumes_and_defers(run, tree):
    t, rows = run
    first = stored.create(t, "r", rows.where("source_path not like '%JPG'"), day(2), day(1))
    assert first == {"run_id": "r", "counts": {"added_deferred": 0, "frozen": 1, "missing": 1, "source_changed": 0}, "resumed": 0, "assets": 1}
    again = stored.create(t, "r", rows, day(2), day(1), root=str(tree))
    assert again == {"run_id": "r", "counts": {"added_deferred": 2, "frozen": 1, "missing": 0, "source_changed": 0}, "resumed": 2, "assets": 1}
    states = {r["source_path"].rsplit("/", 1)[1]: r["occurrence_state"] for r in stored.occurrences(t, "r").collect()}
    assert states == {"a.png": "FROZEN", "b.JPG": "FROZEN", "gone.png": "MISSING", "c.webp": "ADDED_DEFERRED", "d.gif": "ADDED_DEFERRED"}
    with pytest.raises(ValueError, match="each path once"):
        stored.create(t, "q", rows.union(rows), day(2), day(1))


def references(spark):
    records = spark.createDataFrame([("a", [1.0, 0.01 * k]) for k in range(30)] + [(None, [-1.0, 0.01 * k]) for k in range(30)], "label string, vector array<double>")
    return records, spark.createDataFrame([("a", [1.0, 0.0])], "label string, vector array<double>")


def test_decisions_are_kept_once(spark, run, tmp_path):
    t, rows = run
    stored.create(t, "r", rows, day(2), day(1))
    finished(t, "r")
    records, refs = references(spark)
    with pytest.raises(ValueError, match="no complete decision"):
        stored.diff_report(t, "r", "d", str(tmp_path / "out"))
    first = stored.decide(t, "r", "d", records, refs)
    assert first == {"decision_id": "d", "status": "COMPLETE", "resumed": False, "decisions": 2}
    before = files_of(tmp_path / "tables")
    assert stored.decide(t, "r", "d", records, refs) == first | {"resumed": True}
    assert files_of(tmp_path / "tables") == before
    with pytest.raises(ValueError, match="other inputs"):
        stored.decide(t, "r", "d", records.limit(31), refs)
    other = stored.decide(t, "r", "d2", records, refs)
    assert other["decisions"] == 2 and {k: v for k, v in files_of(tmp_path / "tables").items() if k in before} == before
    summary = stored.diff_report(t, "r", "d", str(tmp_path / "out"))
    assert summary["by_status"] == {"baseline_identity_unverifiable": 1, "missing": 1, "processed": 1}
    assert sorted(os.listdir(tmp_path / "out")) == ["diff.csv", "review-queue.json", "summary.json"]
    assert len(json.loads((tmp_path / "out/review-queue.json").read_text())) > 0


def test_half_written_decisions_are_replaced(spark, run, tmp_path):
    t, rows = run
    stored.create(t, "r", rows, day(2), day(1))
    finished(t, "r")
    records, refs = references(spark)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tables.RunTables, "replace", lambda *a: (_ for _ in ()).throw(OSError("away")))
        with pytest.raises(OSError):
            stored.decide(t, "r", "d", records, refs)
    with pytest.raises(ValueError, match="unfinished"):
        stored.prune(t, "r")
    assert stored.decide(t, "r", "d", records, refs)["decisions"] == 2


def test_prune_rewrites_one_partition(spark, run, tmp_path):
    t, rows = run
    for r in ("r", "s"):
        stored.create(t, r, rows, day(2), day(1))
        finished(t, r)
    before = files_of(tmp_path / "tables/items/run_id=s")
    dry = stored.prune(t, "r", dry_run=True)
    assert dry == {"run_id": "r", "items": 2, "derived_bytes": 2 * (12 + 16), "dry_run": True}
    assert stored.prune(t, "r") == dry | {"dry_run": False} and stored.prune(t, "r", True)["items"] == 0
    assert files_of(tmp_path / "tables/items/run_id=s") == before
    left = t.current("items", ["run_id", "asset_id"])
    assert {(r["run_id"], r["state"], r["features"] is None) for r in left.collect()} == {("r", "COMPLETE", True), ("s", "COMPLETE", False)}


def test_commands_over_a_stored_run(spark, run, tree, tmp_path):
    t, _ = run
    call = lambda *a: cli.run(cli.parser().parse_args([*a, "--tables", str(tmp_path / "tables"), "--run", "r"]), spark)
    made = call("create", str(tmp_path / "base.csv"), "--cutoff", "2999-01-01", "--stable-seconds", "0", "--root", str(tree))
    assert made["counts"]["frozen"] == 2 and made["counts"]["added_deferred"] == 2
    finished(t, "r")
    records, refs = references(spark)
    (tmp_path / "refs.json").write_text(json.dumps({"a": [[1.0, 0.0]]}))
    (tmp_path / "labelled.json").write_text(json.dumps([{"label": r["label"], "vector": r["vector"]} for r in records.collect()]))
    said = call("decide", "--decision", "d", "--labelled", str(tmp_path / "labelled.json"), "--references", str(tmp_path / "refs.json"))
    assert said["status"] == "COMPLETE" and said["decisions"] == 2
    assert call("diff", "--decision", "d", "--out", str(tmp_path / "report"))["by_status"]["missing"] == 1
    assert call("prune", "--dry-run")["items"] == 2


def test_scan_command_counts_copies_and_errors(spark, tree):
    (tree / "copy.png").write_bytes(b"a.png")
    call = lambda *a: cli.run(cli.parser().parse_args(["scan", *a]), spark)
    assert call(str(tree)) == {"discovered": 8, "enqueued": 7, "duplicates": 1, "errors": 0}
    assert call(str(tree), str(tree.parent / "aside"), "--extension", "txt") == {"discovered": 1, "enqueued": 1, "duplicates": 0, "errors": 0}
    assert call(str(tree), "--follow-symlinks")["duplicates"] == 2


def test_undecided_while_items_are_open(spark, run):
    t, rows = run
    stored.create(t, "r", rows, day(2), day(1))
    with pytest.raises(ValueError, match="open items"):
        stored.decide(t, "r", "d", *references(spark))
    said = stored.status(t, "r")
    assert said["items"] == {"PENDING": 2} and said["occurrences"] == {"FROZEN": 2, "MISSING": 1}
    assert [s["counts"]["frozen"] for s in said["statistics"]] == [2]
