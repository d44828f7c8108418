
from stacklight.functions import paths
from stacklight.operators import openset
from stacklight.plans import reprocess
from stacklight.sources import files, tables

from .test_operators import png, refs

GOOD = png(3, 2)


class Flaky:
    name = "flaky"

    def embed(self, content, path):
        if path.endswith("io.png"):
            raise OSError("share is away")
        if path.endswith("cuda.png"):
            raise RuntimeError("the CUDA provider is lost")
        return [1.0, 0.0]


def contents(spark, folder, *names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / f"{n}.png").write_bytes(b"junk" if n == "junk" else GOOD)
    found = files.discover(spark, str(folder)).select(files.local_path("path").alias("source_path"), "content")
    return files.with_pixels(found, files.decoded(spark, str(folder))).withColumn("asset_id", paths.stem("source_path"))


def test_outcomes_and_retries(spark, tmp_path):
    t = tables.RunTables(spark, str(tmp_path / "t"))
    own = contents(spark, tmp_path / "f", "a", "b", "io", "junk")
    assert reprocess.start(t, "r", own) == 4 and reprocess.start(t, "r", own) == 0
    part = reprocess.process(t, "r", own, Flaky, "flaky-1", limit=2)
    assert part["paused_reason"] == "invocation_limit_reached" and part["items"] == {"COMPLETE": 2, "PENDING": 2}
    out = reprocess.process(t, "r", own, Flaky, "flaky-1")
    assert out["status"] == "COMPLETE" and out["items"] == {"COMPLETE": 2, "FAILED": 2}
    rows = {r["asset_id"]: r for r in reprocess.items(t, "r").collect()}
    assert rows["io"]["attempts"] == 3 and rows["junk"]["attempts"] == 1 and rows["a"]["embedding"] == [1.0, 0.0]
    assert "share" not in rows["io"]["error"]


def test_lost_provider_pauses(spark, tmp_path):
    t = tables.RunTables(spark, str(tmp_path / "t"))
    own = contents(spark, tmp_path / "f", "cuda", "a")
    reprocess.start(t, "r", own)
    out = reprocess.process(t, "r", own, Flaky, "flaky-2")
    assert (out["status"], out["paused_reason"], out["items"]) == ("PAUSED", "cuda_provider_unavailable", {"COMPLETE": 1, "RETRYABLE_FAILED": 1})
    low = reprocess.process(t, "r", own, Flaky, "flaky-2", gate=lambda: "low_ram")
    assert low["paused_reason"] == "low_ram" and low["claimed"] == 0


def test_decisions(spark):
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [-1.0, 0.1])], "asset_id string, vector array<double>")
    records = spark.createDataFrame([("a", [1.0, 0.01 * i]) for i in range(6)] + [(None, [-1.0, 0.0])], "label string, vector array<double>")
    r = refs(spark, a=[[1.0, 0.0]])
    report, said = reprocess.decide(vectors, records, r, gates=openset.Gates())
    assert report["status"] == "COMPLETE"
    got = {x["asset_id"]: (x["decision_state"], x["identity"], x["reasons"]) for x in said.collect()}
    assert got == {"x": ("ACCEPTED", "a", ["status_policy_not_calibrated"]), "y": ("UNKNOWN", None, ["identity_unknown"])}
    report, said = reprocess.decide(vectors, records, r)
    assert report["status"] == "FAILED" and said is None and len(report["candidates"]) == 12
