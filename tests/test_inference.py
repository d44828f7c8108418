"""Batched inference with small ONNX models that the tests write."""

import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.operators import inference
from stacklight.sources import files

from .test_operators import png


def field(number, value):
    """A protocol-buffer field: whole numbers as varints, else bytes with their length."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def value_info(name, shape):
    dims = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in shape)
    return field(1, name) + field(2, field(1, field(1, 1) + field(2, dims)))


def mean_model(path, batch):
    """x (batch, 448, 448, 3) to its means over rows and columns, twice."""
    axes = field(1, "axes") + field(8, 1) + field(8, 2) + field(20, 7)
    keep = field(1, "keepdims") + field(3, 0) + field(20, 2)
    means = field(1, "x") + field(2, "y") + field(4, "ReduceMean") + field(5, axes) + field(5, keep)
    same = field(1, "y") + field(2, "z") + field(4, "Identity")
    graph = field(1, means) + field(1, same) + field(2, "g") + field(11, value_info("x", [batch, 448, 448, 3])) + field(12, value_info("y", [batch, 3])) + field(12, value_info("z", [batch, 3]))
    path.write_bytes(field(1, 7) + field(7, graph) + field(8, field(1, "") + field(2, 11)))
    return str(path)


@pytest.fixture
def pictures(tmp_path):
    folder = tmp_path / "pictures"
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.png").write_bytes(png(3 + k, 2 + k))
    (folder / "junk.png").write_bytes(b"junk")
    return folder


def tags_file(tmp_path):
    with open(tmp_path / "tags.csv", "w", newline="") as f:
        csv.writer(f).writerows([["tag_id", "name"], [1, "general"], [2, "sky"], [3, "sea"]])
    return str(tmp_path / "tags.csv")


@pytest.mark.parametrize("batch", ["N", 1])
def test_batches_say_what_single_calls_say(spark, pictures, tmp_path, batch):
    model, tags = mean_model(tmp_path / f"m{batch}.onnx", batch), tags_file(tmp_path)
    make = lambda: inference.OnnxAdapter.from_paths(model, tags, dimensions=3)
    found = files.discover(spark, str(pictures)).select(files.local_path("path").alias("source_path"), "content")
    rows = files.with_pixels(found, files.decoded(spark, str(pictures))).withColumn("asset_id", F.col("source_path")).coalesce(1)
    got = {r["asset_id"].rsplit("/", 1)[1]: r for r in inference.analyzed(rows, make, f"onnx-{batch}").collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {f"{k}.png": "COMPLETE" for k in range(5)} | {"junk.png": "DECODE_OR_INVALID"}
    adapter = make()
    for r in rows.where("height > 0").collect():
        rgb = inference.rgb_of(r["height"], r["width"], r["nChannels"], r["data"])
        one = adapter.analyze(rgb, r["content"], r["source_path"])
        own = got[r["asset_id"].rsplit("/", 1)[1]]
        assert np.allclose(own["embedding"], np.array(one.embedding) / np.linalg.norm(one.embedding), atol=1e-3)  # sums of single floats, in another order
        assert json.loads(own["evidence"])["adapter"]["providers"][0] == "CPUExecutionProvider"


def test_one_call_for_many_images(tmp_path):
    adapter = inference.OnnxAdapter(mean_model(tmp_path / "m.onnx", "N"), ["a", "b", "c"], dimensions=3)
    calls = []
    real = adapter.sessions[0]

    class Counting:
        get_inputs, get_providers = real.get_inputs, real.get_providers

        def run(self, names, feed):
            calls.append(next(iter(feed.values())).shape[0])
            return real.run(names, feed)

    adapter.sessions[0] = Counting()
    assert len(adapter.analyze_many([np.zeros((4, 4, 3), np.uint8)] * 7, [b""] * 7, [""] * 7)) == 7 and calls == [7]


class Picky:
    """Fails for small images; says which providers it ran on."""

    def __init__(self, ran_on="CPUExecutionProvider"):
        self.providers, self.ran_on = ["CPUExecutionProvider"], ran_on

    def analyze_many(self, rgbs, contents, paths):
        return [self.analyze(*x) for x in zip(rgbs, contents, paths, strict=True)]

    def analyze(self, rgb, content, path):
        if rgb.shape[0] < 4:
            raise RuntimeError("too small")
        return inference.Analysis([1.0], {"providers": [self.ran_on]}, {})


def test_one_bad_image_fails_no_other(spark, pictures):
    found = files.discover(spark, str(pictures)).select(files.local_path("path").alias("source_path"), "content")
    rows = files.with_pixels(found, files.decoded(spark, str(pictures))).withColumn("asset_id", F.col("source_path")).coalesce(1)
    outcomes = lambda make, key: sorted(r["outcome"] for r in inference.analyzed(rows, make, key).collect())
    said = outcomes(Picky, "picky")
    assert said.count("COMPLETE") + said.count("FAILED") == 5 and 0 < said.count("FAILED") < 5
    lost = outcomes(lambda: Picky("OtherProvider"), "picky-lost")
    assert "COMPLETE" not in lost and "CUDA_PROVIDER_LOST" in lost


def test_manifest_of_files(tmp_path):
    model, tags = mean_model(tmp_path / "m.onnx", "N"), tags_file(tmp_path)
    own = inference.OnnxAdapter.from_paths(model, tags, dimensions=3)
    assert [a["role"] for a in own.manifest["artifacts"]] == ["tagger", "tags"] and str(tmp_path) not in json.dumps(own.manifest)
    assert own.tags == ["general", "sky", "sea"]


def test_extract_and_process_commands(spark, pictures, tmp_path):
    from stacklight.plans import cli

    model, tags = mean_model(tmp_path / "m.onnx", "N"), tags_file(tmp_path)
    common = ["--tables", str(tmp_path / "t"), "--run", "r", "--tagger", model, "--tags", tags, "--dimensions", "3"]
    call = lambda *a: cli.run(cli.parser().parse_args([*a, str(pictures), *common]), spark)
    first = call("extract")
    assert (first["new"], first["status"], first["items"]) == (6, "COMPLETE", {"COMPLETE": 5, "FAILED": 1})
    (pictures / "more.png").write_bytes(png(9, 9))
    assert call("process")["claimed"] == 0
    again = call("extract")
    assert (again["new"], again["claimed"], again["items"]) == (1, 1, {"COMPLETE": 6, "FAILED": 1})
    status = cli.run(cli.parser().parse_args(["status", "--tables", str(tmp_path / "t"), "--run", "r"]), spark)
    assert status["items"] == {"COMPLETE": 6, "FAILED": 1} and status["occurrences"] == {"PROCESSED": 6, "FROZEN": 1}
    with pytest.raises(ValueError, match="either an adapter"):
        cli.run(cli.parser().parse_args(["process", str(pictures), "--tables", str(tmp_path / "t"), "--run", "r"]), spark)
