import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.functions import boxes, digests, images, paths, vectors
from stacklight.operators import inference


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, name, suffix, excluded",
    [
        ("/a/b.PNG", "b.PNG", ".png", False), ("C:\\x\\Tests\\y.jpg", "y.jpg", ".jpg", True), ("/a/.png", ".png", "", False), ("/a.b/c", "c", "", False),
        ("/a/~$doc.png", "~$doc.png", ".png", True), ("/a/x.PART", "x.PART", ".part", True), ("/a/test/x.png", "x.png", ".png", True), ("/a/testing/x.png", "x.png", ".png", False),
    ],
)
def test_paths(spark, path, name, suffix, excluded):
    row = spark.createDataFrame([(path,)], "p string").select(paths.portable_name("p").alias("n"), paths.suffix("p").alias("s"), paths.is_excluded("p").alias("e")).first()
    assert tuple(row) == (name, suffix, excluded)


def test_text_helpers(spark):
    assert one(spark, paths.safe_component("v", "none"), v=' a<b>:"c?. ') == "a_b___c_"
    assert one(spark, paths.safe_component("v", "none"), v="...") == "none"
    assert len(one(spark, paths.safe_component("v", "none"), v="x" * 300)) == 120
    assert one(spark, paths.first_filled(F.lit("  "), F.lit(None), F.lit(" v "))) == "v"
    assert one(spark, paths.integer_or_null("v"), v="12x") is None and one(spark, paths.integer_or_null("v"), v=" 12 ") == 12
    assert one(spark, paths.valid_sha256("v"), v="A" * 64) == "a" * 64 and one(spark, paths.valid_sha256("v"), v="g" * 64) is None
    assert one(spark, paths.casefold("v"), v="STRAßE") == "strasse"
    assert one(spark, paths.source_directory("v", "/r"), v="/r/flux/a.png") == "flux"
    assert one(spark, paths.source_directory("v", "/r"), v="/x/a.png") == "(outside-root)" and one(spark, paths.source_directory("v", "/r"), v="/r") == "(root)"
    assert one(spark, paths.feature_root("v"), v="/a/Output/b/c.png") == "/a/Output" and one(spark, paths.feature_root("v"), v="/a/b/c.png") == "/a/b"


def test_nested_context_and_destination(spark):
    row = spark.createDataFrame([("/r/krea2_turbo/_json/Hero/2024/Mage/a.png", "", "", "other")], "p string, e string, s string, m string")
    got = row.select(paths.nested_context("p", "/r", "e", "s", "m").alias("c")).first()["c"]
    assert tuple(got) == ("Hero", "Mage", "krea2_turbo")
    day = 1_700_000_000_000_000_000
    place = lambda e, s, posted, target="/t": tuple(row.select(paths.destination("p", "/r", target, F.lit(e), F.lit(s), F.lit("Flux"), F.lit(posted), F.lit(day)).alias("d")).first()["d"])
    assert place("Hero", "Mage", False) == ("/t/Hero/Mage/待复核/2023/11/Flux__a.png", "待复核")
    assert place("", "Mage", True) == ("/t/待分拣/已发帖/2023/11/Flux__a.png", "已发帖")
    assert place("Krea2_Turbo", "Mage", False, "/r")[0] == "/r/待分拣/待复核/2023/11/Flux__a.png"


def test_digests(spark):
    pairs = {"b": "zwei\n", "a": '"1"', "é": "ü"}
    got = one(spark, digests.metadata_evidence("m"), m=pairs)
    assert got["sha256"] == hashlib.sha256(json.dumps(pairs, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got["keys"] == sorted(pairs) and got["n"] == 3
    error = one(spark, digests.safe_error(F.lit("OSError"), F.lit("/secret/path")))
    assert error.startswith("OSError:message_sha256=") and "secret" not in error and len(error) == 39
    a, b = ({"model_path": p, "rate": 1.5} for p in ("C:\\x\\m.onnx", "/home/y/m.onnx"))
    assert digests.config_fingerprint(a) == digests.config_fingerprint(b)
    with pytest.raises(ValueError):
        digests.config_fingerprint({"rate": math.nan})


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, b array<double>")
    row = v.select(vectors.normalize("a").alias("n"), vectors.cosine("a", "b").alias("c"), vectors.half_bytes("a").alias("h")).first()
    assert row["n"] == [0.6, 0.8] and row["c"] == 0.6 and len(row["h"]) == 4
    back = v.select(vectors.from_half_bytes(vectors.half_bytes("a")).alias("x")).first()["x"]
    assert abs(back[0] - 0.6) < 1e-3
    for bad in (vectors.normalize(F.array(F.lit(0.0))), vectors.cosine("a", F.array(F.lit(1.0))), vectors.with_dimensions("a", 3)):
        with pytest.raises(Exception):
            v.select(bad).collect()


def test_technical_evidence():
    flat = images.technical_evidence(np.full((512, 1024, 3), 127, np.uint8), 128)
    y, x = np.mgrid[:64, :64]
    checks = images.technical_evidence(np.repeat((((x + y) % 2) * 255).astype(np.uint8)[..., None], 3, 2), 128)
    assert (flat["probe_width"], flat["probe_height"], flat["entropy_bits"]) == (128, 64, 0)
    assert checks["edge_variance_proxy"] > flat["edge_variance_proxy"] and checks["dark_clip_ratio"] == 0.5
    with pytest.raises(ValueError):
        images.technical_evidence(np.zeros((4, 4, 3), np.uint8), 16)
    assert images.tagger_input(np.zeros((10, 20, 3), np.uint8)).shape == (1, 448, 448, 3)
    assert images.detector_input(np.zeros((10, 20, 3), np.uint8), channels_last=False).shape == (1, 3, 320, 320)


def test_model_rows():
    rows = np.arange(44.0).reshape(2, 22)
    assert boxes.model_rows(rows[None]).shape == (2, 22) and (boxes.model_rows(rows.T) == rows).all()
    assert boxes.model_rows(np.zeros((1, 22, 2100))).shape == (2100, 22)
    with pytest.raises(ValueError):
        boxes.model_rows(np.zeros((3, 5)))


def test_manifest_and_adapters():
    m = inference.manifest("a", "1", {"model": "0" * 64}, ["CPU"])
    assert "path" not in json.dumps(m)
    with pytest.raises(ValueError):
        inference.manifest("a", "1", {"model": "0" * 64}, ["CPU", "CPU"])
    with pytest.raises(ValueError):
        inference.load_adapter("no_colon")


def test_nested_configurations():
    print_of = digests.config_fingerprint
    assert print_of({"model": "C:\\x\\m.onnx", "a": [1, "b"]}) == print_of({"a": [1, "b"], "model": "/y/m.onnx"}) != print_of({"model": "n.onnx", "a": [1, "b"]})
    assert print_of({"a": []}) != print_of({"a": {}}) != print_of({"a": None}) and print_of({"a": "1"}) != print_of({"a": 1})
