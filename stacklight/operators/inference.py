"""Analysis of images by adapters, as one Arrow pass over file contents with typed outcomes.

An adapter is made once in each Python worker by a factory; errors of the data become
outcomes in the result and never fail a task.
"""

from __future__ import annotations

import csv
import hashlib
import importlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.functions import boxes, images
from stacklight.operators import detect

OUTCOMES = ("COMPLETE", "SOURCE_CHANGED", "IO_RETRYABLE", "DECODE_OR_INVALID", "ADAPTER_INIT_FAILED", "CUDA_PROVIDER_LOST", "OOM", "FAILED")
_RESULT = "asset_id string, outcome string, error string, features string, evidence string, embedding array<double>"


@dataclass
class Analysis:
    """What an adapter found; at most one embedding."""

    embedding: Sequence[float] | None = None
    evidence: Mapping[str, Any] = field(default_factory=dict)
    features: Mapping[str, Any] = field(default_factory=dict)


class AnalysisAdapter(Protocol):
    name: str

    def analyze(self, rgb: np.ndarray, content: bytes, path: str) -> Analysis: ...


class EmbeddingAdapter(Protocol):
    name: str

    def embed(self, content: bytes, path: str) -> Sequence[float]: ...


@dataclass
class CallableAdapter:
    """Wraps a function (content, path) -> vector."""

    name: str
    function: Callable[[bytes, str], Sequence[float]]

    def embed(self, content: bytes, path: str) -> Sequence[float]:
        return self.function(content, path)


@dataclass
class CombinedAdapter:
    """Runs several adapters after one decode; results are keyed by adapter name, and more than one embedding is an error."""

    adapters: Sequence[AnalysisAdapter]
    name: str = "combined"

    def analyze(self, rgb: np.ndarray, content: bytes, path: str) -> Analysis:
        found = {a.name: a.analyze(rgb, content, path) for a in self.adapters}
        vectors = [r.embedding for r in found.values() if r.embedding is not None]
        if len(vectors) > 1:
            raise ValueError("more than one adapter gave an embedding")
        return Analysis(vectors[0] if vectors else None, {k: dict(r.evidence) for k, r in found.items()}, {k: dict(r.features) for k, r in found.items()})


def load_adapter(spec: str) -> Any:
    """The adapter that "module:factory" makes; it must embed or analyze."""
    module, colon, factory = spec.partition(":")
    if not colon or not module or not factory:
        raise ValueError("an adapter is named as module:factory")
    adapter = getattr(importlib.import_module(module), factory)()
    if not hasattr(adapter, "embed") and not hasattr(adapter, "analyze"):
        raise TypeError(f"{spec} makes neither an embedding nor an analysis adapter")
    return adapter


def manifest(name: str, version: str, artifacts: Mapping[str, str], providers: Sequence[str] = ()) -> dict[str, Any]:
    """A fingerprint of an adapter without paths: roles and digests of its files, unique providers."""
    if len(set(providers)) != len(providers) or any(not p.strip() for p in providers):
        raise ValueError("providers must be unique and not blank")
    if any(len(d) != 64 for d in artifacts.values()) or not artifacts:
        raise ValueError("every artifact needs a SHA-256")
    return {"name": name, "version": version, "artifacts": [{"role": r, "sha256": d} for r, d in sorted(artifacts.items())], "providers": list(providers)}


def checked_manifest(given: Mapping[str, Any]) -> Mapping[str, Any]:
    """A given manifest, if it names an adapter, a version, a role and a SHA-256 for every artifact, no path, and providers once each."""
    artifacts = given.get("artifacts") or []
    if not given.get("name") or not given.get("version") or any(not a.get("role") or "path" in a for a in artifacts):
        raise ValueError("a manifest needs a name, a version, and a role but no path for every artifact")
    manifest(given["name"], given["version"], {a["role"]: a.get("sha256") or "" for a in artifacts}, given.get("providers") or ())
    return given


def check_providers(evidence: Any, wanted: str = "CUDAExecutionProvider") -> None:
    """Fails where any part of an adapter's evidence lists providers of which the first isn't the wanted one; evidence without providers passes."""
    todo = [evidence]
    while todo:
        part = todo.pop()
        if isinstance(part, Mapping):
            listed = part.get("providers")
            if isinstance(listed, (list, tuple)) and listed and listed[0] != wanted:
                raise RuntimeError(f"the adapter fell back from {wanted}: a cuda provider is unavailable")
            todo += part.values()
        elif isinstance(part, (list, tuple)):
            todo += part


def png_text_keys(content: bytes) -> list[str]:
    """The keywords of a PNG's text chunks."""
    out, at = [], 8
    while content[:8] == b"\x89PNG\r\n\x1a\n" and at + 8 <= len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        if kind in (b"tEXt", b"iTXt", b"zTXt"):
            out.append(content[at + 8 : at + 8 + size].split(b"\0", 1)[0].decode("latin-1"))
        at += 12 + size
    return sorted(out)


def rgb_of(height: int | None, width: int | None, channels: int | None, data: bytes | None) -> np.ndarray:
    """(h, w, 3) of what Spark's image source decoded (rows of BGR, BGRA or grey bytes); an image that it couldn't decode raises ValueError."""
    if height is None or height != height or height <= 0 or data is None:
        raise ValueError("the image can't be decoded")
    pixels = np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels))
    return pixels[..., [2, 1, 0]] if channels >= 3 else np.repeat(pixels[..., :1], 3, axis=2)


def kind_of(error: BaseException) -> str:
    """The outcome that an error stands for."""
    text = str(error).lower()
    if isinstance(error, MemoryError) or "out of memory" in text or "bad allocation" in text:
        return "OOM"
    if "cuda" in text and ("provider" in text or "device" in text):
        return "CUDA_PROVIDER_LOST"
    if isinstance(error, OSError):
        return "IO_RETRYABLE"
    return "DECODE_OR_INVALID" if isinstance(error, ValueError) else "FAILED"


def safe(error: BaseException) -> str:
    return f"{type(error).__name__}:message_sha256={hashlib.sha256(str(error).encode()).hexdigest()[:16]}"


_MADE: dict[str, Any] = {}


def _adapter(key: str, factory: Callable[[], Any]) -> Any:
    if key not in _MADE:
        _MADE[key] = factory()
    return _MADE[key]


#: Images that a model sees at once, and the bytes of pixels (of contents, where they are more) in one step.
MOST_IMAGES, MOST_BYTES = 16, 64 << 20


def _steps(rows: Sequence[Any]) -> Iterator[list[Any]]:
    """Runs of at most MOST_IMAGES rows and about MOST_BYTES; a larger image is a run of its own."""
    out: list[Any] = []
    size = 0
    for row in rows:
        own = len(row.data or b"") + len(row.content or b"")
        if out and (len(out) == MOST_IMAGES or size + own > MOST_BYTES):
            yield out
            out, size = [], 0
        out.append(row)
        size += own
    if out:
        yield out


def _found(adapter: Any, ready: list[tuple[Any, np.ndarray]]) -> list[Analysis | Exception]:
    """What an adapter says of some images: all in one call if it can (analyze_many); one at a time if not, or if that call fails, so that one image can't fail others."""
    if len(ready) > 1 and hasattr(adapter, "analyze_many"):
        try:
            return list(adapter.analyze_many([rgb for _, rgb in ready], [row.content for row, _ in ready], [row.source_path for row, _ in ready]))
        except Exception:  # each image has its own outcome below
            pass
    out: list[Analysis | Exception] = []
    for row, rgb in ready:
        try:
            out.append(adapter.analyze(rgb, row.content, row.source_path) if hasattr(adapter, "analyze") else Analysis(adapter.embed(row.content, row.source_path)))
        except Exception as e:
            out.append(e)
    return out


def _described(row: Any, rgb: np.ndarray, found: Analysis, wanted: str | None) -> dict[str, Any]:
    """The result of an image that an adapter analysed; providers that aren't the wanted ones are an error."""
    if wanted is not None:
        check_providers(found.evidence, wanted)
    features = {"width": rgb.shape[1], "height": rgb.shape[0], "technical": images.technical_evidence(rgb), "analysis": dict(found.features)}
    evidence = {"metadata_keys": png_text_keys(row.content), "adapter": dict(found.evidence)}
    out = {"features": json.dumps(features, sort_keys=True), "evidence": json.dumps(evidence, sort_keys=True)}
    if found.embedding is not None:
        v = np.asarray(found.embedding, float)
        out["embedding"] = (v / np.linalg.norm(v)).tolist()
    return out


def analyzed(files: DataFrame, factory: Callable[[], Any], key: str) -> DataFrame:
    """asset_id, outcome, error, features, evidence (JSON), embedding for files (asset_id, source_path, content, pixels as files.with_pixels() adds them, and expected_sha256 if sources must not have changed).

    The JVM decodes; each asset is analysed once, several at a time where the adapter can (analyze_many). An adapter's
    manifest is checked when it is made, and its providers against what its evidence says.
    """
    expected = F.col("expected_sha256") if "expected_sha256" in files.columns else F.lit(None).cast("string")
    rows = files.select("asset_id", "source_path", "content", "height", "width", "nChannels", "data", expected.alias("expected"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter, broken = None, None
        try:
            adapter = _adapter(key, factory)
            if getattr(adapter, "manifest", None):
                checked_manifest(adapter.manifest)
        except Exception as e:  # the outcome carries it
            broken = e
        wanted = next(iter(getattr(adapter, "providers", None) or ()), None)
        for batch in batches:
            for step in _steps(list(batch.itertuples(index=False))):
                results = {r.asset_id: {"asset_id": r.asset_id, "outcome": "COMPLETE", "error": None, "features": None, "evidence": None, "embedding": None} for r in step}
                ready = []
                for row in step:
                    try:
                        if broken is not None:
                            results[row.asset_id] |= {"outcome": "ADAPTER_INIT_FAILED", "error": safe(broken)}
                        elif row.expected is not None and hashlib.sha256(row.content).hexdigest() != row.expected:
                            results[row.asset_id]["outcome"] = "SOURCE_CHANGED"
                        else:
                            ready.append((row, rgb_of(row.height, row.width, row.nChannels, row.data)))
                    except Exception as e:
                        results[row.asset_id] |= {"outcome": kind_of(e), "error": safe(e)}
                for (row, rgb), said in zip(ready, _found(adapter, ready), strict=True):
                    try:
                        if isinstance(said, Exception):
                            raise said
                        results[row.asset_id] |= _described(row, rgb, said, wanted)
                    except Exception as e:
                        results[row.asset_id] |= {"outcome": kind_of(e), "error": safe(e)}
                yield pd.DataFrame(list(results.values()), columns=["asset_id", "outcome", "error", "features", "evidence", "embedding"])

    return rows.mapInPandas(run, _RESULT)


def with_detections(results: DataFrame, canvas: int = 320) -> DataFrame:
    """analyzed() with `detections`, the summary of a detector's raw rows in features; null where there was no detector."""
    raw = F.from_json(F.get_json_object("features", "$.analysis.nudenet_rows"), "array<array<array<double>>>")
    return results.withColumn("__raw", raw).withColumn("detections", F.when(F.col("__raw").isNotNull(), detect.summary_of(detect.detected("__raw", canvas)))).drop("__raw")


@dataclass
class OnnxAdapter:
    """A tagger and, if given, a detector as ONNX sessions of one thread; providers are used in the order given and never silently replaced."""

    tagger: str
    tags: Sequence[str]
    detector: str | None = None
    providers: Sequence[str] = ("CPUExecutionProvider",)
    ratings: tuple[str, ...] = ("general", "sensitive", "questionable", "explicit")
    dimensions: int = 1024
    name: str = "onnx"

    def _session(self, path: str):
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        session = ort.InferenceSession(path, options, providers=list(self.providers))
        if session.get_providers()[: len(self.providers)] != list(self.providers):
            raise RuntimeError("a cuda provider is unavailable" if "CUDAExecutionProvider" in self.providers else "a provider is unavailable")
        return session

    def __post_init__(self):
        self.sessions = [self._session(p) for p in (self.tagger, self.detector) if p]
        self.manifest: Mapping[str, Any] | None = None

    @classmethod
    def from_paths(cls, tagger: str, tags: str, detector: str | None = None, version: str = "1", **settings: Any) -> OnnxAdapter:
        """An adapter of model files and a CSV of tags (column `name`), with its manifest: roles and digests, no paths. Files that change while they are loaded are an error."""
        files = {"tagger": tagger, "tags": tags} | ({"detector": detector} if detector else {})
        before = {role: _file_digest(p) for role, p in files.items()}
        with open(tags, encoding="utf-8-sig", newline="") as f:
            names = [row["name"] for row in csv.DictReader(f)]
        out = cls(tagger, names, detector, **settings)
        if {role: _file_digest(p) for role, p in files.items()} != before:
            raise RuntimeError("model files changed while they were loaded")
        out.manifest = checked_manifest(manifest(out.name, version, before, list(out.providers)))
        return out

    def analyze(self, rgb: np.ndarray, content: bytes, path: str) -> Analysis:
        return self.analyze_many([rgb], [content], [path])[0]

    def analyze_many(self, rgbs: Sequence[np.ndarray], contents: Sequence[bytes], paths: Sequence[str]) -> list[Analysis]:
        """One call of each model for all images; a model with a fixed batch axis of one is called for each."""
        first = self.sessions[0].get_inputs()[0]
        probabilities, vectors = (np.asarray(x).reshape(len(rgbs), -1) for x in _run(self.sessions[0], first, [images.tagger_input(rgb) for rgb in rgbs])[:2])
        if probabilities.shape[1] != len(self.tags) or vectors.shape[1] != self.dimensions:
            raise ValueError("the tagger's outputs don't fit its tags or dimensions")
        raw: list[Any] = [None] * len(rgbs)
        if len(self.sessions) > 1:
            first = self.sessions[1].get_inputs()[0]
            size = next((d for d in first.shape if d in (320, 640)), 320)
            outputs = _run(self.sessions[1], first, [images.detector_input(rgb, size, first.shape[-1] == 3) for rgb in rgbs])
            # Rows of every output; with_detections() makes the summary of them in the JVM.
            raw = [[boxes.model_rows(np.asarray(x)[i]).tolist() for x in outputs] for i in range(len(rgbs))]
        providers = self.sessions[0].get_providers()
        return [Analysis(v.tolist(), {"providers": list(providers)}, self._features(p, r)) for p, v, r in zip(probabilities, vectors, raw, strict=True)]

    def _features(self, probabilities: np.ndarray, rows: Any) -> dict[str, Any]:
        by_name = dict(zip(self.tags, map(float, probabilities), strict=True))
        top = sorted(((-p, t) for t, p in by_name.items() if t not in self.ratings))[:30]
        said = {f"rating_{r}": by_name.get(r, 0.0) for r in self.ratings} | {"top_tags": [{"name": t, "score": -p} for p, t in top if -p >= 0.25]}
        return {"wd14_moat": said} | ({"nudenet_rows": rows} if rows is not None else {})


def _run(session: Any, first: Any, inputs: Sequence[np.ndarray]) -> list[np.ndarray]:
    """A session's outputs for some inputs of one image each, along a batch axis."""
    if isinstance(first.shape[0], int):  # fixed
        each = [session.run(None, {first.name: x}) for x in inputs]
        return [np.concatenate([np.asarray(o) for o in outputs]) for outputs in zip(*each, strict=True)]
    return session.run(None, {first.name: np.concatenate(inputs)})


def _file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
