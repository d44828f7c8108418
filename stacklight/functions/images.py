"""Image arithmetic in numpy, for use inside Arrow tasks, and its raster form as expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EDGE = 512


def luma(rgb: np.ndarray) -> np.ndarray:
    """8-bit luminance of an (h, w, 3) image by the integer weights of ITU-R 601."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _kernel(src: int, dst: int) -> np.ndarray:
    """(dst, src) weights of a Lanczos filter of three lobes with support that grows with the reduction."""
    scale = max(1.0, src / dst)
    centre = (np.arange(dst) + 0.5) * src / dst
    x = (np.arange(src)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(1, keepdims=True)


def resize(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    out = _kernel(plane.shape[0], height) @ plane.astype(float) @ _kernel(plane.shape[1], width).T
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def thumbnail(plane: np.ndarray, max_edge: int) -> np.ndarray:
    h, w = plane.shape
    if max(h, w) <= max_edge:
        return plane
    k = max_edge / max(h, w)
    return resize(plane, max(1, round(w * k)), max(1, round(h * k)))


def edges(plane: np.ndarray) -> np.ndarray:
    """Each inner pixel times 8 less its neighbours, clipped to a byte."""
    p = plane.astype(np.int64)
    if min(p.shape) <= 2:
        return plane
    total = sum(p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    return np.clip(9 * p[1:-1, 1:-1] - total, 0, 255)


def technical_evidence(rgb: np.ndarray, max_edge: int = MAX_EDGE) -> dict:
    """Signals for calibration, measured on a bounded luminance probe."""
    if max_edge < 32:
        raise ValueError("max_edge must be at least 32")
    probe = thumbnail(luma(rgb) if rgb.ndim == 3 else rgb, max_edge)
    counts = np.bincount(probe.ravel(), minlength=256)
    n = max(1, probe.size)
    share = counts[counts > 0] / n
    edge = edges(probe)
    return {
        "probe_width": int(probe.shape[1]),
        "probe_height": int(probe.shape[0]),
        "luminance_mean": round(float(probe.mean()), 4),
        "luminance_stddev": round(float(probe.std()), 4),
        "entropy_bits": round(float(-(share * np.log2(share)).sum()), 4),
        "dark_clip_ratio": round(int(counts[:3].sum()) / n, 6),
        "bright_clip_ratio": round(int(counts[253:].sum()) / n, 6),
        "edge_mean": round(float(edge.mean()), 4),
        "edge_variance_proxy": round(float(edge.var()), 4),
        "calibration_required": True,
    }


def tagger_input(rgb: np.ndarray, size: int = 448) -> np.ndarray:
    """(1, size, size, 3) float32 BGR of the image on a white square."""
    h, w = rgb.shape[:2]
    edge = max(h, w)
    square = np.full((edge, edge, 3), 255, np.uint8)
    top, left = (edge - h) // 2, (edge - w) // 2
    square[top : top + h, left : left + w] = rgb
    planes = [square[..., c] if edge == size else resize(square[..., c], size, size) for c in (2, 1, 0)]
    return np.stack(planes, axis=-1).astype(np.float32)[None]


def detector_input(rgb: np.ndarray, size: int = 320, channels_last: bool = True) -> np.ndarray:
    """The image scaled into the top left of a black square, in [0, 1]."""
    h, w = rgb.shape[:2]
    k = size / max(h, w)
    nh, nw = max(1, math.floor(h * k)), max(1, math.floor(w * k))
    out = np.zeros((size, size, 3), np.float32)
    for c in range(3):
        out[:nh, :nw, c] = (rgb[..., c] if (nh, nw) == (h, w) else resize(rgb[..., c], nw, nh)) / 255.0
    return (out if channels_last else out.transpose(2, 0, 1))[None]


#: What a column of evidence holds.
EVIDENCE = "probe_width int, probe_height int, luminance_mean double, luminance_stddev double, entropy_bits double, dark_clip_ratio double, bright_clip_ratio double, edge_mean double, edge_variance_proxy double"


def raster_evidence(pixels: str, width: int, height: int) -> Column:
    """technical_evidence of grey rasters (array of width x height bytes) as a struct column, in Arrow batches."""
    names = [part.split()[0] for part in EVIDENCE.split(", ")]

    def measured(column: pd.Series) -> pd.DataFrame:
        found = [technical_evidence(np.asarray(v, np.uint8).reshape(height, width)) for v in column]
        return pd.DataFrame([[f[n] for n in names] for f in found], columns=names)

    return F.pandas_udf(measured, EVIDENCE)(F.col(pixels))
