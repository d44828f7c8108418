"""Vector expressions over array<double> columns, and the half-precision codec."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stacklight.functions.paths import col


def doubles(c: str | Column) -> Column:
    return col(c).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    """Left to right, so that sums are reproducible."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: str | Column) -> Column:
    """The unit vector; an empty or zero vector is an error."""
    own = F.array(F.struct(col(a).alias("v"), norm(a).alias("n")))  # bound by a lambda, so that the length is computed once and not for each component
    unit = lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])).otherwise(F.raise_error(F.lit("a vector must not be empty or zero")))
    return F.transform(own, unit)[0]


def cosine(a: str | Column, b: str | Column) -> Column:
    """Of vectors of equal length; other lengths are an error."""
    same = F.size(col(a)) == F.size(col(b))
    return F.when(same, dot(normalize(a), normalize(b))).otherwise(F.raise_error(F.lit("vectors differ in length")))


def with_dimensions(a: str | Column, dimensions: int) -> Column:
    return F.when(F.size(col(a)) == dimensions, normalize(a)).otherwise(F.raise_error(F.lit(f"a vector must have {dimensions} components")))


def half_bytes(v: str | Column) -> Column:
    """Little-endian half-precision bytes of each vector's unit vector."""
    return F.pandas_udf(_half_bytes, "binary")(col(v))


def from_half_bytes(b: str | Column) -> Column:
    """Unit vectors of half-precision bytes."""
    return F.pandas_udf(_from_half_bytes, "array<double>")(col(b))


def _by_length(values: pd.Series, stacked: Callable[[list], np.ndarray], done: Callable[[np.ndarray], list]) -> pd.Series:
    """`done` of the unit rows of what `stacked` makes of all values of one length; nulls stay."""
    out = pd.Series([None] * len(values), dtype=object)
    sizes = values.map(lambda x: -1 if x is None else len(x)).to_numpy()
    for n in np.unique(sizes[sizes >= 0]):
        own = np.flatnonzero(sizes == n)
        x = stacked(values.iloc[own].tolist())
        found = done(x / np.sqrt((x * x).sum(1, keepdims=True)))
        for i, v in zip(own, found, strict=True):
            out.iat[i] = v
    return out


def _half_bytes(v: pd.Series) -> pd.Series:
    return _by_length(v, lambda rows: np.asarray(rows, float).reshape(len(rows), -1), lambda x: [row.tobytes() for row in x.astype("<f2")])


def _from_half_bytes(b: pd.Series) -> pd.Series:
    if b.map(lambda raw: raw is not None and len(raw) % 2).any():
        raise ValueError("half-precision bytes come in pairs")
    return _by_length(b, lambda rows: np.frombuffer(b"".join(rows), "<f2").astype(float).reshape(len(rows), -1), lambda x: x.tolist())


def millionths(c: Column) -> Column:
    """Rounded to a millionth in a way that engines agree on."""
    return F.floor(c * 1e6 + 0.5) / 1e6
