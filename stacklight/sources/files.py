"""File libraries as DataFrames: discovery, fingerprints, verification. Sources are only ever read."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import paths


def local_path(c: str | Column) -> Column:
    """The path of a file: URI as plain text; other URIs stay."""
    return F.regexp_replace(paths.col(c), "^file:(//)?/", "/")


def discover(spark: SparkSession, root: str | Sequence[str], suffixes: Sequence[str] = paths.IMAGE_SUFFIXES) -> DataFrame:
    """path, length, modificationTime, content of the files below root with one of the suffixes; the suffix is tested before content is touched."""
    wanted = [("." + s.lstrip(".")).lower() for s in suffixes]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(root) if not isinstance(root, str) else root)
    return files.where(paths.suffix("path").isin(*wanted))


def snapshots(files: DataFrame) -> DataFrame:
    """source_path, size, modified, asset_id of discovered files. Times are those of the store, to the millisecond."""
    return files.select(local_path("path").alias("source_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("asset_id"))


def unchanged(now: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (source_path, size, asset_id, and modified or mtime_ns if times count) with outcome by what `now` lists: same, changed or missing. A touched file has changed."""
    compared = [c for c in ("size", "asset_id", "modified", "mtime_ns") if c in expected.columns and c in now.columns]
    found = now.select("source_path", F.struct(*compared).alias("__now"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"__now.{c}").eqNullSafe(F.col(c))
    return expected.join(found, "source_path", "left").withColumn("outcome", F.when(F.col("__now").isNull(), "missing").when(same, "same").otherwise("changed")).drop("__now")


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """unchanged() against discovered files."""
    return unchanged(snapshots(files), expected)


_STAT = "size bigint, mtime_ns bigint, regular boolean, error string"
_DIGEST = "sha256 string, size bigint, mtime_ns bigint, error string"


def _failed(e: OSError) -> str:
    return f"{type(e).__name__}:message_sha256={hashlib.sha256(str(e).encode()).hexdigest()[:16]}"


def _stat_of(path: str | None) -> dict:
    out = {"size": None, "mtime_ns": None, "regular": False, "error": None}
    if path is None:
        return out
    try:
        info = os.lstat(path)
    except OSError as e:
        return out | {"error": _failed(e)}
    return out | {"size": info.st_size, "mtime_ns": info.st_mtime_ns, "regular": stat.S_ISREG(info.st_mode)}


def _digest_of(path: str | None) -> dict:
    out = {"sha256": None, "size": None, "mtime_ns": None, "error": None}
    if path is None:  # not asked for: not opened
        return out
    try:
        with open(path, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        after = os.stat(path)
    except OSError as e:
        return out | {"error": _failed(e)}
    return out | {"sha256": digest, "size": after.st_size, "mtime_ns": after.st_mtime_ns}


def _each(f: Callable[[str | None], dict], schema: str) -> Callable:
    """A pandas UDF that asks `f` about each path, once for each row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([f(p) for p in batch], dtype=object)

    return F.pandas_udf(run, schema, F.PandasUDFType.SCALAR_ITER).asNondeterministic()


def stats(path: str | Column = "source_path") -> Column:
    """struct(size, mtime_ns, regular, error) of a path on a mount that all workers share; symlinks and absent files aren't regular. Nothing is opened."""
    return _each(_stat_of, _STAT)(paths.col(path))


def digests(path: str | Column) -> Column:
    """struct(sha256, size, mtime_ns, error): the digest of a path's file, and its stat after reading; a null path is not opened."""
    return _each(_digest_of, _DIGEST)(paths.col(path))


def looked_at(rows: DataFrame) -> DataFrame:
    """rows (source_path) with size, mtime_ns, modified, regular, error: a stat for each, beside it."""
    return rows.withColumn("__stat", stats()).select(*rows.columns, "__stat.size", "__stat.mtime_ns", F.timestamp_micros(F.floor(F.col("__stat.mtime_ns") / 1000)).alias("modified"), "__stat.regular", "__stat.error")


def hashed(looked: DataFrame, wanted: Column) -> DataFrame:
    """looked_at() with sha256, and steady: whether a file's stat was the same after reading as before. Only files that are `wanted` are opened."""
    read = looked.withColumn("__digest", digests(F.when(F.coalesce(wanted, F.lit(False)), F.col("source_path"))))
    steady = F.when(F.col("__digest.sha256").isNotNull(), (F.col("__digest.size") == F.col("size")) & (F.col("__digest.mtime_ns") == F.col("mtime_ns")))
    return read.withColumns({"sha256": F.col("__digest.sha256"), "steady": steady, "error": F.coalesce("error", "__digest.error")}).drop("__digest")


def listing(known_paths: DataFrame) -> DataFrame:
    """source_path, size, mtime_ns, modified, sha256, regular, steady, error of each source_path: every regular file is read."""
    return hashed(looked_at(known_paths.select("source_path")), F.col("regular")).select("source_path", "size", "mtime_ns", "modified", "sha256", "regular", "steady", "error")


def decoded(spark: SparkSession, root: str | Sequence[str]) -> DataFrame:
    """source_path, height, width, channels, data of images that the JVM decodes (PNG, JPEG, GIF, BMP, TIFF); those that it can't have height -1."""
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(list(root) if not isinstance(root, str) else root)
    return images.select(local_path("image.origin").alias("source_path"), "image.height", "image.width", "image.nChannels", "image.data")


def with_pixels(files: DataFrame, images: DataFrame) -> DataFrame:
    """files (source_path, ...) with height, width, nChannels and data of decoded()."""
    return files.join(images, "source_path", "left")
