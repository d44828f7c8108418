"""Whitening of embeddings with MLlib's distributed block matrices.

Entries become integers (``floor(scale * c) + offset``), so sums are exact. Rows, centred by the exact
column sums, are indexed and laid into the blocks of a BlockMatrix; its transpose times
itself is the scatter matrix, added up over partitions of the middle dimension, so that no
task sees all blocks. The scatter is dims x dims and is solved on the driver (``eigh``); the whitening
matrix, eigenvectors over the roots of their eigenvalues, is a BlockMatrix of one block, and the product
with it projects the rows. The projections' own covariance is multiplied out in the same way.

Blocks are gathered by Spark SQL and written as MLlib stores matrices, to be read again as such: the
way over IndexedRowMatrix boxes every entry, and its time grew with the square of the rows. Nothing but sums, the
dims x dims matrices and a count for each partition reaches the driver. Blocks have up to ``BLOCK_ROWS``
rows, fewer while rows are few. Rows of a product lie in about the root of its input's partitions, by MLlib's rule.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries take no part, nor
do those whose length isn't the commonest (of equally common ones, the longest); repeated rows and rows without an
id count like others; a component whose variance is no more than rounding (dims * 1e-13 of the
largest) has no direction of its own: its `whitened` is null and it stays out of identity_error;
without variance `explained` is null; deviations above a bigint are null; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stacklight.llm.common import kept

#: Entries become floor(SCALE * c) + OFFSET; components that are returned.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Most rows of a block, and most bytes.
BLOCK_ROWS, BLOCK_BYTES = 32_768, 1 << 24


def _finite(vec: str) -> Column:
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id, x (array<bigint>) of the rows that take part."""
    fine = rows.where(_finite(vec_col)).select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda v: F.floor(v.cast("double") * scale) + F.lit(offset).cast("bigint")).alias("x"))
    sizes = fine.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    dims = sizes.orderBy(F.desc("n"), F.desc("dims")).select("dims").first()
    return fine.where(F.size("x") == (dims[0] if dims else 0))


def indexed(rows: DataFrame) -> DataFrame:
    """rows, written once, with a dense `index` from 0: places in partitions, shifted by the counts of the partitions before."""
    placed = kept(rows.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # A row for each partition.
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    shifts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part bigint, start bigint"))
    own = placed.withColumn("part", part).join(shifts, "part").withColumn("index", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    return own.drop("part", "start", "place")


def block_rows(n: int, dims: int) -> int:
    """Rows of a block: about the root of all, so that there are as many blocks as rows in one, within bounds."""
    return max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims), 1 << math.ceil(math.log2(max(1, n)) / 2)))


#: How MLlib stores a dense matrix in a table: by rows if it is transposed.
_STORED = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"


def blocks_of(centred: DataFrame, rows: int, dims: int) -> DataFrame:
    """at (block row, block column), ids, deviations, matrix (as stored) of the rows (index, id, deviation, centred), written once; rows of a block are in order of their index."""
    listed = F.array_sort(F.collect_list(F.struct("index", "id", "deviation", "centred"))).alias("listed")
    grouped = centred.groupBy(F.floor(F.col("index") / rows).alias("block")).agg(listed)
    none = F.lit(None).cast("array<int>")
    matrix = F.struct(F.lit(1).cast("tinyint").alias("type"), F.size("listed").alias("numRows"), F.lit(dims).alias("numCols"), none.alias("colPtrs"), none.alias("rowIndices"), F.flatten("listed.centred").alias("values"), F.lit(True).alias("isTransposed"))
    return kept(grouped.select(F.struct(F.col("block"), F.lit(0).cast("bigint").alias("column")).alias("at"), F.col("listed.id").alias("ids"), F.col("listed.deviation").alias("deviations"), matrix.cast(_STORED).alias("matrix")))


def as_matrix(blocks: DataFrame, rows: int, n: int, dims: int) -> BlockMatrix:
    """The BlockMatrix of written blocks: what is stored is read again as matrices."""
    schema = StructType([StructField("at", blocks.schema["at"].dataType), StructField("matrix", MatrixUDT())])
    read = blocks.sparkSession.read.schema(schema).parquet(blocks.kept_path)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", read, rows, dims, n, dims), rows, dims)


def as_rows(matrix: BlockMatrix) -> DataFrame:
    """block, rows (array of arrays): the blocks of a BlockMatrix of one block column, written and read as stored."""
    written = callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model)
    stored = kept(written.toDF("at", "matrix"))
    read = stored.sparkSession.read.schema(f"at struct<_1:int,_2:int>, matrix {_STORED}").parquet(stored.kept_path)
    own = read.select(F.col("at._1").cast("bigint").alias("block"), "matrix.numRows", "matrix.numCols", "matrix.values", "matrix.isTransposed")
    place = lambda i, k: F.when(F.col("isTransposed"), i * F.col("numCols") + k).otherwise(k * F.col("numRows") + i)
    row = lambda i: F.transform(F.sequence(F.lit(0), F.col("numCols") - 1), lambda k: F.get("values", place(i, k)))
    return own.select("block", F.transform(F.sequence(F.lit(0), F.col("numRows") - 1), row).alias("rows"))


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right with the middle dimension in so many parts; Python's own method has no such argument."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The transpose of a matrix times itself, as a local array."""
    out = _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    return (out + out.T) / 2


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns with their largest entry above 0, which have a direction of their own)."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1][:most], 0.0), vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, vectors, values > len(covariance) * 1e-13 * max(float(values[0]), 1e-300)


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """id_col, n, deviation, whitened (array<double>, null entries without a direction), explained (array<double>), identity_error; a row for each row that takes part."""
    spark = rows.sparkSession
    own = indexed(integers(rows, id_col, vec_col)).select("id", "index", "x")
    first = own.select(F.size("x").alias("dims")).first()
    schema = f"{id_col} bigint, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    if first is None:
        return spark.createDataFrame([], schema)
    dims = first["dims"]
    sums = own.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[k].cast("decimal(28,0)")).alias(f"s{k}") for k in range(dims))).first()
    n, total = sums["n"], [int(sums[f"s{k}"]) for k in range(dims)]
    # n * x - S, exactly: what exceeds a bigint becomes null and is divided as a double.
    whole = F.array(*(F.lit(s).cast("decimal(38,0)") for s in total))
    spread = own.agg(*(F.max(F.abs(F.col("x")[k] - F.lit(total[k] // n))).alias(f"m{k}") for k in range(dims))).first()
    fits = dims * (n * (max(spread) + 1)) ** 2 < 1 << 63
    if fits:
        off = F.zip_with("x", F.array(*(F.lit(s).cast("bigint") for s in total)), lambda x, s: x * F.lit(n).cast("bigint") - s)
        deviation = F.aggregate("off", F.lit(0).cast("bigint"), lambda a, v: a + v * v)
    else:
        off = F.zip_with("x", whole, lambda x, s: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") - s).cast("decimal(38,0)"))
        square = F.aggregate("off", F.lit(0).cast("decimal(38,0)"), lambda a, v: F.try_add(a, F.try_multiply(v, v).cast("decimal(38,0)")).cast("decimal(38,0)"))
        deviation = square.try_cast("bigint")
    centred = own.withColumn("off", off).select("id", "index", deviation.alias("deviation"), F.transform("off", lambda v: v.cast("double") / float(n)).alias("centred"))
    size = block_rows(n, dims)
    blocks = blocks_of(centred, size, dims)
    matrix = as_matrix(blocks, size, n, dims)
    splits = max(1, math.isqrt(-(-n // size)))
    covariance = scatter(matrix, splits) / n
    values, axes, fine = components(covariance, most)
    trace = float(np.trace(covariance))
    scaled = axes[:, fine] / np.sqrt(values[fine])
    width = scaled.shape[1]
    explained = [float(v) / trace if trace > 0 else None for v in values]
    if not width:
        blank = F.array(*[F.lit(None).cast("double")] * len(values))
        return centred.select(F.col("id").alias(id_col), F.lit(n).cast("bigint").alias("n"), "deviation", blank.alias("whitened"), F.array(*(F.lit(e).cast("double") for e in explained)).alias("explained"), F.lit(0.0).alias("identity_error"))
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, width, scaled.ravel(order="F").tolist()))], 1), dims, width)
    projected = _product(matrix, right, 1)
    error = float(np.abs(scatter(projected, splits) / n - np.eye(width)).max())
    places = iter(range(width))
    white = F.array(*(F.col("white")[next(places)] if f else F.lit(None).cast("double") for f in fine.tolist()))
    both = blocks.select(F.col("at.block").alias("block"), "ids", "deviations").join(as_rows(projected), "block").select(F.explode(F.arrays_zip("ids", "deviations", F.col("rows").alias("white"))).alias("row"))
    both = both.select(F.col("row.ids").alias("id"), F.col("row.deviations").alias("deviation"), F.col("row.white").alias("white"))
    return both.select(F.col("id").alias(id_col), F.lit(n).cast("bigint").alias("n"), "deviation", white.alias("whitened"), F.array(*(F.lit(e).cast("double") for e in explained)).alias("explained"), F.lit(error).alias("identity_error"))
