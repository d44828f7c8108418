"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by fast Hadamard pseudo-rotations (three rounds of random signs and a
Walsh-Hadamard transform); its nearest signed axes, one for each hash, name its bucket in
each of several tables. A query probes the buckets of each table whose axes it is nearest to,
best first; what it meets there is ranked by the exact cosine of the original vectors in
double precision.

Hashes and probes follow from the number of vectors and a recall target by one rule, with no
switch (``fit``). Vectors whose directions are spread evenly are the hardest to search: their
nearest neighbours are the farthest away. For them the cosine of the first to k-th neighbour
follows from the number of vectors and dimensions. About ``sample`` vectors, chosen by their digests,
show how near neighbours are in the data: among fewer vectors neighbours are farther away, so
both are bounds from below, and the greater counts, quantile by quantile. Pairs of those cosines are
drawn and hashed, and as many buckets are probed as the target's share of them needs. Hashes are
added so that a bucket holds at most about ``bucket_rows`` of evenly spread vectors; two at least.

Identical vectors are one entry that keeps its smallest ids, as many as a result can need,
so copies cost nothing and lose nothing. Buckets with one first axis are a cell; a query goes
once to each cell that holds any of its buckets, with their numbers.
Vectors and queries travel to their cells packed, some at a time. Cells are counted first, and
one above ``block`` vectors or ``query_block`` queries is cut into blocks of both sides, so that
no step holds more than some blocks of each, however hot a bucket is. Inside a block only
vectors of a query's own buckets are compared with it, and a task passes on its best few.

Defined results: vectors that are null, empty, all zero or hold null, NaN or infinite
components take no part, nor do rows without an id; ties go to the smaller id; repeated
rows count once; vectors of other lengths than the query's aren't candidates; a query that met fewer vectors than
k is compared with all, so one with fewer candidates than k gets them all, however far off; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import each_group, kept


@dataclass(frozen=True)
class Settings:
    """recall: the target. least: vectors that a query should meet. hashes, probes: set them to overrule the rule. pairs: drawn to find it. sample: vectors (about) that show how near neighbours are; all vectors are indexed."""

    tables: int = 20
    recall: float = 0.94
    least: int = 64
    bucket_rows: int = 4096
    hashes: int | None = None
    probes: int | None = None
    cells: int = 128
    block: int = 1024
    query_block: int = 512
    pairs: int = 1000
    sample: int = 4096
    seed: int = 11


@lru_cache(maxsize=8)
def _hadamard_matrix(size: int) -> np.ndarray:
    out = np.ones((1, 1))
    while len(out) < size:
        out = np.block([[out, out], [out, -out]])
    return out


def hadamard(x: np.ndarray, radix: int = 64) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, `radix` elements at a time; the length is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        r = min(radix, width // h)
        y = x.reshape(n, width // (r * h), r, h)
        x = (np.swapaxes(y, 2, 3) @ _hadamard_matrix(r)).swapaxes(2, 3).reshape(n, width) if h > 1 else (x.reshape(-1, r) @ _hadamard_matrix(r)).reshape(n, width)
        h *= r
    return x


@lru_cache(maxsize=4096)
def _signs(table: int, which: int, seed: int, width: int) -> np.ndarray:
    """(3, width) random signs, one row for each round."""
    return np.random.default_rng([seed, table, which, width]).choice((-1.0, 1.0), (3, width))


def padded(dims: int) -> int:
    """The power of two that vectors of a length are padded to."""
    return 1 << max(0, int(dims - 1).bit_length())


def rotate(x: np.ndarray, table: int, which: int, seed: int) -> np.ndarray:
    """Pseudo-rotation `which` of a table; rows are padded to a power of two."""
    width = padded(x.shape[1])
    if width > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for signs in _signs(table, which, seed, width):
        x = hadamard(x * (signs / width**0.5))
    return x


def signed_axes(x: np.ndarray, table: int, which: int, seed: int) -> np.ndarray:
    """(n, 2 width) heights over the signed axes: axis a is at a, its opposite at a + width."""
    turned = rotate(x, table, which, seed)
    return np.concatenate([turned, -turned], axis=1)


def own_bucket(x: np.ndarray, table: int, hashes: int, seed: int) -> np.ndarray:
    """The bucket of each row: its nearest axes, as digits of one number."""
    name = np.zeros(len(x), np.int64)
    for which in range(hashes):
        turned = rotate(x, table, which, seed)
        axis = np.abs(turned).argmax(1)
        name = name * (2 * turned.shape[1]) + axis + turned.shape[1] * (turned[np.arange(len(x)), axis] < 0)
    return name


def probed_buckets(x: np.ndarray, table: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(n, probes) buckets with the greatest sums of heights, best first; all buckets if there are no more."""
    best = heights = None
    for which in range(hashes):
        s = signed_axes(x, table, which, seed)
        top = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        high = np.take_along_axis(s, top, 1)
        if best is None:
            best, heights = top.astype(np.int64), high
            continue
        # The pair of an i-th and a j-th best is behind (i + 1) (j + 1) - 1 others: only some can be among the best.
        i, j = _pairs(best.shape[1], top.shape[1], probes)
        both = heights[:, i] + high[:, j]
        order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        best, heights = best[np.arange(len(x))[:, None], i[order]] * s.shape[1] + top[np.arange(len(x))[:, None], j[order]], np.take_along_axis(both, order, 1)
    return best


@lru_cache(maxsize=64)
def _pairs(n: int, m: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    widths = [min(m, most // (i + 1)) for i in range(min(n, most))]
    return np.repeat(np.arange(len(widths)), widths), np.concatenate([np.arange(w) for w in widths])


def neighbour_cosines(count: int, dims: int, ranks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cosines of neighbours of some ranks (from 1), drawn for queries among `count` evenly spread unit vectors."""
    c = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - c * c, 1e-300) ** ((dims - 3) / 2) if dims > 1 else np.ones(len(c))
    above = np.cumsum(density[::-1])[::-1] / density.sum()  # falls from 1 to 0
    wanted = np.minimum(1.0, rng.gamma(ranks) / max(1, count - 1))  # the share of vectors at least as near
    return c[len(c) - np.searchsorted(above[::-1], wanted) - 1]


def sampled_cosines(x: np.ndarray, k: int, most: int) -> tuple[float, ...]:
    """`most` quantiles, rising, of the cosines of up to `most` unit vectors with their first k neighbours among all given; none if there are fewer than k others."""
    if len(x) <= k:
        return ()
    asked = np.arange(min(len(x), most))
    c = x[asked] @ x.T
    c[asked, asked] = -2
    best = np.clip(np.partition(c, -k, axis=1)[:, -k:], -1, 1)
    return tuple(np.quantile(best, (np.arange(most) + 0.5) / most).tolist())


@lru_cache(maxsize=256)
def fit(count: int, dims: int, k: int, s: Settings, seen: tuple[float, ...] = ()) -> tuple[int, int]:
    """(hashes, probes) for `count` vectors of a length: as many probes as the pairs' share ``recall`` needs in the best of all tables. seen: rising cosines of ``pairs`` neighbours in a sample."""
    axes = 2 * padded(dims)
    hashes = s.hashes or max(2, math.ceil(math.log(max(1, count / s.bucket_rows), axes)))
    whole = axes**hashes
    if s.probes:
        return hashes, min(s.probes, whole)
    rng = np.random.default_rng([s.seed, dims])
    q, other = rng.standard_normal((2, s.pairs, dims))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    other -= (other * q).sum(1, keepdims=True) * q
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    cosine = neighbour_cosines(count, dims, np.resize(np.arange(1, k + 1), s.pairs), rng)
    cosine = (np.maximum(np.sort(cosine), seen) if seen else cosine)[:, None]
    near = cosine * q + np.sqrt(np.maximum(0, 1 - cosine**2)) * other
    rank = np.full(s.pairs, whole, np.int64)
    rows = np.arange(s.pairs)
    for t in range(s.tables):
        heights, met = [], np.zeros(s.pairs)
        for which in range(hashes):
            a = signed_axes(q, t, which, s.seed)
            met += a[rows, signed_axes(near, t, which, s.seed).argmax(1)]
            heights.append(np.sort(a, axis=1))
        for i in range(s.pairs):  # buckets that the query would probe before the one that it shares
            firsts = heights[0][i]
            for h in heights[1:-1]:
                firsts = (firsts[:, None] + h[i]).ravel()
            rank[i] = min(rank[i], int((axes - np.searchsorted(heights[-1][i], met[i] - firsts - 1e-12)).sum()) if hashes > 1 else int((firsts >= met[i] - 1e-12).sum()))
    wanted = int(np.sort(rank)[min(s.pairs - 1, math.ceil(s.recall * s.pairs) - 1)])
    meets = math.ceil(whole * s.least / max(1, count * s.tables))
    return hashes, max(1, min(whole, max(wanted, meets)))


def _cell(bucket: np.ndarray, dims: int, hashes: int, s: Settings) -> np.ndarray:
    """Buckets with one first axis share a cell: a query's best buckets lie in few of them, however many vectors there are."""
    return bucket // (2 * padded(dims)) ** (hashes - 1) % s.cells


def _matrix(column: pa.Array, dtype: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors as a float64 matrix) for each vector length in a column of packed vectors."""
    raw, out = column.to_pylist(), []
    sizes = np.array([len(b) for b in raw])
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        x = np.frombuffer(b"".join(raw[i] for i in own), dtype).reshape(len(own), -1).astype(np.float64)
        out.append((own, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


_PACKED = "tab int, cell bigint, dims int, kind int, n bigint, entries binary, extra binary, buckets binary, counts binary, body binary"
_ROWS, _QUERIES = 0, 1
#: Bytes of vectors that are hashed at once, and items in a packed row at most.
HASHED_BYTES, PACKED_ROWS = 1 << 19, 64


def _chunks(key: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of equal keys, at most `size` at a time."""
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])).tolist()
    for first, last in zip(edges, [*edges[1:], len(key)], strict=True):
        for at in range(first, last, size):
            yield order[at : min(at + size, last)]


def _dealt(batches: Iterator[pa.RecordBatch], s: Settings, fits: dict[int, tuple[int, int]], dtype: str, kind: int) -> Iterator[pa.RecordBatch]:
    """Vectors (entry, first_id, body) packed by table and cell: each once in every table with its bucket, or as a query in every cell that it probes, with its buckets there."""
    for batch in batches:
        if not batch.num_rows:
            continue
        entry, first = batch.column("entry").to_numpy(), batch.column("first_id").to_numpy()
        for rows, x in _matrix(batch.column("body"), dtype):
            dims, raw = x.shape[1], np.frombuffer(b"".join(batch.column("body").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
            hashes, probes = fits[dims]
            step = max(16, HASHED_BYTES // (8 * max(dims, probes if kind == _QUERIES else 1)))
            for at in range(0, len(x), step):
                some, out = x[at : at + step], []
                for t in range(s.tables):
                    bucket = own_bucket(some, t, hashes, s.seed)[:, None] if kind == _ROWS else probed_buckets(some, t, hashes, probes, s.seed)
                    who, bucket = np.repeat(np.arange(len(some)), bucket.shape[1]), bucket.ravel()
                    cell = _cell(bucket, dims, hashes, s)
                    order = np.lexsort((bucket, who, cell))
                    who, cell, bucket = who[order], cell[order], bucket[order]
                    # One item for each pair of a vector and a cell; a query's has several buckets.
                    heads = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])]))
                    sizes = np.diff(np.append(heads, len(who)))
                    for own in _chunks(cell[heads], PACKED_ROWS):
                        at_rows = rows[at + who[heads[own]]]
                        listed = bucket[_ranges(heads[own], sizes[own])]
                        out.append((t, cell[heads[own[0]]], dims, kind, len(own), entry[at_rows].tobytes(), first[at_rows].tobytes(), listed.tobytes(), sizes[own].astype(np.int32).tobytes(), raw[at + who[heads[own]]].tobytes()))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["tab", "cell", "dims", "kind", "n", "entries", "extra", "buckets", "counts", "body"])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class _Side:
    """The rows or the queries of a block, unpacked."""

    def __init__(self, table: pa.Table, dims: int, dtype: str):
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        self.entry, self.first, self.bucket, self.count = (read(name, kind) for name, kind in (("entries", np.int64), ("extra", np.int64), ("buckets", np.int64), ("counts", np.int32)))
        self.x = read("body", dtype).reshape(-1, dims).astype(np.float64)
        self.length = np.sqrt((self.x * self.x).sum(1))


#: query, entry, first_id, score
_Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _best(found: _Found, keep: int) -> _Found:
    """The best `keep` of each query, each entry once."""
    query, entry, first, score = found
    order = np.lexsort((entry, first, -score, query))
    query, entry = query[order], entry[order]
    once = np.concatenate([[True], (query[1:] != query[:-1]) | (entry[1:] != entry[:-1])]) if len(order) else np.zeros(0, bool)
    order, query = order[once], query[once]
    heads = np.concatenate([[True], query[1:] != query[:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - (np.flatnonzero(heads)[np.cumsum(heads) - 1] if len(order) else 0)
    own = order[place < keep]
    return tuple(c[own] for c in found)


def _nearest(rows: _Side, queries: _Side, keep: int, step: int = 1 << 16) -> Iterator[_Found]:
    """For each query of a block, its best `keep` rows of the block in the buckets that it probes."""
    order = np.argsort(rows.bucket, kind="stable")
    bucket = rows.bucket[order]
    asker = np.repeat(np.arange(len(queries.entry)), queries.count)
    starts = np.searchsorted(bucket, queries.bucket)
    sizes = np.searchsorted(bucket, queries.bucket, side="right") - starts
    met = sizes > 0
    asker, starts, sizes = asker[met], starts[met], sizes[met]
    ends, at = np.cumsum(sizes), 0
    while at < len(asker):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        row, who = order[_ranges(starts[at:end], sizes[at:end])], np.repeat(asker[at:end], sizes[at:end])
        score = (rows.x[row] * queries.x[who]).sum(1) / (rows.length[row] * queries.length[who])
        yield _best((queries.entry[who], rows.entry[row], rows.first[row], score), keep)
        at = end


def _compared(batches: Iterator[pa.RecordBatch], dtype: str, keep: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The best `keep` rows of each query over all blocks of a task, or of as many as memory allows."""
    waiting: list[_Found] = []
    size = 0

    def out(found: _Found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query", "entry", "first_id", "score"])

    for block in each_group(batches, 5):
        kind, dims = block.column("kind").to_numpy(), block.column("dims")[0].as_py()
        sides = [block.filter(pa.array(kind == which)) for which in (_ROWS, _QUERIES)]
        if not all(side.num_rows for side in sides):
            continue
        for found in _nearest(*(_Side(side, dims, dtype) for side in sides), keep):
            waiting.append(found)
            size += len(found[0])
        if size > most:
            waiting = [_best(tuple(np.concatenate(c) for c in zip(*waiting, strict=True)), keep)]
            size = len(waiting[0][0])
            if size > most // 2:
                yield out(waiting.pop())
                size = 0
    if waiting:
        yield out(_best(tuple(np.concatenate(c) for c in zip(*waiting, strict=True)), keep))


def _usable(vec: str) -> Column:
    x = F.col(vec)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0)


def _pack(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [np.asarray(v, dtype).tobytes() for v in batch.column("vec").to_pylist()]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "vec"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(bodies, pa.binary())], [*(batch.schema.names[i] for i in keep), "body"])


def _best_met(rows: DataFrame, queries: DataFrame, s: Settings, fits: dict[int, tuple[int, int]], dtype: str, keep: int) -> DataFrame:
    """query, entry, score, first_id, n: the best `keep` of the rows (entry, first_id, body) that each query meets in the buckets it probes."""
    dealt = rows.mapInArrow(lambda it: _dealt(it, s, fits, dtype, _ROWS), _PACKED)
    dealt = dealt.union(queries.mapInArrow(lambda it: _dealt(it, s, fits, dtype, _QUERIES), _PACKED))
    dealt = kept(dealt)
    at = ["tab", "cell", "dims"]
    of = lambda kind, size: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("kind") == kind, F.col("n"))) / size)).cast("int")
    sizes = dealt.groupBy(at).agg(of(_ROWS, s.block).alias("row_blocks"), of(_QUERIES, s.query_block).alias("query_blocks"), F.bool_or(F.col("kind") == _QUERIES).alias("asked")).where("asked").drop("asked")
    spot = F.pmod(F.xxhash64("entries"), F.lit(1 << 30))
    is_row = F.col("kind") == _ROWS
    mine, others = F.when(is_row, F.col("row_blocks")).otherwise(F.col("query_blocks")), F.when(is_row, F.col("query_blocks")).otherwise(F.col("row_blocks"))
    placed = dealt.join(sizes, at).withColumn("mine", (spot % mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    placed = placed.select(*at, F.when(is_row, F.col("mine")).otherwise(F.col("other")).alias("row_block"), F.when(is_row, F.col("other")).otherwise(F.col("mine")).alias("query_block"), "kind", "entries", "extra", "buckets", "counts", "body")
    placed = placed.repartition(*at, "row_block", "query_block").sortWithinPartitions(*at, "row_block", "query_block", "kind")
    met = placed.mapInArrow(lambda it: _compared(it, dtype, keep), "query bigint, entry bigint, first_id bigint, score double")
    once = met.groupBy("query", "entry").agg(F.max("score").alias("score"), F.any_value("first_id").alias("first_id"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first_id"))).where(F.col("n") <= keep)


def _seen(packed: DataFrame, total: int, dtype: str, k: int, s: Settings) -> dict[int, tuple[float, ...]]:
    """Cosines of neighbours in the sample, by vector length: entries whose digest is small, at most twice ``sample`` of them."""
    least = min(2**64 - 1, int(2**64 * s.sample / max(1, total))).to_bytes(8, "big")
    chosen = packed.where(F.col("key") <= F.lit(least)).select("body").limit(2 * s.sample).toArrow()
    return {x.shape[1]: sampled_cosines(x, k, s.pairs) for _, x in _matrix(chosen.column("body"), dtype)}


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each row that satisfies is_query."""
    s, keep = settings, k + 1
    kind, dtype = ("float", "<f4") if dict(rows.dtypes)[vec_col] == "array<float>" else ("double", "<f8")
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & _usable("vec")).withColumn("vec", F.transform("vec", lambda v: v + F.lit(0).cast(kind)))
    base = base.withColumn("key", F.unhex(F.sha2(F.concat_ws(",", "vec"), 256)))
    # Identical vectors become one entry with their first k + 1 ids; a salt keeps a vector that many rows share off one task.
    salted = base.groupBy("key", "id").agg(F.any_value("vec").alias("vec"), F.bool_or("asks").alias("asks")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    asking = salted.groupBy("key").agg(F.bool_or("asks").alias("asks"))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id"))).where(F.col("n") <= keep)
    entries = first.groupBy("key").agg(F.any_value("vec").alias("vec"), F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
    entries = entries.join(asking, "key").withColumn("entry", F.monotonically_increasing_id())
    packed = kept(entries.select("entry", "key", "ids", "asks", "vec").mapInArrow(lambda it: _pack(it, dtype), "entry bigint, key binary, ids array<bigint>, asks boolean, body binary"))
    # A count for each vector length, and the sample; nothing else of the data comes to the driver.
    wide = 4 if kind == "float" else 8
    counts = {r["dims"]: r["n"] for r in packed.groupBy((F.length("body") / wide).cast("int").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = {} if s.probes else _seen(packed, sum(counts.values()), dtype, k, s)
    fits = {dims: fit(n, dims, k, s, seen.get(dims, ())) for dims, n in counts.items()}
    own = packed.select("entry", F.col("ids")[0].alias("first_id"), "body", "asks", F.size("ids").alias("copies"))
    best = kept(_best_met(own.select("entry", "first_id", "body"), own.where("asks").select("entry", "first_id", "body"), s, fits, dtype, keep))
    # A query that met fewer than it can have, as where all others are far off, meets every row: one table of one hash, whose buckets it probes all.
    enough = best.join(own.select("entry", "copies"), "entry").groupBy("query").agg(F.sum("copies").alias("met")).where(F.col("met") >= keep)
    lacking = kept(own.where("asks").join(enough, own["entry"] == enough["query"], "left_anti").select("entry", "first_id", "body"))
    if lacking.limit(1).count():
        every = {dims: (1, 2 * padded(dims)) for dims in counts}
        again = _best_met(own.select("entry", "first_id", "body"), lacking, replace(s, tables=1), every, dtype, keep)
        best = best.join(lacking.select(F.col("entry").alias("query")), "query", "left_anti").unionByName(again)
    lists = best.join(packed.select("entry", "ids"), "entry").groupBy("query").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id"))))).alias("found"))
    lists = lists.join(packed.select(F.col("entry").alias("query"), "key"), "query").select("key", F.slice(F.array_sort("found"), 1, keep).alias("found"), F.lit(True).alias("asks"))
    # Both sides are shuffled by two columns, so that a vector that many queries share can be split.
    asked = salted.where("asks").select("key", "id", "asks").join(lists, ["key", "asks"])
    ranked = asked.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
