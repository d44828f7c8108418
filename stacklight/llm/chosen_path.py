"""Jaccard join on word shingles by the chosen-path method.

Equal shingle sets are one entry with a count, so copies are never paired. Every entry
chooses, in each of several runs, the shingles whose hash for that run is below
``picks`` / set size; similar sets choose some of the same, whatever their sizes, and
meet in those buckets. In the large buckets of the first ``tying`` runs all entries first meet a few pivots, which tie most of a group of near
copies together. After that a bucket of one tie is left alone, as its links would join nothing, and one with few entries beside
one large tie is settled by comparing these with all of it. Any other bucket above ``small`` entries is split: of a sample of ``SAMPLE``
shingles that each entry keeps, it goes on along every one whose hash with the bucket is below
``splits`` / ``SAMPLE``. What is still large is split again and again by one sampled shingle each time,
the first of the set in an order that the bucket draws (a minhash): a path is a sequence of sampled
shared shingles, and a group of near copies doesn't multiply with its depth. Small buckets are compared by brute
force on sketches, and a bucket that is still large after ``depth`` splits is clustered around
leaders, in blocks; its leaders then meet in pairs of blocks, and two are linked where the
sketches and sizes of what follows them leave a link possible. What may be similar is thus linked;
the linked entries of a component are then compared exactly, on their whole sets, in blocks
of bounded size, and counted where they are compared: no list of pairs is ever made.

Only the list of large buckets, behind a count of it, is broadcast to tell their rows; rows of
large buckets are never dealt by bucket alone. Runs are repeated until ``recall``, the share of pairs
of the threshold's similarity that survive some run even where each bucket is split ``depth`` times,
reaches ``target``.

Defined results: texts without words are alike to none; texts of fewer than five words have
one shingle; rows without a doc_id are returned without a class and without links; rows
that repeat a doc_id are one document, whose set is the one with the smallest name if their
texts differ; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import byte_column, each_group, in_slices, joined_on_id, kept, let_go, mapped, utf8, whole_groups
from stacklight.llm.components import components
from stacklight.llm.shingles import mix, shingle_sets


@dataclass(frozen=True)
class Settings:
    """threshold is numerator / denominator. tying: runs whose large buckets are tied by pivots first. aside: entries outside a bucket's one large tie that are compared with all of it, unsplit. plausible, alike: shares of equal sketch values that link two entries, and make one follow a leader."""

    size: int = 5
    numerator: int = 4
    denominator: int = 5
    target: float = 0.998
    picks: float = 3.0
    splits: float = 1.5
    depth: int = 3
    small: int = 128
    tying: int = 2
    pivots: int = 32
    aside: int = 512
    block: int = 1024
    exact_block: int = 512
    plausible: float = 0.6
    alike: float = 0.9
    seed: int = 5


#: Minhashes in a sketch, shingles in a sample (about; 4 bytes each).
SKETCH, SAMPLE = 64, 64
#: Large buckets (24 bytes each) that may be broadcast, and salts beyond.
BROADCAST_BUCKETS, SALTS = 500_000, 64


def survival(settings: Settings = Settings(), similarity: float | None = None) -> float:
    """The expected number of common paths of a run at which a pair of a similarity still meets, for the worst ratio of sizes, when every bucket is split ``depth`` times."""
    shared = settings.numerator / settings.denominator if similarity is None else similarity  # of the larger set, when the smaller lies inside it
    alive = 1 - math.exp(-settings.splits * shared * shared ** (settings.depth - 1)) if settings.depth else 1.0
    return settings.picks * shared * alive


def runs_of(settings: Settings = Settings()) -> int:
    """As many runs as the target recall needs."""
    return math.ceil(-math.log(1 - settings.target) / survival(settings))


def recall(settings: Settings = Settings(), similarity: float = 0.8) -> float:
    """The expected share of pairs of a similarity that meet in some bucket of some run."""
    return 1 - math.exp(-runs_of(settings) * survival(settings, similarity))


def sketch(tokens: np.ndarray, seed: int) -> np.ndarray:
    """SKETCH minhashes, a byte each."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        part = tokens[at : at + 4096, None] * factors
        np.minimum(low, (part ^ (part >> np.uint64(32))).min(0), out=low)
    return (mix(low) >> np.uint64(56)).astype(np.uint8)


def _below(share: float) -> np.uint64:
    return np.uint64(min(0.999999, share) * 2.0**64)


def _signed(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    runs, none = runs_of(s), np.zeros(0, np.uint64)
    seeds = mix(np.arange(1, runs + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s.seed))
    for batch in in_slices(batches, 1):
        names, sizes, sketches, paths, early, samples = [], [], [], [], [], []
        for tokens in shingle_sets(*byte_column(batch.column(1)), s.size):
            n = len(tokens)
            names.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
            sizes.append(n)
            sketches.append(sketch(tokens, s.seed).tobytes() if n else b"")
            most, own = _below(s.picks / max(n, 1)), []
            for seed in seeds[:-1] if n else ():
                path = mix(tokens ^ seed)
                own.append(mix(path[path < most] ^ seed))
            paths.append(np.concatenate(own) if own else none)
            early.append(sum(map(len, own[: s.tying])))
            drawn = mix(tokens ^ seeds[-1])
            samples.append((drawn[drawn < _below(SAMPLE / max(n, 1))] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        sampled = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, samples)]), pa.int32()), pa.array(np.concatenate(samples) if samples else np.zeros(0, np.int32)))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, paths)]), pa.int32()), pa.array(np.concatenate(paths).view(np.int64) if paths else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), lists, pa.array(early, pa.int32()), sampled], ["doc_id", "name", "n", "sketch", "paths", "early", "sample"])


def signatures(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, name (of the shingle set), n (its size), sketch, paths (the first buckets of all runs), early (how many of them, the leading ones, are of the first ``tying`` runs), sample (of its shingles)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(F.lower(F.col(text_col))).alias("body"))
    return mapped(rows, lambda it: _signed(it, settings), "doc_id bigint, name binary, n bigint, sketch binary, paths array<bigint>, early int, sample array<int>")


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)


def _fits(n: np.ndarray, m: np.ndarray, s: Settings) -> np.ndarray:
    """Sizes that allow the threshold."""
    return np.minimum(n, m) * s.denominator >= np.maximum(n, m) * s.numerator


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            top = self.up[self.up]
            if (top == self.up).all():
                return top
            self.up = top

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links all pairs (a, b): roots hook under smaller roots until nothing changes."""
        while len(a):
            r = self.roots()
            x, y = r[a], r[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _links(entry: np.ndarray, forest: _Forest) -> pa.RecordBatch:
    roots = forest.roots()
    own = roots != np.arange(len(roots))
    return pa.RecordBatch.from_arrays([pa.array(entry[own], pa.int64()), pa.array(entry[roots[own]], pa.int64())], ["a", "b"])


def _brute(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Plausible links inside small buckets; rows come sorted by bucket and entry."""
    for table in whole_groups(batches, 1):
        bucket, entry, n, sk = table.column("bucket").to_numpy(), table.column("entry").to_numpy(), table.column("n").to_numpy(), _sketches(table)
        forest, gap = _Forest(len(bucket)), 1
        here = np.arange(len(bucket))
        while True:
            here = here[here + gap < len(bucket)]
            here = here[bucket[here] == bucket[here + gap]]
            if not len(here):
                break
            for at in range(0, len(here), 65_536):
                some = here[at : at + 65_536]
                some = some[_fits(n[some], n[some + gap], s)]
                near = some[(sk[some] == sk[some + gap]).sum(1) >= s.plausible * SKETCH]
                forest.join(near, near + gap)
            gap += 1
        yield _links(entry, forest)


def _lead(table: pa.Table, s: Settings) -> pa.Table:
    """Links of a block (b set), and its leaders (sketch set): each leader meets all rows; what is very like a leader and of a fitting size follows it and never leads.

    radius: most sketch values that differ between a leader and its followers. low, high: their sizes.
    """
    order = np.argsort(table.column("entry").to_numpy(), kind="stable")
    entry, n, sk = table.column("entry").to_numpy()[order], table.column("n").to_numpy()[order], _sketches(table)[order]
    forest, open_rows, leaders = _Forest(len(entry)), np.ones(len(entry), bool), []
    for i in range(len(entry)):
        if not open_rows[i]:
            continue
        equal, fits = (sk == sk[i]).sum(1), _fits(n, n[i], s)
        near = np.flatnonzero((equal >= s.plausible * SKETCH) & fits)
        forest.join(near, np.full(len(near), i))
        own = open_rows & fits & (equal >= s.alike * SKETCH)
        open_rows[own] = False
        leaders.append((i, SKETCH - equal[own].min(), n[own].min(), n[own].max()))
    links = _links(entry, forest)
    row, radius, low, high = (np.array(x, np.int64) for x in zip(*leaders, strict=True))
    k, m = links.num_rows, len(row)
    bucket = pa.array([table.column("bucket")[0].as_py()] * (k + m), pa.int64())
    numbers = [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(x)]) for x in (radius, low, high)]
    sketches = pa.concat_arrays([pa.nulls(k, pa.binary()), pa.array([x.tobytes() for x in sk[row]], pa.binary())])
    return pa.table([bucket, pa.concat_arrays([links.column(0), pa.array(entry[row])]), pa.concat_arrays([links.column(1), pa.nulls(m, pa.int64())]), *numbers, sketches], ["bucket", "a", "b", "radius", "low", "high", "sketch"])


def _leaders_meet(table: pa.Table, s: Settings) -> pa.Table:
    """Links between the leaders of two blocks (or of one, if first and second are the same) whose followers may be plausible links of fitting sizes."""
    order = np.argsort(table.column("entry").to_numpy(), kind="stable")
    entry, radius, low, high, block = (table.column(c).to_numpy()[order] for c in ("entry", "radius", "low", "high", "block"))
    sk, forest = _sketches(table)[order], _Forest(len(entry))
    rows, columns = np.flatnonzero(block == table.column("first")[0].as_py()), np.flatnonzero(block == table.column("second")[0].as_py())
    other = sk[columns]
    for i in rows.tolist():
        # Differing values obey the triangle inequality: two followers differ in no fewer than their leaders do, less both radii.
        possible = (other == sk[i]).sum(1) + radius[columns] + radius[i] >= s.plausible * SKETCH
        possible &= (high[columns] * s.denominator >= low[i] * s.numerator) & (high[i] * s.denominator >= low[columns] * s.numerator)
        near = columns[possible]
        forest.join(near, np.full(len(near), i))
    return pa.Table.from_batches([_links(entry, forest)])


def _block_pairs(block: str, blocks: str) -> Column:
    """(low, high) of every pair of blocks that a row of one block takes part in."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1), lambda o: F.struct(F.least(block, o).alias("low"), F.greatest(block, o).alias("high")))


def _with_large(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows with members of their bucket where that is large, null elsewhere. Large buckets are broadcast behind a count; else rows are salted."""
    if large.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS:
        return rows.join(F.broadcast(large), "bucket", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("entry"), F.lit(SALTS)))
    each = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(each, ["bucket", "salt"], "left").drop("salt")


def _beside(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Plausible links of the loose entries of a block with all its entries; rows come sorted by bucket, part, loose and entry."""
    for table in each_group(batches, 2):
        entry, n, sk = table.column("entry").to_numpy(), table.column("n").to_numpy(), _sketches(table)
        forest = _Forest(len(entry))
        for i in np.flatnonzero(table.column("loose").to_numpy(zero_copy_only=False)).tolist():
            near = np.flatnonzero(_fits(n, n[i], s) & ((sk == sk[i]).sum(1) >= s.plausible * SKETCH))
            forest.join(near, np.full(len(near), i))
        yield _links(entry, forest)


def _star(rows: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) of the loose entries of large buckets (bucket, members, loose, entry, n, sketch) with all of their bucket; blocks have about ``block`` others each, and all loose ones."""
    s, blocks = settings, F.ceil(F.col("members") / settings.block)
    part = F.when(F.col("loose"), F.sequence(F.lit(0).cast("bigint"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("entry"), blocks)))
    dealt = rows.select("bucket", F.explode(part).alias("part"), "loose", "entry", "n", "sketch")
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "loose", "entry")
    return kept(mapped(dealt, lambda it: _beside(it, s), "a bigint, b bigint").distinct())


def _tied(entries: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) of all entries in large buckets of the first ``tying`` runs with about ``pivots`` of each bucket, which its hashes choose: what they miss is left to the splits."""
    s = settings
    # Pivots only tie early: a link that they miss is looked for in all runs.
    rows = entries.select("entry", "n", "sketch", F.explode(F.slice("paths", F.lit(1), F.col("early"))).alias("bucket"))
    large = kept(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > s.small))
    chosen = F.pmod(F.xxhash64("bucket", "entry"), F.lit(1_000_000)) < s.pivots * 1e6 / F.col("members")
    return _star(_with_large(rows, large).where("members is not null").withColumn("loose", chosen), s)


def _met(entries: DataFrame, settings: Settings) -> list[DataFrame]:
    """Links (a, b) between entries (entry, tie, loose, n, sketch, paths, sample) that meet.

    Entries of one tie are linked already; those that aren't loose are in ties of more than ``small``. A bucket
    of one tie goes no further. A large bucket of one large tie and at most ``aside`` loose entries isn't split: each loose
    entry is compared with all others in it, in blocks.
    """
    s, found = settings, []
    own = ["entry", "tie", "loose", "n", "sketch"]
    rows, last = entries.select(*own, "sample", F.explode("paths").alias("bucket")), None
    for level in range(s.depth + 1):
        tied = F.when(~F.col("loose"), F.col("tie"))
        large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.count_if("loose").alias("out"), (F.min(tied) == F.max(tied)).alias("one")).where(F.col("members") > s.small)
        near = F.col("one") & (F.col("out") <= s.aside)
        large = kept(large.select("bucket", "members", F.when(near & (F.col("out") == 0), "done").when(near, "near").otherwise("split").alias("way")))
        both = _with_large(rows, large)
        # No bucket of these has more than ``small`` rows.
        here = Window.partitionBy("bucket")
        parts = both.where("members is null").select("bucket", "entry", "tie", "n", "sketch").repartition("bucket").withColumn("least", F.min("tie").over(here)).withColumn("most", F.max("tie").over(here))
        parts = parts.where("least < most").select("bucket", "entry", "n", "sketch").sortWithinPartitions("bucket", "entry")
        found.append(kept(mapped(parts, lambda it: _brute(it, s), "a bigint, b bigint").distinct()))
        found.append(_star(both.where("way = 'near'"), s))
        both = both.where("way = 'split'")
        if level == s.depth:
            break
        if level == 0:
            share = s.splits * 1e6 / F.least(F.lit(SAMPLE).cast("bigint"), F.col("n"))
            chosen = F.filter("sample", lambda t: F.pmod(F.xxhash64("bucket", t), F.lit(1_000_000)) < share)
            step = F.explode(F.transform(chosen, lambda t: t.cast("string")))
        else:
            place = F.pmod(F.xxhash64("bucket", F.lit(level)), F.lit(SKETCH)).cast("int")
            step = F.substring(F.hex("sketch"), 2 * place + 1, F.lit(2))
        done, last = last, kept(both.select(*own, "bucket", step.alias("step")).select(*own, F.xxhash64("bucket", F.lit(level), "step").alias("bucket")))
        rows = last
        let_go(*(x for x in (done, large) if x is not None))
    blocks = F.ceil(F.col("members") / s.block)
    blocked = both.select("bucket", "entry", "n", "sketch", F.pmod(F.xxhash64("entry"), blocks).alias("part"))
    led = kept(blocked.groupBy("bucket", "part").applyInArrow(lambda t: _lead(t.drop_columns(["part"]), s), "bucket bigint, a bigint, b bigint, radius bigint, low bigint, high bigint, sketch binary"))
    leaders = led.where("sketch is not null").select("bucket", F.col("a").alias("entry"), "radius", "low", "high", "sketch")
    blocks = leaders.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / s.block).alias("blocks"))
    leaders = leaders.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks"))).withColumn("pair", F.explode(_block_pairs("block", "blocks")))
    leaders = leaders.select("bucket", F.col("pair.low").alias("first"), F.col("pair.high").alias("second"), "entry", "radius", "low", "high", "sketch", "block")
    again = leaders.groupBy("bucket", "first", "second").applyInArrow(lambda t: _leaders_meet(t, s), "a bigint, b bigint")
    return [*found, led.where("b is not null").select("a", "b"), again]


def candidate_links(entries: DataFrame, settings: Settings) -> DataFrame:
    """a, b: links between entries (entry, n, sketch, paths, early, sample) that may reach the threshold; a spanning forest of each bucket's, not all pairs."""
    s = settings
    entries = kept(entries.select("entry", "n", "sketch", "paths", "early", "sample"))
    first = _tied(entries, s)
    ties = kept(components(first))
    sizes = ties.groupBy("component").agg((F.count(F.lit(1)) <= s.small).alias("loose"))
    tied = entries.join(ties.join(sizes, "component").select(F.col("v").alias("entry"), F.col("component").alias("tie"), "loose"), "entry", "left")
    tied = tied.withColumns({"tie": F.coalesce("tie", "entry"), "loose": F.coalesce("loose", F.lit(True))}).drop("early")
    return reduce(DataFrame.union, _met(kept(tied), s), first)


def _sets(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 0):
        sets = [t.tobytes() for t in shingle_sets(*byte_column(batch.column(0)), s.size)]
        names = [hashlib.blake2b(t, digest_size=16).digest() for t in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.binary()), pa.array(sets, pa.binary())], [*batch.schema.names[1:], "name", "tokens"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence matrices over the tokens that both sides have, some at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(a, b)
    if not len(shared):
        return out
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    in_a, in_b = shared[np.minimum(at_a, len(shared) - 1)] == a, shared[np.minimum(at_b, len(shared) - 1)] == b
    at_a, row_a, at_b, row_b = at_a[in_a], row_a[in_a], at_b[in_b], row_b[in_b]
    step = max(256, (1 << 22) // max(len(left), len(right)))
    for first in range(0, len(shared), step):
        width = min(step, len(shared) - first)
        own_a, own_b = (at_a >= first) & (at_a < first + width), (at_b >= first) & (at_b < first + width)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[row_a[own_a], at_a[own_a] - first] = 1
        y[row_b[own_b], at_b[own_b] - first] = 1
        out += np.rint(x @ y.T).astype(np.int64)
    return out


def _compared(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """entry, links (weights of its partners in this pair of blocks), root: the smallest entry that it is tied to here."""
    for table in each_group(batches, 3):
        entry, weight, block = (table.column(c).to_numpy() for c in ("entry", "weight", "block"))
        low, high = table.column(1)[0].as_py(), table.column(2)[0].as_py()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("tokens").to_pylist()]
        n = np.array([len(x) for x in sets])
        rows, columns = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(rows) or not len(columns):
            continue
        both = intersections([sets[i] for i in rows], [sets[i] for i in columns])
        linked = both * (s.numerator + s.denominator) >= s.numerator * (n[rows][:, None] + n[columns])
        linked &= (both > 0) & (entry[rows][:, None] != entry[columns])
        count = np.zeros(len(entry), np.int64)
        count[rows] += linked @ weight[columns]
        if low != high:
            count[columns] += weight[rows] @ linked
        forest = _Forest(len(entry))
        i, j = np.nonzero(linked)
        forest.join(rows[i], columns[j])
        # Roots are the smallest row numbers; name them by the smallest entry of the tree.
        roots = forest.roots()
        least = np.full(len(entry), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, entry)
        own = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(entry[own], pa.int64()), pa.array(count[own], pa.int64()), pa.array(least[roots[own]], pa.int64())], ["entry", "links", "root"])


def join(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), n_links (documents that reach the threshold with it), entry (smallest doc_id with its shingle set), n_shingles; a row for each document."""
    s = settings
    signed = kept(signatures(docs, s, id_col, text_col))
    own = signed.groupBy("doc_id").agg(F.min(F.struct("name", "n")).alias("own")).select("doc_id", "own.*")
    usable = own.where("doc_id is not null and n > 0")
    groups = kept(usable.groupBy("name").agg(F.min("doc_id").alias("entry"), F.count(F.lit(1)).alias("weight"), F.any_value("n").alias("n")))
    chosen = signed.select("doc_id", "name", "n", "sketch", "paths", "early", "sample").join(groups.select("name", "n", F.col("entry").alias("doc_id"), F.col("entry")), ["name", "n", "doc_id"]).dropDuplicates(["entry"])
    linked = components(candidate_links(chosen.select("entry", "n", "sketch", "paths", "early", "sample"), s))
    sizes = linked.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = kept(linked.join(sizes, "component").join(groups.select(F.col("entry").alias("v"), "name", "weight"), "v").select(F.col("v").alias("doc_id"), "name", "component", "weight", F.ceil(F.col("members") / s.exact_block).alias("blocks")))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(F.lower(F.col(text_col))).alias("body"))
    texts = joined_on_id(texts, members, "doc_id", "left_semi")
    sets = mapped(texts.select("body", "doc_id"), lambda it: _sets(it, s), "doc_id bigint, name binary, tokens binary")
    placed = sets.join(members, ["doc_id", "name"]).dropDuplicates(["doc_id"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    placed = placed.withColumn("pair", F.explode(_block_pairs("block", "blocks"))).select("component", "pair.low", "pair.high", F.col("doc_id").alias("entry"), "weight", "block", "tokens")
    placed = placed.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "entry")
    compared = kept(mapped(placed, lambda it: _compared(it, s), "entry bigint, links bigint, root bigint"))
    links = compared.groupBy("entry").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("entry").alias("a"), F.col("root").alias("b")))
    results = groups.join(links, "entry", "left").join(classes.withColumnRenamed("v", "entry"), "entry", "left")
    results = kept(results.select("name", "n", "entry", F.coalesce("component", "entry").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    # Joined by two columns, so that both sides are shuffled and a set that many documents share can be split.
    out = own.join(results, ["name", "n"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"), F.when(F.col("doc_id").isNotNull(), F.coalesce("entry", "doc_id")).alias("entry"), F.col("n").alias("n_shingles"))
