"""Open-set classification of vectors and its calibration.

References (label, vector) are folded into one row that holds every class with its centre
and unit examples. That row is broadcast, behind a check of its size, and each vector is scored
against it in one projection, without a shuffle. Beyond that size references go in blocks of a row each,
and a vector's best few of each class and block are merged. Scores don't depend on thresholds, so a
calibration grid scores once and then counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.functions.vectors import dot, normalize
from stacklight.sources.shared import once

#: The most reference values (examples x dimensions, 8 bytes each) that may be broadcast.
MOST_REFERENCE_VALUES = 4_000_000
UNKNOWN = "unknown"
SIMILARITIES, MARGINS = (0.75, 0.80, 0.85, 0.90), (0.0, 0.05, 0.10)


@dataclass(frozen=True)
class OpenSet:
    min_similarity: float = 0.80
    min_margin: float = 0.05
    top_k: int = 3

    def __post_init__(self):
        if not -1 <= self.min_similarity <= 1 or self.min_margin < 0 or self.top_k < 1:
            raise ValueError("similarity must lie in [-1, 1], margin be 0 or more and top_k 1 or more")


@dataclass(frozen=True)
class Gates:
    """What a threshold pair must reach to be recommended. STRICT is what decisions ask for."""

    accuracy: float = 0.90
    false_accept: float = 0.05
    accepted: int = 5
    unknown: int = 1


STRICT = Gates(0.95, 0.02, 20, 20)


def centers(references: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """label, center, n: the unit mean of each class's unit vectors, each component averaged to a billionth so that it doesn't depend on the order of rows."""
    parts = references.select(F.col(label).alias("label"), F.posexplode(normalize(vector)).alias("i", "x"))
    mean = parts.groupBy("label", "i").agg((F.floor(F.avg("x") * 1e9 + 0.5) / 1e9).alias("x"), F.count(F.lit(1)).alias("n"))
    folded = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("center"), F.max("n").alias("n"))
    return folded.select("label", normalize("center").alias("center"), "n")


def exemplars(rows: DataFrame, per_class: int, label: str = "label", vector: str = "vector", key: str = "id") -> DataFrame:
    """The per_class vectors nearest each class's centre, ties to smaller keys: a bounded reference set made from all rows."""
    own = rows.select(F.col(label).alias("label"), F.col(key).alias("key"), normalize(vector).alias("vector"))
    near = own.join(centers(rows, label, vector), "label")
    near = near.withColumn("near", F.floor(dot("vector", "center") * 1e6 + 0.5).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("near"), "key"))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_class).select("label", "key", "vector")


def _references(references: DataFrame, label: str, vector: str) -> tuple[DataFrame, int]:
    """(label, unit; written once, values in all). Blank labels, the name of the unknown class and no classes at all are errors."""
    units = once(references.select(F.col(label).alias("label"), normalize(vector).alias("unit")))
    name = F.coalesce(F.col("label").cast("string"), F.lit(""))
    size = units.agg(F.sum(F.size("unit")).alias("n"), F.bool_or((F.trim(name) == "") | (name == UNKNOWN)).alias("bad")).first()
    if not size["n"]:
        raise ValueError("there are no reference classes")
    if size["bad"]:
        raise ValueError(f"a reference label must not be blank or {UNKNOWN!r}")
    return units, size["n"]


def _center(examples: Column) -> Column:
    """The unit mean of unit vectors, each component averaged to a billionth."""
    total = F.aggregate(F.slice(examples, 2, F.size(examples)), examples[0], lambda s, e: F.zip_with(s, e, lambda x, y: x + y))
    return normalize(F.transform(total, lambda x: F.floor(x / F.size(examples) * 1e9 + 0.5) / 1e9))


def _minus(tops: Column, center: Column) -> Column:
    """A class's score with its sign turned: half the mean of the best example cosines and the centre cosine."""
    mean = F.transform(F.array(tops), lambda t: F.aggregate(t, F.lit(0.0), lambda s, x: s + x) / F.size(t))[0]
    return -(mean + center) / 2


def _tops(examples: Column, top_k: int) -> Column:
    """The best cosines of __unit with some examples, falling."""
    return F.slice(F.sort_array(F.transform(examples, lambda e: dot(F.col("__unit"), e)), asc=False), 1, top_k)


def _in_blocks(vectors: DataFrame, units: DataFrame, blocks: int, top_k: int, vector: str, key: str) -> DataFrame:
    """scores() where references are too many for one row: a broadcast row for each block of them.

    Every vector keeps its top_k cosines of each class in a block; they are merged by vector and class, so that
    what is shuffled is bounded by blocks x classes x top_k numbers a vector, however many references there are.
    """
    placed = once(units.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")))
    middle = once(centers(units, "label", "unit").select("label", "center", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("block")))
    asked = vectors.select(F.col(key).alias("__key"), normalize(vector).alias("__unit"))
    parts = []
    for b in range(blocks):
        own = placed.where(F.col("block") == b).groupBy("label").agg(F.collect_list("unit").alias("examples"))
        classes = own.join(middle.where(F.col("block") == b).select("label", "center"), "label", "full")
        row = classes.agg(F.collect_list(F.struct("label", "center", F.coalesce("examples", F.array().cast("array<array<double>>")).alias("examples"))).alias("classes"))
        seen = F.transform("classes", lambda c: F.struct(c["label"].alias("label"), _tops(c["examples"], top_k).alias("tops"), F.when(c["center"].isNotNull(), dot(F.col("__unit"), c["center"])).alias("center")))
        parts.append(asked.join(F.broadcast(row)).select("__key", F.inline(seen)))
    merged = reduce(DataFrame.union, parts).groupBy("__key", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("tops")), asc=False), 1, top_k).alias("tops"), F.max("center").alias("center"))
    ranked = merged.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct(_minus(F.col("tops"), F.col("center")).alias("minus"), "label"))).alias("ranked"))
    return vectors.join(ranked, vectors[key] == ranked["__key"]).drop("__key")


def scores(vectors: DataFrame, references: DataFrame, top_k: int = 3, vector: str = "vector", label: str = "label", reference_vector: str = "vector", key: str | None = None, most: int = MOST_REFERENCE_VALUES) -> DataFrame:
    """vectors with ranked: array<struct<minus, label>>, best first; score = (mean of the top_k example cosines + centre cosine) / 2.

    Up to `most` reference values are one broadcast row. More go in blocks of as many; `key`, a column
    that names each vector once, ties the blocks' parts together.
    """
    units, size = _references(references, label, reference_vector)
    if size > most:
        if key is None:
            raise ValueError(f"{size} reference values exceed {most}: name a key of the vectors, so that blocks of them can be merged")
        return _in_blocks(vectors, units, -(-size // most), top_k, vector, key)
    classes = units.groupBy("label").agg(F.collect_list("unit").alias("examples"))
    row = classes.agg(F.array_sort(F.collect_list(F.struct("label", _center(F.col("examples")).alias("center"), "examples"))).alias("classes"))
    asked = vectors.withColumn("__unit", normalize(vector)).join(F.broadcast(row))
    of = lambda c: F.struct(_minus(_tops(c["examples"], top_k), dot(F.col("__unit"), c["center"])).alias("minus"), c["label"].alias("label"))
    return asked.withColumn("ranked", F.array_sort(F.transform("classes", of))).drop("__unit", "classes")


def decisions(scored: DataFrame, config: OpenSet = OpenSet()) -> DataFrame:
    """scored with label (null if rejected), state, score, margin, nearest and candidates (the first top_k classes)."""
    score, second = -F.col("ranked")[0]["minus"], -F.get("ranked", F.lit(1))["minus"]
    margin = score - F.coalesce(second, F.lit(-1.0))
    accepted = (score >= config.min_similarity) & (margin >= config.min_margin)
    nearest = F.col("ranked")[0]["label"]
    return scored.select(
        *(c for c in scored.columns if c != "ranked"),
        F.when(accepted, nearest).alias("predicted"),
        F.when(accepted, "accepted").otherwise(UNKNOWN).alias("state"),
        score.alias("score"),
        margin.alias("margin"),
        nearest.alias("nearest"),
        F.transform(F.slice("ranked", 1, config.top_k), lambda r: F.struct(r["label"].alias("label"), (-r["minus"]).alias("similarity"))).alias("candidates"),
    )


def classify(vectors: DataFrame, references: DataFrame, config: OpenSet = OpenSet(), vector: str = "vector", key: str | None = None) -> DataFrame:
    return decisions(scores(vectors, references, config.top_k, vector, key=key), config)


def route(rule_accepted: Column, rule_reason: Column, state: Column, label: Column) -> Column:
    """struct(state, stage, label, reason): an accepting rule first, then the reference classes, else review."""
    return (
        F.when(F.coalesce(rule_accepted, F.lit(False)), F.struct(F.lit("accepted").alias("state"), F.lit("rule").alias("stage"), F.lit(None).cast("string").alias("label"), rule_reason.cast("string").alias("reason")))
        .when(state == "accepted", F.struct(F.lit("accepted").alias("state"), F.lit("reference").alias("stage"), label.cast("string").alias("label"), F.lit("reference_match").alias("reason")))
        .otherwise(F.struct(F.lit(UNKNOWN).alias("state"), F.lit("review").alias("stage"), F.lit(None).cast("string").alias("label"), F.lit("no_acceptance_evidence").alias("reason")))
    )


def grid(spark, similarities: Sequence[float] = SIMILARITIES, margins: Sequence[float] = MARGINS) -> DataFrame:
    pairs = [(float(s), float(m)) for s in sorted(set(similarities)) for m in sorted(set(margins))]
    if not pairs:
        raise ValueError("at least one similarity and one margin are needed")
    return spark.createDataFrame(pairs, "min_similarity double, min_margin double")


def outcomes(scored: DataFrame, pairs: DataFrame, actual: str = "label") -> DataFrame:
    """min_similarity, min_margin, actual, predicted, n: how often each pair of thresholds says what. Labels without a class count as unknown."""
    score = -F.col("ranked")[0]["minus"]
    margin = score - F.coalesce(-F.get("ranked", F.lit(1))["minus"], F.lit(-1.0))
    known = F.exists("ranked", lambda r: r["label"].cast("string") == F.col(actual).cast("string"))
    own = scored.select(score.alias("s"), margin.alias("m"), F.col("ranked")[0]["label"].cast("string").alias("nearest"), F.when(F.coalesce(known, F.lit(False)), F.col(actual).cast("string")).otherwise(UNKNOWN).alias("actual"))
    said = F.when((F.col("s") >= F.col("min_similarity")) & (F.col("m") >= F.col("min_margin")), F.col("nearest")).otherwise(UNKNOWN)
    return own.join(F.broadcast(pairs)).groupBy("min_similarity", "min_margin", "actual", said.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def metrics(counts: DataFrame) -> DataFrame:
    """One row for each pair of thresholds; a rate without cases is null."""
    accepted, unknown = F.col("predicted") != UNKNOWN, F.col("actual") == UNKNOWN
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = counts.groupBy("min_similarity", "min_margin").agg(
        F.sum("n").alias("total"), n(accepted).alias("accepted"), n(accepted & (F.col("predicted") == F.col("actual"))).alias("correct"), n(unknown).alias("unknown_total"), n(unknown & accepted).alias("unknown_false_accept")
    )
    return out.select("*", (F.col("accepted") / F.col("total")).alias("coverage"), F.try_divide("correct", "accepted").alias("accepted_accuracy"), F.try_divide("unknown_false_accept", "unknown_total").alias("unknown_false_accept_rate"))


def recommend(rows: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """The pair that passes all gates with the most coverage, then accuracy, then safety, then the stricter thresholds; no row if none passes."""
    fine = (F.col("accepted") >= gates.accepted) & (F.col("unknown_total") >= gates.unknown) & (F.col("accepted_accuracy") >= gates.accuracy) & (F.col("unknown_false_accept_rate") <= gates.false_accept)
    return rows.where(fine).orderBy(F.desc("coverage"), F.desc("accepted_accuracy"), "unknown_false_accept_rate", F.desc("min_similarity"), F.desc("min_margin")).limit(1)


def calibrate(records: DataFrame, references: DataFrame, similarities: Sequence[float] = SIMILARITIES, margins: Sequence[float] = MARGINS, top_k: int = 3, vector: str = "vector", label: str = "label", key: str | None = None) -> DataFrame:
    """Metrics of the whole grid from one scoring of the records."""
    return metrics(outcomes(scores(records, references, top_k, vector, key=key), grid(records.sparkSession, similarities, margins), label))
