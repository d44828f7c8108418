"""Detections: class-wise suppression and summaries of each image's boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.functions import boxes

_BOX = "array<struct<minus:double,seq:bigint,x:double,y:double,w:double,h:double>>"


def suppressed(rows: DataFrame, image: str, label: str, score: str, seq: str, box: Column, min_score: float = boxes.MIN_SCORE, overlap: float = boxes.MAX_OVERLAP) -> DataFrame:
    """image, label, score, seq, x, y, w, h of the boxes kept: in each image and class the best first, equals by seq. An image's boxes are one bounded group."""
    own = rows.where(F.col(score) >= min_score).select(F.col(image).alias("image"), F.col(label).alias("label"), (-F.col(score)).cast("double").alias("minus"), F.col(seq).cast("bigint").alias("seq"), box.alias("b"))
    own = own.where(F.col("b.w") * F.col("b.h") >= boxes.MIN_AREA)
    groups = own.groupBy("image", "label").agg(F.array_sort(F.collect_list(F.struct("minus", "seq", "b.x", "b.y", "b.w", "b.h"))).cast(_BOX).alias("all"))
    kept = groups.select("image", "label", F.explode(boxes.suppress(F.col("all"), _BOX, overlap)).alias("k"))
    return kept.select("image", "label", (-F.col("k.minus")).alias("score"), "k.seq", "k.x", "k.y", "k.w", "k.h")


def summaries(kept: DataFrame, explicit: tuple = boxes.EXPLICIT, covered: tuple = boxes.COVERED, most: int = 24, images: DataFrame | None = None) -> DataFrame:
    """image, n, explicit_score, covered_score, class_maxima and the first detections; classes without boxes score 0, and so do those of `images` (image) without any box."""
    best = lambda names: F.coalesce(F.max(F.when(F.col("label").isin(*names), F.col("score"))), F.lit(0.0))
    by_class = kept.groupBy("image", "label").agg(F.max("score").alias("m")).groupBy("image").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "m")))).alias("class_maxima"))
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "label", "seq"))), 1, most), lambda d: F.struct(d["label"].alias("label"), (-d["minus"]).alias("score")))
    rest = kept.groupBy("image").agg(F.count(F.lit(1)).alias("n"), best(explicit).alias("explicit_score"), best(covered).alias("covered_score"), listed.alias("detections"))
    out = rest.join(by_class, "image")
    if images is None:
        return out
    empty = {"n": F.lit(0).cast("bigint"), "explicit_score": F.lit(0.0), "covered_score": F.lit(0.0), "detections": F.array().cast(out.schema["detections"].dataType), "class_maxima": F.create_map().cast(out.schema["class_maxima"].dataType)}
    return images.select("image").distinct().join(out, "image", "left").withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


_FOUND = "array<struct<minus:double,seq:int,label:string,x:double,y:double,w:double,h:double>>"


def detected(outputs: str | Column, canvas: int = 320, min_score: float = boxes.MIN_SCORE, overlap: float = boxes.MAX_OVERLAP) -> Column:
    """array<struct<label, confidence, area_ratio, x, y, w, h>> of a detector's raw outputs (array of outputs, each an array of rows: centre, size and a score for each class), best first.

    A row is of its best class, the first of equals. Suppression is inside each output and
    class; the outputs then join. Equal confidences (to six digits) keep the order of outputs,
    of their classes' first rows, and of scores. One projection: no shuffle and no Python.
    """
    if canvas <= 0:
        raise ValueError("canvas must be positive")
    classes, n = F.array(*(F.lit(c) for c in boxes.CLASSES)), len(boxes.CLASSES)

    def row(r: Column, i: Column) -> Column:
        scores = F.slice(r, 5, n)
        best = F.array_max(scores)
        box = boxes.corner_box(r[0], r[1], r[2], r[3], canvas)
        fine = F.size(r) >= 4 + n
        return F.struct(F.when(fine, -best).otherwise(F.raise_error(F.lit("the detector's output has an unknown shape"))).alias("minus"), i.cast("int").alias("seq"), F.element_at(classes, F.array_position(scores, best).cast("int")).alias("label"), box["x"].alias("x"), box["y"].alias("y"), box["w"].alias("w"), box["h"].alias("h"))

    def kept_of(fine: Column, output: Column) -> Column:
        first = lambda label: F.array_min(F.transform(F.filter(fine, lambda b: b["label"] == label), lambda b: b["seq"]))
        apart = lambda box: lambda k: (k["label"] != box["label"]) | (boxes.iou(box, k) <= overlap)
        kept = F.aggregate(F.array_sort(fine).cast(_FOUND), F.array().cast(_FOUND), lambda kept, box: F.when(F.forall(kept, apart(box)), F.concat(kept, F.array(box))).otherwise(kept))
        return F.transform(kept, lambda b: F.struct((-F.round(-b["minus"], 6)).alias("minus"), output.cast("int").alias("output"), first(b["label"]).alias("first"), b["minus"].alias("exact"), b["seq"].alias("seq"), b["label"].alias("label"), b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))

    def of(rows: Column, output: Column) -> Column:
        fine = F.filter(F.transform(rows, row), lambda b: (-b["minus"] >= min_score) & (b["w"] * b["h"] >= boxes.MIN_AREA))
        return F.transform(F.array(fine), lambda bound: kept_of(bound, output))[0]  # bound, so that it is computed once

    every = F.array_sort(F.flatten(F.transform(F.col(outputs) if isinstance(outputs, str) else outputs, of)))
    return F.transform(every, lambda d: F.struct(d["label"].alias("label"), (-d["minus"]).alias("confidence"), F.round(d["w"] * d["h"] / canvas**2, 6).alias("area_ratio"), *(F.round(d[k], 2).alias(k) for k in "xywh")))


def summary_of(found: str | Column, explicit: tuple = boxes.EXPLICIT, covered: tuple = boxes.COVERED, most: int = 24) -> Column:
    """struct(class_maxima, explicit_score, covered_score, detections): of no detections an empty map, zeros and an empty list."""
    own = F.col(found) if isinstance(found, str) else found
    best = lambda fits: F.coalesce(F.array_max(F.transform(F.filter(own, lambda d: fits(d["label"])), lambda d: d["confidence"])), F.lit(0.0))
    labels = F.array_sort(F.array_distinct(F.transform(own, lambda d: d["label"])))
    maxima = F.map_from_entries(F.transform(labels, lambda name: F.struct(name.alias("label"), best(lambda x: x == name).alias("score"))))
    return F.struct(maxima.alias("class_maxima"), best(lambda x: x.isin(*explicit)).alias("explicit_score"), best(lambda x: x.isin(*covered)).alias("covered_score"), F.slice(own, 1, most).alias("detections"))


def zipped(names: Column, scores: Column) -> Column:
    """array<struct<name, score>> by position; different lengths are an error."""
    same = F.size(names) == F.size(scores)
    return F.when(same, F.zip_with(names, scores, lambda n, s: F.struct(n.alias("name"), s.alias("score")))).otherwise(F.raise_error(F.lit("the tagger's outputs don't fit its tags")))


def top_tags(tags: Column, ratings: tuple[str, ...], most: int = 30, least: float = 0.25) -> Column:
    """Of array<struct<name, score>>: the best `most` tags that aren't ratings, then those of at least `least`."""
    ordered = F.array_sort(F.transform(F.filter(tags, lambda t: ~t["name"].isin(*ratings)), lambda t: F.struct((-t["score"]).alias("minus"), t["name"].alias("name"))))
    return F.filter(F.transform(F.slice(ordered, 1, most), lambda t: F.struct(t["name"].alias("name"), (-t["minus"]).alias("score"))), lambda t: t["score"] >= least)


def ratings_of(tags: Column, ratings: tuple[str, ...]) -> Column:
    """struct of the named ratings, 0 where absent."""
    best = lambda r: F.array_max(F.transform(F.filter(tags, lambda t: t["name"] == r), lambda t: t["score"]))
    return F.struct(*(F.coalesce(best(r), F.lit(0.0)).alias(r) for r in ratings))
