"""Marker boxes: struct<x1,y1,x2,y2,label,score>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double,label:int,score:double>"

# The label of data markers and the least score.
MARKER_LABEL, MIN_SCORE = 3, 0.5


def centre(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union with pixels counted inclusively; 0 for an empty union."""
    area = lambda p: (p["x2"] - p["x1"] + 1) * (p["y2"] - p["y1"] + 1)
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + 1)
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + 1)
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def markers(boxes: Column, label: int = MARKER_LABEL, least: float = MIN_SCORE) -> Column:
    return F.filter(boxes, lambda b: (b["label"] == label) & (b["score"] >= least))


def deduplicated(boxes: Column, most: float = 0.0) -> Column:
    """Boxes that overlap no earlier kept box by more than most, in their order."""
    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > most), kept).otherwise(F.concat(kept, F.array(b))))


def centres(boxes: Column, dedupe: float | None = None, least: float = MIN_SCORE) -> Column:
    """Centres of the markers from left to right, in their order where they share an x."""
    kept = markers(boxes, least=least) if dedupe is None else deduplicated(markers(boxes, least=least), dedupe)
    ordered = F.array_sort(F.transform(F.transform(kept, centre), lambda c, i: F.struct(c["x"].alias("x"), i.alias("i"), c["y"].alias("y"))))
    return F.transform(ordered, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))


def valid_ticks(points: Column, logits: Column, valid: int = 1) -> Column:
    """Points whose largest logit is that of class valid (the first of equals wins)."""
    best = F.transform(logits, lambda l: F.array_position(l, F.array_max(l)) - 1)
    pairs = F.zip_with(points, best, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    return F.transform(F.filter(pairs, lambda x: x["k"] == valid), lambda x: x["p"])
