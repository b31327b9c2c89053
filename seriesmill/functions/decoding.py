"""Decoders: markers and ticks of one image to its y series, by chart type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.functions.calibration import value_at
from seriesmill.functions.geometry import MIN_SCORE, centres
from seriesmill.functions.let import let, let_all
from seriesmill.functions.values import SERIES, float_val, int_val

#: Fixed value: how far a dot may stand from its column's tick.
COLUMN_TOLERANCE = 10.0


@dataclass(frozen=True)
class Decoder:
    """decode(centres, x_ticks, calibration) gives the values; dedupe is the overlap above which a marker is dropped;
    min_score replaces the usual least score."""

    decode: Callable[[Column, Column, Column], Column]
    dedupe: float | None = None
    integral: bool = False
    min_score: float = MIN_SCORE


def _each(c: Column, x_ticks: Column, cal: Column) -> Column:
    return F.transform(c, lambda m: value_at(cal, m["y"]))


def _nothing(c: Column, x_ticks: Column, cal: Column) -> Column:
    return F.array().cast("array<double>")


def _at_ticks(c: Column, x_ticks: Column, cal: Column) -> Column:
    """The nearest marker's value for each x tick, the leftmost of equals; without ticks, each marker's."""
    nearest = lambda t: F.array_min(F.transform(c, lambda m, i: F.struct(F.abs(m["x"] - t).alias("far"), i.alias("i"), m["y"].alias("y"))))["y"]
    values = F.transform(x_ticks, lambda t: value_at(cal, nearest(t)))
    return F.when(F.size(c) == 0, F.array().cast("array<double>")).when(F.size(x_ticks) == 0, _each(c, x_ticks, cal)).otherwise(values)


def _columns(c: Column, x_ticks: Column, cal: Column) -> Column:
    """Markers within the tolerance of each tick, times the value step between the first two rungs, cut to whole numbers."""
    step = F.coalesce(F.abs(F.try_element_at(cal, F.lit(2))["val"] - F.try_element_at(cal, F.lit(1))["val"]), F.lit(0.0))
    count = lambda t: F.size(F.filter(c, lambda m: F.abs(m["x"] - t) <= COLUMN_TOLERANCE))
    return let(step, lambda s: F.transform(x_ticks, lambda t: F.floor(count(t) * s).cast("double")))


DECODERS: dict[str, Decoder] = {
    "vertical_bar": Decoder(_each, 0.0),
    "horizontal_bar": Decoder(_nothing, 0.0),
    "scatter": Decoder(_each),
    "line": Decoder(_at_ticks),
    "dot": Decoder(_columns, 0.0, integral=True),
}


def _bound(d: Decoder, cal: Column) -> Callable[[Column], Column]:
    return lambda r: d.decode(r["c"], r["t"], cal)


def decoded(chart_type: Column, boxes: Column, x_ticks: Column, cal: Column, decoders: dict[str, Decoder] = DECODERS) -> Column:
    """The y series, array<VAL>; null for a chart type without decoder. x_ticks are sorted first."""
    ticks = F.array_sort(F.coalesce(x_ticks, F.array().cast("array<double>")))
    out = F.lit(None).cast(SERIES)
    for name, d in decoders.items():
        values = let_all({"c": centres(boxes, d.dedupe, d.min_score), "t": ticks}, _bound(d, cal))
        as_val = (lambda v: int_val(v.cast("decimal(38,0)").cast("string"))) if d.integral else float_val
        out = F.when(chart_type == name, F.transform(values, as_val).cast(SERIES)).otherwise(out)
    return out
