"""Pixel positions to data values. A calibration is array<struct<px,val>>, sorted by px."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.functions.let import let, let_all
from seriesmill.functions.values import number_or_infinity, stripped

TICKS = "array<struct<px:double,val:double>>"


def calibrated(pixels: Column, values: Column) -> Column:
    """Pairs up to the shorter length, sorted by pixel (stable); a tick within 1e-9 of the last one kept is dropped."""
    n = F.least(F.size(pixels), F.size(values))
    pairs = F.zip_with(F.slice(pixels, F.lit(1), n), F.slice(values, F.lit(1), n), lambda p, v: F.struct(p.cast("double").alias("px"), v.cast("double").alias("val")))
    ordered = F.array_sort(F.transform(pairs, lambda t, i: F.struct(t["px"].alias("px"), i.alias("i"), t["val"].alias("val"))))
    plain = F.transform(ordered, lambda t: F.struct(t["px"].alias("px"), t["val"].alias("val")))
    near = lambda kept, t: F.coalesce(F.abs(F.try_element_at(kept, F.lit(-1))["px"] - t["px"]) <= 1e-9, F.lit(False))
    return F.aggregate(plain, F.array().cast(TICKS), lambda kept, t: F.when(near(kept, t), kept).otherwise(F.concat(kept, F.array(t))))


def is_usable(ticks: Column) -> Column:
    return F.size(ticks) >= 2


def value_at(ticks: Column, px: Column) -> Column:
    """Piecewise linear, extrapolated by the outer intervals; the only tick's value, or 0 without ticks."""
    n = F.size(ticks)
    above = F.size(F.filter(ticks, lambda t: t["px"] < px)) + 1  # place of the first tick at or beyond px
    line = lambda r: r["a"]["val"] + F.try_divide((px - r["a"]["px"]) * (r["b"]["val"] - r["a"]["val"]), r["b"]["px"] - r["a"]["px"])
    at = let(F.greatest(F.lit(2), F.least(above, n)), lambda hi: let_all({"a": F.try_element_at(ticks, hi - 1), "b": F.try_element_at(ticks, hi)}, line))
    return F.when(n >= 2, at).when(n == 1, F.try_element_at(ticks, F.lit(1))["val"]).otherwise(0.0)


def unit_per_pixel(ticks: Column) -> Column:
    """Mean slope over the whole range; 0 if not usable."""
    a, b = F.try_element_at(ticks, F.lit(1)), F.try_element_at(ticks, F.lit(-1))
    return F.when(is_usable(ticks), F.abs(F.try_divide(b["val"] - a["val"], b["px"] - a["px"]))).otherwise(0.0)


def tick_label(v: Column) -> Column:
    """A value read as a tick's label: numbers and booleans as they are, texts without commas; null if none or not a number."""
    d = F.when(v["kind"].isin("int", "float"), v["d"]).when(v["kind"] == "bool", (v["s"] == "True").cast("double")).when(v["kind"] == "str", number_or_infinity(F.replace(stripped(v["s"]), F.lit(","), F.lit(""))))
    return let(d, lambda x: F.when(~F.isnan(x), x))


def tick_labels(series: Column) -> Column:
    """The readable labels of a series; [0, 0] if there are fewer than two."""
    read = F.filter(F.transform(series, tick_label), lambda d: d.isNotNull())
    return let(read, lambda r: F.when(F.size(r) >= 2, r).otherwise(F.array(F.lit(0.0), F.lit(0.0))))


def series_ladder(tick_pixels: Column, series: Column, rungs: int = 25) -> Column:
    """The series taken for tick labels: a uniform ladder from the first two pixels and labels, by repeated addition.

    It is known to be the wrong source of labels, and kept as the baseline; other sources are registered beside it."""
    at = lambda a, i: F.try_element_at(a, F.lit(i))

    def ladder(r: Column) -> Column:
        start = F.struct(at(r["px"], 1).alias("px"), at(r["lab"], 1).alias("val"))
        step = lambda t: F.struct((t["px"] + r["up"]).alias("px"), (t["val"] - r["down"]).alias("val"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rungs)), F.array(start), lambda acc, _: F.concat(acc, F.array(step(F.element_at(acc, -1)))))

    def built(r: Column) -> Column:
        steps = let_all({"px": r["px"], "lab": r["lab"], "up": at(r["px"], 2) - at(r["px"], 1), "down": at(r["lab"], 1) - at(r["lab"], 2)}, ladder)
        full = let(steps, lambda l: calibrated(F.transform(l, lambda t: t["px"]), F.transform(l, lambda t: t["val"])))
        return F.when(F.size(r["px"]) >= 2, full).otherwise(calibrated(r["px"], r["lab"]))

    return let_all({"px": F.array_sort(F.transform(tick_pixels, lambda p: p.cast("double"))), "lab": tick_labels(series)}, built)


_SOURCES = {"donut_series": series_ladder}


def register_label_source(name: str, build) -> None:
    """build(tick_pixels, series) returns a calibration. A name is registered once."""
    if name in _SOURCES:
        raise ValueError(f"label source {name!r} is already registered")
    _SOURCES[name] = build


def label_sources() -> list[str]:
    return sorted(_SOURCES)


def label_source(name: str):
    if name not in _SOURCES:
        raise ValueError(f"unknown label source {name!r}; known: {', '.join(label_sources())}")
    return _SOURCES[name]


def y_calibration(y_points: Column, series: Column, source: str = "donut_series") -> Column:
    """Empty with fewer than two y ticks, else what the label source builds from their py and the series."""
    pixels = F.transform(y_points, lambda p: p["py"])
    return F.when(F.coalesce(F.size(y_points), F.lit(0)) >= 2, label_source(source)(pixels, series)).otherwise(F.array().cast(TICKS))
