"""Stage outputs to outcomes: one id-keyed join, a ladder of failures, and the submission table.

All tables are keyed by image_id; row order never matters. Ticks and detections may be missing for an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.calibration import is_usable, y_calibration
from seriesmill.functions.decoding import DECODERS, Decoder, decoded
from seriesmill.functions.tokens import parsed_prediction
from seriesmill.functions.values import empty_series, stripped

# Modes, the type of predictions without one, and what stands for a series that is missing.
MODES = ("full", "donut_only")
MISSING_TYPE, PLACEHOLDER = "line", "0;0"


def predictions(raw: DataFrame, clean: bool = True) -> DataFrame:
    """image_id, raw to image_id, chart_type, x, y, raw, failure_mode."""
    p = raw.withColumn("_p", parsed_prediction(F.col("raw"), clean))
    return p.select("image_id", "_p.chart_type", "_p.x", "_p.y", "raw", "_p.failure_mode")


def id_differences(produced: DataFrame, expected: DataFrame, key: str = "image_id") -> DataFrame:
    """key, side: ids that only one table has (missing: expected but not produced; extra: the other way)."""
    a, b = produced.select(key).distinct().withColumn("_a", F.lit(True)), expected.select(key).distinct().withColumn("_b", F.lit(True))
    d = a.join(b, key, "full").where("_a is null or _b is null")
    return d.select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side"))


def require_all_ids(stage: str, produced: DataFrame, expected: DataFrame, key: str = "image_id") -> None:
    """Raises if the two do not hold the same ids, with examples."""
    r = id_differences(produced, expected, key).groupBy("side").agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most"))
    found = [f"{x.n} {x.side}, such as {x.least} and {x.most}" for x in r.collect()]
    if found:
        raise ValueError(f"{stage}: " + "; ".join(sorted(found)))


def staged(refs: DataFrame, preds: DataFrame, ticks: DataFrame | None = None, detections: DataFrame | None = None) -> DataFrame:
    """refs inner preds left ticks left detections, one row per image of refs."""
    d = refs.select("image_id").join(preds, "image_id")
    if ticks is not None:
        d = d.join(ticks.select("image_id", "x_points", "y_points"), "image_id", "left")
    else:
        d = d.withColumns({c: F.lit(None).cast("array<struct<px:double,py:double>>") for c in ("x_points", "y_points")})
    if detections is not None:
        return d.join(detections.select("image_id", "boxes"), "image_id", "left")
    return d.withColumn("boxes", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double,label:int,score:double>>"))


def outcomes(refs: DataFrame, preds: DataFrame, ticks: DataFrame | None = None, detections: DataFrame | None = None, mode: str = "full", label_source: str = "donut_series", decoders: dict[str, Decoder] = DECODERS) -> DataFrame:
    """image_id, chart_type, x_series, y_series, failure_mode, mode. The first failure of the ladder wins: malformed
    prediction, (donut_only: no values), no decoder, no detections, unusable calibration, decode error, nothing decoded."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    whole = mode == "full"
    d = staged(refs, preds, ticks if whole else None, detections if whole else None)
    d = d.withColumn("chart_type", F.coalesce(F.nullif(F.col("chart_type"), F.lit("")), F.lit(MISSING_TYPE)))
    bad = F.col("failure_mode").isNotNull()
    none = F.col("y").isNull() | (F.size("y") == 0)
    if not whole:
        failure = F.when(bad, F.col("failure_mode")).when(none, "empty_series")
        y = F.when(failure.isNull(), F.col("y")).otherwise(empty_series())
    else:
        d = d.withColumn("_cal", y_calibration(F.col("y_points"), F.col("y"), label_source))
        d = d.withColumn("_y", decoded(F.col("chart_type"), F.col("boxes"), F.transform("x_points", lambda p: p["px"]), F.col("_cal"), decoders))
        broken = F.exists("_y", lambda v: v["d"].isNull() | F.isnan(v["d"]) | (F.abs(v["d"]) == float("inf")))
        failure = (
            F.when(bad, F.col("failure_mode"))
            .when(~F.col("chart_type").isin(*decoders), F.concat(F.lit("no_decoder_for_"), F.col("chart_type")))
            .when(F.col("boxes").isNull(), "missing_marker_detections")
            .when(~is_usable(F.col("_cal")), "unusable_axis_calibration")
            .when(broken & (F.col("chart_type") == "dot"), "decode_error")
            .when(F.size("_y") == 0, "no_markers_decoded")
        )
        y = F.when(failure.isNull(), F.col("_y")).otherwise(empty_series())
    return d.select("image_id", "chart_type", F.when(bad, empty_series()).otherwise(F.col("x")).alias("x_series"), y.alias("y_series"), failure.alias("failure_mode"), F.lit(mode).alias("mode"))


def failure_summary(out: DataFrame) -> DataFrame:
    """chart_type, failure_mode (or ok), count; by type, then the most frequent first."""
    s = out.groupBy("chart_type", F.coalesce("failure_mode", F.lit("ok")).alias("failure_mode")).agg(F.count("*").alias("count"))
    return s.orderBy("chart_type", F.desc("count"), "failure_mode")


def finite_text(v: Column) -> Column:
    """A value's text; floats that are not finite read 0.0."""
    odd = (v["kind"] == "float") & (F.isnan(v["d"]) | (F.abs(v["d"]) == float("inf")))
    return F.when(odd, "0.0").otherwise(F.coalesce(v["s"], F.lit("None")))


def series_text(series: Column) -> Column:
    """Values joined by ';', or the placeholder for a series that is missing, empty or blank throughout."""
    text = F.array_join(F.transform(series, finite_text), ";")
    blank = series.isNull() | (F.size(series) == 0) | ~F.exists(series, lambda v: stripped(finite_text(v)) != "")
    return F.when(blank, PLACEHOLDER).otherwise(text)


def instances(table: DataFrame, *keep: str) -> DataFrame:
    """image_id, axis, series, keep...: two rows per row of x_series and y_series, in one scan."""
    pair = F.array(F.struct(F.lit("x").alias("axis"), F.col("x_series").alias("series")), F.struct(F.lit("y").alias("axis"), F.col("y_series").alias("series")))
    return table.select("image_id", *keep, F.explode(pair).alias("_i")).select("image_id", "_i.axis", "_i.series", *keep)


def submission(refs: DataFrame, out: DataFrame) -> DataFrame:
    """id, data_series, chart_type for both axes of every image of refs; sort by (axis, image_id) to print it."""
    full = refs.select("image_id").join(out.select("image_id", "chart_type", "x_series", "y_series"), "image_id", "left")
    rows = instances(full, "chart_type")
    kind = F.coalesce(F.nullif(F.col("chart_type"), F.lit("")), F.lit(MISSING_TYPE))
    return rows.select(F.concat_ws("_", "image_id", "axis").alias("id"), series_text(F.col("series")).alias("data_series"), kind.alias("chart_type"), "axis", "image_id")
