"""The row-local plans over streams: raw sequences that arrive are parsed, decoded and scored against static truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.metric import instance_score
from seriesmill.functions.tokens import parsed_prediction
from seriesmill.operators.evaluate import scored_instances


def scored_stream(raw: DataFrame, truth: DataFrame, late: str = "1 day") -> DataFrame:
    """raw (stream: image_id, raw, at) to instance scores with at. One image that arrives again within the watermark
    counts once. truth is static; only images with truth come out."""
    once = raw.withWatermark("at", late).dropDuplicatesWithinWatermark(["image_id"])
    p = once.withColumn("_p", parsed_prediction(F.col("raw"))).select("image_id", "at", "_p.chart_type", F.col("_p.x").alias("x_series"), F.col("_p.y").alias("y_series"))
    p = p.withColumnsRenamed({"chart_type": "_t", "x_series": "_x", "y_series": "_y"})
    d = p.join(truth, "image_id")
    both = F.array(*(F.struct(F.lit(a).alias("axis"), instance_score(F.col("chart_type"), F.col(f"{a}_series"), F.col("_t"), F.col(f"_{a}")).alias("score")) for a in "xy"))
    d = d.select("image_id", "at", "source", "chart_type", F.col("_t").alias("predicted_chart_type"), F.explode(both).alias("_s"))
    return d.select("image_id", "_s.axis", "source", "chart_type", "predicted_chart_type", "_s.score", "at")


def windowed_scores(scored: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mean score and instances by window, source and chart type; late rows within the watermark are counted."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return scored.groupBy(w.alias("window"), "source", "chart_type").agg(F.avg("score").alias("score"), F.count("*").alias("n_instances")).select("window.start", "window.end", "source", "chart_type", "score", "n_instances")


def batch_equivalent(raw: DataFrame, truth: DataFrame) -> DataFrame:
    """The same scores from a static table, through the batch operator (inner: images with both)."""
    p = raw.withColumn("_p", parsed_prediction(F.col("raw"))).select("image_id", "_p.chart_type", F.col("_p.x").alias("x_series"), F.col("_p.y").alias("y_series"))
    return scored_instances(truth.join(p.select("image_id"), "image_id", "left_semi"), p).drop("instance_id")
