"""The scalars as SQL functions; Catalyst inlines them, no Python worker runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "sm_sigmoid": "(x DOUBLE) RETURNS DOUBLE RETURN 2 - 2 / (1 + exp(-x))",
    "sm_bucket": "(salt STRING, id STRING) RETURNS DOUBLE RETURN cast(conv(substr(md5(concat(salt, ':', id)), 1, 8), 16, 10) AS DOUBLE) / 4294967295D",
    "sm_iou": """(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE) RETURNS DOUBLE RETURN
        coalesce(try_divide(greatest(0D, least(ax2, bx2) - greatest(ax1, bx1) + 1) * greatest(0D, least(ay2, by2) - greatest(ay1, by1) + 1),
        (ax2 - ax1 + 1) * (ay2 - ay1 + 1) + (bx2 - bx1 + 1) * (by2 - by1 + 1) - greatest(0D, least(ax2, bx2) - greatest(ax1, bx1) + 1) * greatest(0D, least(ay2, by2) - greatest(ay1, by1) + 1)), 0D)""",
    "sm_chart_type": """(raw STRING) RETURNS STRING RETURN CASE WHEN contains(raw, '<dot>') THEN 'dot' WHEN contains(raw, '<horizontal_bar>') THEN 'horizontal_bar'
        WHEN contains(raw, '<vertical_bar>') THEN 'vertical_bar' WHEN contains(raw, '<scatter>') THEN 'scatter' WHEN contains(raw, '<line>') THEN 'line' END""",
    "sm_image_id": r"(t STRING) RETURNS STRING RETURN nullif(regexp_extract(lower(t), r'(?U)^\s*(?:[^\r\n]*[/\\])?([0-9a-f]{12})(?:_[xy])?(?:\.[^/\\\s]*)?\s*$', 1), '')",
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions as temporary ones; returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
