"""All core queries over the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesmill.plans import charts, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**records.QUERIES, **charts.QUERIES}
ORACLE: dict[str, str] = {**records.ORACLE, **charts.ORACLE}
FLAGSHIP = "c_breakdown"
