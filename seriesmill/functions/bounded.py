"""Small tables, sent to every executor only once their size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from seriesmill.session import checkpointed


def collect_bounded(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of a table that its contract bounds; an error, not a cut, beyond the bound."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def small_side(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, computed once and checkpointed: for a broadcast join if its rows are at most so many bytes as JSON, else for a
    shuffled join. No row reaches the driver."""
    kept = checkpointed(df)
    size = kept.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*kept.columns)))), F.lit(0))).first()[0]
    return F.broadcast(kept) if size <= most else kept
