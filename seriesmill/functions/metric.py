"""Scores of one predicted series against its truth, all in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.functions.let import let, let_all
from seriesmill.functions.values import number, stripped


def sigmoid(x: Column) -> Column:
    """1 at 0, falling to 0."""
    return 2 - 2 / (1 + F.exp(-x))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def rmse(truth: Column, pred: Column) -> Column:
    squares = F.zip_with(truth, pred, lambda t, p: (t - p) * (t - p))
    return F.sqrt(_sum(squares) / F.nullif(F.size(truth), F.lit(0)))


def normalized_rmse(truth: Column, pred: Column) -> Column:
    """sigmoid of the error over that of the mean; for a constant truth 1 if exact, else 0."""
    base = let(_sum(truth) / F.nullif(F.size(truth), F.lit(0)), lambda mean: rmse(truth, F.transform(truth, lambda _: mean)))
    return let_all({"base": base, "error": rmse(truth, pred)}, lambda r: F.when(r["base"] == 0, F.when(r["error"] == 0, 1.0).otherwise(0.0)).otherwise(sigmoid(r["error"] / F.nullif(r["base"], F.lit(0.0)))))


def edit_score(truth: Column, pred: Column) -> Column:
    """sigmoid of all edit distances over the truth's length; for an empty truth 1 if exact, else 0."""
    distance = F.aggregate(F.zip_with(truth, pred, lambda t, p: F.levenshtein(t, p)), F.lit(0), lambda a, v: a + v)
    length = F.aggregate(F.transform(truth, F.length), F.lit(0), lambda a, v: a + v)
    return let_all({"d": distance, "n": length}, lambda r: F.when(r["n"] == 0, F.when(r["d"] == 0, 1.0).otherwise(0.0)).otherwise(sigmoid(r["d"] / F.nullif(r["n"], F.lit(0)))))


def as_number(v: Column) -> Column:
    """A value's finite number; null for booleans, nulls and texts that are none. Commas in texts do not count."""
    text = let(F.replace(stripped(v["s"]), F.lit(","), F.lit("")), number)
    d = F.when(v["kind"].isin("int", "float"), v["d"]).when(v["kind"] == "str", text)
    return let(d, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def series_score(truth: Column, pred: Column) -> Column:
    """Lengths gate first; a truth whose first value is a text is compared by edits, any other by numbers."""
    pred = F.coalesce(pred, F.slice(truth, 1, 0))
    text = lambda s: F.transform(s, lambda v: F.coalesce(v["s"], F.lit("None")))
    hole = lambda s: F.exists(s, lambda d: d.isNull())
    numbers = let_all({"t": F.transform(truth, as_number), "p": F.transform(pred, as_number)}, lambda r: F.when(hole(r["t"]) | hole(r["p"]), 0.0).otherwise(normalized_rmse(r["t"], r["p"])))
    return (
        F.when(F.size(truth) != F.size(pred), 0.0)
        .when(F.size(truth) == 0, 1.0)
        .when(F.try_element_at(truth, F.lit(1))["kind"] == "str", let_all({"t": text(truth), "p": text(pred)}, lambda r: edit_score(r["t"], r["p"])))
        .otherwise(numbers)
    )


def instance_score(truth_type: Column, truth: Column, pred_type: Column, pred: Column) -> Column:
    """0 for another chart type, else series_score."""
    return F.when(truth_type.eqNullSafe(pred_type), series_score(truth, pred)).otherwise(0.0)
