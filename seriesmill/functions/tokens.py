"""Token sequences: reading predictions out of them, and writing annotations as such."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.functions.let import let, let_all
from seriesmill.functions.repair import cleaned
from seriesmill.functions.values import SERIES, empty_series, stripped, text_val

# The tokens, and the order in which chart types are looked for.
BOS, END = "<|BOS|>", "</s>"
X_START, X_END, Y_START, Y_END = "<x_start>", "<x_end>", "<y_start>", "<y_end>"
TYPE_ORDER = ("dot", "horizontal_bar", "vertical_bar", "scatter", "line")
DEFAULT_TYPE = "vertical_bar"


def detected_type(raw: Column) -> Column:
    """The first chart type, in the fixed order, whose token occurs anywhere; null if none does."""
    out = F.lit(None).cast("string")
    for t in reversed(TYPE_ORDER):
        out = F.when(F.contains(raw, F.lit(f"<{t}>")), F.lit(t)).otherwise(out)
    return out


def between(raw: Column, start: str, end: str) -> Column:
    """Pieces of what stands behind the first start token, up to a second one or the first end token."""
    part = F.split_part(F.split_part(raw, F.lit(start), F.lit(2)), F.lit(end), F.lit(1))
    return F.split(part, ";")


def parsed_prediction(raw: Column, clean: bool = True) -> Column:
    """struct<chart_type, x, y, failure_mode>; a failed parse has empty series. Null reads like ''."""
    raw = F.coalesce(raw, F.lit(""))
    kind = detected_type(raw)
    whole = F.lit(True)
    for t in (X_START, X_END, Y_START, Y_END):
        whole = whole & F.contains(raw, F.lit(t))
    ones = F.replace(raw, F.lit("<one>"), F.lit("1"))
    blank = lambda s: ~F.exists(s, lambda t: stripped(t) != "")
    series = cleaned if clean else (lambda s: F.transform(s, text_val).cast(SERIES))

    def judged(p: Column) -> Column:
        failure = F.when(p["kind"].isNull(), "no_chart_type_token").when(~p["whole"], "missing_series_delimiters").when(blank(p["x"]) | blank(p["y"]), "empty_series")
        return let_all({"p": p, "failure": failure}, built)

    def built(q: Column) -> Column:
        axis = lambda c: F.when(q["failure"].isNull(), series(q["p"][c])).otherwise(empty_series()).alias(c)
        return F.struct(F.coalesce(q["p"]["kind"], F.lit(DEFAULT_TYPE)).alias("chart_type"), axis("x"), axis("y"), q["failure"].alias("failure_mode"))

    pieces = lambda o: let_all({"kind": kind, "whole": whole, "x": between(o, X_START, X_END), "y": between(o, Y_START, Y_END)}, judged)
    return let(ones, pieces)


def training_text(v: Column) -> Column:
    """A value as it is written into a training sequence: integral floats as integers, others with six significant
    digits, texts with ';' replaced."""
    d = v["d"]
    whole = (F.floor(d) == d) & (F.abs(d) < 1e15)
    six = F.format_string("%.5e", d)  # d.ddddde+XX, rounded to six digits
    e = F.substring_index(six, "e", -1).try_cast("int")
    fixed = F.regexp_replace(F.regexp_replace(_fixed_six(six, e), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(six, "e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    sci = F.concat(mantissa, F.lit("e"), F.substring_index(six, "e", -1))
    number = F.when(F.isnan(d) | (F.abs(d) == float("inf")), "0").when(d == 0, "0").when(whole, d.cast("decimal(20,0)").cast("string")).when((e < -4) | (e >= 6), sci).otherwise(fixed)
    text = (
        F.when(v["kind"] == "bool", F.when(v["s"] == "True", "1").otherwise("0"))
        .when(v["kind"] == "int", v["s"])
        .when(v["kind"] == "float", number)
        .when(v["kind"] == "null", "None")
        .otherwise(F.replace(stripped(v["s"]), F.lit(";"), F.lit(",")))
    )
    return F.coalesce(text, F.lit("None"))


def _fixed_six(six: Column, e: Column) -> Column:
    """d.ddddde+XX without its exponent, for exponents from -4 to 5."""
    sign = F.when(six.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.substring_index(six, "e", 1), r"[-.]", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), digits)
    large = F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(6)))
    return F.concat(sign, F.when(e < 0, small).otherwise(large))


def sequence(chart_type: Column, x: Column, y: Column) -> Column:
    """The training sequence of an annotation; null for an unknown chart type or series of unequal lengths."""
    join = lambda s: F.array_join(F.transform(s, training_text), ";")
    text = F.concat(F.lit(f"{BOS}<"), chart_type, F.lit(f">{X_START}"), join(x), F.lit(f"{X_END}{Y_START}"), join(y), F.lit(f"{Y_END}{END}"))
    return F.when(chart_type.isin(*TYPE_ORDER) & (F.size(x) == F.size(y)), text)


def survives_round_trip(chart_type: Column, x: Column, y: Column) -> Column:
    """Whether the sequence reads back well-formed, with the same type and lengths."""
    same = lambda p: p["failure_mode"].isNull() & (p["chart_type"] == chart_type) & (F.size(p["x"]) == F.size(x)) & (F.size(p["y"]) == F.size(y))
    return let(sequence(chart_type, x, y), lambda s: s.isNotNull() & let(parsed_prediction(s, clean=False), same))
