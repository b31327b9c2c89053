"""Series elements: a tagged value that keeps how it was written.

VAL is struct<kind, s, d>: kind is str, int, float, bool or null; s is the text; d the number, null for texts. Texts of
numbers follow the shortest form that reads back: 10000000.0, 2e-05, 1e+16.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.functions.let import let, let_all

VAL = "struct<kind:string,s:string,d:double>"
SERIES = f"array<{VAL}>"

#: Texts that read as a decimal number; underscores may stand between digits.
NUMBER = r"^[+-]?(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"
INTEGER = r"^[+-]?\d(?:_?\d)*$"
BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def val(kind: str | Column, s: Column, d: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), s.alias("s"), d.cast("double").alias("d"))


def empty_series() -> Column:
    return F.array().cast(SERIES)


def stripped(s: Column) -> Column:
    """Without white space around, Unicode white space included."""
    return F.regexp_replace(s, BLANKS, "")


def float_text(d: Column) -> Column:
    """The shortest text of a double, plain from 1e-4 to below 1e16 and with an exponent of two digits or more beyond."""

    def scaled(m: Column) -> Column:
        bare, power, digits, n = m["bare"], m["power"], m["digits"], F.length(m["digits"])
        large = F.when(n <= power + 1, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        two = F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(F.abs(power).cast("string"))
        sci = F.concat(F.rtrim(F.rtrim(bare, F.lit("0")), F.lit(".")), F.when(power < 0, "e-").otherwise("e+"), two)
        return F.concat(m["sign"], F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(sci))

    def parts(j: Column) -> Column:
        mantissa = F.substring_index(j, "E", 1)
        bare = F.ltrim(mantissa, F.lit("-"))
        sign = F.when(j.startswith("-"), "-").otherwise("")
        return let_all({"bare": bare, "sign": sign, "power": F.substring_index(j, "E", -1).try_cast("int"), "digits": F.rtrim(F.replace(bare, F.lit("."), F.lit("")), F.lit("0"))}, scaled)

    plain = let(d.cast("string"), lambda j: F.when(F.contains(j, F.lit("E")), parts(j)).otherwise(j))
    return F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(plain)


def integer_text(s: Column) -> Column:
    """The canonical text of an integer of any length; null if s is none."""
    bare = F.regexp_replace(F.regexp_replace(s, r"[_+]|^-(?=[0_]*$)", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(F.regexp_like(s, F.lit(INTEGER)), bare)


def number(s: Column) -> Column:
    """A text's double; null unless it reads as a decimal number."""
    return F.when(F.regexp_like(s, F.lit(NUMBER)), F.regexp_replace(s, "_", "").try_cast("double"))


def number_or_infinity(s: Column) -> Column:
    """number, and infinities by name; not-a-number is null."""
    low = F.lower(s)
    return F.when(F.regexp_like(low, F.lit(r"^\+?inf(?:inity)?$")), F.lit(float("inf"))).when(F.regexp_like(low, F.lit(r"^-inf(?:inity)?$")), F.lit(float("-inf"))).otherwise(number(s))


def text_val(s: Column) -> Column:
    return val("str", s, F.lit(None))


def int_val(text: Column) -> Column:
    return let(text, lambda t: val("int", t, t.try_cast("double")))


def float_val(d: Column) -> Column:
    return let(d, lambda x: val("float", float_text(x), x))
