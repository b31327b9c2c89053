"""JSON values of unknown shape, as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.let import let


def parsed(text: Column, objects: bool = False) -> Column:
    """The JSON value of a text; null for null, blank or broken texts, and for objects that repeat a key. With objects,
    anything but an object is null too.

    The parser stops behind the first value, so an object or array must also end its text."""
    blanks = F.lit(" \t\r\n")
    first, last = F.substring(F.ltrim(text, blanks), 1, 1), F.substring(F.rtrim(text, blanks), -1, 1)
    if objects:
        return F.when((first == "{") & (last == "}"), F.try_parse_json(text))
    return F.when(F.when(first.isin("{", "["), last.isin("}", "]")).otherwise(True), F.try_parse_json(text))


def exploded(df: DataFrame, value: str, key: str, child: str, pos: str | None = None, outer: bool = False) -> DataFrame:
    """A row per entry of an object or element of an array (key null), with df's columns. With outer, other values keep
    one row without a child. A generator inside code generation, far cheaper than a cast to a map."""
    tvf = df.sparkSession.tvf
    rows = (tvf.variant_explode_outer if outer else tvf.variant_explode)(F.col(value).outer())
    return df.lateralJoin(rows.select(*([F.col("pos").alias(pos)] if pos else []), F.col("key").alias(key), F.col("value").alias(child)))


def kind_of(shape_: Column, value: Column) -> Column:
    """kind, from a shape that is a column already."""
    array = (
        F.when(shape_.isin("ARRAY<VOID>", "ARRAY<VARIANT>"), kind(value))
        .when(shape_ == "ARRAY<STRING>", "array<string>")
        .when(shape_ == "ARRAY<BOOLEAN>", "array<boolean>")
        .when(shape_.startswith("ARRAY<OBJECT<"), "array<object>")
        .when(shape_.startswith("ARRAY<ARRAY<"), "array<array>")
        .otherwise("array<number>")
    )
    return (
        F.when(shape_.isNull() | shape_.isin("VOID", "OBJECT<>"), F.lit(None).cast("string"))
        .when(shape_ == "STRING", "string")
        .when(shape_ == "BOOLEAN", "boolean")
        .when(shape_.startswith("OBJECT<"), "object")
        .when(shape_.startswith("ARRAY<"), array)
        .otherwise("number")
    )


def canonical_of(shape_: Column, value: Column) -> Column:
    """canonical, from a shape that is a column already."""
    named = shape_.isin("STRING", "BOOLEAN") | shape_.startswith("OBJECT<") | shape_.startswith("ARRAY<")
    return F.when(named, F.to_json(value)).when(shape_ != "VOID", F.try_variant_get(value, "$", "double").cast("string"))


def shape(value: Column) -> Column:
    return F.schema_of_variant(value)


def entries(value: Column) -> Column:
    """array<struct<key,value>> of an object; null for anything else."""
    return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))


def elements(value: Column) -> Column:
    """array<variant> of an array; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def simple_kind(value: Column) -> Column:
    """string, number, boolean, object, array or, for null, null."""

    def named(s: Column) -> Column:
        out = F.when(s.isNull() | (s == "VOID"), F.lit(None).cast("string")).when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        return out.when(s.startswith("OBJECT<"), "object").when(s.startswith("ARRAY<"), "array").otherwise("number")

    return let(shape(value), named)


def kind(value: Column) -> Column:
    """simple_kind, but null for empty arrays and objects, and for arrays with the kinds of their elements."""
    held = lambda a: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(a, simple_kind), lambda x: x.isNotNull()))), "|")
    array = let(elements(value), lambda a: F.when(F.size(a) > 0, F.concat(F.lit("array<"), held(a), F.lit(">"))))
    return let(simple_kind(value), lambda k: F.when(k == "array", array).when(k == "object", F.when(shape(value) != "OBJECT<>", k)).otherwise(k))


def canonical(value: Column) -> Column:
    """A text that equal JSON values share: numbers as doubles, keys sorted."""
    return F.when(simple_kind(value) == "number", F.try_variant_get(value, "$", "double").cast("string")).otherwise(F.to_json(value))


def lexeme(value: Column) -> Column:
    """A string as it is, anything else as JSON; null for null."""
    return let(simple_kind(value), lambda k: F.when(k == "string", F.try_variant_get(value, "$", "string")).when(k.isNotNull(), F.to_json(value)))
