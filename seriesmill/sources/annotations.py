"""Images and annotations on disk: discovery, reading, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.labels import CHART_TYPES, SOURCES
from seriesmill.functions.values import SERIES, float_val, val
from seriesmill.functions.variants import elements, entries, parsed, shape


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")


def discover_images(spark: SparkSession, folder: str, pattern: str = "*.jpg", content: bool = False) -> DataFrame:
    """image_id (file stem), path and, if asked for, content of the folder's own files. Raises on a stem that occurs twice."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    refs = files.select(file_stem(F.col("path")).alias("image_id"), "path", *(["content"] if content else []))
    twice = refs.groupBy("image_id").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError("image ids occur twice: " + ", ".join(r.image_id for r in twice))
    return refs


def json_val(v: Column) -> Column:
    """A JSON scalar as VAL. Integers come as BIGINT or, from 19 digits on, as decimals without places; other numbers are
    floats. Null, missing and nested values are of kind null."""
    s, d = shape(v), F.try_variant_get(v, "$", "double")
    text = F.to_json(v)
    none = F.lit(None).cast("string")
    return (
        F.when(v.isNull() | (s == "VOID"), val("null", F.lit("None"), F.lit(None)))
        .when(s == "STRING", val("str", F.try_variant_get(v, "$", "string"), F.lit(None)))
        .when(s == "BOOLEAN", val("bool", F.initcap(text), F.lit(None)))
        .when(s.startswith("OBJECT") | s.startswith("ARRAY"), val("null", none, F.lit(None)))
        .when((s == "BIGINT") | F.regexp_like(s, F.lit(r"^DECIMAL\((?:19|[23]\d),0\)$")), val("int", text, d))
        .otherwise(float_val(d))
    )


def parsed_annotation(text: Column) -> Column:
    """struct<source, chart_type, x_series, y_series, error>. error names the first thing wrong: not_json, missing_<key>,
    bad_source, bad_chart_type, bad_point; the rest is null then."""
    top = F.map_from_entries(entries(parsed(text)))
    get = lambda k: F.try_element_at(top, F.lit(k))
    word = lambda k: F.try_variant_get(get(k), "$", "string")
    points = F.transform(elements(get("data-series")), lambda p: F.map_from_entries(entries(p)))
    missing = F.when(top.isNull(), "not_json")
    for k in ("source", "chart-type", "data-series"):
        missing = missing.when(~F.map_contains_key(top, k), f"missing_{k}")
    whole = F.forall(points, lambda p: F.coalesce(F.map_contains_key(p, "x") & F.map_contains_key(p, "y"), F.lit(False)))
    error = missing.when(~F.coalesce(word("source").isin(*SOURCES), F.lit(False)), "bad_source").when(~F.coalesce(word("chart-type").isin(*CHART_TYPES), F.lit(False)), "bad_chart_type").when(~F.coalesce(whole, F.lit(False)), "bad_point")
    axis = lambda a: F.when(error.isNull(), F.transform(points, lambda p: json_val(p[a]))).cast(SERIES)
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(word("source")).alias("source"), good(word("chart-type")).alias("chart_type"), axis("x").alias("x_series"), axis("y").alias("y_series"), error.alias("error"))


def read_annotations(spark: SparkSession, folder: str, ids: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """image_id, source, chart_type, x_series, y_series of a folder of JSON files, of all or of the given ids.

    A bad file raises while it is read. With strict, an id without a file raises here; else it is left out."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(file_stem(F.col("_metadata.file_path")).alias("image_id"), F.col("value"))
    if ids is not None:
        wanted = ids.select("image_id").distinct()
        lost = wanted.join(raw.select("image_id"), "image_id", "left_anti").limit(3).collect() if strict else []
        if lost:
            raise FileNotFoundError("no annotation for " + ", ".join(r.image_id for r in lost))
        raw = raw.join(wanted, "image_id", "left_semi")
    a = raw.select("image_id", parsed_annotation(F.col("value")).alias("_a"))
    checked = F.when(F.col("_a.error").isNull(), F.col("_a.source")).otherwise(F.raise_error(F.concat_ws(": ", "image_id", "_a.error")))
    return a.select("image_id", checked.alias("source"), "_a.chart_type", "_a.x_series", "_a.y_series")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """image_id from a JSON list, a JSON object with holdout_ids, image_ids or ids (the first it has), or lines."""
    text = spark.read.text(path, wholetext=True)
    top = parsed(F.col("value"))
    keyed = F.map_from_entries(entries(top))
    listed = F.coalesce(elements(top), *(elements(F.try_element_at(keyed, F.lit(k))) for k in ("holdout_ids", "image_ids", "ids")))
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    refused = F.when(keyed.isNotNull(), F.raise_error(F.lit("no list of ids")).cast("array<string>")).otherwise(lines)
    got = F.when(listed.isNotNull(), F.transform(listed, lambda v: F.try_variant_get(v, "$", "string"))).otherwise(refused)
    return text.select(F.explode(got).alias("image_id"))
