"""The append-only run log, per-instance scores, splits and the report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.variants import parsed

# The columns of the comparison table.
TABLE_COLUMNS = ("run", "model", "mode", "subset", "sample", "decode", "extracted", "generated", "overall", "+/-95%", "type acc", "ms/img", "n img", "prec", "bs", "oom")


def run_id(at: Column) -> Column:
    """A UTC time as 20240131T235959Z (the session's time zone must be UTC)."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def append_run(result: DataFrame, folder: str) -> None:
    """Appends each row as one JSON object with sorted keys; earlier rows are never touched."""
    names = sorted(result.columns)
    result.select(F.to_json(F.struct(*names)).alias("value")).write.mode("append").text(f"{folder}/runs")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, body (variant), oldest first; blank and broken lines are left out, a log that is missing is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "run_id string, value string").select("run_id", parsed(F.col("value")).alias("body"))
    lines = spark.read.text(f"{folder}/runs").where(F.trim("value") != "").select(parsed(F.col("value")).alias("body")).where("body is not null")
    return lines.select(F.try_variant_get("body", "$.run_id", "string").alias("run_id"), "body").orderBy("run_id")


def write_scores(scored: DataFrame, folder: str, run: str) -> None:
    """Per-instance scores of one run as CSV with a header."""
    scored.write.mode("error").option("header", True).csv(f"{folder}/per_instance/{run}")


def write_split(parts: DataFrame, path: str) -> None:
    parts.write.mode("overwrite").parquet(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """image_id, part of a written split; raises if an id is in two parts."""
    parts = spark.read.parquet(path)
    twice = parts.groupBy("image_id").agg(F.count_distinct("part").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError("in more than one part: " + ", ".join(r.image_id for r in twice))
    return parts


def generation_label(beams: Column, sample: Column, top_k: Column, top_p: Column, temperature: Column) -> Column:
    """greedy, beam_search(num_beams=n) or sampling(...)."""
    sampling = F.concat(F.lit("sampling(top_k="), top_k.cast("string"), F.lit(", top_p="), top_p.cast("string"), F.lit(", temperature="), temperature.cast("string"), F.lit(")"))
    return F.when(sample, sampling).when(beams == 1, "greedy").otherwise(F.concat(F.lit("beam_search(num_beams="), beams.cast("string"), F.lit(")")))


def generation_options(max_length: int, num_beams: int = 1, do_sample: bool = False, early_stopping: bool = True, **sampling: float | None) -> dict:
    """What a generate call is given; settings of sampling (temperature, top_k, top_p) only if it is on."""
    if unknown := set(sampling) - {"temperature", "top_k", "top_p"}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    fixed = {"max_length": max_length, "num_beams": num_beams, "do_sample": do_sample, "early_stopping": early_stopping}
    return fixed | ({k: v for k, v in sampling.items() if v is not None} if do_sample else {})


def table_row(cells: dict[str, Column]) -> Column:
    """One row of the comparison table, a cell for each of TABLE_COLUMNS ('?' where missing)."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(cells[c].cast("string"), F.lit("?")) if c in cells else F.lit("?") for c in TABLE_COLUMNS)), F.lit(" |"))


def duration(seconds: Column) -> Column:
    """?, 59s, 3m07s or 2h05m."""
    s = F.round(seconds).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(s / 60)
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "?").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(minutes.cast("string"), F.lit("m"), two(s % 60), F.lit("s"))).otherwise(F.concat(hours.cast("string"), F.lit("h"), two(minutes % 60), F.lit("m")))


def scaled_side(side: Column, scale: Column, multiple: int = 32) -> Column:
    """A side times a scale, cut down to a multiple, which is the least."""
    whole = F.floor(side * scale)
    return F.greatest(F.lit(multiple), (F.floor(whole / multiple) * multiple)).cast("int")


def projected(rate: Column, rows: Column, epochs: Column) -> Column:
    """struct<samples_per_s, epoch_s, epoch_hms, total_s, total_hms>; null without a positive rate."""
    ok = (rate > 0) & ~F.isnan(rate)
    epoch = F.try_divide(rows, rate)
    return F.when(ok, F.struct(F.round(rate, 3).alias("samples_per_s"), F.round(epoch, 1).alias("epoch_s"), duration(epoch).alias("epoch_hms"), F.round(epoch * epochs, 1).alias("total_s"), duration(epoch * epochs).alias("total_hms")))
