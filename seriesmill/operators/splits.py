"""Deterministic splits and stratified samples by hashed ids.

An id's place depends on a salt or seed and the id alone. Samples of a fixed size per stratum find the boundary with a
histogram of key prefixes, so no stratum is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions.labels import SOURCES


def bucket(key: Column, salt: str) -> Column:
    """The first 32 bits of MD5(salt:key) as a share of the largest such number, 0 and 1 included."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def validation_split(annotations: DataFrame, fraction: float = 0.05, salt: str = "validation", all_extracted: bool = True) -> DataFrame:
    """The rows of annotations that are held out: those with a bucket below the fraction, and all extracted ones."""
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction must be in (0, 1], not {fraction}")
    low = bucket(F.col("image_id"), salt) < fraction
    extracted = F.col("source") == "extracted"
    return annotations.where(F.coalesce(extracted | low, F.lit(False)) if all_extracted else low)


def complement(rows: DataFrame, held_out: DataFrame, key: str = "image_id") -> DataFrame:
    return rows.join(held_out.select(key), key, "left_anti")


def allocation(strata: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """strata (keys, size) with take: n slots in proportion by largest remainder, ties in order of the keys. With n of
    the whole population or more every stratum gives all."""
    one = W.partitionBy()  # one row per stratum
    s = strata.withColumn("_all", F.sum("size").over(one)).withColumn("_n", F.least(F.lit(n), F.col("_all")))
    s = s.withColumn("_base", F.expr("size * _n div _all")).withColumn("_rest", F.expr("size * _n % _all"))
    s = s.withColumn("_left", F.col("_n") - F.sum("_base").over(one)).withColumn("_rank", F.row_number().over(W.orderBy(F.desc("_rest"), *keys)))
    return s.select(*keys, "size", (F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("bigint")).alias("take"))


def ranked_take(rows: DataFrame, takes: DataFrame, strata: list[str], key: str, seed: int | str) -> DataFrame:
    """Rows with _place, their order of MD5(seed:key) within the stratum, for the first take of each stratum."""
    r = rows.withColumn("_k", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_b", F.substring("_k", 1, 4))
    hist = r.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    hist = hist.withColumn("_off", F.sum("_c").over(W.partitionBy(*strata).orderBy("_b")) - F.col("_c"))
    ends = hist.join(takes.select(*strata, "take"), strata).where("_off < take").select(*strata, "_b", "_off", F.col("take").alias("_take"))
    placed = r.join(ends, [*strata, "_b"]).withColumn("_place", F.col("_off") + F.row_number().over(W.partitionBy(*strata, "_b").orderBy("_k", key)))
    return placed.where("_place <= _take").drop("_k", "_b", "_off", "_take")


def stratified_sample(rows: DataFrame, n: int, seed: int | str = 42, strata: tuple[str, ...] = ("source", "chart_type"), key: str = "image_id") -> DataFrame:
    """n rows (or all) with the population's mix of strata; exact, deterministic, the same in any partitioning."""
    keys = list(strata)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"))
    return ranked_take(rows, allocation(sizes, n, keys), keys, key, seed).drop("_place")


def three_way(rows: DataFrame, seed: int | str = 42, train: float = 0.6, val_of_train: float = 0.1, stratum: str = "chart_type", key: str = "image_id") -> DataFrame:
    """rows with part: per stratum, round(n * train) rows are fitted on, of which round(.. * val_of_train) validate
    (halves to even; each side keeps at least one row where there are two); the rest is holdout."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    fit, val = F.bround(F.col("_n") * train), F.bround(F.col("_fit") * val_of_train)
    clamp = lambda x, n: F.when(n >= 2, F.greatest(F.lit(1), F.least(x.cast("bigint"), n - 1))).otherwise(x.cast("bigint"))
    sizes = sizes.withColumn("_fit", clamp(fit, F.col("_n"))).withColumn("_val", clamp(val, F.col("_fit")))
    placed = ranked_take(rows, sizes.select(stratum, F.col("_n").alias("take")), [stratum], key, seed)
    part = F.when(F.col("_place") <= F.col("_val"), "val").when(F.col("_place") <= F.col("_fit"), "train").otherwise("holdout")
    return placed.join(sizes.select(stratum, "_fit", "_val"), stratum).withColumn("part", part).drop("_place", "_fit", "_val")


def overlapping(parts: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids that are in more than one part; empty for a proper split."""
    return parts.groupBy(key).agg(F.count_distinct("part").alias("parts")).where("parts > 1")


def composition(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by source, by source and chart type, and in all, within each combination of by. level says which."""
    g = F.grouping_id("source", "chart_type")
    c = rows.groupingSets([[*by], [*by, "source"], [*by, "source", "chart_type"]], *by, "source", "chart_type").agg(F.count("*").alias("n"), g.alias("_g"))
    return c.select(*by, F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "source").otherwise("source/chart_type").alias("level"), "source", "chart_type", "n")


def oversampled(extracted: DataFrame, generated: DataFrame, times: int) -> DataFrame:
    """Extracted rows times over and generated rows once, with copy (from 1)."""
    many = extracted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))) if times > 0 else extracted.limit(0).withColumn("copy", F.lit(1))
    return many.unionByName(generated.withColumn("copy", F.lit(1)))


def subset(images: DataFrame, which: str) -> DataFrame:
    """The images of one source, or of both; any other word is an error."""
    if which not in ("both", *SOURCES):
        raise ValueError(f"unknown subset {which!r}; known: both, {', '.join(SOURCES)}")
    return images if which == "both" else images.where(F.col("source") == which)


def leaked(training: DataFrame, holdout: DataFrame) -> DataFrame:
    """image_id of held-out images among the training rows, each once."""
    return holdout.select("image_id").join(training.select("image_id"), "image_id", "left_semi").distinct()


def refuse_leaks(training: DataFrame, holdout: DataFrame) -> None:
    """Raises, naming three of them, if a held-out image is among the training rows."""
    found = leaked(training, holdout).orderBy("image_id").limit(3).collect()
    if found:
        raise ValueError("held-out images in the training rows: " + ", ".join(r.image_id for r in found))
