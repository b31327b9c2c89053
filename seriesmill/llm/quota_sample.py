"""A sample whose categories follow target shares.

Counts per category are the only thing that is gathered; quotas come from largest remainders with floors and caps, and
within a category the items with the smallest random keys are taken. A key depends on the item alone, so reruns and
other partitionings take the same items.

A category may hold any part of all rows: keys are cut into 65,536 buckets, a histogram finds the bucket in which a
quota ends, and only rows of one bucket are ever sorted together. The windows over a group's categories hold one row
per target.

Defined results: items with a null group or category match no target; repeated targets count once, with their largest
figures; null figures are 0; a target without items has available 0; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions.labels import CHART_TYPES, SOURCES, image_key, label


def latest_labels(annotations: DataFrame) -> DataFrame:
    """One row per image named in annotations: batch_id and labels of its latest annotation (annotated_at, then
    annotation_id; null times first). Labels outside the vocabularies are null."""
    a = annotations.select(image_key(F.col("image_id")).alias("image_id"), F.struct("annotated_at", "annotation_id", "batch_id", "source", "chart_type").alias("_a")).where("image_id is not null")
    last = a.groupBy("image_id").agg(F.max("_a").alias("_a"))
    return last.select("image_id", "_a.batch_id", label(F.col("_a.source"), SOURCES).alias("source"), label(F.col("_a.chart_type"), CHART_TYPES).alias("chart_type"))


def quotas(counts: DataFrame, targets: DataFrame, group: list[str], category: list[str], share: str = "target_permille", floor: str = "min_count", size: str = "sample_size") -> DataFrame:
    """The report, one row per target: group, category, required, available, quota, short.

    counts has group, category and n. required is the larger of the floor and the share of the sample, rounded down;
    short is what is missing for want of items. A group draws the sum of its shares of the sample size, or more where
    floors ask for more. Quotas are proportional to shares, but no less than what is required (if there is that much)
    and no more than what is available: one level serves all categories that neither bound holds, and is found exactly,
    as if slots of categories that run out were shared again and again. Fractions go to the largest remainders."""
    by = group + category
    long = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    t = targets.groupBy(*by).agg(*(F.max(long(c)).alias(a) for c, a in ((share, "_share"), (floor, "_floor"), (size, "_size"))))
    t = t.join(counts.where(F.expr(" and ".join(f"{c} is not null" for c in by))).select(*by, F.col("n").alias("_n")), by, "left")
    g = W.partitionBy(*group)
    t = t.select(*by, F.greatest("_share", F.lit(0)).alias("_share"), "_floor", "_size", F.coalesce("_n", F.lit(0)).cast("bigint").alias("available"))
    t = t.withColumn("required", F.greatest("_floor", F.expr("_share * _size div 1000"))).withColumn("_lo", F.least("required", "available"))
    t = t.withColumn("_goal", F.greatest(F.expr("sum(_share) over g * max(_size) over g div 1000".replace("over g", f"over (partition by {', '.join(group)})")), F.sum("_lo").over(g)))
    # As the level (slots a share) rises, a category begins to grow at _lo / _share and stops at available / _share. The
    # total at a bend is base + level * slope; the last bend that does not exceed the goal tells which categories grow.
    bend = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("sign"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    bends = t.where("_share > 0").withColumn("_lows", F.sum("_lo").over(g)).select(*group, "_goal", "_share", F.explode(F.array(bend("_lo", 1), bend("available", -1))).alias("_b"))
    # The lower bounds of categories without a share never change.
    fixed = t.groupBy(*group).agg(F.sum("_lo").alias("_lows"))
    level = W.partitionBy(*group).orderBy("_level").rangeBetween(W.unboundedPreceding, 0)
    bends = bends.join(fixed, group).withColumn("_level", (big("_b.at") / big("_share")).cast("decimal(38,12)"))
    bends = bends.withColumn("_slope", F.sum(F.col("_b.sign") * F.col("_share")).over(level)).withColumn("_base", F.col("_lows") - F.sum(F.col("_b.sign") * F.col("_b.at")).over(level))
    reached = big("_b.at") * big("_slope") <= (F.col("_goal") - F.col("_base")).cast("decimal(19,0)") * big("_share")
    last = bends.where(reached).groupBy(*group).agg(F.max_by(F.struct("_slope", "_base", "_level"), "_level").alias("_l"))
    t = t.join(last, group, "left").withColumn("_left", (F.col("_goal") - F.col("_l._base")).cast("decimal(19,0)"))
    # Between its bounds a category has its share of what the others leave.
    exact = big("_left") * big("_share")
    grows = (F.col("_l._slope") > 0) & (F.col("_share") > 0) & (exact >= big("_lo") * big("_l._slope")) & (exact < big("available") * big("_l._slope"))
    part = F.expr("cast(cast(_left as decimal(19,0)) * cast(_share as decimal(19,0)) as decimal(38,0))")
    whole = F.when(grows, part - part % F.nullif(big("_l._slope"), F.lit(0)))
    t = t.withColumn("_rest", F.when(grows, part % F.nullif(big("_l._slope"), F.lit(0)))).withColumn("_q", F.when(grows, F.round(whole / F.nullif(big("_l._slope"), F.lit(0)), 0).cast("bigint")).when((F.col("_share") > 0) & ((F.col("_l._slope") <= 0) | (exact >= big("available") * big("_l._slope"))), F.col("available")).otherwise(F.col("_lo")))
    t = t.withColumn("_open", F.coalesce(F.col("_rest") > 0, F.lit(False))).withColumn("_more", F.col("_goal") - F.sum("_q").over(g))
    t = t.withColumn("_rank", F.row_number().over(g.orderBy(F.desc("_open"), F.desc("_rest"), *category)))
    quota = F.col("_q") + (F.col("_open") & (F.col("_rank") <= F.col("_more"))).cast("bigint")
    return t.select(*by, "required", "available", quota.alias("quota"), F.greatest(F.lit(0), F.col("required") - F.col("available")).alias("short"))


def random_key(item: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), item.cast("string")))


def _histogram(items: DataFrame, by: list[str], item: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """by, item, _k (random key) and _b (its bucket) of the items, and _n of them by bucket."""
    keyed = items.where(F.col(item).isNotNull()).select(*by, item, random_key(F.col(item), seed).alias("_k")).withColumn("_b", F.substring("_k", 1, 4))
    return keyed, keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))


def smallest_keys(items: DataFrame, report: DataFrame, by: list[str], item: str, seed: int = 0) -> DataFrame:
    """by and item of the quota items with the smallest random keys per category. Whole buckets are taken as they are;
    only rows of the bucket in which a quota ends are ranked."""
    return _taken(*_histogram(items, by, item, seed), report, by, item)


def _taken(keyed: DataFrame, hist: DataFrame, report: DataFrame, by: list[str], item: str) -> DataFrame:
    hist = hist.withColumn("_to", F.sum("_n").over(W.partitionBy(*by).orderBy("_b")))
    ends = hist.join(report.where("quota > 0").select(*by, "quota"), by).where("_to - _n < quota")
    ends = ends.groupBy(*by).agg(F.max("_b").alias("_end"), F.max_by(F.expr("quota - (_to - _n)"), "_b").alias("_take"))
    near = keyed.join(ends, by).where("_b <= _end")
    edge = near.where("_b = _end").withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_k", item)))
    return near.where("_b < _end").select(*by, item).unionByName(edge.where("_r <= _take").select(*by, item))


GROUP, CATEGORY = ["batch_id"], ["source", "chart_type"]


def batch_report(annotations: DataFrame, targets: DataFrame) -> DataFrame:
    """quotas() of annotated images by batch, source and chart type."""
    counts = latest_labels(annotations).groupBy(*GROUP, *CATEGORY).agg(F.count("*").alias("n"))
    return quotas(counts, targets, GROUP, CATEGORY)


def batch_sample(annotations: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """batch_id, source, chart_type, image_id of the sample. Counts come from the histogram of keys, so that one grouping
    of annotations by image serves quotas and sample."""
    by = GROUP + CATEGORY
    keyed, hist = _histogram(latest_labels(annotations).where(F.expr(" and ".join(f"{c} is not null" for c in by))), by, "image_id", seed)
    report = quotas(hist.groupBy(*by).agg(F.sum("_n").alias("n")), targets, GROUP, CATEGORY)
    return _taken(keyed, hist, report, by, "image_id")
