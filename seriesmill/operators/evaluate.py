"""Scores and reports of a run: instance scores, breakdowns, confidence, taxonomy, populations, sanity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.metric import instance_score
from seriesmill.operators.pipeline import instances

# Categories, those that need detectors, and the category of each failure.
CATEGORIES = ("ok", "malformed_sequence", "wrong_chart_type", "axis_misestimation", "marker_miss", "unsupported_chart_type", "decode_error")
DETECTION_ONLY = ("axis_misestimation", "marker_miss", "unsupported_chart_type")
MALFORMED = ("no_chart_type_token", "missing_series_delimiters", "empty_series", "generation_error")
LATER = {"unusable_axis_calibration": "axis_misestimation", "missing_marker_detections": "marker_miss", "no_markers_decoded": "marker_miss", "decode_error": "decode_error"}
# Fixed values of the sanity checks.
REFERENCE = {"donut_only": 0.44}
NEAR_ZERO, SUSPICIOUS, SMALL_SAMPLE, Z95 = 0.05, 0.5, 50, 1.96


def scored_instances(truth: DataFrame, out: DataFrame) -> DataFrame:
    """instance_id, image_id, axis, source, chart_type, predicted_chart_type, score: one row per image and axis of truth.
    An image without outcome scores against an empty series of no type. One join by image; series never leave it."""
    p = out.select("image_id", F.col("chart_type").alias("_t"), F.col("x_series").alias("_x"), F.col("y_series").alias("_y"))
    d = truth.join(p, "image_id", "left")
    both = F.array(
        F.struct(F.lit("x").alias("axis"), instance_score(F.col("chart_type"), F.col("x_series"), F.col("_t"), F.col("_x")).alias("score")),
        F.struct(F.lit("y").alias("axis"), instance_score(F.col("chart_type"), F.col("y_series"), F.col("_t"), F.col("_y")).alias("score")),
    )
    d = d.select("image_id", "source", "chart_type", F.coalesce("_t", F.lit("")).alias("predicted_chart_type"), F.explode(both).alias("_s"))
    return d.select(F.concat_ws("_", "image_id", "_s.axis").alias("instance_id"), "image_id", "_s.axis", "source", "chart_type", "predicted_chart_type", "_s.score")


def truth_instances(truth: DataFrame) -> DataFrame:
    """id, image_id, axis, data_series, chart_type."""
    i = instances(truth, "chart_type")
    return i.select(F.concat_ws("_", "image_id", "axis").alias("id"), "image_id", "axis", F.col("series").alias("data_series"), "chart_type")


def competition_score(solution: DataFrame, submitted: DataFrame) -> DataFrame:
    """One row, score: the mean over instances; raises while it runs if the two tables do not hold the same ids."""
    s = solution.select("id", F.col("data_series").alias("_ts"), F.col("chart_type").alias("_tt"), F.lit(True).alias("_l"))
    p = submitted.select("id", F.col("data_series").alias("_ps"), F.col("chart_type").alias("_pt"), F.lit(True).alias("_r"))
    d = s.join(p, "id", "full")
    score = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("solution and submission hold different ids")).cast("double")).otherwise(instance_score(F.col("_tt"), F.col("_ts"), F.col("_pt"), F.col("_ps")))
    return d.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("score"))


def breakdown(scored: DataFrame) -> DataFrame:
    """level, source, chart_type, axis, score, n_instances, chart_type_accuracy: overall and by chart type, source, axis, and
    source and chart type, all from one pass."""
    sets = [["chart_type"], ["source"], ["axis"], ["source", "chart_type"], []]
    g = scored.groupingSets(sets, "source", "chart_type", "axis").agg(
        F.avg("score").alias("score"), F.count("*").alias("n_instances"), F.avg((F.col("chart_type") == F.col("predicted_chart_type")).cast("double")).alias("chart_type_accuracy"), F.grouping_id("source", "chart_type", "axis").alias("_g")
    )
    level = F.when(F.col("_g") == 7, "overall").when(F.col("_g") == 5, "chart_type").when(F.col("_g") == 3, "source").when(F.col("_g") == 6, "axis").otherwise("source_and_chart_type")
    return g.select(level.alias("level"), "source", "chart_type", "axis", "score", "n_instances", "chart_type_accuracy")


def confidence(scored: DataFrame) -> DataFrame:
    """One row: overall, n_instances, n_images, stderr (clustered by image; 0 for one image), ci_low, ci_high, chart_type_accuracy."""
    hit = (F.col("chart_type") == F.col("predicted_chart_type")).cast("double")
    image = scored.groupBy("image_id").agg(F.avg("score").alias("_m"), F.sum("score").alias("_s"), F.count("score").alias("_k"), F.count("*").alias("_n"), F.sum(hit).alias("_h"), F.count(hit).alias("_hn"))
    r = image.agg(
        F.coalesce(F.sum("_s") / F.nullif(F.sum("_k"), F.lit(0)), F.lit(0.0)).alias("overall"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_instances"),
        F.count("*").alias("n_images"),
        F.coalesce(F.stddev_samp("_m") / F.sqrt(F.count("_m")), F.lit(0.0)).alias("stderr"),
        (F.sum("_h") / F.nullif(F.sum("_hn"), F.lit(0))).alias("chart_type_accuracy"),
    )
    return r.withColumn("ci_low", F.col("overall") - Z95 * F.col("stderr")).withColumn("ci_high", F.col("overall") + Z95 * F.col("stderr"))


def category(failure: Column, predicted: Column, truth: Column, oom_is_malformed: bool = False) -> Column:
    """The taxonomy category of an outcome. An unknown failure is its own category unless the type is wrong; oom is one
    of those, or counts as malformed if asked for."""
    wrong = truth.isNotNull() & ~predicted.eqNullSafe(truth)
    malformed = (*MALFORMED, "oom") if oom_is_malformed else MALFORMED
    out = F.when(failure.startswith("no_decoder_for_"), "unsupported_chart_type").when(failure.isin(*malformed), "malformed_sequence").when(wrong, "wrong_chart_type")
    for mode, cat in LATER.items():
        out = out.when(failure == mode, cat)
    return out.otherwise(F.coalesce(F.nullif(failure, F.lit("")), F.lit("ok")))


def categorised(out: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, truth_type (unknown without truth), category."""
    t = truth.select("image_id", F.col("chart_type").alias("_t"))
    d = out.join(t, "image_id", "left")
    return d.select("image_id", F.coalesce("_t", F.lit("unknown")).alias("truth_type"), category(F.col("failure_mode"), F.col("chart_type"), F.col("_t")).alias("category"))


def applicable(mode: str) -> tuple[str, ...]:
    return tuple(c for c in CATEGORIES if mode != "donut_only" or c not in DETECTION_ONLY)


def _zero_filled(counts: DataFrame, by: list[str], names: tuple[str, ...]) -> DataFrame:
    """counts with a row for every name in every group; a group's rows grow by the few names it lacks."""
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    every = groups.select("*", F.explode(F.array(*map(F.lit, names))).alias("category"))
    return every.withColumn("n", F.lit(0).cast("bigint")).unionByName(counts).groupBy(*by, "category").agg(F.sum("n").alias("n"))


def taxonomy(cats: DataFrame, mode: str = "full") -> DataFrame:
    """category, n over the categories of the mode, zeros included, and any other that occurs."""
    return _zero_filled(cats.groupBy("category").agg(F.count("*").alias("n")), [], applicable(mode))


def taxonomy_by_type(cats: DataFrame) -> DataFrame:
    """truth_type, category, n, zeros included."""
    return _zero_filled(cats.groupBy("truth_type", "category").agg(F.count("*").alias("n")), ["truth_type"], CATEGORIES)


def not_applicable(mode: str) -> list[str]:
    return [c for c in CATEGORIES if c not in applicable(mode)]


def populations(truth: DataFrame, out: DataFrame, chart_type: str = "horizontal_bar") -> DataFrame:
    """kind (ground_truth, predicted), chart_type, n: the size of one type on both sides, and of every true type."""
    t = truth.groupBy(F.lit("by_ground_truth").alias("kind"), "chart_type").agg(F.count("*").alias("n"))
    hits = lambda d, k: d.agg(F.count_if(F.col("chart_type") == chart_type).alias("n")).select(F.lit(k).alias("kind"), F.lit(chart_type).alias("chart_type"), "n")
    return t.unionByName(hits(truth, "ground_truth")).unionByName(hits(out, "predicted"))


def dataset_summary(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("source", "chart_type").agg(F.count("*").alias("count")).orderBy("source", F.desc("count"), "chart_type")


def scored_composition(scored: DataFrame) -> DataFrame:
    """One row: total, generated, extracted, their shares, label, distribution_applies; from instances, not from a split."""
    c = scored.agg(F.count("source").alias("total"), F.count_if(F.col("source") == "generated").alias("generated"), F.count_if(F.col("source") == "extracted").alias("extracted"))
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("total")), F.lit(0.0))
    percent = lambda x: F.concat(F.bround(100 * share(x)).cast("int").cast("string"), F.lit("%"))
    label = F.when(F.col("total") == 0, "empty").when(F.col("generated") == 0, "extracted-only").when(F.col("extracted") == 0, "generated-only (fully synthetic)").otherwise(F.concat(F.lit("mixed ("), percent("generated"), F.lit(" generated, "), percent("extracted"), F.lit(" extracted)")))
    return c.select("total", "generated", "extracted", share("generated").alias("generated_fraction"), share("extracted").alias("extracted_fraction"), label.alias("label"), (F.col("generated") > 0).alias("distribution_applies"))


def sanity(scores: DataFrame, mode: str, reference: float | None = None, reference_mode: str | None = None) -> DataFrame:
    """level, code per warning on a table with overall and n_instances: near zero; far below, below or above the
    reference of the mode; a small sample; a reference of another mode."""
    ref = REFERENCE.get(mode) if reference is None else reference
    other = reference_mode is not None and reference_mode != mode
    o, n = F.col("overall"), F.col("n_instances")
    w = lambda cond, level, code: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    found = [w(o < NEAR_ZERO, "error", "score_near_zero")]
    if ref is not None and other:
        found.append(w(F.lit(True), "info", "reference_mode_mismatch"))
    elif ref is not None:
        found += [w(o < ref * SUSPICIOUS, "error", "far_below_reference"), w((o >= ref * SUSPICIOUS) & (o < ref), "warning", "below_reference"), w(o >= ref, "info", "above_reference"), w((n > 0) & (n < SMALL_SAMPLE), "warning", "small_sample")]
    return scores.select("overall", "n_instances", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_w")).select("_w.level", "_w.code", "overall", "n_instances")


def oom_summary(events: DataFrame) -> DataFrame:
    """stage-independent counts of events: all, recovered, unrecovered, and distinct images of either."""
    back = F.col("recovered")
    return events.agg(F.count("*").alias("n_events"), F.count_if(back).alias("n_recovered"), F.count_if(~back).alias("n_unrecovered"), F.count_distinct(F.when(back, F.col("image_id"))).alias("degraded_images"), F.count_distinct(F.when(~back, F.col("image_id"))).alias("failed_images"))


def oom_images(events: DataFrame) -> DataFrame:
    """image_id and recovered of every image that ran out of memory, each once, sorted; a table, however many there are."""
    return events.select("image_id", "recovered").distinct().orderBy("image_id", "recovered")


def oom_events(generated: DataFrame, height: int, width: int, multiple: int = 32) -> DataFrame:
    """image_id, scale, height, width, recovered of the images that stages.run_generation had to retry; sizes are those
    they were read at, null where no scale fitted."""
    side = lambda n: F.when(F.col("recovered"), F.greatest(F.lit(multiple), F.floor(F.floor(F.col("scale") * n) / multiple) * multiple).cast("int"))
    return generated.where("recovered is not null").select("image_id", "scale", side(height).alias("height"), side(width).alias("width"), "recovered")


def latency(timings: DataFrame) -> DataFrame:
    """timings (n_images, donut_s, axis_s, markers_s, decode_s) as milliseconds per image, total_ms included."""
    per = lambda s: 1000 * s / F.greatest(F.col("n_images"), F.lit(1))
    stages = ("donut", "axis", "markers", "decode")
    return timings.withColumns({f"{s}_ms": per(F.col(f"{s}_s")) for s in stages}).withColumn("total_ms", per(sum((F.col(f"{s}_s") for s in stages), F.lit(0.0))))


def recipe(rows: DataFrame, oversample: int) -> DataFrame:
    """One row on training candidates (source, parses, fits): what is used how often, and what was dropped for which reason."""
    ok = F.col("parses") & F.col("fits")
    r = rows.agg(F.count_if(ok & (F.col("source") == "extracted")).alias("n_extracted_unique"), F.count_if(ok & (F.col("source") == "generated")).alias("n_generated_rows"), F.count_if(~F.col("parses")).alias("n_dropped_unserialisable"), F.count_if(F.col("parses") & ~F.col("fits")).alias("n_dropped_too_long"))
    r = r.withColumn("oversample", F.lit(oversample)).withColumn("n_extracted_rows", F.col("n_extracted_unique") * oversample).withColumn("n_rows", F.col("n_extracted_rows") + F.col("n_generated_rows"))
    return r.withColumn("extracted_share", F.round(F.coalesce(F.try_divide("n_extracted_rows", "n_rows"), F.lit(0.0)), 4))
