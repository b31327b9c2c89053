"""Queries of the chart pipeline and its evaluation over the driver tables.

Truth is the annotations table with its labels read by letters, each annotation an image of its own. Stage outputs are
derived from the tables by fixed arithmetic, the same in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions import calibration, geometry, metric, repair, tokens
from seriesmill.functions.labels import CHART_TYPES, SOURCES, image_key, label
from seriesmill.functions.values import SERIES, VAL
from seriesmill.operators import evaluate, pipeline, splits
from seriesmill.sources import runlog


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    a = _t(spark, sf, "annotations")
    a = a.select(F.col("annotation_id").cast("string").alias("image_id"), F.col("annotation_id").alias("n"), label(F.col("source"), SOURCES).alias("source"), label(F.col("chart_type"), CHART_TYPES).alias("chart_type"), F.col("x").alias("x_series"), F.col("y").alias("y_series"))
    return a.where("source is not null and chart_type is not null and x_series is not null and y_series is not null")


def _raw(t: DataFrame) -> DataFrame:
    """image_id, raw: the truth as a token sequence, damaged by the number of its annotation."""
    join = lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(v["s"], F.lit(""))), ";")
    seq = F.concat(F.lit("<|BOS|><"), F.col("chart_type"), F.lit("><x_start>"), join("x_series"), F.lit("<x_end><y_start>"), join("y_series"), F.lit("<y_end></s>"))
    n = F.col("n")
    raw = F.when(n % 11 == 0, F.replace(seq, F.lit("<y_end>"), F.lit(""))).when(n % 13 == 0, F.replace(seq, F.concat(F.lit("<"), F.col("chart_type"), F.lit(">")), F.lit(""))).when(n % 17 == 0, F.replace(seq, F.lit("1"), F.lit("<one>"))).otherwise(seq)
    return t.select("image_id", raw.alias("raw"))


def _perturbed(t: DataFrame) -> DataFrame:
    """Outcomes: a series shortened, shifted or kept, and a type swapped, by the number of the annotation."""
    n = F.col("n")

    def series(c: str) -> Column:
        moved = F.transform(c, lambda v: F.struct(v["kind"].alias("kind"), F.concat(v["s"], F.lit("x")).alias("s"), (v["d"] * 1.1).alias("d")))
        return F.when(n % 5 == 0, F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))).when(n % 5 == 1, moved).otherwise(F.col(c)).cast(SERIES)

    kind = F.when(n % 19 == 0, "dot").otherwise(F.col("chart_type"))
    failure = F.when(n % 23 == 0, "empty_series").when(n % 29 == 0, "unusable_axis_calibration").when(n % 31 == 0, "no_markers_decoded").when(n % 37 == 0, F.concat(F.lit("no_decoder_for_"), F.col("chart_type")))
    return t.select("image_id", kind.alias("chart_type"), series("x_series").alias("x_series"), series("y_series").alias("y_series"), failure.alias("failure_mode"))


def c_parse_tokens(spark: SparkSession, sf: str) -> DataFrame:
    p = pipeline.predictions(_raw(_truth(spark, sf)), clean=False)
    text = lambda c: F.array_join(F.transform(c, lambda v: v["s"]), ";")
    return p.select("image_id", "chart_type", F.coalesce("failure_mode", F.lit("ok")).alias("failure"), text("x").alias("x"), text("y").alias("y"), F.size("y").cast("bigint").alias("n"))


def c_token_scores(spark: SparkSession, sf: str) -> DataFrame:
    """End to end: sequences parsed and repaired, decoded without detectors, scored, and broken down in one pass."""
    t = _truth(spark, sf)
    out = pipeline.outcomes(t, pipeline.predictions(_raw(t)), mode="donut_only")
    return evaluate.breakdown(evaluate.scored_instances(t, out)).withColumn("score", F.round("score", 6)).withColumn("chart_type_accuracy", F.round("chart_type_accuracy", 6))


def c_repair(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    token = F.when(k % 7 == 0, F.concat(F.lit("$"), price)).when(k % 7 == 1, F.replace(price, F.lit("."), F.lit(". "))).when(k % 7 == 2, F.concat(F.lit("--"), price)).when(k % 7 == 3, F.concat(price, F.lit(".5"))).when(k % 7 == 4, F.concat(F.substring_index(price, ".", 1), F.lit("E"))).when(k % 7 == 5, "2010-2015").otherwise(price)
    o = _t(spark, sf, "orders").select("o_orderkey", repair.repaired(token).alias("v"))
    return o.select("o_orderkey", "v.kind", F.round("v.d", 4).alias("d"))


def c_instance_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    s = evaluate.scored_instances(t, _perturbed(t))
    return s.select("instance_id", "axis", "source", "chart_type", "predicted_chart_type", F.round("score", 6).alias("score"))


def c_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    b = evaluate.breakdown(_t(spark, sf, "scored"))
    return b.select("level", "source", "chart_type", "axis", F.round("score", 6).alias("score"), "n_instances", F.round("chart_type_accuracy", 6).alias("chart_type_accuracy"))


def c_confidence(spark: SparkSession, sf: str) -> DataFrame:
    c = evaluate.confidence(_t(spark, sf, "scored"))
    return c.select("n_instances", "n_images", *(F.round(x, 6).alias(x) for x in ("overall", "stderr", "ci_low", "ci_high", "chart_type_accuracy")))


def c_sanity(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.sanity(evaluate.confidence(_t(spark, sf, "scored")), "donut_only").select("level", "code", F.round("overall", 6).alias("overall"), "n_instances")


def c_scored_composition(spark: SparkSession, sf: str) -> DataFrame:
    c = evaluate.scored_composition(_t(spark, sf, "scored"))
    return c.select("total", "generated", "extracted", F.round("generated_fraction", 6).alias("generated_fraction"), "distribution_applies")


def c_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    return evaluate.taxonomy(evaluate.categorised(_perturbed(t), t))


def c_taxonomy_by_type(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    return evaluate.taxonomy_by_type(evaluate.categorised(_perturbed(t), t))


def c_failures(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.failure_summary(_perturbed(_truth(spark, sf)))


def c_populations(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    return evaluate.populations(t, _perturbed(t))


def c_submission(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    return pipeline.submission(t, _perturbed(t).where("failure_mode is null")).select("id", "data_series", "chart_type")


def c_training_sequences(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    return t.select("image_id", tokens.sequence(F.col("chart_type"), F.col("x_series"), F.col("y_series")).alias("sequence"), tokens.survives_round_trip(F.col("chart_type"), F.col("x_series"), F.col("y_series")).alias("round_trip"))


def c_recipe(spark: SparkSession, sf: str) -> DataFrame:
    rows = c_training_sequences(spark, sf).join(_truth(spark, sf).select("image_id", "source"), "image_id")
    return evaluate.recipe(rows.select("source", F.coalesce("round_trip", F.lit(False)).alias("parses"), (F.coalesce(F.length("sequence"), F.lit(0)) <= 512).alias("fits")), 4)


def c_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.dataset_summary(_truth(spark, sf))


def c_composition(spark: SparkSession, sf: str) -> DataFrame:
    return splits.composition(_truth(spark, sf))


def c_bucket_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.validation_split(_truth(spark, sf)).select("image_id", "source", F.round(splits.bucket(F.col("image_id"), "validation"), 9).alias("bucket"))


def c_complement(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    return splits.complement(t, splits.validation_split(t)).select("image_id")


def c_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_sample(_truth(spark, sf), 1000).select("image_id", "source", "chart_type")


def c_three_way(spark: SparkSession, sf: str) -> DataFrame:
    return splits.three_way(_truth(spark, sf).where("source = 'extracted'")).select("image_id", "chart_type", "part")


def c_oversampled(spark: SparkSession, sf: str) -> DataFrame:
    t = _truth(spark, sf)
    o = splits.oversampled(t.where("source = 'extracted'"), t.where("source = 'generated'"), 4)
    return o.groupBy("source", "chart_type").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


def _order_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: boxes and ticks from its lines."""
    li = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_partkey").alias("p")))).alias("l"))
    box = lambda v: F.struct((v["p"] % 200).cast("double").alias("x1"), (v["q"] * 2).alias("y1"), (v["p"] % 200 + 10).cast("double").alias("x2"), (v["q"] * 2 + 10).alias("y2"), F.lit(3).alias("label"), (F.pmod(v["p"], F.lit(10)) / 10.0).cast("double").alias("score"))
    point = lambda v: F.struct((v["l_linenumber"] * 40.0).alias("px"), (220.0 - v["l_linenumber"] * 20.0).alias("py"))
    k = F.col("l_orderkey")
    kinds = F.element_at(F.array(*map(F.lit, CHART_TYPES)), (k % 5 + 1).cast("int"))
    series = F.transform("l", lambda v: F.struct(F.lit("float").alias("kind"), v["q"].cast("string").alias("s"), v["q"].alias("d")).cast(VAL))
    return li.select(
        k.cast("string").alias("image_id"), k.alias("n"), kinds.alias("chart_type"), series.alias("x"), series.alias("y"), F.when(k % 41 == 0, "missing_series_delimiters").alias("failure_mode"),
        F.transform("l", point).alias("x_points"), F.transform("l", point).alias("y_points"), F.transform("l", box).alias("boxes"),
    )


def c_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The full stage join: detections are missing for some orders, ticks for others."""
    o = _order_shapes(spark, sf)
    ticks, found = o.where("n % 43 <> 0").select("image_id", "x_points", "y_points"), o.where("n % 47 <> 0").select("image_id", "boxes")
    out = pipeline.outcomes(o, o.select("image_id", "chart_type", "x", "y", "failure_mode"), ticks, found)
    total = F.aggregate("y_series", F.lit(0.0), lambda a, v: a + v["d"])
    return out.select("image_id", "chart_type", F.size("y_series").cast("bigint").alias("values"), F.round(total, 4).alias("total"), F.coalesce("failure_mode", F.lit("ok")).alias("failure"))


def c_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks of every order, read at three places: inside, before and behind."""
    o = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 40.0).alias("px"), F.col("l_quantity").cast("double").alias("val")))).alias("t"))
    cal = calibration.calibrated(F.transform("t", lambda v: v["px"]), F.transform("t", lambda v: v["val"]))
    o = o.select("l_orderkey", cal.alias("c"))
    return o.select("l_orderkey", F.size("c").cast("bigint").alias("ticks"), *(F.round(calibration.value_at(F.col("c"), F.lit(p)), 6).alias(n) for n, p in (("before", 10.0), ("inside", 90.0), ("behind", 400.0))))


def c_markers(spark: SparkSession, sf: str) -> DataFrame:
    o = _order_shapes(spark, sf)
    return o.select("image_id", F.size(geometry.markers(F.col("boxes"))).cast("bigint").alias("markers"), F.size(geometry.deduplicated(geometry.markers(F.col("boxes")))).cast("bigint").alias("kept"))


def c_oom_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return evaluate.oom_summary(e.select(F.col("user_id").cast("string").alias("image_id"), (F.col("event_type") == "error").alias("recovered")))


def c_edit_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Categorical series per brand: types against types with their first word cut."""
    p = _t(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))).alias("l"))
    truth, pred = F.transform("l", lambda v: v["p_type"]), F.transform("l", lambda v: F.when(v["p_partkey"] % 3 == 0, F.substring(v["p_type"], 3, 100)).otherwise(v["p_type"]))
    return p.select("p_brand", F.round(metric.edit_score(truth, pred), 6).alias("score"))


def c_duplicate_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Instances that the scored table holds more than once, and how far their scores differ."""
    return _t(spark, sf, "scored").groupBy("instance_id", "run_id").agg(F.count("*").alias("n"), F.round(F.max("score") - F.min("score"), 6).alias("spread")).where("n > 1")


def c_image_join(spark: SparkSession, sf: str) -> DataFrame:
    """Images that only references or only annotations name."""
    refs = _t(spark, sf, "image_refs").select(image_key(F.coalesce("image_id", "path")).alias("image_id")).where("image_id is not null")
    ann = _t(spark, sf, "annotations").select(image_key(F.col("image_id")).alias("image_id")).where("image_id is not null")
    return pipeline.id_differences(ann, refs)


def c_run_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Runs per writer and day, with the run before."""
    r = _t(spark, sf, "run_lines").where("written_at is not null").groupBy("stream_id", F.to_date("written_at").alias("day")).agg(F.count_distinct("written_at").alias("runs"), F.max("written_at").alias("_last"))
    w = W.partitionBy("stream_id").orderBy("day")
    return r.select("stream_id", "day", "runs", runlog.run_id(F.col("_last")).alias("last_run"), F.lag("runs").over(w).alias("runs_before"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for n, f in globals().items() if n.startswith("c_")}

_LET = "regexp_replace(lower({0}), '[^\\pL]+', '', 'g')"
_TRUTH = f"""truth as (select * from (select annotation_id::varchar as image_id, annotation_id as n,
  case {_LET.format('source')} when 'generated' then 'generated' when 'extracted' then 'extracted' end as source,
  case {_LET.format('chart_type')} when 'line' then 'line' when 'scatter' then 'scatter' when 'dot' then 'dot' when 'verticalbar' then 'vertical_bar' when 'horizontalbar' then 'horizontal_bar' end as chart_type,
  x as x_series, y as y_series from annotations) where source is not null and chart_type is not null and x_series is not null and y_series is not null)"""

_RAW = f"""{_TRUTH},
seq as (select *, '<|BOS|><' || chart_type || '><x_start>' || array_to_string(list_transform(x_series, lambda v: coalesce(v.s, '')), ';') || '<x_end><y_start>' || array_to_string(list_transform(y_series, lambda v: coalesce(v.s, '')), ';') || '<y_end></s>' as seq from truth),
raw as (select *, case when n % 11 = 0 then replace(seq, '<y_end>', '') when n % 13 = 0 then replace(seq, '<' || chart_type || '>', '') when n % 17 = 0 then replace(seq, '1', '<one>') else seq end as raw from seq),
pieces as (select image_id, raw, case when contains(raw, '<dot>') then 'dot' when contains(raw, '<horizontal_bar>') then 'horizontal_bar' when contains(raw, '<vertical_bar>') then 'vertical_bar' when contains(raw, '<scatter>') then 'scatter' when contains(raw, '<line>') then 'line' end as kind,
  contains(raw, '<x_start>') and contains(raw, '<x_end>') and contains(raw, '<y_start>') and contains(raw, '<y_end>') as whole,
  split_part(split_part(replace(raw, '<one>', '1'), '<x_start>', 2), '<x_end>', 1) as xs, split_part(split_part(replace(raw, '<one>', '1'), '<y_start>', 2), '<y_end>', 1) as ys from raw),
parsed as (select *, case when kind is null then 'no_chart_type_token' when not whole then 'missing_series_delimiters' when trim(replace(xs, ';', ''), e' \\t\\n') = '' or trim(replace(ys, ';', ''), e' \\t\\n') = '' then 'empty_series' else 'ok' end as failure from pieces)"""


def _moved(c: str) -> str:
    return f"case when n % 5 = 0 then {c}[1:len({c}) - 1] when n % 5 = 1 then list_transform({c}, lambda v: case when v is null then struct_pack(kind := null::varchar, s := null::varchar, d := null::double) else struct_pack(kind := v.kind, s := v.s || 'x', d := v.d * 1.1) end) else {c} end"


_OUT = f"""{_TRUTH},
outc as (select image_id, n, case when n % 19 = 0 then 'dot' else chart_type end as chart_type, {_moved('x_series')} as x_series, {_moved('y_series')} as y_series,
  case when n % 23 = 0 then 'empty_series' when n % 29 = 0 then 'unusable_axis_calibration' when n % 31 = 0 then 'no_markers_decoded' when n % 37 = 0 then 'no_decoder_for_' || chart_type end as failure_mode from truth)"""

_CATS = f"""{_OUT},
cats as (select t.chart_type as truth_type, case when starts_with(failure_mode, 'no_decoder_for_') then 'unsupported_chart_type' when failure_mode = 'empty_series' then 'malformed_sequence'
  when o.chart_type <> t.chart_type then 'wrong_chart_type' when failure_mode = 'unusable_axis_calibration' then 'axis_misestimation' when failure_mode = 'no_markers_decoded' then 'marker_miss' else 'ok' end as category
  from outc o join truth t using (image_id)),
names as (select unnest(['ok','malformed_sequence','wrong_chart_type','axis_misestimation','marker_miss','unsupported_chart_type','decode_error']) as category)"""

_NUM = "case when v.kind in ('int','float') then case when isfinite(v.d) then v.d end when v.kind = 'str' then try_cast(replace(trim(v.s), ',', '') as double) end"
_SCORES = f"""{_OUT},
ins as (select image_id || '_x' as instance_id, 'x' as axis, t.source, t.chart_type, o.chart_type as predicted_chart_type, t.x_series as ts, o.x_series as ps from truth t join outc o using (image_id)
  union all select image_id || '_y', 'y', t.source, t.chart_type, o.chart_type, t.y_series, o.y_series from truth t join outc o using (image_id)),
el as (select instance_id, i, case when v.kind in ('int','float') then case when isfinite(v.d) then v.d end when v.kind = 'str' then try_cast(replace(trim(v.s), ',', '') as double) end as t,
  case when w.kind in ('int','float') then case when isfinite(w.d) then w.d end when w.kind = 'str' then try_cast(replace(trim(w.s), ',', '') as double) end as p, coalesce(v.s, 'None') as a, coalesce(w.s, 'None') as b
  from (select instance_id, i, ts[i] as v, ps[i] as w from ins, range(1, len(ts) + 1) r(i) where len(ts) = len(ps))),
ag as (select instance_id, count(*) filter (t is null or p is null) as holes, sum((t - p) * (t - p)) as se, sum((t - m) * (t - m)) as sb, sum(levenshtein(a, b)) as ed, sum(length(a)) as al
  from (select *, avg(t) over (partition by instance_id) as m from el) group by 1),
sc as (select ins.*, case when predicted_chart_type <> chart_type or len(ts) <> len(ps) then 0.0 when len(ts) = 0 then 1.0
  when ts[1].kind = 'str' then case when al = 0 then case when ed = 0 then 1.0 else 0.0 end else 2 - 2 / (1 + exp(-ed / al)) end
  when holes > 0 then 0.0 when sb = 0 then case when se = 0 then 1.0 else 0.0 end else 2 - 2 / (1 + exp(-sqrt(se / sb))) end as score from ins left join ag using (instance_id))"""

_TEXT = """lambda v: coalesce(case v.kind when 'bool' then case when v.s = 'True' then '1' else '0' end when 'int' then v.s when 'null' then 'None'
  when 'float' then case when not isfinite(v.d) then '0' when v.d = floor(v.d) and abs(v.d) < 1e15 then v.d::decimal(20,0)::varchar else format('{:.6g}', v.d) end else replace(trim(v.s, (' ' || chr(9) || chr(10) || chr(13) || chr(160))), ';', ',') end, 'None')"""
_SEQUENCES = f"""{_TRUTH},
tx as (select *, list_transform(x_series, {_TEXT}) as xt, list_transform(y_series, {_TEXT}) as yt from truth),
tr as (select image_id, source, case when len(xt) = len(yt) then '<|BOS|><' || chart_type || '><x_start>' || array_to_string(xt, ';') || '<x_end><y_start>' || array_to_string(yt, ';') || '<y_end></s>' end as sequence,
  len(xt) = len(yt) and len(list_filter(xt, lambda q: trim(q) <> '')) > 0 and len(list_filter(yt, lambda q: trim(q) <> '')) > 0 as round_trip from tx)"""

_ALLOC = """pop as (select * from ({rows})), st as (select {keys}, count(*) as size from pop group by all), al as (select *, sum(size) over () as al from st),
a2 as (select *, least({n}, al) as n1, (size * least({n}, al)) // al as base, (size * least({n}, al)) % al as rest from al),
a3 as (select *, (base + case when row_number() over (order by rest desc, {keys}) <= n1 - sum(base) over () then 1 else 0 end) as take from a2)"""

ORACLE: dict[str, str] = {
    "c_parse_tokens": f"""with {_RAW} select image_id, coalesce(kind, 'vertical_bar') as chart_type, failure, case when failure = 'ok' then xs else '' end as x, case when failure = 'ok' then ys else '' end as y,
        case when failure = 'ok' then len(string_split(ys, ';')) else 0 end as n from parsed""",
    "c_repair": """with t as (select o_orderkey, o_orderkey % 7 as m, o_totalprice::decimal(18,2)::varchar as price from orders)
        select o_orderkey, case when m in (4, 5) then 'int' else 'float' end as kind,
        round(case m when 2 then -price::double when 3 then replace(price, '.', '')::double / 0 when 4 then split_part(price, '.', 1)::double when 5 then 0.0 else price::double end, 4) as d from t where m <> 3
        union all select o_orderkey, 'float', round((price || '5')::double, 4) from t where m = 3""",
    "c_instance_scores": f"with {_SCORES} select instance_id, axis, source, chart_type, predicted_chart_type, round(score, 6) as score from sc",
    "c_breakdown": """select case when grouping(source, chart_type, axis) = 7 then 'overall' when grouping(source, chart_type, axis) = 5 then 'chart_type' when grouping(source, chart_type, axis) = 3 then 'source' when grouping(source, chart_type, axis) = 6 then 'axis' else 'source_and_chart_type' end as level,
        source, chart_type, axis, round(avg(score), 6) as score, count(*) as n_instances, round(avg((chart_type = predicted_chart_type)::int), 6) as chart_type_accuracy from scored group by grouping sets ((chart_type), (source), (axis), (source, chart_type), ())""",
    "c_confidence": """with i as (select image_id, avg(score) as m from scored group by 1), c as (select coalesce(stddev_samp(m) / sqrt(count(m)), 0) as se, count(*) as n from i),
        o as (select coalesce(avg(score), 0) as o, count(*) as k, avg((chart_type = predicted_chart_type)::int) as acc from scored)
        select k as n_instances, n as n_images, round(o, 6) as overall, round(se, 6) as stderr, round(o - 1.96 * se, 6) as ci_low, round(o + 1.96 * se, 6) as ci_high, round(acc, 6) as chart_type_accuracy from c, o""",
    "c_sanity": """with o as (select coalesce(avg(score), 0) as o, count(*) as n from scored), w as (select unnest([case when o < 0.05 then 'error:score_near_zero' end, case when o < 0.22 then 'error:far_below_reference' when o < 0.44 then 'warning:below_reference' else 'info:above_reference' end, case when n between 1 and 49 then 'warning:small_sample' end]) as w, o, n from o)
        select split_part(w, ':', 1) as level, split_part(w, ':', 2) as code, round(o, 6) as overall, n as n_instances from w where w is not null""",
    "c_scored_composition": "select count(source) as total, count(*) filter (source = 'generated') as generated, count(*) filter (source = 'extracted') as extracted, round(count(*) filter (source = 'generated') / count(source), 6) as generated_fraction, count(*) filter (source = 'generated') > 0 as distribution_applies from scored",
    "c_taxonomy": f"with {_CATS} select category, count(truth_type) as n from names left join cats using (category) group by 1",
    "c_taxonomy_by_type": f"with {_CATS}, ty as (select distinct truth_type from cats) select ty.truth_type, names.category, count(cats.category) as n from ty cross join names left join cats on cats.truth_type = ty.truth_type and cats.category = names.category group by all",
    "c_failures": f"with {_OUT} select chart_type, coalesce(failure_mode, 'ok') as failure_mode, count(*) as count from outc group by all",
    "c_populations": f"""with {_OUT} select 'by_ground_truth' as kind, chart_type, count(*) as n from truth group by all
        union all select 'ground_truth', 'horizontal_bar', count(*) filter (chart_type = 'horizontal_bar') from truth union all select 'predicted', 'horizontal_bar', count(*) filter (chart_type = 'horizontal_bar') from outc""",
    "c_submission": f"""with {_OUT}, s as (select t.image_id, coalesce(o.chart_type, 'line') as chart_type, o.x_series as xs, o.y_series as ys from truth t left join (select * from outc where failure_mode is null) o using (image_id)),
        r as (select image_id || '_x' as id, chart_type, xs as v from s union all select image_id || '_y', chart_type, ys from s)
        select id, chart_type, case when v is null or len(v) = 0 or len(list_filter(v, lambda e: trim(coalesce(e.s, 'None')) <> '')) = 0 then '0;0' else array_to_string(list_transform(v, lambda e: case when e.kind = 'float' and not isfinite(e.d) then '0.0' else coalesce(e.s, 'None') end), ';') end as data_series from r""",
    "c_training_sequences": f"with {_SEQUENCES} select image_id, sequence, round_trip from tr",
    "c_recipe": f"""with {_SEQUENCES}, r as (select count(*) filter (ok and source = 'extracted') as u, count(*) filter (ok and source = 'generated') as g, count(*) filter (not parses) as p, count(*) filter (parses and not fits) as l
          from (select *, parses and fits as ok from (select source, coalesce(round_trip, false) as parses, coalesce(length(sequence), 0) <= 512 as fits from tr)))
        select u as n_extracted_unique, g as n_generated_rows, p as n_dropped_unserialisable, l as n_dropped_too_long, 4 as oversample, 4 * u as n_extracted_rows, 4 * u + g as n_rows, round(case when 4 * u + g > 0 then 4 * u / (4 * u + g) else 0 end, 4) as extracted_share from r""",
    "c_dataset_summary": f"with {_TRUTH} select source, chart_type, count(*) as count from truth group by all",
    "c_composition": f"""with {_TRUTH} select case when grouping(source, chart_type) = 3 then 'all' when grouping(source, chart_type) = 1 then 'source' else 'source/chart_type' end as level, source, chart_type, count(*) as n from truth group by grouping sets ((), (source), (source, chart_type))""",
    "c_bucket_split": f"with {_TRUTH}, b as (select *, ('0x' || substr(md5('validation:' || image_id), 1, 8))::bigint / 4294967295.0::double as b from truth) select image_id, source, round(b, 9) as bucket from b where source = 'extracted' or b < 0.05",
    "c_complement": f"with {_TRUTH} select image_id from truth where source <> 'extracted' and ('0x' || substr(md5('validation:' || image_id), 1, 8))::bigint / 4294967295.0::double >= 0.05",
    "c_stratified_sample": f"""with {_TRUTH}, {_ALLOC.format(rows='select * from truth', keys='source, chart_type', n=1000)}
        select image_id, source, chart_type from (select pop.image_id, source, chart_type, take, row_number() over (partition by source, chart_type order by md5('42:' || image_id), image_id) as r from pop join a3 using (source, chart_type)) where r <= take""",
    "c_three_way": f"""with {_TRUTH}, p as (select image_id, chart_type, count(*) over (partition by chart_type) as n, row_number() over (partition by chart_type order by md5('42:' || image_id), image_id) as r from truth where source = 'extracted'),
        f as (select *, case when n >= 2 then greatest(1, least(round_even(n * 0.6, 0)::bigint, n - 1)) else round_even(n * 0.6, 0)::bigint end as fit from p), v as (select *, case when fit >= 2 then greatest(1, least(round_even(fit * 0.1, 0)::bigint, fit - 1)) else round_even(fit * 0.1, 0)::bigint end as val from f)
        select image_id, chart_type, case when r <= val then 'val' when r <= fit then 'train' else 'holdout' end as part from v""",
    "c_oversampled": f"with {_TRUTH} select source, chart_type, count(*) * case when source = 'extracted' then 4 else 1 end as n, count(*) as images from truth group by source, chart_type",
    "c_calibration": """with t as (select l_orderkey, l_linenumber * 40.0::double as px, avg(0) as z, l_linenumber, min(l_quantity)::double as val from lineitem group by all),
        k as (select l_orderkey, list(px order by px) as p, list(val order by px) as v, count(*) as n from (select l_orderkey, px, first(val order by val) as val from t group by all) group by 1),
        q as (select *, unnest([10.0, 90.0, 400.0]) as probe, unnest(['before', 'inside', 'behind']) as nm from k),
        h as (select *, greatest(2, least(len(list_filter(p, lambda x: x < probe)) + 1, n)) as hi from q),
        r as (select l_orderkey, n, nm, case when n >= 2 then v[hi - 1] + (probe - p[hi - 1]) * (v[hi] - v[hi - 1]) / (p[hi] - p[hi - 1]) else v[1] end as y from h)
        select l_orderkey, any_value(n) as ticks, round(max(y) filter (nm = 'before'), 6) as before, round(max(y) filter (nm = 'inside'), 6) as inside, round(max(y) filter (nm = 'behind'), 6) as behind from r group by 1""",
    "c_markers": """with recursive l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_partkey) as nth, (l_partkey % 200)::double as x, l_quantity::double * 2 as y from lineitem where l_partkey % 10 >= 5),
        b as (select l_orderkey, row_number() over (partition by l_orderkey order by nth) as rn, {'x': x, 'y': y} as box from l),
        w as (select l_orderkey, 1::bigint as i, [box] as kept from b where rn = 1
          union all select w.l_orderkey, i + 1, case when len(list_filter(kept, lambda k: least(k.x, box.x) + 10 - greatest(k.x, box.x) + 1 > 0 and least(k.y, box.y) + 10 - greatest(k.y, box.y) + 1 > 0)) > 0 then kept else list_append(kept, box) end
          from w join b on b.l_orderkey = w.l_orderkey and b.rn = i + 1),
        f as (select l_orderkey, max(i) as markers, max(len(kept)) as kept from w group by 1)
        select o.l_orderkey::varchar as image_id, coalesce(markers, 0)::bigint as markers, coalesce(kept, 0)::bigint as kept from (select distinct l_orderkey from lineitem) o left join f on o.l_orderkey = f.l_orderkey""",
    "c_oom_summary": "select count(*) as n_events, count(*) filter (event_type = 'error') as n_recovered, count(*) filter (event_type <> 'error') as n_unrecovered, count(distinct user_id) filter (event_type = 'error') as degraded_images, count(distinct user_id) filter (event_type <> 'error') as failed_images from events",
    "c_edit_scores": """with s as (select p_brand, sum(levenshtein(p_type, case when p_partkey % 3 = 0 then substr(p_type, 3) else p_type end)) as e, sum(length(p_type)) as n from part group by 1)
        select p_brand, round(case when n = 0 then case when e = 0 then 1.0 else 0.0 end else 2 - 2 / (1 + exp(-e / n)) end, 6) as score from s""",
    "c_duplicate_instances": "select instance_id, run_id, count(*) as n, round(max(score) - min(score), 6) as spread from scored group by all having count(*) > 1",
    "c_run_windows": """with r as (select stream_id, (written_at at time zone 'UTC')::date as day, count(distinct written_at) as runs, max(written_at) as l from run_lines where written_at is not null group by all)
        select stream_id, day, runs, strftime(l at time zone 'UTC', '%Y%m%dT%H%M%SZ') as last_run, lag(runs) over (partition by stream_id order by day) as runs_before from r""",
    "c_image_join": """with r as (select distinct nullif(regexp_extract(lower(coalesce(image_id, path)), '^[\\s\\x{00a0}]*(?:[^\\r\\n]*[/\\\\])?([0-9a-f]{12})(?:_[xy])?(?:\\.[^/\\\\\\s]*)?[\\s\\x{00a0}]*$', 1), '') as i from image_refs),
        a as (select distinct nullif(regexp_extract(lower(image_id), '^[\\s\\x{00a0}]*(?:[^\\r\\n]*[/\\\\])?([0-9a-f]{12})(?:_[xy])?(?:\\.[^/\\\\\\s]*)?[\\s\\x{00a0}]*$', 1), '') as i from annotations)
        select i as image_id, 'missing' as side from r where i is not null and i not in (select i from a where i is not null) union all select i, 'extra' from a where i is not null and i not in (select i from r where i is not null)""",
}
