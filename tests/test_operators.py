import os
import random

import pytest
from helpers import C, rows, series

from pyspark.sql import functions as F

from seriesmill.functions.geometry import BOX
from seriesmill.functions.values import SERIES
from seriesmill.operators import evaluate, pipeline, splits, stages
from seriesmill.sources import annotations, runlog
from seriesmill.streaming import scoring

PRED = f"image_id string, chart_type string, x {SERIES}, y {SERIES}, failure_mode string"
POINTS = "image_id string, x_points array<struct<px:double,py:double>>, y_points array<struct<px:double,py:double>>"
TICKS = ([(15.0, 210.0), (45.0, 210.0)], [(40.0, 100.0), (40.0, 120.0), (40.0, 140.0)])
FOUND = [(10.0, 95.0, 20.0, 105.0, 3, 0.9), (40.0, 95.0, 50.0, 105.0, 3, 0.9)]


def stage_tables(spark):
    xy = (series("a", "b"), series("10", "20", "30"))
    preds = [("ok", "vertical_bar", *xy, None), ("bad", "line", [], [], "missing_series_delimiters"), ("nodet", "scatter", *xy, None), ("notick", "line", *xy, None), ("pie", "pie", *xy, None), ("hbar", "horizontal_bar", *xy, None), ("none", "", *xy, None)]
    ids = [p[0] for p in preds]
    random.Random(1).shuffle(preds)
    return (
        spark.createDataFrame([(i,) for i in ids], "image_id string"),
        spark.createDataFrame(preds, PRED),
        spark.createDataFrame([(i, *TICKS) for i in ids if i != "notick"], POINTS),
        spark.createDataFrame([(i, FOUND) for i in ids if i != "nodet"], f"image_id string, boxes array<{BOX}>"),
    )


def test_failure_ladder(spark):
    out = {r.image_id: r for r in pipeline.outcomes(*stage_tables(spark)).collect()}
    assert {k: v.failure_mode for k, v in out.items()} == {"ok": None, "bad": "missing_series_delimiters", "nodet": "missing_marker_detections", "notick": "unusable_axis_calibration", "pie": "no_decoder_for_pie", "hbar": "no_markers_decoded", "none": None}
    assert [v.d for v in out["ok"].y_series] == [10.0, 10.0] and [v.s for v in out["nodet"].x_series] == ["a", "b"]
    assert out["bad"].x_series == [] and out["none"].chart_type == "line" and len(out["none"].y_series) == 2
    donut = {r.image_id: r for r in pipeline.outcomes(*stage_tables(spark)[:2], mode="donut_only").collect()}
    assert donut["pie"].failure_mode is None and [v.s for v in donut["pie"].y_series] == ["10", "20", "30"] and donut["bad"].failure_mode == "missing_series_delimiters"
    with pytest.raises(ValueError):
        pipeline.outcomes(*stage_tables(spark), mode="half")


def test_ids_and_submission(spark):
    refs, preds, ticks, found = stage_tables(spark)
    pipeline.require_all_ids("donut", preds, refs)
    with pytest.raises(ValueError, match="missing"):
        pipeline.require_all_ids("donut", preds.where("image_id <> 'ok'"), refs)
    sub = {r.id: r for r in pipeline.submission(refs, pipeline.outcomes(refs, preds, ticks, found)).collect()}
    assert len(sub) == 14 and sub["bad_y"].data_series == "0;0" and sub["ok_x"].data_series == "a;b" and sub["ok_y"].data_series == "10.0;10.0"
    lost = pipeline.submission(refs, pipeline.outcomes(refs, preds, ticks, found).where("image_id <> 'ok'")).where("image_id = 'ok'").collect()
    assert {(r.data_series, r.chart_type) for r in lost} == {("0;0", "line")}


TRUTH = f"image_id string, source string, chart_type string, x_series {SERIES}, y_series {SERIES}"
OUT = f"image_id string, chart_type string, x_series {SERIES}, y_series {SERIES}, failure_mode string"


def run_tables(spark):
    t = [("a", "generated", "line", series("p", "q"), series(1, 2)), ("b", "extracted", "line", series("p"), series(3)), ("c", "extracted", "horizontal_bar", series("p"), series(4))]
    o = [("a", "line", series("p", "q"), series(1, 2), None), ("b", "dot", series("p"), series(3), None), ("c", "horizontal_bar", series("p"), [], "no_markers_decoded")]
    return spark.createDataFrame(t, TRUTH), spark.createDataFrame(o, OUT)


def test_scores_breakdown_confidence(spark):
    truth, out = run_tables(spark)
    s = evaluate.scored_instances(truth, out)
    assert rows(s, "instance_id", "score") == [("a_x", 1.0), ("a_y", 1.0), ("b_x", 0.0), ("b_y", 0.0), ("c_x", 1.0), ("c_y", 0.0)]
    b = {(r.level, r.source, r.chart_type, r.axis): (r.score, r.n_instances) for r in evaluate.breakdown(s).collect()}
    assert b[("overall", None, None, None)] == (0.5, 6) and b[("axis", None, None, "x")][1] == 3 and b[("source", "extracted", None, None)] == (0.25, 4)
    assert sum(n for k, (_, n) in b.items() if k[0] == "source_and_chart_type") == 6
    c = evaluate.confidence(s).first()
    assert (c.n_images, c.overall) == (3, 0.5) and c.stderr == pytest.approx(0.5 / 3**0.5) and c.ci_high - c.overall == pytest.approx(1.96 * c.stderr)
    one = evaluate.confidence(s.where("image_id = 'a'")).first()
    none = evaluate.confidence(s.where("false")).first()
    assert one.stderr == 0.0 and (none.overall, none.n_instances, none.n_images) == (0.0, 0, 0)
    missing = evaluate.scored_instances(truth, out.where("image_id <> 'a'")).where("image_id = 'a'").collect()
    assert {(r.score, r.predicted_chart_type) for r in missing} == {(0.0, "")}


def test_competition_score_needs_equal_ids(spark):
    truth, out = run_tables(spark)
    sol, sub = evaluate.truth_instances(truth), evaluate.truth_instances(out)
    assert evaluate.competition_score(sol, sub).first().score == pytest.approx(0.5)
    with pytest.raises(Exception, match="different ids"):
        evaluate.competition_score(sol, sub.where("id <> 'a_x'")).collect()


def test_taxonomy_and_populations(spark):
    truth, out = run_tables(spark)
    cats = evaluate.categorised(out, truth)
    assert rows(cats, "image_id", "category") == [("a", "ok"), ("b", "wrong_chart_type"), ("c", "marker_miss")]
    assert dict(rows(evaluate.taxonomy(cats.where("category <> 'marker_miss'"), "donut_only"), "category", "n")) == {"ok": 1, "malformed_sequence": 0, "wrong_chart_type": 1, "decode_error": 0}
    assert evaluate.taxonomy_by_type(cats).count() == 14
    assert evaluate.not_applicable("donut_only") == ["axis_misestimation", "marker_miss", "unsupported_chart_type"]
    p = dict(((k, c), n) for k, c, n in rows(evaluate.populations(truth, out), "kind", "chart_type", "n"))
    assert p[("ground_truth", "horizontal_bar")] == 1 and p[("by_ground_truth", "line")] == 2
    cases = [("empty_series", "dot", "line", "malformed_sequence"), ("decode_error", "dot", "line", "wrong_chart_type"), ("decode_error", "line", None, "decode_error"), ("oom", "line", "line", "oom"), ("no_decoder_for_pie", "pie", "line", "unsupported_chart_type"), (None, "line", None, "ok")]
    d = spark.createDataFrame(cases, "f string, p string, t string, want string")
    assert d.where(~(evaluate.category(C("f"), C("p"), C("t")) == C("want"))).count() == 0


def test_sanity(spark):
    def codes(score, n=1000, mode="donut_only", **kw):
        d = spark.createDataFrame([(score, n)], "overall double, n_instances bigint")
        return [(r.level, r.code) for r in evaluate.sanity(d, mode, **kw).collect()]

    assert codes(0.001) == [("error", "score_near_zero"), ("error", "far_below_reference")]
    assert codes(0.10) == [("error", "far_below_reference")] and codes(0.40) == [("warning", "below_reference")] and codes(0.75) == [("info", "above_reference")]
    assert ("warning", "small_sample") in codes(0.75, 10) and codes(0.75, mode="full") == []
    assert codes(0.75, mode="full", reference=0.44, reference_mode="donut_only") == [("info", "reference_mode_mismatch")]


def population(spark):
    kinds = ("line", "scatter", "dot", "vertical_bar", "horizontal_bar")
    return spark.createDataFrame([(f"i{i:04d}", "extracted" if i % 5 == 0 else "generated", kinds[i % 5]) for i in range(1000)], "image_id string, source string, chart_type string")


def test_splits_and_samples(spark):
    p = population(spark)
    val = splits.validation_split(p, 0.1)
    assert val.where("source = 'extracted'").count() == 200 and splits.complement(p, val).count() == 1000 - val.count()
    s = splits.stratified_sample(p, 100)
    got = rows(s, "image_id")
    assert len(got) == 100 and got == rows(splits.stratified_sample(p.repartition(7), 100), "image_id") != rows(splits.stratified_sample(p, 100, 43), "image_id")
    assert s.where("source = 'extracted'").count() == 20 and splits.stratified_sample(p, 5000).count() == 1000
    rare = spark.createDataFrame([(f"g{i}", "generated", "line") for i in range(100)] + [(f"d{i}", "extracted", "dot") for i in range(3)], p.schema)
    assert splits.stratified_sample(rare, 40).where("chart_type = 'dot'").count() == 1
    t = splits.three_way(p)
    assert {r.part: r.n for r in t.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"train": 540, "val": 60, "holdout": 400} and splits.overlapping(t).count() == 0
    two = splits.three_way(p.where("image_id in ('i0000','i0005')"))
    assert sorted(r.part for r in two.collect()) == ["holdout", "train"]
    assert splits.oversampled(p.limit(3), p.limit(2), 4).count() == 14 and splits.stratified_sample(p.where("false"), 10).count() == 0


def test_annotations_from_disk(spark, tmp_path):
    good = '{"source":"generated","chart-type":"vertical_bar","data-series":[{"x":"Mon","y":1.0},{"x":"Tue","y":2}]}'
    (tmp_path / "a.json").write_text(good)
    r = annotations.read_annotations(spark, str(tmp_path)).first()
    assert (r.image_id, r.chart_type, [v.s for v in r.x_series], [(v.kind, v.s) for v in r.y_series]) == ("a", "vertical_bar", ["Mon", "Tue"], [("float", "1.0"), ("int", "2")])
    ids = spark.createDataFrame([("a",), ("b",)], "image_id string")
    with pytest.raises(FileNotFoundError):
        annotations.read_annotations(spark, str(tmp_path), ids)
    assert annotations.read_annotations(spark, str(tmp_path), ids, strict=False).count() == 1
    bad = [good.replace('"source":"generated",', ""), good.replace("generated", "synthetic"), good.replace("vertical_bar", "pie"), good.replace('"x":"Tue",', ""), "{", good.replace('"data-series"', '"series"')]
    d = spark.createDataFrame([(b,) for b in bad], "t string").select(annotations.parsed_annotation(C("t")).alias("a"))
    assert [r.a.error for r in d.collect()] == ["missing_source", "bad_source", "bad_chart_type", "bad_point", "not_json", "missing_data-series"]
    for name in ("z.json", "y.jpg", "x.jpg"):
        (tmp_path / name).write_text(good)
    assert rows(annotations.discover_images(spark, str(tmp_path)), "image_id") == [("x",), ("y",)]
    for text in ('["p","q"]', '{"ids":["p","q"]}', '{"holdout_ids":["p","q"],"ids":["z"]}', "p\n\n q \n"):
        (tmp_path / "ids.txt").write_text(text)
        assert rows(annotations.read_id_list(spark, str(tmp_path / "ids.txt")), "image_id") == [("p",), ("q",)]


def test_run_log_appends(spark, tmp_path):
    assert runlog.read_runs(spark, str(tmp_path)).count() == 0
    for i in (2, 1):
        runlog.append_run(spark.createDataFrame([(f"run{i}", 0.5)], "run_id string, overall double"), str(tmp_path))
    assert [r.run_id for r in runlog.read_runs(spark, str(tmp_path)).select("run_id").collect()] == ["run1", "run2"]
    parts = spark.createDataFrame([("a", "train"), ("b", "val")], "image_id string, part string")
    runlog.write_split(parts, str(tmp_path / "s"))
    assert runlog.read_split(spark, str(tmp_path / "s")).count() == 2
    runlog.write_split(parts.unionByName(spark.createDataFrame([("a", "val")], parts.schema)), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        runlog.read_split(spark, str(tmp_path / "t"))
    runlog.write_scores(parts, str(tmp_path), "r1")
    assert os.path.isdir(tmp_path / "per_instance" / "r1")


def test_small_report_functions(spark):
    d = spark.createDataFrame([(1280, 960, 0.75), (40, 40, 0.01)], "w int, h int, s double")
    assert [tuple(r) for r in d.select(runlog.scaled_side(C("w"), C("s")), runlog.scaled_side(C("h"), C("s"))).collect()] == [(960, 704), (32, 32)]
    t = spark.createDataFrame([(None,), (59.0,), (187.0,), (7500.0,)], "s double")
    assert [r[0] for r in t.select(runlog.duration(C("s"))).collect()] == ["?", "59s", "3m07s", "2h05m"]
    e = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "image_id string, recovered boolean")
    assert tuple(evaluate.oom_summary(e).first()) == (3, 2, 1, 1, 1)
    row = evaluate.latency(spark.createDataFrame([(4, 2.0, 1.0, 1.0, 0.0)], "n_images int, donut_s double, axis_s double, markers_s double, decode_s double")).first()
    assert (row.donut_ms, row.total_ms) == (500.0, 1000.0)
    assert spark.range(1).select(runlog.projected(F.lit(2.0), F.lit(100), F.lit(3)).alias("p")).first().p.total_hms == "2m30s"


def test_generation_ladder(spark):
    def factory():
        from seriesmill.operators.stages import DoesNotFit

        def generate(ids, contents, scale):
            if len(ids) > 2:
                raise DoesNotFit
            for i in ids:
                if (i == "big" and scale > 0.75) or i == "huge":
                    raise DoesNotFit
                if i == "broken":
                    raise RuntimeError
            return [f"<line>{i}" for i in ids]

        return generate

    imgs = spark.createDataFrame([(i, bytearray(b"x")) for i in ("a", "big", "huge", "broken")], "image_id string, content binary").coalesce(1)
    got = {r.image_id: (r.raw, r.failure_mode, r.scale, r.recovered) for r in stages.run_generation(imgs, factory).collect()}
    assert got == {"a": ("<line>a", None, 1.0, None), "big": ("<line>big", None, 0.75, True), "huge": ("", "oom", None, False), "broken": ("", "generation_error", 1.0, None)}
    have = stages.availability({"donut_dir": "d", "x_axis_model": "x", "y_axis_model": None, "marker_model": "m"}, lambda p: p != "m")
    assert have.mode == "donut_only" and have.run == ("donut",) and stages.resolve_mode("auto", have) == "donut_only"
    for bad in ("full", "other"):
        with pytest.raises(ValueError):
            stages.resolve_mode(bad, have)


def test_stream_equals_batch(spark, tmp_path):
    truth, _ = run_tables(spark)
    raw = [("a", "<line><x_start>p;q<x_end><y_start>1;2<y_end>", "2024-01-01 00:00:00"), ("b", "<dot><x_start>p<x_end><y_start>3<y_end>", "2024-01-01 01:30:00"), ("c", "<horizontal_bar><x_start>p<x_end><y_start>9<y_end>", "2024-01-01 01:40:00")]
    src = spark.createDataFrame(raw, "image_id string, raw string, at string").withColumn("at", F.to_timestamp("at"))
    src.write.parquet(str(tmp_path / "in"))
    live = scoring.scored_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), truth)
    q = live.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = rows(scoring.batch_equivalent(src, truth), "image_id", "axis", "score")
    assert rows(spark.table("live"), "image_id", "axis", "score") == want and len(want) == 6
    assert rows(scoring.windowed_scores(spark.table("live")), "n_instances") == [(2,), (2,), (2,)]
