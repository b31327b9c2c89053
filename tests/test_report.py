import pytest
from helpers import C, column, rows

from pyspark.sql import functions as F

from seriesmill.functions import decoding
from seriesmill.operators import evaluate, report, splits, stages
from seriesmill.sources import paths, runlog


def test_caveats():
    codes = lambda **k: [c for c, _ in report.caveats(**k)]
    mixed = {"total": 4, "distribution_applies": True, "extracted_fraction": 0.25, "generated_fraction": 0.75}
    assert codes() == ["leakage"] and codes(composition={"total": 0}) == ["leakage"]
    assert codes(composition=mixed, mode="donut_only", oom={"n_recovered": 2, "n_unrecovered": 1}) == ["leakage", "mixed", "donut_only", "degraded", "unprocessed"]
    assert codes(composition=mixed | {"extracted_fraction": 0}) == ["leakage", "generated_only"] and codes(composition=mixed | {"distribution_applies": False}) == ["leakage", "extracted_only"]
    assert codes(holdout={"held_out_from_finetune": True}) == ["partly_held_out"] and codes(holdout={"held_out_from_finetune": True, "held_out_from_base_checkpoint": True}) == ["held_out"]
    s = {"n_selected": 40, "n_population": 298, "seed": 1}
    assert "0.0196" in dict(report.caveats(sampling=s, stderr=0.01))["sampled"] and codes(sampling=s | {"n_selected": 298}) == ["leakage"]


def test_report_names_what_matters():
    t = report.report("r1", {"overall": 0.5}, [{"chart_type": "line", "score": 0.25, "n_instances": 3}], [("ok", 3), ("oom", 1), ("bad", 0)], ["marker_miss"], {"axis": "no model"}, {"total_ms": 2.0}, [{"level": "error", "code": "score_near_zero"}], [("leakage", "x")], [{"image_id": f"i{n}", "recovered": n > 0, "scale": 0.5} for n in range(12)])
    for part in ("run r1", "axis: no model", "0.5000", "0.2500 (n=3)", "3 (75.0%)", "marker_miss", "score_near_zero", "no scale fits", "2 more"):
        assert part in t
    assert "bad" not in t


def test_table_is_only_appended_to(spark, tmp_path):
    for run in ("r2", "r1"):
        report.append_table(spark.createDataFrame([(run, 0.5)], "run string, overall double"), str(tmp_path))
    lines = report.read_table(spark, str(tmp_path)).split("\n")
    assert lines[0].startswith("| run | model |") and [x.split(" | ")[0] for x in lines[2:]] == ["| r1", "| r2"] and "| 0.5 |" in lines[2] and lines[2].count("?") == len(runlog.TABLE_COLUMNS) - 2


def test_paths():
    got = paths.resolve(["a", "b", "c", "d"], {"a": "/arg", "b": ""}, {"SERIESMILL_B": "/env"}, {"a": "/conf", "c": "/conf"}, {"c": "/pre"}, lambda p: p != "/conf")
    assert [(f.path, f.origin, f.exists) for f in got.values()] == [("/arg", "argument", True), ("/env", "environment", True), ("/conf", "config", False), (None, "none", False)]
    assert "/conf (config, missing)" in paths.path_report(got)


def test_subset_and_leaks(spark):
    d = spark.createDataFrame([("a", "generated"), ("b", "extracted"), ("b", "extracted")], "image_id string, source string")
    assert splits.subset(d, "both").count() == 3 and rows(splits.subset(d, "generated"), "image_id") == [("a",)]
    with pytest.raises(ValueError):
        splits.subset(d, "scanned")
    splits.refuse_leaks(d, d.where("false"))
    with pytest.raises(ValueError, match="b"):
        splits.refuse_leaks(d, d.where("image_id = 'b'"))


def test_ladder_goes_on_after_other_errors(spark):
    def factory():
        from seriesmill.operators.stages import DoesNotFit

        def generate(ids, contents, scale):
            if any(i.startswith("broken") for i in ids):
                raise RuntimeError("no memory error")
            if scale == 1.0 and any(i.startswith("big") for i in ids):
                raise DoesNotFit
            if scale == 0.75:
                raise ValueError("no such size")
            if "big2" in ids:
                raise DoesNotFit
            return ["x"] * len(ids)

        return generate

    run = lambda *ids: {r.image_id: (r.failure_mode, r.scale, r.recovered) for r in stages.run_generation(spark.createDataFrame([(i, bytearray(b"")) for i in ids], "image_id string, content binary").coalesce(1), factory).collect()}
    assert run("big1", "big2", "ok") == {"big1": (None, 0.5, True), "big2": ("oom", None, False), "ok": (None, 1.0, None)}
    assert run("ok", "broken") == {"ok": ("generation_error", 1.0, None), "broken": ("generation_error", 1.0, None)}


def test_oom_events(spark):
    g = spark.createDataFrame([("a", 0.75, True), ("b", None, False), ("c", 1.0, None)], "image_id string, scale double, recovered boolean")
    assert rows(evaluate.oom_events(g, 560, 100), "image_id", "height", "width") == [("a", 416, 64), ("b", None, None)]
    assert rows(evaluate.oom_images(g.unionByName(g).where("recovered is not null")), "image_id", "recovered") == [("a", True), ("b", False)]


def test_generation_settings(spark):
    assert runlog.generation_options(512, 2, temperature=0.5) == {"max_length": 512, "num_beams": 2, "do_sample": False, "early_stopping": True}
    assert runlog.generation_options(512, do_sample=True, top_k=5, top_p=None)["top_k"] == 5
    with pytest.raises(ValueError):
        runlog.generation_options(512, beams=3)
    label = runlog.generation_label(C("b"), C("s"), F.lit(5), F.lit(0.9), F.lit(1.0))
    assert column(spark, label, "b int, s boolean", [(1, False), (4, False), (1, True)]) == ["greedy", "beam_search(num_beams=4)", "sampling(top_k=5, top_p=0.9, temperature=1.0)"]


def test_a_decoder_may_ask_for_another_score(spark):
    box = [(0.0, 0.0, 2.0, 2.0, 3, 0.3), (4.0, 4.0, 6.0, 6.0, 3, 0.9)]
    cal = "array(named_struct('px', 0d, 'val', 0d), named_struct('px', 10d, 'val', 10d))"
    low = {"scatter": decoding.Decoder(decoding.DECODERS["scatter"].decode, min_score=0.2)}
    n = lambda d: F.size(decoding.decoded(F.lit("scatter"), C("b"), F.array().cast("array<double>"), F.expr(cal), d))
    schema = "b array<struct<x1:double,y1:double,x2:double,y2:double,label:int,score:double>>"
    assert column(spark, n(decoding.DECODERS), schema, [(box,)]) == [1] and column(spark, n(low), schema, [(box,)]) == [2]
