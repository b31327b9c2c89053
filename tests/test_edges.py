"""Nulls in any column, empty tables, ties, repeated rows, very long texts and extra columns with clashing names."""

import pytest
from helpers import C, rows, series

from pyspark.sql import functions as F

from seriesmill.functions.values import SERIES
from seriesmill.operators import drift, evaluate, pipeline, shred, splits

TRUTH = f"image_id string, source string, chart_type string, x_series {SERIES}, y_series {SERIES}"
OUT = f"image_id string, chart_type string, x_series {SERIES}, y_series {SERIES}, failure_mode string"


def test_null_outcomes_and_truth(spark):
    truth = spark.createDataFrame([("a", None, None, None, None), ("b", "generated", "line", series(1, None), [None]), (None, "generated", "line", [], [])], TRUTH)
    out = spark.createDataFrame([("a", None, None, None, None), ("b", "line", [None], [None], None)], OUT)
    s = evaluate.scored_instances(truth, out)
    assert s.count() == 6 and evaluate.breakdown(s).count() > 0 and evaluate.confidence(s).count() == 1
    assert evaluate.taxonomy(evaluate.categorised(out, truth)).count() == 7
    assert {r.data_series for r in pipeline.submission(truth, out.where("image_id = 'a'")).collect()} == {"0;0"}


@pytest.mark.parametrize("raw", [None, "", "<line><x_start>" + "1;" * 200_000 + "<x_end><y_start>2<y_end>"], ids=["null", "empty", "long"])
def test_any_sequence(spark, raw):
    p = pipeline.predictions(spark.createDataFrame([("a", raw)], "image_id string, raw string"), clean=False).first()
    assert (p.failure_mode is None) == bool(raw) and len(p.x) == (200_001 if raw else 0)


def test_empty_tables(spark):
    t, o = spark.createDataFrame([], TRUTH), spark.createDataFrame([], OUT)
    s = evaluate.scored_instances(t, o)
    assert s.count() == 0 and evaluate.breakdown(s).where("level <> 'overall'").count() == 0
    assert evaluate.taxonomy(evaluate.categorised(o, t)).agg(F.sum("n")).first()[0] == 0
    assert evaluate.scored_composition(s).first().label == "empty"
    assert splits.three_way(t).count() == 0 and splits.composition(t).where("level <> 'all'").count() == 0 and splits.validation_split(t).count() == 0


def test_extra_columns_do_not_clash(spark):
    lines = [("s", 1, 1, '{"run_id":"r","a":1}', "x", "y"), ("s", 2, 2, '{"run_id":"r","b":1}', "x", "y")] * 2
    d = spark.createDataFrame(lines, "stream_id string, file_no int, line_id bigint, body string, path string, fields string")
    assert rows(drift.schema_changes(d), "change_kind", "old_field", "new_field") == [("renamed", "a", "b")]
    r = spark.createDataFrame([(1, '{"counts":{"ok":1}}', "clash", "clash")], "result_id bigint, taxonomy string, node_id string, path string")
    assert rows(shred.taxonomy_counts(r), "parent_key", "item_key") == [("counts", "ok")]
    p = spark.createDataFrame([(f"i{i}", "generated", "line", "x", 1) for i in range(20)], "image_id string, source string, chart_type string, size string, n int")
    assert splits.stratified_sample(p, 5).count() == 5 and splits.three_way(p).count() == 20


def test_ties_and_repeats(spark):
    p = spark.createDataFrame([("same", "generated", "line")] * 10, "image_id string, source string, chart_type string")
    assert splits.stratified_sample(p, 4).count() == 4
    s = spark.createDataFrame([("a", "x", "generated", "line", "line", 0.5)] * 3, "image_id string, axis string, source string, chart_type string, predicted_chart_type string, score double")
    assert evaluate.confidence(s).first().stderr == 0.0 and evaluate.breakdown(s).where(C("level") == "overall").first().n_instances == 3
