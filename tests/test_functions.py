import math

import pytest
from helpers import C, column, pairs, series

from seriesmill.functions import calibration as cal
from seriesmill.functions import decoding, geometry, labels, metric, repair, sqlfuncs, tokens, values
from seriesmill.functions.values import SERIES

sig = lambda x: 2 - 2 / (1 + math.exp(-x))


def test_float_text_is_the_shortest_python_form(spark):
    xs = [1.0, 0.1, 1e7, 12345678.5, 123456789012345.0, 1e15, 1e16, 1.5e16, 1e22, 1e-4, 1.5e-4, 1e-5, 2e-5, 0.001, 0.00012345, -1e7, -2.5e-7, 1e100, 0.0, -0.0, 3.14, math.inf, -math.inf]
    assert column(spark, values.float_text(C("x")), "x double", [(x,) for x in xs]) == [str(x) for x in xs]


def test_repair_table(spark):
    table = {"11": 11, "1E": 1, "3.14": 3.14, "-5": -5, "1e5": 100000.0, "1 0 0": 100, "--3": -3, "1.2.3": 1.23, "": 0, "abc": 0, "12abc": 12, "2010-2015": 0, "Q1 2020": 12020, "1_000": 1000, "007": 7, "-0": 0, ".": 0, "1e2e3": 12000.0, "99999999999999999999": 99999999999999999999}
    got = column(spark, repair.repaired(C("t")), "t string", [(k,) for k in table])
    for (k, want), g in zip(table.items(), got):
        assert (g.d, g.kind) == (float(want), "float" if isinstance(want, float) else "int"), k
        assert g.s == str(want), k


def test_clean_keeps_categories(spark):
    got = column(spark, repair.cleaned(C("x")), "x array<string>", [(["Mon", " Tue", "Wed"],), (["1", "2 ", "3"],), ([],), (["", ""],)])
    assert [[v.kind for v in g] for g in got] == [["str"] * 3, ["int"] * 3, [], ["str", "str"]]
    assert got[0][1].s == "Tue" and got[1][1].d == 2.0


@pytest.mark.parametrize(
    "raw,kind,failure,x,y",
    [
        ("<|BOS|><scatter><x_start>1;2;3<x_end><y_start>4;5;6<y_end>", "scatter", None, ["1", "2", "3"], ["4", "5", "6"]),
        ("no tokens at all", "vertical_bar", "no_chart_type_token", [], []),
        ("<line> partial <x_start>1<x_end>", "line", "missing_series_delimiters", [], []),
        ("<line><x_start><x_end><y_start><y_end>", "line", "empty_series", [], []),
        ("<line><x_start><one>;2<x_end><y_start><one>;3<y_end>", "line", None, ["1", "2"], ["1", "3"]),
        ("<line><dot><x_start>a<x_end><y_start>1<y_end>", "dot", None, ["a"], ["1"]),
        (None, "vertical_bar", "no_chart_type_token", [], []),
    ],
)
def test_parsing(spark, raw, kind, failure, x, y):
    p = column(spark, tokens.parsed_prediction(C("r")), "r string", [(raw,)])[0]
    assert (p.chart_type, p.failure_mode, [v.s for v in p.x], [v.s for v in p.y]) == (kind, failure, x, y)


def test_training_text(spark):
    vs = series(1.0, 2.5, 7, True, 1e5, "a;b", 123456.789, 0.0001234567, 1e-7, 1e15, -2.25) + [("float", "nan", math.nan), ("float", "inf", math.inf)]
    got = column(spark, tokens.training_text(C("v")), f"v {values.VAL}", [(v,) for v in vs])
    assert got == ["1", "2.5", "7", "1", "100000", "a,b", "123457", "0.000123457", "1e-07", "1e+15", "-2.25", "0", "0"]


def test_round_trip(spark):
    good, odd = series(1, 2), series(1)
    expr = tokens.survives_round_trip(C("k"), C("x"), C("y"))
    assert column(spark, expr, f"k string, x {SERIES}, y {SERIES}", [("line", good, good), ("pie", good, good), ("line", good, odd), ("dot", [], [])]) == [True, False, False, False]


def test_metric_table(spark):
    cases = [
        (series(1, 2, 3, 4), series(2.5, 2.5, 2.5, 2.5), sig(1)),
        (series(5, 5, 5), series(5, 5, 5), 1.0),
        (series(5, 5, 5), series(5, 5, 6), 0.0),
        (series(1, 2), series("abc", "1"), 0.0),
        (series(1, 2), series("1.0", "2.0"), 1.0),
        (series(1000, 2), series("1,000", " 2 "), 1.0),
        (series(1, 2), series(math.nan, 2.0), 0.0),
        (series(1, 2), series(math.inf, 2.0), 0.0),
        (series(1, 2), series(True, 2), 0.0),
        (series("abcd"), series("abxy"), sig(0.5)),
        (series("1.0"), series(1.0), 1.0),
        (series(1, 2), series(1), 0.0),
        ([], [], 1.0),
        (series(None, 2), series(None, 2), 0.0),
        (series(""), series("a"), 0.0),
        (series(1), None, 0.0),
    ]
    got = pairs(spark, metric.series_score(C("t"), C("p")), [c[:2] for c in cases])
    assert got == pytest.approx([c[2] for c in cases], abs=1e-12)


def test_calibration(spark):
    t = [(50.0, 30.0), (100.0, 20.0), (150.0, 10.0), (200.0, 0.0)]
    got = column(spark, cal.calibrated(C("p"), C("v")), "p array<double>, v array<double>", [([200.0, 150.0, 100.0, 50.0], [0.0, 10.0, 20.0, 30.0]), ([10.0, 10.0, 20.0], [1.0, 2.0, 3.0]), ([1.0, 2.0, 3.0], [10.0, 20.0]), ([], [])])
    assert [[tuple(x) for x in g] for g in got] == [t, [(10.0, 1.0), (20.0, 3.0)], [(1.0, 10.0), (2.0, 20.0)], []]
    at = column(spark, cal.value_at(C("t"), C("x")), f"t {cal.TICKS}, x double", [(t, 0.0), (t, 250.0), (t, 75.0), ([], 3.0), ([(100.0, 5.0)], 7.0)])
    assert at == [40.0, -10.0, 25.0, 0.0, 5.0]


def test_ladder_and_labels(spark):
    y = series("10", "20", "30")
    got = column(spark, cal.series_ladder(C("p"), C("y")), f"p array<double>, y {SERIES}", [([140.0, 100.0, 120.0], y), ([1.0, 2.0], series("a"))])
    assert len(got[0]) == 26 and [t.val for t in got[0][:3]] == [10.0, 20.0, 30.0] and got[0][25].px == 600.0
    assert {t.val for t in got[1]} == {0.0}
    texts = series("-5", "3.14", "1e5", "12", "1,200", "  7 ", -2, "abc", "", "   ", None, "Monday", True, "inf", "nan", "1d")
    assert column(spark, cal.tick_label(C("v")), f"v {values.VAL}", [(v,) for v in texts]) == [-5.0, 3.14, 1e5, 12.0, 1200.0, 7.0, -2.0, None, None, None, None, None, 1.0, math.inf, None, None]
    with pytest.raises(ValueError):
        cal.register_label_source("donut_series", cal.series_ladder)
    with pytest.raises(ValueError):
        cal.label_source("nothing")


CAL = [(50.0, 30.0), (100.0, 20.0), (150.0, 10.0), (200.0, 0.0)]
BOXES = [(10.0, 95.0, 20.0, 105.0, 3, 0.9), (40.0, 145.0, 50.0, 155.0, 3, 0.9), (70.0, 45.0, 80.0, 55.0, 3, 0.9)]
NEAR = [(10.0, 95.0, 20.0, 105.0, 3, 0.9), (11.0, 96.0, 21.0, 106.0, 3, 0.9)]
STACK = [(10.0, 10.0, 20.0, 20.0, 3, 0.9), (10.0, 40.0, 20.0, 50.0, 3, 0.9), (10.0, 70.0, 20.0, 80.0, 3, 0.9), (60.0, 10.0, 70.0, 20.0, 3, 0.9)]


@pytest.mark.parametrize(
    "kind,boxes,ticks,want",
    [
        ("line", BOXES, [15.0, 45.0, 75.0], [20.0, 10.0, 30.0]),
        ("line", BOXES[:2], [15.0, 45.0, 100.0, 200.0], [20.0, 10.0, 10.0, 10.0]),
        ("line", BOXES[:2], None, [20.0, 10.0]),
        ("vertical_bar", NEAR, [], [20.0]),
        ("scatter", NEAR, [], [20.0, 19.8]),
        ("scatter", [BOXES[0], (*BOXES[1][:5], 0.2)], [], [20.0]),
        ("scatter", [(*BOXES[0][:5], 0.5), (*BOXES[1][:4], 2, 0.9)], [], [20.0]),
        ("dot", STACK, [15.0, 65.0], [30.0, 10.0]),
        ("dot", STACK, [], []),
        ("horizontal_bar", BOXES, [15.0], []),
        *[(k, [], [15.0], []) for k in ("line", "vertical_bar", "scatter", "horizontal_bar")],
        ("pie", BOXES, [15.0], None),
    ],
)
def test_decoders(spark, kind, boxes, ticks, want):
    got = column(spark, decoding.decoded(C("k"), C("b"), C("t"), C("c")), f"k string, b array<{geometry.BOX}>, t array<double>, c {cal.TICKS}", [(kind, boxes, ticks, CAL)])[0]
    assert (got if want is None else pytest.approx([v.d for v in got])) == want


def test_geometry_by_brute_force(spark):
    import random

    def iou(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1), max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
        u = (a[2] - a[0] + 1) * (a[3] - a[1] + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - w * h
        return w * h / u if u > 0 else 0.0

    r, sets, want = random.Random(3), [], []
    for _ in range(30):
        bs = []
        for _ in range(r.randint(0, 12)):
            x, y = r.randint(0, 60), r.randint(0, 60)
            bs.append((float(x), float(y), float(x + r.randint(0, 15)), float(y + r.randint(0, 15)), 3, 0.9))
        kept = []
        for b in bs:
            if not any(iou(k, b) > 0.1 for k in kept):
                kept.append(b)
        sets.append((bs,))
        want.append(kept)
    got = column(spark, geometry.deduplicated(C("b"), 0.1), f"b array<{geometry.BOX}>", sets)
    assert [[tuple(x) for x in g] for g in got] == want


def test_valid_ticks(spark):
    got = column(spark, geometry.valid_ticks(C("p"), C("l")), "p array<double>, l array<array<double>>", [([1.0, 2.0, 3.0], [[0.0, 5.0], [5.0, 0.0], [1.0, 1.0]])])
    assert got == [[1.0]]


def test_image_keys_and_labels(spark):
    ids = {" fc840f203a04\n": "fc840f203a04", "D:\\c\\EC0D19009237.jpg": "ec0d19009237", "a/b/0123456789ab.tar.gz": "0123456789ab", "0123456789AB_X ": "0123456789ab", "982b24dc1f8": None, "": None, None: None, "0123456789abc": None, "0123456789ab_z": None, "\xa00123456789ab\xa0": "0123456789ab"}
    assert column(spark, labels.image_key(C("t")), "t string", [(k,) for k in ids]) == list(ids.values())
    kinds = {"vertical\xa0bar": "vertical_bar", "verticalBar": "vertical_bar", " LINE ": "line", "bar": None, None: None, "": None}
    assert column(spark, labels.label(C("t"), labels.CHART_TYPES), "t string", [(k,) for k in kinds]) == list(kinds.values())


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    r = spark.sql("select sm_sigmoid(0D) a, sm_iou(0,0,9,9,0,0,9,9) b, sm_chart_type('<line><dot>') c, sm_image_id('x/0123456789AB.jpg') d, sm_bucket('s','i') e").first()
    assert (r.a, r.b, r.c, r.d) == (1.0, 1.0, "dot", "0123456789ab") and 0 <= r.e <= 1
