import json
import os
from collections import defaultdict

import pytest
from helpers import C, rows

from seriesmill.functions.variants import parsed
from seriesmill.operators import drift, shred

LINES = "stream_id string, file_no int, line_id bigint, body string"


def kind(v):
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, list):
        return "array<" + "|".join(sorted({kind(e).split("<")[0] for e in v if e is not None})) + ">"
    return {str: "string", dict: "object"}.get(type(v))


def flat(body):
    try:
        v = json.loads(body)
    except (TypeError, ValueError):
        return None
    if not isinstance(v, dict):
        return None
    f = {}
    for k, x in v.items():
        f |= {f"{k}.{kk}": xx for kk, xx in x.items()} if isinstance(x, dict) else {k: x}
    return {k: x for k, x in f.items() if x is not None and x != [] and x != {}}


def brute_changes(lines):
    files, runs = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(list))
    for s, f, _, body in lines:
        files[s, f]
        for k, x in (flat(body) or {}).items():
            files[s, f][k].add(kind(x))
        if flat(body) and "run_id" in flat(body):
            runs[s, f][flat(body)["run_id"]].append(flat(body))
    out = set()
    for (s, f), b in list(files.items()):
        if (s, f - 1) not in files:
            continue
        a = files[s, f - 1]
        gone, come, named = set(a) - set(b), set(b) - set(a), set()
        for o in gone:
            for n in come:
                vs = [(x[o], y[n]) for r in runs[s, f - 1] for x in runs[s, f - 1][r] for y in runs[s, f].get(r, []) if o in x and n in y]
                if vs and all(kind(x) == kind(y) and x == y for x, y in vs):
                    named.add((o, n))
        out |= {(s, f, "renamed", o, n) for o, n in named} | {(s, f, "removed", o, "") for o in gone - {o for o, _ in named}}
        out |= {(s, f, "added", "", n) for n in come - {n for _, n in named}} | {(s, f, "retyped", k, k) for k in set(a) & set(b) if a[k] != b[k]}
    return sorted(out)


CASES = [
    ("s", 1, 1, '{"run_id":"r1","mode":"full","n":1,"gone":true,"e":{},"l":[1]}'),
    ("s", 1, 2, '{"run_id":"r2","mode":"half","n":2,"m":null}'),
    ("s", 2, 3, '{"run_id":"r2","config":{"mode":"half","deep":{"a":1}},"n":"2","l":["a",null]}'),
    ("s", 2, 4, '{"run_id":"r3","config":{"mode":"x"},"n":"2"}'),
    ("s", 2, 5, '{"run_id":"r3","config":{"mode":"x"},"n":"2"}'),
    ("s", 3, 6, None),
    ("s", 3, 7, "  "),
    ("s", 3, 8, '{"run_id":"r3","conf'),
    ("s", 3, 9, '["x"]'),
    ("s", 3, 10, "null"),
    ("s", 5, 11, '{"run_id":"r9","z":1}'),
    ("t", 1, 12, '{"run_id":"q","a":1.0,"N":1}'),
    ("t", 2, 13, '{"run_id":"q","b":1,"n":1}'),
    (None, 2, 14, '{"a":1}'),
    ("t", None, 15, '{"a":1}'),
]


def test_changes_by_brute_force(spark):
    got = rows(drift.schema_changes(spark.createDataFrame(CASES, LINES)), "stream_id", "file_no", "change_kind", "old_field", "new_field")
    assert got == brute_changes([c for c in CASES if c[0] and c[1]])
    kinds = {g[2] for g in got}
    assert kinds == {"renamed", "removed", "added", "retyped"} and ("t", 2, "renamed", "a", "b") in got
    assert drift.schema_changes(spark.createDataFrame([], LINES)).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="driver tables")
def test_changes_of_the_driver_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/run_lines.parquet").select("stream_id", "file_no", "line_id", "body")
    got = rows(drift.schema_changes(t), "stream_id", "file_no", "change_kind", "old_field", "new_field")
    assert got == brute_changes([tuple(r) for r in t.collect()])


def test_consistent_table(spark):
    body = [
        ("s", 1, 1, '{"run_id":"r1","config":{"mode":"full"},"latency":{"total_ms":"1,012.5 ms"},"caveats":["a","b"]}'),
        ("s", 1, 0, '{"run_id":"r0","latency":{"total_ms":4}}'),
        ("s", 2, 0, '{"run_id":"r0","latency":{"millis":4}}'),
        ("s", 2, 2, '{"run_id":"r1","config":{"mode":"full"},"caveats":"a | b"}'),
        ("s", 2, 3, '{"run_id":"r2","config":{"mode":{"name":"half"}},"latency":{"millis":{"value":7,"unit":"ms"}},"caveats":[{"code":1,"text":"c"}]}'),
        ("s", 2, 4, '{"run_id":"r3","config":{"mode":20},"latency":{"millis":"soon"}}'),
        ("s", 2, 5, '{"config":{"mode":"nobody"}}'),
        ("s", 2, 6, '{"run_id":"r4","latency":{"millis":"2.5 s"}}'),
        ("s", 2, 7, '{"run_id":"r5","latency":{"millis":{"seconds":3}}}'),
        ("s", 2, 8, '{"run_id":"r6","latency":{"millis":"3 parsecs"}}'),
        ("u", 1, 9, '{"run_id":"r7","latency":{"millis":5}}'),
    ]
    t = drift.RUN_COLUMNS[:3]
    r = {x.run_id: x for x in drift.consistent_runs(spark.createDataFrame(body, LINES), t).collect()}
    assert (r["r1"].file_no, r["r1"].mode, r["r1"].caveats, r["r1"].total_ms) == (2, "full", ["a", "b"], 1012.5)
    assert (r["r2"].mode, r["r2"].caveats, r["r2"].total_ms, r["r2"].renamed_from) == ("half", ["c"], 7.0, ["total_ms: latency.millis"])
    assert (r["r3"].mode, r["r3"].total_ms, r["r3"].failed_casts) == ("20", None, ['total_ms: "soon"']) and len(r) == 9
    assert (r["r4"].total_ms, r["r5"].total_ms, r["r7"].total_ms, r[None].line_id) == (2500.0, 3000.0, 5.0, 5)
    assert (r["r6"].total_ms, r["r6"].failed_casts) == (None, ['total_ms: "3 parsecs"'])


def test_consistent_table_keeps_every_field(spark):
    body = [
        ("s", 1, 1, '{"run_id":"r1","config":{"mode":"full"},"latency":{"donut_ms":3.5},"new":[1,"x"],"ok":true}'),
        ("s", 2, 2, '{"run_id":"r1","config":{"mode":"full"},"z":{"deep":{"a":1}}}'),
        ("s", 2, 3, '{"config":{"mode":"nobody"},"z":{"deep":"t"}}'),
        ("s", 2, 5, '{"config":'),
    ]
    d = spark.createDataFrame(body, LINES)
    got = sorted(drift.consistent_runs(d, drift.RUN_COLUMNS[:1]).collect(), key=lambda r: r.run_id or "")
    assert [(r.run_id, r.line_id, r.mode, r.latency_donut_ms, r.new, r.ok, r.z_deep, r.other_fields) for r in got] == [
        (None, 3, "nobody", None, None, None, "t", {}),
        ("r1", None, "full", 3.5, ["1", "x"], True, '{"a":1}', {}),
    ]
    few = {r.run_id: r.other_fields for r in drift.consistent_runs(d, drift.RUN_COLUMNS[:1], max_columns=1).collect()}
    assert sorted(few["r1"]) == ["latency.donut_ms", "new", "ok", "z.deep"] or "config.mode" in few["r1"]


def test_consistent_table_chooses_by_column(spark):
    body = [
        ("s", 1, 9, '{"run_id":"r1","config":{"mode":"old"},"caveats":["a"]}'),
        ("s", 1, 8, '{"run_id":"r0","latency":{"total_ms":4}}'),
        ("s", 2, 2, '{"run_id":"r1","config":{"mode":"full"}}'),
        ("s", 2, 3, '{"run_id":"r0","latency":{"millis":4}}'),
        ("s", 2, 4, '{"run_id":"r1","latency":{"millis":7}}'),
        ("s", 2, 7, '{"run_id":"r1","latency":{"millis":"soon"}}'),
        ("s", 3, 1, '{"run_id":"r1","config":{"mode":null},"latency":{"millis":"later"}}'),
    ]
    d = spark.createDataFrame(body, LINES)
    r = [x for x in drift.consistent_runs(d.unionByName(d).repartition(3), drift.RUN_COLUMNS[:3]).collect() if x.run_id == "r1"]
    assert [(x.file_no, x.mode, x.caveats, x.total_ms, x.renamed_from, x.failed_casts) for x in r] == [
        (3, "full", ["a"], 7.0, ["total_ms: latency.millis"], ['total_ms: "later"', 'total_ms: "soon"'])
    ]


def test_a_name_reused_in_another_stream(spark):
    changes = [("s", 2, "renamed", "a", "x"), ("s", 4, "renamed", "x", "y"), ("s", 6, "renamed", "y", "a"), ("u", 2, "renamed", "b", "x"), ("u", 2, "removed", "q", "")]
    got = drift.root_names(spark.createDataFrame(changes, "stream_id string, file_no int, change_kind string, old_field string, new_field string"))
    assert rows(got, "stream_id", "file_no", "path", "root") == [("s", 2, "x", "a"), ("s", 4, "y", "a"), ("s", 6, "a", "a"), ("u", 2, "x", "b")]
    pairs = {("x", "a"), ("y", "a"), ("x", "b")}
    assert drift._family(pairs, {"a"}) == {"a": "a", "b": "a", "x": "a", "y": "a"} and drift._family(pairs, {"a", "b"}) == {"a": "a", "b": "b", "x": "x", "y": "a"}


def test_parser_refuses_what_is_cut_off_or_trails(spark):
    d = spark.createDataFrame([(t,) for t in ('{"a":1} x', '{"a":1', "", None, ' {"a":1} ', "[1", "7", '\r\n{"a":1}\t\n')], "t string")
    assert [r.v for r in d.select(parsed(C("t")).isNotNull().alias("v")).collect()] == [False, False, False, False, True, False, True, True]


RESULTS = "result_id bigint, scores string, models array<struct<name:string,parameters:bigint,size_mb:double,trainable_parameters:bigint,parts:array<struct<part_name:string,n_tensors:int,dtype:string>>>>, taxonomy string"


def test_shredding(spark):
    scores = {
        "overall": 0.5,
        "by_axis": {"x": {"score": 0.1, "n_instances": 2}, "y": None},
        "by_chart_type": [{"chart_type": "line", "score": None, "n_instances": 3, "ci": {"low": 1}}, None],
        "by_source": {},
        "by_source_and_chart_type": [{"source": "generated", "by_chart_type": [{"chart_type": "dot", "score": 0.3}, None]}, {"source": "extracted", "by_chart_type": None}],
    }
    other = {"by_source": [{"source": "extracted", "score": 1e-3}], "by_source_and_chart_type": {"extracted": {"line": {"score": 0.2}, "dot": None}, "generated": {}}}
    tax = {"counts": {"ok": 0, "bad": None, "odd": "3"}, "by_ground_truth_chart_type": {"line": {"ok": 2.0}, "dot": None}, "mode": "full"}
    part = ("enc", 3, None)
    data = [(1, json.dumps(scores), [("m", 1, 1.0, 1, [part, None, part]), None, ("k", None, None, None, None)], json.dumps(tax)), (2, json.dumps(other), None, None), (3, None, [], "{"), (4, "[]", [None], "{}")]
    df = spark.createDataFrame(data, RESULTS)
    assert rows(shred.child_rows(df), "result_id", "child", "parent_key", "item_key") == sorted(
        [(1, "score", "by_axis", "x"), (1, "score", "by_chart_type", "line"), (1, "score", "by_source_and_chart_type/generated", "dot"), (2, "score", "by_source", "extracted"), (2, "score", "by_source_and_chart_type/extracted", "line")]
        + [(1, "model", "", "0"), (1, "model", "", "2"), (1, "model_part", "0", "0"), (1, "model_part", "0", "2")]
        + [(1, "taxonomy", "counts", "ok"), (1, "taxonomy", "by_ground_truth_chart_type/line", "ok")]
    )
    assert shred.child_rows(df.where("false")).count() == 0


def test_adjacency_holds_every_value(spark):
    doc = {"a": {"b": [1, {"c": None, "d": "x"}], "e": {}}, "f": [], "g": True}
    n = {r.node_id: r for r in shred.adjacency(spark.createDataFrame([(1, json.dumps(doc))], "id int, t string"), "id", "t").collect()}
    assert len(n) == 9 and all(r.parent_id in n or r.parent_id == "" for r in n.values())
    assert {tuple(r.path): (r.kind, r.scalar) for r in n.values()} == {
        ("a",): ("object", None), ("a", "b"): ("array", None), ("a", "b", "0"): ("number", "1"), ("a", "b", "1"): ("object", None), ("a", "b", "1", "c"): ("null", None),
        ("a", "b", "1", "d"): ("string", "x"), ("a", "e"): ("object", None), ("f",): ("array", None), ("g",): ("boolean", "true"),
    }
    with pytest.raises(Exception, match="nested deeper than 2"):
        shred.adjacency(spark.createDataFrame([(1, json.dumps(doc))], "id int, t string"), "id", "t", 2).collect()


def test_shredding_keeps_records_of_one_id_apart(spark):
    one = ('{"by_axis":{"x":{"score":1}}}', [("m", 1, 1.0, 1, None)], '{"counts":{"ok":1}}')
    df = spark.createDataFrame([(i, *one) for i in (7, 7, None)], RESULTS)
    got = rows(shred.child_rows(df).where("child <> 'taxonomy'").fillna(0), "result_id", "child", "item_key")
    assert got == sorted([(i, c, k) for i in (7, 7, 0) for c, k in (("score", "x"), ("model", "0"))])
    m = shred.model_rows(df).where("result_id is null").first()
    assert (m.name, m.parameters, m.size_mb) == ("m", 1, 1.0)
