"""Queries over run logs and evaluation records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.operators import drift, shred


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/run_lines.parquet")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/evaluation_results.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(_lines(spark, sf))


def p2_types(spark: SparkSession, sf: str) -> DataFrame:
    """Path and type statistics by file."""
    s = drift.type_statistics(drift.field_rows(_lines(spark, sf)))
    return s.select("stream_id", "file_no", "path", F.array_join("kinds", ",").alias("kinds"), "records")


def p2_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One consistent table of runs, any field under any of its names; lists as texts, bodies without a run under their
    line_id, what no column holds as one JSON object."""
    r = drift.consistent_runs(_lines(spark, sf))
    return r.withColumns({c: F.array_join(c, " | ") for c, t in r.dtypes if t == "array<string>"} | {"other_fields": F.to_json("other_fields")})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return shred.child_rows(_results(spark, sf))


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    return shred.score_cells(_results(spark, sf))


def p4_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return shred.taxonomy_counts(_results(spark, sf))


def p4_parts(spark: SparkSession, sf: str) -> DataFrame:
    return shred.model_parts(_results(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_types, p2_runs, p4_found, p4_scores, p4_taxonomy, p4_parts)}

_CELLS = """
s as (select result_id, try_cast(scores as json) as j from evaluation_results where json_valid(scores)),
top as (select result_id, k.key as grp, k.value as g, json_type(k.value) as t from s, json_each(s.j) k where k.key in ('by_axis','by_chart_type','by_source','by_source_and_chart_type')),
flat as (select result_id, grp as parent_key, case when top.t = 'OBJECT' then e.key else json_extract_string(e.value, '$.' || replace(grp, 'by_', '')) end as item_key, e.value as v
    from top, json_each(top.g) e where grp <> 'by_source_and_chart_type' and top.t in ('OBJECT','ARRAY')),
src as (select result_id, case when top.t = 'OBJECT' then e.key else json_extract_string(e.value, '$.source') end as source, case when top.t = 'OBJECT' then e.value else json_extract(e.value, '$.by_chart_type') end as g
    from top, json_each(top.g) e where grp = 'by_source_and_chart_type' and top.t in ('OBJECT','ARRAY')),
deep as (select result_id, 'by_source_and_chart_type/' || source as parent_key, case when json_type(src.g) = 'OBJECT' then e.key else json_extract_string(e.value, '$.chart_type') end as item_key, e.value as v
    from src, json_each(src.g) e where json_type(src.g) in ('OBJECT','ARRAY')),
cells as (select result_id, parent_key, item_key, v from (select * from flat union all select * from deep) where json_type(v) = 'OBJECT' and v::varchar <> '{}')"""

_COUNTS = """
x as (select result_id, try_cast(taxonomy as json) as j from evaluation_results where json_valid(taxonomy)),
c as (select result_id, 'counts' as parent_key, e.key as item_key, e.value as v from x, json_each(json_extract(x.j, '$.counts')) e
  union all select result_id, 'by_ground_truth_chart_type/' || b.key, e.key, e.value from x, json_each(json_extract(x.j, '$.by_ground_truth_chart_type')) b, json_each(b.value) e where json_type(b.value) = 'OBJECT'),
counts as (select result_id, parent_key, item_key, v::varchar::double as n from c where json_type(v) in ('BIGINT','UBIGINT','DOUBLE'))"""

_MODELS = """
m as (select result_id, i - 1 as i, models[i] as m from evaluation_results, range(1, coalesce(len(models), 0) + 1) r(i) where models[i] is not null),
pt as (select result_id, i, j - 1 as j, m.parts[j] as p from m, range(1, coalesce(len(m.parts), 0) + 1) r(j) where m.parts[j] is not null)"""

_KIND = "case json_type({0}) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'number' end"
_FIELDS = f"""
l as (select stream_id, file_no, line_id, try_cast(body as json) as j from run_lines where stream_id is not null and file_no is not null),
top as (select l.stream_id, l.file_no, l.line_id, e.key as k, e.value as v from l, json_each(l.j) e where json_type(l.j) = 'OBJECT'),
f0 as (select stream_id, file_no, line_id, k as path, v from top where json_type(v) <> 'OBJECT'
  union all select t.stream_id, t.file_no, t.line_id, t.k || '.' || e.key, e.value from top t, json_each(t.v) e where json_type(t.v) = 'OBJECT'),
f as (select * from (select *, case {_KIND.format('v')} when 'object' then case when v::varchar <> '{{}}' then 'object' end
  when 'array' then case when json_array_length(v) > 0 then 'array<' || array_to_string(list_sort(list_distinct(list_filter(list_transform(json_extract(v, '$[*]'), lambda e: {_KIND.format('e')}), lambda q: q is not null))), '|') || '>' end
  else {_KIND.format('v')} end as kind, case when {_KIND.format('v')} = 'number' then (v::double)::varchar else v::varchar end as val from f0) where kind is not null),
stats as (select stream_id, file_no, path, list_sort(list(distinct kind)) as kinds, count(*) as records from f group by all)"""

ORACLE: dict[str, str] = {
    "p2_types": f"with {_FIELDS} select stream_id, file_no, path, array_to_string(kinds, ',') as kinds, records from stats",
    "p2_found": f"""with {_FIELDS}, files as (select distinct stream_id, file_no from l),
        two as (select b.stream_id, b.file_no from files a join files b on a.stream_id = b.stream_id and a.file_no + 1 = b.file_no),
        d as (select coalesce(b.stream_id, a.stream_id) as stream_id, coalesce(b.file_no, a.file_no + 1) as file_no, coalesce(b.path, a.path) as path, a.kinds as was, b.kinds as kinds
          from stats a full join stats b on a.stream_id = b.stream_id and a.file_no + 1 = b.file_no and a.path = b.path),
        c as (select d.* from d join two using (stream_id, file_no) where was is distinct from kinds),
        r as (select distinct stream_id, file_no, line_id, val as run from f where path = 'run_id'),
        pr as (select o.stream_id, o.file_no, o.path as old_field, n.path as new_field, bool_and(x.val = y.val) as same from c o join c n on o.stream_id = n.stream_id and o.file_no = n.file_no and o.kinds is null and n.was is null
          join f x on x.stream_id = o.stream_id and x.file_no + 1 = o.file_no and x.path = o.path join r rx on rx.stream_id = x.stream_id and rx.file_no = x.file_no and rx.line_id = x.line_id
          join r ry on ry.stream_id = o.stream_id and ry.file_no = o.file_no and ry.run = rx.run join f y on y.stream_id = ry.stream_id and y.file_no = ry.file_no and y.line_id = ry.line_id and y.path = n.path group by all),
        nm as (select * from pr where same)
        select stream_id, file_no, 'renamed' as change_kind, old_field, new_field from nm
        union all select stream_id, file_no, 'removed', path, '' from c where kinds is null and (stream_id, file_no, path) not in (select (stream_id, file_no, old_field) from nm)
        union all select stream_id, file_no, 'added', '', path from c where was is null and (stream_id, file_no, path) not in (select (stream_id, file_no, new_field) from nm)
        union all select stream_id, file_no, 'retyped', path, path from c where was is not null and kinds is not null""",
    "p4_found": f"""with {_CELLS}, {_COUNTS}, {_MODELS}
        select result_id, 'score' as child, parent_key, item_key from cells
        union all select result_id, 'taxonomy', parent_key, item_key from counts
        union all select result_id, 'model', '', i::varchar from m
        union all select result_id, 'model_part', i::varchar, j::varchar from pt""",
    "p4_scores": f"""with {_CELLS} select result_id, parent_key, item_key, json_extract_string(v, '$.n_instances')::double as n_instances,
        json_extract_string(v, '$.score')::double as score, json_extract_string(v, '$.stderr')::double as stderr from cells""",
    "p4_taxonomy": f"with {_COUNTS} select result_id, parent_key, item_key, n as count from counts",
    "p4_parts": f"with {_MODELS} select result_id, i::varchar as parent_key, j::varchar as item_key, p.part_name as part_name, p.n_tensors as n_tensors, p.dtype as dtype from pt",
}
