"""The llm problems' queries over the driver tables, and their SQL."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import epoch_sample, mixture, packing, quota_sample, sentences
from seriesmill.session import shared_folder


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    r = quota_sample.batch_report(_t(spark, sf, "annotations"), _t(spark, sf, "sample_targets"))
    return r.where("short > 0").select("batch_id", "source", "chart_type")


def p1_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return quota_sample.batch_report(_t(spark, sf, "annotations"), _t(spark, sf, "sample_targets"))


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return quota_sample.batch_sample(_t(spark, sf, "annotations"), _t(spark, sf, "sample_targets"))


def _p3(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of these tables is kept in the shared folder, so that later calls only add to the sample."""
    ledger = f"{shared_folder(spark)}/ledgers/{hashlib.md5(os.path.abspath(sf).encode()).hexdigest()}"
    return epoch_sample.image_sample(*(_t(spark, sf, n) for n in ("image_refs", "annotations", "picks")), ledger=ledger)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p3(spark, sf).where("carried").select("image_id")


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _p3(spark, sf).select("image_id", F.col("epoch").cast("bigint").alias("epoch"), "rate", "carried")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_t(spark, sf, "documents"), _t(spark, sf, "pack_specs"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packing had to cut: those with a second piece."""
    return _packed(spark, sf).where("piece_no = 1").select("spec_id", "doc_id").distinct()


def p5_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf), _t(spark, sf, "pack_specs"))


def p5_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Mix rows that the mixing left short of their goal although every pass was used."""
    r = mixture.mix_report(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))
    return r.where("actual_tokens < goal_tokens and out_of_reach").select("mix_id", "source")


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix_report(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p6_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mixed(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_t(spark, sf, "documents")).select("doc_id", "sent_start", "sent_end")


def p7_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_t(spark, sf, "documents"), with_text=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_quotas, p1_sample, p3_found, p3_sample, p5_found, p5_fill, p5_containers, p6_found, p6_shares, p6_mix, p7_found, p7_sentences)}

# An image id in a text, and the labels, as in functions.labels.
_ID = "nullif(regexp_extract(lower({0}), '^[\\s\\x{{00a0}}]*(?:[^\\r\\n]*[/\\\\])?([0-9a-f]{{12}})(?:_[xy])?(?:\\.[^/\\\\\\s]*)?[\\s\\x{{00a0}}]*$', 1), '')"
_LETTERS = "regexp_replace(lower({0}), '[^\\pL]+', '', 'g')"
_SOURCE = "case " + _LETTERS + " when 'generated' then 'generated' when 'extracted' then 'extracted' end"
_TYPE = "case " + _LETTERS + " when 'line' then 'line' when 'scatter' then 'scatter' when 'dot' then 'dot' when 'verticalbar' then 'vertical_bar' when 'horizontalbar' then 'horizontal_bar' end"

_LATEST = f"""
named as (select {_ID.format('image_id')} as img, * from annotations),
latest as (select img as image_id, batch_id, {_SOURCE.format('source')} as source, {_TYPE.format('chart_type')} as chart_type
  from (select *, row_number() over (partition by img order by annotated_at desc nulls last, annotation_id desc nulls last) as rn from named where img is not null) where rn = 1),
counts as (select batch_id, source, chart_type, count(*) as n from latest group by all),
t0 as (select t.batch_id, t.source, t.chart_type, target_permille::bigint as share, min_count::bigint as fl, sample_size::bigint as size, coalesce(n, 0)::bigint as available,
  (target_permille::bigint * sample_size) // 1000 as base, (target_permille::bigint * sample_size) % 1000 as rest
  from sample_targets t left join counts c on t.batch_id = c.batch_id and t.source = c.source and t.chart_type = c.chart_type),
t1 as (select *, greatest(fl, base) as required from t0)"""

# The level of every bend is tried against the definition of the total, by a join; nothing is summed up along the way.
_QUOTAS = f"""{_LATEST},
b as (select *, least(required, available)::hugeint as lo, available::hugeint as hi, greatest(sum(share) over g * max(size) over g // 1000, sum(least(required, available)) over g)::hugeint as goal
  from t1 window g as (partition by batch_id)),
bends as (select distinct batch_id, goal, v as p, share::hugeint as q from (select batch_id, goal, share, lo as v from b where share > 0 union all select batch_id, goal, share, hi from b where share > 0)),
sums as (select e.batch_id, e.p, e.q, sum(case when share > 0 then least(hi * e.q, greatest(lo * e.q, e.p * share)) else lo * e.q end) as total from bends e join b using (batch_id) group by e.batch_id, e.p, e.q, e.goal having total <= e.goal * e.q),
best as (select * from (select *, row_number() over (partition by batch_id order by p::double / q::double desc) as rn from sums) where rn = 1),
z as (select b.*, p, q, coalesce(share > 0 and lo * q <= p * share and p * share < hi * q, false) as grows from b left join best using (batch_id)),
y as (select *, goal - sum(case when grows then 0 when share > 0 and p * share >= hi * q then hi else lo end) over (partition by batch_id) as rem, sum(case when grows then share::hugeint else 0 end) over (partition by batch_id) as w from z),
x as (select *, case when grows then rem * share // w when share > 0 and p * share >= hi * q then hi else lo end as q1, case when grows then rem * share % w else 0 end as frac from y),
v as (select *, goal - sum(q1) over (partition by batch_id) as more, row_number() over (partition by batch_id order by frac desc, source, chart_type) as rk from x),
quotas as (select batch_id, source, chart_type, required, available, (q1 + case when frac > 0 and rk <= more then 1 else 0 end)::bigint as quota, greatest(0, required - available) as short from v)"""

_P3 = f"""
with r as (select {_ID.format('coalesce(image_id, path)')} as image_id, min(loaded_at) as t from image_refs group by 1),
a as (select {_ID.format('image_id')} as image_id, min(loaded_at) as t from annotations group by 1),
p as (select {_ID.format('image_id')} as image_id, min(coalesce(draw_no, 0)) as draw from picks group by 1),
draws as (select draw_no, min(picked_at) as t from picks where draw_no is not null group by 1 having min(picked_at) is not null),
seen as (select image_id, greatest(r.t, a.t) as t, draw from r join a using (image_id) left join p using (image_id) where image_id is not null),
ledger as (select image_id, coalesce(draw, (select min_by(d.draw_no, d.t) from draws d where d.t >= seen.t), (select max_by(draw_no, t) + 1 from draws))::bigint as epoch,
  case when draw is not null then 1.0 else 0.1 end::double as rate, draw is not null as carried from seen)
select image_id, epoch, rate, carried from ledger where ('0x' || substr(md5('7:0:' || image_id), 1, 13))::bigint::double / 4503599627370496.0 < rate"""

_KEY = "lower(trim(source, (' ' || chr(9) || chr(10) || chr(13) || chr(160))))"
_MIX = f"""
d0 as (select {_KEY} as key, doc_id, coalesce(strlen(text), 0)::hugeint as size, coalesce(length(regexp_replace(text, '[^\\pL\\pM]+', '', 'g'))::double / (length(text) + 100), 0) as w,
  ln(-ln((('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 1) / 4503599627370497.0)) as e from documents),
d as (select *, coalesce(sum(size) over (partition by key order by w <= 0, case when w > 0 then e - ln(w) else e end, doc_id, size rows between unbounded preceding and 1 preceding), 0)::hugeint as before from d0),
per as (select key, sum(size)::hugeint as s from d0 where key is not null group by 1), total as (select coalesce(sum(size), 0)::hugeint as t from d0),
m as (select mix_id, source, {_KEY} as key, coalesce(s, 0) as s, coalesce(target_permille, 0)::hugeint * coalesce(budget_permille, 0) * t as goal, coalesce(max_repeats, 0)::hugeint as most from mix_targets left join per on per.key = {_KEY}, total),
pl as (select *, case when s = 0 then 0 else least(most, goal // (s * 1000000)) end as passes from m),
plan as (select *, case when s = 0 or passes >= most then 0 else (goal - passes * s * 1000000) // 1000000 end as part from pl),
used as (select mix_id, plan.source, doc_id, size, passes + case when part > 0 and 2 * before + size <= 2 * part then 1 else 0 end as repeats from plan join d using (key)),
mix as (select * from used where repeats > 0)"""

ORACLE: dict[str, str] = {
    "p1_found": f"with {_LATEST} select batch_id, source, chart_type from t1 where available < required",
    "p1_quotas": f"with {_QUOTAS} select batch_id, source, chart_type, required, available, quota, short from quotas",
    "p1_sample": f"""with {_QUOTAS} select batch_id, source, chart_type, image_id from
        (select l.*, quota, row_number() over (partition by l.batch_id, l.source, l.chart_type order by md5('7:' || image_id), image_id) as rn
         from latest l join quotas q on l.batch_id = q.batch_id and l.source = q.source and l.chart_type = q.chart_type) where rn <= quota""",
    "p3_found": f"select image_id from ({_P3}) where carried",
    "p3_sample": _P3,
    "p6_mix": f"with {_MIX} select mix_id, source, doc_id, size::bigint as size, repeats::bigint as repeats from mix",
    "p6_shares": f"""with {_MIX}, u as (select mix_id, source, sum(size * repeats)::bigint as actual_tokens, count(*) as texts from mix group by all)
        select mix_id, source, goal::double / 1000000 as goal_tokens, coalesce(actual_tokens, 0) as actual_tokens, coalesce(texts, 0) as texts, passes::bigint as passes,
        round(1000 * coalesce(actual_tokens, 0)::double / nullif(sum(coalesce(actual_tokens, 0)) over (partition by mix_id), 0), 3) as actual_permille, s * most * 1000000 < goal as out_of_reach from plan left join u using (mix_id, source)""",
    "p5_found": "select spec_id, doc_id from documents, pack_specs where coalesce(strlen(text), 0) > capacity_tokens",
    "p6_found": """with d as (select lower(trim(source, (' ' || chr(9) || chr(10) || chr(13) || chr(160)))) as key, coalesce(strlen(text), 0)::hugeint as n from documents),
        s as (select key, sum(n) as n from d where key is not null group by 1), w as (select coalesce(sum(n), 0) as n from d)
        select mix_id, source from mix_targets left join s on s.key = lower(trim(source, (' ' || chr(9) || chr(10) || chr(13) || chr(160)))), w
        where coalesce(s.n, 0) * max_repeats * 1000000 < target_permille::hugeint * budget_permille * w.n""",
}
