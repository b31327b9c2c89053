"""Schemas that drift between files: one consistent table, and every change.

Rows become path-value maps with raw types; path and type statistics are aggregated by file; files are compared with
their predecessors; and typed columns are projected from any of a field's names, with every failed cast reported.

A field is a key at the top whose value is not an object, or a key in a top-level object, written a or a.b. Nulls, empty
arrays and empty objects say nothing. Null, blank, cut-off and non-object bodies, and objects that repeat a key, do not
count, but their file exists. Rows without a stream or file number belong to no file. Repeated rows say nothing new.

Statistics are pre-aggregated on the way into their shuffle. Values are compared only for runs that two neighbouring files
list, joined by run; a stream or file may hold any part of all rows. Arrays per file hold field names, as many as there
are fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.bounded import collect_bounded, small_side
from seriesmill.functions.variants import canonical_of, elements, exploded, kind_of, lexeme, parsed, shape
from seriesmill.session import checkpointed

FILE = ["stream_id", "file_no"]


def field_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """FILE, line_id, keep, run, run_id, path, shape, value and kind: one row per field of a line that says something. run
    is the canonical form of the line's run_id."""
    d = lines.where("stream_id is not null and file_no is not null").select(*FILE, "line_id", *keep, parsed(F.col("body"), objects=True).alias("_v"))
    d = d.select("*", F.try_variant_get("_v", "$.run_id", "variant").alias("_run")).withColumn("run", canonical_of(shape(F.col("_run")), F.col("_run"))).withColumn("run_id", lexeme(F.col("_run")))
    d = exploded(d.select(*FILE, "line_id", *keep, "run", "run_id", "_v"), "_v", "_key", "_value")
    d = d.withColumn("_inner", F.when(shape(F.col("_value")).startswith("OBJECT<"), F.col("_value")))
    d = exploded(d, "_inner", "_sub", "_child", outer=True)
    inner = F.col("_sub").isNotNull()
    d = d.select(*FILE, "line_id", *keep, "run", "run_id", F.when(inner, F.concat("_key", F.lit("."), "_sub")).otherwise(F.col("_key")).alias("path"), F.when(inner, F.col("_child")).otherwise(F.col("_value")).alias("value"))
    d = d.withColumn("shape", shape(F.col("value"))).withColumn("kind", kind_of(F.col("shape"), F.col("value")))
    return d.where("kind is not null")


def type_statistics(rows: DataFrame) -> DataFrame:
    """FILE, path, kinds (sorted set), records: one row per field of a file."""
    return rows.groupBy(*FILE, "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("records"))


def _pairs(lines: DataFrame) -> DataFrame:
    """The files that have a predecessor."""
    files = lines.where("stream_id is not null and file_no is not null").select(*FILE).distinct()
    return files.join(files.select("stream_id", (F.col("file_no") + 1).alias("file_no")), FILE, "left_semi")


def schema_changes(lines: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """stream_id, file_no, change_kind, old_field, new_field: every difference from the file before. statistics are the
    lines' type_statistics, if they are at hand."""
    stats = (type_statistics(field_rows(lines)) if statistics is None else statistics).select(*FILE, "path", F.array_join("kinds", ",").alias("k"))
    # Each row meets its successor's file too; a join of the statistics with themselves would read the lines twice.
    none = F.lit(None).cast("string")
    as_of = lambda back, k, was: F.struct((F.col("file_no") + back).alias("file_no"), k.alias("k"), was.alias("was"))
    diff = stats.select("stream_id", "path", F.explode(F.array(as_of(0, F.col("k"), none), as_of(1, none, F.col("k")))).alias("s"))
    diff = diff.groupBy("stream_id", "s.file_no", "path").agg(F.max("s.k").alias("kinds"), F.max("s.was").alias("was"))
    diff = diff.where("not (kinds <=> was)").join(_pairs(lines), FILE, "left_semi")
    side = F.when(F.col("kinds").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("retyped")
    diff = checkpointed(diff.select(*FILE, "path", side.alias("side")))  # a row per changed field, used three times
    named = checkpointed(_renames(lines, diff))
    taken = lambda c, s: named.select(*FILE, F.col(c).alias("path"), F.lit(s).alias("side")).distinct()
    rest = diff.join(taken("old_field", "removed").unionByName(taken("new_field", "added")), [*FILE, "path", "side"], "left_anti")
    none = F.lit("")
    old, new = F.when(F.col("side") == "added", none).otherwise(F.col("path")), F.when(F.col("side") == "removed", none).otherwise(F.col("path"))
    return named.select(*FILE, F.lit("renamed").alias("change_kind"), "old_field", "new_field").unionByName(rest.select(*FILE, F.col("side").alias("change_kind"), old.alias("old_field"), new.alias("new_field")))


def _renames(lines: DataFrame, diff: DataFrame) -> DataFrame:
    """FILE, old_field, new_field: pairs of a field that left and one that entered under which all runs that both files
    list, and that have both, have one value. Only lines of files that lost and gained fields are read again, and only
    pairs that share a value in some run are ever formed; they are renames if no run has two values, which needs a
    look at the runs only for pairs that agree in fewer runs than each of the two fields is in."""
    both = diff.where("side <> 'retyped'").groupBy(*FILE).agg(F.count_if(F.col("side") == "removed").alias("_g"), F.count_if(F.col("side") == "added").alias("_c")).where("_g > 0 and _c > 0")
    diff = small_side(diff.join(both.select(*FILE), FILE, "left_semi").select("stream_id", F.col("file_no").alias("later"), F.expr("if(side = 'removed', file_no - 1, file_no)").alias("file_no"), "path", "side").where("side <> 'retyped'"))
    files = small_side(diff.select(*FILE).distinct())
    cells = field_rows(lines.join(files, FILE, "left_semi")).where("run is not null").join(diff, [*FILE, "path"])
    value = canonical_of(F.col("shape"), F.col("value"))
    by = ["stream_id", "later", "run"]
    # A field with two values in a run of a file agrees with no other.
    cells = cells.select(*by, "side", "path", value.alias("v")).groupBy(*by, "side", "path").agg(F.min("v").alias("_a"), F.max("v").alias("_z"))
    cell = F.struct("path", F.when(F.col("_a") == F.col("_z"), F.col("_a")).alias("v"))
    runs = cells.groupBy(*by).agg(F.collect_list(F.when(F.col("side") == "removed", cell)).alias("gone"), F.collect_list(F.when(F.col("side") == "added", cell)).alias("come"))
    runs = checkpointed(runs.where("size(gone) > 0 and size(come) > 0"))  # runs listed twice, with the fields that changed
    file = ["stream_id", "later"]
    old = runs.select(*file, "come", F.explode("gone").alias("o"))
    equal = F.filter("come", lambda c: c["v"] == F.col("o.v"))
    pairs = old.select(*file, F.col("o.path").alias("old_field"), F.explode(equal).alias("n")).groupBy(*file, "old_field", F.col("n.path").alias("new_field")).agg(F.count("*").alias("agree"))
    n_old = old.groupBy(*file, F.col("o.path").alias("old_field")).agg(F.count("*").alias("n_old"))
    n_new = runs.select(*file, F.explode("come").alias("n")).groupBy(*file, F.col("n.path").alias("new_field")).agg(F.count("*").alias("n_new"))
    pairs = checkpointed(pairs.join(n_old, [*file, "old_field"]).join(n_new, [*file, "new_field"]))
    sure, open_ = pairs.where("agree >= least(n_old, n_new)"), pairs.where("agree < least(n_old, n_new)")
    names = open_.groupBy(*file, "old_field").agg(F.collect_list(F.struct("new_field", "agree")).alias("_with"))
    met = old.select(*file, F.transform("come", lambda c: c["path"]).alias("_come"), F.col("o.path").alias("old_field")).join(names, [*file, "old_field"])
    met = met.select(*file, "old_field", F.explode(F.filter("_with", lambda w: F.array_contains("_come", w["new_field"]))).alias("w"))
    met = met.groupBy(*file, "old_field", F.col("w.new_field").alias("new_field"), F.col("w.agree").alias("agree")).agg(F.count("*").alias("both")).where("agree = both")
    cols = ["stream_id", F.col("later").alias("file_no"), "old_field", "new_field"]
    return sure.select(*cols).unionByName(met.select(*cols))


@dataclass(frozen=True)
class Target:
    """A column of the consistent table: its name, its type (string, double, bigint, boolean or array<string>), the field
    it comes from and the unit of its numbers, if they have one."""

    name: str
    type: str
    field: str
    unit: str | None = None


#: Columns whose names and types are declared; all other fields get columns by the statistics of their types.
RUN_COLUMNS = (
    Target("mode", "string", "config.mode"),
    Target("caveats", "array<string>", "caveats"),
    Target("total_ms", "double", "latency.total_ms", "ms"),
    Target("num_beams", "bigint", "config.num_beams"),
    Target("precision", "string", "config.precision"),
    Target("model_tag", "string", "config.model_tag"),
    Target("subset", "string", "config.subset"),
    Target("overall", "double", "scores.overall"),
    Target("n_images", "bigint", "split.n_images"),
    Target("wall_s", "double", "latency.total_wall_s", "s"),
)
# Units of time in milliseconds.
UNITS = {"us": 0.001, "ms": 1.0, "millis": 1.0, "s": 1000.0, "sec": 1000.0, "seconds": 1000.0, "min": 60_000.0, "h": 3_600_000.0}


def root_names(changes: DataFrame) -> DataFrame:
    """stream_id, file_no, path, root: from file_no on the stream's field path is the one that was called root before its
    first renaming. Chains are followed by doubling; every round halves them."""
    named = changes.where("change_kind = 'renamed'")
    ev = checkpointed(named.groupBy("stream_id", "file_no", F.col("new_field").alias("path")).agg(F.min("old_field").alias("root")).withColumn("at", F.col("file_no")))
    while True:
        up = ev.select("stream_id", F.col("path").alias("root"), F.struct("file_no", F.col("root").alias("r"), F.col("at").alias("a")).alias("up"))
        met = ev.join(up, ["stream_id", "root"], "left").withColumn("up", F.when(F.col("up.file_no") < F.col("at"), F.col("up")))
        met = met.groupBy("stream_id", "file_no", "path", "root", "at").agg(F.max("up").alias("up"))
        new = checkpointed(met.select("stream_id", "file_no", "path", F.coalesce("up.r", "root").alias("root"), F.coalesce("up.a", "at").alias("at"), F.col("up").isNotNull().alias("moved")))
        ev = new.drop("moved")
        if new.where("moved").isEmpty():
            return ev.drop("at")


def _family(pairs: set[tuple[str, str]], owned: set[str]) -> dict[str, str]:
    """What a name stands for in streams that begin with it. Names tied by renamings in any stream stand for the declared
    one among them, or for the least. If they lead to two declared ones, because a name means something else in
    another stream, a name stands for the root it has in all streams where it came by renaming, if they agree."""
    near: dict[str, set[str]] = {}
    for new, root in pairs:
        near.setdefault(new, set()).add(root)
        near.setdefault(root, set()).add(new)
    roots: dict[str, set[str]] = {}
    for new, root in pairs:
        roots.setdefault(new, set()).add(root)
    out: dict[str, str] = {}
    for start in sorted(near):
        if start in out:
            continue
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        heads = sorted(seen & owned)
        for n in seen:
            only = roots.get(n, set()) - {n}
            out[n] = heads[0] if len(heads) == 1 else min(seen) if not heads else n if n in owned or len(only) != 1 else next(iter(only))
    return out


def columns_of(statistics: DataFrame, roots: DataFrame, targets: Sequence[Target] = RUN_COLUMNS, max_names: int = 100_000) -> dict[str, Target]:
    """The column of every name that a field's root can have. Only distinct names reach the driver (a vocabulary; an
    error beyond max_names)."""
    kinds = statistics.groupBy("path").agg(F.count_if(F.exists("kinds", lambda k: k.startswith("array"))).alias("array"), *(F.count_if(F.array_contains("kinds", k)).alias(k) for k in ("number", "string", "boolean", "object")))
    kinds = {r.path: r for r in collect_bounded(kinds, max_names, "field names")}
    pairs = {(r.path, r.root) for r in collect_bounded(roots.select("path", "root").distinct(), max_names, "renamed fields")}
    owner = {t.field: t for t in targets}
    family = _family(pairs, set(owner))
    members: dict[str, list[str]] = {}
    for n in sorted(set(kinds) | set(family)):
        members.setdefault(family.get(n, n), []).append(n)
    out, used = {}, {t.name for t in targets} | {"stream_id", "run_id", "line_id", "file_no", "renamed_from", "failed_casts", "other_fields"}
    for head, names in members.items():
        if head == "run_id":
            continue
        if head not in owner:
            n = {k: sum(kinds[m][k] for m in names if m in kinds) for k in ("array", "number", "string", "boolean", "object")}
            type_ = "array<string>" if n["array"] else "double" if n["number"] and n["number"] >= n["string"] else "boolean" if n["boolean"] and not n["string"] and not n["object"] else "string"
            name = head.replace(".", "_")
            while name.lower() in {u.lower() for u in used}:
                name += "_"
            used.add(name)
            owner[head] = Target(name, type_, head, next((u for u in UNITS if head.lower().endswith(f"_{u}")), None))
        out |= {n: owner[head] for n in names}
    return out | {t.field: t for t in targets}


def _text(value: Column, shape_: Column) -> Column:
    """A string as it is; an object's name, value or text, else its JSON; anything else as JSON."""
    inner = F.coalesce(*(F.try_variant_get(value, f"$.{k}", "variant") for k in ("name", "value", "text")))
    return F.when(shape_ == "STRING", F.try_variant_get(value, "$", "string")).when(shape_.startswith("OBJECT<"), F.coalesce(lexeme(inner), F.to_json(value))).otherwise(F.to_json(value))


def _number(value: Column, shape_: Column, unit: Column) -> Column:
    """A number in the column's unit. Texts may group digits by commas and name a unit, objects hold value and unit, or
    one field named by a unit. Null if there is a unit that is unknown, or none to convert to."""
    text = F.when(shape_.startswith("OBJECT<"), lexeme(F.try_variant_get(value, "$.value", "variant"))).otherwise(_text(value, shape_))
    said = F.when(shape_.startswith("OBJECT<"), F.try_variant_get(value, "$.unit", "string"))
    for u in UNITS:
        alone = F.when(shape_.startswith(f"OBJECT<{u}: ") & ~F.contains(shape_, F.lit(", ")), lexeme(F.try_variant_get(value, f"$.{u}", "variant")))
        text, said = F.coalesce(text, alone), F.coalesce(said, F.when(alone.isNotNull(), F.lit(u)))
    pattern = r"^\s*([-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?(?:[eE][-+]?\d+)?)\s*([a-zA-Zµ%]*)\s*$"
    n = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    said = F.coalesce(said, F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")))
    table = F.create_map(*(x for u, f in UNITS.items() for x in (F.lit(u), F.lit(f))))
    factor = lambda u: F.try_element_at(table, F.lower(u))
    return F.when(said.isNull() | (F.lower(said) == unit), n).otherwise(n * factor(said) / factor(unit))


def consistent_table(lines: DataFrame, roots: DataFrame, columns: dict[str, Target], max_columns: int = 200) -> DataFrame:
    """One row per run of a stream: a typed column per family of names, the names that values came under, and
    failed_casts (column: raw value) of all its lines. Each column takes the last line (file_no, then line_id) whose
    value casts, for a later line may leave a field out; file_no is that of the run's last line. A body without a run_id
    has a row of its own under its line_id.

    A field's column depends on its stream and file (root_names). Columns beyond max_columns, and the other of two
    fields of a line that belong to one column, are kept in other_fields (path to JSON text)."""
    heads = {t.field: t for t in columns.values()}
    shown = list(heads.values())[:max_columns]
    spark = lines.sparkSession
    table = small_side(spark.createDataFrame([(n, t.field, t.type, t.unit) for n, t in columns.items()], "root string, field string, type string, unit string"))
    since = small_side(roots.groupBy("stream_id", "path").agg(F.collect_list(F.struct("file_no", "root")).alias("_since")))
    cells = field_rows(lines).where("path <> 'run_id'").join(since, ["stream_id", "path"], "left")
    then = F.array_max(F.filter("_since", lambda x: x["file_no"] <= F.col("file_no")))["root"]
    cells = cells.withColumn("root", F.coalesce(then, F.col("path"))).join(table, "root")
    value, form, kind_ = F.col("value"), F.col("shape"), F.col("kind")
    d = _number(value, form, F.col("unit"))
    as_list = F.when(kind_.startswith("array"), F.transform(elements(value), lambda e: _text(e, shape(e)))).otherwise(F.split(_text(value, form), r"\s*\|\s*"))
    whole = F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string"))
    text = (
        F.when(F.col("type") == "double", d.cast("string"))
        .when(F.col("type") == "bigint", whole)
        .when(F.col("type") == "boolean", F.when(F.lower(_text(value, form)).isin("true", "false"), F.lower(_text(value, form))))
        .when(F.col("type") == "array<string>", F.to_json(as_list))
        .otherwise(_text(value, form))
    )
    cells = cells.select("stream_id", "run_id", F.when(F.col("run_id").isNull(), F.col("line_id")).alias("line_id"), F.struct("file_no", F.col("line_id").alias("line")).alias("at"), "field", "path", text.alias("v"), F.to_json(value).alias("raw"))
    key = ["stream_id", "run_id", "line_id"]
    rank = F.struct(F.col("v").isNotNull().alias("casts"), "at")
    by_path = cells.groupBy(*key, "field", "path").agg(F.max("at").alias("last"), F.max_by(F.struct("v", "raw"), rank).alias("best"), F.max(rank).alias("rank"), F.collect_set(F.when(F.col("v").isNull(), F.col("raw"))).alias("bad"))
    one = F.struct("rank", (F.col("path") == F.col("field")).alias("own"), "path", "best")
    by_field = by_path.groupBy(*key, "field").agg(F.max("last").alias("last"), F.max(one).alias("one"), F.collect_list(one).alias("all"), F.flatten(F.collect_list("bad")).alias("bad"))
    # As many entries as there are fields.
    entry = F.struct("field", F.col("one.best.v").alias("v"), F.col("one.path").alias("path"))
    beside = F.filter("all", lambda x: (x["rank"]["at"] == F.col("one.rank.at")) & (x["path"] != F.col("one.path")))
    far = F.when(~F.col("field").isin([t.field for t in shown]), F.array(F.col("one"))).otherwise(F.slice(F.array("one"), 1, 0))
    pair = lambda x: F.struct(x["path"].alias("path"), x["best"]["raw"].alias("raw"))
    runs = by_field.groupBy(*key).agg(
        F.max("last.file_no").alias("file_no"),
        F.map_from_entries(F.collect_list(F.struct("field", entry.alias("e")))).alias("of"),
        F.flatten(F.collect_list(F.transform(F.concat(beside, far), pair))).alias("other"),
        F.flatten(F.collect_list(F.transform("bad", lambda r: F.struct(F.col("field").alias("field"), r.alias("raw"))))).alias("bad"),
    )
    get = lambda t, c: F.try_element_at("of", F.lit(t.field))[c]
    typed = lambda t: F.from_json(get(t, "v"), "array<string>") if t.type == "array<string>" else get(t, "v").try_cast(t.type)
    names = F.create_map(*(x for t in heads.values() for x in (F.lit(t.field), F.lit(t.name)))) if heads else F.create_map(F.lit(""), F.lit(""))
    origin = F.filter(F.array(*(F.when(get(t, "path") != t.field, F.concat(F.lit(f"{t.name}: "), get(t, "path"))) for t in shown)), lambda x: x.isNotNull())
    bad = F.array_sort(F.array_distinct(F.transform("bad", lambda b: F.concat(names[b["field"]], F.lit(": "), b["raw"]))))
    return runs.select(*key, "file_no", *(typed(t).alias(t.name) for t in shown), F.array_sort(origin).alias("renamed_from"), bad.alias("failed_casts"), F.map_from_entries(F.array_sort("other")).alias("other_fields"))


def consistent_runs(lines: DataFrame, targets: Sequence[Target] = RUN_COLUMNS, max_columns: int = 200) -> DataFrame:
    """consistent_table of lines, with columns and families from their own statistics and changes."""
    statistics = checkpointed(type_statistics(field_rows(lines)))  # a row per field of a file
    roots = root_names(schema_changes(lines, statistics))
    return consistent_table(lines, roots, columns_of(statistics, roots, targets), max_columns)
