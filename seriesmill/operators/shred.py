"""Deeply nested records as flat tables with parent links.

Every value of a record becomes a node: its id (the way of places from the root), its parent's id, label (key, or null in
an array), ordinal, kind and scalar. All nodes of a record come out of one scan: a generator per level gives the ways from
the root to its leaves, and each inner node goes out with the first leaf below it. Entities are object nodes joined
with their scalar children; as both are keyed by the object's id, that join and the pivot are one grouping, which the
map side completes, since a record's nodes stand together.

Values nested deeper than max_depth are an error, not a cut. Null, blank or broken texts give no nodes. Empty objects and
arrays are nodes without children; nulls are nodes of kind null. Records are told apart by their row, so repeated and null
ids do not merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.variants import exploded, lexeme, parsed, shape


NODES = "array<struct<node_id:string,parent_id:string,path:array<string>,label:string,ordinal:int,kind:string,scalar:string,carried:string>>"


def _kind(shape_: Column) -> Column:
    return (
        F.when(shape_ == "STRING", "string")
        .when(shape_ == "BOOLEAN", "boolean")
        .when(shape_ == "VOID", "null")
        .when(shape_.startswith("OBJECT<"), "object")
        .when(shape_.startswith("ARRAY<"), "array")
        .otherwise("number")
    )


def nodes(records: DataFrame, key: str, roots: dict[str, Column], max_depth: int = 6, carry: str | None = None) -> DataFrame:
    """key, row_id, node_id, parent_id, path, label, ordinal, kind, scalar of every node below the roots (variants by name).
    A path begins with its root's name, unless that is empty. With carry, carried is the text that the nearest object
    above a node holds under that label."""
    root = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in roots.items())))
    # The number of a row is unique, whatever the ids are.
    d = records.select(F.col(key), F.monotonically_increasing_id().alias("row_id"), root.alias("_r"))
    none = F.lit(None).cast("string")
    d = d.select(key, "row_id", F.col("_r.name").alias("_id"), F.array_compact(F.array(F.nullif(F.col("_r.name"), F.lit("")))).alias("_path"), none.alias("_above"), F.array().cast(NODES).alias("_out"), F.col("_r.v").alias("_v"))
    for i in range(1, max_depth + 1):
        # _out holds the nodes on the way that no other way has sent out: a first child takes its parents along.
        d = exploded(d, "_v", "_k", "_c", "_p", outer=i > 1)
        d = d.withColumn("_s", shape(F.col("_c"))).withColumn("_t", _kind(F.col("_s"))).withColumn("_in", F.col("_t").isin("object", "array"))
        text = F.when(~F.col("_in"), lexeme(F.col("_c")))
        if i == max_depth:
            text = F.when(F.col("_in") & ~F.to_json("_c").isin("{}", "[]"), F.raise_error(F.lit(f"nested deeper than {max_depth}")).cast("string")).otherwise(text)
        step = F.col("_p").cast("string")
        d = d.withColumn("_at", F.concat_ws("/", "_id", step)).withColumn("_way", F.array_append("_path", F.coalesce("_k", step)))
        node = F.struct(F.col("_at").alias("node_id"), F.col("_id").alias("parent_id"), F.col("_way").alias("path"), F.col("_k").alias("label"), F.col("_p").alias("ordinal"), F.col("_t").alias("kind"), text.alias("scalar"), F.col("_above").alias("carried"))
        out = F.when(F.col("_p").isNull(), F.col("_out")).when(F.col("_p") == 0, F.array_append("_out", node)).otherwise(F.array(node))
        own = F.coalesce(F.when(F.col("_t") == "object", F.try_variant_get("_c", f"$.{carry}", "string")), F.col("_above")) if carry else none
        d = d.select(key, "row_id", F.col("_at").alias("_id"), F.col("_way").alias("_path"), own.alias("_above"), out.alias("_out"), F.when(F.col("_in"), F.col("_c")).alias("_v"))
    d = d.select(key, "row_id", F.explode("_out").alias("n")).select(key, "row_id", "n.*")
    return d if carry else d.drop("carried")


def adjacency(records: DataFrame, key: str, text: str, max_depth: int = 6) -> DataFrame:
    """The nodes of a JSON text."""
    return nodes(records, key, {"": parsed(F.col(text))}, max_depth)


def entities(nodes_: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Object nodes with the named scalar children pivoted into columns: key, row_id, node_id, parent_id, path, ordinal,
    carried (if the nodes have it), n_scalars and a column for each field."""
    is_object = F.col("kind") == "object"
    scalar = ~F.col("kind").isin("object", "array")
    # An object takes part as itself; a scalar as a child of its parent.
    owner = F.when(is_object, F.col("node_id")).when(scalar & F.col("label").isNotNull(), F.col("parent_id"))
    carried = ["carried"] if "carried" in nodes_.columns else []
    n = nodes_.withColumn("_owner", owner).where("_owner is not null")
    out = n.groupBy(key, "row_id", "_owner").agg(
        F.max(F.when(is_object, F.struct("parent_id", "path", "ordinal", *carried))).alias("_o"),
        F.count_if(scalar & (F.col("kind") != "null")).alias("n_scalars"),
        *(F.max(F.when(scalar & (F.col("label") == f), F.col("scalar"))).alias(f) for f in fields),
    )
    return out.where("_o is not null").select(key, "row_id", F.col("_owner").alias("node_id"), "_o.*", "n_scalars", *fields)


# The tables of an evaluation result.

FIELDS = {"scores": ["axis", "chart_type", "source", "n_instances", "score", "stderr"], "models": ["name", "parameters", "size_mb", "trainable_parameters"], "parts": ["part_name", "n_tensors", "dtype"]}


def result_entities(results: DataFrame, *roots: str) -> DataFrame:
    """The entities of scores and models, or of one of them; every text is parsed once."""
    values = {"scores": parsed(F.col("scores")), "models": F.to_variant_object("models")}
    fields = [f for r in roots for part in ({"models": ["models", "parts"]}.get(r, [r])) for f in FIELDS[part]]
    return entities(nodes(results, "result_id", {r: values[r] for r in roots}, carry="source"), "result_id", fields)


def _cell() -> tuple[Column, Column, Column]:
    """Whether an entity is the object with the figures of one group, and its parent_key and item_key: its place in an
    object, or its own axis, chart_type or source in an array."""
    at = lambda i: F.try_element_at("path", F.lit(i + 2))
    depth, group = F.size("path") - 1, at(0)
    deep = group == "by_source_and_chart_type"
    own = F.coalesce(F.when(group == "by_axis", F.col("axis")).when(group == "by_source", F.col("source")).otherwise(F.col("chart_type")), F.element_at("path", -1))
    # In an array of sources, a cell's source is a scalar of the object that holds its by_chart_type.
    source = F.when(depth == 2, F.col("source")).when(at(2) == "by_chart_type", F.coalesce("carried", at(1))).otherwise(at(1))
    flat = group.isin("by_axis", "by_chart_type", "by_source") & (depth == 2)
    # At depth 2 of by_source_and_chart_type only cells that name both are cells; the others are the sources themselves.
    whole = flat | deep & ((depth == 2) & F.col("chart_type").isNotNull() & F.col("source").isNotNull() | (depth == 3) & (at(2) != "by_chart_type") | (depth == 4) & (at(2) == "by_chart_type"))
    return (F.col("path")[0] == "scores") & whole & (F.col("n_scalars") > 0), F.when(deep, F.concat(F.lit("by_source_and_chart_type/"), source)).otherwise(group), own


def _model() -> tuple[Column, Column, Column]:
    """As _cell, for a non-null model, by its place from 0."""
    return F.expr("path[0] = 'models' and size(path) = 2"), F.lit(""), F.element_at("path", -1)


def _part() -> tuple[Column, Column, Column]:
    """As _cell, for a non-null part, by the places of its model and its own."""
    return F.expr("path[0] = 'models' and size(path) = 4 and path[2] = 'parts'"), F.try_element_at("path", F.lit(2)), F.element_at("path", -1)


def _rows(e: DataFrame, place: tuple[Column, Column, Column], fields: dict[str, str]) -> DataFrame:
    which, parent, item = place
    return e.where(which).select("result_id", parent.alias("parent_key"), item.alias("item_key"), *(F.col(f).try_cast(t).alias(f) for f, t in fields.items()))


def score_cells(results: DataFrame) -> DataFrame:
    """result_id, parent_key, item_key, n_instances, score, stderr."""
    return _rows(result_entities(results, "scores"), _cell(), dict.fromkeys(("n_instances", "score", "stderr"), "double"))


def model_rows(results: DataFrame) -> DataFrame:
    """result_id, parent_key, item_key and fields of every non-null model."""
    return _rows(result_entities(results, "models"), _model(), {"name": "string", "parameters": "bigint", "size_mb": "double", "trainable_parameters": "bigint"})


def model_parts(results: DataFrame) -> DataFrame:
    """result_id, parent_key, item_key and fields of every non-null part."""
    return _rows(result_entities(results, "models"), _part(), {"part_name": "string", "n_tensors": "int", "dtype": "string"})


def taxonomy_counts(results: DataFrame) -> DataFrame:
    """result_id, parent_key, item_key, count of every count that is a number."""
    n = adjacency(results, "result_id", "taxonomy").where("kind = 'number' and label is not null")
    top = (F.size("path") == 2) & (F.col("path")[0] == "counts")
    by_type = (F.size("path") == 3) & (F.col("path")[0] == "by_ground_truth_chart_type")
    key = F.when(top, F.lit("counts")).when(by_type, F.concat(F.lit("by_ground_truth_chart_type/"), F.col("path")[1]))
    return n.where(top | by_type).select("result_id", key.alias("parent_key"), F.col("label").alias("item_key"), F.col("scalar").try_cast("double").alias("count"))


def child_rows(results: DataFrame) -> DataFrame:
    """result_id, child, parent_key, item_key: all child rows of all tables. Scores and models are shredded and grouped
    once, and every entity becomes the row of the one table that it belongs to."""
    row = lambda name, p: F.when(p[0], F.struct(F.lit(name).alias("child"), p[1].alias("parent_key"), p[2].alias("item_key")))
    table = F.coalesce(*(row(n, p()) for n, p in (("score", _cell), ("model", _model), ("model_part", _part))))
    rows = result_entities(results, "scores", "models").select("result_id", F.explode(F.array_compact(F.array(table))).alias("r")).select("result_id", "r.*")
    return rows.unionByName(taxonomy_counts(results).select("result_id", F.lit("taxonomy").alias("child"), "parent_key", "item_key"))
