"""Rows in, rows out."""

from pyspark.sql import functions as F

from seriesmill.functions.values import SERIES


def series(*values):
    """VAL tuples of Python values."""
    out = []
    for v in values:
        if v is None:
            out.append(("null", "None", None))
        elif isinstance(v, bool):
            out.append(("bool", str(v), None))
        elif isinstance(v, str):
            out.append(("str", v, None))
        else:
            out.append(("int" if isinstance(v, int) else "float", str(v), float(v)))
    return out


def column(spark, expr, schema, rows):
    """The values of an expression over rows, in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def pairs(spark, expr, rows):
    return column(spark, expr, f"t {SERIES}, p {SERIES}", rows)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


C = F.col
