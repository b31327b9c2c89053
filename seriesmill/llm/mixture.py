"""Mixing sources to target shares of the total size.

Each source has a budget of tokens. Whole passes over the source come first, at most max_repeats of them; what is left of
the budget is filled by a weighted sample without replacement (Efraimidis and Spirakis): every text has an exponential
key -ln(u) / weight, texts are sorted by key within their source and taken while their prefix sum stays within half a
text of the budget. u depends on the id alone, so mixes take prefixes of one order.

Texts are read once: what remains of them is source, id, size and the key's logarithm. A source may hold any part of all
texts, and weights may be any numbers: the logarithm of an exponential key has a density below 0.37 whatever it is
shifted by, so buckets of equal width in it hold at most 0.37 / RESOLUTION of their source. Sums by bucket are
prefix-summed; whole buckets are taken as they are, and only the bucket in which a budget ends is sorted. Sizes are those
of a byte-level tokenizer: UTF-8 bytes.

Defined results: a null source belongs to no mix but counts in the total; null and empty texts have size 0 and come
along with a whole pass; a mix row whose source has no texts gets none and is out of reach unless its goal is 0; null
figures of a mix are 0; every row counts, repeated ids too. A text whose weight is null, not a number or not positive comes
after all others, one of infinite weight before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions.bounded import small_side
from seriesmill.functions.labels import squeezed
from seriesmill.session import checkpointed

#: Buckets to a unit of the key's logarithm.
RESOLUTION = 1024
#: Length in characters at which a text has half the weight that its length can give it.
HALF_LENGTH = 100


def tokens(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0))


def quality(text: Column) -> Column:
    """The weight of texts that bring none: the share of letters and marks, times n / (n + HALF_LENGTH) for n characters."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    return F.coalesce(letters.cast("double") / (n + HALF_LENGTH), F.lit(0.0))


def sized(docs: DataFrame, weight: Column | None = None, seed: int = 7) -> DataFrame:
    """key (source), doc_id, size, rank (-1, 0 or 1: infinite, usual, no weight), log (of the key) and bucket of every
    text; checkpointed, so that texts are read once."""
    w = (quality(F.col("text")) if weight is None else weight).cast("double")
    d = docs.select(squeezed(F.col("source")).alias("key"), "doc_id", tokens(F.col("text")).alias("size"), w.alias("w"))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    rank = F.when(F.col("w") == float("inf"), -1).when((F.col("w") > 0) & ~F.isnan("w"), 0).otherwise(1)
    # (bits + 1) / (2 ** 52 + 1) lies within 0 and 1, so that both logarithms are finite.
    d = d.select("key", "doc_id", "size", rank.alias("rank"), F.log(-F.log((bits + 1) / float((1 << 52) + 1))).alias("e"), "w")
    d = d.select("key", "doc_id", "size", "rank", F.when(F.col("rank") == 0, F.col("e") - F.log("w")).otherwise(F.col("e")).alias("log"))
    return checkpointed(d.withColumn("bucket", F.col("rank") * (1 << 40) + F.floor(F.col("log") * RESOLUTION)))


def mix_plan(d: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per row of targets: mix_id, source, key, size and texts (of the source), goal, passes, part (tokens of the
    broken pass), out_of_reach. goal is in millionths of a token; all products are exact decimals. d is what sized gives."""
    totals = d.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    whole = F.coalesce(totals.agg(F.sum("size")).scalar(), F.lit(0)).cast("decimal(20,0)")
    n = lambda c: F.coalesce(F.col(c).cast("decimal(9,0)"), F.lit(0).cast("decimal(9,0)"))
    t = targets.select("mix_id", "source", squeezed(F.col("source")).alias("key"), n("target_permille").alias("_t"), n("max_repeats").alias("_m"), n("budget_permille").alias("_b"))
    t = t.join(totals.where("key is not null"), "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("size", "n")})
    t = t.withColumn("_s", F.col("size").cast("decimal(20,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("goal", (F.col("_t") * F.col("_b")).cast("decimal(12,0)") * whole)
    t = t.withColumn("_max", (F.col("_s").cast("decimal(27,0)") * F.col("_m")).cast("decimal(38,0)")).withColumn("goal", F.col("goal").cast("decimal(38,0)"))
    t = t.withColumn("passes", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.col("_m").cast("bigint"), F.expr("goal div nullif(_s, 0)"))))
    t = t.withColumn("part", F.when((F.col("size") == 0) | (F.col("passes") >= F.col("_m")), F.lit(0)).otherwise(F.expr("(goal - passes * _s) div 1000000")).cast("bigint"))
    return t.select("mix_id", "source", "key", "size", F.col("n").alias("texts"), "goal", F.col("passes").cast("bigint").alias("passes"), "part", (F.col("_max") < F.col("goal")).alias("out_of_reach"))


def _ends(d: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """plan with the broken pass's whole buckets (upto, full_tokens, full_texts) and the one in which it ends (edge), and
    the rows of all edges, sorted: key, bucket, doc_id, size, before (tokens of the source in front of the text)."""
    sums = d.groupBy("key", "bucket").agg(F.sum("size").alias("_n"), F.count("*").alias("_c"))
    over = W.partitionBy("key").orderBy("bucket")
    sums = checkpointed(sums.withColumn("_to", F.sum("_n").over(over)).withColumn("_texts", F.sum("_c").over(over)).withColumn("_from", F.col("_to") - F.col("_n")))
    met = sums.join(plan.where("part > 0").select("mix_id", "source", "key", "part"), "key").where("_from <= part")
    met = met.groupBy("mix_id", "source").agg(
        F.max(F.when(F.col("_to") <= F.col("part"), F.struct("bucket", "_to", "_texts"))).alias("_f"),
        F.min(F.when(F.col("_to") > F.col("part"), F.struct("bucket", "_from"))).alias("_e"),
    )
    met = met.select("mix_id", "source", F.col("_f.bucket").alias("upto"), F.coalesce("_f._to", F.lit(0)).alias("full_tokens"), F.coalesce("_f._texts", F.lit(0)).alias("full_texts"), F.col("_e.bucket").alias("edge"), F.col("_e._from").alias("_from"))
    plan = small_side(plan.join(met, ["mix_id", "source"], "left"))
    edges = plan.where("edge is not null").select("key", F.col("edge").alias("bucket"), "_from").distinct()
    rows = d.join(small_side(edges), ["key", "bucket"])
    inside = W.partitionBy("key", "bucket").orderBy("log", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return plan, rows.select("key", "bucket", "doc_id", "size", (F.col("_from") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("before"))


#: Whether the broken pass takes a text: while the prefix sum stays within half a text of the budget.
TAKEN = "2 * before + size <= 2 * part"


def mixed(docs: DataFrame, targets: DataFrame, weight: Column | None = None, seed: int = 7) -> DataFrame:
    """mix_id, source, doc_id, size, repeats: every text of every mix, with how often it is used."""
    d = sized(docs, weight, seed)
    plan, edge_rows = _ends(d, mix_plan(d, targets).where("passes > 0 or part > 0"))
    plan = plan.select("mix_id", "source", "key", "passes", "part", "upto", "edge")
    far = d.select("key", "doc_id", "size", "bucket").join(plan, "key").where("edge is null or bucket <> edge")
    far = far.select("mix_id", "source", "doc_id", "size", (F.col("passes") + F.coalesce(F.col("bucket") <= F.col("upto"), F.lit(False)).cast("bigint")).alias("repeats"))
    near = edge_rows.join(plan.withColumn("bucket", F.col("edge")), ["key", "bucket"])
    near = near.select("mix_id", "source", "doc_id", "size", (F.col("passes") + F.expr(TAKEN).cast("bigint")).alias("repeats"))
    return far.unionByName(near).where("repeats > 0")


def mix_report(docs: DataFrame, targets: DataFrame, weight: Column | None = None, seed: int = 7) -> DataFrame:
    """One row per row of targets: goal, actual tokens, texts, passes, actual share of its mix in permille, out_of_reach.
    Sums of whole passes and whole buckets are known already; only texts of the last buckets are looked at."""
    d = sized(docs, weight, seed)
    plan, edge_rows = _ends(d, mix_plan(d, targets))
    near = edge_rows.join(plan.select("mix_id", "source", "key", "passes", "part", F.col("edge").alias("bucket")), ["key", "bucket"]).where(TAKEN)
    near = near.groupBy("mix_id", "source").agg(F.sum("size").alias("_tokens"), F.count("*").alias("_texts"))
    r = plan.join(near, ["mix_id", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_tokens", "_texts", "full_tokens", "full_texts")})
    r = r.withColumn("actual_tokens", F.col("passes") * F.col("size") + F.col("full_tokens") + F.col("_tokens"))
    r = r.withColumn("texts", F.when(F.col("passes") > 0, F.col("texts")).otherwise(F.col("full_texts") + F.col("_texts")))
    share = F.round(1000 * F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(W.partitionBy("mix_id")), F.lit(0)), 3)
    return r.select("mix_id", "source", (F.col("goal") / 1_000_000).cast("double").alias("goal_tokens"), "actual_tokens", "texts", "passes", share.alias("actual_permille"), "out_of_reach")
