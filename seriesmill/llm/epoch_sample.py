"""A sample that stays the same in reruns and keeps what it took while records arrive.

A record's epoch is the draw at which it was first seen, and the rate of that draw is frozen with it in a ledger (id,
epoch, rate). A counter-based generator keyed by the id gives a number in [0, 1); the record is in the sample while its
number is below its own rate. Neither other records nor partitioning enter into it, and later draws, whatever their
rates, add records but never remove one. What earlier draws took by another rule is carried with rate 1.

A stored ledger is a folder of Parquet files to which every draw appends what is new, so rows are never rewritten. An
image that a later pick carries gets a second row; of an id's rows the least epoch and the largest rate count. Without
a stored ledger the epochs of the past are read off the picks, once.

Defined results: null ids are no records; an id counts once, with its earliest epoch; empty tables give an empty sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.bounded import collect_bounded
from seriesmill.functions.labels import image_key


def unit(key: Column, seed: int, counter: int = 0) -> Column:
    """Number counter of the stream that belongs to key: 52 bits of MD5 over seed, counter and key, in [0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{counter}:"), key.cast("string"))), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def extend_ledger(ledger: DataFrame | None, arrived: DataFrame, key: str, epoch: int, rate: float) -> DataFrame:
    """The ledger with the ids of arrived that it lacks, under this epoch and rate; older rows stay as they are."""
    new = arrived.where(F.col(key).isNotNull()).select(key).distinct()
    if ledger is not None:
        new = new.join(ledger.select(key), key, "left_anti")
    new = new.select(key, F.lit(epoch).alias("epoch"), F.lit(float(rate)).alias("rate"))
    return new if ledger is None else ledger.select(key, "epoch", "rate").unionByName(new)


def selected(ledger: DataFrame, key: str, seed: int) -> DataFrame:
    """The ledger's rows that are in the sample."""
    return ledger.where(unit(F.col(key), seed) < F.col("rate"))


def epoch_of(seen: Column, draws: Sequence[tuple[int, object, float]]) -> tuple[Column, Column]:
    """Epoch and rate of a time: those of the first draw not before it; beyond the last, or null, the next epoch at the last rate."""
    last = (draws[-1][0] + 1, draws[-1][2]) if draws else (1, 0.0)
    epoch, rate = F.lit(last[0]), F.lit(float(last[1]))
    for n, at, r in reversed(draws):
        epoch, rate = F.when(seen <= F.lit(at), F.lit(n)).otherwise(epoch), F.when(seen <= F.lit(at), F.lit(float(r))).otherwise(rate)
    return epoch, rate


LEDGER = "image_id string, epoch int, rate double, carried boolean"


def stored_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """image_id, epoch, rate, carried of a ledger's folder, a row per id; None if nothing was stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(LEDGER).parquet(folder)
    return rows.groupBy("image_id").agg(F.min("epoch").alias("epoch"), F.max("rate").alias("rate"), F.bool_or("carried").alias("carried"))


def image_sample(image_refs: DataFrame, annotations: DataFrame, picks: DataFrame, rate: float = 0.1, seed: int = 7, max_draws: int = 1000, ledger: str | None = None) -> DataFrame:
    """image_id, epoch, rate, carried of the sample from images that both tables name.

    ledger is the folder of the stored ledger. What it holds keeps its epoch and rate, and its place in the sample,
    even if its deliveries are gone; images it lacks enter through extend_ledger under the next epoch and this rate,
    and are stored. If it is empty, or none is given, an image is first seen when both tables hold it (loaded_at), and
    draws are those of picks, at their earliest time. Images in picks are carried under the first draw that took them.
    The three tables' ids are united behind flags and pre-aggregated in one shuffle."""
    draws = collect_bounded(picks.where("draw_no is not null").groupBy("draw_no").agg(F.min("picked_at").alias("at")).where("at is not null"), max_draws, "draws")
    draws = [(r.draw_no, r["at"], rate) for r in sorted(draws, key=lambda r: r["at"])]
    none = F.lit(None)
    tables = [
        image_refs.select(image_key(F.coalesce("image_id", "path")).alias("image_id"), F.col("loaded_at").alias("_r"), none.cast("timestamp").alias("_a"), none.cast("int").alias("_p"), F.lit(1).alias("_k")),
        annotations.select(image_key(F.col("image_id")).alias("image_id"), none.cast("timestamp").alias("_r"), F.col("loaded_at").alias("_a"), none.cast("int").alias("_p"), F.lit(2).alias("_k")),
        picks.select(image_key(F.col("image_id")).alias("image_id"), none.cast("timestamp").alias("_r"), none.cast("timestamp").alias("_a"), F.coalesce("draw_no", F.lit(0)).alias("_p"), F.lit(4).alias("_k")),
    ]
    ids = tables[0].unionByName(tables[1]).unionByName(tables[2]).where("image_id is not null")
    ids = ids.groupBy("image_id").agg(F.min("_r").alias("_r"), F.min("_a").alias("_a"), F.min("_p").alias("_p"), F.bit_or("_k").alias("_k"))
    spark, picked, ids = picks.sparkSession, ids.where("_p is not null").select("image_id", "_p"), ids.where("_k & 3 = 3")
    known = stored_ledger(spark, ledger) if ledger else None
    last = known.agg(F.max("epoch")).first()[0] if known is not None else None
    if last is None:
        epoch, frozen = epoch_of(F.greatest("_r", "_a"), draws)
        new = ids.select("image_id", F.coalesce("_p", epoch).alias("epoch"), F.when(F.col("_p").isNotNull(), 1.0).otherwise(frozen).alias("rate"), F.col("_p").isNotNull().alias("carried"))
        if not ledger:
            return selected(new, "image_id", seed)
    else:
        whole = extend_ledger(known, ids, "image_id", max([last, *(n for n, _, _ in draws)]) + 1, rate)
        was = known.select("image_id", F.col("carried").alias("_was"))
        whole = whole.join(was, "image_id", "left").join(picked, "image_id", "left")
        changed = whole.where("_was is null or (not _was and _p is not null)")
        taken = F.col("_p").isNotNull()
        new = changed.select("image_id", F.when(F.col("_was").isNull(), F.coalesce("_p", "epoch")).otherwise(F.col("epoch")).alias("epoch"), F.when(taken, 1.0).otherwise(F.col("rate")).alias("rate"), taken.alias("carried"))
    new.select("image_id", F.col("epoch").cast("int").alias("epoch"), "rate", "carried").write.mode("append").parquet(ledger)
    return selected(stored_ledger(spark, ledger), "image_id", seed)
