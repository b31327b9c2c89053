"""Filling containers of fixed capacity, bulk-synchronous best fit.

Sizes are whole tokens, so texts and gaps, sorted by size, are runs of equal values: at most one run per token of
capacity, however many texts there are. A text's rank within its run is found by a distributed sort (runs are salted:
one may hold any part of all texts). A round sweeps the two sorted sequences from large to small; every text takes the
smallest free gap that holds it, which is a stack of gap runs, and conflicts between equal texts are settled by rank.
Gaps are updated, texts for which no gap can ever do open new containers, and the next round begins. Only runs are swept
(on the driver, bounded by the capacities); every text then finds its container by its rank, going back through the
rounds' tables, in parallel and without another shuffle.

A text larger than the capacity is cut into full containers and a rest; nothing else is cut. A round may put several small
equal texts into one gap at once, at most half of it, which bounds the number of rounds.

Defined results: null and empty texts have no tokens and no container (container_id null, one row); equal sizes are told
apart by id; a capacity that is null or below 1 is an error; repeated rows are texts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.functions.bounded import collect_bounded
from seriesmill.session import checkpointed

#: Bits for ranks in a run, below the bits for the size.
SHIFT = 40


def sweep_rounds(runs: dict[int, int], capacity: int) -> tuple[list[tuple], list[list[tuple]], int]:
    """Best fit over runs (size: texts). Returns
    events (size, first rank, round, gap, first place among the gap's containers, texts a container),
    moves: for each round, where its containers were before: (gap, first place, gap before, first place before, containers);
    the number of containers. A gap of -1 stands for new containers, numbered on."""
    left, used, gaps, opened = dict(runs), dict.fromkeys(runs, 0), {}, 0
    events: list[tuple] = []
    moves: list[list[tuple]] = [[]]
    while any(left.values()):
        n_round, segments, stack = len(moves) - 1, [], []
        waiting = sorted(gaps.items())
        for size in sorted((s for s, n in left.items() if n), reverse=True):
            while waiting and waiting[-1][0] >= size:
                stack.append([*waiting.pop(), 0])
            while left[size] and stack:
                gap, count, taken = stack[-1]
                each = min(left[size], max(1, gap // (2 * size)))
                n = min(count - taken, left[size] // each)
                events.append((size, used[size], n_round, gap, taken, each))
                segments.append((gap - each * size, gap, taken, n))
                used[size] += n * each
                left[size] -= n * each
                stack[-1][2] += n
                if stack[-1][2] == count:
                    stack.pop()
        segments += [(gap, gap, taken, count - taken) for gap, count, taken in stack] + [(gap, gap, 0, count) for gap, count in waiting]
        widest = max((s[0] for s in segments), default=0)
        alone = sorted((s for s, n in left.items() if n and s > widest), reverse=True)
        fresh = max(-(-sum(s * left[s] for s in alone) // capacity), sum(left[s] for s in alone if 2 * s > capacity))
        for size in alone:
            n = min(fresh, left[size])
            if n:
                events.append((size, used[size], n_round, -1, opened, 1))
                segments.append((capacity - size, -1, opened, n))
                used[size] += n
                left[size] -= n
                fresh -= n
                opened += n
        least, gaps, table = min((s for s, n in left.items() if n), default=capacity + 1), {}, []
        for gap, before, place, n in segments:
            if gap >= least:  # the others are closed
                table.append((gap, gaps.get(gap, 0), before, place, n))
                gaps[gap] = gaps.get(gap, 0) + n
        moves.append(table)
    return events, moves, opened


def _tables(events: list[tuple], moves: list[list[tuple]]) -> tuple:
    """Sorted arrays, a sixth of the tuples' memory, built once instead of in every task."""
    import numpy as np

    return np.array(sorted(events), dtype=np.int64).reshape(-1, 6), [np.array(sorted(m), dtype=np.int64).reshape(-1, 5) for m in moves]


def pack(docs: DataFrame, specs: DataFrame, salts: int = 256, max_specs: int = 1000, max_runs: int = 1 << 22) -> DataFrame:
    """spec_id, container_id, doc_id, piece_no, tok_start, tok_end: one row per piece."""
    spark = docs.sparkSession
    caps = sorted((r.spec_id, r.capacity_tokens) for r in collect_bounded(specs.select("spec_id", "capacity_tokens").distinct(), max_specs, "specs"))
    if any(c is None or c < 1 for _, c in caps) or sum(c for _, c in caps) > max_runs:
        raise ValueError(f"capacities must be 1 or more, {max_runs} in all at most")
    spec = F.explode(F.array(*(F.struct(F.lit(i).alias("spec"), F.lit(s).alias("spec_id"), F.lit(c).cast("bigint").alias("cap")) for i, (s, c) in enumerate(caps)))) if caps else None
    if spec is None:
        return docs.limit(0).select(F.lit("").alias("spec_id"), F.lit("").alias("container_id"), "doc_id", F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("tok_start"), F.lit(0).cast("bigint").alias("tok_end"))
    sizes = checkpointed(docs.select("doc_id", F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0)).alias("size")))  # texts are read once
    d = sizes.select("doc_id", "size", spec.alias("_s")).select("_s.*", "doc_id", "size")
    d = d.withColumn("full", F.when(F.col("size") > F.col("cap"), F.expr("size div cap")).otherwise(F.lit(0).cast("bigint"))).withColumn("rest", F.expr("size - full * cap"))
    d = d.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = d.groupBy("spec", "rest", "_salt").agg(F.count("*").alias("_n"))
    offsets = counts.select("spec", "rest", "_salt", (F.sum("_n").over(W.partitionBy("spec", "rest").orderBy("_salt")) - F.col("_n")).alias("_off"))
    ranked = d.withColumn("_r", F.row_number().over(W.partitionBy("spec", "rest", "_salt").orderBy("doc_id", "size"))).join(offsets, ["spec", "rest", "_salt"])
    ranked = ranked.select("spec", "spec_id", "cap", "doc_id", "full", "rest", (F.col("_off") + F.col("_r") - 1).alias("rank"))

    runs: list[dict[int, int]] = [{} for _ in caps]
    for r in collect_bounded(d.where("rest > 0").groupBy("spec", "rest").agg(F.count("*").alias("n")), max_runs, "runs"):
        runs[r.spec][r.rest] = r.n
    plan = spark.sparkContext.broadcast([_tables(*sweep_rounds(runs[i], c)[:2]) for i, (_, c) in enumerate(caps)])  # rounds x runs at most, 48 bytes each

    def place(batches: Iterator) -> Iterator:  # nested, so that executors need no copy of this package
        import numpy as np

        tables = [(e, (e[:, 0] << SHIFT) | e[:, 1], ms, [(m[:, 0] << SHIFT) | m[:, 1] for m in ms]) for e, ms in plan.value]
        for pdf in batches:
            out = np.full(len(pdf), -1, dtype=np.int64)
            specs_, rests, ranks = (pdf[c].to_numpy(dtype=np.int64) for c in ("spec", "rest", "rank"))
            for i, (e, keys, ms, mkeys) in enumerate(tables):
                at = np.flatnonzero((specs_ == i) & (rests > 0))
                if not len(at):
                    continue
                ev = e[np.searchsorted(keys, (rests[at] << SHIFT) | ranks[at], side="right") - 1]
                rnd, gap, pos = ev[:, 2].copy(), ev[:, 3].copy(), ev[:, 4] + (ranks[at] - ev[:, 1]) // ev[:, 5]
                for r in range(len(ms) - 1, -1, -1):
                    on = np.flatnonzero((rnd == r) & (gap >= 0))
                    if len(on):
                        k = np.searchsorted(mkeys[r], (gap[on] << SHIFT) | pos[on], side="right") - 1
                        m = ms[r][k]
                        pos[on] = m[:, 3] + pos[on] - m[:, 1]
                        gap[on], rnd[on] = m[:, 2], r - 1
                out[at] = pos
            yield pdf.assign(bin=out)

    placed = ranked.mapInPandas(place, ranked.select("*", F.lit(0).cast("bigint").alias("bin")).schema)
    last = F.expr("greatest(full - if(rest = 0, 1, 0), 0)")
    pieces = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    whole = F.col("piece_no") < F.col("full")
    name = F.when(whole, F.concat_ws(":", F.lit("cut"), "rest", "rank", "piece_no")).when(F.col("rest") > 0, F.concat(F.lit("mix:"), F.col("bin").cast("string")))
    start = F.col("piece_no") * F.col("cap")
    return pieces.select("spec_id", name.alias("container_id"), "doc_id", "piece_no", start.alias("tok_start"), (start + F.when(whole, F.col("cap")).otherwise(F.col("rest"))).alias("tok_end"))


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, documents cut, and the share of room left unused in permille."""
    used = packed.groupBy("spec_id", "container_id").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("_n"), F.count_if(F.col("piece_no") == 1).alias("_cut"))
    used = used.groupBy("spec_id").agg(F.count("container_id").alias("containers"), F.sum("_n").alias("tokens"), F.sum("_cut").alias("documents_cut"))
    room = F.col("containers") * F.col("capacity_tokens")
    return used.join(specs.distinct(), "spec_id").select("spec_id", "containers", "tokens", "documents_cut", F.round(1000 * (1 - F.col("tokens") / room), 3).alias("unused_permille"))
