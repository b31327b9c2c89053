"""What travels with a run's figures: caveats, a report as text, a row of the comparison table.

A run is one row, small by nature: scores and counts are aggregated before they come here. Wording is ours; the codes name
the cases.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.sources.runlog import TABLE_COLUMNS, table_row


def caveats(composition: Mapping | None = None, mode: str = "full", sampling: Mapping | None = None, stderr: float = 0.0, oom: Mapping | None = None, holdout: Mapping | None = None) -> list[tuple[str, str]]:
    """(code, text) of all that limits how a run's score may be read, in a fixed order.

    composition is a row of scored_composition; sampling has n_selected, n_population and seed; oom n_recovered and
    n_unrecovered; holdout n_holdout, seed and whether the set was held out from the base model too."""
    out = []
    if holdout and holdout.get("held_out_from_finetune"):
        n, seed = holdout.get("n_holdout"), holdout.get("seed")
        if holdout.get("held_out_from_base_checkpoint"):
            out.append(("held_out", f"{n} images, held out from every training (seed {seed}): no leakage."))
        else:
            out.append(("partly_held_out", f"{n} images, held out from fine-tuning (seed {seed}) but perhaps not from the base model: compare models on this set, do not quote the score alone."))
    else:
        out.append(("leakage", "The base model may have been trained on these images; the score is optimistic."))
    if composition and composition["total"]:
        if not composition["distribution_applies"]:
            out.append(("extracted_only", "Only extracted charts were scored; no synthetic ones make it easier."))
        elif composition["extracted_fraction"] == 0:
            out.append(("generated_only", "Only generated charts were scored, which are far easier than real ones."))
        else:
            out.append(("mixed", f"{100 * composition['generated_fraction']:.0f}% of the instances are generated charts, which are easier; read the extracted slice first."))
    if sampling and sampling.get("n_selected", 0) < sampling.get("n_population", 0):
        out.append(("sampled", f"{sampling['n_selected']} of {sampling['n_population']} images (seed {sampling['seed']}); the score is within {1.96 * stderr:.4f} at 95%, clustered by image."))
    if mode == "donut_only":
        out.append(("donut_only", "Axis and marker stages did not run; not comparable with runs of the full pipeline."))
    if oom and oom.get("n_recovered"):
        out.append(("degraded", f"{oom['n_recovered']} images were read at a lower resolution for want of memory."))
    if oom and oom.get("n_unrecovered"):
        out.append(("unprocessed", f"{oom['n_unrecovered']} images fitted at no resolution and count as failures."))
    return out


def report(run: str, scores: Mapping, by_type: Sequence[Mapping] = (), taxonomy: Sequence[tuple[str, int]] = (), not_applicable: Sequence[str] = (), skipped: Mapping[str, str] | None = None, latency: Mapping[str, float] | None = None, warnings: Sequence[Mapping] = (), notes: Sequence[tuple[str, str]] = (), degraded: Sequence[Mapping] = (), most: int = 10) -> str:
    """A run's figures as text. by_type has chart_type, score and n_instances; taxonomy (category, n); degraded the images
    that ran out of memory, the first of which are named."""
    line = lambda k, v: f"  {k:<24} {v}"
    out = [f"run {run}", *(line("skipped stage", f"{k}: {v}") for k, v in (skipped or {}).items())]
    out += [line(k, f"{v:.4f}" if isinstance(v, float) else v) for k, v in scores.items()]
    out += ["by chart type", *(line(r["chart_type"], f"{r['score']:.4f} (n={r['n_instances']})") for r in sorted(by_type, key=lambda r: r["chart_type"]))]
    total = sum(n for _, n in taxonomy) or 1
    out += ["taxonomy", *(line(k, f"{n} ({100 * n / total:.1f}%)") for k, n in taxonomy if n)]
    if not_applicable:
        out.append(line("not applicable", ", ".join(not_applicable)))
    out += ["milliseconds an image", *(line(k, f"{v:.1f}") for k, v in (latency or {}).items())]
    if degraded:
        out += ["out of memory", *(line(d["image_id"], f"scale {d['scale']}" if d["recovered"] else "no scale fits") for d in degraded[:most])]
        out += [line("and", f"{len(degraded) - most} more")] if len(degraded) > most else []
    out += ["checks", *(line(w["level"], w["code"]) for w in warnings), "caveats", *(line(c, t) for c, t in notes)]
    return "\n".join(out)


def append_table(rows: DataFrame, folder: str) -> None:
    """Appends rows (columns named as in TABLE_COLUMNS, others are '?') to the comparison table; earlier rows stay."""
    cells = {c: F.col(f"`{c}`") for c in TABLE_COLUMNS if c in rows.columns}
    rows.select(table_row(cells).alias("value")).write.mode("append").text(f"{folder}/table")


def read_table(spark: SparkSession, folder: str) -> str:
    """The comparison table as Markdown: a header and a line per run that was appended, sorted."""
    lines = [r.value for r in spark.read.text(f"{folder}/table").orderBy("value").toLocalIterator()]
    bar = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([bar(TABLE_COLUMNS), bar(["---"] * len(TABLE_COLUMNS)), *lines])
