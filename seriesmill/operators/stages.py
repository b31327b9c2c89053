"""Model stages behind a contract. A stage is a function on a batch of images; any runtime can stand behind it.

Models are loaded once per worker by the stage's own factory, in Arrow batches through mapInPandas. When a batch does not
fit into memory, its images are tried one by one, then at smaller scales; what fits nowhere is a failed row, not a failed
task. Which images were degraded comes out as a column, because such rows are not comparable with the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

# Stages and what each needs, retry scales.
REQUIREMENTS = {"donut": ("donut_dir",), "axis": ("x_axis_model", "y_axis_model"), "markers": ("marker_model",)}
RETRY_SCALES = (0.75, 0.5)
OUT_OF_MEMORY = "oom"


class DoesNotFit(Exception):
    """Raised by a stage for a batch that does not fit into memory."""


def run_generation(images: DataFrame, factory: Callable[[], Callable[[Sequence[str], Sequence[bytes], float], list[str]]], batch: int = 8, scales: Sequence[float] = RETRY_SCALES) -> DataFrame:
    """images (image_id, content) to image_id, raw, failure_mode, scale, recovered.

    factory() gives generate(ids, contents, scale), which returns one raw sequence per image and may raise DoesNotFit;
    any other exception fails the batch's images with generation_error. scale is 1.0 unless an image was retried lower;
    recovered is null for images that never ran out of memory."""
    tried = tuple(scales)

    def stage(frames: Iterator) -> Iterator:
        import pandas as pd

        generate = factory()

        def attempt(ids, contents, scale):
            try:
                return list(generate(ids, contents, scale)), None
            except DoesNotFit:
                return None, OUT_OF_MEMORY
            except Exception:
                return None, "generation_error"

        for frame in frames:
            rows = []
            for at in range(0, len(frame), batch):
                ids, contents = list(frame["image_id"][at : at + batch]), list(frame["content"][at : at + batch])
                raw, why = attempt(ids, contents, 1.0)
                if why is None:
                    rows += [(i, r, None, 1.0, None) for i, r in zip(ids, raw)]
                    continue
                if why != OUT_OF_MEMORY:
                    rows += [(i, "", why, 1.0, None) for i in ids]
                    continue
                for i, c in zip(ids, contents):
                    raw, why_one = attempt([i], [c], 1.0)
                    scale, recovered = 1.0, None
                    if why_one == OUT_OF_MEMORY:
                        # Any error at a lower scale is a failed attempt; the next scale may still do.
                        scale, recovered = None, False
                        for s in tried:
                            raw, failed = attempt([i], [c], s)
                            if failed is None:
                                scale, recovered, why_one = s, True, None
                                break
                    rows.append((i, raw[0] if why_one is None else "", why_one, scale, recovered))
            yield pd.DataFrame(rows, columns=["image_id", "raw", "failure_mode", "scale", "recovered"]).astype({"scale": "float64", "recovered": "object"})

    return images.select("image_id", "content").mapInPandas(stage, "image_id string, raw string, failure_mode string, scale double, recovered boolean")


def run_detector(images: DataFrame, factory: Callable[[], Callable[[object], object]], schema: str) -> DataFrame:
    """images (image_id, content) through a detector: factory() gives a function from one pandas batch to one of schema."""

    def stage(frames: Iterator) -> Iterator:
        detect = factory()
        for frame in frames:
            yield detect(frame)

    return images.select("image_id", "content").mapInPandas(stage, schema)


def apply_generation_failures(preds: DataFrame, generated: DataFrame) -> DataFrame:
    """Predictions whose generation failed take the stage's failure instead of the parser's."""
    from pyspark.sql import functions as F

    g = generated.select("image_id", F.col("failure_mode").alias("_g"))
    return preds.join(g, "image_id", "left").withColumn("failure_mode", F.coalesce("_g", "failure_mode")).drop("_g")


@dataclass(frozen=True)
class Availability:
    """Which stages can run, and why the others cannot."""

    missing: dict[str, str]

    @property
    def run(self) -> tuple[str, ...]:
        return tuple(s for s in REQUIREMENTS if s not in self.missing)

    @property
    def mode(self) -> str:
        return "full" if {"axis", "markers"} <= set(self.run) else "donut_only"


def availability(paths: dict[str, str | None], exists: Callable[[str], bool]) -> Availability:
    missing = {}
    for stage, names in REQUIREMENTS.items():
        for n in names:
            p = paths.get(n)
            if p is None or not exists(p):
                missing[stage] = f"{n} not configured" if p is None else f"{n} not on disk ({p})"
                break
    return Availability(missing)


def resolve_mode(requested: str, have: Availability) -> str:
    """auto takes the richest mode there is; full is an error, not a downgrade, without its stages; nothing runs without donut."""
    if requested not in ("auto", "full", "donut_only"):
        raise ValueError(f"unknown mode {requested!r}")
    if "donut" in have.missing:
        raise ValueError(f"no mode can run: {have.missing['donut']}")
    if requested == "full" and have.mode != "full":
        raise ValueError("full mode lacks " + "; ".join(f"{k}: {v}" for k, v in have.missing.items()))
    return have.mode if requested == "auto" else requested
