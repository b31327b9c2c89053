"""Reading image ids and closed-vocabulary labels out of untidy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies.
SOURCES = ("generated", "extracted")
CHART_TYPES = ("line", "scatter", "dot", "vertical_bar", "horizontal_bar")

#: Twelve hexadecimal digits, bare or behind any directory, before an axis or an extension.
IMAGE_ID = r"(?U)^\s*(?:[^\r\n]*[/\\])?([0-9a-f]{12})(?:_[xy])?(?:\.[^/\\\s]*)?\s*$"


def image_key(text: Column) -> Column:
    """The image named by a text, in lower case; null if it names none (null, empty or any other text)."""
    return F.nullif(F.regexp_extract(F.lower(text), IMAGE_ID, 1), F.lit(""))


def letters(text: Column) -> Column:
    """Letters only, lower case; what labels are compared by."""
    return F.regexp_replace(F.lower(text), r"\P{L}+", "")


def label(text: Column, vocabulary: tuple[str, ...]) -> Column:
    """The vocabulary's word with the same letters; null for anything else."""
    bare, out = letters(text), F.lit(None).cast("string")
    for word in vocabulary:
        out = F.when(bare == "".join(filter(str.isalpha, word)), F.lit(word)).otherwise(out)
    return out


def squeezed(text: Column) -> Column:
    """Lower case without blanks around, Unicode blanks included."""
    return F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
