"""Reading numbers out of damaged tokens, and telling numeric series from categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.functions.let import let, let_all
from seriesmill.functions.values import SERIES, float_val, int_val, integer_text, number, stripped, text_val


def digit_share(tokens: Column) -> Column:
    """Digits (of any script) as a share of all characters of the joined tokens; 0 without characters."""
    joined = F.array_join(tokens, "")
    return F.coalesce(F.length(F.regexp_replace(joined, r"(?U)[^\d]", "")) / F.nullif(F.length(joined), F.lit(0)), F.lit(0.0))


def bare_number(token: Column) -> Column:
    """What is left of a damaged number: allowed characters only, one leading dash if there were several, one point, one
    exponent mark (the last between other characters), none at the end; '' if nothing readable is left."""

    def count(t: Column, pattern: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    def one_point(t: Column) -> Column:
        behind = F.regexp_replace(F.regexp_extract(t, r"(?s)^[^.]*\.(.*)$", 1), r"\.", "")
        return F.when(count(t, r"\.") > 1, F.concat(F.substring_index(t, ".", 1), F.lit("."), behind)).otherwise(t)

    def split_marks(inner: Column) -> Column:
        mark = F.when(F.contains(inner, F.lit("e")), "e").otherwise("E")
        joined = lambda p: F.concat(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ""), F.lit("e"), F.element_at(p, -1))
        return let(F.split(inner, mark), lambda p: F.when(F.size(p) > 1, joined(p)).otherwise(inner))

    def one_mark(t: Column) -> Column:
        return F.when(count(t, "[eE]") > 1, let(F.regexp_replace(t, "^[eE]+|[eE]+$", ""), split_marks)).otherwise(t)

    t = F.regexp_replace(token, r"[^0-9.\-eE]", "")
    t = let(t, lambda x: F.when(count(x, "-") > 1, F.concat(F.lit("-"), F.regexp_replace(x, "-", ""))).otherwise(x))
    t = F.regexp_replace(let(let(t, one_point), one_mark), "[eE]+$", "")
    return let(t, lambda x: F.when(x.isin("", "-", ".", "-."), "").otherwise(x))


def repaired(token: Column) -> Column:
    """The number a token stands for, as VAL: an integer if it has no point and reads as one, else a float; 0 if unreadable."""

    def second(whole: Column, rest: Column) -> Column:
        read = {"whole": whole, "empty": rest == "", "i": integer_text(rest), "f": number(rest)}
        return let_all(read, lambda r: F.when(r["empty"], int_val(F.lit("0"))).when(r["whole"] & r["i"].isNotNull(), int_val(r["i"])).when(r["f"].isNotNull(), float_val(r["f"])).otherwise(int_val(F.coalesce(r["i"], F.lit("0")))))

    def first(t: Column) -> Column:
        whole = ~F.contains(t, F.lit("."))
        tight = F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]", "")
        read = {"whole": whole, "v": let(tight, lambda s: F.when(whole, integer_text(s)).otherwise(F.when(number(s).isNotNull(), s)))}
        again = let(bare_number(t), lambda rest: second(whole, rest))
        return let_all(read, lambda r: F.when(r["v"].isNull(), again).when(r["whole"], int_val(r["v"])).otherwise(float_val(number(r["v"]))))

    return let(token, first)


def cleaned(tokens: Column, threshold: float = 0.5) -> Column:
    """A series of VAL: repaired numbers where digits make up at least the threshold, else trimmed texts."""
    texts = F.transform(tokens, lambda t: text_val(stripped(t)))
    return F.when(digit_share(tokens) >= threshold, F.transform(tokens, repaired)).otherwise(texts).cast(SERIES)
