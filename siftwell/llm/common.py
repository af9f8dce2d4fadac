"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009..U+000D.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for a null text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WORD_BREAKS, " " * len(WORD_BREAKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (an array lambda binds it)."""
    return F.transform(F.array(value), body)[0]


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only; the same in any SQL engine with md5."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def free_name(columns: list[str], base: str) -> str:
    """``base``, led by as many underscores as make it none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def join_bounded(left: DataFrame, right: DataFrame, on, how: str, rows: int, bound: int) -> DataFrame:
    """Join with ``right``, broadcast only when its counted ``rows`` stay within ``bound``."""
    return left.join(F.broadcast(right) if rows <= bound else right, on, how)
