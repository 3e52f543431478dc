"""Text normalisation and the small value rules used all over.

``length`` counts code points throughout. ``SPACE`` is Unicode white space with U+FEFF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{FEFF}]"
_U = "(?U)"
CJK = r"[\x{3400}-\x{9FFF}]"


def squeeze(c: Column) -> Column:
    """Each run of white space one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{_U}{SPACE}+", " "))


def without_space(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"{_U}{SPACE}+", "")


def strip(c: Column) -> Column:
    """No white space at the ends; inside it stays as it is."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"{_U}^{SPACE}+|{SPACE}+$", "")


def normalize_text(c: Column) -> Column:
    """NUL dropped, no white space between two CJK characters, the rest squeezed."""
    plain = F.translate(F.coalesce(c, F.lit("")), "\x00", "")
    return squeeze(F.regexp_replace(plain, f"{_U}(?<={CJK}){SPACE}+(?={CJK})", ""))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(strip(c)) > 0, c)


def falsy_coalesce(*columns: Column) -> Column:
    """The first that is neither null nor empty nor zero nor NaN."""
    return F.coalesce(*[F.when(c.isNotNull() & ~c.cast("string").isin("", "0", "0.0", "NaN", "false"), c) for c in columns])


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5), also below zero."""
    return F.floor(c + 0.5)


def clamp(c: Column, low, high) -> Column:
    """Between two bounds; null stays null."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(c.isNotNull(), F.greatest(low, F.least(high, c)))


def number_or(c: Column, default) -> Column:
    """A number from anything; missing, zero and what is no number give the default."""
    n = c.cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (n == 0), F.lit(default)).otherwise(n)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def position(text: Column, part: Column) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.position(part, text) - 1
