"""Column functions on keys, numbers as text, and overrides ``lhs=rhs``.

Decimals are rounded from the exact binary value, as C does.  Spark's ``format_string`` rounds the shortest decimal form
instead, so these few go through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _shown(v: Column, show: Callable[[str | None], str]) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(show, na_action=None).astype(object)

    return run(v.cast("string"))


def format_number(v: Column, digits: int = 3) -> Column:
    """An integer if integral, else so many significant digits; ``?`` for null and NaN, other text unchanged."""

    def show(text: str | None) -> str:
        try:
            number = float("nan" if text is None else text)
        except ValueError:
            return text
        return "?" if number != number else str(int(number)) if number.is_integer() else f"{number:.{digits}g}"

    return _shown(v, show)


def _fixed(v: Column, digits: int, factor: float, end: str) -> Column:
    return _shown(v, lambda text: f"{factor * float('nan' if text is None else text):.{digits}f}{end}")


def format_decimal(v: Column, digits: int = 3) -> Column:
    """So many decimals; ``nan`` for null."""
    return _fixed(v, digits, 1.0, "")


def format_integer(v: Column) -> Column:
    """Rounded, halves to even, with ``_`` between thousands: 150_000."""
    return F.replace(F.format_number(F.rint(v), 0), F.lit(","), F.lit("_"))


def significant(v: Column, digits: int = 3) -> Column:
    """Rounded to significant digits, as a number."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 0.0).otherwise(F.round(v * scale) / scale)


def close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def sanitised_key(k: Column) -> Column:
    """Letters, digits, ``_ - . / : space`` and no others, 250 at most."""
    return F.substring(F.regexp_replace(k, r"[^A-Za-z0-9_\-./: ]", "_"), 1, 250)


def stringified(v: Column) -> Column:
    """Null as ``null``; at most 6000 characters."""
    return F.coalesce(F.substring(v, 1, 6000), F.lit("null"))


def normalised_number(v: Column) -> Column:
    """``1.50``, ``1.5`` and ``15e-1`` alike; other text unchanged."""
    d = v.try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.when(d == 0, "0").otherwise(plain)
    return F.coalesce(plain, v)


def slug(v: Column) -> Column:
    """Lower case, other than letters and digits to ``_``, ``value`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(v)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("value"))


def override_parts(o: Column) -> Column:
    """(negated, lhs, rhs, keys) of ``lhs=rhs`` or ``~lhs``; keys are the names under which a run may have logged it."""
    negated = o.startswith("~")
    lhs = F.when(negated, F.regexp_replace(o, "^~", "")).otherwise(F.split(o, "=", 2)[0])
    rhs = F.when(~negated, F.get(F.split(o, "=", 2), F.lit(1)))
    lhs = F.split(lhs, "=", 2)[0]
    keys = F.array_distinct(F.array(F.concat(F.lit("choice/"), F.replace(lhs, F.lit("@"), F.lit("_"))), F.replace(lhs, F.lit("."), F.lit("/")), lhs))
    return F.struct(negated.alias("negated"), lhs.alias("lhs"), rhs.alias("rhs"), keys.alias("keys"))


def root_of(part: Column) -> Column:
    """First segment before ``.`` or ``/``."""
    return F.regexp_extract(part, r"^([^./]*)", 1)


def is_logged(lhs: Column, roots: list[str]) -> Column:
    """Whether the root of ``lhs``, or of either side of its ``@``, is logged."""
    return F.arrays_overlap(F.transform(F.split(lhs, "@"), root_of), F.array(*[F.lit(r) for r in roots]))


def percent(v: Column, digits: int = 2) -> Column:
    """A share as ``12.34%``; ``nan%`` for null."""
    return _fixed(v, digits, 100.0, "%")


def bar(v: Column, width: int = 14) -> Column:
    """A bar of full and light blocks for a share, clipped to 0 to 1; blanks if it isn't finite."""
    n = F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))).otherwise(" " * width)


def listed(items: Column, most: int = 12) -> Column:
    """The entries of an array in a row, those beyond ``most`` as a count."""
    more = F.size(items) - most
    head = F.array_join(F.slice(items.cast("array<string>"), 1, most), ", ")
    return F.when(more > 0, F.concat(head, F.lit(", … (+"), more.cast("string"), F.lit(" more)"))).otherwise(head)
