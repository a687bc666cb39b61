"""Null handling, guarded division, and the predicates behind the checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekwatch.specs import Strata


def or_zero(name: str) -> Column:
    """The column with a missing value read as zero."""
    return F.coalesce(F.col(name), F.lit(0))


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``, null where ``den`` is zero (ANSI mode would raise)."""
    return num / F.nullif(den, F.lit(0))


def percent(part: Column, whole: Column, digits: int, empty: float | None = None) -> Column:
    """Share of ``whole`` in percent, ties rounded to even; ``empty`` when there is no whole."""
    share = F.bround(safe_div(part, whole) * 100, digits)
    return share if empty is None else F.coalesce(share, F.lit(empty))


def count_true(flag: str | Column) -> Column:
    """How many rows have the flag; null flags do not count, no rows give 0."""
    return F.count_if(F.col(flag) if isinstance(flag, str) else flag)


def any_true(flags: Iterable[str]) -> Column:
    """Three-valued OR: true if any flag is, else null if any flag is null."""
    return reduce(lambda acc, name: acc | F.col(name), flags, F.lit(False))


def strata_exceed(strata: Strata) -> Column:
    """The parts add up to more than the reported total."""
    parts = reduce(lambda a, b: a + b, (or_zero(c) for c in strata.parts))
    return parts > or_zero(strata.total)


def total_exceeds(bigger: str, smaller: str) -> Column:
    """``bigger > smaller`` with missing counts read as zero."""
    return or_zero(bigger) > or_zero(smaller)


def silent(cases: str, hosp: str, deaths: str) -> Column:
    """Cases were reported but neither admissions nor deaths."""
    return (or_zero(cases) > 0) & (or_zero(hosp) == 0) & (or_zero(deaths) == 0)


def quoted(name: str) -> str:
    """The column's name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def long_form(names: Sequence[str], label: str, value: str, prefix: str = "") -> Column:
    """One row per name: ``position``, the name as ``label``, and its column as ``value``.

    The column of a name is ``prefix + name``. For tables with one row, as a generator.
    """
    rows = ", ".join(
        f"{i}, '{n.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', {quoted(prefix + n)}"
        for i, n in enumerate(names)
    )
    return F.expr(f"stack({len(names)}, {rows}) as (position, {quoted(label)}, {quoted(value)})")
