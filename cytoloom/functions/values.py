"""Value policies that all operators share: missing values, groups, votes, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as missing in a vote, and as blank in a label.
NULLISH = ("nan", "NaN", "None", "<NA>", "NA", "")
BLANK = ("", "nan", "none", "unassigned")
#: Scales a median absolute deviation to a normal standard deviation.
MAD_SCALE = 1.482602218505602


def as_group(c: Column) -> Column:
    """The value as a group's name; a missing one is the group "nan"."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def as_vote(c: Column) -> Column:
    """The value as a vote; missing values abstain (null)."""
    s = c.cast("string")
    return F.when(~s.isin(*NULLISH), s)


def finite(c: Column) -> Column:
    """Null instead of NaN and infinities, so that aggregates leave them out."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def non_blank(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*BLANK), F.trim(c))


def median(c: Column) -> Column:
    return F.percentile(finite(c), F.lit(0.5))


def starts_with_any(symbol: Column, prefixes: Sequence[str]) -> Column:
    """Case-insensitive test for gene families, such as mitochondrial or ribosomal symbols."""
    up = F.upper(symbol)
    return F.coalesce(F.lit(False) if not prefixes else _any([up.startswith(p.upper()) for p in prefixes]), F.lit(False))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def resolve_key(columns: Sequence[str], given: str | None, candidates: Sequence[str]) -> str | None:
    """The column to group by: the given one if it is there, else the first candidate that is."""
    if given is not None:
        return given if given in columns else None
    return next((c for c in candidates if c in columns), None)

