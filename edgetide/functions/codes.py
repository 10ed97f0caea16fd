"""Small scalar encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgetide.schema import SID_CLASSES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def principal_class(principal) -> Column:
    """Class of an account name; the first of the listed markers wins."""
    principal = _col(principal)
    return (
        F.when(principal.contains("AUTHORITY"), 1)
        .when(principal.contains("SYSTEMIA"), 2)
        .when(principal.contains("Window Manager"), 3)
        .when(principal.contains("Font Driver Host"), 4)
        .otherwise(5)
    )


def sid_histogram(sid) -> Column:
    """Aggregate: counts per well-known SID class (substring test), then all others."""
    sid = _col(sid)
    hits = [F.sum(F.coalesce(sid.contains(f"S-1-5-{c}").cast("long"), F.lit(0))) for c in SID_CLASSES]
    matched = hits[0]
    for h in hits[1:]:
        matched = matched + h
    return F.array(*hits, F.count("*") - matched)


def parent_child_user(parent, child) -> Column:
    r"""Aggregate: counts of (parent, child) image paths inside/outside ``\Users\``."""
    up = F.coalesce(_col(parent).contains("\\Users\\"), F.lit(False))
    uc = F.coalesce(_col(child).contains("\\Users\\"), F.lit(False))
    return F.array(*[F.sum(c.cast("long")) for c in (up & uc, up & ~uc, ~up & uc, ~up & ~uc)])


def edge_code(u, i, multiplier: int) -> Column:
    """u * multiplier + i, which ``edge_decode`` reverses; ids for which it could not (i outside [0, multiplier), u negative or
    so large that the code leaves the range of a long) are an error, as two edges would share a code."""
    u, i = _col(u).cast("long"), _col(i).cast("long")
    fits = (i >= 0) & (i < multiplier) & (u >= 0) & (u <= ((1 << 63) - multiplier) // multiplier)
    code = u * F.lit(multiplier).cast("long") + i
    return F.when(fits, code).when(u.isNotNull() & i.isNotNull(), F.raise_error(F.lit("ids do not fit the edge code")).cast("long"))


def edge_decode(code, multiplier: int) -> tuple[Column, Column]:
    code = _col(code)
    return ((code - F.pmod(code, F.lit(multiplier))) / F.lit(multiplier)).cast("long"), F.pmod(code, F.lit(multiplier))


def sigmoid(logit, temperature: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(logit) / F.lit(temperature)))
