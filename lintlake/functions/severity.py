"""Severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.model import SEVERITIES


def severity_rank(severity: Column | str) -> Column:
    """0 for critical up to 4 for info, -1 for anything else."""
    col = F.col(severity) if isinstance(severity, str) else severity
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.coalesce(F.array_position(order, col).cast("int") - 1, F.lit(-1))


def rank_of(level: str) -> int:
    """The rank of a level given by the caller; -1 when there is no such level."""
    return SEVERITIES.index(level) if level in SEVERITIES else -1


def at_or_above(severity: Column | str, level: str) -> Column:
    return severity_rank(severity) <= F.lit(rank_of(level))
