"""Rules that are a fixed run of tokens, all found in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Row:
    """Columns of the row at hand, made on use so that modules load without a session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


this = _Row()


def say(*parts) -> Column:
    """Text from literals and columns."""
    return F.concat(
        *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    )


def hits(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` once per rule whose condition holds, with ``hit`` naming the rule."""
    found = F.array_compact(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()])
    )
    return rows.withColumn("hit", F.explode(found))
