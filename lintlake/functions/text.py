"""Text helpers used by the rendered outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_html(col: Column) -> Column:
    # The five HTML replacements; the ampersand must go first.
    for raw, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#39;"),
    ):
        col = F.replace(col, F.lit(raw), F.lit(entity))
    return col


def format_category(col: Column) -> Column:
    """``code_structure`` -> ``Code Structure``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def truncate_left(col: Column, width: int) -> Column:
    """Keep the right end of a text that is longer than ``width``."""
    return F.when(
        F.length(col) > width, F.concat(F.lit("..."), F.right(col, F.lit(width - 3)))
    ).otherwise(col)


def percent(col: Column) -> Column:
    """0.85 -> ``85``."""
    return F.round(col * 100, 0).cast("int").cast("string")


def base_name(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), -1)


def extension(col: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(col, r"[^/](\.[^./]*)$", 1))
