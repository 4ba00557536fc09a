"""The findings record, its closed vocabularies and the shared row builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severity order, effort labels and categories of a finding.
SEVERITIES = ("critical", "high", "medium", "low", "info")
EFFORTS = ("minutes", "hours", "days", "weeks")
CATEGORIES = (
    "code_structure",
    "security",
    "dependencies",
    "test_quality",
    "concurrency",
    "api_design",
    "documentation",
)

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("repo", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("antipattern", T.StringType(), False),
        T.StructField("antipattern_name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("confidence", T.DoubleType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("line_start", T.IntegerType(), False),
        T.StructField("line_end", T.IntegerType(), False),
        T.StructField("column", T.IntegerType(), True),
        T.StructField("language", T.StringType(), False),
        T.StructField("language_pack", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("remediation", T.StringType(), False),
        T.StructField("effort", T.StringType(), False),
        T.StructField("tool", T.StringType(), False),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("code_snippet", T.StringType(), True),
        T.StructField("references", T.ArrayType(T.StringType()), True),
        T.StructField("tags", T.ArrayType(T.StringType()), True),
        T.StructField("detected_at", T.TimestampType(), False),
    ]
)
FINDING_COLUMNS = [f.name for f in FINDING_SCHEMA]
REQUIRED_COLUMNS = [f.name for f in FINDING_SCHEMA if not f.nullable]

SOURCE_SCHEMA = "repo string, path string, ext string, content string"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def string_list(values) -> Column:
    """A literal array<string>, also for no values at all."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def finding_id(*parts) -> Column:
    """Nine characters that are the same on every replay of the same input."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 9)


def build_findings(df: DataFrame, *, ordinal, **fields) -> DataFrame:
    """Project ``df`` (which has ``repo``) onto the findings schema.

    ``fields`` gives a column or a plain value for every finding field but
    ``repo`` and ``id``; ``ordinal`` tells apart findings of one rule on one line.
    """
    values = {
        "column": F.lit(None),
        "code_snippet": F.lit(None),
        "references": string_list(()),
        "tags": string_list(()),
        "detected_at": F.current_timestamp(),
    }
    values.update({k: as_column(v) for k, v in fields.items()})
    values["repo"] = F.col("repo")
    values["id"] = finding_id(
        F.col("repo"),
        values["file"],
        values["rule_id"],
        values["line_start"].cast("string"),
        as_column(ordinal).cast("string"),
    )
    return df.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in FINDING_SCHEMA]
    )
