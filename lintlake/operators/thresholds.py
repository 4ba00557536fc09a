"""Per-repository thresholds in three layers: built-in, language pack, repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Built-in thresholds.
BUILT_IN = {
    ("code_structure", "max_cyclomatic_complexity"): "10",
    ("code_structure", "max_function_length"): "50",
    ("code_structure", "max_nesting_depth"): "4",
    ("code_structure", "god_class_method_count"): "20",
    ("code_structure", "god_class_total_lines"): "500",
    ("code_structure", "magic_number_allowed"): "[0, 1, -1, 2, 100]",
    ("test_quality", "min_coverage_percent"): "50",
    ("test_quality", "max_mock_calls"): "5",
    ("security", "bandit_severity_level"): "medium",
}
# What each language pack sets on top.
PACK_LAYER = {
    "python": {},
    "typescript": {("code_structure", "god_class_method_count"): "15"},
    "javascript": {("code_structure", "god_class_method_count"): "15"},
    "go": {
        ("code_structure", "max_nesting_depth"): "5",
        ("code_structure", "god_struct_method_count"): "15",
        ("code_structure", "max_interface_methods"): "5",
    },
}
SECTIONS = ("code_structure", "test_quality", "security")


def defaults(language: str) -> dict[str, str]:
    """Thresholds of a pack without any repository override, by key."""
    merged = {**BUILT_IN, **PACK_LAYER.get(language, {})}
    return {key: value for (_, key), value in merged.items()}


def number(limits: dict, key: str) -> float:
    return float(limits[key])


def numbers(limits: dict, key: str) -> list[float]:
    return [float(v) for v in str(limits[key]).strip("[]").split(",") if v.strip()]


def layer_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The built-in and the pack layer as long tables of fixed size."""
    schema = "language string, section string, key string, value string"
    base = [(lang, s, k, v) for lang in PACK_LAYER for (s, k), v in BUILT_IN.items()]
    pack = [(lang, s, k, v) for lang, kv in PACK_LAYER.items() for (s, k), v in kv.items()]
    return spark.createDataFrame(base, schema), spark.createDataFrame(pack, schema)


def parse_overrides(df: DataFrame) -> DataFrame:
    """``(repo, content)`` override texts -> ``(repo, section, key, value, line)``.

    A line that is not indented and ends in a colon opens a section; later lines of
    the form ``key: value`` belong to it. Dashes in keys become underscores; of equal
    keys in one file the last one counts.
    """
    lines = df.select(
        "repo", F.posexplode(F.split("content", "\n")).alias("line", "raw")
    ).withColumn("text", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    kept = lines.filter((F.col("text") != "") & ~F.col("text").startswith("#"))
    header = ~F.col("raw").rlike(r"^[ \t]") & F.col("text").endswith(":")
    upto = (
        Window.partitionBy("repo")
        .orderBy("line")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    marked = kept.select(
        "repo",
        "line",
        "text",
        header.alias("header"),
        F.last(F.when(header, F.regexp_replace("text", ":$", "")), ignorenulls=True)
        .over(upto)
        .alias("section"),
    )
    pair = r"^([\w-]+):\s*(.+)$"
    rows = marked.filter(
        ~F.col("header") & (F.col("section") != "") & F.col("text").rlike(pair)
    ).select(
        "repo",
        "section",
        F.regexp_replace(F.regexp_extract("text", pair, 1), "-", "_").alias("key"),
        F.trim(F.regexp_extract("text", pair, 2)).alias("value"),
        "line",
    )
    return rows.groupBy("repo", "section", "key").agg(
        F.max_by("value", "line").alias("value"), F.max("line").cast("int").alias("line")
    )


def value_type(value: Column) -> Column:
    """``list``, ``number``, ``boolean`` or ``text``, by the look of a value."""
    return (
        F.when(value.startswith("[") & value.endswith("]"), "list")
        .when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .when(value.isin("true", "false"), "boolean")
        .otherwise("text")
    )


def resolve_thresholds(
    repos: DataFrame, built_in: DataFrame, pack: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Effective value of every key per ``(repo, language)``; the later layer wins.

    ``repos`` has ``(repo, language)``. Sections nobody knows are dropped; unknown keys
    of known sections are kept.
    """
    wide = repos.select("repo", "language").distinct()
    layers = (
        wide.join(F.broadcast(built_in), "language")
        .withColumn("layer", F.lit(0))
        .unionByName(wide.join(F.broadcast(pack), "language").withColumn("layer", F.lit(1)))
        .unionByName(
            overrides.filter(F.col("section").isin(*SECTIONS))
            .select("repo", "section", "key", "value")
            .join(wide, "repo")
            .withColumn("layer", F.lit(2))
        )
    )
    return layers.groupBy("repo", "language", "section", "key").agg(
        F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer")
    )


def pivot_thresholds(resolved: DataFrame) -> DataFrame:
    """One row per ``(repo, language)`` with the numeric limits as columns."""
    keys = sorted({k for _, k in BUILT_IN} | {k for kv in PACK_LAYER.values() for _, k in kv})
    return resolved.groupBy("repo", "language").agg(
        *[
            F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
            for k in keys
        ]
    )


def with_limits(df: DataFrame, limits, language: str, *keys: str) -> DataFrame:
    """Add ``limit_<key>`` columns: one dict for all repositories, or one row each.

    ``limits`` is None (pack defaults), a dict, or the output of ``pivot_thresholds``.
    The table is joined on ``repo``; Spark broadcasts it only when it is small enough.
    """
    base = defaults(language)
    if isinstance(limits, DataFrame):
        mine = limits.filter(F.col("language") == language).select(
            "repo", *[F.col(k).alias(f"limit_{k}") for k in keys]
        )
        df = df.join(mine, "repo", "left")
        own = {k: F.col(f"limit_{k}") for k in keys}
    else:
        base = {**base, **(limits or {})}
        own = {k: F.lit(None).cast("string") for k in keys}
    for key in keys:
        value = F.coalesce(own[key], F.lit(str(base[key])))
        if key.endswith("_allowed"):
            items = F.split(F.regexp_replace(value, r"[\[\]\s]", ""), ",")
            typed = F.filter(
                F.transform(items, lambda v: v.try_cast("double")), lambda v: v.isNotNull()
            )
        else:
            typed = value.try_cast("double")
        df = df.withColumn(f"limit_{key}", typed)
    return df
