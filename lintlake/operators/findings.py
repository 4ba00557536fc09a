"""Filters, counts, groups and matches on the findings table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.severity import at_or_above, rank_of, severity_rank
from lintlake.model import CATEGORIES, EFFORTS, REQUIRED_COLUMNS, SEVERITIES
from lintlake.operators.ranking import first_of_each
from lintlake.sources.files import clean_pattern

# The order findings are reported in where "first" matters.
REPORT_ORDER = ["file", "line_start", "rule_id", "id"]
# Lines of a change are matched in stretches of this many lines.
LINE_STRETCH = 64


# Filters


def clamp_confidence(value) -> float:
    """The threshold a caller means: 0..1, and 0.7 for nothing, zero or no number."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = math.nan
    if math.isnan(number) or number == 0:
        number = 0.7
    return max(0.0, min(1.0, number))


def filter_confidence(df: DataFrame, threshold) -> DataFrame:
    return df.filter(F.col("confidence") >= clamp_confidence(threshold))


def filter_severity(df: DataFrame, threshold: str) -> DataFrame:
    """Findings at or above a level; nothing passes a level that does not exist."""
    return df.filter(at_or_above("severity", threshold))


def filter_editor(df: DataFrame, threshold: str, confidence: float) -> DataFrame:
    """The editor's filter: an unknown level shows medium and above."""
    rank = severity_rank("severity")
    level = rank_of(threshold)
    shown = rank <= 2 if level < 0 else (rank >= 0) & (rank <= level)
    return df.filter(shown & (F.col("confidence") >= confidence))


def filter_paths(df: DataFrame, patterns) -> DataFrame:
    """Drop findings below the given paths.

    ``patterns`` is a list, or a table ``(repo, pattern)`` for patterns per repository.
    """
    if isinstance(patterns, DataFrame):
        bare = F.regexp_replace(F.replace("pattern", F.lit("*"), F.lit("")), "^/|/$", "")
        table = (
            patterns.select(F.col("repo").alias("_repo"), bare.alias("_bare"))
            .filter(F.col("_bare") != "")
            .distinct()
        )
        hit = (F.col("repo") == F.col("_repo")) & (
            F.startswith("file", "_bare") | F.contains("file", F.concat(F.lit("/"), F.col("_bare")))
        )
        return df.join(table, hit, "left_anti")
    for pattern in patterns:
        bare = clean_pattern(pattern)
        if bare:
            df = df.filter(~(F.col("file").startswith(bare) | F.col("file").contains("/" + bare)))
    return df


def filter_category(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Optional filter by a finding's own category; off without a list."""
    return df if categories is None else df.filter(F.col("category").isin(*categories))


def validate_findings(df: DataFrame) -> DataFrame:
    """``(check, violations)`` for every rule a finding has to keep, zero included."""
    checks = {f"{c} is set": F.col(c).isNull() for c in REQUIRED_COLUMNS}
    checks.update(
        {
            "severity is known": ~F.col("severity").isin(*SEVERITIES),
            "category is known": ~F.col("category").isin(*CATEGORIES),
            "effort is known": ~F.col("effort").isin(*EFFORTS),
            "confidence in 0..1": ~F.col("confidence").between(0, 1),
            "line_start above 0": F.col("line_start") <= 0,
            "line_end not before line_start": F.col("line_end") < F.col("line_start"),
        }
    )
    counted = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("violations"))
            for i, name in enumerate(checks)
        ]
    )
    return counted.select(F.inline(rows))


# Counts


def _sided(df: DataFrame, *dimensions: str) -> DataFrame:
    """Counts per ``(repo, dimension, value)`` from one pass over the findings.

    Each finding counts once per dimension, and tasks add up before anything moves.
    """
    sides = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]
    )
    return df.select("repo", F.inline(sides)).groupBy("repo", "dimension", "value").agg(
        F.count("*").alias("n")
    )


def build_summary(df: DataFrame) -> DataFrame:
    """One row per repository: total, a count for each severity, maps, distinct files.

    The findings are read once; the maps hold only the few known categories and languages,
    and files are counted, never collected.
    """
    counts = _sided(df, "severity", "category", "language", "file")
    dimension, value, n = F.col("dimension"), F.col("value"), F.col("n")

    def entries(name: str) -> Column:
        return F.map_from_entries(
            F.array_sort(F.collect_list(F.when(dimension == name, F.struct("value", "n"))))
        )

    by_severity = [
        x
        for s in SEVERITIES
        for x in (F.lit(s), F.sum(F.when((dimension == "severity") & (value == s), n).otherwise(0)))
    ]
    return counts.groupBy("repo").agg(
        F.sum(F.when(dimension == "severity", n).otherwise(0)).alias("total"),
        F.create_map(*by_severity).alias("by_severity"),
        entries("category").alias("by_category"),
        entries("language").alias("by_language"),
        F.count_if(dimension == "file").alias("files_affected"),
    )


def summary_for_all(repos: DataFrame, summary: DataFrame) -> DataFrame:
    """Add an all-zero row for each repository without findings."""
    zero = F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.lit(0).cast("long"))])
    none = F.create_map().cast("map<string,bigint>")
    return repos.select("repo").distinct().join(summary, "repo", "left").select(
        "repo",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("by_severity", zero).alias("by_severity"),
        F.coalesce("by_category", none).alias("by_category"),
        F.coalesce("by_language", none).alias("by_language"),
        F.coalesce("files_affected", F.lit(0)).alias("files_affected"),
    )


def summary_sets(df: DataFrame) -> DataFrame:
    """The same counts in long form: ``(repo, dimension, value, n)``."""
    return _sided(df.withColumn("total", F.lit("total")), "total", "severity", "category", "language")


def gate_fail(df: DataFrame, level: str) -> DataFrame:
    """``(repo, blocking, failed)``; ``none`` and unknown levels never fail."""
    return df.groupBy("repo").agg(F.count_if(at_or_above("severity", level)).alias("blocking")).withColumn(
        "failed", F.col("blocking") > 0
    )


def scan_outputs(df: DataFrame, report_path: str) -> DataFrame:
    return df.groupBy("repo").agg(
        F.count("*").alias("findings_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
    ).withColumn("report_path", F.concat(F.lit(report_path.rstrip("/") + "/repo="), F.col("repo")))


def scan_complete(df: DataFrame) -> DataFrame:
    """Files and findings of the latest state, over everything."""
    per_file = df.groupBy("repo", "file").agg(F.count("*").alias("n"))
    return per_file.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings")
    )


def worst_by_file(df: DataFrame) -> DataFrame:
    """Files with their number of findings and worst severity, worst first."""
    rank = F.min(severity_rank("severity"))
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    return (
        df.groupBy("repo", "file")
        .agg(F.count("*").alias("findings"), rank.alias("worst_rank"))
        .withColumn("worst", F.get(order, F.col("worst_rank")))
        .orderBy("worst_rank", "repo", "file")
    )


def order_in_file(df: DataFrame) -> DataFrame:
    """Findings by file, then severity, then line."""
    return df.withColumn("rank", severity_rank("severity")).orderBy(
        "repo", "file", "rank", "line_start", "id"
    )


def dashboard_counts(df: DataFrame) -> DataFrame:
    """``(dimension, value, n)`` by severity, all five of them, and by category."""
    counts = df.groupBy("severity", "category").agg(F.count("*").alias("n"))
    zero = df.sparkSession.createDataFrame(
        [("severity", s, 0) for s in SEVERITIES], "dimension string, value string, n long"
    )
    sides = F.array(
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")),
    )
    return (
        counts.select(F.inline(sides), "n")
        .unionByName(zero)
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("n"))
    )


def dashboard_order(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", severity_rank("severity")).orderBy("rank", "file", "repo", "line_start", "id")


def card_text() -> Column:
    """What one card of the dashboard shows."""
    return F.concat_ws(
        " ", "severity", "antipattern_name", "category", "effort",
        F.concat_ws(":", "file", F.col("line_start").cast("string")), "message", "remediation",
        "rule_id",
    )


def dashboard_search(df: DataFrame, severity: str = "", category: str = "", text: str = "") -> DataFrame:
    if severity:
        df = df.filter(F.col("severity") == severity)
    if category:
        df = df.filter(F.col("category") == category)
    if text:
        df = df.filter(F.contains(F.lower(card_text()), F.lit(text.lower())))
    return df


# Issues and review comments


def top_findings(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The first critical or high findings of each repository, in report order."""
    severe = df.filter(F.col("severity").isin("critical", "high"))
    return first_of_each(severe, ["repo"], order or REPORT_ORDER, n)


def issue_title() -> Column:
    return F.concat(
        F.lit("["), F.upper("severity"), F.lit("] "), F.col("antipattern_name"), F.lit(" in `"),
        F.col("file"), F.lit("`"),
    )


def group_issues(df: DataFrame, label: str = "antipattern", order: list[str] | None = None) -> DataFrame:
    """One row per (anti-pattern, file): its first finding, its size, title and labels.

    The locations stay rows of the findings table; nothing is collected here.
    """
    first = F.min_by(
        F.struct(*[c for c in df.columns if c not in ("repo", "antipattern", "file")]),
        F.struct(*(order or REPORT_ORDER)),
    )
    groups = df.groupBy("repo", "antipattern", "file").agg(
        first.alias("first"), F.count("*").alias("locations")
    )
    return groups.select("repo", "antipattern", "file", "first.*", "locations").withColumn(
        "title", issue_title()
    ).withColumn(
        "labels",
        F.array(F.lit(label), F.col("category"), F.concat(F.lit("severity:"), F.col("severity"))),
    )


def dedup_issues(groups: DataFrame, open_issues: DataFrame) -> DataFrame:
    """Groups whose title is not open yet; equal titles within a run are all kept."""
    return groups.join(open_issues.select("repo", "title"), ["repo", "title"], "left_anti")


def pr_candidates(df: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Critical and high findings in files of the change ``(repo, file)``."""
    return df.filter(F.col("severity").isin("critical", "high")).join(
        changed_files.select("repo", "file"), ["repo", "file"], "left_semi"
    )


def pr_changed_lines(df: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings whose first line lies in a hunk ``(repo, file, start, end)``.

    Both sides meet on a stretch of lines as well as on the file, so a file with many
    findings and many hunks is no product of the two.
    """
    spread = hunks.select(
        "repo", "file", "start", "end",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / LINE_STRETCH), F.floor(F.col("end") / LINE_STRETCH)
            )
        ).alias("stretch"),
    ).alias("h")
    placed = df.withColumn("_stretch", F.floor(F.col("line_start") / LINE_STRETCH)).alias("f")
    return placed.join(
        spread,
        (F.col("f.repo") == F.col("h.repo"))
        & (F.col("f.file") == F.col("h.file"))
        & (F.col("f._stretch") == F.col("h.stretch"))
        & F.col("f.line_start").between(F.col("h.start"), F.col("h.end")),
        "left_semi",
    ).drop("_stretch")
