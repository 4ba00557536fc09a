"""Rules added by users: DataFrame functions or SQL text over the code relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lintlake.model import FINDING_COLUMNS, build_findings, string_list
from lintlake.operators.pynodes import _parse, _walk

LANGUAGES = ("python", "typescript", "go")
_RULES: dict[str, UserRule] = {}


@dataclass(frozen=True)
class UserRule:
    rule_id: str
    language: str
    query: Callable[[DataFrame], DataFrame]


def register_rule(rule_id: str, language: str, query: Callable[[DataFrame], DataFrame]) -> None:
    """Add a rule: ``query`` gets ``py_nodes`` (Python) or ``code`` rows and returns findings."""
    if language not in LANGUAGES:
        raise ValueError(f"no pack for {language!r}")
    if rule_id in _RULES:
        raise ValueError(f"rule {rule_id!r} is registered already")
    _RULES[rule_id] = UserRule(rule_id, language, query)


def register_sql_rule(
    rule_id: str, language: str, sql: str, *, antipattern: str, name: str, message: str,
    remediation: str, category: str = "code_structure", severity: str = "medium",
    confidence: float = 0.8, effort: str = "minutes",
) -> None:
    """Add a rule as SQL over ``{code}``; it selects ``repo, path, line, ordinal``."""

    def query(rows: DataFrame) -> DataFrame:
        found = rows.sparkSession.sql(sql, code=rows)
        return build_findings(
            found, ordinal=F.col("ordinal"), antipattern=antipattern, antipattern_name=name,
            category=category, severity=severity, confidence=confidence, file=F.col("path"),
            line_start=F.col("line"), line_end=F.col("line"), language=language,
            language_pack="user", message=message, remediation=remediation, effort=effort,
            tool="user-rule", rule_id=rule_id, tags=string_list(()),
        )

    register_rule(rule_id, language, query)


def unregister_rule(rule_id: str) -> None:
    _RULES.pop(rule_id, None)


def user_rules(language: str) -> list[UserRule]:
    return [r for r in _RULES.values() if r.language == language]


def apply_user_rules(rows: DataFrame, language: str) -> list[DataFrame]:
    return [r.query(rows).select(*FINDING_COLUMNS) for r in user_rules(language)]


@udtf(returnType="pre int, last int, parent int, field string, kind string, line int, end_line int, name string")
class SourceNodes:
    """``LATERAL source_nodes(path, content)``: syntax nodes of one Python file in SQL."""

    def eval(self, path: str, content: str):
        tree = _parse(content or "")
        if isinstance(tree, str):
            return
        for row in _walk(tree):
            yield (
                row["pre"], row["last"], row["parent"], row["field"], row["kind"], row["line"],
                row["end_line"], row.get("name"),
            )


def register_functions(spark: SparkSession) -> None:
    """Make the table functions of this package callable from SQL."""
    spark.udtf.register("source_nodes", SourceNodes)
