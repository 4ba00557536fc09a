"""The driver's tables as inputs of this package: sources, findings, reports, saves.

Texts in SQL that both engines understand are shared with the oracles, so both sides
start from the same derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRS = ("src", "lib/node_modules", "build/out", ".github", "app/vendor", "tests", "tools/venv", "docs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Spark SQL over the named driver tables."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


# Source files from documents

_DIR_CASE = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DIRS)) + " END"
SOURCES_SQL = f"""
SELECT source AS repo,
  concat({_DIR_CASE}, '/doc_', doc_id,
    CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.go'
      ELSE CASE doc_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.rs' ELSE '.txt' END END) AS path,
  text AS content, doc_id
FROM {{documents}}
"""


def sources_sql() -> str:
    return SOURCES_SQL.format(documents="documents")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SOURCES_SQL, "documents")


# Findings from events; a third of the users share one repository

FINDINGS_SQL = """
SELECT CASE WHEN user_id % 3 = 0 THEN 'mono' ELSE concat('repo', user_id % 20) END AS repo,
  concat('f', event_id) AS id,
  concat('ap_', event_type) AS antipattern,
  CASE event_type WHEN 'error' THEN 'Error Case' WHEN 'purchase' THEN 'Bought <it>' WHEN 'click' THEN 'Click "x"'
    WHEN 'view' THEN 'View & See' ELSE 'Sign Up' END AS antipattern_name,
  CASE event_type WHEN 'error' THEN 'security' WHEN 'purchase' THEN 'dependencies' WHEN 'click' THEN 'code_structure'
    WHEN 'view' THEN 'test_quality' ELSE 'documentation' END AS category,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium'
    WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
  CAST(event_id % 21 AS DOUBLE) / 20 AS confidence,
  concat(CASE user_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'very/long/directory/name/of/a/project/'
    ELSE 'lib/vendor/' END, 'user_', user_id, CASE user_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END) AS file,
  CAST(event_id % 400 + 1 AS INT) AS line_start,
  CAST(event_id % 400 + 1 + event_id % 3 AS INT) AS line_end,
  CASE user_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END AS language,
  CASE user_id % 3 WHEN 0 THEN 'python_v1' WHEN 1 THEN 'typescript_v1' ELSE 'go_v1' END AS language_pack,
  concat('event <', event_id, '> & ''', event_type, '''') AS message,
  concat('fix ', event_type) AS remediation,
  CASE event_type WHEN 'error' THEN 'minutes' WHEN 'purchase' THEN 'days' WHEN 'click' THEN 'hours'
    WHEN 'view' THEN 'weeks' ELSE 'minutes' END AS effort,
  'ast-checker' AS tool,
  CASE event_type WHEN 'error' THEN 'python/eval-usage' WHEN 'purchase' THEN 'python/low-coverage'
    WHEN 'click' THEN 'ts/magic-number' WHEN 'view' THEN 'go/god-struct' ELSE 'python/long-method' END AS rule_id,
  CASE event_id % 3 WHEN 0 THEN concat('def f(x=[], n=', event_id, '):') WHEN 1 THEN concat('from m', event_id, ' import *') END AS code_snippet,
  CASE event_type WHEN 'error' THEN concat('https://e.example/', event_id) END AS link,
  CASE WHEN event_id % 50 = 0 THEN 'dead_code' ELSE 'plain' END AS tag,
  ts AS detected_at, event_id, user_id
FROM {events}
"""


def findings_sql() -> str:
    return FINDINGS_SQL.format(events="events")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, FINDINGS_SQL, "events")
    return rows.select(
        *[c for c in rows.columns if c not in ("link", "tag")],
        F.lit(None).cast("int").alias("column"),
        F.when(F.col("link").isNotNull(), F.array("link", F.concat("link", F.lit("/b"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("references"),
        F.array("tag").alias("tags"),
    )


# Function metrics from lineitem

METRICS_SQL = """
SELECT concat('r', l_suppkey % 10) AS repo,
  concat('src/o', l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN '.ts' ELSE '.js' END) AS file,
  concat('f', l_linenumber, '_', l_partkey) AS name,
  CAST(l_linenumber * 10 AS INT) AS start,
  CAST(l_linenumber * 10 + l_quantity * 4 - 1 AS INT) AS "end",
  CAST(l_quantity * 4 AS INT) AS length,
  CAST(l_quantity AS INT) AS ccn
FROM {lineitem}
"""


def metrics_sql() -> str:
    return METRICS_SQL.format(lineitem="lineitem")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, METRICS_SQL.replace('"end"', "`end`"), "lineitem")


# Reports of analysers, one JSON text per part


def reports(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """``(repo, json)``: ``body`` is a Spark SQL value over ``k``, ``n``, ``w``, ``repo``."""
    rows = run(
        spark, sf_dir,
        "SELECT p_brand AS repo, p_partkey AS k, p_size AS n, replace(p_name, ' ', '_') AS w FROM {part}", "part",
    )
    return rows.selectExpr("repo", f"{body} AS json")


PARTS = "(SELECT p_brand AS repo, p_partkey AS k, p_size AS n, replace(p_name, ' ', '_') AS w FROM part)"

# Saves and settings from events

SAVES_SQL = """
SELECT concat('repo', user_id % 5) AS repo, concat('src/u', user_id, '.py') AS uri, ts,
  concat('x = ', event_id) AS content, event_id
FROM {events}
"""
CONFIG_SQL = """
SELECT concat('repo', user_id % 5) AS repo,
  CASE event_id % 3 WHEN 0 THEN 'enabled' WHEN 1 THEN 'severityThreshold' ELSE 'other' END AS key,
  CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END
    WHEN 1 THEN concat('level', event_id) ELSE 'x' END AS value, ts
FROM {events}
"""

# Override texts from supplier

OVERRIDES_SQL = r"""
SELECT concat('s', s_suppkey) AS repo, concat('# limits\n\ncode_structure:\n  max-function-length: ', s_nationkey * 10,
  '\n  max_nesting_depth:   ', s_nationkey, '\n  magic_number_allowed: [0, 1, ', s_nationkey, ']\n',
  CASE WHEN s_suppkey % 2 = 0 THEN 'test_quality:\n\tmin_coverage_percent: 12.5\n\tnote: a: b\n' ELSE 'unknown:\n  a: true\n' END,
  '  max_mock_calls: -', s_nationkey, '\nstray\n') AS content, s_suppkey
FROM {supplier}
"""
