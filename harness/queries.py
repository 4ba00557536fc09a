"""Every operator of the survey over the driver's tables, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harness import adapters as A
from harness.plants import BY_RULE, PLANTS, expected_sql, planted
from lintlake.functions.severity import at_or_above, severity_rank
from lintlake.functions.text import escape_html, format_category, truncate_left
from lintlake.operators import findings as O
from lintlake.operators import relations as R
from lintlake.operators import render as V
from lintlake.operators import rules_go, rules_python, rules_typescript
from lintlake.operators import thresholds as T
from lintlake.operators.metrics import function_metrics
from lintlake.operators.pynodes import py_nodes
from lintlake.operators.statements import statements
from lintlake.operators.secrets import label_by_pack, leaks_to_findings, scan_secrets
from lintlake.plans import registry
from lintlake.plans.catalogue import RULES, gate_categories, rules_table
from lintlake.plans.scan import Relations, _apply, full_scan, scan, scan_meta, write_report
from lintlake.sources import files as S
from lintlake.sources import reports as I
from lintlake.sources.storage import fresh_path
from lintlake.streaming import saves as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, fn: Query, oracle: str | None = None) -> None:
    QUERIES[name] = fn
    if oracle is not None:
        ORACLES[name] = oracle


def query(name: str, oracle: str | None = None):
    def wrap(fn: Query) -> Query:
        add(name, fn, oracle)
        return fn

    return wrap


def values(rows) -> str:
    """A VALUES list of SQL from Python tuples."""
    shown = [
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    ]
    return "(VALUES " + ", ".join(shown) + ")"


FOUND = f"WITH findings AS ({A.findings_sql()}) "
SRC = f"WITH src AS ({A.sources_sql()}), dirs AS (SELECT *, list_slice(string_split(path, '/'), 1, -2) AS d FROM src) "
RANK = (
    "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3"
    " WHEN 'info' THEN 4 ELSE -1 END"
)
MARK = (
    "CASE severity WHEN 'critical' THEN '[crit]' WHEN 'high' THEN '[high]' WHEN 'medium' THEN '[med]'"
    " WHEN 'low' THEN '[low]' ELSE '[info]' END"
)
EFFORT = (
    "CASE effort WHEN 'minutes' THEN '[fast]' WHEN 'hours' THEN '[hrs]' WHEN 'days' THEN '[days]' ELSE '[wks]' END"
)
PCT = "CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR)"


# Rules over planted code

_RULES = {**rules_python.RULES, **rules_typescript.RULES, **rules_go.RULES, **rules_typescript.TEXT_RULES}
_RULE_COLUMNS = (
    "repo", "file", "rule_id", "antipattern", "category", "severity", "confidence", "effort",
    "line_start", "line_end",
)


def _relation(src: DataFrame, rule_id: str, language: str) -> DataFrame:
    if rule_id in rules_typescript.TEXT_RULES:
        return src
    return py_nodes(src) if language == "python" else R.code_rows(src, language)


def _rule_query(plant):
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = planted(A.table(spark, sf_dir, "part"), plant)
        relation = _relation(src, plant.rule_id, plant.language)
        return _apply(_RULES[plant.rule_id], relation, src, None).select(*_RULE_COLUMNS)

    return fn


for _plant in PLANTS:
    add(
        "rule_" + _plant.rule_id.replace("/", "_").replace("-", "_"),
        _rule_query(_plant),
        f"SELECT {', '.join(_RULE_COLUMNS)} FROM ({expected_sql(_plant)})",
    )


# Sources and file selection


@query(
    "read_source_files",
    "SELECT source AS repo, md5(text) AS digest, CAST(length(text) AS INTEGER) AS chars FROM documents",
)
def _(spark, sf_dir):
    root = fresh_path(spark, "checkout")
    # a document that stands twice is two files; 256 folders a repository keep folders small
    twin = Window.partitionBy("doc_id", "source").orderBy("text")
    S.write_source_files(
        A.table(spark, sf_dir, "documents").withColumn("twin", F.row_number().over(twin)).selectExpr(
            "concat('repo=', coalesce(nullif(replace(source, '/', '%2F'), ''), '__HIVE_DEFAULT_PARTITION__')) AS repo",
            "concat(pmod(hash(doc_id), 256), '/doc_', coalesce(cast(doc_id AS string), 'none'), '_', twin, '.txt') AS path",
            "concat(coalesce(text, ''), '\n') AS content",
        ),
        root,
    )
    rows = S.read_source_files(spark, root, extensions=(".txt",))
    body = F.expr("substr(content, 1, length(content) - 1)")
    return rows.select(
        F.regexp_replace("repo", "^repo=", "").alias("repo"), F.md5(body).alias("digest"), F.length(body).alias("chars")
    )


for _pack in S.SKIP_DIRS:
    _hidden = "" if _pack in S.ENTERS_HIDDEN else " AND len(list_filter(d, lambda x: starts_with(x, '.'))) = 0"
    add(
        f"prune_dirs_{_pack}",
        lambda spark, sf_dir, p=_pack: S.prune_dirs(A.source_files(spark, sf_dir), p).select("repo", "path"),
        SRC + "SELECT repo, path FROM dirs WHERE NOT list_has_any(d, ["
        + ", ".join(f"'{x}'" for x in S.SKIP_DIRS[_pack]) + f"]){_hidden}",
    )

add(
    "prune_ignored_dir",
    lambda spark, sf_dir: S.prune_ignored(A.source_files(spark, sf_dir), ["src", "app/ven"]).select("repo", "path"),
    SRC + "SELECT repo, path FROM dirs WHERE NOT starts_with(array_to_string(d, '/'), 'src')"
    " AND NOT starts_with(array_to_string(d, '/'), 'app/ven')",
)
add(
    "prune_ignored_file",
    lambda spark, sf_dir: S.prune_ignored(A.source_files(spark, sf_dir), ["docs/doc_1"], on="file").select("repo", "path"),
    SRC + "SELECT repo, path FROM src WHERE NOT starts_with(path, 'docs/doc_1')",
)
_PREFIXES = "SELECT DISTINCT source AS repo, CASE WHEN lang = 'en' THEN 'src' ELSE 'docs' END AS prefix FROM {documents}"
add(
    "prune_ignored_per_repo",
    lambda spark, sf_dir: S.prune_ignored(
        A.source_files(spark, sf_dir),
        A.run(spark, sf_dir, _PREFIXES + " WHERE doc_id % 5 = 0", "documents"),
    ).select("repo", "path"),
    SRC + ", pre AS (" + _PREFIXES.format(documents="documents") + " WHERE doc_id % 5 = 0)"
    " SELECT repo, path FROM dirs WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.repo = dirs.repo"
    " AND starts_with(array_to_string(d, '/'), prefix))",
)
add(
    "prune_ignored_glob",
    lambda spark, sf_dir: S.prune_glob(A.source_files(spark, sf_dir), ["**/docs/**", "*tools/venv*", "/app/vendor/"]).select(
        "repo", "path"
    ),
    SRC + "SELECT repo, path FROM dirs WHERE NOT list_contains(d, 'docs')"
    " AND NOT ends_with(array_to_string(d, '/'), 'tools/venv') AND NOT ends_with(array_to_string(d, '/'), 'app/vendor')",
)
_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"


def _language_case(table: dict) -> str:
    return f"CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in table.items()) + " END"


add(
    "language_of",
    lambda spark, sf_dir: A.source_files(spark, sf_dir).select(
        "repo", "path",
        S.language_column(F.col("path")).alias("scan"),
        S.language_column(F.col("path"), "editor").alias("editor"),
        S.language_column(F.col("path"), "infer").alias("inferred"),
    ),
    SRC + f"SELECT repo, path, {_language_case(S.EXTENSIONS)} AS scan, {_language_case(S.EDITOR_EXTENSIONS)} AS editor,"
    f" CASE WHEN {_EXT} IN ('.ts', '.tsx') THEN 'typescript' ELSE 'javascript' END AS inferred FROM src",
)
_DETECT = (
    SRC + f", det AS (SELECT repo, {_language_case(S.EXTENSIONS)} AS language, count(*) AS file_count FROM src"
    " GROUP BY 1, 2 HAVING language IS NOT NULL) "
)
add(
    "detect_languages",
    lambda spark, sf_dir: S.detect_languages(A.source_files(spark, sf_dir)),
    _DETECT + "SELECT repo, language, file_count, language IN ('python', 'typescript', 'javascript', 'go') AS pack_available FROM det",
)
add(
    "select_packs",
    lambda spark, sf_dir: S.packs_to_run(S.select_packs(S.detect_languages(A.source_files(spark, sf_dir)))),
    _DETECT + "SELECT DISTINCT repo, CASE WHEN language = 'python' THEN 'python_v1' WHEN language = 'go' THEN 'go_v1'"
    " ELSE 'typescript_v1' END AS pack FROM det WHERE language IN ('python', 'typescript', 'javascript', 'go')",
)
add(
    "select_packs_requested",
    lambda spark, sf_dir: S.select_packs(S.detect_languages(A.source_files(spark, sf_dir)), "go, rust").select(
        "repo", "language", "has_pack"
    ),
    _DETECT + "SELECT DISTINCT repo, l AS language, l = 'go' AS has_pack FROM det, (VALUES ('go'), ('rust')) t(l)",
)
add(
    "gate_categories",
    lambda spark, sf_dir: A.findings(spark, sf_dir).join(
        F.broadcast(gate_categories(rules_table(spark), ["test_quality", "security"])).select("rule_id"), "rule_id"
    ).groupBy("repo", "rule_id").agg(F.count("*").alias("n")),
    FOUND + "SELECT repo, rule_id, count(*) AS n FROM findings WHERE rule_id IN ("
    + ", ".join(f"'{r.rule_id}'" for r in RULES if r.runner in ("test_quality", "security")) + ") GROUP BY 1, 2",
)


# Relations


def _re2(pattern: str) -> str:
    """The same pattern without possessive marks, which DuckDB does not have."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        elif pattern[i] in "*+?" and pattern[i + 1 : i + 2] == "+":
            out.append(pattern[i])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out).replace("'", "''")


add(
    "tokens",
    lambda spark, sf_dir: R.tokens(A.source_files(spark, sf_dir), "go").groupBy("repo", "path", "kind").agg(
        F.count("*").alias("n"), F.sum(F.length("tok")).alias("chars"), F.sum("line").alias("lines"), F.sum("pos").alias("places")
    ),
    SRC + f", t AS (SELECT repo, path, toks, unnest(range(0, len(toks))) AS pos FROM (SELECT repo, path,"
    f" regexp_extract_all(content, '{_re2(R.GO_TOKENS)}', 0) AS toks FROM src)),"
    " u AS (SELECT repo, path, pos, toks[pos + 1] AS tok FROM t),"
    " v AS (SELECT *, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (PARTITION BY repo, path"
    " ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM u)"
    " SELECT repo, path, CASE WHEN tok = chr(10) THEN 'newline' WHEN starts_with(tok, '//') OR starts_with(tok, '/*') THEN 'comment'"
    " WHEN starts_with(tok, '`') THEN 'template' WHEN (starts_with(tok, '\"') OR starts_with(tok, '''')) AND length(tok) > 1 THEN 'string'"
    " WHEN starts_with(tok, '/') AND length(tok) > 2 THEN 'regex' WHEN regexp_matches(tok, '^\\.?[0-9]') THEN 'number'"
    " WHEN regexp_matches(tok, '^[\\p{L}_$#]') THEN 'word' ELSE 'punct' END AS kind, count(*) AS n,"
    " CAST(sum(length(tok)) AS BIGINT) AS chars, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(pos) AS BIGINT) AS places"
    " FROM v GROUP BY 1, 2, 3",
)


_DEEP = (
    "concat('const a = [', chr(10), repeat(' ', p_size), '/`/,', chr(10), repeat(' ', p_size), 'eval(', p_partkey, '),',"
    " chr(10), repeat(' ', p_size), '/[\"`]/g ];')"
)


@query(
    "tokens_typescript",
    # regular expressions with quotes and backticks, indented by up to 50 blanks
    "SELECT p_brand AS repo, p_partkey AS k, kind, n, lines FROM part, (VALUES ('word', 3, 5), ('punct', 8, 21), ('newline', 3, 6),"
    " ('regex', 2, 6), ('number', 1, 3)) AS t(kind, n, lines)",
)
def _(spark, sf_dir):
    src = A.table(spark, sf_dir, "part").selectExpr("p_brand AS repo", "CAST(p_partkey AS STRING) AS path", f"{_DEEP} AS content")
    return (
        R.tokens(src, "typescript")
        .groupBy("repo", F.col("path").cast("long").alias("k"), "kind")
        .agg(F.count("*").alias("n"), F.sum("line").alias("lines"))
    )


def _planted_rows(spark, sf_dir, rule_id):
    plant = BY_RULE[rule_id]
    src = planted(A.table(spark, sf_dir, "part"), plant)
    return _relation(src, rule_id, plant.language)


_NEST = "(SELECT p_brand AS repo, p_partkey AS k, p_size % 8 AS d FROM part)"
_TS_PATH = "concat('src/part_', k, '.ts')"
add(
    "brackets",
    lambda spark, sf_dir: R.pairs(_planted_rows(spark, sf_dir, "ts/deep-nesting"), "level").select(
        "repo", "path", "bracket", "open_line", "close_line", "level"
    ),
    f"SELECT repo, {_TS_PATH} AS path, '{{' AS bracket, CAST(i + 1 AS INTEGER) AS open_line, CAST(2 * d + 3 - i AS INTEGER) AS close_line,"
    f" CAST(i + 1 AS INTEGER) AS level FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM {_NEST})"
    f" UNION ALL SELECT repo, {_TS_PATH}, '(', CAST(i + 1 AS INTEGER), CAST(i + 1 AS INTEGER), CAST(i + 1 AS INTEGER)"
    f" FROM (SELECT *, unnest(range(0, d + 2)) AS i FROM {_NEST})",
)
add(
    "blocks",
    lambda spark, sf_dir: R.blocks(_planted_rows(spark, sf_dir, "ts/deep-nesting")).groupBy(
        "repo", "path", F.col("kind_of_block").alias("kind")
    ).agg(F.count("*").alias("n"), F.max("level").alias("deepest")),
    f"SELECT repo, {_TS_PATH} AS path, 'function' AS kind, CAST(1 AS BIGINT) AS n, 1 AS deepest FROM {_NEST}"
    f" UNION ALL SELECT repo, {_TS_PATH}, 'if', CAST(d AS BIGINT), d + 1 FROM {_NEST} WHERE d > 0",
)
# Control statements of all nine kinds, most of them without braces: one more per line.
_OPENERS = "array('if (x)', 'for (;;)', 'for (k in x)', 'for (k of x)', 'while (x)', 'with (x)')"
_INNERMOST = "array('do go(x)\\n while (x)\\n', 'switch (x) { case 1: go(x)\\n }\\n', 'try { go(x) }\\n catch (e) { }\\n')"


def _bare_bodies(spark, sf_dir):
    src = A.table(spark, sf_dir, "part").selectExpr(
        "p_brand AS repo", "concat('src/part_', p_partkey, '.ts') AS path",
        "concat('function g(x) {\\n  go(1)\\n', array_join(transform(slice(sequence(0, 60), 1, cast(p_size % 8 as int)),"
        f" d -> concat(element_at({_OPENERS}, cast((p_partkey + d) % 6 + 1 as int)), '\\n')), ''),"
        f" element_at({_INNERMOST}, cast(p_partkey % 3 + 1 as int)), '  go(2)\\n}}\\nif (y)\\n go(3)\\n else if (z) go(4)\\n') AS content",
    )
    return R.code_rows(src, "typescript")


_BARE = (
    "(SELECT p_brand AS repo, concat('src/part_', p_partkey, '.ts') AS path, p_partkey AS k, p_size % 8 AS d FROM part)"
)
add(
    "statements",
    lambda spark, sf_dir: statements(_bare_bodies(spark, sf_dir)).select("repo", "path", "kind", "tok", "line", "end_line", "depth", "braced"),
    f"WITH s AS {_BARE}, w AS (SELECT *, unnest(range(0, d)) AS i FROM s)"
    " SELECT repo, path, 'control' AS kind, ['if', 'for', 'for', 'for', 'while', 'with'][(k + i) % 6 + 1] AS tok,"
    " CAST(3 + i AS INTEGER) AS line, CAST(4 + d AS INTEGER) AS end_line, CAST(1 + i AS INTEGER) AS depth, false AS braced FROM w"
    " UNION ALL SELECT repo, path, 'control', ['do', 'switch', 'try'][k % 3 + 1], 3 + d, 4 + d, 1 + d, k % 3 > 0 FROM s"
    " UNION ALL SELECT repo, path, 'function', '{', 1, 6 + d, 1 + d, true FROM s"
    " UNION ALL SELECT repo, path, 'control', 'if', 7 + d, 9 + d, 1, false FROM s"
    " UNION ALL SELECT repo, path, 'control', 'if', 9 + d, 9 + d, 2, false FROM s",
)
add(
    "rule_ts_deep_nesting_without_braces",
    lambda spark, sf_dir: rules_typescript.deep_nesting(_bare_bodies(spark, sf_dir)).select("repo", "file", "line_start", "line_end", "severity"),
    f"SELECT repo, path AS file, 1 AS line_start, CAST(6 + d AS INTEGER) AS line_end, CASE WHEN d >= 5 THEN 'high' ELSE 'medium' END AS severity"
    f" FROM {_BARE} WHERE d >= 3",
)
_PYCOG = "(SELECT p_brand AS repo, concat('src/part_', p_partkey, '.py') AS path, p_size % 4 + 2 AS loops, p_size % 7 AS ifs FROM part)"
add(
    "py_nodes",
    lambda spark, sf_dir: _planted_rows(spark, sf_dir, "python/cognitive-complexity").filter(
        F.col("kind").isin("FunctionDef", "For", "If", "Call")
    ).groupBy("repo", "path", "kind").agg(F.count("*").alias("n"), F.max("line").alias("last_line")),
    f"SELECT repo, path, 'FunctionDef' AS kind, CAST(1 AS BIGINT) AS n, 1 AS last_line FROM {_PYCOG}"
    f" UNION ALL SELECT repo, path, 'For', loops, 1 + loops FROM {_PYCOG}"
    f" UNION ALL SELECT repo, path, 'If', ifs, loops + 2 * ifs FROM {_PYCOG} WHERE ifs > 0"
    f" UNION ALL SELECT repo, path, 'Call', greatest(ifs, 1), 1 + loops + greatest(2 * ifs, 1) FROM {_PYCOG}",
)
add(
    "function_metrics_python",
    lambda spark, sf_dir: function_metrics(_planted_rows(spark, sf_dir, "python/cognitive-complexity"), "python"),
    f"SELECT repo, path AS file, 'f' AS name, 1 AS start, CAST(1 + loops + greatest(2 * ifs, 1) AS INTEGER) AS \"end\","
    f" CAST(1 + loops + greatest(2 * ifs, 1) AS INTEGER) AS length, CAST(1 + loops + ifs AS INTEGER) AS ccn FROM {_PYCOG}",
)
add(
    "function_metrics_typescript",
    lambda spark, sf_dir: function_metrics(_planted_rows(spark, sf_dir, "ts/deep-nesting"), "typescript"),
    f"SELECT repo, {_TS_PATH} AS file, 'f' AS name, 1 AS start, CAST(2 * d + 3 AS INTEGER) AS \"end\","
    f" CAST(2 * d + 3 AS INTEGER) AS length, CAST(1 + d AS INTEGER) AS ccn FROM {_NEST}",
)
add(
    "function_metrics_go",
    lambda spark, sf_dir: function_metrics(_planted_rows(spark, sf_dir, "go/deep-nesting"), "go"),
    "SELECT repo, concat('src/part_', k, '.go') AS file, 'f' AS name, 3 AS start, CAST(2 * d + 5 AS INTEGER) AS \"end\","
    " CAST(2 * d + 3 AS INTEGER) AS length, CAST(1 + d AS INTEGER) AS ccn FROM"
    " (SELECT p_brand AS repo, p_partkey AS k, p_size % 9 AS d FROM part)",
)


def _doc_findings(spark, sf_dir):
    src = A.source_files(spark, sf_dir)
    marks = src.select("repo", F.col("path").alias("file"), (F.col("doc_id") % 5 + 1).cast("int").alias("line_start"))
    return marks, src


add(
    "snippet_python",
    lambda spark, sf_dir: V.snippet(*_doc_findings(spark, sf_dir), "python"),
    SRC + "SELECT repo, path AS file, CAST(doc_id % 5 + 1 AS INTEGER) AS line_start,"
    " regexp_replace(array_to_string(list_slice(string_split(content, chr(10)), greatest(doc_id % 5 - 1, 1), doc_id % 5 + 3), chr(10)),"
    " '^\\s+|\\s+$', '', 'g') AS code_snippet FROM src",
)
add(
    "snippet_typescript",
    lambda spark, sf_dir: V.snippet(*_doc_findings(spark, sf_dir), "typescript"),
    SRC + "SELECT repo, path AS file, CAST(doc_id % 5 + 1 AS INTEGER) AS line_start,"
    " array_to_string(list_slice(string_split(content, chr(10)), doc_id % 5 + 1, doc_id % 5 + 5), chr(10)) AS code_snippet FROM src",
)
add(
    "cut_snippet",
    lambda spark, sf_dir: A.source_files(spark, sf_dir).select("repo", "path", V.cut_snippet(F.col("content")).alias("code_snippet")),
    SRC + "SELECT repo, path, CASE WHEN length(content) > 500 THEN concat(substr(content, 1, 500), '...') ELSE content END AS code_snippet FROM src",
)


# Secrets and reports


def _secret_oracle() -> str:
    from lintlake.operators.secrets import SECRET_RULES

    parts = [
        f"SELECT repo, path, ln, '{name}' AS rule_id, unnest(regexp_extract_all(line, '{_re2(rx)}', 0)) AS m FROM lines"
        for name, _, rx, _ in SECRET_RULES
    ]
    return (
        SRC + ", ls AS (SELECT repo, path, string_split(content, chr(10)) AS l FROM src),"
        " lines AS (SELECT repo, path, unnest(range(1, len(l) + 1)) AS ln, unnest(l) AS line FROM ls),"
        " hits AS (" + " UNION ALL ".join(parts) + ") "
    )


add(
    "scan_secrets",
    lambda spark, sf_dir: leaks_to_findings(scan_secrets(A.source_files(spark, sf_dir))).select(
        "repo", "file", "rule_id", "severity", "confidence", "line_start", "line_end"
    ),
    _secret_oracle() + "SELECT repo, path AS file, rule_id, 'critical' AS severity,"
    " CASE WHEN contains(rule_id, 'generic') THEN 0.75::DOUBLE ELSE 0.95::DOUBLE END AS confidence,"
    " CAST(ln AS INTEGER) AS line_start, CAST(ln AS INTEGER) AS line_end FROM hits",
)
add(
    "secrets_by_pack",
    lambda spark, sf_dir: label_by_pack(leaks_to_findings(scan_secrets(A.source_files(spark, sf_dir)))).groupBy(
        "language", "language_pack"
    ).agg(F.count("*").alias("n")),
    _secret_oracle() + f", l AS (SELECT {_EXT} AS e FROM hits) SELECT CASE WHEN e = '.py' THEN 'python' WHEN e = '.go' THEN 'go'"
    " ELSE 'typescript' END AS language, CASE WHEN e = '.py' THEN 'python_v1' WHEN e = '.go' THEN 'go_v1' ELSE 'typescript_v1' END"
    " AS language_pack, count(*) AS n FROM l WHERE e IN ('.py', '.go', '.ts', '.js') GROUP BY 1, 2",
)

_METRIC_COLUMNS = ("repo", "file", "severity", "effort", "language", "line_start", "line_end", "message")
_TSLANG = "CASE WHEN ends_with(file, '.ts') THEN 'typescript' ELSE 'javascript' END"
_MET = f"WITH m AS ({A.metrics_sql()}) "
add(
    "long_method",
    lambda spark, sf_dir: I.long_method(A.metrics(spark, sf_dir), "typescript").select(*_METRIC_COLUMNS),
    _MET + "SELECT repo, file, CASE WHEN length > 150 THEN 'high' ELSE 'medium' END AS severity,"
    f" CASE WHEN length > 150 THEN 'days' ELSE 'hours' END AS effort, {_TSLANG} AS language, start AS line_start, \"end\" AS line_end,"
    " concat('Function ''', name, ''' has ', length, ' lines (threshold: 50)') AS message FROM m WHERE length > 50",
)
add(
    "high_cyclomatic_complexity",
    lambda spark, sf_dir: I.high_cyclomatic_complexity(A.metrics(spark, sf_dir), "typescript").select(*_METRIC_COLUMNS),
    _MET + f"SELECT repo, file, CASE WHEN ccn > 20 THEN 'high' ELSE 'medium' END AS severity, 'hours' AS effort, {_TSLANG} AS language,"
    " start AS line_start, \"end\" AS line_end,"
    " concat('Function ''', name, ''' has cyclomatic complexity ', ccn, ' (threshold: 10)') AS message FROM m WHERE ccn > 10",
)
add(
    "god_class_file",
    lambda spark, sf_dir: I.god_class_file(A.metrics(spark, sf_dir), "typescript").select(
        "repo", "file", "rule_id", "language_pack", "severity", "line_start", "line_end"
    ),
    _MET + "SELECT repo, file, 'ts/god-class' AS rule_id, 'typescript_v1' AS language_pack,"
    " CASE WHEN count(*) > 30 THEN 'high' ELSE 'medium' END AS severity, 1 AS line_start, CAST(sum(length) AS INTEGER) AS line_end"
    " FROM m GROUP BY repo, file HAVING count(*) > 15 OR sum(length) > 500",
)
add(
    "ingest_complexity",
    lambda spark, sf_dir: I.ingest_complexity(
        A.metrics(spark, sf_dir).select(
            "repo",
            F.to_json(
                F.struct(
                    F.array(
                        F.struct(
                            F.col("file").alias("filename"), "name", "length", F.col("ccn").alias("cyclomatic_complexity"),
                            F.col("start").alias("start_line"), F.col("end").alias("end_line"),
                        )
                    ).alias("function_list")
                )
            ).alias("json"),
        ),
        "go",
    ).groupBy("repo", "rule_id", "severity").agg(F.count("*").alias("n")),
    _MET + "SELECT repo, 'go/long-function' AS rule_id, CASE WHEN length > 150 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n"
    " FROM m WHERE length > 50 GROUP BY 1, 2, 3 UNION ALL SELECT repo, 'go/high-complexity', CASE WHEN ccn > 20 THEN 'high' ELSE 'medium' END,"
    " count(*) FROM m WHERE ccn > 10 GROUP BY 1, 2, 3",
)

_LEVEL = "CASE n % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'medium' END"
_TRUST = "CASE n % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END"
_RAW_LEVEL = "element_at(array('HIGH', 'MEDIUM', 'LOW', 'UNDEFINED'), n % 4 + 1)"
_RAW_TRUST = "element_at(array('HIGH', 'MEDIUM', 'LOW'), n % 3 + 1)"
_BANDIT = (
    "to_json(named_struct('results', array(named_struct('test_id', element_at(array('B105', 'B307', 'B608', 'B999', 'B311'), int(k % 5 + 1)),"
    " 'test_name', CASE WHEN n % 2 = 0 THEN concat('name_', k) END,"
    f" 'issue_severity', {_RAW_LEVEL}, 'issue_confidence', {_RAW_TRUST}, 'filename', concat('src/', w, '.py'), 'line_number', n,"
    " 'line_range', CASE n % 3 WHEN 0 THEN array(n, n + 1, n + 2) WHEN 1 THEN array() END,"
    " 'issue_text', concat('issue ', k), 'code', concat('x = \"', k, '\"'), 'more_info', CASE WHEN n % 2 = 0 THEN 'https://m' ELSE '' END))))"
)
add(
    "ingest_bandit",
    lambda spark, sf_dir: I.ingest_bandit(A.reports(spark, sf_dir, _BANDIT)).select(
        "repo", "file", "antipattern", "antipattern_name", "severity", "confidence", "line_start", "line_end", "message", "rule_id",
        "code_snippet", F.size("references").alias("links"),
    ),
    "WITH b AS (SELECT *, CASE k % 5 WHEN 0 THEN 'hardcoded_secret' WHEN 1 THEN 'shell_injection_vector' WHEN 2 THEN 'sql_injection_vector'"
    " WHEN 3 THEN 'security_issue' ELSE 'weak_cryptography' END AS antipattern FROM " + A.PARTS + ")"
    " SELECT repo, concat('src/', w, '.py') AS file, antipattern, CASE WHEN n % 2 = 0 THEN concat('name_', k) ELSE antipattern END AS antipattern_name,"
    f" {_LEVEL} AS severity, {_TRUST} AS confidence, n AS line_start, CASE WHEN n % 3 = 0 THEN n + 2 ELSE n END AS line_end, concat('issue ', k) AS message,"
    " concat('bandit/', CASE k % 5 WHEN 0 THEN 'B105' WHEN 1 THEN 'B307' WHEN 2 THEN 'B608' WHEN 3 THEN 'B999' ELSE 'B311' END) AS rule_id,"
    " concat('x = \"', k, '\"') AS code_snippet, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS links FROM b",
)
_GOSEC = (
    "to_json(named_struct('Issues', array(named_struct('rule_id', element_at(array('G101', 'G204', 'G304', 'G501', 'G777'), int(k % 5 + 1)),"
    f" 'details', concat('detail ', k), 'severity', {_RAW_LEVEL}, 'confidence', {_RAW_TRUST}, 'file', concat('cmd/', w, '.go'),"
    " 'line', CASE n % 3 WHEN 0 THEN string(n) WHEN 1 THEN concat(n, '-', n + 4) ELSE 'x' END, 'code', 'c',"
    " 'cwe', CASE WHEN n % 2 = 0 THEN named_struct('url', 'https://c') END))))"
)
add(
    "ingest_gosec",
    lambda spark, sf_dir: I.ingest_gosec(A.reports(spark, sf_dir, _GOSEC)).select(
        "repo", "file", "antipattern", "antipattern_name", "severity", "confidence", "line_start", "line_end", "rule_id",
        F.size("references").alias("links"),
    ),
    "SELECT repo, concat('cmd/', w, '.go') AS file, CASE k % 5 WHEN 0 THEN 'hardcoded_secret' WHEN 1 THEN 'shell_injection_vector'"
    " WHEN 2 THEN 'path_traversal' WHEN 3 THEN 'weak_cryptography' ELSE 'security_issue' END AS antipattern, concat('detail ', k) AS antipattern_name,"
    f" {_LEVEL} AS severity, {_TRUST} AS confidence, CASE WHEN n % 3 < 2 AND n > 0 THEN n ELSE 1 END AS line_start,"
    " CASE WHEN n % 3 < 2 AND n > 0 THEN n ELSE 1 END AS line_end,"
    " concat('gosec/', CASE k % 5 WHEN 0 THEN 'G101' WHEN 1 THEN 'G204' WHEN 2 THEN 'G304' WHEN 3 THEN 'G501' ELSE 'G777' END) AS rule_id,"
    " CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS links FROM " + A.PARTS,
)
_LEAKS = (
    "to_json(array(named_struct('RuleID', CASE n % 3 WHEN 0 THEN 'generic-api-key' WHEN 1 THEN 'aws-key' END, 'Description', concat('d', k),"
    " 'File', concat('src/', w, '_', k, element_at(array('.py', '.TSX', '.go', '.md'), int(k % 4 + 1))),"
    " 'StartLine', CASE WHEN n % 2 = 0 THEN n END, 'EndLine', CASE WHEN n % 4 = 0 THEN n + 3 END)))"
)
add(
    "ingest_gitleaks",
    lambda spark, sf_dir: I.ingest_gitleaks(A.reports(spark, sf_dir, _LEAKS)).select(
        "repo", "file", "language", "language_pack", "severity", "confidence", "rule_id", "line_start", "line_end"
    ),
    "SELECT repo, concat('src/', w, '_', k, CASE k % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' ELSE '.go' END) AS file,"
    " CASE k % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END AS language,"
    " CASE k % 4 WHEN 0 THEN 'python_v1' WHEN 1 THEN 'typescript_v1' ELSE 'go_v1' END AS language_pack, 'critical' AS severity,"
    " CASE WHEN n % 3 = 0 THEN 0.75::DOUBLE ELSE 0.95::DOUBLE END AS confidence,"
    " CASE n % 3 WHEN 0 THEN 'generic-api-key' WHEN 1 THEN 'aws-key' ELSE 'gitleaks/secret' END AS rule_id,"
    " CASE WHEN n % 2 = 0 THEN n ELSE 1 END AS line_start, CASE WHEN n % 4 = 0 THEN n + 3 WHEN n % 2 = 0 THEN n ELSE 1 END AS line_end"
    " FROM " + A.PARTS + " WHERE k % 4 <> 3",
)
_OSV = (
    "to_json(named_struct('results', array(named_struct('source', CASE WHEN n % 5 <> 0 THEN named_struct('path', concat('deps/', w)) END,"
    " 'packages', array(named_struct('package', named_struct('name', w, 'version', string(n), 'ecosystem', element_at(array('npm', 'PyPI', 'Node'), n % 3 + 1)),"
    " 'vulnerabilities', array(named_struct('id', concat('V-', k), 'database_specific', CASE WHEN n % 2 = 0 THEN named_struct('severity',"
    " element_at(array('9.8', '7.1', '4.0', '1.5', 'HIGH'), int(k % 5 + 1))) END,"
    " 'severity', CASE WHEN n % 4 = 1 THEN array(named_struct('score', '8.0')) END, 'references', array(named_struct('url', 'https://v'))))))))))"
)
_OSV_LEVEL = (
    "CASE WHEN n % 2 = 0 THEN CASE k % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE {word} END"
    " WHEN n % 4 = 1 THEN 'high' ELSE 'medium' END"
)


def _osv_oracle(language: str, word: str, where: str, missing: str) -> str:
    return (
        f"SELECT repo, CASE WHEN n % 5 <> 0 THEN concat('deps/', w) ELSE '{missing}' END AS file, '{language}' AS language,"
        f" {_OSV_LEVEL.format(word=repr(word))} AS severity, concat('osv/V-', k) AS rule_id,"
        f" concat(w, '@', n, ' is affected by V-', k) AS message, concat('security dependencies V-', k) AS tags FROM {A.PARTS} WHERE {where}"
    )


for _name, _lang, _words, _where, _missing in (
    ("ingest_osv_python", "python", False, "true", ""),
    ("ingest_osv_typescript", "typescript", False, "n % 3 <> 1", "package-lock.json"),
    ("ingest_osv_words", "python", True, "true", ""),
):
    add(
        _name,
        lambda spark, sf_dir, la=_lang, wo=_words: I.ingest_osv(A.reports(spark, sf_dir, _OSV), la, wo).select(
            "repo", "file", "language", "severity", "rule_id", "message", F.array_join("tags", " ").alias("tags")
        ),
        _osv_oracle(_lang, "high" if _words else "low", _where, _missing),
    )
_PIP = (
    "to_json(named_struct('dependencies', array(named_struct('name', w, 'version', string(n), 'vulns',"
    " transform(slice(sequence(1, 10), 1, n % 3), i -> named_struct('id', concat('P', k, '-', i), 'description', 'bad',"
    " 'fix_versions', array('1.0', string(k)), 'link', 'https://p'))))))"
)
add(
    "ingest_pip_audit",
    lambda spark, sf_dir: I.ingest_pip_audit(A.reports(spark, sf_dir, _PIP)).select(
        "repo", "file", "severity", "rule_id", "message", "remediation"
    ),
    "SELECT repo, 'requirements.txt' AS file, 'high' AS severity, concat('pip-audit/P', k, '-', i) AS rule_id,"
    " concat(w, '==', n, ' is vulnerable: P', k, '-', i, ' - bad') AS message, concat('Upgrade ', w, ' to 1.0 or ', k, ' or later.') AS remediation"
    f" FROM (SELECT *, unnest(range(1, n % 3 + 1)) AS i FROM {A.PARTS})",
)
_NPM = (
    "concat('{\"vulnerabilities\":{\"', w, '-', k, '\":{\"severity\":\"', element_at(array('critical', 'moderate', 'low', 'odd'), n % 4 + 1), '\"',"
    " CASE n % 3 WHEN 0 THEN concat(',\"title\":\"t', k, '\"') ELSE '' END, ',\"via\":[',"
    " CASE WHEN n % 2 = 0 THEN '{\"title\":\"via\",\"url\":\"https://n\"},\"plain\"' ELSE '\"plain\"' END, '],\"fixAvailable\":',"
    " element_at(array('true', 'false', '{\"name\":\"x\"}'), int(k % 3 + 1)), '}}}')"
)
add(
    "ingest_npm_audit",
    lambda spark, sf_dir: I.ingest_npm_audit(A.reports(spark, sf_dir, _NPM)).select(
        "repo", "severity", "rule_id", "message", F.startswith("remediation", F.lit("Run")).alias("fixable"),
        F.array_join("references", " ").alias("links"),
    ),
    "SELECT repo, CASE n % 4 WHEN 0 THEN 'critical' WHEN 2 THEN 'low' ELSE 'medium' END AS severity, concat('npm-audit/', w, '-', k) AS rule_id,"
    " concat(w, '-', k, ' is vulnerable: ', CASE WHEN n % 3 = 0 THEN concat('t', k) WHEN n % 2 = 0 THEN 'via' ELSE 'see npm audit' END) AS message,"
    f" k % 3 <> 1 AS fixable, CASE WHEN n % 2 = 0 THEN 'https://n' ELSE '' END AS links FROM {A.PARTS}",
)
_VULN = (
    "concat('{\"config\":{}}\\n\\n{\"vulnerability\":{\"osv\":{\"id\":\"GO-', k, '\",\"summary\":\"',"
    " element_at(array('Remote Code run', 'Stack overflow', 'Denial of service', 'leak'), n % 4 + 1), '\"}}}\\n',"
    " CASE WHEN n % 3 = 0 THEN '{broken\\n' ELSE '' END, '{\"vulnerability\":{\"osv\":{\"id\":\"GX-', k, '\"}}}')"
)
_VULN_ORACLE = (
    "SELECT concat(repo, '/', k) AS repo, CASE n % 4 WHEN 0 THEN 'critical' WHEN 3 THEN 'medium' ELSE 'high' END AS severity,"
    f" concat('govulncheck/GO-', k) AS rule_id FROM {A.PARTS}"
    f" UNION ALL SELECT concat(repo, '/', k), 'medium', concat('govulncheck/GX-', k) FROM {A.PARTS}"
)


def _vuln_reports(spark, sf_dir):
    return A.reports(spark, sf_dir, f"struct(concat(repo, '/', k) AS r, {_VULN} AS j)").select(
        F.col("json.r").alias("repo"), F.col("json.j").alias("json")
    )


add(
    "ingest_govulncheck",
    lambda spark, sf_dir: I.ingest_govulncheck(_vuln_reports(spark, sf_dir)).select("repo", "severity", "rule_id"),
    _VULN_ORACLE,
)
add(
    "ingest_govulncheck_strict",
    lambda spark, sf_dir: I.ingest_govulncheck(_vuln_reports(spark, sf_dir), stop_at_bad_line=True).select("repo", "severity", "rule_id"),
    _VULN_ORACLE + " WHERE n % 3 <> 0",
)
add(
    "ingest_govulncheck_strict_shared_repo",
    # all reports of a repository side by side: a bad one ends at its own bad line
    lambda spark, sf_dir: I.ingest_govulncheck(
        _vuln_reports(spark, sf_dir).withColumn("repo", F.substring_index("repo", "/", 1)), stop_at_bad_line=True
    ).select("repo", "severity", "rule_id"),
    f"SELECT split_part(repo, '/', 1) AS repo, severity, rule_id FROM ({_VULN_ORACLE} WHERE n % 3 <> 0)",
)
add(
    "govulncheck_quarantine",
    lambda spark, sf_dir: I.govulncheck_quarantine(_vuln_reports(spark, sf_dir)),
    f"SELECT concat(repo, '/', k) AS repo, 3 AS at, '{{broken' AS line FROM {A.PARTS} WHERE n % 3 = 0",
)
_COVERAGE_SQL = (
    "SELECT source AS repo, concat('{{\"files\":{{\"src/', CASE WHEN doc_id % 7 = 0 THEN 'test_' ELSE 'mod_' END, doc_id, '.py\":{{\"summary\":{{',"
    " CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('\"percent_covered\":', n_chars % 101) END, '}}', CASE WHEN doc_id % 3 = 0 THEN '' ELSE"
    " ',\"missing_lines\":[1,2,3,4,5,6,7,8,9,10,11,12]' END, '}}}}}}') AS json FROM {documents}"
)
add(
    "ingest_coverage",
    lambda spark, sf_dir: I.ingest_coverage(A.run(spark, sf_dir, _COVERAGE_SQL, "documents")).select(
        "repo", "file", "severity", "message", "remediation"
    ),
    "SELECT source AS repo, concat('src/mod_', doc_id, '.py') AS file, CASE WHEN n_chars % 101 < 20 THEN 'high' ELSE 'medium' END AS severity,"
    " concat('Tests cover ', n_chars % 101, '.0% of the file (threshold: 50%). Lines without a test: ',"
    " CASE WHEN doc_id % 3 = 0 THEN 'undefined' ELSE '1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12' END) AS message,"
    " concat('Write tests for the logic and the error paths, first for lines ', CASE WHEN doc_id % 3 = 0 THEN '' ELSE '1, 2, 3, 4, 5, 6, 7, 8, 9, 10' END)"
    " AS remediation FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND n_chars % 101 < 50",
)
add(
    "union_findings",
    lambda spark, sf_dir: I.union_findings(
        I.ingest_bandit(A.reports(spark, sf_dir, _BANDIT)), I.ingest_gosec(A.reports(spark, sf_dir, _GOSEC)),
        I.ingest_npm_audit(A.reports(spark, sf_dir, _NPM)),
    ).groupBy("repo", "tool", "category", "language").agg(F.count("*").alias("n")),
    f"SELECT repo, 'bandit' AS tool, 'security' AS category, 'python' AS language, count(*) AS n FROM {A.PARTS} GROUP BY 1"
    f" UNION ALL SELECT repo, 'gosec', 'security', 'go', count(*) FROM {A.PARTS} GROUP BY 1"
    f" UNION ALL SELECT repo, 'npm-audit', 'dependencies', 'typescript', count(*) FROM {A.PARTS} GROUP BY 1",
)


# Findings: filters and counts

_KEYS = ("repo", "id")
add(
    "severity_rank",
    lambda spark, sf_dir: A.findings(spark, sf_dir).select(
        *_KEYS, severity_rank("severity").alias("rank"), at_or_above("severity", "medium").alias("at_or_above")
    ),
    FOUND + f"SELECT repo, id, {RANK} AS rank, {RANK} <= 2 AS at_or_above FROM findings",
)
add(
    "severity_at_or_above",
    lambda spark, sf_dir: A.findings(spark, sf_dir).filter(at_or_above("severity", "high")).groupBy("repo").agg(F.count("*").alias("n")),
    FOUND + "SELECT repo, count(*) AS n FROM findings WHERE severity IN ('critical', 'high') GROUP BY 1",
)
add(
    "filter_confidence",
    lambda spark, sf_dir: O.filter_confidence(A.findings(spark, sf_dir), 0).select(*_KEYS),
    FOUND + "SELECT repo, id FROM findings WHERE confidence >= 0.7::DOUBLE",
)
add(
    "filter_severity",
    lambda spark, sf_dir: O.filter_severity(A.findings(spark, sf_dir), "medium").select(*_KEYS),
    FOUND + f"SELECT repo, id FROM findings WHERE {RANK} <= 2",
)
add(
    "filter_severity_unknown",
    lambda spark, sf_dir: O.filter_severity(A.findings(spark, sf_dir), "fatal").select(*_KEYS),
    FOUND + "SELECT repo, id FROM findings WHERE false",
)
add(
    "filter_editor",
    lambda spark, sf_dir: O.filter_editor(A.findings(spark, sf_dir), "low", 0.5).select(*_KEYS).unionByName(
        O.filter_editor(A.findings(spark, sf_dir), "odd", 0.9).select(*_KEYS)
    ),
    FOUND + f"SELECT repo, id FROM findings WHERE {RANK} <= 3 AND confidence >= 0.5::DOUBLE"
    f" UNION ALL SELECT repo, id FROM findings WHERE {RANK} <= 2 AND confidence >= 0.9::DOUBLE",
)
add(
    "filter_paths",
    lambda spark, sf_dir: O.filter_paths(A.findings(spark, sf_dir), ["tests/**", "/vendor/*", "**"]).select(*_KEYS),
    FOUND + "SELECT repo, id FROM findings WHERE NOT (starts_with(file, 'tests') OR contains(file, '/tests'))"
    " AND NOT (starts_with(file, 'vendor') OR contains(file, '/vendor'))",
)
_PATTERNS = "SELECT DISTINCT concat('repo', user_id % 20) AS repo, CASE WHEN user_id % 2 = 0 THEN 'src/*' ELSE '**' END AS pattern FROM {events}"
add(
    "filter_paths_per_repo",
    lambda spark, sf_dir: O.filter_paths(A.findings(spark, sf_dir), A.run(spark, sf_dir, _PATTERNS, "events")).select(*_KEYS),
    FOUND + ", p AS (" + _PATTERNS.format(events="events") + ") SELECT repo, id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.repo = f.repo"
    " AND p.pattern = 'src/*' AND (starts_with(f.file, 'src') OR contains(f.file, '/src')))",
)
add(
    "filter_category",
    lambda spark, sf_dir: O.filter_category(A.findings(spark, sf_dir), ["security"]).select(*_KEYS),
    FOUND + "SELECT repo, id FROM findings WHERE category = 'security'",
)


def _broken(spark, sf_dir):
    f = A.findings(spark, sf_dir)
    e = F.col("event_id")
    return (
        f.withColumn("severity", F.when(e % 11 == 0, "fatal").otherwise(F.col("severity")))
        .withColumn("confidence", F.when(e % 13 == 0, 1.5).otherwise(F.col("confidence")))
        .withColumn("line_start", F.when(e % 17 == 0, 0).otherwise(F.col("line_start")))
        .withColumn("line_end", F.when(e % 19 == 0, -1).otherwise(F.col("line_end")))
        .withColumn("message", F.when(e % 23 == 0, F.lit(None)).otherwise(F.col("message")))
    )


_CHECKS = {
    **{f"{c} is set": "0" for c in O.REQUIRED_COLUMNS},
    "message is set": "count(*) FILTER (event_id % 23 = 0)",
    "severity is known": "count(*) FILTER (event_id % 11 = 0)",
    "category is known": "0",
    "effort is known": "0",
    "confidence in 0..1": "count(*) FILTER (event_id % 13 = 0)",
    "line_start above 0": "count(*) FILTER (event_id % 17 = 0)",
    "line_end not before line_start": "count(*) FILTER (CASE WHEN event_id % 19 = 0 THEN -1 ELSE line_end END"
    " < CASE WHEN event_id % 17 = 0 THEN 0 ELSE line_start END)",
}
add(
    "validate_findings",
    lambda spark, sf_dir: O.validate_findings(_broken(spark, sf_dir)),
    FOUND + " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", CAST({sql} AS BIGINT) AS violations FROM findings" for name, sql in _CHECKS.items()
    ).replace("CAST(0 AS BIGINT) AS violations FROM findings", "CAST(0 AS BIGINT) AS violations"),
)


def _flat(summary: DataFrame) -> DataFrame:
    return summary.select(
        "repo", "total",
        *[F.try_element_at("by_severity", F.lit(s)).alias(s) for s in ("critical", "high", "medium", "low", "info")],
        F.array_join(F.transform(F.array_sort(F.map_entries("by_category")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("categories"),
        F.array_join(F.transform(F.array_sort(F.map_entries("by_language")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("languages"),
        "files_affected",
    )


def _summary_sql(source: str = "findings") -> str:
    return (
        "SELECT repo, count(*) AS total, "
        + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
        + f", (SELECT string_agg(concat(category, '=', n), ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM {source} x WHERE x.repo = t.repo GROUP BY 1)) AS categories"
        f", (SELECT string_agg(concat(language, '=', n), ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM {source} x WHERE x.repo = t.repo GROUP BY 1)) AS languages"
        f", count(DISTINCT file) AS files_affected FROM {source} t GROUP BY repo"
    )


add("build_summary", lambda spark, sf_dir: _flat(O.build_summary(A.findings(spark, sf_dir))), FOUND + _summary_sql())
add(
    "summary_sets",
    lambda spark, sf_dir: O.summary_sets(A.findings(spark, sf_dir)),
    FOUND + " UNION ALL ".join(
        f"SELECT repo, '{d}' AS dimension, {v} AS value, count(*) AS n FROM findings GROUP BY ALL"
        for d, v in (("total", "'total'"), ("severity", "severity"), ("category", "category"), ("language", "language"))
    ),
)
add(
    "gate_fail",
    lambda spark, sf_dir: O.gate_fail(A.findings(spark, sf_dir), "critical"),
    FOUND + "SELECT repo, count(*) FILTER (severity = 'critical') AS blocking, count(*) FILTER (severity = 'critical') > 0 AS failed FROM findings GROUP BY 1",
)
add(
    "gate_fail_none",
    lambda spark, sf_dir: O.gate_fail(A.findings(spark, sf_dir), "none"),
    FOUND + "SELECT repo, CAST(0 AS BIGINT) AS blocking, false AS failed FROM findings GROUP BY 1",
)
add(
    "scan_outputs",
    lambda spark, sf_dir: O.scan_outputs(A.findings(spark, sf_dir), "out/"),
    FOUND + "SELECT repo, count(*) AS findings_count, count(*) FILTER (severity = 'critical') AS critical_count,"
    " count(*) FILTER (severity = 'high') AS high_count, concat('out/repo=', repo) AS report_path FROM findings GROUP BY 1",
)
add(
    "scan_complete",
    lambda spark, sf_dir: O.scan_complete(A.findings(spark, sf_dir)),
    FOUND + "SELECT count(DISTINCT concat(repo, '|', file)) AS file_count, count(*) AS total_findings FROM findings",
)
_META = dict(sha="abcdef0123456", ref="main", run_id="77", run_number="7", actor="me", event="push",
             languages_detected=["python", "go"], scanned_at="2024-01-01 00:00:00", scan_duration_ms=1500)


def _meta(spark, sf_dir):
    return scan_meta(A.findings(spark, sf_dir).select("repo").distinct(), **_META)


add(
    "scan_meta",
    lambda spark, sf_dir: _meta(spark, sf_dir).select(
        "repo", "sha", "ref", "run_id", "actor", F.array_join("languages_detected", ",").alias("languages"), "scan_duration_ms", "scanned_at"
    ),
    FOUND + "SELECT DISTINCT repo, 'abcdef0123456' AS sha, 'main' AS ref, '77' AS run_id, 'me' AS actor, 'python,go' AS languages,"
    " CAST(1500 AS BIGINT) AS scan_duration_ms, TIMESTAMP '2024-01-01 00:00:00' AS scanned_at FROM findings",
)


@query("write_report", FOUND + "SELECT repo, count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(line_start) AS BIGINT) AS lines FROM findings GROUP BY 1")
def _(spark, sf_dir):
    path = fresh_path(spark, "report")
    write_report(A.findings(spark, sf_dir).drop("event_id", "user_id"), _meta(spark, sf_dir), path)
    back = spark.read.schema("repo string, id string, line_start int").json(f"{path}/findings")
    return back.groupBy("repo").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("line_start").alias("lines"))


@query("write_report_parquet", FOUND + _summary_sql())
def _(spark, sf_dir):
    path = fresh_path(spark, "report")
    write_report(A.findings(spark, sf_dir).drop("event_id", "user_id"), _meta(spark, sf_dir), path, "parquet")
    return _flat(spark.read.parquet(f"{path}/summary"))


# Findings: rendered and grouped

add(
    "severity_table",
    lambda spark, sf_dir: V.severity_table(O.build_summary(A.findings(spark, sf_dir))),
    FOUND + " UNION ALL ".join(
        f"SELECT repo, {i} AS row_no, concat('| {V.SEVERITY_MARKS[s]} {s.capitalize()} | **', count(*) FILTER (severity = '{s}'), '** |') AS \"row\" FROM findings GROUP BY repo"
        for i, s in enumerate(("critical", "high", "medium", "low", "info"))
    ) + " UNION ALL SELECT repo, 5, concat('| **Total** | **', count(*), '** |') FROM findings GROUP BY repo",
)
_TITLE = "array_to_string(list_transform(string_split(category, '_'), lambda x: concat(upper(x[1]), x[2:])), ' ')"
_CUT = "CASE WHEN length(file) > 40 THEN concat('...', right(file, 37)) ELSE file END"
add(
    "category_tables",
    lambda spark, sf_dir: V.category_tables(A.findings(spark, sf_dir)).select("repo", "category", "rank", "line_start", "id", "row"),
    FOUND + f"SELECT repo, category, -1 AS rank, 0 AS line_start, '' AS id, concat('### ', {_TITLE}, ' (', count(*), ')') AS \"row\" FROM findings GROUP BY repo, category"
    f" UNION ALL SELECT repo, category, {RANK}, line_start, id, concat('| ', {MARK}, ' ', severity, ' | ', antipattern_name, ' | `', {_CUT}, '` | ', line_start,"
    f" ' | ', {EFFORT}, ' ', effort, ' |') FROM findings",
)
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, line_start, rule_id, id) AS position FROM findings WHERE severity IN ('critical', 'high')) WHERE position <= 10) "
add(
    "top_findings",
    lambda spark, sf_dir: O.top_findings(A.findings(spark, sf_dir)).select("repo", "id", "position"),
    FOUND + ", " + _TOP + "SELECT repo, id, CAST(position AS INTEGER) AS position FROM top",
)
add(
    "top_finding_text",
    lambda spark, sf_dir: V.top_finding_text(O.top_findings(A.findings(spark, sf_dir))).select("repo", "id", "text"),
    FOUND + ", " + _TOP + f"SELECT repo, id, concat('<details>', chr(10), '<summary>', {MARK}, ' <strong>', antipattern_name, '</strong> -- `', file, ':', line_start,"
    " '`</summary>', chr(10), chr(10), '**Message:** ', message, chr(10), chr(10), '**Remediation:** ', remediation, chr(10), chr(10),"
    " CASE WHEN code_snippet <> '' THEN concat('```', language, chr(10), code_snippet, chr(10), '```', chr(10)) ELSE '' END,"
    f" '**Confidence:** ', {PCT}, '% | **Effort:** ', {EFFORT}, ' ', effort, chr(10), '</details>') AS text FROM top",
)
_ISSUE_TITLE = "concat('[', upper(severity), '] ', antipattern_name, ' in `', file, '`')"
_GROUPS = (
    f"grp AS (SELECT repo, antipattern, file, count(*) AS locations, arg_min({_ISSUE_TITLE}, struct_pack(a := line_start, b := rule_id, c := id)) AS title,"
    " arg_min(id, struct_pack(a := line_start, b := rule_id, c := id)) AS first_id, arg_min(category, struct_pack(a := line_start, b := rule_id, c := id)) AS category,"
    " arg_min(severity, struct_pack(a := line_start, b := rule_id, c := id)) AS severity FROM findings GROUP BY 1, 2, 3) "
)
add(
    "group_issues",
    lambda spark, sf_dir: O.group_issues(A.findings(spark, sf_dir)).select(
        "repo", "antipattern", "file", "title", F.col("id").alias("first_id"), F.array_join("labels", ",").alias("labels"), "locations"
    ),
    FOUND + ", " + _GROUPS + "SELECT repo, antipattern, file, title, first_id, concat('antipattern,', category, ',severity:', severity) AS labels, locations FROM grp",
)
_OPEN = "SELECT DISTINCT repo, title FROM grp WHERE length(file) % 2 = 0"
add(
    "dedup_issues",
    lambda spark, sf_dir: (
        lambda g: O.dedup_issues(g, g.filter(F.length("file") % 2 == 0).select("repo", "title")).select("repo", "antipattern", "file")
    )(O.group_issues(A.findings(spark, sf_dir))),
    FOUND + ", " + _GROUPS + f", opened AS ({_OPEN}) SELECT repo, antipattern, file FROM grp g WHERE NOT EXISTS (SELECT 1 FROM opened o WHERE o.repo = g.repo AND o.title = g.title)",
)
_LOC = "concat('- [ ] [`', file, ':', line_start, '`](../../blob/HEAD/', file, '#L', line_start, ') -- ', message)"
_BODY_SQL = (
    ", pos AS (SELECT *, row_number() OVER (PARTITION BY repo, antipattern, file ORDER BY line_start, rule_id, id) AS position,"
    " count(*) OVER (PARTITION BY repo, antipattern, file) AS locations FROM findings),"
    " lines AS (SELECT repo, antipattern, file, (position - 1) // 500 AS part, any_value((locations - 1) // 500) AS last_part,"
    f" string_agg({_LOC}, chr(10) ORDER BY position) AS body FROM pos GROUP BY 1, 2, 3, 4),"
    f" rep AS (SELECT repo, antipattern, file, {_ISSUE_TITLE} AS title,"
    f" concat('## ', {MARK}, ' ', antipattern_name, chr(10), chr(10), '**Category:** `', category, '` | **Language:** `', language, '` | **Severity:** `', severity, '`', chr(10),"
    f" '**Confidence:** ', {PCT}, '% | **Estimated Effort:** ', {EFFORT}, ' ', effort, chr(10), chr(10), '---', chr(10), chr(10), '### Affected Locations', chr(10)) AS head,"
    " concat(chr(10), '### What is this anti-pattern?', chr(10), chr(10), message, chr(10), chr(10), '### Remediation', chr(10), chr(10), remediation, chr(10),"
    " CASE WHEN code_snippet <> '' THEN concat(chr(10), '### Offending Code', chr(10), chr(10), '```', language, chr(10), code_snippet, chr(10), '```', chr(10)) ELSE '' END,"
    " CASE WHEN link IS NOT NULL THEN concat(chr(10), '### References', chr(10), chr(10), '- ', link, chr(10), '- ', link, '/b', chr(10)) ELSE '' END,"
    " chr(10), '---', chr(10), '> lintlake - Rule: `', rule_id, '` - Pack: `', language_pack, '`') AS tail FROM pos WHERE position = 1)"
    " SELECT repo, antipattern, file, title, CAST(part AS INTEGER) AS part, md5(concat(CASE WHEN part = 0 THEN concat(head, chr(10)) ELSE '' END, body,"
    " CASE WHEN part = last_part THEN concat(chr(10), tail) ELSE '' END)) AS body FROM lines JOIN rep USING (repo, antipattern, file)"
)
add(
    "issue_body",
    lambda spark, sf_dir: (
        lambda f: V.issue_body(O.group_issues(f), f).withColumn("body", F.md5("body"))
    )(A.findings(spark, sf_dir)),
    FOUND + _BODY_SQL,
)
add(
    "pr_candidates",
    lambda spark, sf_dir: (
        lambda f: O.pr_candidates(f, f.filter("user_id % 2 = 0").select("repo", "file")).select(*_KEYS)
    )(A.findings(spark, sf_dir)),
    FOUND + "SELECT repo, id FROM findings WHERE severity IN ('critical', 'high') AND user_id % 2 = 0",
)
_HUNKS = (
    "SELECT CASE WHEN o_custkey % 3 = 0 THEN 'mono' ELSE concat('repo', o_custkey % 20) END AS repo,"
    " concat(CASE o_custkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'very/long/directory/name/of/a/project/' ELSE 'lib/vendor/' END,"
    " 'user_', o_custkey, CASE o_custkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END) AS file,"
    " CAST(o_orderkey % 390 AS INT) AS start, CAST(o_orderkey % 390 + o_orderkey % 9 AS INT) AS {end} FROM {orders}"
)
add(
    "pr_changed_lines",
    lambda spark, sf_dir: O.pr_changed_lines(
        A.findings(spark, sf_dir), spark.sql(_HUNKS.replace("{end}", "`end`"), orders=A.table(spark, sf_dir, "orders"))
    ).select(*_KEYS),
    FOUND + ", hunks AS (" + _HUNKS.format(end='"end"', orders="orders") + ") SELECT repo, id FROM findings f WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.repo = f.repo"
    " AND h.file = f.file AND f.line_start BETWEEN h.start AND h.\"end\")",
)
add(
    "pr_comment_body",
    lambda spark, sf_dir: V.pr_comment_body(A.findings(spark, sf_dir)).select(*_KEYS, "body"),
    FOUND + f"SELECT repo, id, concat('### ', {MARK}, ' ', antipattern_name, chr(10), chr(10), message, chr(10), chr(10), '**[fix] Fix:** ', remediation, chr(10), chr(10),"
    f" '`', rule_id, '` - Confidence: ', {PCT}, '% - ', {EFFORT}, ' ', effort, ' to fix') AS body FROM findings",
)
add(
    "chat_payload",
    lambda spark, sf_dir: V.chat_payload(O.build_summary(A.findings(spark, sf_dir)), _meta(spark, sf_dir), "https://host.example"),
    FOUND + ", s AS (SELECT repo, count(*) AS total, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM findings GROUP BY 1)"
    " SELECT repo, concat('{\"blocks\":[{\"type\":\"header\",\"text\":{\"type\":\"plain_text\",\"text\":\"[scan] Anti-Pattern Scan: ', repo, '\"}},',"
    " '{\"type\":\"section\",\"fields\":[{\"type\":\"mrkdwn\",\"text\":\"*Total Findings:*\\n', total, '\"},{\"type\":\"mrkdwn\",\"text\":\"*Critical/High:*\\n', c + h,"
    " '\"},{\"type\":\"mrkdwn\",\"text\":\"*Branch:*\\n`main`\"},{\"type\":\"mrkdwn\",\"text\":\"*Languages:*\\npython, go\"}]},',"
    " CASE WHEN c > 0 THEN concat('{\"type\":\"section\",\"text\":{\"type\":\"mrkdwn\",\"text\":\"[crit] *', c, ' critical findings* require immediate attention.\"}},') ELSE '' END,"
    " '{\"type\":\"actions\",\"elements\":[{\"type\":\"button\",\"text\":{\"type\":\"plain_text\",\"text\":\"View Full Report\"},\"url\":\"https://host.example/', repo, '/actions/runs/77\",\"style\":\"',"
    " CASE WHEN c > 0 THEN 'danger' ELSE 'primary' END, '\"}]}]}') AS payload FROM s",
)
add(
    "agent_prompt",
    lambda spark, sf_dir: V.agent_prompt(A.findings(spark, sf_dir)).select(*_KEYS, "prompt"),
    FOUND + f"SELECT repo, id, concat('## Anti-Pattern Remediation Task', chr(10), chr(10), '**Anti-Pattern:** ', antipattern_name, chr(10), '**Category:** ', category, chr(10),"
    f" '**Severity:** ', severity, chr(10), '**Confidence:** ', {PCT}, '%', chr(10), '**Estimated Effort:** ', effort, chr(10), chr(10), '### Location', chr(10), '- File: `', file, '`', chr(10),"
    " '- Lines: ', line_start, '-', line_end, chr(10), '- Language: ', language, chr(10), chr(10), '### Problem', chr(10), message, chr(10), chr(10), '### Current Code', chr(10),"
    " '```', language, chr(10), coalesce(code_snippet, '(code snippet not available)'), chr(10), '```', chr(10), chr(10), '### Required Fix', chr(10), remediation, chr(10), chr(10),"
    " '### Constraints', chr(10), '- Touch nothing beyond this finding', chr(10), '- Callers must not notice a difference except where the finding is the difference', chr(10),"
    " '- Leave a test that fails without the change', chr(10), '- Rule: `', rule_id, '`',"
    " CASE WHEN link IS NOT NULL THEN concat(chr(10), chr(10), '### References', chr(10), '- ', link, chr(10), '- ', link, '/b') ELSE '' END) AS prompt FROM findings",
)
add(
    "editor_issue_body",
    lambda spark, sf_dir: V.editor_issue_body(A.findings(spark, sf_dir)).select(*_KEYS, "title", "body"),
    FOUND + f"SELECT repo, id, {_ISSUE_TITLE} AS title, concat('## ', antipattern_name, chr(10), chr(10), '**File:** `', file, ':', line_start, '`', chr(10), '**Severity:** ', severity, chr(10),"
    " '**Category:** ', category, chr(10), chr(10), '### Problem', chr(10), message, chr(10), chr(10), '### Fix', chr(10), remediation, chr(10), chr(10), '---', chr(10),"
    " '> lintlake - Rule: `', rule_id, '`') AS body FROM findings",
)
add(
    "to_diagnostics",
    lambda spark, sf_dir: V.to_diagnostics(A.findings(spark, sf_dir)),
    FOUND + "SELECT repo, file, id, line_start - 1 AS start_line, 0 AS start_character, line_end - 1 AS end_line, 9999 AS end_character,"
    " CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS severity, rule_id AS code, link AS href,"
    " 'antipattern (ast-checker)' AS source, concat(antipattern_name, ': ', message) AS message, CASE WHEN tag = 'dead_code' THEN 1 END AS tag FROM findings",
)
add(
    "fix_preview",
    lambda spark, sf_dir: V.fix_preview(
        A.findings(spark, sf_dir).withColumn(
            "antipattern",
            F.when(F.col("event_id") % 6 == 0, "mutable_default_argument").when(F.col("event_id") % 6 == 1, "wildcard_import").otherwise("other"),
        )
    ).select(*_KEYS, "original", "fixed"),
    FOUND + "SELECT repo, id, code_snippet AS original, CASE event_id % 6 WHEN 0 THEN concat('def f(x=None  # was: [], n=', event_id, '):')"
    " WHEN 1 THEN concat('from m', event_id, ' import SpecificName  # replace with actual names')"
    " ELSE concat('# Suggested fix:', chr(10), '# ', remediation, chr(10), chr(10), code_snippet) END AS fixed FROM findings WHERE code_snippet IS NOT NULL",
)
_WORST = "CASE min(" + RANK + ") WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"
add(
    "worst_by_file",
    lambda spark, sf_dir: O.worst_by_file(A.findings(spark, sf_dir)),
    FOUND + f"SELECT repo, file, count(*) AS findings, min({RANK}) AS worst_rank, {_WORST} AS worst FROM findings GROUP BY 1, 2",
)
add(
    "order_in_file",
    lambda spark, sf_dir: O.order_in_file(A.findings(spark, sf_dir)).select("repo", "file", "rank", "line_start", "id"),
    FOUND + f"SELECT repo, file, {RANK} AS rank, line_start, id FROM findings ORDER BY 1, 2, 3, 4, 5",
)
add(
    "dashboard_counts",
    lambda spark, sf_dir: O.dashboard_counts(A.findings(spark, sf_dir)),
    FOUND + "SELECT 'severity' AS dimension, s AS value, count(id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) v(s) LEFT JOIN findings ON severity = s GROUP BY 2"
    " UNION ALL SELECT 'category', category, count(*) FROM findings GROUP BY 2",
)
add(
    "dashboard_order",
    lambda spark, sf_dir: O.dashboard_order(A.findings(spark, sf_dir)).select("rank", "file", "repo", "line_start", "id"),
    FOUND + f"SELECT {RANK} AS rank, file, repo, line_start, id FROM findings ORDER BY 1, 2, 3, 4, 5",
)
add(
    "dashboard_search",
    lambda spark, sf_dir: O.dashboard_search(A.findings(spark, sf_dir), "critical", "security", "USER_1").select(*_KEYS).unionByName(
        O.dashboard_search(A.findings(spark, sf_dir), text="<99").select(*_KEYS)
    ),
    FOUND + "SELECT repo, id FROM findings WHERE severity = 'critical' AND category = 'security' AND contains(file, 'user_1')"
    " UNION ALL SELECT repo, id FROM findings WHERE contains(lower(message), '<99')",
)
add(
    "escape_html",
    lambda spark, sf_dir: A.findings(spark, sf_dir).select(*_KEYS, escape_html(F.col("message")).alias("message"), escape_html(F.col("antipattern_name")).alias("name")),
    FOUND + "SELECT repo, id, replace(replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS message,"
    " replace(replace(replace(replace(replace(antipattern_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS name FROM findings",
)
add(
    "format_category",
    lambda spark, sf_dir: A.findings(spark, sf_dir).select(*_KEYS, format_category(F.col("category")).alias("title"), truncate_left(F.col("file"), 15).alias("short")),
    FOUND + f"SELECT repo, id, {_TITLE} AS title, CASE WHEN length(file) > 15 THEN concat('...', right(file, 12)) ELSE file END AS short FROM findings",
)


# Thresholds


def _overrides(spark, sf_dir):
    return T.parse_overrides(A.run(spark, sf_dir, A.OVERRIDES_SQL, "supplier"))


_OVERRIDE_ROWS = (
    "ov AS (SELECT concat('s', s_suppkey) AS repo, 'code_structure' AS section, 'max_function_length' AS key, CAST(s_nationkey * 10 AS VARCHAR) AS value FROM supplier"
    " UNION ALL SELECT concat('s', s_suppkey), 'code_structure', 'max_nesting_depth', CAST(s_nationkey AS VARCHAR) FROM supplier"
    " UNION ALL SELECT concat('s', s_suppkey), 'code_structure', 'magic_number_allowed', concat('[0, 1, ', s_nationkey, ']') FROM supplier"
    " UNION ALL SELECT concat('s', s_suppkey), 'test_quality', 'min_coverage_percent', '12.5' FROM supplier WHERE s_suppkey % 2 = 0"
    " UNION ALL SELECT concat('s', s_suppkey), 'test_quality', 'note', 'a: b' FROM supplier WHERE s_suppkey % 2 = 0"
    " UNION ALL SELECT concat('s', s_suppkey), 'unknown', 'a', 'true' FROM supplier WHERE s_suppkey % 2 = 1"
    " UNION ALL SELECT concat('s', s_suppkey), CASE WHEN s_suppkey % 2 = 0 THEN 'test_quality' ELSE 'unknown' END, 'max_mock_calls', concat('-', s_nationkey) FROM supplier)"
)
add(
    "parse_overrides",
    lambda spark, sf_dir: _overrides(spark, sf_dir).select("repo", "section", "key", "value", T.value_type(F.col("value")).alias("type")),
    f"WITH {_OVERRIDE_ROWS} SELECT *, CASE WHEN starts_with(value, '[') THEN 'list' WHEN value = 'true' THEN 'boolean' WHEN value = 'a: b' THEN 'text' ELSE 'number' END AS type FROM ov",
)
_LANGS = "(VALUES ('python'), ('typescript'), ('go')) t(language)"
_LAYERS = (
    "base AS (SELECT * FROM " + values([(la, s, k, v) for la in ("python", "typescript", "go") for (s, k), v in T.BUILT_IN.items()]) + " b(language, section, key, value)),"
    " pack AS (SELECT * FROM " + values([(la, s, k, v) for la in ("typescript", "go") for (s, k), v in T.PACK_LAYER[la].items()]) + " p(language, section, key, value))"
)


def _repos(spark, sf_dir):
    return A.run(
        spark, sf_dir,
        "SELECT concat('s', s_suppkey) AS repo, explode(array('python', 'typescript', 'go')) AS language FROM {supplier}", "supplier",
    )


def _resolved(spark, sf_dir):
    base, pack = T.layer_rows(spark)
    return T.resolve_thresholds(_repos(spark, sf_dir), base, pack, _overrides(spark, sf_dir))


_RESOLVED = (
    f"WITH {_OVERRIDE_ROWS}, {_LAYERS}, rl AS (SELECT concat('s', s_suppkey) AS repo, language FROM supplier, {_LANGS}),"
    " al AS (SELECT repo, language, section, key, value, 0 AS layer FROM rl JOIN base USING (language)"
    " UNION ALL SELECT repo, language, section, key, value, 1 FROM rl JOIN pack USING (language)"
    " UNION ALL SELECT repo, language, section, key, value, 2 FROM rl JOIN ov USING (repo) WHERE section IN ('code_structure', 'test_quality', 'security')),"
    " res AS (SELECT repo, language, section, key, arg_max(value, layer) AS value, max(layer) AS layer FROM al GROUP BY 1, 2, 3, 4) "
)
add("resolve_thresholds", _resolved, _RESOLVED + "SELECT * FROM res")
add(
    "pivot_thresholds",
    lambda spark, sf_dir: T.pivot_thresholds(_resolved(spark, sf_dir)).select(
        "repo", "language", "max_function_length", "max_nesting_depth", "god_class_method_count", "min_coverage_percent"
    ),
    _RESOLVED + "SELECT repo, language, " + ", ".join(
        f"max(value) FILTER (key = '{k}') AS {k}" for k in ("max_function_length", "max_nesting_depth", "god_class_method_count", "min_coverage_percent")
    ) + " FROM res GROUP BY 1, 2",
)


def _limited_rule(spark, sf_dir):
    """A rule with limits that differ by repository: each brand has its own depth."""
    plant = BY_RULE["go/deep-nesting"]
    part = A.table(spark, sf_dir, "part")
    limits = part.select(
        F.col("p_brand").alias("repo"), F.lit("go").alias("language"),
        (F.length("p_brand") - 1).cast("string").alias("max_nesting_depth"),
    ).distinct()
    return rules_go.deep_nesting(R.code_rows(planted(part, plant), "go"), limits).select("repo", "file", "severity", "line_end")


add(
    "rule_with_repo_limits",
    _limited_rule,
    "SELECT p_brand AS repo, concat('src/part_', p_partkey, '.go') AS file, CASE WHEN p_size % 9 >= length(p_brand) + 1 THEN 'high' ELSE 'medium' END AS severity,"
    " CAST(2 * (p_size % 9) + 5 AS INTEGER) AS line_end FROM part WHERE p_size % 9 >= length(p_brand) - 1",
)


# Streams

_SAVES = "WITH saves AS (" + A.SAVES_SQL.format(events="events") + "), "
_BURSTS = (
    "b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS fresh FROM saves WINDOW w AS (PARTITION BY repo, uri ORDER BY ts)),"
    " g AS (SELECT *, sum(fresh) OVER (PARTITION BY repo, uri ORDER BY ts, event_id) AS burst FROM b),"
    " d AS (SELECT repo, uri, max(ts) AS ts, arg_max(content, ts) AS content, count(*) AS saves FROM g GROUP BY repo, uri, burst) "
)


def _saves(spark, sf_dir):
    return A.run(spark, sf_dir, A.SAVES_SQL, "events")


SAVES_PER_FILE = 100_000


def _saves_stream(spark, sf_dir, batches=4):
    """The saves as a stream of several batches, each a stretch of time in no order. A user's saves of
    a stretch are in one file, and files grow in number with the saves."""
    events = A.table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last, n = events.agg(F.min(at), F.max(at), F.count("*")).first()
    stretch = F.floor((at - F.lit(first)) * batches / F.lit(last - first + 1))
    path, files = fresh_path(spark, "saves"), max(1, n // (batches * SAVES_PER_FILE))
    for i in range(batches):
        events.filter(stretch == i).repartition(files, "user_id").write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.selectExpr(
        "concat('repo', user_id % 5) AS repo", "concat('src/u', user_id, '.py') AS uri", "ts", "concat('x = ', event_id) AS content"
    )


add(
    "debounce_saves",
    lambda spark, sf_dir: ST.debounce_saves(_saves(spark, sf_dir), "90 minutes"),
    _SAVES + _BURSTS + "SELECT * FROM d",
)


@query("debounce_saves_stream", _SAVES + _BURSTS + "SELECT * FROM d")
def _(spark, sf_dir):
    path, state = fresh_path(spark, "bursts"), fresh_path(spark, "bursts-state")
    bursts = ST.debounce_saves(_saves_stream(spark, sf_dir), "90 minutes")
    ST.start_available(
        bursts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", state)
    ).awaitTermination()
    # the newest burst of a file waits for the clock
    return spark.read.schema(bursts.schema).parquet(path).unionByName(ST.open_bursts(spark, state))


@query(
    "scan_stream",
    "WITH s AS (SELECT concat('repo', user_id % 5) AS repo, concat('src/u', user_id, '.py') AS uri, arg_max(event_id, ts) AS e FROM events GROUP BY 1, 2)"
    " SELECT repo, uri AS file, CAST(1 + i AS INTEGER) AS line_start, 'python/eval-usage' AS rule_id FROM (SELECT *, unnest(range(0, e % 3 + 1)) AS i FROM s)",
)
def _(spark, sf_dir):
    stream = (
        spark.readStream.schema(A.table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ).selectExpr(
        "concat('repo', user_id % 5) AS repo", "concat('src/u', user_id, '.py') AS uri", "ts",
        "concat('x = eval(', event_id, ')', repeat('\\nexec(y)', cast(event_id % 3 as int))) AS content",
    )
    path = fresh_path(spark, "log")
    ST.scan_stream(stream, path, fresh_path(spark, "log-state"), "high").awaitTermination()
    log = spark.read.parquet(f"{path}/findings")
    scans = spark.read.parquet(f"{path}/scans")
    return ST.latest_findings(log, scans).select("repo", "file", "line_start", "rule_id")



@query(
    "latest_findings",
    FOUND + ", log AS (SELECT *, event_id // 700 AS scan_id FROM findings WHERE severity <> 'info'), sc AS (SELECT DISTINCT repo, file, event_id // 700 AS scan_id FROM findings),"
    " last AS (SELECT repo, file, max(scan_id) AS scan_id FROM sc GROUP BY 1, 2)"
    " SELECT log.repo, log.id FROM log JOIN last USING (repo, file, scan_id) WHERE NOT (repo = 'mono' AND scan_id <= 9)",
)
def _(spark, sf_dir):
    rows = A.findings(spark, sf_dir).withColumn("scan_id", F.floor(F.col("event_id") / 700))
    log = rows.filter("severity <> 'info'")
    scans = rows.select("repo", "file", "scan_id", F.lit(False).alias("cleared")).distinct()
    clears = rows.filter("repo = 'mono'").select("repo").distinct().select(
        "repo", F.lit(None).cast("string").alias("file"), F.lit(9).cast("long").alias("scan_id"), F.lit(True).alias("cleared")
    )
    return ST.latest_findings(log, scans.unionByName(clears)).select("repo", "id")


_CFG = "cfg AS (" + A.CONFIG_SQL.format(events="events") + ")"
add(
    "apply_config",
    lambda spark, sf_dir: ST.apply_config(_saves(spark, sf_dir), A.run(spark, sf_dir, A.CONFIG_SQL, "events")).select(
        "repo", "event_id", "severityThreshold", "confidenceThreshold"
    ),
    _SAVES + _CFG + ", n AS (SELECT repo, arg_max(value, ts) FILTER (key = 'enabled') AS enabled, arg_max(value, ts) FILTER (key = 'severityThreshold') AS sev FROM cfg GROUP BY 1)"
    " SELECT repo, event_id, coalesce(sev, 'medium') AS severityThreshold, '0.7' AS confidenceThreshold FROM saves LEFT JOIN n USING (repo) WHERE coalesce(enabled, 'true') = 'true'",
)


# Extension


def _user_rule(spark, sf_dir):
    """A rule registered as SQL text: calls of ``go`` in planted TypeScript."""
    plant = BY_RULE["ts/deep-nesting"]
    name = "user/go-call"
    registry.unregister_rule(name)
    registry.register_sql_rule(
        name, "typescript",
        "SELECT repo, path, line, idx AS ordinal FROM {code} WHERE tok = 'go' AND n1 = '('",
        antipattern="go_call", name="Go Call", message="go() is called", remediation="do not", severity="low",
    )
    try:
        rows = R.code_rows(planted(A.table(spark, sf_dir, "part"), plant), "typescript")
        (found,) = registry.apply_user_rules(rows, "typescript")
    finally:
        registry.unregister_rule(name)
    return found.select("repo", "file", "rule_id", "severity", "line_start")


add(
    "register_rule",
    _user_rule,
    f"SELECT repo, {_TS_PATH} AS file, 'user/go-call' AS rule_id, 'low' AS severity, CAST(d + 2 AS INTEGER) AS line_start FROM {_NEST}",
)


@query("source_nodes_udtf", f"SELECT repo, path, CAST(loops AS BIGINT) AS loops FROM {_PYCOG}")
def _(spark, sf_dir):
    registry.register_functions(spark)
    # a table function runs where its rows are, so files are spread over the tasks first
    src = R.by_file(planted(A.table(spark, sf_dir, "part"), BY_RULE["python/cognitive-complexity"]))
    return spark.sql(
        "SELECT repo, path, count(*) AS loops FROM {src}, LATERAL source_nodes(path, content) WHERE kind = 'For' GROUP BY repo, path",
        src=src,
    )


# Whole runs


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources -> secrets -> findings -> filters -> a summary row for every repository."""
    src = A.source_files(spark, sf_dir)
    found = O.filter_severity(O.filter_confidence(label_by_pack(leaks_to_findings(scan_secrets(src))), 0.7), "low")
    return _flat(O.summary_for_all(src, O.build_summary(found)))


add(
    "flagship_secret_summary",
    flagship,
    _secret_oracle() + f", f AS (SELECT repo, path AS file, {_EXT} AS e FROM hits WHERE {_EXT} IN ('.py', '.go', '.ts', '.js')),"
    " g AS (SELECT repo, file, CASE WHEN e = '.py' THEN 'python' WHEN e = '.go' THEN 'go' ELSE 'typescript' END AS language FROM f),"
    " s AS (SELECT repo, count(*) AS total, count(DISTINCT file) AS files, (SELECT string_agg(concat(language, '=', n), ',' ORDER BY language) FROM"
    " (SELECT language, count(*) AS n FROM g x WHERE x.repo = t.repo GROUP BY 1)) AS languages FROM g t GROUP BY repo)"
    " SELECT r.repo, coalesce(total, 0) AS total, coalesce(total, 0) AS critical, CAST(0 AS BIGINT) AS high, CAST(0 AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low,"
    " CAST(0 AS BIGINT) AS info, CASE WHEN total > 0 THEN concat('security=', total) ELSE '' END AS categories, coalesce(languages, '') AS languages,"
    " coalesce(files, 0) AS files_affected FROM (SELECT DISTINCT repo FROM src) r LEFT JOIN s USING (repo)",
)


def _scan_all(language: str, rule_ids: tuple):
    """All rules of a language over several plants at once, by one shared relation."""

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = A.table(spark, sf_dir, "part")
        src = None
        for rule_id in rule_ids:
            one = planted(part, BY_RULE[rule_id]).withColumn("repo", F.lit(rule_id.replace("/", "_")))
            src = one if src is None else src.unionByName(one)
        found = scan(src, languages=(language,), categories=["code_structure"])
        return found.groupBy("repo", "rule_id", "severity").agg(F.count("*").alias("n"))

    return fn


_SCAN_PYTHON = ("python/eval-usage", "python/wildcard-import", "python/isinstance-chain")
add(
    "scan_python",
    _scan_all("python", _SCAN_PYTHON),
    "SELECT repo, rule_id, severity, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT '{r.replace('/', '_')}' AS repo, rule_id, severity FROM ({expected_sql(BY_RULE[r])})" for r in _SCAN_PYTHON
    )
    # `exec` and `eval` plants hold nothing else; the chain of 7 branches and more nests too deep
    + " UNION ALL SELECT 'python_isinstance-chain', 'x', 'x' FROM part WHERE false) GROUP BY 1, 2, 3",
)


# A run with all its runners: rules, metrics, a tool's report, snippets, files that do not parse.
_RUN_SOURCE = (
    "CASE WHEN p_size % 5 = 0 THEN 'def f(:\\n' ELSE concat('from a', p_partkey, ' import *\\nx = eval(y)\\ndef g(z):\\n',"
    " repeat('    z()\\n', p_size + 20)) END"
)


@query(
    "full_scan",
    "WITH s AS (SELECT p_brand AS repo, concat('src/part_', p_partkey, '.py') AS file, p_partkey AS k, p_size AS n FROM part),"
    " b AS (SELECT * FROM s WHERE n % 5 > 0),"
    f" t AS (SELECT *, concat('from a', k, ' import *', chr(10), 'x = eval(y)', chr(10), 'def g(z):') AS head FROM b)"
    " SELECT repo, file, 'python/wildcard-import' AS rule_id, 1 AS line_start, 1 AS line_end, head AS code_snippet FROM t"
    " UNION ALL SELECT repo, file, 'python/eval-usage', 2, 2, concat(head, chr(10), '    z()') FROM t"
    " UNION ALL SELECT repo, file, 'python/long-method', 3, CAST(n + 23 AS INTEGER), NULL FROM b WHERE n > 29"
    " UNION ALL SELECT repo, file, 'not parsed', NULL, NULL, NULL FROM s WHERE n % 5 = 0"
    " UNION ALL SELECT repo, concat('src/', w, '.py'), concat('bandit/', CASE k % 5 WHEN 0 THEN 'B105' WHEN 1 THEN 'B307' WHEN 2 THEN 'B608' WHEN 3 THEN 'B999' ELSE 'B311' END),"
    f" n, CASE WHEN n % 3 = 0 THEN n + 2 ELSE n END, concat('x = \"', k, '\"') FROM {A.PARTS}",
)
def _(spark, sf_dir):
    src = A.table(spark, sf_dir, "part").selectExpr("p_brand AS repo", "concat('src/part_', p_partkey, '.py') AS path", f"{_RUN_SOURCE} AS content")
    relations = Relations(src, keep="checkpoint")
    found, errors = full_scan(src, relations=relations, reports={"bandit": A.reports(spark, sf_dir, _BANDIT)}, languages=("python",))
    rows = found.select("repo", "file", "rule_id", "line_start", "line_end", "code_snippet")
    none = errors.select("repo", F.col("path").alias("file"), F.lit("not parsed").alias("rule_id"))
    return rows.unionByName(none, allowMissingColumns=True)
