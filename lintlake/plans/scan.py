"""From source files to findings: the batch scan and its report."""

from __future__ import annotations

import inspect
import tempfile
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import extension
from lintlake.model import FINDING_COLUMNS
from lintlake.operators import rules_go, rules_python, rules_typescript
from lintlake.operators.findings import (
    build_summary, filter_confidence, filter_paths, filter_severity, scan_outputs, summary_for_all,
)
from lintlake.operators.metrics import function_metrics
from lintlake.operators.pynodes import errors_of, nodes_of, py_nodes, py_parse
from lintlake.operators.relations import code_rows
from lintlake.operators.render import with_snippets
from lintlake.operators.secrets import label_by_pack, leaks_to_findings, scan_secrets
from lintlake.plans.catalogue import runs
from lintlake.plans.registry import apply_user_rules, user_rules
from lintlake.sources.files import CHECKER_EXTENSIONS, EDITOR_EXTENSIONS, prune_dirs, prune_ignored
from lintlake.sources import reports as R
from lintlake.sources.reports import union_findings
from lintlake.sources.storage import cut


def session(app: str = "lintlake", **conf) -> SparkSession:
    """A session with the settings this package is made for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins on the file and more keys may use the partitioning by file
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # a scan builds some ten thousand columns; noting the place of each takes most of that time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # rows hold whole files, so few of them make a batch
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application; nothing to do where it
    is installed on them or on their path, and no harm."""
    if getattr(spark.sparkContext, "_lintlake_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="lintlake-ship-")) / "lintlake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._lintlake_shipped = True


def _apply(rule, relation: DataFrame, src: DataFrame, limits) -> DataFrame:
    wanted = inspect.signature(rule).parameters
    extra = {}
    if "src" in wanted and next(iter(wanted)) != "src":
        extra["src"] = src
    if "limits" in wanted:
        extra["limits"] = limits
    return rule(relation, **extra)


def sources_of(src: DataFrame, language: str, editor: bool = False) -> DataFrame:
    wanted = set(CHECKER_EXTENSIONS[language])
    if editor:
        names = {"typescript", "javascript"} if language == "typescript" else {language}
        wanted |= {e for e, lang in EDITOR_EXTENSIONS.items() if lang in names}
    return src.filter(extension(F.col("path")).isin(*sorted(wanted)))


@dataclass
class Relations:
    """The parse-once relations of a scan, kept until ``release``.

    ``keep`` is "persist" for a large scan (columns a rule does not read are not touched),
    "checkpoint" for small and frequent ones (the plans of the rules become short), or
    False to compute them anew in every rule. What is kept of Python files are the nodes that
    a rule reads, and all of them where users have rules for Python.
    """

    src: DataFrame
    editor: bool = False
    keep: str | bool = "persist"
    made: dict = field(default_factory=dict)
    whole: bool = False

    def of(self, language: str) -> tuple[DataFrame, DataFrame]:
        if language not in self.made:
            files = sources_of(self.src, language, self.editor)
            made = py_parse(files) if language == "python" else code_rows(files, language)
            if language == "python":
                self.whole = bool(user_rules(language)) or not self.keep
                made = made if self.whole else made.filter(rules_python.read_by_rules())
            if self.keep == "checkpoint":
                made = cut(made)
            elif self.keep:
                made = made.persist(StorageLevel.MEMORY_AND_DISK)
            self.made[language] = (files, made)
        files, made = self.made[language]
        return files, nodes_of(made) if language == "python" else made

    def errors(self) -> DataFrame:
        """``(repo, path, error)`` of Python files that do not parse, from the same parse."""
        self.of("python")
        return errors_of(self.made["python"][1])

    def release(self) -> None:
        for _, relation in self.made.values():
            relation.unpersist()
        self.made.clear()


def scan_language(relations: Relations, language: str, limits=None, categories=None) -> DataFrame | None:
    """Findings of all rules of one language, those of users included."""
    files, relation = relations.of(language)
    rules = {
        "python": rules_python.RULES, "typescript": rules_typescript.RULES, "go": rules_go.RULES,
    }[language]
    parts = [
        _apply(rule, relation, files, limits)
        for rule_id, rule in rules.items()
        if runs(rule_id, categories)
    ]
    if language == "typescript" and runs("ts/ts-ignore-proliferation", categories):
        parts += [rule(files) for rule in rules_typescript.TEXT_RULES.values()]
    if language == "python" and not relations.whole and user_rules(language):
        # a rule of a user that came after the parse may read any node
        relation = py_nodes(files)
    parts += apply_user_rules(relation, language)
    return union_findings(*parts).select(*FINDING_COLUMNS) if parts else None


def scan(
    src: DataFrame,
    *,
    languages=("python", "typescript", "go"),
    categories: list[str] | None = None,
    limits=None,
    editor: bool = False,
    keep: str | bool = "checkpoint",
    relations: Relations | None = None,
) -> DataFrame:
    """Findings of source files ``(repo, path, content)`` by rules and the secret scan.

    ``limits`` is None, a dict, or a table per repository. Nothing is left behind in memory:
    files are parsed once, when this is called, into the shared folder. To hold the parsed
    relations in memory instead, pass ``relations`` and release them after the findings are
    written; ``keep=False`` parses anew for every rule.
    """
    relations = relations or Relations(src, editor, keep)
    parts = [scan_language(relations, lang, limits, categories) for lang in languages]
    if categories is None or "security" in categories:
        parts.append(label_by_pack(leaks_to_findings(scan_secrets(src))))
    return union_findings(*[p for p in parts if p is not None])


#: How the reports of each outside tool become findings.
INGEST = {
    "bandit": R.ingest_bandit,
    "gosec": R.ingest_gosec,
    "gitleaks": R.ingest_gitleaks,
    "osv-python": lambda reports: R.ingest_osv(reports, "python"),
    "osv-typescript": lambda reports: R.ingest_osv(reports, "typescript"),
    "pip-audit": R.ingest_pip_audit,
    "npm-audit": R.ingest_npm_audit,
    "govulncheck": R.ingest_govulncheck,
    "coverage": R.ingest_coverage,
}


def metric_findings(relations: Relations, language: str, limits=None) -> DataFrame:
    """Long and complex functions and, but for Go, files with too many of them."""
    metrics = function_metrics(relations.of(language)[1], language)
    found = R.long_method(metrics, language, limits).unionByName(R.high_cyclomatic_complexity(metrics, language, limits))
    if language != "go":
        found = found.unionByName(R.god_class_file(metrics, language, limits))
    return found.select(*FINDING_COLUMNS)


def full_scan(
    src: DataFrame,
    *,
    relations: Relations,
    reports: dict[str, DataFrame] | None = None,
    languages=("python", "typescript", "go"),
    categories: list[str] | None = None,
    limits=None,
) -> tuple[DataFrame, DataFrame]:
    """Findings of all runners of a run, and the files that could not be read as code.

    To the rules and the secret scan come the metrics of functions and files, the ``reports`` of
    outside tools by the names in :data:`INGEST`, and the code of each rule finding. A report of
    a category that is switched off is left out. All read the ``relations``, parsed once.
    """
    found = [scan(src, languages=languages, categories=categories, limits=limits, relations=relations)]
    if categories is None or "code_structure" in categories:
        found += [metric_findings(relations, language, limits) for language in languages]
    for tool, rows in (reports or {}).items():
        found.append(INGEST[tool](rows).select(*FINDING_COLUMNS))
    every = union_findings(*found)
    if categories is not None:
        every = every.filter(F.col("category").isin(*categories))
    return with_snippets(every, src), relations.errors()


def select_findings(
    findings: DataFrame, *, confidence=0.7, severity: str = "low", ignore_paths=()
) -> DataFrame:
    """The filters of a run, in its order."""
    kept = filter_paths(filter_confidence(findings, confidence), ignore_paths)
    return filter_severity(kept, severity)


def select_sources(src: DataFrame, ignore_paths=()) -> DataFrame:
    return prune_ignored(prune_dirs(src), list(ignore_paths))


def scan_meta(repos: DataFrame, **values) -> DataFrame:
    """One row of run facts per repository; lists and texts as given."""
    # The fields of a run.
    texts = ("sha", "ref", "run_id", "run_number", "actor", "event")
    lists = ("languages_detected", "language_packs_used", "categories_scanned")
    have = set(repos.columns)

    def text(name: str):
        return F.col(name) if name in have else F.lit(values.get(name, ""))

    def many(name: str):
        given = values.get(name, ())
        made = F.array(*[F.lit(v) for v in given]).cast("array<string>")
        return F.col(name) if name in have else made

    return repos.select(
        "repo",
        *[text(n).cast("string").alias(n) for n in texts],
        *[many(n).alias(n) for n in lists],
        F.lit(values.get("scan_duration_ms", 0)).cast("long").alias("scan_duration_ms"),
        F.coalesce(
            F.lit(values.get("scanned_at")).cast("timestamp"), F.current_timestamp()
        ).alias("scanned_at"),
    )


def write_report(findings: DataFrame, meta: DataFrame, path: str, fmt: str = "json") -> DataFrame:
    """Write meta, findings and summary below ``path``, one folder per repository each.

    Findings are laid out by range of (repo, file), so a repository with very many of
    them becomes several files and small ones share a task. Returns the run's outputs.
    """
    base = path.rstrip("/")
    spark = findings.sparkSession
    spread = findings.repartitionByRange("repo", "file", "line_start", "id").sortWithinPartitions(
        "repo", "file", "line_start"
    )
    spread.write.mode("overwrite").partitionBy("repo").format(fmt).save(f"{base}/findings")
    # what follows reads what was written: the findings are worked out once
    findings = spark.read.schema(findings.schema).format(fmt).load(f"{base}/findings")
    meta.write.mode("overwrite").partitionBy("repo").format(fmt).save(f"{base}/meta")
    summary_for_all(meta, build_summary(findings)).write.mode("overwrite").partitionBy("repo").format(
        fmt
    ).save(f"{base}/summary")
    return scan_outputs(findings, f"{base}/findings")
