"""Reports of outside analysers -> findings, for many repositories at once.

Every function takes ``(repo, json)`` rows, one report per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import extension
from lintlake.model import build_findings, string_list
from lintlake.operators.hits import say
from lintlake.operators.secrets import label_by_pack, leaks_to_findings
from lintlake.operators.thresholds import with_limits
from lintlake.plans.catalogue import BY_ID, LANGUAGE_PACKS, report

# The parts of each report that are read.
COMPLEXITY = (
    "struct<function_list:array<struct<filename:string,name:string,length:int,"
    "cyclomatic_complexity:int,start_line:int,end_line:int>>>"
)
BANDIT = (
    "struct<results:array<struct<test_id:string,test_name:string,issue_severity:string,"
    "issue_confidence:string,filename:string,line_number:int,line_range:array<int>,"
    "issue_text:string,code:string,more_info:string>>>"
)
GOSEC = (
    "struct<Issues:array<struct<rule_id:string,details:string,severity:string,"
    "confidence:string,file:string,line:string,code:string,cwe:struct<url:string>>>>"
)
GITLEAKS = (
    "array<struct<RuleID:string,Description:string,File:string,StartLine:int,EndLine:int>>"
)
OSV = (
    "struct<results:array<struct<source:struct<path:string>,packages:array<struct<"
    "package:struct<name:string,version:string,ecosystem:string>,vulnerabilities:array<struct<"
    "id:string,database_specific:struct<severity:string>,severity:array<struct<score:string>>,"
    "references:array<struct<url:string>>>>>>>>>"
)
PIP_AUDIT = (
    "struct<dependencies:array<struct<name:string,version:string,vulns:array<struct<"
    "id:string,description:string,fix_versions:array<string>,link:string>>>>>"
)
NPM_AUDIT = (
    "struct<vulnerabilities:map<string,struct<severity:string,title:string,"
    "via:array<string>,fixAvailable:string>>>"
)
GOVULNCHECK = (
    "struct<vulnerability:struct<osv:struct<id:string,summary:string,"
    "references:array<struct<url:string>>>>>"
)
COVERAGE = (
    "struct<files:map<string,struct<summary:struct<percent_covered:double>,"
    "missing_lines:array<int>>>>"
)

# Rules of the security analysers to anti-patterns.
BANDIT_PATTERNS = {
    "B105": "hardcoded_secret", "B106": "hardcoded_secret", "B107": "hardcoded_secret",
    "B201": "shell_injection_vector", "B202": "shell_injection_vector",
    "B301": "insecure_deserialization", "B302": "insecure_deserialization",
    "B303": "weak_cryptography", "B304": "weak_cryptography", "B305": "weak_cryptography",
    "B306": "weak_cryptography", "B307": "shell_injection_vector", "B311": "weak_cryptography",
    "B320": "sql_injection_vector", "B324": "weak_cryptography",
    "B601": "shell_injection_vector", "B602": "shell_injection_vector",
    "B608": "sql_injection_vector",
}
GOSEC_PATTERNS = {
    "G101": "hardcoded_secret", "G201": "sql_injection_vector", "G202": "sql_injection_vector",
    "G203": "shell_injection_vector", "G204": "shell_injection_vector",
    "G301": "path_traversal", "G302": "path_traversal", "G304": "path_traversal",
    "G401": "weak_cryptography", "G501": "weak_cryptography",
}
# What to do about the rules that have advice of their own.
BANDIT_ADVICE = {
    "B105": "Read the password from the environment.",
    "B106": "Do not pass credentials as literals; read them from the environment.",
    "B301": "Use json or another format that cannot run code, not pickle.",
    "B303": "Use SHA-256 or stronger.",
    "B307": "Use ast.literal_eval() in place of eval().",
    "B601": "Pass the command as a list and without a shell.",
    "B608": "Use query parameters or an ORM.",
}
GOSEC_ADVICE = {
    "G101": "Read credentials from the environment or a secrets manager.",
    "G201": "Use query parameters.",
    "G204": "Check arguments before they reach exec.Command.",
    "G304": "Check paths against a list of allowed ones and clean them.",
    "G401": "Use current algorithms such as SHA-256 and AES-256.",
}
DEFAULT_ADVICE = "Look at this issue and grant no more rights than needed."


def _lookup(table: dict[str, str], key: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(mapping, key)


def _level(col: Column) -> Column:
    return (
        F.when(col == "HIGH", "high").when(col == "MEDIUM", "medium").when(col == "LOW", "low")
        .otherwise("medium")
    )


def _trust(col: Column) -> Column:
    return F.when(col == "HIGH", 0.9).when(col == "MEDIUM", 0.7).otherwise(0.5)


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit("undefined"))


def _parsed(reports: DataFrame, schema: str) -> DataFrame:
    return reports.select("repo", F.from_json("json", schema).alias("r"))


# Function metrics


def complexity_metrics(reports: DataFrame) -> DataFrame:
    """``(repo, file, name, start, end, length, ccn)`` from complexity reports."""
    return _parsed(reports, COMPLEXITY).select(
        "repo", F.explode("r.function_list").alias("f")
    ).select(
        "repo",
        F.col("f.filename").alias("file"),
        F.col("f.name").alias("name"),
        F.col("f.start_line").alias("start"),
        F.col("f.end_line").alias("end"),
        F.col("f.length").alias("length"),
        F.col("f.cyclomatic_complexity").alias("ccn"),
    )


# Names of the metric rules per pack.
_METRIC_RULES = {
    "python": ("python/long-method", "python/high-complexity"),
    "typescript": ("ts/long-method", "ts/high-complexity"),
    "go": ("go/long-function", "go/high-complexity"),
}


def _metric_language(language: str) -> Column | str:
    if language == "typescript":
        return F.when(extension(F.col("file")).isin(".ts", ".tsx"), "typescript").otherwise("javascript")
    return language


def long_method(metrics: DataFrame, language: str, limits=None) -> DataFrame:
    """Functions longer than the limit; three times as long is severe."""
    limited = with_limits(metrics, limits, language, "max_function_length")
    limit, length = F.col("limit_max_function_length"), F.col("length")
    severe = length > limit * 3
    return report(
        limited.filter(length > limit).withColumn("line", F.col("start")),
        _METRIC_RULES[language][0], language=_metric_language(language),
        file=F.col("file"), line_end=F.col("end"),
        severity=F.when(severe, "high").otherwise("medium"),
        effort=F.when(severe, "days").otherwise("hours"),
        message=say("Function '", F.col("name"), "' has ", length, " lines (threshold: ", limit.cast("int"), ")"),
        remediation=say("Split '", F.col("name"), "' into functions that each do one thing."),
        ordinal=F.concat_ws(":", "name", "end"),
    )


def high_cyclomatic_complexity(metrics: DataFrame, language: str, limits=None) -> DataFrame:
    """Functions with more branches than the limit; twice as many is severe."""
    limited = with_limits(metrics, limits, language, "max_cyclomatic_complexity")
    limit, ccn = F.col("limit_max_cyclomatic_complexity"), F.col("ccn")
    return report(
        limited.filter(ccn > limit).withColumn("line", F.col("start")),
        _METRIC_RULES[language][1], language=_metric_language(language),
        file=F.col("file"), line_end=F.col("end"),
        severity=F.when(ccn > limit * 2, "high").otherwise("medium"),
        message=say("Function '", F.col("name"), "' has cyclomatic complexity ", ccn, " (threshold: ", limit.cast("int"), ")"),
        remediation=say("Return early in '", F.col("name"), "', name conditions, or use a table of cases."),
        ordinal=F.concat_ws(":", "name", "end"),
    )


def god_class_file(metrics: DataFrame, language: str, limits=None) -> DataFrame:
    """Files with too many functions or too many lines of them; not for Go."""
    files = metrics.groupBy("repo", "file").agg(
        F.count("*").alias("functions"), F.sum("length").alias("total")
    )
    limited = with_limits(files, limits, language, "god_class_method_count", "god_class_total_lines")
    most, longest = F.col("limit_god_class_method_count"), F.col("limit_god_class_total_lines")
    rule = BY_ID["python/god-class"]
    return report(
        limited.filter((F.col("functions") > most) | (F.col("total") > longest)).withColumn("line", F.lit(1)),
        rule.rule_id, language=_metric_language(language), file=F.col("file"),
        line_end=F.col("total"),
        rule_id="python/god-class" if language == "python" else "ts/god-class",
        language_pack=LANGUAGE_PACKS[language],
        severity=F.when(F.col("functions") > most * 2, "high").otherwise("medium"),
        message=say("'", F.col("file"), "' holds ", F.col("functions"), " functions and about ", F.col("total"), " lines of logic"),
        remediation="Split it into parts that each have one responsibility.",
        ordinal=F.lit("file"),
    )


def ingest_complexity(reports: DataFrame, language: str, limits=None) -> DataFrame:
    metrics = complexity_metrics(reports)
    out = long_method(metrics, language, limits).unionByName(
        high_cyclomatic_complexity(metrics, language, limits)
    )
    if language != "go":
        out = out.unionByName(god_class_file(metrics, language, limits))
    return out


# Security analysers


def ingest_bandit(reports: DataFrame) -> DataFrame:
    rows = _parsed(reports, BANDIT).select("repo", F.posexplode("r.results").alias("at", "i")).select(
        "repo", "at", "i.*"
    )
    rule = F.col("test_id")
    pattern = F.coalesce(_lookup(BANDIT_PATTERNS, rule), F.lit("security_issue"))
    span = F.col("line_range")
    return build_findings(
        rows,
        ordinal=F.col("at"),
        antipattern=pattern,
        antipattern_name=F.coalesce("test_name", pattern),
        category="security",
        severity=_level(F.col("issue_severity")),
        confidence=_trust(F.col("issue_confidence")),
        file=F.col("filename"),
        line_start=F.col("line_number"),
        line_end=F.coalesce(F.get(span, F.size(span) - 1), F.col("line_number")),
        language="python",
        language_pack="python_v1",
        message=F.col("issue_text"),
        remediation=F.coalesce(_lookup(BANDIT_ADVICE, rule), F.lit(DEFAULT_ADVICE)),
        effort="hours",
        tool="bandit",
        rule_id=say("bandit/", _text(rule)),
        code_snippet=F.col("code"),
        references=F.when(F.col("more_info") != "", F.array("more_info")).otherwise(string_list(())),
        tags=string_list(("security",)),
    )


def ingest_gosec(reports: DataFrame) -> DataFrame:
    rows = _parsed(reports, GOSEC).select("repo", F.posexplode("r.Issues").alias("at", "i")).select(
        "repo", "at", "i.*"
    )
    rule = F.col("rule_id")
    number = F.regexp_extract("line", r"^\s*(\d+)", 1).try_cast("int")
    line = F.when(number > 0, number).otherwise(1)
    return build_findings(
        rows,
        ordinal=F.col("at"),
        antipattern=F.coalesce(_lookup(GOSEC_PATTERNS, rule), F.lit("security_issue")),
        antipattern_name=F.coalesce("details", rule),
        category="security",
        severity=_level(F.col("severity")),
        confidence=_trust(F.col("confidence")),
        file=F.col("file"),
        line_start=line,
        line_end=line,
        language="go",
        language_pack="go_v1",
        message=F.col("details"),
        remediation=F.coalesce(_lookup(GOSEC_ADVICE, rule), F.lit(DEFAULT_ADVICE)),
        effort="hours",
        tool="gosec",
        rule_id=say("gosec/", _text(rule)),
        code_snippet=F.col("code"),
        references=F.when(F.col("cwe.url") != "", F.array("cwe.url")).otherwise(string_list(())),
        tags=string_list(("security",)),
    )


def ingest_gitleaks(reports: DataFrame) -> DataFrame:
    """One pass over the leaks, then each goes to the pack of its file's extension."""
    leaks = _parsed(reports, GITLEAKS).select("repo", F.posexplode("r").alias("ordinal", "l")).select(
        "repo", "ordinal", "l.*"
    )
    return label_by_pack(leaks_to_findings(leaks))


# Vulnerable dependencies


def _dependency(df: DataFrame, **fields) -> DataFrame:
    shared = {
        "antipattern": "vulnerable_dependency",
        "antipattern_name": "Vulnerable Dependency",
        "category": "dependencies",
        "confidence": 1.0,
        "line_start": 1,
        "line_end": 1,
        "effort": "hours",
        "tags": string_list(("security", "dependencies")),
    }
    return build_findings(df, **{**shared, **fields})


def _score_level(score: Column, words: bool) -> Column:
    number = score.try_cast("double")
    level = (
        F.when(score.isNull() | (score == "") | (number == 0), "medium")
        .when(number >= 9, "critical")
        .when(number >= 7, "high")
        .when(number >= 4, "medium")
    )
    if words:
        upper = F.upper(score)
        level = level.when(upper == "CRITICAL", "critical").when(upper == "HIGH", "high").when(
            upper.isin("MODERATE", "MEDIUM"), "medium"
        )
    return level.otherwise("low")


def ingest_osv(reports: DataFrame, language: str, severity_words: bool = False) -> DataFrame:
    """Vulnerabilities per package; the TypeScript pack takes npm packages only.

    A score in words counts as low unless ``severity_words`` reads it.
    """
    packages = _parsed(reports, OSV).select("repo", F.posexplode("r.results").alias("at", "x")).select(
        "repo", "at", F.col("x.source.path").alias("source"), F.posexplode("x.packages").alias("pkg_at", "p")
    )
    if language == "typescript":
        packages = packages.filter(
            F.lower(F.coalesce("p.package.ecosystem", F.lit(""))).isin("npm", "node", "")
        )
    rows = packages.select(
        "repo", "source", "p.package.name", "p.package.version",
        F.posexplode("p.vulnerabilities").alias("vuln_at", "v"), "at", "pkg_at",
    )
    score = F.coalesce("v.database_specific.severity", F.get("v.severity", F.lit(0))["score"])
    vuln = _text(F.col("v.id"))
    missing = "package-lock.json" if language == "typescript" else ""
    return _dependency(
        rows,
        ordinal=F.concat_ws(":", "at", "pkg_at", "vuln_at"),
        severity=_score_level(score, severity_words),
        file=F.coalesce("source", F.lit(missing)),
        language=language,
        language_pack=LANGUAGE_PACKS[language],
        message=say(_text(F.col("name")), "@", _text(F.col("version")), " is affected by ", vuln),
        remediation=say("Upgrade ", _text(F.col("name")), "; ", vuln, " lists the fixed versions."),
        tool="osv-scanner",
        rule_id=say("osv/", vuln),
        references=F.coalesce(F.col("v.references.url"), string_list(())),
        tags=F.array(F.lit("security"), F.lit("dependencies"), vuln),
    )


def ingest_pip_audit(reports: DataFrame) -> DataFrame:
    rows = (
        _parsed(reports, PIP_AUDIT)
        .select("repo", F.posexplode("r.dependencies").alias("at", "d"))
        .select("repo", "at", "d.name", "d.version", F.posexplode("d.vulns").alias("vuln_at", "v"))
    )
    vuln = _text(F.col("v.id"))
    return _dependency(
        rows,
        ordinal=F.concat_ws(":", "at", "vuln_at"),
        severity="high",
        file="requirements.txt",
        language="python",
        language_pack="python_v1",
        message=say(_text(F.col("name")), "==", _text(F.col("version")), " is vulnerable: ", vuln, " - ",
                    _text(F.col("v.description"))),
        remediation=say("Upgrade ", _text(F.col("name")), " to ",
                        F.coalesce(F.array_join("v.fix_versions", " or "), F.lit("undefined")), " or later."),
        tool="pip-audit",
        rule_id=say("pip-audit/", vuln),
        references=F.array("v.link"),
    )


def ingest_npm_audit(reports: DataFrame) -> DataFrame:
    rows = _parsed(reports, NPM_AUDIT).select(
        "repo", F.explode("r.vulnerabilities").alias("name", "a")
    ).select("repo", "name", "a.*")
    level = F.col("severity")
    severity = (
        F.when(level.isin("critical", "high", "low"), level).otherwise("medium")
    )
    title = F.coalesce(
        "title", F.get_json_object(F.get("via", F.lit(0)), "$.title"), F.lit("see npm audit")
    )
    fix = F.coalesce("fixAvailable", F.lit("false"))
    links = F.filter(
        F.transform("via", lambda v: F.get_json_object(v, "$.url")), lambda u: u.isNotNull() & (u != "")
    )
    return _dependency(
        rows,
        ordinal=F.col("name"),
        severity=severity,
        file="package.json",
        language="typescript",
        language_pack="typescript_v1",
        message=say(F.col("name"), " is vulnerable: ", title),
        remediation=F.when(
            ~fix.isin("false", "", "0", "null"), say("Run `npm audit fix` or upgrade ", F.col("name"), " by hand.")
        ).otherwise(say("There is no fix for ", F.col("name"), " yet; look for another package.")),
        tool="npm-audit",
        rule_id=say("npm-audit/", F.col("name")),
        references=F.coalesce(links, string_list(())),
    )


def _vulncheck_lines(reports: DataFrame) -> DataFrame:
    """``repo, stop, at, line, bad``: lines of each report, and where its first bad one is."""
    each = F.transform(
        F.split("json", "\n"),
        lambda line, at: F.struct(at.alias("at"), line.alias("line"), F.try_parse_json(line).isNull().alias("bad")),
    )
    lines = reports.select("repo", F.filter(each, lambda x: F.trim(x["line"]) != "").alias("lines"))
    stop = F.array_min(F.transform(F.filter("lines", lambda x: x["bad"]), lambda x: x["at"]))
    return lines.withColumn("stop", stop).select("repo", "stop", F.inline("lines"))


def govulncheck_quarantine(reports: DataFrame) -> DataFrame:
    """Lines of vulnerability reports that are no JSON."""
    return _vulncheck_lines(reports).filter("bad").select("repo", "at", "line")


def ingest_govulncheck(reports: DataFrame, stop_at_bad_line: bool = False) -> DataFrame:
    """JSON lines; bad ones go to the quarantine, or end their own report as an option."""
    lines = _vulncheck_lines(reports)
    if stop_at_bad_line:
        lines = lines.filter(F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    rows = (
        lines.filter("not bad")
        .select("repo", "at", F.from_json("line", GOVULNCHECK)["vulnerability"].alias("v"))
        .filter(F.col("v").isNotNull())
    )
    summary = F.lower(F.coalesce("v.osv.summary", F.lit("")))
    severity = (
        F.when(summary.contains("remote code") | summary.contains("rce"), "critical")
        .when(summary.contains("denial") | summary.contains("overflow"), "high")
        .otherwise("medium")
    )
    return _dependency(
        rows,
        ordinal=F.col("at"),
        severity=severity,
        file="go.mod",
        language="go",
        language_pack="go_v1",
        message=say(_text(F.col("v.osv.id")), ": ", F.coalesce("v.osv.summary", F.lit("Known vulnerability"))),
        remediation="Update the module: go get -u <module>@latest",
        tool="govulncheck",
        rule_id=say("govulncheck/", F.coalesce("v.osv.id", F.lit("unknown"))),
        references=F.coalesce(F.col("v.osv.references.url"), string_list(())),
    )


# Coverage


def ingest_coverage(reports: DataFrame, limits=None) -> DataFrame:
    """Files below the least coverage; below 1/2.5 of it is severe. Tests are left out."""
    rows = _parsed(reports, COVERAGE).select(
        "repo", F.explode("r.files").alias("file", "c")
    ).select(
        "repo", "file", F.coalesce("c.summary.percent_covered", F.lit(100.0)).alias("pct"),
        F.col("c.missing_lines").alias("missing"),
    ).filter(~F.col("file").contains("test_") & ~F.col("file").contains("_test.py"))
    limited = with_limits(rows, limits, "python", "min_coverage_percent")
    least = F.col("limit_min_coverage_percent")

    def listed(lines: Column) -> Column:
        return F.array_join(lines.cast("array<string>"), ", ")

    return report(
        limited.filter(F.col("pct") < least).withColumn("line", F.lit(1)),
        "python/low-coverage", language="python", file=F.col("file"),
        severity=F.when(F.col("pct") < least / 2.5, "high").otherwise("medium"),
        message=say("Tests cover ", F.format_string("%.1f", "pct"), "% of the file (threshold: ",
                    least.cast("int"), "%). Lines without a test: ", _text(listed(F.col("missing")))),
        remediation=say("Write tests for the logic and the error paths, first for lines ",
                        F.coalesce(listed(F.slice("missing", 1, 10)), F.lit(""))),
        ordinal=F.lit("file"),
    )


def union_findings(*parts: DataFrame) -> DataFrame:
    """All findings of all runners under one schema."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
