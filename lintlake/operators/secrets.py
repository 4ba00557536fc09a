"""Secrets: a scan of source lines, and the shared shaping of leak records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import extension
from lintlake.model import build_findings, string_list

LEAK_FIELDS = ("RuleID", "Description", "File", "StartLine", "EndLine")

# Rule name, description and pattern of the secrets looked for, and the
# words, in small letters, of which a text must hold one for the pattern to match.
SECRET_RULES = (
    ("aws-access-key", "AWS access key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("akia", "asia")),
    ("github-token", "GitHub token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack-token", "Slack token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}", ("xox",)),
    ("private-key", "Private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key",)),
    (
        "generic-secret",
        "Secret in an assignment",
        r"(?i)(?:token|secret|password|passwd|api_?key)[a-z_]*\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']",
        ("token", "secret", "passw", "apikey", "api_key"),
    ),
)
# Which extensions each pack takes secrets from.
SECRET_EXTENSIONS = (
    ("python", "python_v1", (".py", ".pyw")),
    ("typescript", "typescript_v1", (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")),
    ("go", "go_v1", (".go",)),
)


def _may_match(text: Column, hints: tuple) -> Column:
    found = F.lit(False)
    for hint in hints:
        found = found | text.contains(hint)
    return found


def _once(value: Column, test) -> Column:
    """``test`` of a value that is worked out once, however often the test names it."""
    return F.exists(F.array(value), test)


def scan_secrets(src: DataFrame) -> DataFrame:
    """Leak records of whole files, one per match.

    Plain words are looked for first; only files and then lines that hold one are matched
    against a pattern, and only matching files are cut into lines.
    """
    def any_rule(small: Column) -> Column:
        hit = F.lit(False)
        for _, _, pattern, hints in SECRET_RULES:
            hit = hit | (_may_match(small, hints) & F.col("content").rlike(pattern))
        return hit

    def any_hint(small: Column) -> Column:
        return _may_match(small, sum((r[3] for r in SECRET_RULES), ()))

    lines = src.filter(_once(F.lower("content"), any_rule)).select(
        "repo", "path", F.posexplode(F.split("content", "\n")).alias("at", "line")
    )

    def found(name: str, text: str, pattern: str, hints: tuple):
        return F.transform(
            F.regexp_extract_all("line", F.lit(pattern), F.lit(0)),
            lambda m: F.struct(F.lit(name).alias("RuleID"), F.lit(text).alias("Description"), m.alias("Match")),
        )

    matches = F.concat(*[found(*rule) for rule in SECRET_RULES])
    lines = lines.filter(_once(F.lower("line"), any_hint))
    return lines.select("repo", "path", "at", F.posexplode(matches).alias("ordinal", "m")).select(
        "repo",
        "m.RuleID",
        "m.Description",
        F.col("path").alias("File"),
        (F.col("at") + 1).alias("StartLine"),
        (F.col("at") + 1).alias("EndLine"),
        "ordinal",
    )


def leaks_to_findings(leaks: DataFrame) -> DataFrame:
    """Leak records -> findings without a language yet."""
    rule = F.col("RuleID")
    start = F.coalesce("StartLine", F.lit(1))
    ordinal = F.col("ordinal") if "ordinal" in leaks.columns else F.lit(0)
    return build_findings(
        leaks,
        ordinal=ordinal,
        antipattern="hardcoded_secret",
        antipattern_name="Hardcoded Secret",
        category="security",
        severity="critical",
        confidence=F.when(F.coalesce(rule.contains("generic"), F.lit(False)), 0.75).otherwise(0.95),
        file=F.coalesce("File", F.lit("")),
        line_start=start,
        line_end=F.coalesce("EndLine", start),
        language="",
        language_pack="",
        message=F.concat(
            F.lit("This may be a secret: "), F.coalesce("Description", F.lit("undefined")),
            F.lit(" (rule: "), F.coalesce(rule, F.lit("undefined")), F.lit(")"),
        ),
        remediation="Take the secret out of the code, keep it in a secrets manager, and replace it.",
        effort="hours",
        tool="gitleaks",
        rule_id=F.coalesce(rule, F.lit("gitleaks/secret")),
        references=string_list(
            ("https://cheatsheetseries.owasp.org/cheatsheets/Secrets_Management_Cheat_Sheet.html",)
        ),
        tags=string_list(("security", "owasp-a02", "secrets")),
    )


def label_by_pack(findings: DataFrame) -> DataFrame:
    """Give each secret the language and pack of its file; other files drop out."""
    ext = extension(F.col("file"))
    language, pack = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, version, extensions in SECRET_EXTENSIONS:
        language = F.when(ext.isin(*extensions), name).otherwise(language)
        pack = F.when(ext.isin(*extensions), version).otherwise(pack)
    return (
        findings.withColumn("language", language)
        .withColumn("language_pack", pack)
        .filter(F.col("language").isNotNull())
    )
