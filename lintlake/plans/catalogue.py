"""The rule catalogue: what every rule reports, and which runner it belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.model import build_findings, string_list


@dataclass(frozen=True)
class Rule:
    rule_id: str
    antipattern: str
    name: str
    severity: str
    confidence: float
    effort: str
    tags: tuple = ()
    references: tuple = ()
    category: str = "code_structure"
    tool: str = "ast-checker"
    runner: str = "code_structure"

    @property
    def pack(self) -> str:
        return PACKS[self.rule_id.split("/")[0]]


# Pack versions by the first part of a rule id, and by language.
PACKS = {"python": "python_v1", "ts": "typescript_v1", "go": "go_v1"}
LANGUAGE_PACKS = {
    "python": "python_v1",
    "typescript": "typescript_v1",
    "javascript": "typescript_v1",
    "go": "go_v1",
}

# Identity, rating, tags and links of every rule.
_OWASP = "https://cheatsheetseries.owasp.org/cheatsheets/"
RULES = (
    # Python
    Rule("python/mutable-default-argument", "mutable_default_argument", "Mutable Default Argument", "high", 1.0, "minutes",
         ("python-gotcha", "bugs"), ("https://docs.python-guide.org/writing/gotchas/#mutable-default-arguments",)),
    Rule("python/cognitive-complexity", "high_cyclomatic_complexity", "High Cognitive Complexity", "high", 0.9, "hours",
         ("maintainability", "testability"), ("https://www.sonarsource.com/docs/CognitiveComplexity.pdf",)),
    Rule("python/deep-nesting", "deep_nesting", "Deep Nesting", "medium", 0.85, "hours", ("maintainability", "readability")),
    Rule("python/bare-except", "bare_except", "Bare Except", "high", 1.0, "minutes",
         ("python-gotcha", "error-handling"), ("https://peps.python.org/pep-0352/",)),
    Rule("python/wildcard-import", "wildcard_import", "Wildcard Import", "medium", 1.0, "minutes", ("maintainability", "namespace")),
    Rule("python/magic-number", "magic_number", "Magic Number", "low", 0.7, "minutes", ("readability", "maintainability")),
    Rule("python/n-plus-one-query", "n_plus_one_query", "N+1 Query Pattern", "high", 0.8, "hours",
         ("performance", "database", "n+1"), ("https://docs.djangoproject.com/en/stable/ref/models/querysets/#select-related",)),
    Rule("python/datetime-now-naive", "datetime_now_naive", "Naive datetime.now()", "medium", 0.9, "minutes",
         ("bugs", "timezone"), ("https://docs.python.org/3/library/datetime.html#aware-and-naive-objects",)),
    Rule("python/string-format-sql", "string_format_sql", "String-Formatted SQL", "high", 0.85, "minutes",
         ("security", "sql-injection", "owasp-a03"), (_OWASP + "SQL_Injection_Prevention_Cheat_Sheet.html",), "security"),
    Rule("python/isinstance-chain", "isinstance_chain", "Long isinstance Chain", "medium", 0.8, "hours", ("design", "maintainability")),
    Rule("python/eval-usage", "eval_usage", "eval/exec Usage", "critical", 1.0, "hours",
         ("security", "injection"), ("https://bandit.readthedocs.io/en/latest/plugins/b307_eval.html",), "security"),
    Rule("python/yaml-unsafe-load", "yaml_unsafe_load", "Unsafe YAML Load", "high", 0.95, "minutes",
         ("security", "deserialization"), ("https://pyyaml.org/wiki/PyYAMLDocumentation",), "security"),
    Rule("python/file-not-closed", "file_not_closed", "File Not Closed", "medium", 0.8, "minutes", ("resource-management", "reliability")),
    Rule("python/test-no-assertion", "test_no_assertion", "Test Without Assertion", "medium", 0.85, "minutes",
         ("test_quality", "test-smell"), (), "test_quality"),
    # TypeScript and JavaScript
    Rule("ts/deep-nesting", "deep_nesting", "Deep Nesting", "medium", 0.9, "hours", ("maintainability", "readability")),
    Rule("ts/magic-number", "magic_number", "Magic Number", "low", 0.7, "minutes", ("readability", "maintainability")),
    Rule("ts/assertion-roulette", "assertion_roulette", "Assertion Roulette", "medium", 0.95, "minutes",
         ("test_quality", "test-smell"), ("https://testsmells.org/pages/testsmellexamples.html#AssertionRoulette",), "test_quality"),
    Rule("ts/excessive-mocking", "excessive_mocking", "Excessive Mocking", "medium", 0.85, "hours",
         ("test_quality", "test-smell"), ("https://kentcdodds.com/blog/testing-implementation-details",), "test_quality"),
    Rule("ts/god-class", "god_class", "God Class", "medium", 0.85, "days",
         ("maintainability", "srp"), ("https://refactoring.guru/smells/large-class",)),
    Rule("ts/any-type-abuse", "any_type_abuse", "Excessive `any` Type Usage", "medium", 0.9, "hours",
         ("type-safety", "maintainability"), ("https://www.typescriptlang.org/docs/handbook/2/types-from-types.html",)),
    Rule("ts/ts-ignore-proliferation", "ts_ignore_proliferation", "@ts-ignore Proliferation", "medium", 0.95, "hours",
         ("type-safety", "maintainability")),
    Rule("ts/callback-hell", "callback_hell", "Callback Hell", "medium", 0.85, "hours",
         ("readability", "maintainability", "async"), ("http://callbackhell.com/",)),
    Rule("ts/promise-no-catch", "promise_no_catch", "Unhandled Promise", "medium", 0.75, "minutes", ("async", "reliability"),
         ("https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/Global_Objects/Promise/catch",)),
    Rule("ts/console-log-left", "console_log_left", "Console Logging Left in Code", "low", 0.8, "minutes", ("cleanup", "production")),
    Rule("ts/non-null-assertion", "non_null_assertion", "Excessive Non-Null Assertions", "medium", 0.85, "hours", ("type-safety", "maintainability"),
         ("https://www.typescriptlang.org/docs/handbook/2/everyday-types.html#non-null-assertion-operator-postfix-",)),
    Rule("ts/eval-usage", "eval_usage", "eval() Usage", "critical", 1.0, "hours", ("security", "injection"),
         ("https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/Global_Objects/eval#never_use_eval!",), "security"),
    Rule("ts/innerhtml-assignment", "innerhtml_assignment", "innerHTML/outerHTML Assignment", "high", 0.9, "minutes",
         ("security", "xss", "owasp-a07"), (_OWASP + "DOM_based_XSS_Prevention_Cheat_Sheet.html",), "security"),
    Rule("ts/test-no-assertion", "test_no_assertion", "Test Without Assertion", "medium", 0.85, "minutes",
         ("test_quality", "test-smell"), (), "test_quality"),
    # Go
    Rule("go/unchecked-error", "error_not_checked", "Unchecked Error", "high", 0.85, "minutes",
         ("errors", "reliability"), ("https://go.dev/doc/effective_go#errors",)),
    Rule("go/bare-goroutine", "bare_goroutine", "Bare Goroutine", "medium", 0.8, "minutes",
         ("concurrency", "reliability"), ("https://go.dev/doc/effective_go#recover",), "concurrency"),
    Rule("go/deep-nesting", "deep_nesting", "Deep Nesting", "medium", 0.85, "hours", ("maintainability", "readability")),
    Rule("go/god-struct", "god_class", "God Struct", "medium", 0.85, "days",
         ("maintainability", "srp"), ("https://refactoring.guru/smells/large-class",)),
    Rule("go/magic-number", "magic_number", "Magic Number", "low", 0.7, "minutes", ("readability", "maintainability")),
    Rule("go/empty-interface-abuse", "empty_interface_abuse", "Empty Interface Abuse", "medium", 0.8, "hours",
         ("type-safety", "maintainability"), ("https://go.dev/doc/effective_go#interface_methods",)),
    Rule("go/context-not-first", "context_not_first_param", "Context Not First Parameter", "medium", 0.95, "minutes",
         ("convention", "stdlib"), ("https://go.dev/blog/context#package-context",)),
    Rule("go/large-interface", "large_interface", "Large Interface", "medium", 0.85, "hours",
         ("design", "go-idiom"), ("https://go.dev/doc/effective_go#interfaces",)),
    Rule("go/init-side-effects", "init_side_effects", "Complex init() Function", "medium", 0.75, "hours", ("testability", "maintainability")),
    Rule("go/defer-in-loop", "defer_in_loop", "Defer in Loop", "high", 0.95, "minutes",
         ("resource-leak", "reliability"), ("https://go.dev/doc/effective_go#defer",)),
    Rule("go/error-string-format", "error_string_format", "Verbose Error Construction", "low", 1.0, "minutes", ("go-idiom", "readability")),
    Rule("go/goroutine-closure-capture", "goroutine_closure_capture", "Loop Variable Captured by Goroutine", "high", 0.9, "minutes",
         ("concurrency", "bugs", "race-condition"), ("https://go.dev/doc/faq#closures_and_goroutines",), "concurrency"),
    Rule("go/tls-insecure-skip", "tls_insecure_skip", "TLS InsecureSkipVerify", "critical", 1.0, "minutes",
         ("security", "tls", "owasp-a07"), ("https://pkg.go.dev/crypto/tls#Config",), "security"),
    Rule("go/sql-string-concat", "sql_string_concat", "SQL String Concatenation", "high", 0.85, "minutes",
         ("security", "sql-injection", "owasp-a03"), (_OWASP + "SQL_Injection_Prevention_Cheat_Sheet.html",), "security"),
    Rule("go/weak-rand", "weak_rand", "Weak Random Number Generator", "high", 0.75, "minutes",
         ("security", "cryptography"), ("https://pkg.go.dev/crypto/rand",), "security"),
    # Function metrics, for all packs
    Rule("python/long-method", "long_method", "Long Method", "medium", 0.95, "hours", ("maintainability",), tool="lizard"),
    Rule("ts/long-method", "long_method", "Long Method", "medium", 0.95, "hours", ("maintainability",), tool="lizard"),
    Rule("go/long-function", "long_method", "Long Function", "medium", 0.95, "hours", ("maintainability",), tool="lizard"),
    Rule("python/high-complexity", "high_cyclomatic_complexity", "High Cyclomatic Complexity", "medium", 1.0, "hours",
         ("maintainability", "testability"), ("https://en.wikipedia.org/wiki/Cyclomatic_complexity",), tool="lizard"),
    Rule("ts/high-complexity", "high_cyclomatic_complexity", "High Cyclomatic Complexity", "medium", 1.0, "hours",
         ("maintainability", "testability"), ("https://en.wikipedia.org/wiki/Cyclomatic_complexity",), tool="lizard"),
    Rule("go/high-complexity", "high_cyclomatic_complexity", "High Cyclomatic Complexity", "medium", 1.0, "hours",
         ("maintainability", "testability"), tool="lizard"),
    Rule("python/god-class", "god_class", "God Class", "medium", 0.82, "days",
         ("maintainability", "srp"), ("https://refactoring.guru/smells/large-class",), tool="lizard"),
    # Coverage
    Rule("python/low-coverage", "missing_test_coverage", "Missing Test Coverage", "medium", 1.0, "days",
         ("test_quality", "coverage"), (), "test_quality", "pytest-cov", "test_quality"),
)
BY_ID = {r.rule_id: r for r in RULES}

# The runner that turns each outside report into findings.
REPORT_RUNNERS = {
    "lizard": "code_structure",
    "gitleaks": "security",
    "bandit": "security",
    "gosec": "security",
    "osv-scanner": "dependencies",
    "pip-audit": "dependencies",
    "npm-audit": "dependencies",
    "govulncheck": "dependencies",
    "pytest-cov": "test_quality",
}


def rules_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table; a dimension of fixed size."""
    return spark.createDataFrame(
        [
            (r.rule_id, r.antipattern, r.name, r.category, r.severity, r.confidence, r.effort, r.tool, r.runner, r.pack)
            for r in RULES
        ],
        "rule_id string, antipattern string, antipattern_name string, category string, severity string,"
        " confidence double, effort string, tool string, runner string, language_pack string",
    )


def gate_categories(rules: DataFrame, categories: list[str]) -> DataFrame:
    """Rules whose runner is switched on; findings themselves are not filtered."""
    return rules.filter(F.col("runner").isin(*[c.strip() for c in categories]))


def runs(rule_id: str, categories: list[str] | None) -> bool:
    return categories is None or BY_ID[rule_id].runner in categories


def report(
    df: DataFrame,
    rule_id: str,
    /,
    *,
    language: Column | str,
    message,
    remediation,
    ordinal,
    line_end: Column | None = None,
    file: Column | None = None,
    **fields,
) -> DataFrame:
    """Findings of one catalogue rule from rows with ``repo``, ``path``, ``line``."""
    rule = BY_ID[rule_id]
    values = {
        "antipattern": rule.antipattern,
        "antipattern_name": rule.name,
        "category": rule.category,
        "severity": rule.severity,
        "confidence": rule.confidence,
        "file": F.col("path") if file is None else file,
        "line_start": F.col("line"),
        "line_end": F.col("line") if line_end is None else line_end,
        "language": language,
        "language_pack": rule.pack,
        "message": message,
        "remediation": remediation,
        "effort": rule.effort,
        "tool": rule.tool,
        "rule_id": rule_id,
        "references": string_list(rule.references),
        "tags": string_list(rule.tags),
    }
    values.update(fields)
    return build_findings(df, ordinal=ordinal, **values)
