"""Operators on the findings table, on small tables with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from lintlake.functions.text import escape_html, extension, format_category, truncate_left
from lintlake.model import FINDING_SCHEMA, SEVERITIES
from lintlake.operators import findings as O
from lintlake.operators import render as V
from lintlake.operators.ranking import numbered


@pytest.fixture(scope="module")
def make(spark):
    def rows(*items):
        out = []
        for i, item in enumerate(items):
            base = {
                "repo": "r", "id": f"id{i}", "antipattern": "bare_except", "antipattern_name": "Bare Except",
                "category": "code_structure", "severity": "high", "confidence": 0.9, "file": "src/a.py",
                "line_start": i + 1, "line_end": i + 1, "column": None, "language": "python",
                "language_pack": "python_v1", "message": "m", "remediation": "r", "effort": "minutes",
                "tool": "t", "rule_id": "python/bare-except", "code_snippet": None, "references": [], "tags": [],
                "detected_at": datetime.datetime(2024, 1, 1),
            }
            base.update(item)
            out.append(tuple(base[f.name] for f in FINDING_SCHEMA))
        return spark.createDataFrame(out, FINDING_SCHEMA)

    return rows


def test_summary_counts_and_zero_fill(spark, make):
    df = make({"severity": "critical"}, {"severity": "critical"}, {"severity": "high", "file": "b"},
              {"severity": "low", "category": "security", "language": "go"})
    (row,) = O.build_summary(df).collect()
    assert row["total"] == 4 and row["files_affected"] == 2
    assert row["by_severity"] == {"critical": 2, "high": 1, "medium": 0, "low": 1, "info": 0}
    assert row["by_category"] == {"code_structure": 3, "security": 1}
    assert row["by_language"] == {"python": 3, "go": 1}
    empty = O.summary_for_all(spark.createDataFrame([("q",)], "repo string"), O.build_summary(df)).collect()[0]
    assert empty["total"] == 0 and set(empty["by_severity"]) == set(SEVERITIES)


def test_filters(make):
    df = make({"severity": "critical"}, {"severity": "info"}, {"severity": "odd", "confidence": 0.2})
    # a severity nobody knows ranks before all others, as in the order lookup it comes from
    assert O.filter_severity(df, "high").count() == 2
    assert O.filter_severity(df, "fatal").filter("severity <> 'odd'").count() == 0
    assert O.filter_editor(df, "nope", 0.0).count() == 2
    assert O.filter_editor(df, "info", 0.0).count() == 2
    once = O.filter_confidence(df, 0.5)
    assert once.count() == O.filter_confidence(once, 0.5).count() == 2
    assert [O.clamp_confidence(v) for v in ("x", 0, None, 5, -1, 0.3)] == [0.7, 0.7, 0.7, 1.0, 0.0, 0.3]


def test_gate(make):
    df = make({"severity": "critical"}, {"severity": "low"})
    got = {lv: O.gate_fail(df, lv).first()["failed"] for lv in ("critical", "low", "none", "odd")}
    assert got == {"critical": True, "low": True, "none": False, "odd": False}


def test_paths(make):
    df = make({"file": "tests/a.py"}, {"file": "src/tests/b.py"}, {"file": "src/c.py"})
    assert [r["file"] for r in O.filter_paths(df, ["/tests/**", "**", ""]).collect()] == ["src/c.py"]


def test_issue_groups_and_dedup(make):
    df = make({}, {}, {"file": "b.py"}, {"antipattern": "magic_number", "antipattern_name": "Magic Number"})
    groups = O.group_issues(df)
    assert sorted(r["locations"] for r in groups.collect()) == [1, 1, 2]
    opened = groups.filter("file = 'b.py'").select("repo", "title")
    assert O.dedup_issues(groups, opened).count() == 2


def test_issue_body_parts_hold_every_location(make, monkeypatch):
    monkeypatch.setattr(V, "LOCATIONS_PER_PART", 3)
    df = make(*[{"line_start": i // 2 + 1, "line_end": i // 2 + 1, "message": f"m{i}"} for i in range(8)])
    parts = V.issue_body(O.group_issues(df), df).orderBy("part").collect()
    assert [p["part"] for p in parts] == [0, 1, 2]
    whole = "\n".join(p["body"] for p in parts)
    assert [line.rsplit(" ", 1)[1] for line in whole.split("\n") if line.startswith("- [ ]")] == [f"m{i}" for i in range(8)]
    assert whole.startswith("## [high] Bare Except") and "### Remediation" in whole
    assert whole.index("Affected Locations") < whole.index("m7") < whole.index("What is this")


def test_numbered_is_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") % 11).alias("c"), F.col("id").alias("o"))
    got = {(r["k"], r["o"]): r["position"] for r in numbered(df, ["k"], ["c"], ["o"]).collect()}
    for k in range(3):
        order = sorted((i for i in range(500) if i % 3 == k), key=lambda i: (i % 11, i))
        assert [got[(k, o)] for o in order] == list(range(1, len(order) + 1))


def test_top_findings_cut_before_the_shuffle(make):
    df = make(*[{"line_start": 100 - i, "line_end": 100} for i in range(15)], {"severity": "low", "line_start": 1})
    top = O.top_findings(df)
    assert sorted(r["line_start"] for r in top.collect()) == list(range(86, 96))
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_changed_lines(spark, make):
    df = make({"line_start": 5}, {"line_start": 64}, {"line_start": 200}, {"line_start": 201})
    hunks = spark.createDataFrame([("r", "src/a.py", 1, 70), ("r", "src/a.py", 60, 65), ("r", "src/a.py", 190, 200)],
                                  "repo string, file string, start int, end int")
    assert sorted(r["line_start"] for r in O.pr_changed_lines(df, hunks).collect()) == [5, 64, 200]


def test_text_helpers(spark):
    df = spark.createDataFrame([("very/long/path/to/file.py x", "code_structure", "<a href='x'>&\"")], "p string, c string, h string")
    (r,) = df.select(truncate_left(F.col("p"), 15), format_category(F.col("c")), escape_html(F.col("h"))).collect()
    assert len(r[0]) == 15 and r[0].startswith("...")
    assert r[1] == "Code Structure"
    assert r[2] == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    exts = spark.createDataFrame([("a/b.TS",), (".env",), ("a.b/c",), ("x.test.ts",)], "p string").select(extension(F.col("p")))
    assert [r[0] for r in exts.collect()] == [".ts", "", "", ".ts"]


def test_fix_preview_and_diagnostics(make):
    df = make({"antipattern": "mutable_default_argument", "code_snippet": "def f(x=[], y = {}):"}, {"line_start": 1})
    (row,) = V.fix_preview(df).collect()
    assert row["fixed"] == "def f(x=None  # was: [], y=None  # was: {}):"
    assert {r["severity"] for r in V.to_diagnostics(df).collect()} == {1}
