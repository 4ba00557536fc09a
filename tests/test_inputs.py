"""Sources, reports, thresholds, streams and registered rules."""

import datetime
import json

from pyspark.sql import functions as F

from lintlake.operators import thresholds as T
from lintlake.operators.secrets import label_by_pack, leaks_to_findings, scan_secrets
from lintlake.plans import registry
from lintlake.plans.scan import scan, write_report, scan_meta
from lintlake.sources import files as S
from lintlake.sources import reports as I
from lintlake.streaming import saves as ST


def test_read_source_files(spark, tmp_path):
    for name, data in {
        "one/src/a.py": b"x = 1\n", "one/node_modules/b.ts": b"y\n", "two/c.go": b"package p \xff\n", "two/d.rs": b"fn\n",
        "two/my dir/e.py": b"pass\n", "two/notes.md": b"no",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    df = S.read_source_files(spark, str(tmp_path))
    got = {(r["repo"], r["path"]): r["content"] for r in df.collect()}
    assert got[("two", "c.go")] == "package p \ufffd\n"
    assert ("two", "my dir/e.py") in got and ("two", "notes.md") not in got
    kept = S.prune_dirs(df)
    detected = {(r["repo"], r["language"]): (r["file_count"], r["pack_available"]) for r in S.detect_languages(kept).collect()}
    assert detected == {("one", "python"): (1, True), ("two", "go"): (1, True), ("two", "python"): (1, True), ("two", "rust"): (1, False)}
    packs = S.packs_to_run(S.select_packs(S.detect_languages(kept)))
    assert sorted(tuple(r) for r in packs.collect()) == [("one", "python_v1"), ("two", "go_v1"), ("two", "python_v1")]


def test_prune_glob(sources):
    src = sources({"venv/a.py": "", "venv_old/a.py": "", "src/generated/x/a.py": "", "src/x/generated/a.py": "", "src/b.py": ""})
    assert sorted(r["path"] for r in S.prune_glob(src, ["**/venv/**"]).collect())[0] == "src/b.py"
    kept = sorted(r["path"] for r in S.prune_glob(src, ["src/generated"]).collect())
    assert kept == ["src/b.py", "venv/a.py", "venv_old/a.py"]


def test_secrets(sources):
    text = 'a\nAPI_KEY = "abcdefgh12"\nk = "AKIA' + "A" * 16 + '"\n'
    src = sources({"a.py": text, "b.md": text, "c.go": "clean"})
    found = leaks_to_findings(scan_secrets(src))
    assert found.count() == 4
    labeled = label_by_pack(found)
    assert sorted((r["rule_id"], r["line_start"], r["confidence"], r["language"]) for r in labeled.collect()) == [
        ("aws-access-key", 3, 0.95, "python"), ("generic-secret", 2, 0.75, "python"),
    ]


def test_reports_with_missing_parts(spark):
    def table(*objects):
        return spark.createDataFrame([("r", o if isinstance(o, str) else json.dumps(o)) for o in objects], "repo string, json string")

    assert I.ingest_bandit(table({}, {"results": []}, "no json")).count() == 0
    osv = {"results": [{"packages": [{"package": {"name": "p"}, "vulnerabilities": [
        {"id": "A", "severity": [{"score": "7.5"}]}, {"id": "B", "database_specific": {"severity": "HIGH"}}, {"id": "C"},
        {"id": "D", "database_specific": {"severity": 9.8}}]}]}]}
    got = {r["rule_id"]: r["severity"] for r in I.ingest_osv(table(osv), "python").collect()}
    assert got == {"osv/A": "high", "osv/B": "low", "osv/C": "medium", "osv/D": "critical"}
    npm = {"vulnerabilities": {"x": {"severity": "moderate", "via": ["y"], "fixAvailable": False}}}
    (row,) = I.ingest_npm_audit(table(npm)).collect()
    assert row["severity"] == "medium" and row["references"] == [] and "see npm audit" in row["message"]
    cov = {"files": {"a.py": {"summary": {"percent_covered": 10.25}, "missing_lines": list(range(1, 14))},
                     "test_a.py": {"summary": {"percent_covered": 0}}, "b.py": {}}}
    (row,) = I.ingest_coverage(table(cov)).collect()
    assert row["severity"] == "high" and row["remediation"].endswith("1, 2, 3, 4, 5, 6, 7, 8, 9, 10")


def test_thresholds(spark):
    text = "# c\ncode_structure:\n  max-nesting_depth: 7\n  max_function_length: 60\n  max_function_length: 61\nodd:\n  a: 1\n"
    over = T.parse_overrides(spark.createDataFrame([("r", text)], "repo string, content string"))
    base, pack = T.layer_rows(spark)
    repos = spark.createDataFrame([("r", "go"), ("q", "go")], "repo string, language string")
    rows = {(r["repo"], r["key"]): r["value"] for r in T.resolve_thresholds(repos, base, pack, over).collect()}
    assert rows[("r", "max_nesting_depth")] == "7" and rows[("q", "max_nesting_depth")] == "5"
    assert rows[("r", "max_function_length")] == "61" and ("r", "a") not in rows


def _saves(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("r", "a.py", t0 + datetime.timedelta(milliseconds=ms), f"eval({ms})", ) for ms in (0, 300, 700, 2000, 2100)]
    rows.append(("r", "b.py", t0, "pass"))
    return spark.createDataFrame(rows, "repo string, uri string, ts timestamp, content string")


def test_debounce(spark):
    got = sorted((r["uri"], r["content"], r["saves"]) for r in ST.debounce_saves(_saves(spark)).collect())
    assert got == [("a.py", "eval(2100)", 2), ("a.py", "eval(700)", 3), ("b.py", "pass", 1)]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    _saves(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, uri string, ts timestamp, content string").parquet(str(tmp_path / "in"))
    ST.scan_stream(stream, str(tmp_path / "log"), str(tmp_path / "state"), "info").awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log/findings"))
    scans = spark.read.parquet(str(tmp_path / "log/scans"))
    assert scans.count() == 2
    latest = ST.latest_findings(log, scans)
    assert [(r["file"], r["rule_id"]) for r in latest.collect()] == [("a.py", "python/eval-usage")]
    later = scans.agg(F.max("scan_id")).first()[0] + 1
    clear = spark.createDataFrame([("r", None, later, True)], "repo string, file string, scan_id int, cleared boolean")
    assert ST.latest_findings(log, scans.unionByName(clear)).count() == 0


def test_apply_config(spark):
    log = spark.createDataFrame(
        [("r", "enabled", "false", 2), ("r", "enabled", "true", 1), ("q", "severityThreshold", "low", 1)],
        "repo string, key string, value string, ts int",
    )
    events = spark.createDataFrame([("r", 1), ("q", 2), ("p", 3)], "repo string, n int")
    got = {(r["repo"], r["severityThreshold"]) for r in ST.apply_config(events, log).collect()}
    assert got == {("q", "low"), ("p", "medium")}


def test_user_rule_runs_with_the_scan(sources):
    registry.register_sql_rule(
        "user/todo", "python", "SELECT repo, path, line, pre AS ordinal FROM {code} WHERE kind = 'Pass'",
        antipattern="todo", name="Todo", message="pass", remediation="write it",
    )
    try:
        found = scan(sources({"a.py": "def f():\n    pass\n"}), languages=("python",))
        assert [(r["rule_id"], r["line_start"]) for r in found.collect()] == [("user/todo", 2)]
    finally:
        registry.unregister_rule("user/todo")


def test_report(spark, sources, tmp_path):
    found = scan(sources({"a.py": "eval(x)\n"}), languages=("python",))
    meta = scan_meta(found.select("repo").distinct(), sha="s", languages_detected=["python"])
    outputs = write_report(found, meta, str(tmp_path / "out"))
    assert outputs.first()["critical_count"] == 1
    assert spark.read.json(str(tmp_path / "out/summary")).first()["total"] == 1
    assert spark.read.json(str(tmp_path / "out/findings")).filter(F.col("repo") == "r").count() == 1
