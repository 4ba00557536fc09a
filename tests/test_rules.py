"""Whole samples with exactly the findings they must give."""

import pytest
from pyspark.sql import functions as F

from lintlake.operators import rules_go, rules_python, rules_typescript
from lintlake.operators.findings import validate_findings
from lintlake.operators.metrics import function_metrics
from lintlake.operators.pynodes import errors_of, parse_errors, py_nodes, py_parse
from lintlake.operators.relations import code_rows
from lintlake.plans import registry
from lintlake.plans.scan import Relations, _apply, scan
from tests.conftest import sample

GO = {
    ("go/unchecked-error", 45, 45, "high"): 1, ("go/unchecked-error", 46, 46, "high"): 1,
    ("go/unchecked-error", 48, 48, "high"): 1, ("go/unchecked-error", 51, 51, "high"): 4,
    ("go/bare-goroutine", 35, 35, "medium"): 1, ("go/deep-nesting", 60, 79, "medium"): 1,
    ("go/magic-number", 12, 12, "low"): 1, ("go/magic-number", 51, 51, "low"): 1,
    ("go/magic-number", 57, 57, "low"): 1, ("go/magic-number", 69, 69, "low"): 1,
    ("go/empty-interface-abuse", 60, 60, "medium"): 1, ("go/context-not-first", 60, 60, "medium"): 1,
    ("go/large-interface", 14, 14, "medium"): 1, ("go/init-side-effects", 23, 29, "medium"): 1,
    ("go/defer-in-loop", 34, 34, "high"): 2, ("go/defer-in-loop", 39, 39, "high"): 2,
    ("go/error-string-format", 47, 47, "low"): 1, ("go/goroutine-closure-capture", 35, 35, "high"): 1,
    ("go/tls-insecure-skip", 54, 54, "critical"): 1, ("go/sql-string-concat", 55, 55, "high"): 1,
    ("go/weak-rand", 57, 57, "high"): 1,
}
TS = {
    ("ts/deep-nesting", 6, 18, "high"): 1, ("ts/magic-number", 2, 2, "low"): 1,
    ("ts/magic-number", 3, 3, "low"): 1, ("ts/magic-number", 7, 7, "low"): 1,
    ("ts/magic-number", 8, 8, "low"): 1, ("ts/magic-number", 11, 11, "low"): 1,
    ("ts/magic-number", 31, 31, "low"): 1, ("ts/magic-number", 34, 34, "low"): 3,
    ("ts/magic-number", 37, 37, "low"): 1, ("ts/assertion-roulette", 36, 36, "medium"): 1,
    ("ts/any-type-abuse", 6, 38, "medium"): 1, ("ts/callback-hell", 30, 31, "medium"): 1,
    ("ts/callback-hell", 30, 30, "medium"): 1, ("ts/promise-no-catch", 24, 25, "medium"): 1,
    ("ts/promise-no-catch", 24, 29, "medium"): 1, ("ts/console-log-left", 34, 34, "low"): 1,
    ("ts/non-null-assertion", 27, 28, "medium"): 1, ("ts/eval-usage", 21, 22, "critical"): 1,
    ("ts/eval-usage", 23, 23, "critical"): 1, ("ts/innerhtml-assignment", 19, 20, "high"): 1,
}
TS_TEST = {
    ("ts/assertion-roulette", 10, 10, "medium"): 1, ("ts/excessive-mocking", 1, 2, "medium"): 1,
    ("ts/test-no-assertion", 4, 6, "medium"): 1, ("ts/test-no-assertion", 9, 9, "medium"): 1,
}
PY = {
    ("python/mutable-default-argument", 4, 4, "high"): 3, ("python/cognitive-complexity", 62, 75, "high"): 1,
    ("python/deep-nesting", 38, 50, "medium"): 1, ("python/deep-nesting", 52, 60, "medium"): 1,
    ("python/bare-except", 10, 11, "high"): 1, ("python/bare-except", 14, 15, "high"): 1,
    ("python/wildcard-import", 2, 2, "medium"): 1, ("python/magic-number", 5, 5, "low"): 1,
    ("python/magic-number", 7, 7, "low"): 1, ("python/n-plus-one-query", 18, 22, "high"): 1,
    ("python/n-plus-one-query", 19, 22, "high"): 1, ("python/datetime-now-naive", 23, 23, "medium"): 1,
    ("python/datetime-now-naive", 24, 24, "medium"): 1, ("python/string-format-sql", 26, 26, "high"): 1,
    ("python/string-format-sql", 27, 27, "high"): 1, ("python/string-format-sql", 28, 28, "high"): 1,
    ("python/isinstance-chain", 39, 50, "medium"): 1, ("python/isinstance-chain", 41, 50, "medium"): 1,
    ("python/eval-usage", 29, 29, "critical"): 1, ("python/yaml-unsafe-load", 30, 30, "high"): 1,
    ("python/file-not-closed", 32, 32, "medium"): 1,
}


def counted(df):
    out = {}
    for r in df.select("rule_id", "line_start", "line_end", "severity").collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


@pytest.mark.parametrize(
    "path, name, language, expected",
    [
        ("a.go", "sample.go.txt", "go", GO),
        ("a.ts", "sample.ts.txt", "typescript", TS),
        ("b.test.ts", "sample.test.ts.txt", "typescript", TS_TEST),
        ("a.py", "sample.py.txt", "python", PY),
    ],
)
def test_samples(sources, path, name, language, expected):
    found = scan(sources({path: sample(name)}), languages=(language,)).cache()
    assert counted(found) == expected
    assert {r["violations"] for r in validate_findings(found).collect()} == {0}
    ids = [r["id"] for r in found.select("id").collect()]
    assert len(ids) == len(set(ids))
    found.unpersist()


def test_result_does_not_depend_on_partitions(spark, sources):
    files = {f"f{i}.go": sample("sample.go.txt") for i in range(7)}
    src = sources(files)
    one = rules_go.defer_in_loop(code_rows(src.coalesce(1), "go")).select("file", "line_start", "id")
    many = rules_go.defer_in_loop(code_rows(src.repartition(5), "go")).select("file", "line_start", "id")
    assert sorted(one.collect()) == sorted(many.collect())
    assert one.count() == 28


def test_god_struct_limit_is_a_parameter(sources):
    text = "package p\n" + "".join(f"func (s *S) M{i}() {{}}\n" for i in range(18))
    rows = code_rows(sources({"a.go": text}), "go")
    assert rules_go.god_struct(rows).count() == 1
    assert rules_go.god_struct(rows, {"god_struct_method_count": "20"}).count() == 0


def test_python_files_that_do_not_parse(sources):
    src = sources({"bad.py": "def (", "good.py": "eval(x)\n"})
    assert [r["path"] for r in parse_errors(src).collect()] == ["bad.py"]
    assert rules_python.eval_usage(py_nodes(src)).count() == 1


def test_test_without_assertion(sources):
    text = "def test_a():\n    go()\ndef test_b():\n    assert 1\nclass T:\n    def test_c(self):\n        self.assertEqual(1, 2)\n"
    found = rules_python.test_no_assertion(py_nodes(sources({"test_x.py": text, "x.py": text})))
    assert [(r["file"], r["line_start"]) for r in found.collect()] == [("test_x.py", 1)]


def test_strict_promise_mode(sources):
    rows = code_rows(sources({"a.ts": "a.then(b).catch(c);\nd.then(e);\n"}), "typescript")
    assert rules_typescript.promise_no_catch(rows).count() == 2
    assert [r["line_start"] for r in rules_typescript.promise_no_catch(rows, strict=True).collect()] == [2]


def test_rules_ignore_strings_and_comments(sources):
    text = "// eval(x)\n/* eval(y)\n*/ const a = 'eval(z)' + `eval(${w})` + /eval(u)/.source;\neval(v);\n"
    rows = code_rows(sources({"a.js": text}), "javascript")
    assert [r["line_start"] for r in rules_typescript.eval_usage(rows).collect()] == [4]


def test_long_tokens_do_not_use_the_stack(sources):
    text = "/* " + "x*" * 100_000 + " */\nconst a = '" + "y\\'" * 60_000 + "';\neval(b);\n"
    rows = code_rows(sources({"a.js": text}), "javascript")
    assert [r["line_start"] for r in rules_typescript.eval_usage(rows).collect()] == [3]


def test_apply_passes_what_a_rule_asks_for(sources):
    src = sources({"a.py": "def f():\n    x = 3.5\n    y = 7  # 0x7\n"})
    found = _apply(rules_python.magic_number, py_nodes(src), src, None)
    assert [r["line_start"] for r in found.collect()] == [2]


@pytest.mark.parametrize("language, module", [("go", rules_go), ("typescript", rules_typescript)])
def test_rules_read_the_relation_once(sources, language, module):
    src = sources({"a.go": "package p\n", "a.ts": "f()\n"})
    for rule_id, rule in module.RULES.items():
        plan = _apply(rule, code_rows(src, language), src, None)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan, rule_id
        assert plan.count("RepartitionByExpression") == 1, rule_id
    metrics = function_metrics(code_rows(src, language), language)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in metrics and metrics.count("RepartitionByExpression") == 1


def test_goroutines_behind_a_bracket_too_many(sources):
    """Levels go below zero there; a guard still belongs to its own statement."""
    text = "package p\n)}\nfunc F() {\n\tfor {\n\t\tgo b()\n\t\tgo func() { defer func() { recover() }() }()\n\t}\n}\n"
    rows = code_rows(sources({"a.go": text}), "go")
    assert [r["line_start"] for r in rules_go.bare_goroutine(rows).collect()] == [5]
    plain = code_rows(sources({"a.go": text.replace(")}\n", "", 1)}), "go")
    assert [r["line_start"] for r in rules_go.bare_goroutine(plain).collect()] == [4]


def test_god_struct_reads_the_first_token_of_a_method(sources):
    """No aggregation over all tokens of all declarations."""
    text = "package p\n" + "func (s *Store) A() {\n\tx := func() {}\n}\n" * 9 + "func (Store) B() {}\n" * 8 + "func free() {}\n"
    found = rules_go.god_struct(code_rows(sources({"a.go": text}), "go"))
    assert [(r["line_start"], r["message"]) for r in found.collect()] == [(2, "Type 'Store' has 17 methods in one file.")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def test_the_table_function_runs_on_spread_files(spark, tmp_path):
    from harness.queries import QUERIES

    rows = [(i, f"part {i}", f"Brand#{i % 3}", i) for i in range(50)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["source_nodes_udtf"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert found.count() == 50


def test_kept_nodes_are_all_that_rules_read(spark, sources):
    """Rules and metrics find the same in the nodes that a scan keeps as in all nodes."""
    from harness.plants import PLANTS

    rows = [(i, f"part {i}", "b", i) for i in range(1, 46)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int")
    from harness.plants import planted

    src = sources({"sample.py": sample("sample.py.txt"), "tests/test_x.py": sample("sample.py.txt"), "bad.py": "def f(:"})
    for plant in PLANTS:
        if plant.language == "python":
            src = src.unionByName(planted(part, plant).withColumn("repo", F.lit(plant.rule_id)))
    every = py_parse(src).cache()
    kept = every.filter(rules_python.read_by_rules()).cache()
    assert kept.count() < every.count() / 2
    key = lambda df: sorted(map(str, df.drop("detected_at").collect()))
    for rule in (*rules_python.RULES.values(), lambda nodes: function_metrics(nodes, "python"), errors_of):
        assert key(rule(kept)) == key(rule(every))


def test_a_user_rule_after_the_parse_sees_every_node(spark, sources):
    relations = Relations(sources({"a.py": "x = y.z\n"}))
    relations.of("python")
    registry.register_sql_rule(
        "user/late", "python", "SELECT repo, path, line, pre AS ordinal FROM {code} WHERE kind = 'Attribute'",
        antipattern="a", name="A", message="m", remediation="r",
    )
    try:
        found = scan(relations.src, languages=("python",), relations=relations)
        assert [r["rule_id"] for r in found.collect()] == ["user/late"]
    finally:
        registry.unregister_rule("user/late")
        relations.release()


def test_scan_query_parses_once(spark, tmp_path):
    """The rules read what one parse left; none of them has a parse in its plan."""
    from harness.queries import QUERIES

    rows = [(i, f"part {i}", f"Brand#{i % 3}", i) for i in range(1, 9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["scan_python"](spark, str(tmp_path))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
