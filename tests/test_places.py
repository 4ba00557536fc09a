"""Where tokens stand, against a direct walk; files of many chunks, files of the same name."""

import random

import pyarrow as pa
import pytest

from lintlake.operators import places, rules_go, rules_typescript
from lintlake.operators import relations as R
from lintlake.plans.scan import _apply

CLOSING = {"(": ")", "[": "]", "{": "}"}


def text_of(seed: int, length: int) -> str:
    rng, out, stack = random.Random(seed), [], []
    for _ in range(length):
        move = rng.random()
        if move < 0.25:
            stack.append(rng.choice("([{"))
            out.append(rng.choice(["", "f ", "function g ", "class A ", "if "]) + stack[-1])
        elif move < 0.5 and stack:
            out.append(CLOSING[stack.pop()])
        else:
            out.append(rng.choice(["x", ",", "=", ";", "x . y", "\n"]))
    return " ".join(out)


def walk(toks: list[str]) -> list[tuple]:
    """Closing bracket, bracket around, statement, and the latest ``(``, ``=`` and ``function`` of the place."""
    out, close, open_at = [], {}, []
    # what was seen at a depth stays when the bracket closes
    depths: dict[int, dict] = {0: {"at": None, "stmt": 1}}
    for i, tok in enumerate(toks, 1):
        if tok in CLOSING.values():
            close[open_at.pop()] = i
        here = depths[len(open_at)]
        if tok in (";", "}"):
            here["stmt"] = i + 1
        out.append((here["at"], here["stmt"], here.get("("), here.get("="), here.get("function")))
        here[tok] = i
        if tok in CLOSING:
            open_at.append(i)
            depths.setdefault(len(open_at), {}).update(at=i, stmt=i + 1)
    return [(close.get(i), *facts) for i, facts in enumerate(out, 1)]


def test_tokens_stand_where_a_walk_puts_them(sources):
    files = {f"f{n}.ts": text_of(n, length) for n, length in enumerate([0, 1, 40, places.CHUNK - 1, 3 * places.CHUNK + 5, 5000])}
    files["deep.ts"] = "f ( { " * 900 + "class A { m() {} } " + "} ) " * 900
    rows = R.code_rows(sources(files), "typescript").orderBy("path", "idx").collect()
    found = {}
    for r in rows:
        found.setdefault(r.path, []).append(r)
    assert sorted(found) == sorted(p for p, t in files.items() if t.strip())
    assert max(len(v) for v in found.values()) > 4 * places.CHUNK
    for mine in found.values():
        toks = [r.tok for r in mine]
        assert [r.idx for r in mine] == list(range(1, len(mine) + 1))
        at = lambda i: toks[i - 1] if i is not None and 1 <= i <= len(toks) else None  # noqa: E731, B023
        of = lambda s: s and s.idx
        got = [(r.close, r.encl, r.stmt, of(r.last_open), of(r.last_assign), of(r.last_func)) for r in mine]
        assert got == walk(toks)
        for r in mine:
            assert [r[f"p{i}"] for i in range(1, 9)] == [at(r.idx - i) for i in range(1, 9)]
            assert [r[f"n{i}"] for i in range(1, 7)] == [at(r.idx + i) for i in range(1, 7)]
            if r.close:
                assert (r.close_line, r.after, r.after2) == (mine[r.close - 1].line, at(r.close + 1), at(r.close + 2))
            if r.last_open:
                seen = mine[r.last_open.idx - 1]
                assert tuple(r.last_open)[1:] == (seen.line, seen.p1, seen.p2, seen.p3)
            if r.last_func:
                seen = mine[r.last_func.idx - 1]
                assert tuple(r.last_func)[1:] == (seen.line, seen.inside, seen.p1, *(seen[f"n{i}"] for i in range(1, 7)))


def test_texts_of_one_name_go_by_place(spark):
    rows = [("r", "a.ts", "a b {"), ("r", "a.ts", "c d }"), ("r", "a.ts", None), (None, None, "{ }"), ("r", "b.ts", "")]
    got = R.code_rows(spark.createDataFrame(rows, "repo string, path string, content string").coalesce(1), "typescript")
    named = sorted((r.idx, r.pos) for r in got.filter("repo = 'r'").collect())
    assert named == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2)]
    assert [(r.path, r.close) for r in got.filter("repo IS NULL").orderBy("idx").collect()] == [(None, 2), (None, None)]


def test_god_class_sorts_no_tokens(sources):
    """The tokens of a file were sorted three times, the last time twice over with all facts."""
    src = sources({"a.ts": "class A { m() {} }\n"})
    plan = rules_typescript.god_class(R.code_rows(src, "typescript"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("language, module", [("go", rules_go), ("typescript", rules_typescript)])
def test_rules_shuffle_the_source_alone(sources, language, module):
    src = sources({"a.go": "package p\n", "a.ts": "f()\n"})
    for rule_id, rule in module.RULES.items():
        plan = _apply(rule, R.code_rows(src, language), src, None)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, rule_id


def test_god_class_in_a_long_file(sources):
    methods = "".join(f"  m{i}(a: number): void {{ if (a) {{ go([a], {{ b: 1 }}); }} }}\n" for i in range(400))
    text = "const f = function () {};\n" + "x(1);\n" * 700 + "class Big extends Base {\n" + methods + "}\nclass Small { a() {} }\n"
    found = rules_typescript.god_class(R.code_rows(sources({"a.ts": text}), "typescript")).collect()
    assert [(r["line_start"], r["line_end"], r["severity"], r["message"]) for r in found] == [(702, 1103, "high", "Class 'Big' has 400 methods.")]


def test_files_are_whole_however_rows_come():
    rows = [("r", "a", ["a", "("]), ("r", "a", None), ("r", "a", ["c", ")"]), ("r", "b", ["{", "}"]), (None, "b", ["x"]), (None, "b", ["y"])]
    schema = pa.schema([("of_repo", pa.string()), ("of_path", pa.string()), ("toks", pa.list_(pa.string()))])
    one = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    want = pa.Table.from_batches(places._places(iter([one]), False)).to_pylist()
    assert [(r["path"], r["toks"], r["pos"]) for r in want] == [
        ("a", ["a", "c", "(", ")"], [0, 0, 1, 1]), ("b", ["{", "}"], [0, 1]), ("b", ["x", "y"], [0, 0]),
    ]
    for size in (1, 2, 3, 5):
        parts = (one.slice(i, size) for i in range(0, len(rows), size))
        assert pa.Table.from_batches(places._places(parts, False)).to_pylist() == want
