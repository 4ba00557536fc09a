"""Code planted in every row of ``part``, with what each rule must report on it.

Each plant is a text built from the row's columns and a closed form, in SQL, of the
findings that the rule has to give. Inside the expressions ``k`` is the part's key, ``n``
its size, ``w`` its name as an identifier and ``i`` counts repeats from 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.plans.catalogue import BY_ID

SUFFIX = {"python": ".py", "typescript": ".ts", "go": ".go"}


@dataclass(frozen=True)
class Case:
    """Findings of a plant: where they apply, how many, and their lines."""

    line: str
    end: str | None = None
    where: str = "true"
    times: str = "1"
    severity: str | None = None
    effort: str | None = None
    antipattern: str | None = None


@dataclass(frozen=True)
class Plant:
    rule_id: str
    language: str
    content: str
    cases: tuple = field(default_factory=tuple)
    path: str | None = None

    def path_sql(self) -> str:
        return self.path or f"concat('src/part_', k, '{SUFFIX[self.language]}')"


def nest(opening: str, depth: str, unit: str = "    ", base: str = "1") -> str:
    """Spark SQL for ``depth`` lines that each open a block one level deeper."""
    return (
        f"array_join(transform(slice(sequence(0, 60), 1, cast({depth} as int)),"
        f" d -> concat(repeat('{unit}', d + {base}), '{opening}\\n')), '')"
    )


def close(depth: str, unit: str = "  ", base: str = "1") -> str:
    """Spark SQL for the closing braces of ``nest``."""
    return (
        f"array_join(reverse(transform(slice(sequence(0, 60), 1, cast({depth} as int)),"
        f" d -> concat(repeat('{unit}', d + {base}), '}}\\n'))), '')"
    )


PLANTS = [
    # Python
    Plant(
        "python/mutable-default-argument", "python",
        r"concat(repeat('import os\n', n % 5), CASE n % 3 WHEN 0 THEN 'def f(a, b=[], *, c={}):\n'"
        r" WHEN 1 THEN 'def f(a, b=set(), c=None, d=()):\n' ELSE 'async def f(b={1, 2}):\n' END, '    return a\n')",
        (Case("n % 5 + 1", where="n % 3 = 0", times="2"), Case("n % 5 + 1", where="n % 3 = 2")),
    ),
    Plant(
        "python/cognitive-complexity", "python",
        "concat('def f(b):\\n', " + nest("for a in b:", "n % 4 + 2") + ","
        r" CASE WHEN n % 7 = 0 THEN concat(repeat('    ', n % 4 + 3), 'go()\n') ELSE"
        r" repeat(concat(repeat('    ', n % 4 + 3), 'if a:\n', repeat('    ', n % 4 + 4), 'go()\n'), n % 7) END)",
        (
            Case(
                "1",
                end="1 + (n % 4 + 2) + CASE WHEN n % 7 = 0 THEN 1 ELSE 2 * (n % 7) END",
                where="(n % 4 + 2) * (n % 4 + 3) / 2 + (n % 7) * (n % 4 + 3) >= 20",
                severity="CASE WHEN (n % 4 + 2) * (n % 4 + 3) / 2 + (n % 7) * (n % 4 + 3) < 25 THEN 'medium' ELSE 'high' END",
            ),
        ),
    ),
    Plant(
        "python/deep-nesting", "python",
        "concat('def f(x):\\n', " + nest("if x:", "n % 9 + 1") + ","
        r" repeat('    ', n % 9 + 2), CASE WHEN n % 2 = 0 THEN 'f(x)\n' ELSE 'go(x)\n' END)",
        (
            Case(
                "1", end="n % 9 + 3",
                where="n % 9 + 1 >= 5 + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END",
                severity="CASE WHEN n % 9 + 1 < 7 + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END THEN 'medium' ELSE 'high' END",
            ),
        ),
    ),
    Plant(
        "python/bare-except", "python",
        r"concat(repeat('# x\n', n), 'try:\n    go()\n', CASE n % 3 WHEN 0 THEN 'except:\n    pass\n'"
        r" WHEN 1 THEN 'except:\n    log()\n    pass\n' ELSE 'except ValueError:\n    pass\n' END)",
        (
            Case("n + 3", end="n + 4", where="n % 3 = 0", antipattern="'exception_sink'"),
            Case("n + 3", end="n + 5", where="n % 3 = 1"),
        ),
    ),
    Plant(
        "python/wildcard-import", "python",
        r"concat('import os\n', repeat(concat('from m', n, ' import *\n'), n % 4), 'from x import y\n')",
        (Case("i + 2", times="n % 4"),),
    ),
    Plant(
        "python/magic-number", "python",
        r"concat('RATE = ', n, '\ndef f(a):\n    LIMIT = ', n, '\n    b = ', n, '\n    c = -', n, '\n    go(', n, ', k=', n, ')\n"
        r"    d = ', n, '  # 0x10\n    e = a * ', n, '\n    if a > ', n, ':\n        return [', n, ']\n    return ', n, '.5\n')",
        (
            Case("4", where="n NOT IN (0, 1, 2, 100)"),
            Case("5", where="n NOT IN (0, 1, 2, 100)"),
            Case("11"),
        ),
    ),
    Plant(
        "python/n-plus-one-query", "python",
        r"concat('for u in users:\n    for ', CASE WHEN n % 2 = 0 THEN 'v' ELSE 'attempt' END, ' in range(3):\n        ',"
        r" CASE n % 3 WHEN 0 THEN 'Q.filter(a=1)' WHEN 1 THEN 'q.get(pk=u)' ELSE 'd.get(\"key\", x=1)' END, '\n')",
        (Case("1", end="3", where="n % 3 <> 2"), Case("2", end="3", where="n % 3 <> 2 AND n % 2 = 0")),
    ),
    Plant(
        "python/datetime-now-naive", "python",
        r"concat(repeat('a = datetime.now()\n', n % 3), repeat('b = dt.datetime.now()\n', n % 2),"
        r" 'c = datetime.now(tz=utc)\nd = datetime.now(utc)\ne = time.now()\n')",
        (Case("i + 1", times="n % 3 + n % 2"),),
    ),
    Plant(
        "python/string-format-sql", "python",
        r"concat(repeat('# x\n', n), CASE n % 5 WHEN 0 THEN 'c.execute(f\"select {x}\")' WHEN 1 THEN 'c.raw(\"a {}\".format(x))'"
        r" WHEN 2 THEN 'c.executemany(\"a %s\" % x)' WHEN 3 THEN 'c.execute(\"a %s\", (x,))' ELSE 'c.run(f\"{x}\")' END, '\n')",
        (Case("n + 1", where="n % 5 < 3"),),
    ),
    Plant(
        "python/isinstance-chain", "python",
        r"concat('if isinstance(x, A0):\n    go()\n', array_join(transform(slice(sequence(1, 60), 1, n % 9),"
        r" d -> concat('elif isinstance(x, A', d, '):\n    go()\n')), ''), 'else:\n    go()\n')",
        (
            Case(
                "2 * i + 1", end="2 * (n % 9 + 1) + 2", times="greatest(n % 9 + 1 - 3, 0)",
                severity="CASE WHEN n % 9 + 1 - i < 6 THEN 'medium' ELSE 'high' END",
            ),
        ),
    ),
    Plant(
        "python/eval-usage", "python",
        r"concat(repeat('eval(x)\n', n % 4), repeat('exec(y)\n', n % 3), 'm.eval(z)\n')",
        (Case("i + 1", times="n % 4 + n % 3"),),
    ),
    Plant(
        "python/yaml-unsafe-load", "python",
        r"concat(repeat('yaml.load(x)\n', n % 3), CASE n % 4 WHEN 0 THEN 'yaml.load(x, Loader=SafeLoader)' WHEN 1"
        r" THEN 'yaml.load(x, Loader=yaml.SafeLoader)' WHEN 2 THEN 'yaml.load(x, Loader=yaml.CSafeLoader)' ELSE 'json.load(x)' END, '\n')",
        (Case("i + 1", times="n % 3"), Case("n % 3 + 1", where="n % 4 = 2")),
    ),
    Plant(
        "python/file-not-closed", "python",
        r"concat(repeat('f = open(p)\n', n % 4), 'with open(p) as g, closing(open(q)) as h:\n    pass\n')",
        (Case("i + 1", times="n % 4"), Case("n % 4 + 1")),
    ),
    Plant(
        "python/test-no-assertion", "python",
        r"concat('def test_a():\n    go()\n\ndef test_b():\n    assert x\n\nclass T:\n    def test_c(self):\n        ',"
        r" CASE WHEN n % 2 = 0 THEN 'self.assertEqual(1, 2)' ELSE 'mock.assert_called()' END, '\n\ndef helper():\n    go()\n')",
        (
            Case("1", end="2", where="n % 3 = 0"),
            Case("8", end="9", where="n % 3 = 0 AND n % 2 = 1"),
        ),
        path="concat('src/', CASE WHEN n % 3 = 0 THEN 'test_' ELSE 'case_' END, k, '.py')",
    ),
    # TypeScript
    Plant(
        "ts/deep-nesting", "typescript",
        "concat('function f(x) {\\n', " + nest("if (x) {", "n % 8", "  ") + r", repeat('  ', n % 8 + 1), 'go(x);\n', "
        + close("n % 8") + r", '}\n')",
        (
            Case("1", end="2 * (n % 8) + 3", where="n % 8 >= 4",
                 severity="CASE WHEN n % 8 >= 6 THEN 'high' ELSE 'medium' END"),
        ),
    ),
    Plant(
        "ts/magic-number", "typescript",
        r"concat('const LIMIT = ', n, ';\nlet a = ', n, ';\nfoo(', n, ', b[', n, ']);\nconst o = { p: ', n, ', q: [', n, '] };\n"
        r"function g(h = ', n, ') {\n  return h * ', n, ';\n}\nconst m = h & ', n, ';\nlet hex = 0x1f;\n')",
        (Case("2", where="n > 1"), Case("3", where="n > 1"), Case("6", where="n > 1")),
    ),
    Plant(
        "ts/assertion-roulette", "typescript",
        r"concat(repeat('expect(true).toBe(true);\n', n % 3), CASE n % 4 WHEN 0 THEN 'expect(1).toEqual(1);' WHEN 1"
        r" THEN 'expect(0).toStrictEqual(0);' WHEN 2 THEN 'expect(1).toBe(0);' ELSE 'expect(true).not.toBe(true);' END, '\n')",
        (Case("i + 1", times="n % 3"), Case("n % 3 + 1", where="n % 4 < 2")),
    ),
    Plant(
        "ts/excessive-mocking", "typescript",
        r"concat('// x\n', repeat('jest.mock(\'a\');\n', n % 12), 'vi.mock(\'b\');\n')",
        (Case("2", end="n % 12 + 1", where="n % 12 > 5 AND k % 2 = 0"),),
        path="concat('src/part_', k, CASE WHEN k % 2 = 0 THEN '.test.ts' ELSE '.ts' END)",
    ),
    Plant(
        "ts/god-class", "typescript",
        r"concat('// x\nclass Big {\n  field = 1;\n  constructor() { }\n', array_join(transform(slice(sequence(1, 60), 1, n - 1),"
        r" d -> concat('  m', d, '(a: number): void { go(a); }\n')), ''), '}\n')",
        (Case("2", end="n + 4", where="n > 15", severity="CASE WHEN n > 30 THEN 'high' ELSE 'medium' END"),),
    ),
    Plant(
        "ts/any-type-abuse", "typescript",
        r"concat('const any = 1;\n', repeat('let a: any = x.any;\n', n % 20))",
        (
            Case("2", end="n % 20 + 1", where="n % 20 > 5 AND k % 2 = 0",
                 severity="CASE WHEN n % 20 > 15 THEN 'high' ELSE 'medium' END",
                 effort="CASE WHEN n % 20 > 15 THEN 'days' ELSE 'hours' END"),
        ),
        path="concat('src/part_', k, CASE WHEN k % 2 = 0 THEN '.tsx' ELSE '.js' END)",
    ),
    Plant(
        "ts/ts-ignore-proliferation", "typescript",
        r"concat('go();\n', repeat('// @ts-ignore\nx();\n', n % 7), repeat('// @ts-expect-error\ny();\n', n % 8))",
        (
            Case("2", end="2 * (n % 7 + n % 8)", where="n % 7 + n % 8 > 3",
                 severity="CASE WHEN n % 7 + n % 8 > 10 THEN 'high' ELSE 'medium' END"),
        ),
    ),
    Plant(
        "ts/callback-hell", "typescript",
        r"concat(array_join(transform(slice(sequence(0, 60), 1, n % 8 + 1), d -> concat(repeat('  ', d), 'f', d, '(() => {\n')), ''),"
        r" repeat('  ', n % 8 + 1), 'go();\n', array_join(reverse(transform(slice(sequence(0, 60), 1, n % 8 + 1),"
        r" d -> concat(repeat('  ', d), '});\n'))), ''))",
        (
            Case("i + 4", end="2 * (n % 8 + 1) - i - 2", times="greatest(n % 8 + 1 - 3, 0)",
                 severity="CASE WHEN i + 3 >= 5 THEN 'high' ELSE 'medium' END"),
        ),
    ),
    Plant(
        "ts/promise-no-catch", "typescript",
        r"concat(repeat('load(x)\n  .then(y => z(y))\n  .catch(e);\n', n % 3), 'a.then(\n  b\n);\n')",
        (
            Case("3 * i + 1", end="3 * i + 2", times="n % 3", where="k % 2 = 0"),
            Case("3 * (n % 3) + 1", end="3 * (n % 3) + 3", where="k % 2 = 0"),
        ),
        path="concat('src/part_', k, CASE WHEN k % 2 = 0 THEN '.ts' ELSE '.spec.ts' END)",
    ),
    Plant(
        "ts/console-log-left", "typescript",
        r"concat('go();\n', repeat('console.log(x);\n', n % 5), repeat('console.trace(y);\n', n % 3), 'console.table(z);\n')",
        (Case("2", end="n % 5 + n % 3 + 1", where="n % 5 + n % 3 > 3 AND k % 3 <> 0"),),
        path="concat('src/part_', k, CASE WHEN k % 3 = 0 THEN '.config.ts' ELSE '.ts' END)",
    ),
    Plant(
        "ts/non-null-assertion", "typescript",
        r"concat('if (!a != !b) { }\n', repeat('use(a!.b!);\n', n % 10))",
        (
            Case("2", end="n % 10 + 1", where="2 * (n % 10) > 5",
                 severity="CASE WHEN 2 * (n % 10) > 10 THEN 'high' ELSE 'medium' END"),
        ),
    ),
    Plant(
        "ts/eval-usage", "typescript",
        r"concat(repeat('eval(x);\n', n % 4), 'const f = new Function(\'a\',\n  \'return a\');\nwindow.eval(y);\n')",
        (Case("i + 1", times="n % 4"), Case("n % 4 + 1", end="n % 4 + 2")),
    ),
    Plant(
        "ts/innerhtml-assignment", "typescript",
        r"concat(repeat('a.innerHTML = b;\n', n % 4), 'c.outerHTML +=\n  d;\nif (a.innerHTML === b) { }\na.textContent = b;\n')",
        (Case("i + 1", times="n % 4"), Case("n % 4 + 1", end="n % 4 + 2")),
    ),
    Plant(
        "ts/test-no-assertion", "typescript",
        r"concat('it(\'a\', () => {\n  go();\n});\n', repeat('test(\'b\', async function () {\n  expect(x).toBe(y);\n});\n', n % 3),"
        r" 'it(\'c\', () => go(', n, '));\nit(\'d\');\n')",
        (Case("1", end="3", where="k % 2 = 0"), Case("3 * (n % 3) + 4", where="k % 2 = 0")),
        path="concat('src/', CASE WHEN k % 2 = 0 THEN '__tests__' ELSE 'lib' END, '/part_', k, '.ts')",
    ),
    # Go
    Plant(
        "go/unchecked-error", "go",
        r"concat('package p\n\nfunc f() {\n', repeat('\t_, _ = g(), h()\n', n % 3), '\tif _, err := m.get(', n, '); err != nil {\n\t}\n"
        r"\t_ = x\n\t_ = !g()\n\tfor _, v := range g() {\n\t}\n}\n')",
        (Case("i + 4", times="n % 3"), Case("i + 4", times="n % 3"), Case("i + 4", times="n % 3"),
         Case("i + 4", times="n % 3"), Case("n % 3 + 4")),
    ),
    Plant(
        "go/bare-goroutine", "go",
        r"concat('package p\n\nfunc f() {\n', repeat('\tgo g()\n', n % 4), '\tgo func() {\n\t\tdefer func() { recover() }()\n\t}()\n}\n')",
        (Case("i + 4", times="n % 4"),),
    ),
    Plant(
        "go/deep-nesting", "go",
        "concat('package p\\n\\nfunc f() {\\n', " + nest("for x {", "n % 9", "\\t") + r", repeat('\t', n % 9 + 1), 'go()\n', "
        + close("n % 9", "\\t") + r", '}\n')",
        (
            Case("3", end="2 * (n % 9) + 5", where="n % 9 >= 5",
                 severity="CASE WHEN n % 9 >= 7 THEN 'high' ELSE 'medium' END"),
        ),
    ),
    Plant(
        "go/god-struct", "go",
        r"concat('package p\n\n', array_join(transform(slice(sequence(1, 60), 1, n), d -> concat('func (s *Store) M', d, '() {}\n')), ''),"
        r" 'func (o Other) A() {}\nfunc free() {}\n')",
        (Case("3", where="n > 15", severity="CASE WHEN n > 30 THEN 'high' ELSE 'medium' END"),),
    ),
    Plant(
        "go/magic-number", "go",
        r"concat('package p\n\nconst A = ', n, '\n\nvar size = ', n, '\nvar q = ', n, '\n\nfunc f() {\n\tx := ', n, '\n\tos.Chmod(p, 0644)\n"
        r"\ty := 0xff\n\tz := ', n, '.5\n}\n')",
        (
            Case("6", where="n NOT IN (0, 1, 2, 100) AND k % 2 = 0"),
            Case("9", where="n NOT IN (0, 1, 2, 100) AND k % 2 = 0"),
            Case("12", where="k % 2 = 0"),
        ),
        path="concat('src/part_', k, CASE WHEN k % 2 = 0 THEN '.go' ELSE '_test.go' END)",
    ),
    Plant(
        "go/empty-interface-abuse", "go",
        r"concat('package p\n', repeat('\n', n % 3), 'func f(a', repeat(', x any', n % 5), ') {}\n')",
        (Case("n % 3 + 2", where="n % 5 > 1"),),
    ),
    Plant(
        "go/context-not-first", "go",
        r"concat('package p\n\nfunc f(', CASE n % 3 WHEN 0 THEN 'a, b int, ctx context.Context' WHEN 1 THEN 'ctx context.Context, a int'"
        r" ELSE 'ctx context.Context' END, ') {}\n')",
        (Case("3", where="n % 3 = 0"),),
    ),
    Plant(
        "go/large-interface", "go",
        r"concat('package p\n\ntype Big interface {\n\tio.Reader\n', repeat('\tM()\n', n % 14), '}\n')",
        (Case("3", where="n % 14 + 1 > 5", severity="CASE WHEN n % 14 + 1 > 10 THEN 'high' ELSE 'medium' END"),),
    ),
    Plant(
        "go/init-side-effects", "go",
        r"concat('package p\n\nfunc init() {\n', repeat('\tg()\n', n % 5), '\tif x := h(); x {\n\t\ty++\n\t}\n}\n')",
        # the body, the calls, and for the branch: itself, its header, its block, its statement
        (Case("3", end="n % 5 + 7", where="1 + n % 5 + 4 > 5"),),
    ),
    Plant(
        "go/defer-in-loop", "go",
        "concat('package p\\n\\nfunc f() {\\n\\tdefer a()\\n', " + nest("for x {", "n % 4", "\\t") + r", repeat('\t', n % 4 + 1),"
        r" 'defer c.Close()\n', " + close("n % 4", "\\t") + r", '}\n')",
        (Case("n % 4 + 5", times="n % 4"),),
    ),
    Plant(
        "go/error-string-format", "go",
        r"concat('package p\n\nfunc f() {\n', repeat('\terrors.New(fmt.Sprintf(\"a %d\", x))\n', n % 4), '\terrors.New(\"b\")\n\tfmt.Errorf(\"c\")\n}\n')",
        (Case("i + 4", times="n % 4"),),
    ),
    Plant(
        "go/goroutine-closure-capture", "go",
        r"concat('package p\n\nfunc f() {\n\tfor ', CASE n % 3 WHEN 0 THEN '_, v := range x' WHEN 1 THEN 'v := 0; v < 3; v++' ELSE 'i, v := range x' END,"
        r" ' {\n\t\tgo func() {\n\t\t\tuse(v)\n\t\t}()\n\t\tgo func(v int) {\n\t\t}(v)\n\t}\n}\n')",
        (Case("5", where="n % 3 <> 2"),),
    ),
    Plant(
        "go/tls-insecure-skip", "go",
        r"concat('package p\n\nvar c = &tls.Config{\n', repeat('\tInsecureSkipVerify: true,\n', n % 4), '\tInsecureSkipVerify: false,\n}\n')",
        (Case("i + 4", times="n % 4"),),
    ),
    Plant(
        "go/sql-string-concat", "go",
        r"concat('package p\n\nfunc f() {\n', repeat('\tdb.Query(\"a\" + x)\n', n % 3), '\tdb.Exec(\"a\", b + c)\n\tdb.QueryRow(a + b, c)\n}\n')",
        (Case("i + 4", times="n % 3"), Case("n % 3 + 5")),
    ),
    Plant(
        "go/weak-rand", "go",
        r"concat('package p\n\nimport \"', CASE WHEN n % 2 = 0 THEN 'crypto/sha256' ELSE 'fmt' END, '\"\n\nfunc f() {\n',"
        r" repeat('\tx := rand.Intn(5)\n', n % 4), CASE WHEN n % 3 = 0 THEN '\tapiToken := 1\n' ELSE '' END, '\trand.Seed(1)\n}\n')",
        (Case("i + 6", times="n % 4", where="n % 2 = 0 OR n % 3 = 0"),),
    ),
]
BY_RULE = {p.rule_id: p for p in PLANTS}


def planted(part: DataFrame, plant: Plant) -> DataFrame:
    """``(repo, path, ext, content)`` with the plant's text in every part."""
    named = part.select(
        F.col("p_brand").alias("repo"),
        F.col("p_partkey").alias("k"),
        F.col("p_size").alias("n"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("w"),
    )
    return named.select(
        "repo",
        F.expr(plant.path_sql()).alias("path"),
        F.lit(SUFFIX[plant.language]).alias("ext"),
        F.expr(plant.content).alias("content"),
    )


def expected_sql(plant: Plant) -> str:
    """The findings of a plant as SQL over ``part``."""
    rule = BY_ID[plant.rule_id]
    parts = []
    for case in plant.cases:
        line = f"CAST({case.line} AS INTEGER)"
        end = line if case.end is None else f"CAST({case.end} AS INTEGER)"
        parts.append(
            f"SELECT repo, {plant.path_sql()} AS file, '{rule.rule_id}' AS rule_id,"
            f" {case.antipattern or repr(rule.antipattern)} AS antipattern,"
            f" '{rule.category}' AS category,"
            f" {case.severity or repr(rule.severity)} AS severity,"
            f" CAST({rule.confidence} AS DOUBLE) AS confidence,"
            f" {case.effort or repr(rule.effort)} AS effort,"
            f" {line} AS line_start, {end} AS line_end"
            f" FROM (SELECT *, unnest(range(0, CAST({case.times} AS BIGINT))) AS i FROM"
            f" (SELECT p_brand AS repo, p_partkey AS k, p_size AS n FROM part) WHERE {case.where})"
        )
    return " UNION ALL ".join(parts)
