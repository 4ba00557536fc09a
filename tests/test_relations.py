"""Relations against direct walks of the same text."""

import random

from pyspark.sql import functions as F

from lintlake.operators import relations as R
from lintlake.operators import rules_python
from lintlake.operators.metrics import function_metrics
from lintlake.operators.pynodes import py_nodes


def test_enclosing_is_the_stack(sources):
    rng = random.Random(5)
    files = {}
    for n in range(12):
        out, stack = [], []
        for _ in range(120):
            move = rng.random()
            if move < 0.35:
                stack.append(rng.choice("([{"))
                out.append(stack[-1])
            elif move < 0.65 and stack:
                out.append({"(": ")", "[": "]", "{": "}"}[stack.pop()])
            else:
                out.append("x" + str(rng.randrange(9)))
        out += [{"(": ")", "[": "]", "{": "}"}[b] for b in reversed(stack)]
        files[f"f{n}.go"] = " ".join(out)
    rows = R.code_rows(sources(files), "go")
    got = {
        (r["path"], r["idx"], r["outer"]["idx"])
        for r in R.enclosing(rows, F.col("tok").startswith("x"), ["idx"], []).collect()
    }
    want, ends = set(), set()
    for path, text in files.items():
        stack = []
        for i, tok in enumerate(text.split(" "), start=1):
            if tok in "([{":
                stack.append(i)
            elif tok in ")]}":
                ends.add((path, stack.pop(), i))
            else:
                want |= {(path, i, s) for s in stack}
    assert got == want
    assert {(r["path"], r["open"], r["close"]) for r in R.pairs(rows).collect()} == ends


def test_blocks_of_both_languages(sources):
    go = "package p\nfunc (t *T) G(y []int) (int, error) {\n\tfor _, v := range []int{1} {\n\t\tif v == 1 {\n\t\t} else if y[0] > 2 {\n\t\t} else {\n\t\t\tgo func() {\n\t\t\t\tx := T{a: 1}\n\t\t\t}()\n\t\t}\n\t}\n}\n"
    ts = "class A extends B {\n m(x: number): Promise<void> { return foo({a: 1}); }\n}\nfunction q(a = {}) { while (1) { do { } while (x); } }\nconst f = async (x) => { switch (x) { case 1: { } } };\n"

    def kinds(path, text, language):
        rows = R.code_rows(sources({path: text}), language).filter("tok = '{'").orderBy("idx")
        return [r["kind_of_block"] for r in rows.select("kind_of_block").collect()]

    assert kinds("a.go", go, "go") == ["func", "literal", "for", "if", "if", "else", "func", "literal"]
    assert kinds("a.ts", ts, "typescript") == [
        "class", "method", "literal", "literal", "function", "while", "do", "arrow", "switch", "literal",
    ]


class _Writer:
    """Writes random functions and adds up, line by line, what each has to score."""

    def __init__(self, rng):
        self.rng, self.lines, self.points = rng, [], {}

    def function(self, name, depth, indent):
        self.put(indent, f"def {name}(a, b):")
        self.points[name] = 0
        self.block(name, depth, indent + 1, 1)

    def put(self, indent, text):
        self.lines.append("    " * indent + text)

    def block(self, name, depth, indent, cost, counted=False):
        """Statements below a header; ``cost`` is what a branch or loop costs there, ``counted``
        that they have been counted one by one. Gives their number."""
        count = self.rng.randrange(1, 4)
        for _ in range(count):
            kind = "plain" if depth == 0 else self.rng.choice(["plain", "loop", "if", "if", "try_block", "inner"])
            if kind == "if":
                self.chain(name, depth - 1, indent, cost, counted)
            else:
                getattr(self, kind)(name, depth - 1, indent, cost)
        return count

    def plain(self, name, depth, indent, cost):
        text, worth = self.rng.choice([("go(a)", 0), (f"{name}(b)", 1), ("x = a and b or c", 2), ("return", 0)])
        self.put(indent, text)
        self.points[name] += worth

    def loop(self, name, depth, indent, cost):
        self.put(indent, self.rng.choice(["for i in a:", "while a:"]))
        self.points[name] += cost
        self.block(name, depth, indent + 1, cost + 1)

    def chain(self, name, depth, indent, cost, counted):
        # every other branch of a chain opens it anew at full cost, those between cost one (or
        # nothing, if they were counted as statements); an else below a full one costs one for
        # each of its statements
        branches = 1 + self.rng.randrange(3)
        for i in range(branches):
            full = i % 2 == (1 if counted else 0)
            self.put(indent, "elif c:" if i else "if a and b:")
            self.points[name] += cost if full else min(i, 1)
            self.block(name, depth, indent + 1, cost)
        if self.rng.random() < 0.5:
            self.put(indent, "else:")
            count = self.block(name, depth, indent + 1, cost, full)
            self.points[name] += count * full

    def try_block(self, name, depth, indent, cost):
        self.put(indent, "try:")
        self.block(name, depth, indent + 1, cost)
        self.put(indent, "except E:")
        self.points[name] += cost
        self.block(name, depth, indent + 1, cost)

    def inner(self, name, depth, indent, cost):
        self.function(f"inner{len(self.lines)}", depth, indent)


def test_cognitive_scores_are_what_was_written(sources):
    rng = random.Random(11)
    files, want = {}, {}
    for i in range(80):
        writer = _Writer(rng)
        writer.function(f"fn{i}", 4, 0)
        files[f"f{i}.py"] = "\n".join(writer.lines) + "\n"
        want |= {(f"f{i}.py", n): p for n, p in writer.points.items() if p}
    nodes = py_nodes(sources(files))
    got = {(r["path"], r["name"]): r["score"] for r in rules_python._function_facts(nodes).collect()}
    assert {k: v for k, v in got.items() if v > 0} == want


def test_function_metrics(sources):
    text = "def f(a):\n    if a and b:\n        return [x for x in a if x]\n    return 1 if a else 2\n"
    (row,) = function_metrics(py_nodes(sources({"a.py": text})), "python").collect()
    assert (row["name"], row["length"], row["ccn"]) == ("f", 4, 6)
    go = "package p\nfunc (s *S) Put(a int) {\n\tif a > 1 && b {\n\t}\n\tfunc() { for {} }()\n}\n"
    (row,) = function_metrics(R.code_rows(sources({"a.go": go}), "go"), "go").collect()
    assert (row["name"], row["start"], row["end"], row["ccn"]) == ("Put", 2, 6, 4)


def test_partitions_grow_with_the_text(spark, sources):
    """A task gets so much text, however many files there are; a file stays in one."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = sources({"a.py": "x", "b.py": None})
    assert R.by_file(small).rdd.getNumPartitions() == least
    large = small.unionByName(spark.range(90).selectExpr("'r' AS repo", "concat(id, '.py') AS path", "'.py' AS ext", "repeat('x', 100000) AS content"))
    assert R.by_file(large).rdd.getNumPartitions() == max(least, 10)
