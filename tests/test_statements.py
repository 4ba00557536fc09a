import random

from lintlake.operators import relations as R
from lintlake.operators import rules_typescript
from lintlake.operators.statements import statements


class Writer:
    """Programs whose statements are known because they are written one by one."""

    def __init__(self, seed):
        self.rng, self.tokens, self.want, self.deepest = random.Random(seed), [], [], []

    def put(self, text):
        self.tokens += text.split(" ")

    def control(self, tok, depth, write, braced):
        at = len([t for t in self.tokens if t != "\n"]) + 1
        write()
        self.want.append(("control", at, tok, depth, braced))

    def body(self, depth, level):
        if self.rng.random() < 0.4:
            self.put("{")
            for _ in range(self.rng.randint(0, 2)):
                self.statement(depth, level + 1)
            self.put("}")
            return True
        if self.rng.random() < 0.5:
            self.put("\n")
        self.statement(depth, level + 1)
        return False

    def statement(self, depth, level):
        kind = self.rng.choice(["simple"] * 4 + ["if", "else", "for", "while", "do", "with", "switch", "try", "function", "label"])
        if level > 6:
            kind = "simple"
        at = len(self.want)
        here = len([t for t in self.tokens if t != "\n"]) + 1
        braced = False
        if kind == "simple":
            self.put(self.rng.choice(["a . b ( c ) ;", "x = { p : 1 , q : [ 2 ] } \n", "y ++ \n", "go ( function ( ) { z ( ) ; } ) \n", "return \n", "v = w \n + 1 ;", "u = t ? s : r ;", "n = m \n . k ( ) \n", ";"]).replace("function ( ) {", "function ( ) {"))
            return
        if kind == "label":
            self.put("l :")
            self.statement(depth, level + 1)
            return
        if kind == "function":
            self.put("function f ( ) {")
            open_ = len([t for t in self.tokens if t != "\n"])
            before = max((w[3] for w in self.want), default=0)
            first = len(self.want)
            for _ in range(self.rng.randint(0, 2)):
                self.statement(depth, level + 1)
            self.put("}")
            self.deepest.append(("function", open_, max([w[3] - depth for w in self.want[first:]], default=0)))
            return
        if kind in ("if", "else"):
            self.put("if ( e )")
            braced = self.body(depth + 1, level)
            # without an else an if that ends here would take a later one
            self.put("else")
            braced |= self.body(depth + 1, level)
            kind = "if"
        elif kind in ("for", "while", "with"):
            self.put({"for": self.rng.choice(["for ( ; ; )", "for ( i of j )", "for await ( i of j )"]), "while": "while ( e )", "with": "with ( e )"}[kind])
            braced = self.body(depth + 1, level)
        elif kind == "do":
            self.put("do")
            braced = self.body(depth + 1, level)
            self.put(self.rng.choice(["while ( e ) ;", "while ( e ) \n"]))
        elif kind == "switch":
            self.put("switch ( e ) { case 1 :")
            self.statement(depth + 1, level + 1)
            self.put("case g ? 2 : 3 : default :")
            self.statement(depth + 1, level + 1)
            self.put("}")
            braced = True
        elif kind == "try":
            self.put("try {")
            self.statement(depth + 1, level + 1)
            self.put("}")
            for clause in self.rng.choice([["catch ( e ) {"], ["finally {"], ["catch {", "finally {"]]):
                self.put(clause)
                self.statement(depth + 1, level + 1)
                self.put("}")
            braced = True
        self.want.insert(at, ("control", here, kind, depth + 1, braced))


def test_statements_are_those_written(spark, sources):
    files, want = {}, set()
    for seed in range(150):
        w = Writer(seed)
        for _ in range(6):
            w.statement(0, 0)
        path = f"f{seed}.js"
        files[path] = " ".join(w.tokens)
        want |= {(path, kind, idx, tok, depth, braced) for kind, idx, tok, depth, braced in w.want}
        want |= {(path, kind, idx, "{", depth, True) for kind, idx, depth in w.deepest}
    rows = statements(R.code_rows(sources(files), "typescript")).select("path", "kind", "idx", "tok", "depth", "braced", "name").collect()
    got = {tuple(r)[:6] for r in rows if r.kind == "control" or r.name == "f"}
    assert len(want) > 600
    assert got == want


def test_deep_nesting_without_braces(spark, sources):
    text = "function q(a, b, c, d, e) {\n  if (a) if (b) if (c) if (d) if (e) g()\n}\nconst r = x => {\n  for (;;)\n    while (x)\n      if (x) y()\n      else if (z)\n        do w()\n        while (v)\n}\n"
    found = rules_typescript.deep_nesting(R.code_rows(sources({"a.ts": text}), "typescript"))
    got = sorted((r["line_start"], r["line_end"], r["severity"], r["message"]) for r in found.collect())
    assert [(g[0], g[1], g[2]) for g in got] == [(1, 3, "medium"), (4, 11, "medium")]
    assert "nests 5 levels" in got[0][3] and "nests 5 levels" in got[1][3]


def test_broken_text_and_none(spark, sources):
    files = {"a.ts": "if ( { ) } ] while", "b.ts": "", "c.ts": "} } else { if (x) }", "d.ts": "function f() { if (a) b()"}
    assert statements(R.code_rows(sources(files), "typescript")).filter("kind = 'control'").count() >= 2
    assert statements(R.code_rows(sources(files).limit(0), "typescript")).count() == 0


def test_statements_that_begin_with_a_bracket(spark, sources):
    text = "(function () {\n  [1].map(f)\n  if (a) { b() }\n})()\nfunction q() {\n  (a || b)()\n  if (a) if (b) c()\n}\n"
    rows = statements(R.code_rows(sources({"a.ts": text}), "typescript")).collect()
    assert sorted((r.line, r.end_line, r.depth) for r in rows if r.kind == "control") == [(3, 3, 1), (7, 7, 1), (7, 7, 2)]
    assert sorted((r.line, r.end_line, r.depth) for r in rows if r.kind == "function") == [(1, 4, 1), (5, 8, 2)]


def test_any_text_is_passed(spark, sources):
    rng = random.Random(3)
    words = "( ) [ ] { } ; , : ? => if else do while for try catch function class case x ( ) \n".split(" ")
    files = {f"f{i}.ts": " ".join(rng.choice(words) for _ in range(60)) for i in range(200)}
    rows = statements(R.code_rows(sources(files), "typescript")).collect()
    assert {r.kind for r in rows} == {"control", "function"}
    assert all(r.end_line is None and r.kind == "function" or r.line <= r.end_line for r in rows)
    assert all(r.depth >= (r.kind == "control") for r in rows)


def test_files_reach_the_pass_in_pieces_and_in_order():
    import pyarrow as pa

    from lintlake.operators import statements as S

    files = [(f"p{i}", ("function f ( ) { " + "if ( x ) " * (i % 5 + 1) + "go ( ) ; }").split()) for i in range(400)]
    rows = []
    for path, toks in files:
        for n, tok in enumerate(toks, 1):
            kind = "word" if tok.isalpha() else "punct"
            rows.append((n, "r", path, n, tok, kind, n, None if n == 1 else False, "function" if n == 5 else None, 1, "f"))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.string()] * 2, pa.int32(), *[pa.string()] * 2, pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.string()), strict=True)]
    table = pa.table(columns, names=["at", "repo", "path", *S._FACTS])
    want = [(path, "control", 6 + 4 * j) for path, toks in files for j in range(toks.count("if"))]
    for size in (7, 256, 100_000):
        out = list(S._statements_of(iter(table.to_batches(max_chunksize=size))))
        got = [r for b in out for r in b.to_pylist()]
        assert [(r["path"], r["kind"], r["idx"]) for r in got if r["kind"] == "control"] == want
        assert [(r["path"], r["depth"], r["end_line"]) for r in got if r["kind"] == "function"] == [(p, t.count("if"), len(t)) for p, t in files]
        # rows of many files make one batch
        assert len(out) <= 3


def test_statements_sort_the_files_before_their_tokens_and_collect_nothing(spark, sources):
    rows = statements(R.code_rows(sources({"a.ts": "if (x) go()\n"}), "typescript"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.rindex("Sort [repo") > plan.rindex("Generate")
