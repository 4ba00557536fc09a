"""Python code as a relation of syntax nodes.

The standard parser is the one step that needs Python: Spark hands it batches of files
and gets one row per node back. Nothing is judged here; the rules are queries on the
rows. ``pre`` / ``last`` number the nodes in source order, so a node lies in another
when its ``pre`` is in that range. ``scopes`` lists the surrounding functions, classes,
loops, branches and handlers with their names and lines, and calls carry their keywords
and first argument; so a rule is one pass over the rows and never reads the files twice.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lintlake.operators.relations import by_file

_SCOPE = pa.struct(
    [("pre", pa.int32()), ("kind", pa.string()), ("edge", pa.string()), ("deep", pa.bool_()),
     ("elif_pos", pa.int32()), ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32())]
)
_KEYWORD = pa.struct([("name", pa.string()), ("value", pa.string())])
NODE_SCHEMA = pa.schema(
    [("repo", pa.string()), ("path", pa.string())]
    + [(c, pa.int32()) for c in ("pre", "last", "parent", "idx", "line", "end_line", "size", "elif_pos")]
    + [
        (c, pa.string())
        for c in (
            "parent_kind", "grand_kind", "field", "kind", "name", "shown", "op", "receiver",
            "receiver_kind", "first", "assigned", "line_text",
        )
    ]
    + [("num", pa.float64()), ("early_exit", pa.bool_()), ("alone", pa.bool_()),
       ("keywords", pa.list_(_KEYWORD)), ("scopes", pa.list_(_SCOPE))]
)
# Kinds of nodes that other nodes look back at.
SCOPE_KINDS = (
    "FunctionDef", "AsyncFunctionDef", "ClassDef", "For", "AsyncFor", "While", "If",
    "ExceptHandler",
)
LOOP_KINDS = ("For", "AsyncFor", "While")
DEF_KINDS = ("FunctionDef", "AsyncFunctionDef")
_ROWS_PER_BATCH = 50_000


def _word(node) -> str | None:
    """The identifier of a name or attribute."""
    return getattr(node, "id", getattr(node, "attr", None))


def _first(node: ast.AST) -> str:
    """What a first argument is: a string, a call by method name, an operator, a kind."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return "str"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        return "Call." + node.func.attr
    if isinstance(node, ast.BinOp):
        return "BinOp." + type(node.op).__name__
    return type(node).__name__


def _constant(node: ast.Constant, lines: list[str]) -> dict:
    if not isinstance(node.value, (int, float)):
        return {}
    out = {"shown": str(node.value), "line_text": lines[node.lineno - 1] if node.lineno <= len(lines) else ""}
    try:
        out["num"] = float(node.value)
    except OverflowError:
        out["num"] = float("inf")
    return out


def _call(node: ast.Call, lines: list[str]) -> dict:
    func = node.func
    out = {
        "op": type(func).__name__, "size": len(node.args), "first": _first(node.args[0]) if node.args else None,
        "keywords": [{"name": k.arg, "value": _word(k.value)} for k in node.keywords],
    }
    if isinstance(func, (ast.Name, ast.Attribute)):
        out["name"] = _word(func)
    if isinstance(func, ast.Attribute):
        out["receiver_kind"] = type(func.value).__name__
        out["receiver"] = _word(func.value)
    return out


def _for(node: ast.For, lines: list[str]) -> dict:
    # the variable of a loop over range(...)
    if isinstance(node.iter, ast.Call) and getattr(node.iter.func, "id", None) == "range":
        return {"name": getattr(node.target, "id", None)}
    return {}


def _if(node: ast.If, lines: list[str]) -> dict:
    out = {
        "early_exit": not node.orelse
        and len(node.body) == 1
        and isinstance(node.body[0], (ast.Return, ast.Continue, ast.Break))
    }
    # the function that the test calls
    if isinstance(node.test, ast.Call):
        out["name"] = getattr(node.test.func, "id", None)
    return out


#: The values of one node that the rules compare, by its type.
_FACTS = {
    **dict.fromkeys((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef), lambda node, lines: {"name": node.name}),
    **dict.fromkeys((ast.Name, ast.Attribute), lambda node, lines: {"name": _word(node)}),
    ast.ImportFrom: lambda node, lines: {"name": node.module, "keywords": [{"name": a.name} for a in node.names]},
    ast.Call: _call,
    ast.Constant: _constant,
    ast.For: _for,
    ast.BoolOp: lambda node, lines: {"size": len(node.values)},
    ast.comprehension: lambda node, lines: {"size": len(node.ifs)},
    ast.If: _if,
    ast.ExceptHandler: lambda node, lines: {
        "op": type(node.type).__name__ if node.type else None, "first": type(node.body[0]).__name__, "size": len(node.body),
    },
}


_MARKS = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)


def _walk(tree: ast.AST, content: str = "") -> list[dict]:
    """Rows of one file in source order, without recursion."""
    rows: list[dict] = []
    lines = content.splitlines()
    stack = [(tree, {"pre": -1}, None, 0, False, ())]
    while stack:
        node, above, field, idx, alone, scopes = stack.pop()
        if node is None:
            above["last"] = len(rows) - 1
            continue
        kind = type(node).__name__
        facts = _FACTS.get(type(node))
        pre = len(rows)
        row = {
            "pre": pre, "last": pre, "parent": above["pre"], "parent_kind": above.get("kind"),
            "grand_kind": above.get("parent_kind"), "field": field, "idx": idx, "alone": alone,
            "kind": kind, "line": getattr(node, "lineno", above.get("line", 0)), "scopes": scopes,
            "assigned": above.get("target"),
        }
        if facts:
            row |= facts(node, lines)
        row["end_line"] = getattr(node, "end_lineno", None) or row["line"]
        if kind == "If":
            chained = above.get("kind") == "If" and field == "orelse"
            row["elif_pos"] = above["elif_pos"] + 1 if chained else 0
        elif kind == "Assign":
            # for the values below it; the key is no column
            row["target"] = getattr(node.targets[0], "id", None)
        rows.append(row)
        children = []
        for name in node._fields:
            value = getattr(node, name, None)
            if isinstance(value, list):
                kids = [(i, c) for i, c in enumerate(value) if isinstance(c, ast.AST) and not isinstance(c, _MARKS)]
                items = value
            else:
                kids = [(0, value)] if isinstance(value, ast.AST) and not isinstance(value, _MARKS) else []
                items = (value,)
            if not kids:
                continue
            around = scopes
            if kind in SCOPE_KINDS:
                deep = kind in LOOP_KINDS or (kind == "If" and not row["early_exit"])
                around = (
                    *scopes,
                    {"pre": pre, "kind": kind, "edge": name, "deep": deep, "elif_pos": row.get("elif_pos"),
                     "name": row.get("name"), "line": row["line"], "end_line": row["end_line"]},
                )
            children += [(c, row, name, i, len(items) == 1, around) for i, c in kids]
        stack.append((None, row, None, 0, False, ()))
        stack.extend(reversed(children))
    return rows


def _parse(content: str) -> ast.AST | str:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return f"{type(error).__name__}: {error}"


def _files(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in batch.to_pylist():
            yield row["repo"], row["path"], row["content"], _parse(row["content"])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in NODE_SCHEMA if f.name != "scopes"]
    # nodes of one place share their scopes: each list becomes Arrow once
    places: dict[int, int] = {}
    lists = []
    at = []
    for row in rows:
        scopes = row.get("scopes")
        place = places.get(id(scopes))
        if place is None:
            place = places[id(scopes)] = len(lists)
            lists.append(scopes)
        at.append(place)
    columns.append(pa.array(lists, NODE_SCHEMA.field("scopes").type).take(pa.array(at, pa.int32())))
    return pa.RecordBatch.from_arrays(columns, schema=NODE_SCHEMA)


#: The kind of the one row of a file that does not parse; ``name`` tells why.
NOT_PARSED = "ParseError"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending: list[dict] = []
    for repo, path, content, tree in _files(batches):
        for row in [{"kind": NOT_PARSED, "name": tree}] if isinstance(tree, str) else _walk(tree, content):
            row["repo"], row["path"] = repo, path
            pending.append(row)
        if len(pending) >= _ROWS_PER_BATCH:
            yield _batch(pending)
            pending = []
    if pending:
        yield _batch(pending)


def _texts(src: DataFrame) -> DataFrame:
    """Texts spread by file: parsing takes far longer than moving them once."""
    return by_file(src.select("repo", "path", "content").filter(F.col("content").isNotNull()))


def py_parse(src: DataFrame) -> DataFrame:
    """The one parse: rows of nodes, and a row of kind :data:`NOT_PARSED` for other files."""
    return _texts(src).mapInArrow(_nodes, from_arrow_schema(NODE_SCHEMA))


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("kind") != NOT_PARSED)


def errors_of(parsed: DataFrame) -> DataFrame:
    """``(repo, path, error)`` of the files that have no nodes."""
    return parsed.filter(F.col("kind") == NOT_PARSED).select("repo", "path", F.col("name").alias("error"))


def py_nodes(src: DataFrame) -> DataFrame:
    """One row per syntax node; files that do not parse give no rows."""
    return nodes_of(py_parse(src))


def parse_errors(src: DataFrame) -> DataFrame:
    """``(repo, path, error)`` of the files that ``py_nodes`` leaves out."""
    return errors_of(py_parse(src))
