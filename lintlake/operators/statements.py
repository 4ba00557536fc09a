"""Extents of JS/TS statements, with bodies in braces or without.

One pass over the tokens of a file with a stack: a token is shifted, and what ends with it is
reduced. A statement ends at its semicolon, at the end of the block it stands in, or where the
language inserts a semicolon: at a line break before a token that cannot go on with it. The body
of a control statement is the statement behind its header, so a statement that ends closes all
the control statements it is the last body of.

The pass reads the rows of ``code`` file by file, which a window keeps together without a shuffle;
files are spread over the tasks as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.relations import KEY, js_head_line, js_name

# Words that begin a control statement, what can stand where a statement goes on
# over a line break, and words that no statement ends with.
CONTROL = frozenset(("if", "for", "while", "do", "switch", "try", "with"))
GOES_ON = frozenset(
    ". ?. ( [ , ; : ? = == === != !== < > <= >= << >>> + - * / % ** & | ^ && || ?? => += -= *= /= %= **= &= |= ^= &&= ||= ??= <<= >>= >>>="
    " in of instanceof as satisfies ) ]".split()
)
LEADS_ON = frozenset("typeof new void delete in of instanceof as satisfies extends implements case const let var function class interface enum import export default async await else do throw".split())
#: Blocks that declarations end with, blocks whose inside is no list of statements, functions.
DECLARED = frozenset(("function", "class", "interface", "enum", "namespace", "module"))
CONTAINERS = frozenset(("literal", "class", "interface", "enum"))
FUNCTIONS = frozenset(("function", "method", "arrow"))
OPENING = {")": "(", "]": "[", "}": "{"}


@dataclass(slots=True)
class _Frame:
    """What is open: a control statement, a simple one, a block of statements, or a bracket."""

    kind: str  # "control", "simple", "block", "bracket"
    tok: str
    at: int
    #: control: "head", "body", "tail" (after a body); simple: "declared" ends with its block
    phase: str = ""
    depth: int = 0
    function: bool = False
    deepest: int = 0
    braced: bool = False


def extents(toks: list, kinds: list, fresh: list, blocks: list) -> tuple[list[tuple], list[tuple]]:
    """Control statements ``(start, end, depth, braced)`` and functions ``(start, deepest)`` of a
    file, by places in the columns of its tokens. ``depth`` counts a statement and the control statements around
    it, functions or not; ``deepest`` is the depth inside a function."""
    controls: list[tuple] = []
    functions: list[tuple] = []
    stack: list[_Frame] = [_Frame("block", "", -1)]
    owners = [stack[0]]  # the functions that are open
    opened = dict.fromkeys(OPENING.values(), 0)
    depth = 0
    n = len(toks)
    word = lambda i: toks[i] if 0 <= i < n else ""

    def leave(frame: _Frame, end: int) -> None:
        nonlocal depth
        if frame.kind == "control":
            depth -= 1
            controls.append((frame.at, end, frame.depth, frame.braced))
        elif frame.kind != "simple" and frame.tok in opened:
            opened[frame.tok] -= 1
        if frame.function:
            functions.append((frame.at, frame.deepest - frame.depth))
            owners.pop()
            owners[-1].deepest = max(owners[-1].deepest, frame.deepest)

    def enter(frame: _Frame) -> None:
        stack.append(frame)
        if frame.kind != "simple" and frame.tok in opened:
            opened[frame.tok] += 1
        if frame.function:
            owners.append(frame)

    def ended(at: int) -> None:
        """The statement on top of the stack has ended before place ``at``."""
        while stack[-1].kind == "simple" or stack[-1].kind == "control":
            top = stack[-1]
            following = word(at)
            if top.kind == "control":
                if top.tok == "if" and top.phase == "body" and following == "else":
                    top.phase = "else"
                    return
                if top.tok == "do" and top.phase == "body" and following == "while":
                    top.phase = "until"
                    return
                if top.tok == "try" and top.phase != "finally" and following in ("catch", "finally"):
                    top.phase = following
                    return
            stack.pop()
            leave(top, at - 1)

    def closes(i: int, tok: str) -> None:
        """A closing bracket takes everything off that it closes."""
        opening = OPENING[tok]
        if not opened[opening]:
            return
        while stack[-1].kind == "simple" or stack[-1].tok != opening:
            leave(stack.pop(), i - 1)
        frame = stack.pop()
        leave(frame, i)
        top = stack[-1]
        if top.kind == "control":
            if tok == ")" and top.phase == "head":
                top.phase = "body"
            elif tok == ")" and top.phase == "until":
                top.phase = "tail"
                if word(i + 1) != ";":
                    ended(i + 1)
            elif tok == "}" and frame.kind == "block" and top.phase in ("body", "otherwise", "catch", "finally"):
                ended(i + 1)
        elif tok == "}" and top.kind == "simple" and top.phase == "declared" and blocks[frame.at] in DECLARED:
            ended(i + 1)

    def begins(i: int, tok: str) -> None:
        """A statement begins here."""
        nonlocal depth
        following = word(i + 1)
        if tok in CONTROL and (following == "(" or tok == "for" and following == "await" or tok in ("do", "try") and following != ":"):
            depth += 1
            stack.append(_Frame("control", tok, i, "body" if tok in ("do", "try") else "head", depth))
            owners[-1].deepest = max(owners[-1].deepest, depth)
        elif tok == "{":
            if stack[-1].kind == "control":
                stack[-1].braced = True
            enter(_Frame("block", "{", i))
        elif tok == ";":
            if stack[-1].kind == "control":
                ended(i + 1)
        elif tok in ("case", "default") and stack[-1].kind == "block" and following != "(":
            stack.append(_Frame("bracket", "case", i))
        elif following == ":" and kinds[i] == "word":
            stack.append(_Frame("bracket", "case", i))  # a label is passed like a case
        else:
            phase = "declared" if tok in ("function", "class", "interface", "enum", "namespace", "module", "declare", "abstract", "export", "async", "default") else ""
            stack.append(_Frame("simple", tok, i, phase))
            shift(i, tok)

    def shift(i: int, tok: str) -> None:
        """A token inside a statement."""
        if tok in ("(", "["):
            enter(_Frame("bracket", tok, i))
        elif tok == "{":
            kind = blocks[i]
            if kind in FUNCTIONS:
                enter(_Frame("block", "{", i, depth=depth, function=True, deepest=depth))
            else:
                enter(_Frame("bracket" if kind in CONTAINERS else "block", "{", i))

    for i, tok in enumerate(toks):
        top = stack[-1]
        if tok in OPENING and kinds[i] == "punct":
            closes(i, tok)
            continue
        if top.kind == "simple":
            if tok == ";":
                ended(i + 1)
                continue
            if fresh[i] and i > top.at and toks[i - 1] not in LEADS_ON and tok not in GOES_ON and kinds[i] != "template":
                if kinds[i - 1] != "punct" or toks[i - 1] in (")", "]", "}", "++", "--"):
                    ended(i)
                    top = stack[-1]
        if top.kind == "control" and top.phase in ("head", "until", "catch", "finally", "else", "tail"):
            if tok == "(":
                enter(_Frame("bracket", "(", i))
                continue
            if top.phase == "else" and tok == "else":
                top.phase = "otherwise"
                continue
            if top.phase == "tail" and tok == ";":
                ended(i + 1)
                continue
            if tok in ("catch", "finally", "while", "await", "for", "if", "with", "switch") and top.phase != "tail":
                continue
            if tok == "{" and top.phase in ("catch", "finally"):
                enter(_Frame("block", "{", i))
                continue
        if top.kind == "bracket":
            if top.tok == "case":
                if tok == ":":
                    stack.pop()
                    continue
                if tok == "?":
                    stack.append(_Frame("bracket", "?", i))
                    continue
            elif top.tok == "?" and tok == ":":
                stack.pop()
                continue
            shift(i, tok)
        elif top.kind == "simple":
            shift(i, tok)
        elif top.kind == "block" or top.phase in ("body", "otherwise"):
            begins(i, tok)
    while len(stack) > 1:
        leave(stack.pop(), n - 1)
    return sorted(controls), sorted(functions)


_OUT = {"kind": "string", "idx": "int", "tok": "string", "line": "int", "end_line": "int", "depth": "int", "braced": "boolean", "name": "string"}
TOKENS_AT_ONCE = 10_000
_FACTS = ("idx", "tok", "kind", "line", "fresh", "kind_of_block", "head_line", "name")
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def statements(rows: DataFrame) -> DataFrame:
    """``(repo, path, kind, idx, tok, line, end_line, depth, braced, name)`` of JS/TS ``code``.

    ``kind`` is "control" for a control statement, with its first token, its lines, its depth
    (itself and the control statements around it, an ``else if`` in the else of its ``if``) and
    whether its body has braces; or "function" for a function body in braces, with the line its
    header begins on, the depth inside it and its name. Text that does not parse is taken up
    again at the next bracket that closes; files without such statements have no rows.
    """
    shaped = rows.withColumn("name", js_name()).withColumn("head_line", js_head_line()).select(*KEY, *_FACTS)
    # the window holds the tokens of a file together and in order
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("idx"))
    return shaped.select(at.alias("at"), "*").mapInArrow(
        _statements_of, ", ".join(f"{f} string" for f in KEY) + ", " + ", ".join(f"{c} {t}" for c, t in _OUT.items())
    )


def _statements_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements of files whose tokens come one after the other, the first of a file with ``at`` 1."""
    schema = pa.schema([*((k, pa.string()) for k in KEY), *((c, _ARROW[t]) for c, t in _OUT.items())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    file, held = (), []
    for batch in _larger(batches):
        at, *facts = (_values(c) for c in (batch.column(0), *batch.columns[len(KEY) + 1 :]))
        starts = [i for i, n in enumerate(at) if n == 1]
        out: list[tuple] = []
        for first, end in zip([0, *starts], [*starts, len(at)], strict=True):
            if first == end:
                continue
            more = [c[first:end] for c in facts]
            if at[first] == 1:
                out += _statements(file, *held) if held else []
                file, held = tuple(batch.column(k + 1)[first].as_py() for k in range(len(KEY))), more
            else:
                held = [h + m for h, m in zip(held, more, strict=True)]
        if out:
            yield made(out)
    if held and (out := _statements(file, *held)):
        yield made(out)


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, as a session whose rows hold whole files makes small ones."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOKENS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _closing(toks: list) -> list[int]:
    """The place of the next bracket on the level of each opening one, -1 where there is none, as
    ``close`` of ``code`` has it."""
    out, level = [-1] * len(toks), 0
    latest: dict[int, int] = {}
    for i, tok in enumerate(toks):
        if tok in ("(", "[", "{"):
            level += 1
            here = level
        elif tok in OPENING:
            here, level = level, level - 1
        else:
            continue
        if (before := latest.get(here, -1)) >= 0 and toks[before] not in OPENING:
            out[before] = i
        latest[here] = i
    return out


def _values(column: pa.ChunkedArray) -> list:
    return column.to_pandas(integer_object_nulls=True).tolist()


def _statements(file: tuple, idx, toks, kinds, line, fresh, blocks, head_line, name) -> list[tuple]:
    controls, functions = extents(toks, kinds, fresh, blocks)
    close = _closing(toks) if functions else []
    out = [(*file, "control", idx[s], toks[s], line[s], line[e], d, b, None) for s, e, d, b in controls]
    return out + [(*file, "function", idx[s], toks[s], head_line[s], line[close[s]] if close[s] >= 0 else None, d, True, name[s]) for s, d in functions]
