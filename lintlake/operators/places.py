"""Where each token of code stands: level, bracket around it, statement, latest tokens of its place.

The tokens of many files are looked at as flat columns: running sums over token order, and one
stable sort by file and place, in which the latest token of some sort is a running maximum. A file
becomes chunks of arrays in which a token refers to others by their index, so the facts of a
neighbour, of a closing bracket or of the latest ``(`` are looked up where they are used, and those
that a query does not use are never made. A chunk ends after so many tokens; tokens farther off that
it refers to come along behind it, with their own neighbours.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.operators.words import GO_CONTROL, GO_KEYWORDS, GO_LINE_ENDERS, JS_CONTROL, JS_TYPE_WORDS

#: So many tokens are looked at together, and so many make a chunk.
TOKENS_AT_ONCE = 65_536
CHUNK = 1_024
#: Neighbours that a token of a chunk has, and a token that comes along.
BEFORE, AFTER, FAR_BEFORE = 8, 6, 3

# Columns for each token of a chunk, those that refer to other tokens, and columns
# for each token of its array, the ones that come along included.
REFERS = ("close", "func", "control", "type", "open", "shut", "head")
OWN = ("pos", "encl", "stmt", "assign", "comma", "block", *REFERS)
ALL = ("idx", "line", "prev_line", "inside")
KEY = ("repo", "path")
_SCHEMA = ", ".join((*(f"{k} string" for k in KEY), "ahead int", "toks array<string>", *(f"{c} array<int>" for c in (*ALL, *OWN))))
_NAMES = [*KEY, "ahead", "toks", *ALL, *OWN]

# What a ``{`` of JS/TS opens, as ``block`` counts it, and the words that tell it.
JS_KINDS = (
    "else", "do", "try", "finally", "catch", "if", "for", "while", "switch", "with", *JS_TYPE_WORDS,
    "arrow", "function", "method", "bare", "literal",
)
_BEFORE_BODY, _HEADED = JS_KINDS[:5], JS_KINDS[4:10]
_AFTER_BARE = (";", "{", "}", ")")
_NO_TYPE = ("=", ",", "(", ":", "[", "?", "&&", "||", "=>")
_NAMED = {w: i for i, w in enumerate(dict.fromkeys((*JS_KINDS[:-5], *_AFTER_BARE, *_NO_TYPE, "await", "function", "*")))}

(_SKIP, _OPENS, _CLOSES, _WORD, _FUNC, _CONTROL, _TYPE, _OPEN, _SHUT, _ASSIGN, _COMMA, _ENDS, _DOT, _VALUE, _LINE_ENDS, _CALLED, _TYPE_NAME) = (
    1 << i for i in range(17)
)
_SIGNS = {
    "(": _OPENS | _OPEN, "[": _OPENS, "{": _OPENS, ")": _CLOSES | _SHUT | _VALUE, "]": _CLOSES | _VALUE, "}": _CLOSES | _ENDS,
    ";": _ENDS, "=": _ASSIGN, ",": _COMMA, ".": _DOT | _VALUE, "?.": _DOT, "\n": _SKIP,
}


def _facts(tok: str, control: tuple) -> int:
    """What a token is by itself."""
    first = tok[:1]
    found = _SIGNS.get(tok, 0)
    if (letter := first in "_$" or unicodedata.category(first)[0] == "L") or first in "\"'{":
        found |= _TYPE_NAME
    if letter or first in "#\"']>":
        found |= _CALLED
    if tok in GO_LINE_ENDERS:
        found |= _LINE_ENDS
    if tok[:2] in ("//", "/*"):
        return found | _SKIP
    if first in "\"'" and len(tok) > 1:
        return found | _VALUE | _LINE_ENDS
    if first == "`" or (first == "}" and len(tok) > 1):
        return found | _LINE_ENDS
    if (first == "/" and len(tok) > 2) or tok in _SIGNS:
        return found
    if first in "0123456789" or (first == "." and tok[1:2] and tok[1] in "0123456789"):
        return found | _LINE_ENDS
    if letter or first == "#":
        found |= _WORD | _VALUE
        if tok not in GO_KEYWORDS:
            found |= _LINE_ENDS
        if tok in ("func", "function"):
            found |= _FUNC
        if tok in control:
            found |= _CONTROL
        if tok in JS_TYPE_WORDS:
            found |= _TYPE
    return found


def _stable(key: np.ndarray) -> np.ndarray:
    """Order by small numbers, equal ones as they stood."""
    most = int(key.max(initial=0))
    return np.argsort(key.astype(np.uint16) if most < 1 << 16 else key, kind="stable")


def _before(values: np.ndarray, first: np.ndarray, none) -> np.ndarray:
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = none
    return out


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def placed(lists: DataFrame, go: bool) -> DataFrame:
    """Chunks of files from ``(repo, path, toks)``: rows of one file come together, and where it has
    several texts their tokens go by their places in the texts.

    Chunks stay in the partition of their file. The key of the result is that of ``lists``, not only columns
    with such values, so what is partitioned by it needs no shuffle behind this. As it then counts as made
    here, plans may drop it from the input, so the pass reads copies.
    """
    lists = lists.select(*KEY, *(F.col(k).alias(f"of_{k}") for k in KEY), "toks")
    made = lists.mapInArrow(partial(_places, go=go), _SCHEMA)
    plan, keys = made._jdf.queryExecution().analyzed(), lists._jdf.queryExecution().analyzed().output()
    output = plan.output()
    for i in range(len(KEY)):
        output = output.updated(i, output.apply(i).withExprId(keys.apply(i).exprId()))
    spark = lists.sparkSession
    same = plan.copy(plan.functionExpr(), output, plan.child(), plan.isBarrier(), plan.profile())
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, same), spark)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Rows of whole files, and where each file begins; its rows come one after the other."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(f"of_{k}").to_pylist() for k in KEY), strict=True))
        if not keys or (held and keys[0] == keys[-1] == key):
            held += [batch] if keys else []
            continue
        if held:
            keys = [key] * sum(h.num_rows for h in held) + keys
            batch = pa.concat_batches([*held, batch])
        starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
        if last := starts[-1]:
            yield batch.slice(0, last), starts
        held, key = [batch.slice(last)], keys[-1]
    if held:
        rows = pa.concat_batches(held)
        yield rows, [0, rows.num_rows]


def _places(batches: Iterator[pa.RecordBatch], go: bool) -> Iterator[pa.RecordBatch]:
    for batch, starts in _whole(batches):
        texts = batch.column("toks")
        of_file, of_text = np.array(starts), texts.offsets.to_numpy()
        upto = of_text[of_file]
        at = 0
        while at < len(of_file) - 1:
            end = max(int(np.searchsorted(upto, upto[at] + TOKENS_AT_ONCE, "right")) - 1, at + 1)
            many, columns = _some(texts.values, of_file[at : end + 1], of_text, go)
            file = pa.array(np.repeat(of_file[at:end], many))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"of_{k}").take(file) for k in KEY), *columns], _NAMES)
            at = end


def _some(every: pa.Array, of_file: np.ndarray, of_text: np.ndarray, go: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """Of some files the number of chunks each, and their columns."""
    starts = of_text[of_file].astype(np.int64)
    begin, total, files = starts[0], int(starts[-1] - starts[0]), len(of_file) - 1
    starts -= begin
    toks = every.slice(begin, total)
    lengths = np.diff(of_text[of_file[0] : of_file[-1] + 1])
    pos = np.arange(total) - np.repeat(of_text[of_file[0] : of_file[-1]] - begin, lengths)
    file = np.repeat(np.arange(files), np.diff(starts))
    if np.diff(of_file).max(initial=0) > 1:
        order = np.argsort(file * (int(pos.max(initial=0)) + 1) + pos, kind="stable")
        toks, pos = toks.take(pa.array(order)), pos[order]

    shown = toks.dictionary_encode()
    words = shown.dictionary.to_pylist()
    control = GO_CONTROL if go else JS_CONTROL
    # one more stands for no token
    facts = np.array([*(_facts(w, control) for w in words), 0], np.int32)
    breaks = np.array([*(w.count("\n") for w in words), 0], np.int64)
    word = shown.indices.to_numpy()
    passed = np.concatenate(([0], np.cumsum(breaks[word])))
    line = 1 + passed[:-1] - passed[starts[:-1]][file]

    kept = np.flatnonzero(facts[word] & _SKIP == 0)
    n = len(kept)
    word, file, pos, line = word[kept], file[kept], pos[kept], line[kept]
    offs = np.concatenate(([0], np.cumsum(np.bincount(file, minlength=files))))
    base = offs[:-1][file]
    idx = np.arange(n) - base + 1
    first = np.flatnonzero(idx == 1)
    is_ = facts[word]
    was = facts[_before(word, first, len(words))]
    prev_line = _before(line + breaks[word], first, 0)
    opens, closes = is_ & _OPENS != 0, is_ & _CLOSES != 0
    net = np.concatenate(([0], np.cumsum(opens.astype(np.int64) - closes)))
    level = net[1:] + closes - net[offs[:-1]][file]
    inside = level - (opens | closes)

    refer = {}
    lowest, deep = int(inside.min(initial=0)), int(level.max(initial=0)) - int(inside.min(initial=0)) + 1
    brackets = np.flatnonzero(opens | closes)
    key = file[brackets] * deep + level[brackets] - lowest
    order = _stable(key)
    brackets, key = brackets[order], key[order]
    paired = opens[brackets[:-1]] & (key[:-1] == key[1:])
    close = np.full(n, -1)
    close[brackets[:-1][paired]] = brackets[1:][paired]
    refer["close"] = close

    # an opening bracket stands twice: as a token of its place, then as what the place inside begins with
    row = np.repeat(np.arange(n), 1 + opens)
    anchor = np.concatenate(([False], row[1:] == row[:-1])) if n else np.zeros(0, bool)
    key = file[row] * deep + inside[row] + anchor - lowest
    order = _stable(key)
    row, anchor, key = row[order].astype(np.int32), anchor[order], key[order]
    at = np.arange(len(row), dtype=np.int32)
    begins = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1]))[: len(row)], at, 0))
    own = np.empty(n, np.int32)
    own[row[~anchor]] = at[~anchor]
    own_begins = begins[own]

    def upto(condition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the latest such row stands, up to each token, and whether its place has one."""
        found = np.maximum.accumulate(np.where(condition, at, -1))[own]
        return found, found >= own_begins

    def latest(condition: np.ndarray) -> np.ndarray:
        """The latest such token before each token, -1 where its place has none."""
        found = np.maximum.accumulate(np.where(condition[row] & ~anchor, at, -1))
        found = np.concatenate(([-1], found[:-1]))[: len(row)][own]
        return np.where(found >= own_begins, row[found], -1) if n else found

    if go:
        starts_here = (prev_line < line) & (idx > 1) & ~closes & (was & _LINE_ENDS != 0)
        following = anchor
    else:
        starts_here, following = is_ & _ENDS != 0, np.True_
    found, there = upto(anchor)
    encl = np.where(there, idx[row[found]], 0) if n else idx
    found, there = upto(anchor | starts_here[row])
    stmt = np.where(there, (idx[row] + following)[found], 1) if n else idx
    heads = ((is_ & _WORD != 0) & (was & _DOT == 0)) | (opens & (was & _VALUE == 0))
    for name, bit in (("func", _FUNC), ("control", _CONTROL), ("type", _TYPE), ("open", _OPEN), ("shut", _SHUT)):
        refer[name] = latest(is_ & bit != 0)
    refer["head"] = latest(heads)
    columns = {"pos": pos, "encl": encl, "stmt": stmt}
    for name, bit in (("assign", _ASSIGN), ("comma", _COMMA)):
        there = latest(is_ & bit != 0)
        columns[name] = np.where(there >= 0, idx[there], 0) if n else there
    columns["block"] = np.full(n, -1)
    if not go:
        braces = np.flatnonzero(opens & (np.array([*(w == "{" for w in words), False])[word]))
        names = np.array([*(_NAMED.get(w, -1) for w in words), -1])
        columns["block"][braces] = _js_blocks(braces, names[word], is_, idx, {c: v[braces] for c, v in (columns | refer).items()})
    return _chunked(toks.take(pa.array(kept)), offs, {"idx": idx, "line": line, "prev_line": prev_line, "inside": inside}, columns, refer, base)


def _js_blocks(at: np.ndarray, names: np.ndarray, is_: np.ndarray, idx: np.ndarray, of: dict) -> np.ndarray:
    """What the ``{`` at some tokens open, by what stands before them."""

    def name(token: np.ndarray, step: int = 0) -> np.ndarray:
        """The word so far from a token, -2 where there is none."""
        near = np.clip(token + step, 0, len(names) - 1)
        there = (token >= 0) & (idx[np.clip(token, 0, None)] + step >= 1) & (near == token + step)
        return np.where(there & (idx[near] == idx[np.clip(token, 0, None)] + step), names[near], -2)

    def among(found: np.ndarray, some: tuple) -> np.ndarray:
        return np.isin(found, [_NAMED[w] for w in some])

    p1 = name(at, -1)
    bracket, shut, word = of["open"], of["shut"], of["type"]
    bracket_at, word_at = np.where(bracket >= 0, idx[bracket], 0), np.where(word >= 0, idx[word], 0)
    typed = (
        (shut >= 0) & (idx[shut] >= of["stmt"]) & (name(shut, 1) == _NAMED[":"]) & ~among(p1, _NO_TYPE)
        # an initialiser or a further argument between them ends the header
        & (of["assign"] < bracket_at) & (of["comma"] < bracket_at)
    )
    head = np.where((p1 == _NAMED[")"]) | typed, bracket, -1)
    q1, q2, q3 = name(head, -1), name(head, -2), name(head, -3)
    function, star = _NAMED["function"], _NAMED["*"]
    declared = (
        (word >= 0) & (word_at >= of["stmt"])
        & (name(word, 1) != -2) & (is_[np.clip(word + 1, 0, len(is_) - 1)] & _TYPE_NAME != 0)
        & ((of["assign"] < word_at) | (of["assign"] < of["stmt"]))
    )
    kind = {k: i for i, k in enumerate(JS_KINDS)}
    return np.select(
        [
            p1 == _NAMED["=>"], among(p1, _BEFORE_BODY), among(q1, _HEADED), (q1 == _NAMED["await"]) & (q2 == _NAMED["for"]),
            (q1 == function) | (q2 == function) | ((q2 == star) & (q3 == function)),
            (q1 != -2) & (is_[head - 1] & _CALLED != 0), declared, (p1 == -2) | among(p1, _AFTER_BARE),
        ],
        [kind["arrow"], p1, q1, kind["for"], kind["function"], kind["method"], names[word], kind["bare"]],
        kind["literal"],
    )


def _chunked(toks: pa.Array, offs: np.ndarray, every: dict, own: dict, refer: dict, base: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The columns of some files, cut into chunks, and the number of chunks of each."""
    counts = np.diff(offs)
    chunks = -(-counts // CHUNK)
    columns = own | {c: np.where(r >= 0, r - base, -1) for c, r in refer.items()}
    if chunks.max(initial=0) > 1:
        shown, sizes, ahead, cuts = [], [], [], []
        for a, b, many in zip(offs[:-1].tolist(), offs[1:].tolist(), chunks.tolist(), strict=True):
            if many == 1:
                shown.append(np.arange(a, b))
                sizes.append(b - a)
                ahead.append(0)
                cuts.append(b)
            for start in range(a, b, CHUNK) if many > 1 else ():
                end = min(start + CHUNK, b)
                here = max(start - BEFORE, a)
                near = np.arange(here, end + AFTER)
                refers = np.stack([refer[c][start:end] for c in REFERS])
                outside = (refers >= 0) & ((refers < start) | (refers >= end))
                far = np.unique(refers[outside])
                along = far[:, None] + np.arange(-FAR_BEFORE, AFTER + 1)
                local = np.where(refers >= 0, refers - here, -1)
                local[outside] = len(near) + np.searchsorted(far, refers[outside]) * along.shape[1] + FAR_BEFORE
                for c, values in zip(REFERS, local, strict=True):
                    columns[c][start:end] = values
                place = np.concatenate((near, along.ravel()))
                # there is nothing before and behind the file
                shown.append(np.where((place >= a) & (place < b), place, -1))
                sizes.append(len(place))
                ahead.append(start - here)
                cuts.append(end)
        place = np.concatenate(shown)
        toks = toks.take(pa.array(place, mask=place < 0))
        every = {c: v[place] for c, v in every.items()}
        ends, cuts = np.concatenate(([0], np.cumsum(sizes))), np.array([0, *cuts])
    else:
        ahead, ends = np.zeros(int(chunks.sum()), np.int32), np.concatenate(([0], offs[1:][counts > 0]))
        cuts = ends
    return chunks, [
        pa.array(ahead, pa.int32()),
        _lists(toks, ends),
        *(_lists(pa.array(every[c], pa.int32()), ends) for c in ALL),
        *(_lists(pa.array(columns[c], pa.int32()), cuts) for c in OWN),
    ]
