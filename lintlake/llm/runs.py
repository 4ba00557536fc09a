"""Periodic runs of words, by a suffix automaton with link-cut access.

Words are appended one by one to a suffix automaton. Its suffix links form a tree, kept as a
link-cut tree whose preferred paths are the stretches of states that were last reached by the
same word. Access from the newest state recolours the way to the root; each stretch it takes over
tells where its strings ended before. Where that is at most as many words back as the stretch's
longest string has, the text there is a square: its half is the distance. Squares of one half
that end at neighbouring words are one maximal run.

A run of at least four periods holds each of its words four times or more, so a text is first
cut at words that are rarer, and its pieces again; runs lie inside the pieces, and only these are
given to an automaton.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.llm.shared import arrow_schema, ddl, ids_and_texts, row_wise

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, PERIODS = 6, 4
#: Passes that cut a text at rare words; what is left after them goes to the automaton.
PASSES = 6


class Squares:
    """Squares of a growing sequence. State 0 is the empty string and the root of the links."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.length, self.link = [0], [-1]
        # the link-cut tree: a splay tree per preferred path, deeper states to the right;
        # up[root of a splay tree] is the state above the path
        self.up, self.left, self.right = [-1], [-1], [-1]
        # colours lie at the roots of splay trees: the last end of the path's strings
        self.end = [-1]
        self.newest, self.size = 0, 0

    def _state(self, after: dict, length: int) -> int:
        self.next.append(after)
        self.length.append(length)
        for column in (self.link, self.up, self.left, self.right, self.end):
            column.append(-1)
        return len(self.length) - 1

    def append(self, word) -> list[int]:
        """Halves of the primitive squares that end with ``word``, as it is appended."""
        following, length, link = self.next, self.length, self.link
        p = self.newest
        new = self._state({}, length[p] + 1)
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p < 0:
            self._hang(new, 0)
        else:
            q = following[p][word]
            if length[q] == length[p] + 1:
                self._hang(new, q)
            else:
                copy = self._state(following[q].copy(), length[p] + 1)
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = copy
                    p = link[p]
                self._between(copy, q)
                self._hang(new, copy)
        self.newest = new
        halves = self._access(new)
        self.size += 1
        return halves

    def _hang(self, state: int, parent: int) -> None:
        """A new leaf below ``parent``."""
        self.link[state] = self.up[state] = parent

    def _between(self, copy: int, state: int) -> None:
        """``copy`` comes between ``state`` and the state above it; its strings ended where
        those of ``state`` did."""
        up, left, right = self.up, self.left, self.right
        self._splay(state)
        above = left[state]
        self.link[copy] = self.link[state]
        self.link[state] = copy
        # on the path of its state: what lay above the state lies above the copy
        left[copy] = above
        if above >= 0:
            up[above] = copy
        left[state] = copy
        up[copy] = state

    def _access(self, state: int) -> list[int]:
        """Makes the way from ``state`` to the root one path that ends now; squares met."""
        up, left, right, end, length = self.up, self.left, self.right, self.end, self.length
        now, halves = self.size, []
        below, at = -1, state
        while at >= 0:
            self._splay(at)
            colour = end[at]
            if colour >= 0 and now - colour <= length[at]:
                halves.append(now - colour)
            if (cut := right[at]) >= 0:
                end[cut] = colour  # the deeper rest is a path of its own; up[cut] stays
            right[at] = below
            if below >= 0:
                up[below] = at
            below, at = at, up[at]
        end[below] = now
        return halves

    def _splay(self, x: int) -> None:
        """``x`` becomes the root of its splay tree."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        top = -1
        while p >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            in_tree = g >= 0 and (left[g] == p or right[g] == p)
            if in_tree:
                if (left[g] == p) == (left[p] == x):
                    self._rotate(p, g)
                else:
                    self._rotate(x, p)
                    p = g
            self._rotate(x, p)
            top = p if not in_tree else g
            p = up[x]
        if top >= 0:
            self.end[x] = self.end[top]

    def _rotate(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            up[inner] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x


def _pieces(words: list) -> Iterator[tuple[int, int]]:
    """Stretches that hold all runs: no word in them is rarer than :data:`PERIODS`, or they were
    cut :data:`PASSES` times."""
    todo = [(0, len(words), 0)]
    while todo:
        begin, end, passes = todo.pop()
        if end - begin < LEAST_WORDS:
            continue
        part = words[begin:end]
        counts = Counter(part)
        if passes == PASSES or min(counts.values()) >= PERIODS:
            yield begin, end
            continue
        cuts = [-1, *(i for i, w in enumerate(part) if counts[w] < PERIODS), len(part)]
        todo.extend((begin + a + 1, begin + b, passes + 1) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > LEAST_WORDS)


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all maximal runs of ``words``, by start and period: of
    :data:`LEAST_WORDS` words and :data:`PERIODS` times the smallest period at least."""
    found = []
    for begin, end in _pieces(words):
        squares, open_ = Squares(), {}
        for i in range(begin, end):
            halves = squares.append(words[i])
            if halves or open_:
                # a square that ends one word further belongs to the same run
                going = {half: open_.pop(half, i) for half in halves}
                found += [(first - 2 * half + 1, i - first + 2 * half - 1, half) for half, first in open_.items()]
                open_ = going
        found += [(first - 2 * half + 1, end - first + 2 * half - 1, half) for half, first in open_.items()]
    return sorted((s, n, q) for s, n, q in found if n >= max(LEAST_WORDS, PERIODS * q))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that lie in a run behind its first period."""
    if not runs:
        return words
    kept, at = [], 0
    for begin, end in sorted((s + q, s + n) for s, n, q in runs):
        if begin > at:
            kept += words[at:begin]
        at = max(at, end)
    return kept + words[at:]


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` of each row of ``docs`` (``doc_id, text``): its maximal runs
    (``start, length, period`` in words, by start and period) and its words without what the
    runs repeat, joined by one blank.

    Words are what stands between ASCII white space. A null or empty text has no words, no runs
    and an empty ``collapsed``; rows are judged one by one, whatever repeats; an empty table
    gives no rows; other columns play no part.
    """
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    schema = pa.schema([*arrow_schema({"doc_id": "long"}), pa.field("runs", pa.list_(run)), pa.field("collapsed", pa.string())])

    def one(doc_id: int | None, text: str | None) -> tuple:
        words = (text or "").encode().split()
        runs = runs_of(words)
        return doc_id, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(collapsed(words, runs)).decode()

    kinds = {"doc_id": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
    return ids_and_texts(docs).mapInArrow(lambda batches: row_wise(batches, one, schema), ddl(kinds))
