"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``seed`` tokens that a document shares with a benchmark text. They are joined
in the tasks that read the documents: the benchmark goes round in blocks of bounded size, each
against all documents. For a document and a test that share seeds, the longest non-overlapping
matches are marked again and again, longest first, found by running Karp-Rabin hashes of falling
length; the share of the test's tokens that end up marked decides. Passages in another order
count as well as passages in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import arrow_schema, as_rows, cut, ddl, from_rows, ids_and_texts

#: Characters of benchmark text that go to every task at once; more go in further rounds.
BLOCK_CHARS = 8 << 20
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
#: Karp-Rabin base and modulus.
BASE, PRIME = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and marks."""
    return WORD.findall((text or "").lower())


def tiles(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in a, place in b, length)`` of matches of ``least``
    tokens or more, longest first, no token in two; the first in ``a``, then in ``b``, of
    equals. A negative token matches nothing.
    """
    marked_a, marked_b = [t < 0 for t in a], [t < 0 for t in b]
    out: list[tuple[int, int, int]] = []
    length = min(len(a), len(b))
    while length >= least:
        found = _matches(a, b, marked_a, marked_b, length)
        if not found:
            length = max(least, length // 2) if length > least else 0
            continue
        longest = max(n for _, _, n in found)
        for at_a, at_b, n in sorted(found):
            if n == longest and not any(marked_a[at_a : at_a + n]) and not any(marked_b[at_b : at_b + n]):
                out.append((at_a, at_b, n))
                marked_a[at_a : at_a + n] = marked_b[at_b : at_b + n] = [True] * n
        length = longest - 1
    return out


def _matches(a: list[int], b: list[int], marked_a: list[bool], marked_b: list[bool], length: int) -> list[tuple[int, int, int]]:
    """All matches of unmarked tokens, as long as they go, of ``length`` or more."""
    places: dict[int, list[int]] = {}
    for at, h in _running(a, marked_a, length):
        places.setdefault(h, []).append(at)
    out = []
    for at_b, h in _running(b, marked_b, length) if places else ():
        for at_a in places.get(h, ()):
            before = at_a and at_b and a[at_a - 1] == b[at_b - 1] and not marked_a[at_a - 1] and not marked_b[at_b - 1]
            if before or a[at_a : at_a + length] != b[at_b : at_b + length]:
                continue
            i, j = at_a + length, at_b + length
            while i < len(a) and j < len(b) and a[i] == b[j] and not marked_a[i] and not marked_b[j]:
                i, j = i + 1, j + 1
            out.append((at_a, at_b, i - at_a))
    return out


def _running(text: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Place and hash of each window without a marked token, each from the one before."""
    top = pow(BASE, length, PRIME)
    h = run = 0
    for i, token in enumerate(text):
        if marked[i]:
            h = run = 0
            continue
        h = (h * BASE + token + 1) % PRIME
        run += 1
        if run > length:
            h = (h - (text[i - length] + 1) * top) % PRIME
        if run >= length:
            yield i - length + 1, h


class Tests:
    """A block of benchmark texts as numbered tokens, with their seeds."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.seed = seed
        pairs: set[tuple[int, int]] = set()
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)]
            if ids:
                pairs |= {(h, len(self.items)) for h in self._hashes(np.array(ids, np.int64)).tolist()}
                self.items.append((item_id, ids))
        ordered = sorted(pairs)
        self.hashes = np.array([p[0] for p in ordered], np.int64)
        self.owners = np.array([p[1] for p in ordered], np.int64)

    def _hashes(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each run of ``seed`` tokens, or of all if there are fewer."""
        size = min(self.seed, len(ids))
        with np.errstate(over="ignore"):
            total = np.zeros(len(ids) - size + 1, np.uint64)
            for i in range(size):
                total = (total + ids[i : len(ids) - size + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
        return total.view(np.int64) if size == self.seed else np.array([-size - int(total[0] >> np.uint64(8))])

    def hits(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """``item_id, marked tokens, tokens`` of each test that shares a seed with ``text``."""
        known = self.vocabulary.get
        ids = np.array([known(t, -1) for t in tokens(text)], np.int64)
        out = []
        if len(ids) < 1 or not len(self.hashes):
            return out
        shares: dict[int, list[int]] = {}
        if len(ids) >= self.seed:
            runs = np.flatnonzero(np.convolve(ids > 0, np.ones(self.seed, int), "valid") == self.seed)
            if len(runs):
                h = self._hashes(ids)[runs]
                low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
                for at, a, b in zip(runs[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    for owner in self.owners[a:b].tolist():
                        shares.setdefault(owner, []).append(at)
        listed = ids.tolist()
        for owner in sorted(shares):
            item_id, item = self.items[owner]
            # only the stretches that hold seeds can match; a bar keeps them apart
            reduced, end = [], -1
            for at in shares[owner]:
                if at > end and reduced:
                    reduced.append(-1)
                reduced.extend(listed[max(at, end) : at + self.seed])
                end = at + self.seed
            marked = sum(n for _, _, n in tiles(item, reduced, self.seed))
            out.append((item_id, marked, len(item)))
        for item_id, item in self.items:
            if len(item) < self.seed and _holds(listed, item):
                out.append((item_id, len(item), len(item)))
        return out


def _holds(ids: list[int], item: list[int]) -> bool:
    first = item[0]
    return any(t == first and ids[i : i + len(item)] == item for i, t in enumerate(ids))


def overlaps(docs: DataFrame, benchmark: DataFrame, seed: int = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, marked, n_tokens``: tokens of the test that tiles of the document
    mark, for every pair that shares a seed.

    A test shorter than a seed counts if the document has all of it in a row. Null and empty
    texts share nothing; repeated rows of a document or a test give a row each.
    """
    own = ids_and_texts(docs)
    found = None
    for items in blocks_of(benchmark, block_chars):
        part = _round(own, docs.sparkSession.sparkContext.broadcast(items), seed)
        found = part if found is None else found.unionByName(part)
    return found


def blocks_of(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's texts in shares by hash, of about half of ``block_chars`` each; one
    share at a time is on the driver."""
    texts = cut(benchmark.selectExpr("CAST(item_id AS BIGINT) AS item_id", "CAST(text AS STRING) AS text").where("length(text) > 0"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_chars))
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], r["text"]) for r in mine.toLocalIterator()]


def _round(own: DataFrame, items, seed: int) -> DataFrame:
    columns = {"doc_id": "long", "item_id": "long", "marked": "int", "n_tokens": "int"}
    schema = arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(items.value, seed)

        for batch in batches:
            rows = [(d, *hit) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for hit in tests.hits(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return own.mapInArrow(run, ddl(columns))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, seed: int = 5) -> DataFrame:
    """``doc_id, item_id, marked, n_tokens, coverage`` of the pairs whose tiles cover at least
    ``least`` of the test. Repeated document rows are one pair."""
    pairs = overlaps(docs, benchmark, seed).withColumn("coverage", F.col("marked") / F.col("n_tokens"))
    return pairs.where(F.col("coverage") >= least).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, seed: int = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that cover no test to ``least``, with all their columns.

    Each row is judged by its own text where it lies, so nothing is joined and rows that share
    an id, or have none, don't touch each other.
    """
    left = docs
    for items in blocks_of(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        shaped, names = as_rows(left)
        place = names.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            tests = Tests(shared.value, seed)
            for batch in batches:
                clean = [all(marked < least * n for _, marked, n in tests.hits(t)) for t in batch.column("row").field(place).cast(pa.string()).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        left = shaped.mapInArrow(run, shaped.schema)
        left = left.select(*from_rows(left, names))
    return left
