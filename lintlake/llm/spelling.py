"""Spelling variants: words that differ by one letter, found with blocked Gram matrices.

Every word has a vector of letter counts. One inserted or deleted letter puts two vectors at
squared distance 1, one replaced letter at 2; so NumPy products of blocks of count vectors give
all candidates, and an edit check decides. Blocks are taken of adjacent lengths only, and inside
a length of cells: letters are dealt into a few groups, a cell holds the words with equal counts
per group, and one edit moves a word to the same cell or a known neighbour. A cell of many words
is split into parts, and every part meets every part of the cells next to it once, each meeting a
row of its own, so no cell is work for one task alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import arrow_schema, cut, ddl, ids_and_texts, to_batch, written

#: Letters of a run once A-Z are lowered, one letter in so many runs goes.
LETTERS = "".join(map(chr, (*range(97, 123), *range(0xC0, 0x100))))
RUN = regex.compile("[a-zÀ-ÿ]+")
ONE_IN = 199
#: Words and letters of a part; entries that a task counts before it sends them on.
PART_WORDS, PART_LETTERS, HELD = 8192, 1 << 20, 200_000
#: Numbers of a distance matrix that is held at once.
MATRIX = 1 << 23


def _spoilt(run: str, crc: int) -> str:
    """``run`` without one letter if the hash says so; ``crc`` is that of what comes before it."""
    h = zlib.crc32(run.encode(), crc)
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 6) -> DataFrame:
    """``word, n`` of all documents: runs of letters, A-Z lowered, one in 199 (by document and
    run) without a letter; words of ``least_length`` or more. Runs of a row without an id stay
    as they are."""
    kinds = {"word": "string", "n": "long"}
    schema = arrow_schema(kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                lowered = text.lower() if text.isascii() else text.encode().lower().decode()
                crc = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(RUN.findall(lowered)).items():
                    if len(run) >= least_length and len(word := run if crc is None else _spoilt(run, crc)) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield to_batch(list(held.items()), schema)
                    held.clear()
        if held:
            yield to_batch(list(held.items()), schema)

    return ids_and_texts(docs).mapInArrow(count, ddl(kinds)).groupBy("word").agg(F.sum("n").alias("n"))


def cell_of(word: Column, groups: int) -> Column:
    """Letters of a word by group: equal for all words of a cell, and its sum is the length."""
    rest = ["".join(c for c in LETTERS if ord(c) % groups != g) for g in range(groups)]
    return F.array(*(F.length(F.translate(word, r, "")) for r in rest))


def _neighbours(cell: Column, groups: int) -> Column:
    """Cells one edit away, each two cells told once: one letter more, or moved to a later group
    from an earlier one; and the cell itself."""
    moved = lambda plus, minus: F.array(*(cell[i] + int(i == plus) - int(i == minus) for i in range(groups)))
    return F.array(cell, *(moved(g, None) for g in range(groups)), *(moved(b, a) for a in range(groups) for b in range(a + 1, groups)))


def _meetings(parts: DataFrame, groups: int) -> DataFrame:
    """``id, cell, part, second``: two rows for each two parts that have to meet, one for a
    part by itself."""
    near = parts.select("cell", "parts", F.explode(_neighbours(F.col("cell"), groups)).alias("other"))
    others = parts.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts"))
    same = F.col("cell") == F.col("other")
    met = near.join(others, "other").select("cell", "other", "other_parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = met.select("cell", "other", "part", F.explode(F.sequence(F.when(same, F.col("part")).otherwise(0), F.col("other_parts") - 1)).alias("other_part"))
    alone = same & (F.col("part") == F.col("other_part"))
    side = lambda cell, part, second: F.struct(F.col(cell).alias("cell"), F.col(part).alias("part"), F.lit(second).alias("second"))
    one, two = side("cell", "part", False), side("other", "other_part", True)
    met = met.select(F.struct("cell", "part", "other", "other_part").alias("id"), F.explode(F.when(alone, F.array(one)).otherwise(F.array(one, two))).alias("s"))
    return met.select("id", "s.*")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a row each (0 where a word is over), and their lengths."""
    lengths = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return codes, lengths


def _letter_counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    kind = np.float32 if codes.shape[1] < 2000 else np.float64  # squares and products stay whole numbers
    counts = np.zeros((len(codes), len(letters)), kind)
    for j, letter in enumerate(letters):
        counts[:, j] = (codes == letter).sum(1)
    return counts


def one_edit(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows ``i`` and ``j`` differ by one inserted, deleted or replaced code point."""
    good = np.zeros(len(i), bool)
    if not len(i):
        return good
    swap = left[1][i] > right[1][j]
    for one, two, a, b, at in ((left, right, i, j, ~swap), (right, left, j, i, swap)):
        a, b = a[at], b[at]
        width = max(one[0].shape[1], two[0].shape[1])
        short, long = (np.pad(x[0], ((0, 0), (0, width - x[0].shape[1])))[k] for x, k in ((one, a), (two, b)))
        differ = short != long
        # up to the first place that differs both agree; behind it the longer is one place on
        first = np.where(differ.any(1), differ.argmax(1), width)
        shifted = np.pad(long[:, 1:], ((0, 0), (0, 1)))
        tail = np.arange(width) >= first[:, None]
        replaced = differ.sum(1) == 1
        inserted = ~((short != shifted) & tail).any(1)
        gap = two[1][b] - one[1][a]
        good[at] = np.where(gap == 0, replaced, (gap == 1) & inserted)
    return good


def near_words(one: list[str], two: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``one`` and ``two`` of all words one edit apart; without ``two`` each pair
    inside ``one`` once."""
    left = _codes(one)
    right = left if two is None else _codes(two)
    letters = np.union1d(left[0], right[0])
    a = _letter_counts(left[0], letters[letters > 0])
    b = a if two is None else _letter_counts(right[0], letters[letters > 0])
    norm_a, norm_b = (a * a).sum(1), (b * b).sum(1)
    step, found = max(1, MATRIX // max(1, len(b))), [(np.empty(0, int), np.empty(0, int))]
    for at in range(0, len(a), step):
        gram = a[at : at + step] @ b.T
        gram *= -2
        gram += norm_a[at : at + step, None]
        gram += norm_b
        i, j = np.nonzero(gram <= 2)
        i += at
        if two is None:
            i, j = i[i < j], j[i < j]
        good = one_edit(left, right, i, j)
        found.append((i[good], j[good]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def neighbours(words: DataFrame, groups: int | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """``word, n_near, best``: for each word of ``words`` (``word, n``, distinct) that has one,
    the number of words one edit away and, as ``best`` (``less``, ``word``), that with the
    largest n (``-less``), the first in code-point order of equals."""
    if groups is None:
        groups = max(2, min(6, round(math.log10(max(words.count(), 1))) - 2))
    celled = words.select("word", "n", cell_of(F.col("word"), groups).alias("cell"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("c"), F.sum(F.length("word")).alias("letters"))
    parts = cut(sizes.select("cell", F.ceil(F.greatest(F.col("c") / part_words, F.col("letters") / PART_LETTERS)).cast("int").alias("parts")))
    dealt = celled.join(parts, "cell").select("cell", F.pmod(F.xxhash64("word"), "parts").cast("int").alias("part"), "word", "n")
    packed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    sides = _meetings(parts, groups).join(packed, ["cell", "part"]).select("id", F.struct("second", "words").alias("side"))
    # by number of meetings, not by bytes: products take far longer than their words are large
    sides = sides.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    met = sides.groupBy("id").agg(F.collect_list("side").alias("sides")).select("sides")
    kinds = {"word": "string", "n_near": "long", "other_n": "long", "other": "string"}
    schema = arrow_schema(kinds)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides in batch.column(0):
                sides = sorted(sides.as_py(), key=lambda s: s["second"])
                lists = [([w["word"] for w in s["words"]], [w["n"] for w in s["words"]]) for s in sides]
                i, j = near_words(lists[0][0], lists[1][0] if len(lists) > 1 else None)
                rows: dict[tuple, list] = {}
                for (words, _), (others, ns), a, b in ((lists[0], lists[-1], i, j), (lists[-1], lists[0], j, i)):
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        best = (-ns[y], others[y])
                        row = rows.setdefault(words[x], [0, best])
                        row[0] += 1
                        row[1] = min(row[1], best)
                yield to_batch([(w, r[0], r[1][0], r[1][1]) for w, r in rows.items()], schema)

    found = met.mapInArrow(compare, ddl(kinds))
    best = F.min(F.struct(F.col("other_n").alias("less"), F.col("other").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """``word, root``: from each word of ``forms`` (``word, form``) along the forms to the last;
    no way has more than ``longest`` steps, and its length doubles with each join."""
    way = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(longest, 1))))):
        onward = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = cut(way.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return way


def variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, ratio: int = 5, **blocks) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id, text``).

    A word's form is the word one edit away with the largest n, if that is ``ratio`` times its
    own or more. Null and empty texts have no words, repeated rows count as often as they stand,
    a row without an id counts with its runs whole, ties go by code-point order, an empty table
    gives no rows; other columns play no part.
    """
    words = written(word_counts(docs, least_length).where(F.col("n") >= least_n), "words")
    near = neighbours(words, **blocks)
    formed = F.col("best.less") <= -ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")
    )
    judged = written(judged, "variants")
    most = judged.agg(F.max("n")).first()[0] or 1
    # n grows by the ratio with each step
    way = roots(judged.where("form IS NOT NULL").select("word", "form"), 1 + int(math.log(most / least_n, ratio)) if most > least_n else 1)
    whole = judged.join(way, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
