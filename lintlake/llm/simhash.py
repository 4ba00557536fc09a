"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked where at most ``radius`` bits differ. Bits that go together
in the corpus are put in one part. Parts get unequal thresholds that add up to
``radius - parts + 1``; at least one part of any linked pair is then within its own threshold.
Dynamic programming picks the thresholds (and the number of parts) of least estimated work,
from bit counts over all fingerprints. A fingerprint files each part under its value and
probes the values within the threshold; what meets is verified on all bits.

Only links that connect something new inside a bucket leave a task, so a bucket of n gives at
most n - 1 rows; a bucket above :data:`BLOCK` rows is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.components import components
from lintlake.llm.shared import arrow_schema, cut, ddl, ids_and_texts, row_wise

BITS, SEED = 64, 42
#: Rows of a bucket that one task compares at a time.
BLOCK = 20_000
#: Work of one probe and of one verified candidate, relative to each other.
PROBE, VERIFY = 20.0, 1.0
PRINTS = {"doc_id": "long", "text_hash": "long", "print": "long"}


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is set if it is set in over half of the hashes of the shingles.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by one
    space, repeats count. Fewer words make one shingle; none make zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        some = np.array(hashes[at : at + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > len(hashes)).tolist())


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, text_hash, print`` per row (the 64 bits as a signed long); a null text has no
    words."""
    schema = arrow_schema(PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(doc_id, text_hash, text):
            p = fingerprint(text, words)
            return doc_id, text_hash, p - (1 << 64) if p >> 63 else p

        return row_wise(batches, one, schema)

    own = ids_and_texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, ddl(PRINTS))


@dataclass(frozen=True)
class Plan:
    """Masks of the parts and the threshold of each; a threshold of -1 leaves a part out."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and how often each two bits are set together, over all rows.

    Each task sums its own 64 x 64 counts, so the driver gets 4096 sums whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            rows += len(values)
            for at in range(0, len(values), 65_536):
                bits = np.unpackbits(values[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += np.rint(bits.T @ bits).astype(np.int64)
        if rows:
            spot = np.arange(BITS * BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(spot, pa.int32()), pa.array(np.append(total.ravel(), rows), pa.int64())], names=["spot", "n"])

    sums = prints.select("print").mapInArrow(run, "spot int, n long").groupBy("spot").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BITS * BITS + 1, np.int64)
    for r in sums:
        found[r["spot"]] = r["n"]
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def make_plan(rows: int, both: np.ndarray, radius: int = 3) -> Plan:
    """The parts and thresholds of least estimated work."""
    n = max(rows, 1)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    together = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    best: tuple[float, Plan] | None = None
    for parts in range(1, radius + 2):
        groups = _groups(together, parts)
        costs = [_costs(p[g], n, radius) for g in groups]
        # least[s]: (cost, thresholds) of the parts so far, thresholds adding up to s
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in costs:
            ahead: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, chosen) in least.items():
                for t, extra in enumerate(c, start=-1):
                    here = (cost + extra, (*chosen, t))
                    if s + t not in ahead or here < ahead[s + t]:
                        ahead[s + t] = here
            least = ahead
        cost, chosen = least[radius - parts + 1]
        masks = tuple(sum(1 << int(b) for b in g) for g in groups)
        if best is None or cost < best[0]:
            best = (cost, Plan(masks, chosen))
    return best[1]


def _groups(together: np.ndarray, parts: int) -> list[np.ndarray]:
    """Bits in ``parts`` groups of equal size, each begun with the bit that goes best with all
    that are left, and grown by the bit that goes best with it."""
    left = list(range(BITS))
    groups = []
    for i in range(parts):
        size = (len(left) + parts - i - 1) // (parts - i)
        group = [max(left, key=lambda b: (round(together[b, left].sum(), 9), -b))]
        left.remove(group[0])
        while len(group) < size:
            bit = max(left, key=lambda b: (round(together[b, group].sum(), 9), -b))
            left.remove(bit)
            group.append(bit)
        groups.append(np.array(sorted(group)))
    return groups


def _costs(p: np.ndarray, n: int, radius: int) -> list[float]:
    """Estimated work of a part at thresholds -1, 0, ... radius: probes, and pairs within."""
    differ = 2 * p * (1 - p)
    chance = np.array([1.0])  # of 0, 1, ... differing bits
    for d in differ:
        chance = np.append(chance * (1 - d), 0.0) + np.append(0.0, chance * d)
    out = [0.0]
    for t in range(radius + 1):
        probes = sum(comb(len(p), k) for k in range(t + 1))
        out.append(PROBE * n * probes + VERIFY * n * n / 2 * float(chance[: t + 1].sum()))
    return out


def filed(prints: DataFrame, plan: Plan) -> DataFrame:
    """``part, key, own, print``: each fingerprint under its own keys and its probes."""
    rows = []
    for part, (mask, t) in enumerate(zip(plan.masks, plan.thresholds, strict=True)):
        if t < 0:
            continue
        bits = [1 << b for b in range(BITS) if mask >> b & 1]
        flips = [0, *(sum(c) for k in range(1, t + 1) for c in combinations(bits, k))]
        flips = [f - (1 << 64) if f >> 63 else f for f in flips]
        mask = mask - (1 << 64) if mask >> 63 else mask
        flip = F.explode(F.array(*(F.lit(f).cast("long") for f in flips)))
        row = prints.select("print", flip.alias("flip"))
        if t == 1:
            # of two values that differ in one bit, the one that has the bit probes the other
            row = row.where(F.col("print").bitwiseAND(F.col("flip")) == F.col("flip"))
        key = F.col("print").bitwiseAND(F.lit(mask).cast("long")).bitwiseXOR(F.col("flip"))
        rows.append(row.select(F.lit(part).cast("tinyint").alias("part"), key.alias("key"), (F.col("flip") == 0).alias("own"), "print"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def links(prints: DataFrame, plan: Plan, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all that are linked."""
    rows = filed(prints, plan)
    # how many times a bucket is too large for one comparison; most are not listed
    hot = cut(rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    n_hot = hot.count()
    none = F.lit(0)
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= 100_000 else hot
        blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / block).cast("int")
        mine = F.pmod(F.xxhash64("print"), blocks).cast("int")
        rows = rows.join(hot, ["part", "key"], "left").withColumns({"mine": mine, "other": F.explode(F.sequence(none, blocks - 1))})
        rows = rows.select("part", "key", "own", "print", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    else:
        rows = rows.select("part", "key", "own", "print", none.alias("i"), none.alias("j"))
    spread = rows.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)]
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            part, key, _, _, i, j = held
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            if len(new):
                # the last bucket may go on in the next batch
                yield _linked([x[: new[-1]] for x in held], np.insert(new, 0, 0), radius)
                held = [x[new[-1] :] for x in held]
        if held:
            part, key, _, _, i, j = held
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            yield _linked(held, np.append(np.insert(new, 0, 0), len(part)), radius)

    return spread.mapInArrow(run, "a long, b long").distinct()


def _linked(rows: list[np.ndarray], bounds: np.ndarray, radius: int) -> pa.RecordBatch:
    own, prints = rows[2], rows[3]
    sizes = np.diff(bounds)
    owners = np.add.reduceat(own, bounds[:-1]) if len(sizes) else sizes
    meet = (sizes > 1) & (owners > 0)
    two = bounds[:-1][meet & (sizes == 2)]
    near = np.bitwise_count((prints[two] ^ prints[two + 1]).view(np.uint64)) <= radius
    a, b = [prints[two][near]], [prints[two + 1][near]]
    for k in np.flatnonzero(meet & (sizes > 2)).tolist():
        values = np.unique(prints[bounds[k] : bounds[k + 1]])
        x, y = forest(values.view(np.uint64), radius)
        a.append(values[x])
        b.append(values[y])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect whatever links of at most ``radius`` bits connect.

    What is reached leaves the rest, so a dense group is read about once.
    """
    rest = np.arange(len(values))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= radius
            if near.any():
                hits = rest[near]
                a.append(np.full(len(hits), at))
                b.append(hits)
                reached.extend(hits.tolist())
                rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def classes(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row: the smallest doc_id that links reach.

    Copies share a fingerprint and are linked through it, so only distinct fingerprints are
    compared. Texts without words all have fingerprint zero and are one class. Repeated rows
    and rows without an id come back each; a class of nulls only has a null component. Extra
    columns play no part; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words))
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0")
    return prints.join(owners(prints, radius), "print").select("doc_id", hexed.alias("fingerprint"), "component_id")


def owners(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``print, root, component_id`` of each distinct fingerprint; roots name the classes."""
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    plan = make_plan(*bit_counts(distinct), radius)
    root = components(links(distinct.select("print"), plan, radius))
    rooted = distinct.join(root.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("print", "root").join(named, "root").select("print", "root", "component_id")


def keep_first(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` per class, that of the smallest doc_id; all columns stay.

    Of rows that share this id the one of the smallest text hash stays, and one of its
    repetitions; a class of rows without any id keeps one of these. Classes are found on
    fingerprints alone; the texts move once, for the semi-join that takes the kept rows.
    """
    prints = cut(fingerprints(docs, words))
    named = prints.join(owners(prints, radius), "print").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    each = named.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = cut(each.groupBy("root").agg(F.min(F.struct("text_hash", "doc_id", "n")).alias("first")).select(F.col("first.doc_id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"), "first.n"))
    columns = docs.columns
    shaped = docs.select(
        F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    out = shaped.join(kept.where("n = 1"), same, "left_semi").select("row")
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        some = shaped.join(repeated, same, "left_semi")
        out = out.unionByName(some.groupBy("doc_id", "text_hash").agg(F.first("row").alias("row")).select("row"))
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)))
