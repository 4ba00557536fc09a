"""Exact top-k search by inner product: a KD-tree per shard, best boxes first.

Vectors are dealt to shards of bounded size. Each shard's tree is built by splitting at the
median of the widest side and keeps a tight box per node. The largest inner product that a box
can give a query is the sum over sides of the better of its two ends; a query walks a tree from
the node with the best bound on and stops when no bound reaches its kth score. Each block of
queries is searched in one shard first; the kth scores found there go along to all others.

Blocks and shards are of bounded size and meet as one row each, so a task holds one tree and one
block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.shared import arrow_schema, ddl, to_batch, written

#: Rows of a shard, of a leaf of its tree, and queries of a block.
SHARD, LEAF, BLOCK = 4096, 64, 1024
#: A place of a list, or of the nodes still to open, that holds nothing.
FREE = -np.inf
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Tree:
    """A KD-tree over vectors; rows are kept in the order of its leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.children, self.span = [], [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            begin, end, parent = todo.pop()
            part = rows[order[begin:end]]
            low, high = part.min(0), part.max(0)
            if parent is not None:
                self.children[parent].append(len(self.span))
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            self.span.append((begin, end))
            side = int((high - low).argmax()) if len(low) else None
            if end - begin > leaf and side is not None and high[side] > low[side]:
                order[begin:end] = order[begin:end][np.argsort(part[:, side], kind="stable")]
                middle, node = (begin + end) // 2, len(self.span) - 1
                todo += [(begin, middle, node), (middle, end, node)]
        self.ids, self.rows = ids[order], rows[order]
        self.repeats = len(np.unique(ids)) < len(ids)

    def bounds(self, queries: np.ndarray, node: int) -> np.ndarray:
        """The best score that a row in the box of ``node`` can have, per query."""
        return np.maximum(queries, 0) @ self.high[node] + np.minimum(queries, 0) @ self.low[node]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's ``k`` best rows of other ids, ties to smaller ids and
        none below ``kth``; places that stay free hold :data:`FREE`.

        All queries advance together: in each round a query opens the node of its best bound.
        """
        kth = kth.copy()
        scores = np.full((len(queries), k), FREE, self.rows.dtype)
        ids = np.full((len(queries), k), -1, np.int64)
        front = np.full((len(queries), len(self.span)), FREE, self.rows.dtype)
        front[:, 0] = self.bounds(queries, 0)
        active = np.arange(len(queries))
        while True:
            node_of = front[active].argmax(1)
            bound = front[active, node_of]
            # a bound equal to the kth score may still hide a smaller id
            going = (bound >= kth[active]) & (bound > FREE)
            active, node_of = active[going], node_of[going]
            if not len(active):
                return scores, ids
            front[active, node_of] = FREE
            for node in np.unique(node_of):
                some = active[node_of == node]
                for child in self.children[node]:
                    front[some, child] = self.bounds(queries[some], child)
                if not self.children[node]:
                    self._scan(node, some, query_ids, queries, kth, scores, ids)

    def _scan(self, node: int, some: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of a leaf's rows for the queries ``some``, taken into their lists."""
        leaf = slice(*self.span[node])
        got = queries[some] @ self.rows[leaf].T
        got[query_ids[some][:, None] == self.ids[leaf]] = FREE
        best = got.max(1)
        hit = (best >= kth[some]) & (best > FREE)
        some, got = some[hit], got[hit]
        if not len(some):
            return
        k = scores.shape[1]
        both = np.concatenate([scores[some], got], 1)
        names = np.concatenate([ids[some], np.broadcast_to(self.ids[leaf], got.shape)], 1)
        order = _order(both, names)
        both, names = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        if self.repeats:
            for r in range(len(both)):
                seen: set[int] = set()
                first = [c for c, name in enumerate(names[r].tolist()) if both[r, c] > FREE and not (name in seen or seen.add(name))][:k]
                kept = both[r, first], names[r, first]
                both[r] = FREE
                both[r, : len(first)], names[r, : len(first)] = kept
        scores[some], ids[some] = both[:, :k], names[:, :k]
        kth[some] = np.maximum(kth[some], scores[some, -1])


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of each row by score, the largest first, and id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores), 1)
    return np.array([sorted(range(len(s)), key=lambda c: (-s[c], i[c])) for s, i in zip(scores, ids, strict=True)]).reshape(scores.shape)


def _exact(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles where all products and their sums are whole numbers there, else as Python's."""
    size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    kind = np.float64 if size(one) * size(two) * one.shape[1] < 2**52 else object
    return one.astype(kind), two.astype(kind)


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``vec_id, vector``: floor(scale * x) of each component as a long (at its ends beyond).
    Rows without an id or a vector, or with a component that is null or not finite, are left
    out; rows equal in both stand once."""
    own = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = own.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    return kept.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("vector")).distinct()


def _packed(vectors: DataFrame, key: str, keys: int, name: str) -> DataFrame:
    """Rows of equal width in ``keys`` parts, each part one row."""
    row = F.struct(*(c for c in ("vec_id", "vector", "kth") if c in vectors.columns))
    dealt = vectors.select(F.size("vector").alias("width"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(keys)).cast("int").alias(key), row.alias("row"))
    return dealt.groupBy(key, "width").agg(F.collect_list("row").alias(name))


def _unpacked(packed: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    rows = packed.values
    ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
    return ids, rows.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), rows


def _met(shards: DataFrame, blocks: DataFrame, wanted: Column, meetings: int, k: int, leaf: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of each query of a block in each of the
    shards that the block meets."""
    kinds = {"query_id": "long", "vec_id": "long", "score": "long"}
    schema = arrow_schema(kinds)
    sent = blocks.select("width", "queries", F.explode(wanted).alias("shard"))
    # dealt by number: searches take far longer than their rows are large
    met = shards.join(sent, ["shard", "width"]).select("rows", "queries").repartition(max(1, min(meetings, 10_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block in zip(batch.column(0), batch.column(1), strict=True):
                ids, rows, _ = _unpacked(shard)
                query_ids, queries, more = _unpacked(block)
                rows, queries = _exact(rows, queries)
                kth = np.array([FREE if x is None else x for x in more.field("kth").to_pylist()], rows.dtype)
                scores, found = Tree(ids, rows, leaf).search(query_ids, queries, kth, k)
                q, place = np.nonzero(scores > FREE)
                got = [max(LEAST, min(MOST, int(s))) for s in scores[q, place].tolist()]
                yield to_batch(list(zip(query_ids[q].tolist(), found[q, place].tolist(), got, strict=True)), schema)

    return met.mapInArrow(run, ddl(kinds))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, an id once with its best score, as ``rank`` from 1."""
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, k: int = 20, query_every: int = 20, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF, **columns) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of the largest integer inner product
    for each row of ``table`` whose id is divisible by ``query_every``; fewer if there are fewer.

    Ties go to the smaller id. Only vectors of equal length meet, empty ones with score 0. Equal
    rows count once; where an id has several vectors, a query takes its best pair and lists it
    once, and rows of its own id never. Products are exact; beyond the long range they stand at its ends.
    Rows of null ids or unusable vectors take no part; an empty table gives no rows.
    """
    vectors = written(whole_vectors(table, **columns), "vectors")
    is_query = F.col("vec_id") % query_every == 0
    n, n_queries = vectors.select(F.count("*"), F.count(F.when(is_query, 1))).first()
    n_shards, n_blocks = max(1, -(-n // shard)), max(1, -(-n_queries // block))
    shards = written(_packed(vectors, "shard", n_shards, "rows"), "shards")
    queries = vectors.where(is_query)
    first = lambda: F.pmod(F.col("block"), F.lit(n_shards))
    blocks = _packed(queries.withColumn("kth", F.lit(None).cast("long")), "block", n_blocks, "queries")
    seeds = written(_met(shards, blocks, F.array(first()), n_blocks, k, leaf), "found")
    if n_shards == 1:
        return _ranked(seeds, k).select("query_id", "rank", "vec_id", "score")
    kth = _ranked(seeds, k).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("kth"))
    known = queries.join(kth, F.col("vec_id") == F.col("q"), "left").select("vec_id", "vector", "kth")
    others = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: s != first())
    rest = _met(shards, _packed(known, "block", n_blocks, "queries"), others, n_blocks * (n_shards - 1), k, leaf)
    return _ranked(seeds.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
