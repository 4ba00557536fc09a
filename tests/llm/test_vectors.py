import math
import random

from pyspark.sql import functions as F

from lintlake.llm import vectors
from tests.llm.edge import CLASHES, table

COLUMNS = ("query_id", "rank", "vec_id", "score")
SCHEMA = "vec_id long, embedding array<double>"


def direct(rows, k=20, every=20):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = {}
    for q, x in usable:
        if q % every == 0:
            for i, y in usable:
                if i != q and len(x) == len(y):
                    score = sum(a * b for a, b in zip(x, y, strict=True))
                    best.setdefault(q, {})
                    best[q][i] = max(score, best[q].get(i, score))
    out = []
    for q, found in best.items():
        for rank, (i, s) in enumerate(sorted(found.items(), key=lambda f: (-f[1], f[0]))[:k], 1):
            out.append((q, rank, i, max(-(1 << 63), min((1 << 63) - 1, s))))
    return sorted(out, key=str)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = direct(rows)
    for shard, block, leaf in ((4096, 1024, 64), (100, 9, 8), (37, 4, 1)):
        assert table(vectors.top_k(df, shard=shard, block=block, leaf=leaf), *COLUMNS) == want


def test_ties_and_equal_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)]) for i in range(-200, 200)]
    rows += [(7, [0.5, 0.5, 0.5]), (7, [-0.5, 0.5, 0.5]), (20, [0.5, 0.5, 0.5]), (20, [0.0, 0.0, -0.5])] + rows[:40] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    assert table(vectors.top_k(df, shard=50, block=5, leaf=4), *COLUMNS) == direct(rows)
    assert table(vectors.top_k(df, k=3, query_every=7, shard=64, leaf=2), *COLUMNS) == direct(rows, 3, 7)


def test_a_box_is_passed_only_below_the_kth_score():
    import numpy as np

    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.integers(-60, -20, (4000, 4)), rng.integers(20, 60, (96, 4))]).astype(float)
    tree = vectors.Tree(np.arange(len(rows)), rows, 16)
    opened = []
    scan = tree._scan
    tree._scan = lambda node, *rest: (opened.append(node), scan(node, *rest))
    query = np.array([[3.0, 1.0, 2.0, 1.0]])
    scores, ids = tree.search(np.array([-5]), query, np.array([-np.inf]), 5)
    want = sorted(range(len(rows)), key=lambda i: (-(rows[i] @ query[0]), i))[:5]
    assert ids[0].tolist() == want and len(opened) < 20


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 0.0]), (None, [1.0, 1.0]), (1, [0.01, -0.01]), (0, [1.0, 2.0]), (2, [1e17, 1e17]), (100, [1e17, -1e17]), (120, []), (3, []), (140, [1.0, 2.0, 3.0]), (4, [1e300, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in (*CLASHES, "vector", "x", "rows", "queries", "shard", "block", "width")})
    big = (1 << 63) - 1
    clipped = [(i, v if v is None or 1e300 not in v else [big / 64, 1.0]) for i, v in rows]
    got = table(vectors.top_k(df), *COLUMNS)
    assert [r[:3] for r in got] == [r[:3] for r in direct(clipped)]
    assert vectors.top_k(df.limit(0)).count() == 0
    assert vectors.top_k(spark.createDataFrame([(20, None)], SCHEMA)).count() == 0
    assert vectors.top_k(spark.createDataFrame([(20, [1.0])], SCHEMA)).count() == 0
