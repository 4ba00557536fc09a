import random

import pytest

from lintlake.llm import decontaminate as d
from tests.llm.edge import EDGE, documents


def direct_tiles(a, b, least):
    """Longest common run of unmarked tokens, marked, again and again."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and a[i + n] >= 0 and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append(n)
        free_a[i : i + n] = free_b[j : j + n] = [False] * n


@pytest.mark.parametrize("letters", [2, 3, 6])
def test_tiles_against_direct(letters):
    rnd = random.Random(letters)
    for _ in range(150):
        a = [rnd.randrange(letters) for _ in range(rnd.randrange(40))]
        b = [rnd.randrange(-1, letters) for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.5 and len(a) > 6:
            k = rnd.randrange(1, len(a))
            b[3:3] = a[k:] + [-1] * rnd.randrange(2) + a[:k]
        got = d.tiles(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        for side in (0, 1):
            used = [t[side] + k for t in got for k in range(t[2])]
            assert len(used) == len(set(used))
        want = direct_tiles(a, b, 3)
        lengths = [n for _, _, n in got]
        assert lengths == sorted(lengths, reverse=True)
        assert lengths[:1] == want[:1] and len(used) >= 0.9 * sum(want)
        # what is left has no further match
        left_a = [-2 if any(i <= k < i + n for i, _, n in got) else t for k, t in enumerate(a)]
        left_b = [-1 if any(j <= k < j + n for _, j, n in got) else t for k, t in enumerate(b)]
        assert not direct_tiles(left_a, left_b, 3)


def words(rnd, n):
    return [f"{rnd.choice('abcdefghij')}{rnd.choice('klmnop')}{rnd.randrange(30)}" for _ in range(n)]


def corpus(seed=4):
    rnd = random.Random(seed)
    items = [(i, words(rnd, rnd.randint(3, 40))) for i in range(12)]
    rows = []
    for i in range(60):
        text = words(rnd, rnd.randint(5, 60))
        _, item = rnd.choice(items)
        kind = rnd.random()
        at = rnd.randrange(len(text))
        if kind < 0.2:
            text[at:at] = item
        elif kind < 0.5 and len(item) > 12:
            k = rnd.randrange(5, len(item) - 5)  # in another order, with words between
            text[at:at] = item[k:] + words(rnd, 3) + item[:k]
        elif kind < 0.7:
            text[at:at] = item[: len(item) // 3]
        rows.append((i, rnd.choice([" ", ", "]).join(text).upper()))
    return rows, [(i, " ".join(t)) for i, t in items]


def direct_coverage(rows, items):
    out = {}
    for doc, text in rows:
        t = d.tokens(text)
        for item, body in items:
            b = d.tokens(body)
            if not b:
                continue
            number = {w: i for i, w in enumerate(dict.fromkeys(b))}
            least = min(5, len(b))
            marked = sum(direct_tiles([number[w] for w in b], [number.get(w, -1) for w in t], least))
            if 2 * marked >= len(b):
                out[doc, item] = (marked, len(b))
    return out


def test_contaminated_against_direct(spark):
    rows, items = corpus()
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "!!!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["marked"], r["n_tokens"]) for r in d.contaminated(documents(spark, rows), bench).collect()}
    want = direct_coverage(rows, items)
    assert len(want) > 15 and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) <= 5 for k in got)


def test_blocks_give_the_same(spark):
    rows, items = corpus(7)
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, d.overlaps(docs, bench).collect()))
    many = sorted(map(tuple, d.overlaps(docs, bench, block_chars=200).collect()))
    assert one == many and one
    kept = sorted(r["doc_id"] for r in d.decontaminate(docs, bench, block_chars=200).collect())
    dirty = {r["doc_id"] for r in d.contaminated(docs, bench).collect()}
    assert kept == [i for i, _ in rows if i not in dirty]


def test_edges(spark):
    docs = documents(spark, EDGE)
    bench = spark.createDataFrame([(1, "the same row stands HERE twice and it has"), (1, "the same row stands HERE twice and it has"), (None, "is not the same"), (3, None)], "item_id long, text string")
    found = sorted((str(r["doc_id"]), str(r["item_id"])) for r in d.contaminated(docs, bench).collect())
    assert found == [("6", "1"), ("7", "1"), ("7", "None")]
    kept = d.decontaminate(docs, bench)
    assert kept.dtypes == docs.dtypes and kept.count() == len(EDGE) - 4
    assert d.decontaminate(docs.limit(0), bench).count() == 0
    assert d.contaminated(docs, bench.limit(0)).count() == 0 and d.decontaminate(docs, bench.limit(0)).count() == len(EDGE)
