import random
import re

import numpy as np
import xxhash

from lintlake.llm import simhash
from lintlake.llm.components import components
from tests.llm.edge import EDGE, documents, table


def direct_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] or [xxhash.xxh64_intdigest(" ".join(words).encode(), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def direct_classes(rows, radius=3):
    prints = [direct_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(n, seed=2):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(["Ab", "cd", "éf", "gh", "ij", "kl", "MN"]) + str(rnd.randrange(300)) for _ in range(200)) for _ in range(4)]
    rows = []
    for i in range(n):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            words[rnd.randrange(len(words))] = f"new{rnd.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_classes_against_direct(spark):
    rows = [*EDGE, *((100 + i, t) for i, t in near_copies(120))]
    got = table(simhash.classes(documents(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert got == direct_classes(rows)
    assert simhash.classes(documents(spark, rows).limit(0)).count() == 0


def random_prints(n=400, seed=5):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(n // 8)]
    values = set(base)
    for _ in range(n):
        values.add(rnd.choice(base) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) & (1 << 64) - 1)
    return sorted(v - (1 << 64) if v >> 63 else v for v in (v & (1 << 64) - 1 for v in values))


def roots(values, pairs):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_links_of_any_plan_connect_the_same(spark):
    values = random_prints()
    direct = [(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = roots(values, direct)
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    mask = lambda lo, hi: sum(1 << b for b in range(lo, hi))
    plans = [
        simhash.Plan((mask(0, 32), mask(32, 64)), (1, 1)),
        simhash.Plan((mask(0, 40), mask(40, 64)), (2, 0)),
        simhash.Plan((mask(0, 16), mask(16, 32), mask(32, 48), mask(48, 64)), (0, 0, 0, 0)),
        simhash.Plan((mask(0, 30), mask(30, 50), mask(50, 64)), (1, 1, -1)),
        simhash.make_plan(*simhash.bit_counts(prints)),
    ]
    for plan in plans:
        assert sum(plan.thresholds) == 3 - len(plan.masks) + 1
        for block in (simhash.BLOCK, 5):
            got = [(r["a"], r["b"]) for r in simhash.links(prints, plan, block=block).collect()]
            assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in got)
            assert roots(values, got) == want


def test_plan_follows_the_bits():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, 10:20] = bits[:, [10]]  # ten bits that say the same
    n, both = 50_000_000, (bits.T @ bits) * 25_000
    plan = simhash.make_plan(n, both)
    assert sum(plan.thresholds) == 3 - len(plan.masks) + 1
    assert any(all(m >> b & 1 for b in range(10, 20)) for m in plan.masks)
    skewed = np.zeros((64, 64))
    assert len(simhash.make_plan(10, skewed).masks) >= 1


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)] + [(rnd.randrange(6000, 6100), rnd.randrange(6000, 6100)) for _ in range(60)]
    got = {}
    for node, root in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(root, set()).add(node)
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert sorted(map(sorted, got.values())) == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first(spark):
    rows = [*EDGE, *((100 + i, t) for i, t in near_copies(60))]
    docs = documents(spark, rows)
    kept = simhash.keep_first(docs)
    assert kept.dtypes == docs.dtypes
    classes = {}
    for d, _, c in direct_classes(rows):
        classes.setdefault(c, []).append(d)
    want = sorted(map(str, classes))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert simhash.keep_first(docs.limit(0)).count() == 0
