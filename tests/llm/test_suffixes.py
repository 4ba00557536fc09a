import hashlib
import random

import numpy as np
import pytest

from lintlake.llm import suffixes
from tests.llm.edge import EDGE, documents, table


def direct(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for n, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((n, p))
    marked = [np.zeros(len(b) + 1, int) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for n, p in places:
                marked[n][p : p + length] = 1
    out = []
    for (i, _), b, m in zip(rows, texts, marked, strict=True):
        kept = bytes(x for x, gone in zip(b, m, strict=False) if not gone)
        out.append((i, len(b), int(m.sum()), int((np.diff(m, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mixed(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    base = [text(120) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        b = rnd.choice(base)
        at = rnd.randrange(0, len(b) - 100)
        if kind < 0.1:
            t = b
        elif kind < 0.5:
            t = text(rnd.randint(0, 30)) + b[at : at + rnd.choice([150, 198, 199, 200, 201, 202, 230, 400])] + text(rnd.randint(0, 30))
        elif kind < 0.6:
            t = "ab" * rnd.randint(50, 200)
        elif kind < 0.65:
            t = rnd.choice(["a" * 199, "a" * 200, "a" * 201, "b" * 200])
        elif kind < 0.7:
            x = text(50)
            t = x + " " + x
        else:
            t = text(rnd.randint(1, 90))
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("shape", [{}, {"hot": 3}, {"gram": 150, "band": 20, "hot": 1}, {"length": 60, "gram": 20}])
def test_against_direct(spark, shape):
    rows = mixed(110, len(shape)) + [r for r in EDGE if r[1] is None or len(r[1]) < 9999]
    rows += rows[:4]
    got = table(suffixes.remove_repeats(documents(spark, rows), with_text=False, **shape), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == direct(rows, shape.get("length", 200))


def test_long_texts_and_kept_bytes(spark, monkeypatch):
    rnd = random.Random(6)
    long = "".join(chr(97 + rnd.randrange(26)) for _ in range(1_300_000))
    rows = [(1, long), (2, "xyz" + long[1_048_300:1_048_800] + "zyx"), (3, long[5:204])]
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(documents(spark, rows)).collect()}
    assert bytes(got[2]["kept"]) == b"xyzzyx"
    assert got[1]["n_removed"] == 500 and [tuple(s) for s in got[1]["spans"]] == [(1_048_300, 1_048_800)]
    assert got[3]["n_removed"] == 0
    assert suffixes.remove_repeats(documents(spark, rows).limit(0)).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    rnd = random.Random(1)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted("".join(rnd.choice("ab") for _ in range(rnd.randrange(9))).encode() for _ in range(rnd.randrange(12))) for _ in range(k)]

        def coded(run):
            last = b""
            for s in run:
                yield suffixes.mismatch(last, s, 0), s
                last = s

        out = [(shared, row[1]) for shared, row, _ in suffixes.merged([coded(r) for r in runs])]
        assert [s for _, s in out] == sorted(s for r in runs for s in r)
        assert all(shared == suffixes.mismatch(a, b, 0) for (_, a), (shared, b) in zip(out, out[1:], strict=False))
