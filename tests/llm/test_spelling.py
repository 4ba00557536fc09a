import random
import zlib
from collections import Counter

import regex
from pyspark.sql import functions as F

from lintlake.llm import spelling
from tests.llm.edge import CLASHES, EDGE, documents, table


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def direct(rows, least_length=6, least_n=5):
    n = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}
    near = {w: sorted((v for v in n if one_apart(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: near[w][0] for w in n if near[w] and n[near[w][0]] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdéÀ×") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 30, 200])
        for _ in range(6):
            i = rng.randrange(len(w))
            other = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i:], w[:i] + rng.choice("abcdé") + w[i + 1 :]])
            words += [other.upper() if other.isascii() else other] * rng.choice([1, 5, 7, 26])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::300])) for i in range(300)]
    want = direct(rows)
    assert sum(w[1] is not None for w in want) > 20
    docs = documents(spark, rows)
    assert table(spelling.variants(docs), *COLUMNS) == want
    # other groups and parts of a few words give the same
    assert table(spelling.variants(docs, groups=3, part_words=7), *COLUMNS) == want


def test_long_words_and_ways(spark):
    long = "abcdefghij" * 300
    texts = [long] * 5 + [long[:-1]] * 30 + ["kettle"] * 5 + ["kettles"] * 25 + ["kettless"] * 125 + ["kettlesse"] * 625
    rows = [(None, " ".join(texts))]
    got = table(spelling.variants(documents(spark, rows)), *COLUMNS)
    assert got == direct(rows)
    assert [r[2] for r in got if r[0] == "kettle"] == ["kettlesse"]


def test_edges(spark):
    docs = documents(spark, EDGE)
    assert table(spelling.variants(docs), *COLUMNS) == direct(EDGE)
    assert spelling.variants(docs.limit(0)).columns == list(COLUMNS) and spelling.variants(docs.limit(0)).count() == 0
    assert table(spelling.variants(documents(spark, [(1, None), (2, "")])), *COLUMNS) == []
    assert table(spelling.variants(docs.withColumns({c: F.lit("x") for c in (*CLASHES, "word", "n", "cell", "part")})), *COLUMNS) == direct(EDGE)
