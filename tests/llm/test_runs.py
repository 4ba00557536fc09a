import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import queries, runs
from tests.llm.edge import EDGE, documents, table


def direct(words):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            part = words[i : j + q]
            if n >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found)


def rest(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 7), st.integers(0, 40))
def test_runs_of_short_alphabets(words, period, begin):
    words = [w if i < begin else words[begin + (i - begin) % period] for i, w in enumerate(words)]
    assert runs.runs_of(words) == direct(words)


def test_squares_are_all_primitive_ones():
    rng = random.Random(8)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(60)]
        squares = runs.Squares()
        for i, w in enumerate(words):
            want = []
            for d in range(1, (i + 1) // 2 + 1):
                half = words[i - d + 1 : i + 1]
                if half == words[i - 2 * d + 1 : i - d + 1] and not any(d % p == 0 and half == half[:p] * (d // p) for p in range(1, d)):
                    want.append(d)
            assert sorted(squares.append(w)) == want


def test_long_texts_take_time_in_proportion():
    rng = random.Random(1)
    for words in (["x"] * 60_000, [rng.choice("ab") for _ in range(30_000)], list("ab" * 30_000), [f"w{i % 5000}" for i in range(60_000)]):
        found = runs.runs_of(words)
        assert sum(n for _, n, _ in found) >= 0 and all(n >= 4 * q for _, n, q in found)
    assert runs.runs_of(["x"] * 60_000) == [(0, 60_000, 1)] and found == [(0, 60_000, 5000)]


def test_documents(spark):
    rows = [*EDGE, (9, "b " + "a " * 7 + "c"), (10, "x y x y x y x y x\tz\x0bz\x0cz z z z z"), (11, "é é é é é é é"), (12, "a b\n" * 5000)]
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in runs.find_runs(documents(spark, rows)).collect()}
    want = {}
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        found = [(0, len(words), 3)] if "Word number" in (text or "") else [(0, 10_000, 2)] if doc_id == 12 else direct(words)
        want[doc_id, rest(words, found)] = found
    assert got == want
    assert runs.find_runs(documents(spark, EDGE)).count() == len(EDGE)
    assert runs.find_runs(documents(spark, EDGE).limit(0)).collect() == []


def test_drawn_periods(spark):
    import zlib

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i % 97))) for i in range(400)]
    got = dict(table(queries._with_periods(documents(spark, [*rows, *EDGE, (-7, "a b c")])), "doc_id", "text"))
    assert got[1] is None or got[1].startswith("w1x")
    changed = 0
    for doc_id, text in rows:
        words, h = text.split(), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words and doc_id > 8:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        if doc_id > 8:
            assert got[doc_id].split() == words
    assert changed > 20
