"""What counts as recurring: different documents, whatever stands around the line."""

import random

from lintlake.llm import lines
from tests.llm.edge import documents


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def texts_of(got):
    return {r["doc_id"]: r["text"] for r in got.collect()}


def test_passages_footers_and_blank_lines_recur(spark):
    rnd = random.Random(5)
    passage = [f"Passage line {w} goes on and on" for w in ("alpha", "beta", "gamma", "delta", "omega")]
    footer = "All rights of this page are reserved"
    rows = []
    for i in range(20):
        own = [words(rnd, 30), words(rnd, 40)]
        rows.append((i, "\n".join([own[0], *passage, own[1]])))
        rows.append((100 + i, "\n\n".join([words(rnd, 30), words(rnd, 30), footer])))
        rows.append((200 + i, "\n\n".join([words(rnd, 30), "Sign up for the weekly letter", words(rnd, 30)])))
    got = texts_of(lines.dedup_lines(documents(spark, rows)))
    assert not any(b in t for t in got.values() for b in (*passage, footer, "Sign up for"))
    for i, t in rows:
        rest = [x for x in t.split("\n") if x not in (*passage, footer) and not x.startswith("Sign up")]
        assert got[i].split("\n") == rest


def test_copies_are_one_document(spark):
    rnd = random.Random(6)
    body = [words(rnd, 25) for _ in range(8)]
    one_line = words(rnd, 120).split()
    rows = []
    for i in range(300):
        parts = list(body)
        parts[i % 8] = parts[i % 8] + f" {words(rnd, 2)}"
        rows.append((i, "\n".join(parts)))  # near copies, each changed by itself
        own = list(one_line)
        own[rnd.randrange(120)] = words(rnd, 1)
        rows.append((1000 + i, " ".join(own)))
        rows.append((2000 + i, "\n".join([*body, "the same end of all of these"])))
    got = texts_of(lines.dedup_lines(documents(spark, rows)))
    assert got == dict(rows)


def test_long_lines_recur_in_two_documents(spark):
    rnd = random.Random(7)
    long, short = words(rnd, 60), words(rnd, 20)
    rows = [(i, "\n".join([words(rnd, 200), long, short, words(rnd, 150)])) for i in range(2)]
    rows += [(10 + i, "\n".join([words(rnd, 30), words(rnd, 70)])) for i in range(2)] + [(20, rows[0][1])]
    rows += [(30 + i, "\n".join(["\n".join(["own " + long] * 3), words(rnd, 5)])) for i in range(1)]
    got = texts_of(lines.dedup_lines(documents(spark, rows)))
    for i, t in rows:
        assert got[i] == "\n".join(x for x in t.split("\n") if x != long)


def test_one_large_group_of_copies_raises_no_bar(spark):
    rnd = random.Random(8)
    hot = "This line is in many copies and elsewhere"
    copied = "\n".join([words(rnd, 40), hot, words(rnd, 40)])
    rows = [(i, f"{copied} {i}") for i in range(400)] + [(1000 + i, "\n".join([words(rnd, 40), hot, words(rnd, 30)])) for i in range(12)]
    got = texts_of(lines.dedup_lines(documents(spark, rows)))
    assert not any(hot in t for t in got.values())
    assert all(len(t.split("\n")) == 2 for t in got.values())
