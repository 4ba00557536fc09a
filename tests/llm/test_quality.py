import random
import re

from pyspark.sql import functions as F

from lintlake.llm import quality
from tests.llm.edge import EDGE, LONG, documents, table


def direct(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 5)}
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words), dup, len(covered)


def texts(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rnd.choice(["the", "a", "été", "x*", "UP", "b|c", "\x1f\x85", "d e"]) for _ in range(rnd.randint(0, 60))]
        out.append("".join(w + rnd.choice([" ", "  ", "\n", "\t", "\n\n", "\x0b"]) for w in words))
    return out


def test_measures_against_direct(spark):
    rows = [*enumerate(texts(80)), *((100 + i, t) for i, (_, t) in enumerate(EDGE) if t != LONG)]
    got = table(quality.measures(documents(spark, rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *direct(t)) for i, t in rows), key=str)


def test_base_and_repeats(spark):
    rows = [(1, "one two three four five six seven eight nine"), (2, " ".join("abcdefghij")), (3, " ".join("abcde" * 2) + " " + " ".join(f"w{i}" for i in range(40))), (4, " ".join("abcde" * 2) + " " + " ".join(f"w{i}" for i in range(39)))]
    got = dict(table(quality.judge(documents(spark, rows)), "doc_id", "base_failed"))
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_model_finds_the_odd_class(spark):
    rnd = random.Random(3)
    good = [(i, " ".join(rnd.choice(["river", "stone", "light", "under", "slowly"]) + str(rnd.random())[2:5] * 0 + chr(97 + rnd.randrange(26)) for _ in range(80)) + ".") for i in range(200)]
    bad = [(1000 + i, " ".join(f"{chr(97 + rnd.randrange(26))}x{rnd.randrange(999)}###$$$" for _ in range(80)) + ".") for i in range(20)]
    kept = dict(table(quality.judge(documents(spark, good + bad)), "doc_id", "kept"))
    assert sum(kept[i] for i, _ in good) >= 195
    assert not any(kept[i] for i, _ in bad)


def test_edges_and_filter(spark):
    docs = documents(spark, [*EDGE, *enumerate(texts(30), 100)])
    judged = quality.judge(docs)
    assert judged.count() == docs.count()
    kept = quality.keep_good(docs)
    assert kept.dtypes == docs.dtypes
    want = sorted(map(str, (r["doc_id"] for r in judged.where("kept").collect())))
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == want
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_posterior_is_of_the_votes(spark):
    rules = (quality.Rule("short", F.col("n_words") < 12, F.col("n_words") > 20), quality.Rule("never", F.lit(False), F.lit(False)))
    judged = quality.judge(documents(spark, enumerate(texts(60, 9))), rules)
    by_votes = {}
    for r in judged.collect():
        assert 0 <= r["p_good"] <= 1 and r["vote_never"] == 0
        by_votes.setdefault(r["vote_short"], set()).add(round(r["p_good"], 9))
    assert all(len(p) == 1 for p in by_votes.values())
