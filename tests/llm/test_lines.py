import random
import re
from collections import Counter, defaultdict

from lintlake.llm import lines
from tests.llm.edge import EDGE, documents


def tokens(text):
    parts = [re.sub(r"[^\x20\t-\r]*[0-9][^\x20\t-\r]*", "<*>", x) for x in text.split("\n")]
    return [re.split(r"[\x20\t-\r]+", re.sub(r"^[\x20\t-\r]+|[\x20\t-\r]+$", "", p)) for p in parts]


def shapes(text, depth=2, least=4, constant=5):
    """Per line its templates as tuples, by hand."""
    for i, t in enumerate(tokens(text)):
        n = len(t)
        if n < least:
            continue
        half, third = n // 2, n // 3
        ways = [("full", n, *t)]
        if half >= constant or 2 * third >= constant:
            ways += [("tail", n, *t[: n - half]), ("front", n, *t[:depth], "/", *t[half:])]
        if 2 * third >= constant:
            ways.append(("middle", n, *t[:third], "/", *t[n - third :]))
        yield i, ways


def folded(texts, least=0.6):
    """Each text's class: texts that share most of their shingles, and so on."""
    def shingles(text):
        t = [x for line in tokens(text) for x in line if x]
        return {tuple(t[i : i + 3]) for i in range(len(t))}

    texts, root = sorted(texts), {}
    grams = {t: shingles(t) for t in texts}
    for t in texts:
        near = [u for u in root if grams[t] and len(grams[t] & grams[u]) >= least * len(grams[t] | grams[u])]
        old = {root[u] for u in near}
        root[t] = t
        root.update({u: t for u in root if root[u] in old})
    return root


def direct(rows, least_places=10):
    """What the operator does, with exact similarities for its sketches."""
    root = folded({t for _, t in rows if t is not None})
    places = defaultdict(set)
    for _, t in rows:
        for _, ways in shapes(t) if t is not None else ():
            for w in ways:
                places[w].add(root[t])
    hot = {w for w, p in places.items() if len(p) >= (2 if w[0] == "full" and w[1] >= 50 else least_places)}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        gone = {i for i, ways in shapes(t) if hot.intersection(ways)}
        parts = t.split("\n")
        out.append((d, "\n".join(x for i, x in enumerate(parts) if i not in gone), len(parts), len(gone)))
    return sorted(out, key=str)


def corpus(n=150, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    prose = lambda: " ".join(word() for _ in range(rnd.randint(1, 14))) + "."
    copied = [prose() for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [prose() for _ in range(rnd.randint(1, 6))]
        kind = rnd.random()
        if kind < 0.3:
            parts = list(copied)  # copies, some of them changed a little
            if rnd.random() < 0.3:
                k = rnd.randrange(len(parts))
                parts[k] = parts[k] + " more"
        if rnd.random() < 0.25:
            parts.insert(rnd.randrange(len(parts) + 1), f"Posted on {rnd.randrange(1, 29)} May by user{i}")
        if rnd.random() < 0.25:
            parts.insert(rnd.randrange(len(parts) + 1), f"Read the whole story of {word()} {word()} {word()} {word()} {word()}"[:90])
        if rnd.random() < 0.2:
            parts.append("Yes no.")
        rows.append((i, "\n".join(parts)))
    return rows


def test_against_direct(spark):
    rows = [*corpus(), *((1000 + (i or 0), t) for i, t in EDGE)]
    passage = " ".join(f"long{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    other = ("".join(random.Random(i).choices("ijklm", k=5)) for i in range(900))
    # other white space, and a passage that stands in two different documents
    rows += [(2000 + i, " ".join(next(other) for _ in range(120)) + f"\n{passage}\n" + "\t \x0b".join(next(other) for _ in range(90))) for i in range(2)]
    rows += [(3000 + i, " ".join(next(other) for _ in range(20)) + "\n\t the\x0bsame \r footer\x0c of\tour pages \n\n") for i in range(12)]
    assert {r[3] for r in direct(rows) if r[0] >= 2000 and r[0] != 2002} == {1}
    got = lines.dedup_lines(documents(spark, rows))
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == direct(rows)


def test_what_goes_and_what_stays(spark):
    rows = corpus()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert not any("Posted on" in t or "Read the whole" in t for t in got.values())
    assert any("Yes no." in t for t in got.values())
    copied = Counter(x for _, t in rows for x in t.split("\n"))
    body = next(x for x, c in copied.most_common() if c > 20 and len(x.split()) > 4 and not x.startswith(("Posted", "Read")))
    assert sum(body in t for t in got.values()) == sum(body in t for _, t in rows)


def test_edges(spark):
    docs = documents(spark, EDGE)
    got = lines.dedup_lines(docs)
    assert [c for c, _ in got.dtypes] == [*docs.columns, "n_lines", "n_dropped"]
    assert got.count() == len(EDGE)
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(t) for _, t in EDGE)
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    again = lines.dedup_lines(got)
    assert again.columns == got.columns
