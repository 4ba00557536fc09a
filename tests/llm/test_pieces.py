import random

import sentencepiece
from pyspark.sql import functions as F

from lintlake.llm import pieces
from tests.llm.edge import EDGE, documents

MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def texts(n=120, seed=1):
    rnd = random.Random(seed)
    parts = ["the", "Straße", "naïve", "漢字", "\U0001f600", " ", "  ", "\n", "\t", "x" * 70, "...", "▁", "<s>", "<0x41>", "don't", "12345", "\r\n", "\x00"]
    return ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def ids(text, **kw):
    import numpy as np

    return np.frombuffer(pieces.encode_texts([text], **kw)[0], "<i4").tolist()


def test_no_dropout_is_the_plain_encoding():
    for t in texts():
        if "▁" not in t:
            assert ids(t) == MODEL.encode(t), t


def plain_agenda(word, skips):
    """One chunk by looking over all pairs again after each step."""
    scores = pieces.vocabulary(pieces.MODEL).scores
    live, at, came, gone = list(word), list(range(len(word))), 0, set()
    while True:
        pairs = [(-scores[live[i] + live[i + 1]], at[i], i) for i in range(len(live) - 1) if live[i] + live[i + 1] in scores and (at[i], live[i], live[i + 1]) not in gone]
        if not pairs:
            break
        _, _, i = min(pairs)
        if came in skips:
            gone.add((at[i], live[i], live[i + 1]))
        else:
            live[i : i + 2] = [live[i] + live[i + 1]]
            del at[i + 1]
        came += 1
    vocab = pieces.vocabulary(pieces.MODEL)
    return [x for p in live for x in ([vocab.ids[p]] if p in vocab.ids else [vocab.bytes[b] for b in p.encode()])], came


def test_rows_and_heap_agree_with_a_plain_agenda():
    vocab = pieces.vocabulary(pieces.MODEL)
    import numpy as np

    chunks = sorted({c for t in texts(60, 2) for u in pieces.units(t) if (c := pieces._chunk(u))})
    assert [(np.frombuffer(b, "<i4").tolist(), n) for b, n in vocab.many(chunks)] == [plain_agenda(c, ()) for c in chunks]
    rnd = random.Random(5)
    for c in chunks:
        skips = sorted(rnd.sample(range(12), rnd.randint(1, 6)))
        assert vocab.pieces_of(c, iter(skips)) == plain_agenda(c, skips)


def test_dropout_against_a_plain_agenda_per_occurrence():
    """Every word of a text by the skips drawn for its place, remembered or not."""
    import numpy as np
    import xxhash

    for rate in (0.1, 0.5, 1.0):
        gaps = pieces.Gaps(rate)
        for t in texts(60, 4):
            want = []
            for place, u in enumerate(pieces.units(t) if t else []):
                key = (xxhash.xxh64_intdigest(t.encode(), 9) + place * 0xD6E8FEB86659FD93) % (1 << 64)
                skips = [s for s, _ in zip(gaps.skips(key), range(400), strict=False)]
                if c := pieces._chunk(u):
                    want += plain_agenda(c, set(skips))[0]
                else:
                    want += [pieces.vocabulary(pieces.MODEL).bytes[b] for b in "▁".encode()]
            assert np.frombuffer(pieces.encode_texts([t], rate=rate, seed=9)[0], "<i4").tolist() == want, t


def test_every_join_is_in_the_table_and_no_other():
    import numpy as np

    vocab = pieces.vocabulary(pieces.MODEL)
    known = sorted(vocab.number.items())
    want = {(vocab.number[p[:k]], vocab.number[p[k:]]): (vocab.scores[p], i) for p, i in vocab.ids.items() for k in range(1, len(p)) if p[:k] in vocab.number and p[k:] in vocab.number}
    best_first = {x: r for r, x in enumerate(sorted({x for x, _ in want.values()}, reverse=True))}
    left, right = np.array([*want], np.int64).T
    found = vocab._joined(left, right)
    assert list(zip((found >> pieces.RANK).tolist(), (found & pieces.JOINT).tolist(), strict=True)) == [(best_first[x], i) for x, i in want.values()]
    rnd = random.Random(8)
    others = {(rnd.choice(known)[1], rnd.choice(known)[1]) for _ in range(50_000)}.difference(want)
    others |= {(a, b) for a in (vocab.gone, vocab.gone - 1) for _, b in known} | {(b, a) for a in (vocab.gone, vocab.gone - 1) for _, b in known}
    left, right = np.array([*others], np.int64).T
    assert (vocab._joined(left, right) == pieces.NONE).all()


def test_agendas_by_rows_agree_with_the_heap_under_given_skips():
    import numpy as np

    vocab = pieces.vocabulary(pieces.MODEL)
    rnd = random.Random(11)
    words = ["▁" + "".join(rnd.choice(["er", "tion", "heit", "ñ", "ou", "st", "a", "ê", "漢", "\U0001f600"]) for _ in range(rnd.randint(0, 14))) for _ in range(9_000)]
    words[7:7] = ["", "▁", "a", "\n", "x" * pieces.LONG, "x" * (pieces.LONG + 1)]
    skips = [tuple(sorted(rnd.sample(range(30), rnd.randint(0, 6)))) for _ in words]
    for some in (skips, None):
        want = [vocab.pieces_of(w, iter(x) if some else None) for w, x in zip(words, skips, strict=True)]
        assert [(np.frombuffer(b, "<i4").tolist(), n) for b, n in vocab.many(words, some)] == want
    assert vocab.many([]) == []


def test_new_words_with_all_their_skips_cost_less_than_a_heap_each():
    """Words and paths of skips that are new to a worker are most of its work."""
    from time import process_time

    vocab = pieces.vocabulary(pieces.MODEL)
    rnd = random.Random(11)
    text = " ".join("".join(rnd.choice(["er", "tion", "heit", "ñ", "ou", "st", "a", "ê", "漢"]) for _ in range(rnd.randint(4, 7))) for _ in range(40_000))
    words = sorted({pieces._chunk(u) for u in pieces.units(text)})
    assert len(words) > 30_000
    pieces.encode_texts(["warm"], rate=0.1)
    times = []
    for _ in range(3):
        pieces._MEMORIES.clear()
        began = process_time()
        pieces.encode_texts([text], rate=0.1, seed=3)
        middle = process_time()
        for w in words:
            vocab.pieces_of(w)
        times.append((middle - began) / (process_time() - middle))
    assert min(times) < 0.75, times


def test_long_units_and_full_memories_change_nothing(monkeypatch):
    rnd = random.Random(6)
    some = [" ".join("".join(rnd.choice("abcdeé漢 ") for _ in range(rnd.randint(1, 150))) for _ in range(20)) for _ in range(12)]
    some += ["x" * 60 + " " + "x" * 60, ""]
    one = [pieces.encode_texts([t], rate=0.2, seed=4)[0] for t in some]
    assert pieces.encode_texts(some, rate=0.2, seed=4) == one
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    assert pieces.encode_texts(some, rate=0.2, seed=4) == one
    memory = pieces._MEMORIES[pieces.MODEL]
    assert not memory.unit and not memory.long and memory.came.size == 0
    assert [pieces.encode_texts([t], rate=0.2, seed=4)[0] for t in some] == one


def test_occurrences_of_a_word_vary():
    from collections import Counter

    ways = Counter()
    text = " ".join(["internationalization"] * 3000)
    found = ids(text, rate=0.1, seed=3)
    begin = {i for i, p in enumerate(MODEL.id_to_piece(list(range(MODEL.get_piece_size())))) if p.startswith("▁")}
    word = []
    for i in found:
        if i in begin and word:
            ways[tuple(word)] += 1
            word = []
        word.append(i)
    plain = tuple(MODEL.encode("internationalization"))
    assert len(ways) > 50 and ways.most_common(1)[0][0] == plain
    import numpy as np

    drawn = pieces.Gaps(0.1).draw(np.arange(20_000, dtype=np.uint64), 2)
    assert all(abs((drawn >= k).mean() - 0.9**k) < 0.015 for k in (0, 1, 5, 20))


def test_dropout_varies_by_seed_only_and_is_lossless(spark):
    rows = [*EDGE, *((100 + i, t) for i, t in enumerate(texts(60, 3)))]
    docs = documents(spark, rows).withColumn("ids", F.lit("old"))
    one = pieces.encode(docs, rate=0.3, seed=1)
    back = pieces.decode(one)
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0 and back.count() == len(rows)
    checked = pieces.encode(docs, rate=0.3, seed=1, check_col="ok")
    assert checked.columns == [*one.columns, "ok"] and checked.where("NOT ok").count() == 0
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])[:50], r["ids"] or []) for r in df.collect())
    assert key(one) == key(pieces.encode(docs.repartition(3), rate=0.3, seed=1))
    assert key(one) != key(pieces.encode(docs, rate=0.3, seed=2))
    size = lambda df: df.agg(F.sum(F.size("ids"))).first()[0]
    assert size(one) > size(pieces.encode(docs, rate=0.0))
    nulls = one.where("text IS NULL").select("ids").collect()
    assert nulls and all(r["ids"] is None for r in nulls)
    assert one.where("text = ''").first()["ids"] == []
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0
