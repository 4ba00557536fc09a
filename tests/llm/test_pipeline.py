import random

import corpus_pipeline as p
from lintlake.llm import decontaminate, lines, pieces, quality, simhash
from tests.llm.edge import EDGE, documents


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    prose = lambda: " ".join(word() for _ in range(rnd.randint(8, 15))) + "."
    bench = [(i, prose() + " " + prose()) for i in range(5)]
    rows = []
    for i in range(80):
        parts = [prose() for _ in range(rnd.randint(3, 6))]
        if i % 4 == 0:
            parts.insert(rnd.randrange(len(parts)), "Read more of this on our site today.")
        if i % 16 == 3:
            parts.insert(1, bench[i // 16][1])
        rows.append((i, "\n".join(parts)))
    rows += [(100 + i, rows[5][1]) for i in range(10)] + [(200, "too short"), (201, " ".join(["spam"] * 40))]
    return rows, bench


def written(spark, folder, rows, bench, clash):
    documents(spark, rows, clash).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_is_its_stages(spark, tmp_path):
    rows, bench = corpus()
    sf = written(spark, tmp_path, rows, bench, False)
    got = {r["doc_id"]: r for r in p.run(spark, sf).collect()}
    # the stages one after the other on plain rows
    left = {i: t for i, t in rows if quality_of(spark, rows)[i]}
    assert {200, 201}.isdisjoint(left)
    left = {i: "\n".join(x for x in t.split("\n") if not x.startswith("Read more of")) for i, t in left.items()}
    first = {}
    for i, t in sorted(left.items()):
        first.setdefault(simhash.fingerprint(t), i)
    left = {i: left[i] for i in first.values()}
    tests = decontaminate.Tests(bench, 5)
    left = {i: t for i, t in left.items() if all(m < 0.5 * n for _, m, n in tests.hits(t))}
    assert got.keys() == left.keys() and 5 in got and 100 not in got and 3 not in got
    for i, r in got.items():
        assert r["lossless"] and pieces.decode_ids(r["ids"]) == left[i]


def quality_of(spark, rows):
    return {r["doc_id"]: r["kept"] for r in quality.judge(documents(spark, rows)).collect()}


def test_stages_keep_columns_and_stand_edges(spark, tmp_path):
    rows, bench = corpus()
    sf = written(spark, tmp_path, [*EDGE, *rows], bench, True)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            assert out.dtypes == docs.dtypes
            out.collect()
    assert p.STAGES[-1][1](spark, docs, sf).where("NOT lossless").count() == 0
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"]
    assert lines.dedup_lines(docs).where("text IS NULL AND n_lines > 0").count() == 0
