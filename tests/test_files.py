"""Listing and reading source files, empty and unreadable ones included."""

import pytest

from lintlake.sources import files as S
from lintlake.sources import storage


def test_empty_files_count_and_come_with_empty_text(spark, tmp_path):
    for name, text in {"r1/pkg/__init__.py": "", "r1/a b%20c.py": "x = 1\n", "r1/m.go": "", "r2/a.py": "y\n", "r2/n.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    listed = S.list_source_files(spark, str(tmp_path))
    assert sorted((r["repo"], r["path"], r["ext"], r["size"]) for r in listed.collect()) == [
        ("r1", "a b%20c.py", ".py", 6), ("r1", "m.go", ".go", 0), ("r1", "pkg/__init__.py", ".py", 0), ("r2", "a.py", ".py", 2),
    ]
    read = S.read_source_files(spark, str(tmp_path))
    got = {(r["repo"], r["path"]): r["content"] for r in read.collect()}
    assert got == {("r1", "a b%20c.py"): "x = 1\n", ("r1", "m.go"): "", ("r1", "pkg/__init__.py"): "", ("r2", "a.py"): "y\n"}
    counts = [(r["repo"], r["language"], r["file_count"]) for r in S.detect_languages(listed).collect()]
    assert counts == [("r1", "python", 2), ("r1", "go", 1), ("r2", "python", 1)]
    left = S.unread_files(listed, read.filter("path <> 'a.py'")).collect()
    assert [(r["repo"], r["path"], r["size"]) for r in left] == [("r2", "a.py", 2)]


def test_no_local_folder_off_local_masters(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_checkouts_are_written_by_many_tasks(spark, tmp_path):
    texts = {("r1", "a.py"): "x = 1\n", ("r1", "pkg/b.py"): "", ("r2", "a.py"): "\u00e9\n"}
    rows = [(*key, text) for key, text in texts.items()] + [("r3", f"{i % 7}/{i}.py", "y\n" * (i % 5)) for i in range(500)]
    src = spark.createDataFrame([*rows, ("r4", "none.py", None)], "repo string, path string, content string")
    S.write_source_files(src, str(tmp_path))
    read = S.read_source_files(spark, str(tmp_path))
    got = {(r["repo"], r["path"]): r["content"] for r in read.collect()}
    assert got == {(r, p): t for r, p, t in rows} | {("r4", "none.py"): ""}


def test_the_query_spreads_a_repository(spark, tmp_path):
    """One repository of many documents, some twice, without id or text: every row is a file."""
    from harness.queries import QUERIES

    rows = [(i % 40, f"text {i % 40}", "one") for i in range(80)] + [(None, None, None), (None, "x", "a/b"), (7, "", "one")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["read_source_files"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r["repo"] for r in got} == {"one", "a%2Fb", "__HIVE_DEFAULT_PARTITION__"}
    assert sorted(r["chars"] for r in got if r["repo"] != "one") == [0, 1]
