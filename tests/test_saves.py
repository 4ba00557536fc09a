import random
import time

import pytest
from pyspark.sql import functions as F

from lintlake.streaming import saves as ST

SCHEMA = "repo string, uri string, ts timestamp, content string"


def events(rows):
    """Rows of (file, seconds, content)."""
    return [("r", f, s, c) for f, s, c in rows]


def frame(spark, rows):
    return spark.createDataFrame(events(rows), "repo string, uri string, s double, content string").select(
        "repo", "uri", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "content"
    )


def bursts_of(spark, folder, batches, **kw):
    """The stream's bursts if its saves come in these batches, and those still open."""
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = ST.debounce_saves(stream, **kw)
    ST.start_available(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")).awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{folder}/out")
    return done, ST.open_bursts(spark, f"{folder}/state")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_one_burst_in_three_batches(spark, tmp_path):
    done, still = bursts_of(spark, str(tmp_path), [[("a", 10.0, "1"), ("a", 10.2, "2")], [("a", 10.4, "3"), ("a", 10.6, "4")], [("a", 10.9, "5"), ("a", 11.3, "6")]])
    assert done.count() == 0
    assert [(r.content, r.saves) for r in still.collect()] == [("6", 6)]


def test_any_cut_equals_the_table(spark, tmp_path):
    rnd = random.Random(7)
    rows, at = [], {f: 100.0 for f in "abcd"}
    for i in range(160):
        f = rnd.choice("aaabcd")
        at[f] += rnd.choice([0.1, 0.3, 0.499, 0.5, 0.9, 3.0])
        rows.append((f, at[f], str(i)))
    cuts = sorted(rnd.sample(range(1, 160), 2))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 160], strict=True)]
    for b in batches:
        rnd.shuffle(b)
    done, still = bursts_of(spark, str(tmp_path), batches)
    assert rows_of(done.unionByName(still)) == rows_of(ST.debounce_saves(frame(spark, rows)))
    assert done.count() > 20 and still.count() == 4


def test_late_saves(spark, tmp_path):
    batches = [[("a", 10.0, "1"), ("a", 12.0, "3")], [("a", 10.3, "2"), ("a", 11.8, "x")], [("a", 30.0, "9")]]
    every = [r for b in batches for r in b]
    done, still = bursts_of(spark, str(tmp_path / "1"), batches, late="5 seconds")
    assert rows_of(done.unionByName(still)) == rows_of(ST.debounce_saves(frame(spark, every)))
    done, still = bursts_of(spark, str(tmp_path / "2"), batches)
    got = done.unionByName(still)
    # what is late beyond that is a burst of its own
    assert sorted((r.content, r.saves) for r in got.collect()) == [("1", 1), ("2", 1), ("3", 2), ("9", 1)]


def test_a_hot_file_is_folded_before_the_shuffle():
    import pyarrow as pa

    n = 30_000
    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * n, "uri": [None] * n, "first": list(range(n)), "last": list(range(n)), "content": ["x"] * (n - 1) + ["y"], "saves": [1] * n})
    out = list(ST._folder(10)(iter([batch])))
    assert [b.to_pylist() for b in out] == [[{"repo": "r", "uri": None, "first": 0, "last": n - 1, "content": "y", "saves": n}]]


def test_saves_are_folded_over_arrow_batches():
    import pyarrow as pa

    def batch(i):
        return pa.RecordBatch.from_pydict({"repo": ["r", "r"], "uri": ["a", "b"], "first": [i, i], "last": [i, i], "content": [str(i), None], "saves": [1, 1]})

    out = [r for b in ST._folder(10)(batch(i) for i in range(256)) for r in b.to_pylist()]
    assert [(r["uri"], r["content"], r["saves"]) for r in out] == [("a", "255", 256), ("b", None, 256)]


class _State:
    """What Spark keeps of a group, with a clock set by hand."""

    def __init__(self, now):
        self.now, self.get, self.exists, self.hasTimedOut, self.timeout = now, None, False, False, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, rows):
        self.get, self.exists = rows, True

    def remove(self):
        self.get, self.exists, self.timeout = None, False, None

    def setTimeoutDuration(self, ms):
        self.timeout = self.now + ms


def test_files_of_a_group_end_one_by_one():
    import pandas as pd

    def saves(*rows):
        return iter([pd.DataFrame([(r, u, t, t, c, 1) for r, u, t, c in rows], columns=["repo", "uri", "first", "last", "content", "saves"])])

    run, state = ST._bursts(500_000, 60_000_000, 0), _State(1_000)
    out = lambda frames: [tuple(r) for f in run((7,), frames, state) for r in f.itertuples(index=False)]
    # the saves of a are of now, those of the null file are old, so it waits for the quiet time
    assert out(saves((None, None, 5, None), ("r", "a", 900_000, "1"))) == []
    assert state.timeout == 1_400
    state.now = 1_300
    assert out(saves(("r", "a", 1_250_000, "2"))) == [] and state.timeout == 1_750
    state.now, state.hasTimedOut = 1_751, True
    assert out(iter(())) == [("r", "a", 900_000, 1_250_000, "2", 2)] and state.timeout == 61_000
    state.now, state.hasTimedOut = 61_001, False
    # one file is over as saves of another come in
    assert out(saves(("r", "b", 61_000_000, "3"))) == [(None, None, 5, 5, None, 1)] and state.timeout == 61_500
    state.now, state.hasTimedOut = 61_600, True
    assert out(iter(())) == [("r", "b", 61_000_000, 61_000_000, "3", 1)] and not state.exists


def test_a_call_for_many_files(spark, tmp_path):
    rows = [(f"f{i}", 10.0 + 0.2 * (j % 2) + 5 * (j // 2), f"{i}.{j}") for i in range(9000) for j in range(4)]
    batches = [rows[:: 2], rows[1 :: 2]]
    done, still = bursts_of(spark, str(tmp_path), batches, late="1 minute")
    assert done.count() == 0 and still.count() == 18_000
    assert rows_of(still) == rows_of(ST.debounce_saves(frame(spark, rows)))
    groups = spark.read.format("statestore").load(f"{tmp_path}/state").count()
    assert groups <= ST.FILE_GROUPS < 9000


def test_the_newest_burst_ends_by_the_clock(spark, tmp_path):
    frame(spark, [("a", 10.0, "1"), ("a", 10.2, "2")]).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set(*ST.STATE_STORE)
    try:
        out = ST.debounce_saves(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), quiet="100 milliseconds")
        stream = out.writeStream.format("memory").queryName("ended_by_clock").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="100 milliseconds").start()
        until = time.time() + 90
        while time.time() < until and spark.table("ended_by_clock").count() == 0:
            time.sleep(0.5)
        stream.stop()
    finally:
        spark.conf.unset(ST.STATE_STORE[0])
    assert [(r.content, r.saves) for r in spark.table("ended_by_clock").collect()] == [("2", 2)]


def test_runs_never_share_a_number(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = lambda f, x: spark.createDataFrame([("r", f, 1.0, x)], "repo string, uri string, ts double, content string").withColumn("ts", F.timestamp_seconds("ts"))
    a, b = ST.log_writer(path, "info", 0.0, run="a"), ST.log_writer(path, "info", 0.0, run="b")
    a(batch("x.py", "eval(1)"), 0)
    b(batch("y.py", "eval(1)"), 0)
    a(batch("z.py", "eval(1)"), 1)
    b(batch("x.py", "y = 1"), 1)
    shown = lambda: sorted((r.file, r.rule_id) for r in ST.latest_findings(spark.read.parquet(f"{path}/findings"), spark.read.parquet(f"{path}/scans")).collect())
    assert shown() == [("y.py", "python/eval-usage"), ("z.py", "python/eval-usage")]
    ST.clear_findings(spark.createDataFrame([("r",)], "repo string"), path)
    b(batch("x.py", "y = 1"), 1)  # a batch that runs again leaves the clear
    assert shown() == []
    a(batch("z.py", "eval(2)"), 2)
    assert shown() == [("z.py", "python/eval-usage")]
    assert spark.read.parquet(f"{path}/claims").count() == 6


@pytest.mark.parametrize("gap", [1, 5])
def test_fold_is_the_same_in_any_order(gap):
    rnd = random.Random(gap)
    for _ in range(200):
        parts = [(t, t, str(t), 1) for t in rnd.sample(range(60), rnd.randint(1, 20))]
        want = ST._fold(parts, gap)
        rnd.shuffle(parts)
        k = rnd.randint(0, len(parts))
        assert ST._fold(ST._fold(parts[:k], gap) + ST._fold(parts[k:], gap), gap) == want
