import base64
import gzip
import hashlib
import random
from pathlib import Path

from pyspark.sql import functions as F

from lintlake.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "size", "record", "last_id")})


def rows_of(n=120, seed=1):
    rnd = random.Random(seed)
    some = ["", None, "<p>same</p>", "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx", "x" * 300_000, "\U0001f600\x00"]
    return [(i, rnd.choice([None, "", f"http://a.com/{i}", "http://a\r\nX: y"]), rnd.choice([*some, f"<p>{rnd.random()}</p>"])) for i in range(n)]


def direct(rows, least=0):
    last, out = {}, []
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    for i, _, h in rows:
        body = (h or "").encode()
        at = last[h or ""] if len(body) >= least else i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if at == i else "revisit", None if at == i else at))
    return sorted(out)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark, tmp_path):
    rows = rows_of()
    for least in (0, 12):
        folder = warc.write_archives(pages(spark, rows).repartition(5), f"{tmp_path}/{least}", least, archive_bytes=2_000)
        back = warc.read_records(spark, folder, gap=10, chunk=1_000)
        assert sorted(tuple(r) for r in back.select(*COLUMNS).collect()) == direct(rows, least)
        bodies = {i: h or "" for i, _, h in rows}
        assert all(r["payload"] == bodies[r["page_id"]] for r in back.where("record_type = 'response'").collect())
    one = next(Path(f"{folder}/warc").iterdir())
    assert gzip.decompress(one.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_selected_ranges_are_joined(spark, tmp_path):
    folder = warc.write_archives(pages(spark, rows_of(60)).coalesce(1), str(tmp_path))
    table = spark.read.parquet(f"{folder}/index")
    some = table.where("page_id % 7 = 0")
    got = sorted(r["page_id"] for r in warc.read_records(spark, folder, some).collect())
    assert got == list(range(0, 60, 7))
    spans = [(r["start"], r["stop"]) for r in warc.ranges(table).collect()]
    assert len(spans) == 1 and spans[0][0] == 0
    apart = warc.ranges(some, gap=0).collect()
    assert sum(len(r["parts"]) for r in apart) == len(got)


def test_edges(spark, tmp_path):
    rows = [(None, None, None), (None, "u", ""), (1, None, "<p>"), (1, None, "<p>"), (2, "u", "<p>"), (3, None, None)]
    folder = warc.write_archives(pages(spark, rows), f"{tmp_path}/a")
    got = sorted((tuple(r) for r in warc.read_records(spark, folder).select("page_id", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(None, "revisit", 3), (None, "revisit", 3), (1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "response", None)], key=str)
    empty = warc.write_archives(pages(spark, rows).limit(0), f"{tmp_path}/b")
    assert warc.read_records(spark, empty).count() == 0


def test_ranges_are_dealt_over_tasks(spark, tmp_path):
    folder = warc.write_archives(pages(spark, rows_of(200)).repartition(16), str(tmp_path))
    tasks = warc.read_records(spark, folder, gap=10, chunk=1_000).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 4
