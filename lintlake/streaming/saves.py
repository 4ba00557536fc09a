"""Save events of an editor as a stream: debounce, scan, keep the latest findings."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lintlake.functions.severity import severity_rank
from lintlake.model import FINDING_COLUMNS
from lintlake.operators.findings import filter_editor
from lintlake.plans.scan import Relations, scan
from lintlake.sources.files import language_column

# Quiet time before a save is scanned, and the editor's settings.
DEBOUNCE = "500 milliseconds"
EDITOR_DEFAULTS = {
    "enabled": "true",
    "scanOnOpen": "true",
    "severityThreshold": "medium",
    "confidenceThreshold": "0.7",
}


#: How long the clock has to stand still for a file whose saves are old, as in a backlog.
QUIET = "1 minute"
# Where Spark keeps the state of such streams.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)

BURSTS = "repo string, uri string, ts timestamp, content string, saves long"
_PART = "first long, last long, content string, saves long"
_FACTS = ("first", "last", "content", "saves")
_OPEN = "repo array<string>, uri array<string>, due array<long>, first array<long>, last array<long>, content array<string>, saves array<long>"
#: Files share state by groups, as a call for each file costs more than its saves. A batch reads and
#: writes the open bursts of the groups that it has saves of.
FILE_GROUPS = 4096
#: So many saves or bytes are folded at once before the shuffle.
FOLD_ROWS, FOLD_BYTES = 100_000, 32 << 20


def debounce_saves(saves: DataFrame, gap: str = DEBOUNCE, quiet: str = QUIET, late: str = "0 seconds") -> DataFrame:
    """The last save of each burst: ``(repo, uri, ts, content, saves)``.

    A burst of a file ends with more than ``gap`` without a save, by the times of the saves; rows without
    a time are left out. On a table it is a session window.

    On a stream the bursts of a file are state, and come out the same however the saves are cut
    into batches, as long as a file's saves do not come in more than ``late`` out of order; one
    that does is a burst of its own, none is dropped. A burst is emitted when a save shows that
    it is over (by ``late`` more). Only the newest burst of a file needs a timer on the clock:
    it fires at the end of its gap, or, where that is past because the saves are old, when the
    file has been silent for ``quiet``. Rows are folded into bursts before the shuffle and as
    they come in after it, so a file takes as much memory as it has open bursts. Files share
    state by :data:`FILE_GROUPS` groups, so memory is that of the open bursts of a group. The
    stream needs the state store that ``start_available`` sets.
    """
    saves = saves.withColumn("ts", F.col("ts").cast("timestamp"))
    if saves.isStreaming:
        spark = saves.sparkSession
        micros = [spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {x})").first()[0] for x in (gap, quiet, late)]
        us = F.unix_micros("ts")
        parts = saves.filter("ts IS NOT NULL").select("repo", "uri", us.alias("first"), us.alias("last"), "content", F.lit(1).cast("long").alias("saves"))
        folded = parts.mapInArrow(_folder(micros[0]), parts.schema)
        grouped = folded.withColumn("group", F.pmod(F.xxhash64("repo", "uri"), F.lit(FILE_GROUPS))).groupBy("group")
        bursts = grouped.applyInPandasWithState(
            _bursts(*micros), f"repo string, uri string, {_PART}", _OPEN, "append", "ProcessingTimeTimeout"
        )
        return bursts.select("repo", "uri", F.timestamp_micros("last").alias("ts"), "content", "saves")
    return (
        saves.groupBy(F.session_window("ts", gap).alias("burst"), "repo", "uri")
        .agg(
            F.max("ts").alias("last_ts"),
            F.max_by("content", "ts").alias("content"),
            F.count("*").alias("saves"),
        )
        .select("repo", "uri", F.col("last_ts").alias("ts"), "content", "saves")
    )


def open_bursts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The bursts that a stopped stream of ``debounce_saves`` has not emitted yet."""
    state = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    held = state.select(F.inline(F.arrays_zip("repo", "uri", *_FACTS)))
    return held.select("repo", "uri", F.timestamp_micros("last").alias("ts"), "content", "saves")


def _fold(parts: list[tuple], gap: int) -> list[tuple]:
    """Parts ``(first, last, content, saves)`` of one file joined where no more than ``gap`` lies
    between them, in order."""
    out: list[tuple] = []
    for part in sorted(parts, key=lambda p: p[:2]):
        if out and part[0] - out[-1][1] <= gap:
            held = out[-1]
            newer = part if part[1] >= held[1] else held
            out[-1] = (held[0], newer[1], newer[2], held[3] + part[3])
        else:
            out.append(part)
    return out


def _folder(gap: int):
    def fold(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        schema = held[0].schema
        files: dict[tuple, list] = {}
        for batch in held:
            for repo, uri, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files.setdefault((repo, uri), []).append(tuple(part))
        rows = [(*key, *burst) for key, parts in files.items() for burst in _fold(parts, gap)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FOLD_ROWS or sum(b.nbytes for b in held) >= FOLD_BYTES:
                yield fold(held)
                held = []
        if held:
            yield fold(held)

    return run


def _bursts(gap: int, quiet: int, late: int):
    """Bursts that may still grow are the state of a group of files, each with the time when its
    file is over; times in microseconds. State and timeout come and go with the rows of a group,
    and the timeout is that of its file that is over first."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() * 1000
        files: dict[tuple, list] = {}
        due: dict[tuple, int] = {}
        for *file, end, part in _rows_of_state(state):
            files.setdefault(tuple(file), []).append(part)
            due[tuple(file)] = end
        come: dict[tuple, list] = {}
        for frame in () if state.hasTimedOut else frames:
            for repo, uri, *part in zip(*(frame[c].tolist() for c in ("repo", "uri", *_FACTS)), strict=True):
                come.setdefault((repo, uri), []).append(tuple(part))
            come = {file: _fold(parts, gap) for file, parts in come.items()}
        over: list[tuple] = []
        for file, parts in come.items():
            held = _fold([*files.get(file, ()), *parts], gap)
            newest = held[-1][1]
            ended = [b for b in held[:-1] if b[1] + gap + late < newest]
            over += [(*file, *b) for b in ended]
            files[file] = held[len(ended) :]
            end = newest + gap + late
            due[file] = end if end > now else now + quiet
        for file in [f for f, end in due.items() if end <= now]:
            over += [(*file, *b) for b in files.pop(file)]
            del due[file]
        if files:
            held = [(*file, due[file], *b) for file, bursts in files.items() for b in bursts]
            state.update(tuple(map(list, zip(*held, strict=True))))
            state.setTimeoutDuration(-(-(min(due.values()) - now) // 1000))
        elif state.exists:
            state.remove()
        if over:
            yield pd.DataFrame(dict(zip(("repo", "uri", *_FACTS), map(list, zip(*over, strict=True)), strict=True)))

    return run


def _rows_of_state(state: GroupState) -> Iterator[tuple]:
    if state.exists:
        for *file, end, first, last, content, saves in zip(*state.get, strict=True):
            yield *file, end, (first, last, content, saves)


def newest_config(config_log: DataFrame) -> DataFrame:
    """One row per repository; each key has its newest value, else the default."""
    return config_log.groupBy("repo").agg(
        *[
            F.coalesce(
                F.max_by("value", F.when(F.col("key") == key, F.col("ts"))), F.lit(default)
            ).alias(key)
            for key, default in EDITOR_DEFAULTS.items()
        ]
    )


def apply_config(events: DataFrame, config_log: DataFrame) -> DataFrame:
    """Add the settings of each event's repository and drop events while switched off."""
    joined = events.join(newest_config(config_log), "repo", "left")
    for key, default in EDITOR_DEFAULTS.items():
        joined = joined.withColumn(key, F.coalesce(key, F.lit(default)))
    return joined.filter(F.col("enabled") == "true")


def saved_sources(saves: DataFrame) -> DataFrame:
    """Saved files ``(repo, uri, content)`` of supported languages as sources."""
    return saves.filter(language_column(F.col("uri"), "editor").isNotNull()).select(
        "repo", F.col("uri").alias("path"), "content"
    )


def packs_of(src: DataFrame) -> list[str]:
    """Packs that have files in a batch: at most three short names."""
    pack = F.replace(language_column(F.col("path"), "editor"), F.lit("javascript"), F.lit("typescript"))
    return sorted(r["pack"] for r in src.select(pack.alias("pack")).distinct().collect())


def scan_batch(
    src: DataFrame, severity: str, confidence: float, languages=("python", "typescript", "go"), relations=None
) -> DataFrame:
    """Findings of sources that the editor shows."""
    found = scan(
        src, languages=languages, editor=True, keep=False, relations=relations
    )
    return filter_editor(found, severity, confidence).select(*FINDING_COLUMNS)


def shown_by_settings(found: DataFrame, config_log: DataFrame) -> DataFrame:
    """Findings that pass the thresholds of their own repository's settings; an unknown
    level shows medium and above, a confidence that is no number is the default."""
    level = severity_rank(F.col("severityThreshold"))
    least = F.coalesce(F.try_to_number("confidenceThreshold", F.lit("9.99")), F.lit(0.7)).cast("double")
    rank = severity_rank("severity")
    shown = (rank >= 0) & (rank <= F.when(level < 0, 2).otherwise(level)) & (F.col("confidence") >= least)
    return apply_config(found, config_log).filter(shown).select(*found.columns)


def _parts_of(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None  # nothing is written yet


def _claim(spark: SparkSession, path: str, run: str, batch_id: int) -> int:
    """The scan number of a run's batch in the log at ``path``.

    A number is claimed in the log before it is used, and a batch that runs again finds the one
    it has. Numbers rise; their low bits come of the run, so no two runs ever share one, even if
    they claim at the same time.
    """
    claims = _parts_of(spark, f"{path}/claims")
    most = None
    if claims is not None:
        mine = (F.col("run") == run) & (F.col("batch") == batch_id)
        known, most = claims.agg(F.max(F.when(mine, F.col("claimed"))), F.max("claimed")).first()
        if known is not None:
            return known
    number = _above(most, run)
    spark.createDataFrame([(run, batch_id, number)], "run string, batch long, claimed long").coalesce(1).write.mode("append").parquet(f"{path}/claims")
    return number


_RUN_BITS = 24


def _above(most: int | None, run: str) -> int:
    """The next number after ``most``, with the run in its low bits."""
    return ((0 if most is None else (most >> _RUN_BITS) + 1) << _RUN_BITS) | zlib.crc32(run.encode()) >> (32 - _RUN_BITS)


def log_writer(path: str, severity: str = "medium", confidence: float = 0.7, config_log: DataFrame | None = None, run: str = "run"):
    """A ``foreachBatch`` function that scans a batch and appends to the log at ``path``.

    Each batch owns a folder named by its scan number, so a batch that runs again after a
    failure replaces its own output. A file without findings still leaves a scan row. With
    ``config_log`` the settings of each repository as of the batch decide: switched off, its
    saves are not scanned, and its thresholds filter its findings.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scan_id = _claim(batch.sparkSession, path, run, batch_id)
        latest = batch.groupBy("repo", "uri").agg(F.max_by("content", "ts").alias("content"))
        if config_log is not None:
            latest = apply_config(latest, config_log).select("repo", "uri", "content")
        kept = latest.persist()
        src = saved_sources(kept)
        relations = Relations(src, editor=True, keep="checkpoint")
        try:
            wide = ("info", 0.0) if config_log is not None else (severity, confidence)
            found = scan_batch(src, *wide, packs_of(src), relations)
            if config_log is not None:
                found = shown_by_settings(found, config_log)
            found.write.mode("overwrite").parquet(f"{path}/findings/scan_id={scan_id}")
            kept.select(
                "repo", F.col("uri").alias("file"), F.lit(False).alias("cleared")
            ).write.mode("overwrite").parquet(f"{path}/scans/scan_id={scan_id}")
        finally:
            relations.release()
            kept.unpersist()

    return write


def clear_findings(repos: DataFrame, path: str) -> None:
    """Appends a clear event for each row's ``repo``: what was found before is not shown. A
    clear has a number of its own, which no batch that runs again writes to."""
    rows = repos.select("repo", F.lit(None).cast("string").alias("file"), F.lit(True).alias("cleared"))
    scan_id = _claim(repos.sparkSession, path, f"clear-{uuid.uuid4().hex}", 0)
    rows.write.parquet(f"{path}/scans/scan_id={scan_id}")


def compact_log(spark: SparkSession, path: str, to: str) -> None:
    """Writes what ``latest_findings`` shows of the log at ``path``, and the scans behind it,
    as a log at ``to``; old findings are left behind. Claims go along."""
    scans = spark.read.parquet(f"{path}/scans")
    found = latest_findings(spark.read.parquet(f"{path}/findings"), scans)
    found.write.partitionBy("scan_id").parquet(f"{to}/findings")
    newest = scans.groupBy("repo", "file", "cleared").agg(F.max("scan_id").alias("scan_id"))
    newest.write.partitionBy("scan_id").parquet(f"{to}/scans")
    spark.read.parquet(f"{path}/claims").write.parquet(f"{to}/claims")


def start_available(writer):
    """Starts a stream that ends when what has arrived is done.

    Batches without data exist to let timers fire, and with clock timers there is always one
    more; such a run leaves them out, and bursts still open wait in the state for the next run.
    """
    spark = SparkSession.getActiveSession()
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", STATE_STORE[0]: STATE_STORE[1]}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def scan_stream(
    saves: DataFrame, path: str, checkpoint: str, severity: str = "medium", confidence: float = 0.7,
    config_log: DataFrame | None = None, gap: str | None = None,
):
    """Start the scan of a stream of saves; returns the streaming query.

    With ``gap`` the saves are debounced first; with ``config_log`` (repo, key, value, ts) the
    repositories' settings hold.
    """
    events = debounce_saves(saves, gap) if gap else saves
    return start_available(
        events.writeStream.foreachBatch(log_writer(path, severity, confidence, config_log, checkpoint)).option(
            "checkpointLocation", checkpoint
        )
    )


def latest_findings(findings_log: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings of each file's newest scan, unless its repository was cleared since.

    ``scans`` has ``(repo, file, scan_id, cleared)``; a clear is a row without a file.
    """
    newest = scans.filter(~F.col("cleared")).groupBy("repo", "file").agg(
        F.max("scan_id").alias("scan_id")
    )
    cleared = scans.filter("cleared").groupBy("repo").agg(F.max("scan_id").alias("cleared_at"))
    current = (
        newest.join(cleared, "repo", "left")
        .filter(F.col("cleared_at").isNull() | (F.col("scan_id") > F.col("cleared_at")))
        .drop("cleared_at")
    )
    return findings_log.join(current, ["repo", "file", "scan_id"], "left_semi")
