"""Helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.sources.storage import cut, fresh_path, written  # noqa: F401

#: A text batch that a Python helper builds at once is at most about this large.
BATCH_BYTES = 8 << 20


def row_wise(batches: Iterator[pa.RecordBatch], make: Callable[..., tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``make(*row)`` for each row, in batches of bounded text size."""
    for batch in batches:
        rows, held = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(make(*row))
            held += sum(len(x) for x in row if isinstance(x, str))
            if held > BATCH_BYTES:
                yield to_batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield to_batch(rows, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl_types: dict[str, str]) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in ddl_types.items()])


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns.items())


#: Rows of an Arrow batch: each holds a whole text, and some batches are under way per task.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs: DataFrame) -> None:
    """Holds the session to Arrow batches of at most :data:`BATCH_ROWS` rows."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
        conf.set(_ROWS_SETTING, str(BATCH_ROWS))


def as_rows(df: DataFrame, leave_out: tuple = ()) -> tuple[DataFrame, list[str]]:
    """``df`` as one column ``row`` of structs with fields ``c0, c1, ...``, and their names in
    order; names of the columns cannot clash with anything then."""
    small_batches(df)
    names = [c for c in df.columns if c not in leave_out]
    return df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row")), names


def from_rows(df: DataFrame, names: list[str]) -> list:
    return [F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text``; other columns play no part."""
    small_batches(docs)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
