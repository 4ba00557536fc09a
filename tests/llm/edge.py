"""Rows that every operator has to stand."""

from pyspark.sql import functions as F

LONG = "Word number one. " * 40_000
#: Names that operators use inside.
CLASHES = ("row", "slot", "kind", "text_hash", "doc_key", "print", "gone", "ways", "c0", "host", "path", "score", "h", "d")


def documents(spark, rows, clash=True):
    """``rows`` of (doc_id, text) with the other columns of documents and clashing ones."""
    df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHES}) if clash else df


EDGE = [
    (1, None),
    (2, ""),
    (3, "   \n\t\n "),
    (None, "A text without an id that is long enough to be looked at, once and again."),
    (None, None),
    (4, LONG),
    (5, LONG),
    (6, "The same row stands here twice and it has more than ten words in it."),
    (6, "The same row stands here twice and it has more than ten words in it."),
    (7, "The same row stands here twice and it has more than ten words in it."),
    (7, "Another text with the id of the row above, which is not the same."),
    (8, "a▁b ▁  \x00 é 　 漢字 \U0001f600"),
]


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
