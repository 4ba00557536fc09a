"""Line dedup by log templates, in DataFrame functions only.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens, with
tokens that hold a digit read as variable. At the leaf it has the template of all its tokens
and, if it is long enough, templates in which one stretch of tokens is variable: the tail, the
head behind the leading tokens, or the middle. A template that turns up in many different
documents is boilerplate, and lines of it are dropped from every document.

Copies of a document, exact ones and near ones, count as one document, so copies alone make no
template recur. A full template of many tokens needs only two documents. Near copies are found
by least hashes of their three-token shingles: texts that share a band of hashes and agree in
most of all hashes are folded.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.components import components
from lintlake.llm.shared import cut, ids_and_texts, written

WILD = "<*>"
#: Recurring templates up to this many (8 bytes each) are sent to every task.
BROADCAST_ROWS = 1_000_000
#: Full templates of this many tokens recur in two documents; their hashes are odd, others even.
LONG_TOKENS = 50
#: Bands of least hashes that a copy shares one of, hashes of a band, and of all hashes those
#: in which copies agree (about the share of shingles that they have in common).
BANDS, BAND, AGREE = 6, 3, 11
#: Odd numbers of 64 bits; the shingle nearest to each, bit by bit, is one of the least hashes.
DRAWS = [(0x9E3779B97F4A7C15 * (2 * i + 1) + 0x1F83D9ABFB41BD6B * i * i) % (1 << 64) - (1 << 63) for i in range(BANDS * BAND)]
#: Band keys of more than one text up to this many (about 100 bytes each) are sent to every task.
BROADCAST_KEYS = 100_000


def spaced(text: Column, breaks: bool = False) -> Column:
    """``text`` with one blank for all white space between tokens; line breaks stay unless
    ``breaks``."""
    marks = ("  ", "\t", "\x0b", "\x0c", "\r", *(("\n",) if breaks else ()))
    odd = reduce(or_, (F.contains(text, F.lit(m)) for m in marks))
    return F.when(odd, F.regexp_replace(text, r"[\x20\t-\r]+" if breaks else r"[\x20\t\x0b-\r]+", " ")).otherwise(text)


def masked(text: Column) -> Column:
    """Tokens of spaced text with those that hold a digit as variable, one blank between them."""
    known = F.regexp_replace(text, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", WILD)
    return F.trim(F.when(text.rlike("[0-9]"), known).otherwise(text))


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_no, line`` of whole texts; a null text has no lines."""
    own = ids_and_texts(docs)
    lines = F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    return own.select("doc_id", F.xxhash64("text").alias("text_hash"), lines)


def templates(docs: DataFrame, depth: int = 2, least_tokens: int = 4, least_constant: int = 5) -> DataFrame:
    """``doc_id, text_hash, line_no, ways``: the hashed templates of each line that has at
    least ``least_tokens`` tokens.

    ``ways`` holds the full template and, where at least ``least_constant`` tokens stay
    constant, those with a variable tail, head or middle; every template names the number of
    tokens and the ``depth`` leading ones.
    """
    own = ids_and_texts(docs)
    split = F.posexplode(F.split(spaced(F.col("text")), "\n", -1)).alias("line_no", "line")
    rows = own.select("doc_id", F.xxhash64("text").alias("text_hash"), split).withColumn("line", masked(F.col("line")))
    rows = rows.withColumn("n", F.size(F.split("line", " "))).where(F.col("n") >= least_tokens)
    n, line = F.col("n"), F.col("line")
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    first = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    last = lambda k: first(-k)
    even = lambda h: h.bitwiseAND(F.lit(-2))
    full = even(F.xxhash64(n, F.lit(0), line)).bitwiseOR(F.when(n >= LONG_TOKENS, 1).otherwise(0))
    tail = even(F.xxhash64(n, F.lit(1), first(n - half)))
    front = even(F.xxhash64(n, F.lit(2), first(F.lit(depth)), last(n - half)))
    middle = even(F.xxhash64(n, F.lit(3), first(third), last(third)))
    ways = F.when(2 * third >= least_constant, F.array(full, tail, front, middle)).when(half >= least_constant, F.array(full, tail, front)).otherwise(F.array(full))
    return rows.select("doc_id", "text_hash", "line_no", ways.alias("ways"))


def copies(docs: DataFrame) -> DataFrame:
    """``text_hash, root``: each text that is a near copy of others, and the one that stands
    for all of them; a text that stands for itself has no row."""
    own = ids_and_texts(docs).where("text IS NOT NULL")
    tokens = own.select(F.xxhash64("text").alias("text_hash"), F.split(masked(spaced(F.col("text"), breaks=True)), " ").alias("t"))
    # the last two lack what would follow them, so that short texts have some too
    shingles = F.transform("t", lambda x, i: F.xxhash64(x, F.get("t", i + 1), F.get("t", i + 2)))
    # no filter is inferred from an outer one, which would make all tokens twice
    least = tokens.select("text_hash", F.explode_outer(shingles).alias("h")).groupBy("text_hash")
    least = least.agg(*(F.min(F.col("h").bitwiseXOR(F.lit(d).cast("long"))).alias(f"m{i}") for i, d in enumerate(DRAWS)))
    keys = F.array(*(F.xxhash64(F.lit(b), *(f"m{i}" for i in range(b * BAND, (b + 1) * BAND))) for b in range(BANDS)))
    short = F.array(*(F.pmod(f"m{i}", F.lit(1 << 15)).cast("short") for i in range(len(DRAWS))))
    sketched = written(least.select("text_hash", keys.alias("keys"), short.alias("sketch")), "sketches")
    banded = sketched.select("text_hash", "sketch", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min(F.struct("text_hash", "sketch")).alias("one"), F.max("text_hash").alias("last"))
    shared = cut(shared.where("one.text_hash <> last").select("key", "one"))
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared
    alike = F.size(F.filter(F.zip_with("sketch", "one.sketch", lambda x, y: x == y), lambda same: same)) >= AGREE
    met = banded.join(shared, "key").where(F.col("text_hash") != F.col("one.text_hash")).where(alike)
    root = components(met.select(F.col("text_hash").alias("a"), F.col("one.text_hash").alias("b")))
    return root.where("node <> root").select(F.col("node").alias("text_hash"), "root")


def recurring(lined: DataFrame, folded: DataFrame, least_places: int = 10) -> DataFrame:
    """``way``: templates in at least ``least_places`` different documents, copies folded
    into one; two are enough for full templates of :data:`LONG_TOKENS`."""
    folded = F.broadcast(folded) if folded.count() <= BROADCAST_ROWS else folded
    placed = lined.join(folded, "text_hash", "left").select(F.explode("ways").alias("way"), F.coalesce("root", "text_hash").alias("place"))
    # a template has few places of its own per task after this; sums are made there first
    found = placed.distinct().groupBy("way").agg(F.count("*").alias("places"))
    least = F.when(F.col("way").bitwiseAND(F.lit(1)) == 1, 2).otherwise(max(least_places, 2))
    return found.where(F.col("places") >= least).select("way")


def dedup_lines(docs: DataFrame, least_places: int = 10, **shape) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    All rows and other columns stay (columns of those two names are replaced). A null text
    stays null and has no lines; an empty one has one empty line, which stays. Rows that
    repeat an id and a text are treated alike; equal ids with different texts are judged by
    their own text.
    """
    lined = written(templates(docs, **shape), "templates")
    found = cut(recurring(lined, copies(docs), least_places))
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    hits = lined.select("doc_id", "text_hash", "line_no", F.explode("ways").alias("way")).join(found, "way", "left_semi")
    dropped = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("text_hash", F.xxhash64("text"))
    right = dropped.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "gone")
    joined = own.join(right, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    out = [kept.alias(c) if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)]
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return joined.select(*out, F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
