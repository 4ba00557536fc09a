"""Length and cyclomatic complexity of functions, from the code relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.operators.pynodes import DEF_KINDS, LOOP_KINDS
from lintlake.operators.relations import KEY, enclosing, js_head_line, js_name

# Tokens that open one more path through a function.
DECISIONS = {
    "go": ("if", "for", "case", "&&", "||"),
    "typescript": ("if", "for", "while", "case", "catch", "&&", "||", "?"),
}


def python_metrics(nodes: DataFrame) -> DataFrame:
    """``(repo, file, name, start, end, length, ccn)`` of Python functions.

    Complexity is one plus branches, loops, handlers, conditional expressions,
    comprehension parts and further operands of and/or.
    """
    kind = F.col("kind")
    points = (
        F.when(kind.isin("If", "IfExp", "ExceptHandler", *LOOP_KINDS), 1)
        .when(kind == "comprehension", 1 + F.col("size"))
        .when(kind == "BoolOp", F.col("size") - 1)
    )
    around = F.filter("scopes", lambda s: s["kind"].isin(*DEF_KINDS))
    owner = F.get(around, F.size(around) - 1)
    fields = ("pre", "name", "line", "end_line")
    # each function stands for itself, and each decision for the function around it
    shares = F.array_compact(
        F.array(
            F.when(kind.isin(*DEF_KINDS), F.struct(*fields, F.lit(0).alias("points"))),
            F.when(
                (points > 0) & owner.isNotNull(),
                F.struct(*[owner[f].alias(f) for f in fields], points.alias("points")),
            ),
        )
    )
    return (
        nodes.select(*KEY, F.explode(shares).alias("s"))
        .groupBy(*KEY, *[f"s.{f}" for f in fields])
        .agg(F.sum("s.points").alias("points"))
        .select(
            "repo",
            F.col("path").alias("file"),
            "name",
            F.col("line").alias("start"),
            F.col("end_line").alias("end"),
            (F.col("end_line") - F.col("line") + 1).alias("length"),
            (F.lit(1) + F.col("points")).cast("int").alias("ccn"),
        )
    )


def block_metrics(rows: DataFrame, language: str) -> DataFrame:
    """The same from the blocks of Go or JS/TS code."""
    kinds = ("func",) if language == "go" else ("function", "method", "arrow")
    if language == "go":
        # `func name(` or `func (r T) name(`; the name stands before the parameters
        named = rows.withColumn(
            "name",
            F.when(F.col("last_func.n1") != "(", F.col("last_func.n1"))
            .when(F.col("last_func.n4") == ")", F.col("last_func.n5"))
            .when(F.col("last_func.n5") == ")", F.col("last_func.n6"))
            .when((F.col("last_func.n3") == ")") & (F.col("last_func.n5") == "("), F.col("last_func.n4")),
        ).withColumn("head_line", F.col("last_func.line"))
        # a literal inside a function is part of it, as only declarations count
        own = (F.col("kind_of_block") == "func") & (F.col("inside") == 0)
    else:
        named = rows.withColumn("name", js_name()).withColumn("head_line", js_head_line())
        own = F.col("kind_of_block").isin(*kinds)
    named = named.withColumn("own", F.coalesce(own, F.lit(False)))
    wanted = F.col("tok").isin(*DECISIONS[language]) & ~F.coalesce(F.col("p1") == ".", F.lit(False))
    facts = ["idx", "name", "head_line", "close_line"]
    around = enclosing(
        named.withColumn("function", F.when(F.col("own") & F.col("close").isNotNull(), F.struct(*facts))),
        wanted, ["idx", "function"], ["function"], own=F.col("own") & F.col("close").isNotNull(),
    )
    # a function stands for itself, a decision for the innermost function around it
    innermost = (
        around.withColumn("itself", F.col("outer").isNull())
        .withColumn("of", F.when(F.col("itself"), F.col("function")).otherwise(F.col("outer.function")))
        .filter(F.col("of").isNotNull())
        .groupBy(*KEY, "idx", "itself")
        .agg(F.max("of").alias("of"))
    )
    return (
        innermost.groupBy(*KEY, "of")
        .agg(F.count_if(~F.col("itself")).alias("points"))
        .select(
            "repo",
            F.col("path").alias("file"),
            F.coalesce("of.name", F.lit("(anonymous)")).alias("name"),
            F.col("of.head_line").alias("start"),
            F.col("of.close_line").alias("end"),
            (F.col("of.close_line") - F.col("of.head_line") + 1).alias("length"),
            (F.lit(1) + F.col("points")).cast("int").alias("ccn"),
        )
    )


def function_metrics(relation: DataFrame, language: str) -> DataFrame:
    """From ``py_nodes`` for Python, from ``code`` rows for the other languages."""
    if language == "python":
        return python_metrics(relation)
    return block_metrics(relation, "go" if language == "go" else "typescript")
