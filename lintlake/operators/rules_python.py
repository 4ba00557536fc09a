"""Python rules as queries over the ``py_nodes`` relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import base_name
from lintlake.operators.hits import say, this
from lintlake.operators.pynodes import DEF_KINDS, LOOP_KINDS, NOT_PARSED
from lintlake.operators.thresholds import with_limits
from lintlake.model import as_column
from lintlake.plans.catalogue import report

KEY = ("repo", "path")
# Calls that reach a database, alone or only with keyword arguments.
ORM_METHODS = (
    "filter", "exclude", "select_related", "prefetch_related", "values", "values_list",
    "annotate", "aggregate", "create", "bulk_create", "delete",
)
MAYBE_ORM_METHODS = ("get", "all", "first", "last", "count", "update")
# Where a number explains itself, by the node it stands in.
EXPLAINED_IN = (
    "AnnAssign", "Assert", "arguments", "keyword", "Call", "Compare", "Dict", "List",
    "Tuple", "Set", "Subscript", "Slice", "BinOp",
)
RETRY_NAMES = r"^(_$|attempt|retry|try_)"
CHAIN_LIMITS = (4, 6)

def _calls(nodes: DataFrame) -> DataFrame:
    return nodes.filter(this.kind == "Call")


def _has_keyword(*names: str) -> Column:
    return F.coalesce(F.exists("keywords", lambda k: k["name"].isin(*names)), F.lit(False))


def _defs() -> Column:
    """Functions around a node."""
    return F.filter("scopes", lambda s: s["kind"].isin(*DEF_KINDS))


def read_by_rules() -> Column:
    """Nodes that a rule of this module or the metrics of functions look at, by what their filters
    share: most nodes of a file are names and values that none of them reads."""
    kinds = (
        "If", "IfExp", "ExceptHandler", "BoolOp", "comprehension", "ImportFrom", "Assert", NOT_PARSED, *LOOP_KINDS, *DEF_KINDS,
    )
    named = this.name.isin(
        *ORM_METHODS, *MAYBE_ORM_METHODS, "now", "execute", "raw", "executemany", "eval", "exec", "load", "open"
    ) | this.name.startswith("assert") | F.exists(_defs(), lambda s: s["name"] == this.name)
    wanted = (
        this.kind.isin(*kinds)
        | ((this.kind == "Constant") & F.col("num").isNotNull())
        | ((this.kind == "Call") & named)
        | ((this.parent_kind == "If") & (F.col("field") == "orelse"))
        | ((this.parent_kind == "arguments") & this.kind.isin("List", "Dict", "Set"))
    )
    return F.coalesce(wanted, F.lit(False))


def mutable_default_argument(nodes: DataFrame) -> DataFrame:
    """List, dict or set literals as defaults, one finding each, at the ``def``."""
    owner = F.get("scopes", F.size("scopes") - 1)
    found = nodes.filter(
        (this.parent_kind == "arguments") & F.col("field").isin("defaults", "kw_defaults")
        & this.kind.isin("List", "Dict", "Set") & F.col("grand_kind").isin(*DEF_KINDS)
    ).select(
        *KEY, "pre", F.lower("kind").alias("type"), owner["name"].alias("name"), owner["line"].alias("line")
    )
    return report(
        found, "python/mutable-default-argument", language="python",
        message=say("Function '", this.name, "' has a ", F.col("type"), " as a default; all calls share that one object."),
        remediation=say("Default to None in '", this.name, "' and make the ", F.col("type"), " inside."),
        ordinal=F.col("pre"),
    )


def _owned(kinds: tuple) -> Column:
    """``owner``, the innermost scope of these kinds around a node, and ``within``, the
    scopes between the two."""
    wanted = F.array(*[F.lit(k) for k in kinds])
    position = F.coalesce(
        F.array_max(
            F.transform(
                "scopes", lambda s, i: F.when(F.array_contains(wanted, s["kind"]), i + 1).otherwise(0)
            )
        ),
        F.lit(0),
    )
    return F.struct(
        F.get("scopes", position - 1).alias("owner"),
        F.slice("scopes", position + 1, F.greatest(F.size("scopes") - position, F.lit(0))).alias("within"),
    )


def _function_facts(nodes: DataFrame) -> DataFrame:
    """Per function: cognitive ``score``, nesting ``depth`` and whether it is ``recursive``.

    One pass: every node gives points to the function it belongs to, and calls mark the
    functions of their name around them; all of it is added up in one aggregation.
    """
    own = _owned((*DEF_KINDS, "ClassDef"))
    above = F.get("scopes", F.size("scopes") - 1)
    in_else = (
        (this.parent_kind == "If") & (F.col("field") == "orelse") & (above["elif_pos"] % 2 == 0)
    )
    loops = F.size(F.filter(own["within"], lambda s: s["kind"].isin(*LOOP_KINDS)))
    self_call = (this.kind == "Call") & (F.col("op") == "Name") & (this.name == own["owner"]["name"])
    points = (
        F.coalesce(in_else.cast("int"), F.lit(0))
        + F.when(this.kind == "If", F.when(F.col("elif_pos") % 2 == 0, 1 + loops).otherwise(0))
        .when(this.kind.isin(*LOOP_KINDS, "ExceptHandler"), 1 + loops)
        .when((this.kind == "BoolOp") | self_call, 1)
        .otherwise(0)
    )
    # the test of a branch is not walked, and classes keep their own
    counted = own["owner"]["kind"].isin(*DEF_KINDS) & ~F.exists(
        own["within"], lambda s: (s["kind"] == "If") & (s["edge"] == "test")
    )
    home = _owned(DEF_KINDS)
    deep = this.kind.isin(*LOOP_KINDS) | ((this.kind == "If") & ~F.col("early_exit"))
    depth = 1 + F.size(F.filter(home["within"], lambda s: s["deep"]))

    def share(scope: Column, points, depth, recursive) -> Column:
        return F.struct(
            scope["pre"].alias("pre"), scope["name"].alias("name"), scope["line"].alias("line"),
            scope["end_line"].alias("end_line"), as_column(points).cast("int").alias("points"),
            as_column(depth).cast("int").alias("depth"), F.lit(recursive).alias("recursive"),
        )

    shares = F.concat(
        F.array_compact(
            F.array(
                F.when(counted & (points > 0), share(own["owner"], points, 0, 0)),
                F.when(deep & home["owner"].isNotNull(), share(home["owner"], 0, depth, 0)),
            )
        ),
        F.when(
            (this.kind == "Call") & this.name.isNotNull(),
            F.transform(
                F.filter(_defs(), lambda s: s["name"] == this.name), lambda s: share(s, 0, 0, 1)
            ),
        ).otherwise(F.array()),
    )
    return (
        nodes.filter(F.size("scopes") > 0)
        .select(*KEY, F.explode(shares).alias("s"))
        .groupBy(*KEY, "s.pre", "s.name", "s.line", "s.end_line")
        .agg(
            F.sum("s.points").alias("score"), F.max("s.depth").alias("depth"),
            F.max("s.recursive").alias("recursive"),
        )
    )


def _judged(nodes: DataFrame, limits) -> DataFrame:
    limited = with_limits(
        _function_facts(nodes), limits, "python", "max_cyclomatic_complexity", "max_nesting_depth"
    )
    return limited.withColumn("score_limit", F.col("limit_max_cyclomatic_complexity") * 2).withColumn(
        "depth_limit", F.col("limit_max_nesting_depth") + 1 + F.col("recursive")
    )


def cognitive_complexity(nodes: DataFrame, limits=None) -> DataFrame:
    score, limit = F.col("score"), F.col("score_limit")
    return report(
        _judged(nodes, limits).filter(score >= limit), "python/cognitive-complexity", language="python",
        line_end=F.col("end_line"),
        severity=F.when(score < limit * 1.25, "medium").otherwise("high"),
        message=say("Function '", this.name, "' scores ", score, " in cognitive complexity (threshold: ",
                    limit.cast("int"), ")."),
        remediation="Move parts into helpers, flatten loops, return early, or simplify conditions.",
        ordinal=F.col("pre"),
    )


def deep_nesting(nodes: DataFrame, limits=None) -> DataFrame:
    """Loops and branches inside each other; early exits are free, recursion gives one more.

    Functions that are reported for their cognitive score are left out.
    """
    depth, limit = F.col("depth"), F.col("depth_limit")
    found = _judged(nodes, limits).filter((depth >= limit) & (F.col("score") < F.col("score_limit")))
    return report(
        found, "python/deep-nesting", language="python", line_end=F.col("end_line"),
        severity=F.when(depth < limit + 2, "medium").otherwise("high"),
        message=say("Function '", this.name, "' nests ", depth, " levels deep (threshold: ", limit.cast("int"), ")."),
        remediation="Return early, move inner blocks into functions, or use generators in place of loops.",
        ordinal=F.col("pre"),
    )


def bare_except(nodes: DataFrame) -> DataFrame:
    """Handlers without a type; with a lone ``pass`` they swallow everything."""
    found = nodes.filter((this.kind == "ExceptHandler") & F.col("op").isNull())
    sink = (F.col("first") == "Pass") & (F.col("size") == 1)
    return report(
        found, "python/bare-except", language="python", line_end=F.col("end_line"),
        antipattern=F.when(sink, "exception_sink").otherwise("bare_except"),
        antipattern_name=F.when(sink, "Exception Sink").otherwise("Bare Except"),
        message=F.when(sink, "A bare `except:` catches everything and drops it.").otherwise(
            "A bare `except:` also catches SystemExit and KeyboardInterrupt."
        ),
        remediation="Name the exceptions to catch; if all are meant, catch Exception and log it.",
        ordinal=F.col("pre"),
    )


def wildcard_import(nodes: DataFrame) -> DataFrame:
    found = nodes.filter(this.kind == "ImportFrom").select(
        *KEY, "pre", "line", F.coalesce("name", F.lit("None")).alias("module"),
        F.explode(F.filter("keywords", lambda k: k["name"] == "*")),
    )
    return report(
        found, "python/wildcard-import", language="python",
        message=say("`from ", F.col("module"), " import *` hides where names come from."),
        remediation=say("Import the names you use from ", F.col("module"), "."),
        ordinal=F.col("pre"),
    )


def magic_number(nodes: DataFrame, limits=None) -> DataFrame:
    """Numbers whose place does not explain them."""
    path, name = F.col("path"), F.col("assigned")
    tests = path.rlike(r"(_test\.py|test_\.py)$") | path.contains("/test")
    # letters all in capitals, and at least one
    constant = (F.upper(name) == name) & (F.lower(name) != name)
    assigned = (this.parent_kind == "Assign") & ((F.col("grand_kind") == "Module") | constant)
    candidates = nodes.filter(
        (this.kind == "Constant") & F.col("num").isNotNull() & ~tests
        & ~F.coalesce(this.parent_kind.isin(*EXPLAINED_IN), F.lit(False))
        & ~F.coalesce(assigned, F.lit(False))
        & ~F.col("line_text").rlike("0[xXoO]")
    )
    found = with_limits(candidates, limits, "python", "magic_number_allowed").filter(
        ~F.array_contains("limit_magic_number_allowed", F.col("num"))
    )
    return report(
        found, "python/magic-number", language="python", line_end=F.col("line"),
        message=say("Number `", F.col("shown"), "` has no name that tells what it means."),
        remediation=say("Give ", F.col("shown"), " a name in capitals and use the name."),
        ordinal=F.col("pre"),
    )


def n_plus_one_query(nodes: DataFrame) -> DataFrame:
    """Loops with database calls in their body; every loop around such a call reports."""
    method = (this.kind == "Call") & (F.col("op") == "Attribute")
    maybe = this.name.isin(*MAYBE_ORM_METHODS) & (F.size("keywords") > 0) & (
        F.coalesce(F.col("first"), F.lit("")) != "str"
    )
    loops = F.filter(
        "scopes",
        lambda s: (s["kind"] == "For") & (s["edge"] == "body")
        # a loop over a range for retries asks the same thing again
        & ~F.coalesce(s["name"].rlike(RETRY_NAMES), F.lit(False)),
    )
    found = (
        nodes.filter(method & (this.name.isin(*ORM_METHODS) | maybe))
        .select(*KEY, "name", F.explode(loops).alias("s"))
        .groupBy(*KEY, "s.pre", "s.line", "s.end_line")
        # a set over a list of fixed words
        .agg(F.array_sort(F.collect_set("name")).alias("methods"))
    )
    return report(
        found, "python/n-plus-one-query", language="python", line_end=F.col("end_line"),
        message=say("The loop calls .", F.array_join("methods", "(), ."), "() each round, which may be a query each time."),
        remediation="Fetch the rows before the loop, in one query or with the related ones.",
        ordinal=F.col("pre"),
    )


def datetime_now_naive(nodes: DataFrame) -> DataFrame:
    """``datetime.now()`` without a time zone in any form."""
    found = _calls(nodes).filter(
        (F.col("op") == "Attribute") & (this.name == "now") & (F.col("size") == 0)
        & F.col("receiver_kind").isin("Name", "Attribute") & (F.col("receiver") == "datetime")
        & ~_has_keyword("tz", "tzinfo")
    )
    return report(
        found, "python/datetime-now-naive", language="python",
        message="datetime.now() without a time zone gives a time that means something else elsewhere.",
        remediation="Pass a zone, such as datetime.now(tz=timezone.utc).",
        ordinal=F.col("pre"),
    )


def string_format_sql(nodes: DataFrame) -> DataFrame:
    """SQL calls whose first argument is built by an f-string, ``.format`` or ``%``."""
    found = _calls(nodes).filter(
        (F.col("op") == "Attribute") & this.name.isin("execute", "raw", "executemany")
        & F.col("first").isin("JoinedStr", "Call.format", "BinOp.Mod")
    )
    return report(
        found, "python/string-format-sql", language="python",
        message=say("The SQL of .", this.name, "() is formatted from values, which opens it to injection."),
        remediation="Keep placeholders in the SQL and pass the values as parameters.",
        ordinal=F.col("pre"),
    )


def isinstance_chain(nodes: DataFrame) -> DataFrame:
    """Runs of if/elif that each test ``isinstance``; each member starts a run of its own.

    The members of one if/elif ladder are numbered by ``elif_pos``; runs are found as
    gaps and islands over that number, so no walk along the ladder is needed.
    """
    linked = (
        nodes.filter(this.kind == "If")
        .withColumn("tested", this.name == "isinstance")
        # an `if` follows on its parent when it is the only statement of the else branch
        .withColumn("follows", (F.col("elif_pos") > 0) & F.col("alone"))
        # a ladder is known by its first member: it lies `elif_pos` links up
        .withColumn(
            "ladder",
            F.when(F.col("elif_pos") > 0, F.get("scopes", F.size("scopes") - F.col("elif_pos"))["pre"])
            .otherwise(F.col("pre")),
        )
    )
    # ladders with several statements in an else branch fork; the fork number parts them
    fork = (
        Window.partitionBy(*KEY, "ladder").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    )
    parted = linked.withColumn("part", F.sum((~F.col("follows")).cast("int")).over(fork))
    ladder = Window.partitionBy(*KEY, "ladder", "part").orderBy(F.col("elif_pos").desc())
    run = parted.withColumn(
        "island", F.sum(F.when(F.col("tested"), 0).otherwise(1)).over(ladder)
    )
    counted = run.filter("tested").withColumn(
        "length",
        F.count("*").over(
            Window.partitionBy(*KEY, "ladder", "part", "island").orderBy(F.col("elif_pos").desc())
        ),
    )
    found = counted.filter(F.col("length") >= CHAIN_LIMITS[0])
    return report(
        found, "python/isinstance-chain", language="python", line_end=F.col("end_line"),
        severity=F.when(F.col("length") < CHAIN_LIMITS[1], "medium").otherwise("high"),
        message=say(F.col("length"), " branches in a row test isinstance()."),
        remediation="Use methods of a shared base class, a table from type to handler, or match.",
        ordinal=F.col("pre"),
    )


def eval_usage(nodes: DataFrame) -> DataFrame:
    found = _calls(nodes).filter((F.col("op") == "Name") & this.name.isin("eval", "exec"))
    return report(
        found, "python/eval-usage", language="python",
        message=say("`", this.name, "()` runs any text as code."),
        remediation=say("Replace `", this.name, "()` by ast.literal_eval() or a table of functions."),
        ordinal=F.col("pre"),
    )


def yaml_unsafe_load(nodes: DataFrame) -> DataFrame:
    """``yaml.load`` without ``Loader=SafeLoader``."""
    safe = F.exists(
        "keywords",
        lambda k: (k["name"] == "Loader") & F.coalesce(k["value"] == "SafeLoader", F.lit(False)),
    )
    found = _calls(nodes).filter(
        (F.col("op") == "Attribute") & (this.name == "load")
        & (F.col("receiver_kind") == "Name") & (F.col("receiver") == "yaml")
        & ~F.coalesce(safe, F.lit(False))
    )
    return report(
        found, "python/yaml-unsafe-load", language="python",
        message="yaml.load() without SafeLoader can run code from the document.",
        remediation="Call yaml.safe_load(), or pass Loader=yaml.SafeLoader.",
        ordinal=F.col("pre"),
    )


def file_not_closed(nodes: DataFrame) -> DataFrame:
    found = _calls(nodes).filter(
        (F.col("op") == "Name") & (this.name == "open") & (this.parent_kind != "withitem")
    )
    return report(
        found, "python/file-not-closed", language="python",
        message="open() outside a `with` may leave the file open when something fails.",
        remediation="Open the file in a `with` statement.",
        ordinal=F.col("pre"),
    )


def test_no_assertion(nodes: DataFrame) -> DataFrame:
    """``test_*`` functions of test files with no assertion anywhere inside."""
    file = base_name(F.col("path"))
    check = (this.kind == "Assert") | (
        (this.kind == "Call") & (F.col("op") == "Attribute") & this.name.startswith("assert")
        & (F.col("receiver_kind") == "Name") & (F.col("receiver") == "self")
    )
    # each function stands for itself, and each assertion for the functions around it
    shares = F.when(
        this.kind.isin(*DEF_KINDS),
        F.array(F.struct("pre", "name", "line", "end_line", F.lit(0).alias("checks"))),
    ).when(
        check,
        F.transform(
            _defs(),
            lambda s: F.struct(
                s["pre"].alias("pre"), s["name"].alias("name"), s["line"].alias("line"),
                s["end_line"].alias("end_line"), F.lit(1).alias("checks"),
            ),
        ),
    )
    found = (
        nodes.filter(file.contains("test_") | file.contains("_test"))
        .select(*KEY, F.explode(shares).alias("s"))
        .filter(F.startswith("s.name", F.lit("test_")))
        .groupBy(*KEY, "s.pre", "s.name", "s.line", "s.end_line")
        .agg(F.sum("s.checks").alias("checks"))
        .filter("checks = 0")
    )
    return report(
        found, "python/test-no-assertion", language="python", line_end=F.col("end_line"),
        message=say("Test '", this.name, "' asserts nothing."),
        remediation=say("Assert in '", this.name, "' what the tested code should do."),
        ordinal=F.col("pre"),
    )


# Rule ids and their queries, in reporting order.
RULES = {
    "python/mutable-default-argument": mutable_default_argument,
    "python/cognitive-complexity": cognitive_complexity,
    "python/deep-nesting": deep_nesting,
    "python/bare-except": bare_except,
    "python/wildcard-import": wildcard_import,
    "python/magic-number": magic_number,
    "python/n-plus-one-query": n_plus_one_query,
    "python/datetime-now-naive": datetime_now_naive,
    "python/string-format-sql": string_format_sql,
    "python/isinstance-chain": isinstance_chain,
    "python/eval-usage": eval_usage,
    "python/yaml-unsafe-load": yaml_unsafe_load,
    "python/file-not-closed": file_not_closed,
    "python/test-no-assertion": test_no_assertion,
}
