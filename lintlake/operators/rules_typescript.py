"""TypeScript and JavaScript rules as queries over the ``code`` relation.

Limits next to a full parser: template literals count as one string, control
statements without braces are seen themselves but add no depth to what they hold,
and return types that are object literals hide a method's body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import base_name, extension
from lintlake.operators.hits import hits, say, this
from lintlake.operators.relations import (
    KEY, enclosing, js_head_line, js_name, js_type_name,
)
from lintlake.operators.statements import statements
from lintlake.operators.thresholds import with_limits
from lintlake.model import string_list
from lintlake.plans.catalogue import BY_ID, report

# What the rules look for.
CONSOLE_METHODS = ("log", "debug", "info", "warn", "error", "trace")
TRIVIAL_LITERALS = ("true", "false", "1", "0")
SAME_CHECKS = ("toBe", "toEqual", "toStrictEqual")
ASSIGNMENTS = (
    "=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=",
    "&&=", "||=", "??=",
)
TRIVIAL_NUMBERS = (0.0, 1.0)
# Words that a value follows.
BEFORE_VALUES = (
    "return", "typeof", "case", "in", "of", "new", "delete", "void", "await", "yield",
    "else", "do", "throw", "instanceof", "default", "export", "if", "while",
)
DECLARERS = (
    "let", "var", "const", ";", "{", "}", "readonly", "private", "public", "protected",
    "declare", "static",
)
# Fewest hits of the per-file rules, and where they turn severe.
ANY_LIMITS = (5, 15)
IGNORE_LIMITS = (3, 10)
CONSOLE_LIMIT = 3
NON_NULL_LIMITS = (5, 10)
CALLBACK_LIMITS = (3, 5)


def language() -> Column:
    return F.when(extension(F.col("path")).isin(".ts", ".tsx"), "typescript").otherwise("javascript")


def _has(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def test_path() -> Column:
    return _has(F.col("path"), ".test.", ".spec.", "__tests__")


def test_name() -> Column:
    return _has(base_name(F.col("path")), ".test.", ".spec.", "__tests__")


def _plain() -> Column:
    return ~F.coalesce(this.p1.isin(".", "?."), F.lit(False))


def _value_before() -> Column:
    """The token before ends a value, so an operator or index follows."""
    word = F.col("p1_kind").isin("word", "string", "template") & ~F.coalesce(
        this.p1.isin(*BEFORE_VALUES), F.lit(False)
    )
    return word | F.coalesce(this.p1.isin(")", "]", "}", "!"), F.lit(False))


def _sequence(name: str) -> Column:
    """The condition of a rule that is a fixed run of tokens.

    A call is found at its opening bracket, whose row also knows where the call ends.
    """
    call = this.tok == "("
    member = this.p2 == "."
    whole = ~F.coalesce(this.p4.isin(".", "?."), F.lit(False))
    return {
        "eval": lambda: call & (this.p1 == "eval")
        & ~F.coalesce(this.p2.isin(".", "?.", "function", "get", "set", "async", "*"), F.lit(False)),
        "Function": lambda: (call & (this.p1 == "Function") & (this.p2 == "new"))
        | ((this.tok == "Function") & (this.p1 == "new") & ~F.coalesce(this.n1.isin(".", "("), F.lit(False))),
        "html": lambda: this.tok.isin("innerHTML", "outerHTML") & this.p1.isin(".", "?.") & this.n1.isin(*ASSIGNMENTS),
        "then": lambda: call & (this.p1 == "then") & this.p2.isin(".", "?."),
        "console": lambda: call & this.p1.isin(*CONSOLE_METHODS) & member & (this.p3 == "console") & whole,
        "mock": lambda: call & (this.p1 == "mock") & member & (this.p3 == "jest") & whole,
        "any": lambda: (this.tok == "any") & (
            (this.p1.isin(":", "<", "|", "&", "as", "=>", "extends", "keyof", "is", "readonly", "?")
             & ~F.coalesce(this.n1.isin(".", "(", "?."), F.lit(False)))
            | ((this.p1 == ",") & ((this.n1 == ">") | ((this.n1 == "[") & (this.n2 == "]"))))
            | ((this.p1 == "(") & (this.n1 == ")") & (this.n2 == "["))
            | ((this.p1 == "[") & this.n1.isin(",", "]"))
            | ((this.p1 == "=") & ((this.p3 == "type") | this.n1.isin(">", ",")))
        ),
        "nonnull": lambda: (this.tok == "!") & _value_before() & (this.p1 != "}") & ~F.col("fresh")
        & ~((this.p1 == ")") & F.coalesce(F.col("last_open.p1").isin("if", "while", "for"), F.lit(False)))
        # `name!: T` promises a later assignment, it is no assertion
        & ~F.coalesce((this.n1 == ":") & this.p2.isin(*DECLARERS), F.lit(False)),
        # expect ( true ) . toBe ( true
        "roulette": lambda: call & this.p1.isin(*SAME_CHECKS) & member & (this.p3 == ")")
        & this.p4.isin(*TRIVIAL_LITERALS) & (this.p5 == "(") & (this.p6 == "expect")
        & ~F.coalesce(this.p7.isin(".", "?."), F.lit(False))
        & (this.n1 == this.p4) & this.n2.isin(")", ","),
    }[name]()


def sequence_hits(rows: DataFrame, *names: str) -> DataFrame:
    """Hits of the named runs of tokens, all in one pass."""
    return hits(rows, {n: _sequence(n) for n in names})


def _calls(rows: DataFrame, name: str) -> DataFrame:
    """Hits at call brackets, with ``line`` of the word before and ``end_line``."""
    return (
        sequence_hits(rows, name)
        .withColumn("end_line", F.coalesce("close_line", "line"))
        .withColumn("line", F.when(this.tok == "(", F.col("prev_line")).otherwise(F.col("line")))
    )


def _stops() -> Column:
    """Whether the expression before a token ends there."""
    new_statement = (
        F.col("fresh") & (this.kind == "word") & _value_before()
        & ~this.tok.isin("instanceof", "in", "of", "as", "satisfies")
    )
    return this.tok.isin(",", ";") | F.coalesce(new_statement, F.lit(False))


def _later():
    """The tokens behind one in its place, the nearest last."""
    place = Window.partitionBy(*KEY, "inside", "encl").orderBy(F.col("idx").desc())
    return place.rowsBetween(Window.unboundedPreceding, -1)


def _expression_ends(rows: DataFrame, wanted: Column) -> DataFrame:
    """Wanted rows with ``end_line``, the line where the token's expression ends.

    It ends before the next comma, semicolon or new statement of its place, else before
    the bracket that closes the place.
    """
    marked = (
        rows.withColumn("_stop", _stops())
        .withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
        .filter(F.col("_stop") | F.col("_wanted") | this.tok.isin("(", "[", "{"))
        .withColumn(
            "stop_line", F.last(F.when(F.col("_stop"), F.col("prev_line")), ignorenulls=True).over(_later())
        )
    )
    return _innermost(marked, F.col("_wanted"), ["last_line"]).withColumn(
        "end_line", F.coalesce("stop_line", "outer.last_line", "line")
    )


def eval_usage(rows: DataFrame) -> DataFrame:
    """``eval(...)`` calls and ``new Function``, each under its own name."""
    found = sequence_hits(rows, "eval", "Function")
    is_eval = F.col("hit") == "eval"
    links = string_list(BY_ID["ts/eval-usage"].references)
    return report(
        found.withColumn("end_line", F.coalesce("close_line", "line")).withColumn(
            "line", F.when(this.tok == "(", F.col("prev_line")).otherwise(F.col("line"))
        ),
        "ts/eval-usage", language=language(), line_end=F.col("end_line"),
        antipattern_name=F.when(is_eval, "eval() Usage").otherwise("new Function() Usage"),
        references=F.when(is_eval, links).otherwise(string_list(())),
        message=F.when(is_eval, "`eval()` runs any text as code; with user input that is an open door.").otherwise(
            "`new Function()` builds code from text, just as eval() does."
        ),
        remediation=F.when(is_eval, "Use JSON.parse() for data or a lookup object for behaviour.").otherwise(
            "Use a named function, a closure or a lookup object."
        ),
        ordinal=F.col("idx"),
    )


def innerhtml_assignment(rows: DataFrame) -> DataFrame:
    """Assignments to ``.innerHTML`` / ``.outerHTML``; they end where the statement does."""
    found = _expression_ends(rows, _sequence("html")).withColumn(
        "line", F.coalesce("last_head.line", "line")
    )
    return report(
        found, "ts/innerhtml-assignment", language=language(), line_end=F.col("end_line"),
        message=say("Writing to `.", this.tok, "` puts text into the page as HTML; user input in it can run scripts."),
        remediation="Write to .textContent, or clean the HTML with a sanitizer first.",
        ordinal=F.col("idx"),
    )


def promise_no_catch(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Every ``.then(`` outside tests; ``strict`` leaves out those with ``.catch`` behind.

    The finding runs from the line of the chain's first token to the call's end.
    """
    if strict:
        caught = (this.tok == "catch") & this.p1.isin(".", "?.") & (this.n1 == "(")
        place = Window.partitionBy(*KEY, "inside", "stmt")
        rows = rows.withColumn("catch_at", F.max(F.when(caught, F.col("idx"))).over(place))
    found = (
        _calls(rows, "then")
        .filter(~_has(F.col("path"), ".test.", ".spec."))
        .withColumn("line", F.coalesce("last_head.line", "line"))
    )
    if strict:
        found = found.filter(F.col("catch_at").isNull() | (F.col("catch_at") < F.col("idx")))
    return report(
        found, "ts/promise-no-catch", language=language(), line_end=F.col("end_line"),
        message=".then() has no .catch() with it; a rejection that nobody handles ends the process.",
        remediation="End the chain with .catch(), or await it inside try/catch.",
        ordinal=F.col("idx"),
    )


def assertion_roulette(rows: DataFrame) -> DataFrame:
    """``expect(true).toBe(true)`` and its kin: the same literal on both sides."""
    found = _calls(rows, "roulette")
    return report(
        found, "ts/assertion-roulette", language=language(), line_end=F.col("end_line"),
        message=say("`expect(", this.p4, ").", this.p1, "(", this.n1, ")` can never fail."),
        remediation="Assert on a value that the tested code produced.",
        ordinal=F.col("idx"),
    )


def _per_file(found: DataFrame, least) -> DataFrame:
    """Files with more than ``least`` hits, from the first to the last of them."""
    return (
        found.groupBy(*KEY)
        .agg(
            F.count("*").alias("hits"),
            F.min_by("line", "idx").alias("line"),
            F.max_by("line", "idx").alias("end_line"),
        )
        .filter(F.col("hits") > least)
    )


def excessive_mocking(rows: DataFrame, limits=None) -> DataFrame:
    found = with_limits(
        _per_file(_calls(rows, "mock").filter(test_name()), 0),
        limits, "typescript", "max_mock_calls",
    ).filter(F.col("hits") > F.col("limit_max_mock_calls"))
    return report(
        found, "ts/excessive-mocking", language=language(), line_end=F.col("end_line"),
        message=say("The test file mocks ", F.col("hits"), " modules, so it tests little but its mocks."),
        remediation="Test through the public interface, inject dependencies, or split the module.",
        ordinal=F.lit(0),
    )


def console_log_left(rows: DataFrame) -> DataFrame:
    name = base_name(F.col("path"))
    found = _per_file(
        _calls(rows, "console").filter(~_has(name, ".test.", ".spec.", "config")), CONSOLE_LIMIT
    )
    return report(
        found, "ts/console-log-left", language=language(), line_end=F.col("end_line"),
        message=say("The file writes to the console in ", F.col("hits"), " places."),
        remediation="Remove the calls or use a logger with levels.",
        ordinal=F.lit(0),
    )


def any_type_abuse(rows: DataFrame) -> DataFrame:
    found = _per_file(
        sequence_hits(rows, "any").filter(language() == "typescript"), ANY_LIMITS[0]
    )
    many = F.col("hits") > ANY_LIMITS[1]
    return report(
        found, "ts/any-type-abuse", language="typescript", line_end=F.col("end_line"),
        severity=F.when(many, "high").otherwise("medium"),
        effort=F.when(many, "days").otherwise("hours"),
        message=say("The file says `any` ", F.col("hits"), " times, which switches type checks off there."),
        remediation="Use real types, `unknown`, or type parameters.",
        ordinal=F.lit(0),
    )


def non_null_assertion(rows: DataFrame) -> DataFrame:
    found = _per_file(
        sequence_hits(rows, "nonnull").filter(language() == "typescript"), NON_NULL_LIMITS[0]
    )
    return report(
        found, "ts/non-null-assertion", language="typescript", line_end=F.col("end_line"),
        severity=F.when(F.col("hits") > NON_NULL_LIMITS[1], "high").otherwise("medium"),
        message=say("The file asserts with `!` ", F.col("hits"), " times that a value is there."),
        remediation="Check for null, or use ?. and ??.",
        ordinal=F.lit(0),
    )


def ts_ignore_proliferation(src: DataFrame) -> DataFrame:
    """Lines with a directive that silences the type checker; works on the text."""
    marked = F.filter(
        F.transform(
            F.split("content", "\n"),
            lambda x, i: F.when(_has(x, "@ts-ignore", "@ts-expect-error"), i + 1),
        ),
        lambda i: i.isNotNull(),
    )
    found = (
        src.filter(_has(F.col("content"), "@ts-ignore", "@ts-expect-error"))
        .select(*KEY, marked.alias("lines"))
        .withColumn("hits", F.size("lines"))
        .filter(F.col("hits") > IGNORE_LIMITS[0])
        .withColumn("line", F.element_at("lines", 1))
    )
    return report(
        found, "ts/ts-ignore-proliferation", language=language(),
        line_end=F.element_at("lines", -1),
        severity=F.when(F.col("hits") > IGNORE_LIMITS[1], "high").otherwise("medium"),
        message=say("The file silences the type checker ", F.col("hits"), " times."),
        remediation="Fix the types; where that cannot be, prefer @ts-expect-error.",
        ordinal=F.lit(0),
    )


def _heads(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name", js_name()).withColumn("head_line", js_head_line())


def deep_nesting(rows: DataFrame, limits=None) -> DataFrame:
    """Control statements inside each function, inner functions included.

    Bodies count with braces or without. An ``else if`` is a statement in the else branch of its
    ``if``, so a chain goes one deeper with each link, and so do the bodies along it.
    """
    deepest = statements(rows).filter("kind = 'function'").select(
        *KEY, F.col("idx").alias("open"), F.col("depth").alias("deepest"), "line", "end_line", "name"
    )
    limited = with_limits(deepest, limits, "typescript", "max_nesting_depth")
    limit = F.col("limit_max_nesting_depth")
    found = limited.filter(F.col("deepest") >= limit)
    return report(
        found, "ts/deep-nesting", language=language(), line_end=F.col("end_line"),
        severity=F.when(F.col("deepest") >= limit + 2, "high").otherwise("medium"),
        message=say("Function '", F.coalesce(F.col("name"), F.lit("<anonymous>")), "' nests ",
                    F.col("deepest"), " levels deep (threshold: ", limit.cast("int"), ")."),
        remediation="Return early, or move inner blocks into functions.",
        ordinal=F.col("open"),
    )


def god_class(rows: DataFrame, limits=None) -> DataFrame:
    """Method bodies that stand directly in a class."""
    head = F.struct(F.col("last_type.line").alias("line"), js_type_name().alias("name"), F.col("close_line").alias("end_line"))
    # a class stands for itself, a method for the bracket around it
    shares = F.array_compact(
        F.array(
            F.when(this.kind_of_block == "class", F.struct(F.col("idx").alias("open"), head.alias("head"), F.lit(0).alias("n"))),
            F.when(
                this.kind_of_block == "method",
                F.struct(
                    F.col("encl").alias("open"),
                    F.lit(None).cast("struct<line:int,name:string,end_line:int>").alias("head"), F.lit(1).alias("n"),
                ),
            ),
        )
    )
    sized = (
        rows.filter(this.kind_of_block.isin("class", "method"))
        .select(*KEY, F.explode(shares).alias("s"))
        .groupBy(*KEY, F.col("s.open").alias("encl"))
        .agg(F.max("s.head").alias("head"), F.sum("s.n").alias("methods"))
        .filter(F.col("head").isNotNull() & (F.col("methods") > 0))
        .select(*KEY, "encl", "head.*", "methods")
    )
    limited = with_limits(sized, limits, "typescript", "god_class_method_count")
    limit = F.col("limit_god_class_method_count")
    name = F.coalesce(F.col("name"), F.lit("<anonymous>"))
    return report(
        limited.filter(F.col("methods") > limit),
        "ts/god-class", language=language(), line_end=F.col("end_line"),
        severity=F.when(F.col("methods") > limit * 2, "high").otherwise("medium"),
        message=say("Class '", name, "' has ", F.col("methods"), " methods."),
        remediation=say("Split '", name, "' by the things it is responsible for."),
        ordinal=F.col("encl"),
    )


def callback_hell(rows: DataFrame) -> DataFrame:
    """Function values with three or more callbacks around them.

    A callback around a token shows at each call bracket around it: the last ``=>`` or
    ``function`` there comes after the last comma, so the token lies in that function.
    """
    expression = (this.tok == "function") & (
        (F.col("idx") != F.col("stmt")) & ~F.coalesce(this.p1.isin("export", "default"), F.lit(False))
        & ~((this.p1 == "async") & (F.col("idx") - 1 == F.col("stmt")))
    )
    wanted = (this.tok == "=>") | expression | (this.kind_of_block == "method")
    call = (
        (this.tok == "(")
        & this.p1.rlike(r"^[\p{L}_$#)\]>]")
        & ~this.p1.isin("if", "for", "while", "switch", "catch", "with", "function", "return", "typeof", "await", "of", "in", "new")
        & ~F.coalesce((this.p2 == "new") | ((this.p2 == ".") & (F.col("p4") == "new")) | (this.p2 == "function"), F.lit(False))
    )
    opener = this.tok.isin("(", "[", "{")
    depths = F.when(wanted & (F.col("inside") > 0), F.sequence(F.lit(1), F.col("inside")))
    role = "struct<place:int,part:string>"

    def part(place: Column, name: str) -> Column:
        return F.struct(place.alias("place"), F.lit(name).alias("part"))

    none = F.array().cast(f"array<{role}>")
    spread = _function_ends(rows, wanted | opener).select(
        *KEY, "idx", "line", "level", "inside", call.alias("is_call"), "last_line", "facts",
        F.explode(
            F.concat(
                F.coalesce(F.transform(depths, lambda d: part(d, "item")), none),
                F.coalesce(F.when(opener, F.array(part(F.col("level"), "open"))), none),
                F.when(this.tok == ",", F.array(part(F.col("inside"), "comma"))).otherwise(none),
                F.when((this.tok == "=>") | (this.tok == "function"), F.array(part(F.col("inside"), "function"))).otherwise(none),
            )
        ).alias("role"),
    ).select("*", "role.place", "role.part")
    # a token that is a function itself looks only at what stands before it
    before = (
        Window.partitionBy(*KEY, "place")
        .orderBy("idx", F.when(F.col("part") == "item", 0).otherwise(1))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    state = spread.withColumn(
        "opened", F.last(F.when(F.col("part") == "open", F.struct("idx", "is_call", "last_line")), ignorenulls=True).over(before)
    ).withColumn(
        "comma", F.last(F.when(F.col("part") == "comma", F.col("idx")), ignorenulls=True).over(before)
    ).withColumn(
        "func", F.last(F.when(F.col("part") == "function", F.col("idx")), ignorenulls=True).over(before)
    )
    facts = F.col("facts")
    found = (
        state.filter(F.col("part") == "item")
        .groupBy(*KEY, "idx")
        .agg(
            F.first("line").alias("own_line"),
            F.first("facts").alias("facts"),
            # before the bracket that closes the place of the function itself
            F.max(F.when(F.col("place") == F.col("inside"), F.col("opened.last_line"))).alias("place_end"),
            F.count_if(
                F.col("opened.is_call")
                & (F.col("func") > F.col("opened.idx"))
                & (F.col("func") > F.coalesce(F.col("comma"), F.lit(0)))
            ).alias("callbacks"),
        )
        .filter(F.col("callbacks") >= CALLBACK_LIMITS[0])
        .withColumn("line", F.coalesce(facts["head_line"], "own_line"))
        .withColumn("end_line", F.coalesce(facts["end_line"], F.when(~facts["is_word"], F.coalesce(facts["stop_line"], "place_end")), "line"))
    )
    return report(
        found, "ts/callback-hell", language=language(), line_end=F.col("end_line"),
        severity=F.when(F.col("callbacks") >= CALLBACK_LIMITS[1], "high").otherwise("medium"),
        message=say("A function lies inside ", F.col("callbacks"), " callbacks."),
        remediation="Use async/await, or give the inner steps names of their own.",
        ordinal=F.col("idx"),
    )


def _function_ends(rows: DataFrame, wanted: Column) -> DataFrame:
    """Wanted rows, commas and function words with ``facts`` on where a function value there ends.

    A function is known by its ``=>``, its word, or the brace of its body. A body in braces ends at
    its bracket, any other arrow body where its expression ends (``stop_line``, or the place).
    """
    order = Window.partitionBy(*KEY).orderBy("idx")
    level = Window.partitionBy(*KEY, "inside").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    word = this.tok.isin("func", "function")
    braces = (this.tok == "{") & F.col("close").isNotNull()
    arrow = this.tok == "=>"
    kept = rows.withColumn("_stop", _stops()).filter(wanted | F.col("_stop") | word | (this.tok == ",")).withColumn(
        "next_end", F.lead("close_line").over(order)
    ).withColumn(
        "next_body", F.last(F.when(braces | word, F.struct("tok", "close_line")), ignorenulls=True).over(level)
    ).withColumn(
        "stop_line", F.last(F.when(F.col("_stop"), F.col("prev_line")), ignorenulls=True).over(_later())
    )
    end = (
        F.when(this.tok == "function", F.when(F.col("next_body.tok") == "{", F.col("next_body.close_line")))
        .when(arrow, F.when(this.n1 == "{", F.col("next_end")))
        .otherwise(F.col("close_line"))
    )
    return kept.withColumn(
        "facts",
        F.struct(
            F.when(arrow & (this.p1 == ")"), F.col("last_open.line")).alias("head_line"),
            end.alias("end_line"), (this.tok == "function").alias("is_word"), "stop_line",
        ),
    )


def magic_number(rows: DataFrame) -> DataFrame:
    """Number literals, judged by their neighbours and the bracket they stand in."""
    value = F.regexp_replace(this.tok, "_", "").try_cast("double")
    number = (
        (this.kind == "number")
        & ~this.tok.endswith("n")
        & ~this.tok.rlike("^0[xXoO]")
        & (value.isNull() | ~value.isin(*TRIVIAL_NUMBERS))
        & ~test_path()
    )
    placed = _innermost(rows, number, ["tok", "kind_of_block", "after_value", "p1", "after"])
    is_params = F.coalesce(
        (F.col("outer.tok") == "(")
        & F.col("outer.after").isin("=>", "{", ":")
        & ~F.coalesce(F.col("outer.p1").isin("if", "while", "for", "switch", "catch", "with"), F.lit(False)),
        F.lit(False),
    )
    around, group, word = F.col("outer.tok"), F.col("outer.kind_of_block"), F.col("declared")
    # the literal is the whole value, not a part of a larger expression
    alone = ~F.coalesce(
        this.n1.isin(
            "*", "/", "%", "+", "-", "**", "<", ">", "<=", ">=", "===", "!==", "==", "!=",
            "?", "&&", "||", "??", ".", "as", "satisfies", "in", "instanceof",
        ),
        F.lit(False),
    )
    in_array = (around == "[") & ~F.col("outer.after_value")
    in_object = (around == "{") & (group == "literal")
    skip = (
        # const X = 5, also with a type
        ((this.p1 == "=") & (word == "const") & this.p3.isin("const", ",", ":", ".", "|", "&", "<"))
        # default values of parameters and of names taken from objects or arrays
        | ((this.p1 == "=") & (is_params | in_object | in_array))
        # data: values of arrays, values and keys of objects
        | (this.p1.isin("[", ",") & in_array)
        | (this.p1.isin(":", "{", ",") & in_object & ((this.p1 == ":") | (this.n1 == ":")))
    ) & alone
    skip = (
        F.coalesce(skip, F.lit(False))
        # list[5]
        | F.coalesce((this.p1 == "[") & (this.n1 == "]") & F.col("outer.after_value"), F.lit(False))
        # enum members and literal types
        | F.coalesce(group.isin("enum", "interface"), F.lit(False))
        | F.coalesce((word == "type") | this.p1.isin("as", "extends"), F.lit(False))
        | F.coalesce((this.p1 == ":") & ((group == "class") | is_params), F.lit(False))
        # bit masks
        | F.coalesce(this.p1.isin("|", "&", "^", "<<") | this.n1.isin("|", "&", "^", "<<"), F.lit(False))
        | F.coalesce(((this.p1 == ">") & (this.p2 == ">")) | ((this.n1 == ">") & (this.n2 == ">")), F.lit(False))
    )
    return report(
        placed.filter(~skip), "ts/magic-number", language=language(),
        message=say("Number `", this.tok, "` has no name that tells what it means."),
        remediation=say("Give ", this.tok, " a name with `const` and use the name."),
        ordinal=F.col("idx"),
    )


def _innermost(rows: DataFrame, wanted: Column, facts: list[str]) -> DataFrame:
    """Wanted rows with ``outer``, the given columns of the bracket directly around them,
    and ``declared``, the last declaring word of their statement."""
    opener = this.tok.isin("(", "[", "{")
    declares = this.tok.isin("const", "let", "var", "type", "return") & _plain()
    role = F.struct(F.col("inside").alias("place"), F.lit(False).alias("anchor"))
    anchor = F.struct(F.col("level").alias("place"), F.lit(True).alias("anchor"))
    spread = (
        rows.withColumn("wanted", F.coalesce(wanted, F.lit(False)))
        .withColumn("declares", F.coalesce(declares, F.lit(False)))
        .withColumn("after_value", F.coalesce(_value_before(), F.lit(False)))
        .filter(opener | F.col("wanted") | F.col("declares"))
        .withColumn("role", F.explode(F.when(opener, F.array(role, anchor)).otherwise(F.array(role))))
    )
    before = (
        Window.partitionBy(*KEY, "role.place").orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    is_anchor = F.col("role.anchor")
    return (
        spread.withColumn(
            "outer", F.last(F.when(is_anchor, F.struct(*facts)), ignorenulls=True).over(before)
        )
        .withColumn(
            "latest",
            F.last(F.when(F.col("declares") & ~is_anchor, F.struct("idx", "tok")), ignorenulls=True).over(before),
        )
        .filter(~is_anchor & F.col("wanted"))
        .withColumn("outer", F.when(F.col("inside") > 0, F.col("outer")))
        .withColumn("declared", F.when(F.col("latest.idx") >= F.col("stmt"), F.col("latest.tok")))
        .drop("role")
    )


def test_no_assertion(rows: DataFrame) -> DataFrame:
    """``it`` / ``test`` calls with a function as second argument and no ``expect`` in it."""
    own = ~F.coalesce(this.p2.isin(".", "?.", "function", "get", "set", "async", "*"), F.lit(False))
    call = (this.tok == "(") & this.p1.isin("it", "test") & own & F.col("close").isNotNull()
    comma, arrow = this.tok == ",", this.tok == "=>"
    part = (comma | arrow) & F.col("encl").isNotNull()
    check = (this.tok == "expect") & _plain() & (this.n1 == "(")
    # a call stands for its own bracket, commas and arrows for the one directly around them, a
    # check for all around it
    around = enclosing(
        rows.filter(test_path()).withColumn("is_call", F.coalesce(call, F.lit(False))), check,
        ["idx", "tok", "encl", "prev_line", "n1", "n2", "close_line", "is_call"], [], own=F.col("is_call") | part,
    ).withColumn(
        "call",
        F.when(F.col("outer").isNotNull(), F.col("outer.idx")).when(F.col("is_call"), F.col("idx")).otherwise(F.col("encl")),
    )
    before = Window.partitionBy(*KEY, "call").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    second = F.count_if(comma).over(before) == 1
    tests = (
        around.withColumn("in_second", second)
        .groupBy(*KEY, "call")
        .agg(
            F.max(F.when(F.col("is_call"), F.struct(F.col("prev_line").alias("line"), F.col("n1").alias("title"), F.col("close_line").alias("call_line")))).alias("head"),
            F.min(F.when(comma, F.struct("idx", "n1", "n2"))).alias("second"),
            F.count_if(arrow & F.col("in_second")).alias("arrows"),
            F.count_if((this.tok == "expect") & F.col("in_second")).alias("checks"),
        )
        .filter(F.col("head").isNotNull() & F.col("second").isNotNull())
    )
    is_function = (F.col("second.n1") == "function") | (
        (F.col("second.n1") == "async") & (F.col("second.n2") == "function")
    ) | ((F.col("arrows") > 0) & (F.col("second.n1").rlike(r"^[\p{L}_$(]")))
    found = tests.filter(is_function & (F.col("checks") == 0)).select(*KEY, "call", "head.*")
    quoted = F.col("title").rlike("^[\"'`]")
    name = F.when(
        quoted, F.regexp_replace(F.col("title"), "^[\"'`]|[\"'`]$|\\$\\{(?s:.*)$", "")
    ).otherwise("<unnamed>")
    return report(
        found, "ts/test-no-assertion", language=language(), line_end=F.col("call_line"),
        message=say("Test '", name, "' never calls expect(), so it checks nothing."),
        remediation="Add an expect() on what the test is about.",
        ordinal=F.col("call"),
    )


# Rule ids and their queries, in reporting order.
RULES = {
    "ts/deep-nesting": deep_nesting,
    "ts/magic-number": magic_number,
    "ts/assertion-roulette": assertion_roulette,
    "ts/excessive-mocking": excessive_mocking,
    "ts/god-class": god_class,
    "ts/any-type-abuse": any_type_abuse,
    "ts/callback-hell": callback_hell,
    "ts/promise-no-catch": promise_no_catch,
    "ts/console-log-left": console_log_left,
    "ts/non-null-assertion": non_null_assertion,
    "ts/eval-usage": eval_usage,
    "ts/innerhtml-assignment": innerhtml_assignment,
    "ts/test-no-assertion": test_no_assertion,
}
# Rules that read the text of a file, not its tokens.
TEXT_RULES = {"ts/ts-ignore-proliferation": ts_ignore_proliferation}
