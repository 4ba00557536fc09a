"""Go rules as queries over the ``code`` relation of Go files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.hits import say, this
from lintlake.operators.relations import KEY, enclosing, run_depth
from lintlake.operators.thresholds import with_limits
from lintlake.plans.catalogue import report

# Methods that run SQL, and methods of the weak generator.
SQL_METHODS = ("Query", "Exec", "QueryRow")
RAND_METHODS = (
    "Intn", "Int", "Float64", "Float32", "Int31", "Int31n", "Int63", "Int63n",
    "Uint32", "Uint64",
)
# Parts of names that mark a file as security-sensitive.
SENSITIVE_WORDS = ("token", "secret", "password", "key")



def _sequence(name: str) -> Column:
    """Condition of a rule that is a fixed run of tokens."""
    # errors . New ( fmt . Sprintf (
    sprintf = (this.tok == "(") & (this.p1 == "Sprintf") & (F.col("p2") == ".") & (F.col("p3") == "fmt")
    errors_new = (
        (F.col("p4") == "(") & (F.col("p5") == "New") & (F.col("p6") == ".") & (F.col("p7") == "errors")
        & ~F.coalesce(F.col("p8") == ".", F.lit(False))
    )
    alone = (F.col("after") == ")") | ((F.col("after") == ",") & (F.col("after2") == ")"))
    return {
        "tls": (this.tok == "InsecureSkipVerify") & (this.n1 == ":") & (this.n2 == "true") & this.n3.isin(",", "}"),
        "rand": (this.tok == "rand") & ~F.coalesce(this.p1 == ".", F.lit(False)) & (this.n1 == ".")
        & this.n2.isin(*RAND_METHODS) & (this.n3 == "("),
        "errors.New": sprintf & errors_new & alone,
        "sql": (this.tok == "(") & this.p1.isin(*SQL_METHODS) & (F.col("p2") == "."),
    }[name]


def tls_insecure_skip(rows: DataFrame) -> DataFrame:
    """``InsecureSkipVerify: true`` in a composite literal."""
    return report(
        rows.filter(_sequence("tls")), "go/tls-insecure-skip", language="go",
        message="InsecureSkipVerify: true turns certificate checks off.",
        remediation="Keep certificate verification on; add the needed CA to the pool instead.",
        ordinal=F.col("idx"),
    )


def unchecked_error(rows: DataFrame) -> DataFrame:
    """Each blank on the left paired with each call on the right of one assignment.

    The tokens of a statement that stand directly in it are joined to a line of text,
    with blanks carrying their line number and all literals cut to ``""``; what is
    inside brackets is not part of it.
    """
    statement = [*KEY, "inside", "encl", "stmt"]
    whole = Window.partitionBy(*statement)
    shown = (
        F.when(this.tok == "_", say("_@", F.col("line")))
        .when(F.col("kind").isin("string", "template"), '""')
        .otherwise(this.tok)
    )
    texts = (
        rows.withColumn("blank", F.max((this.tok == "_").cast("int")).over(whole))
        .filter("blank = 1")
        .groupBy(*statement)
        .agg(F.sort_array(F.collect_list(F.struct("idx", shown.alias("shown")))).alias("toks"))
        .select(*KEY, "stmt", F.array_join(F.transform("toks", lambda t: t["shown"]), " ").alias("text"))
    )
    # headers hold assignments too, so cut at semicolons, colons and header words
    parts = texts.select(
        *KEY,
        "stmt",
        F.posexplode(F.split("text", r" ; | : |(?:^|(?<= ))(?:if|for|switch|else|case|select|default) ")).alias("part_no", "part"),
    ).filter(F.col("part").rlike(r"_@\d+.* :?= "))
    sides = r"^(.*?) :?= (.*)$"
    operators = r" (\+|-|\*|/|%|&&|\|\||==|!=|<|>|<=|>=|<<|>>|&|\||\^|&\^|<-) "
    blanks = F.filter(
        F.split(F.regexp_extract("part", sides, 1), " , "), lambda x: x.rlike(r"^_@\d+$")
    )
    calls = F.filter(
        F.split(F.regexp_extract("part", sides, 2), " , "),
        lambda x: x.rlike(r"[^.] \( \)$")
        & ~x.rlike(r"^(<-|!|-|\+|&|\*|\^|range) ")
        & ~x.rlike(operators),
    )
    found = parts.select(
        *KEY, "stmt", "part_no", F.posexplode(blanks).alias("blank_no", "blank"), calls.alias("calls")
    ).select(
        *KEY, "stmt", "part_no", "blank_no",
        F.substring_index("blank", "@", -1).cast("int").alias("line"),
        F.posexplode("calls").alias("call_no", "call"),
    )
    called = F.when(
        F.col("call").rlike(r"^[\p{L}_][\p{L}\p{N}_]*( \. [\p{L}_][\p{L}\p{N}_]*)* \( \)$"),
        F.regexp_replace("call", r" |\( \)$", ""),
    ).otherwise("<expr>")
    return report(
        found, "go/unchecked-error", language="go",
        message=say("The result of ", called, "() goes to `_`; an error in it is lost."),
        remediation=say("Assign the error of ", called, "() to a name and test it."),
        ordinal=F.concat_ws(":", "stmt", "part_no", "blank_no", "call_no"),
    )


def bare_goroutine(rows: DataFrame) -> DataFrame:
    """``go`` statements without a ``recover()`` call in what they start."""
    go = (this.tok == "go") & ~F.coalesce(this.p1 == ".", F.lit(False))
    guard = (this.tok == "recover") & (this.n1 == "(") & (this.p1 != ".")
    place = ["encl", "stmt", "inside"]
    # brackets that stand in the very statement of the `go` word hold its call
    seen = enclosing(rows, guard, ["idx", "line", *place], place, own=go).select(
        *KEY, "idx", "line", F.col("outer.idx").alias("guarded"),
        *[F.when(F.col("outer").isNull(), F.col(c)).otherwise(F.col(f"outer.{c}")).alias(c) for c in place],
    )
    last_guard = F.max("guarded").over(Window.partitionBy(*KEY, *place))
    found = seen.withColumn("last_guard", last_guard).filter(
        F.col("guarded").isNull() & (F.col("last_guard").isNull() | (F.col("last_guard") < F.col("idx")))
    )
    return report(
        found, "go/bare-goroutine", language="go",
        message="A goroutine starts without recover(); a panic in it ends the whole program.",
        remediation="Defer a function that calls recover() as the first step of the goroutine.",
        ordinal=F.col("idx"),
    )


def _declares() -> Column:
    """The ``func`` that begins a declaration."""
    return (this.tok == "func") & (F.col("inside") == 0) & (F.col("idx") == F.col("stmt"))


def _functions(rows: DataFrame) -> DataFrame:
    """Function and method declarations with name, receiver and body.

    A declaration stands at bracket level 0; its number counts the ``func`` words
    there, so every token of the file carries the number of its declaration.
    """
    order = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("decl", F.sum(F.when(_declares(), 1).otherwise(0)).over(order)).filter(
        F.col("decl") > 0
    )


def _name() -> Column:
    """Aggregate over the tokens of a declaration: its name."""
    named = (F.col("kind") == "word") & (F.col("inside") == 0) & (this.tok != "func")
    return F.min(F.when(named, F.struct("idx", "tok")))["tok"]


def deep_nesting(rows: DataFrame, limits=None) -> DataFrame:
    """Deepest if/for/switch/select per declaration; closures are not entered."""
    # brackets make the depth, what stands outside of them the name of the declaration
    counted = rows.filter(this.tok.isin("(", "[", "{", ")", "]", "}", "func") | (F.col("inside") == 0))
    kind = F.col("kind_of_block")
    control = kind.isin("if", "for", "switch", "select")
    # a label directly before the word hides the statement
    labeled = (
        (F.col("last_control.p1") == ":")
        & (F.col("last_control.idx") - 2 == F.col("stmt"))
        & (F.col("last_control.p2") != "default")
    )
    # Closures and brackets of expressions weigh far more than any depth, which marks
    # all that lies in them; an `else` block weighs nothing, it is a sibling of its `if`.
    beyond = 1_000_000
    weight = (
        F.when(this.tok.isin("(", "[") | (kind == "literal"), beyond)
        .when((kind == "func") & (F.col("inside") > 0), beyond)
        .when(control & labeled, beyond)
        .when(control, 1)
        .otherwise(0)
    )
    depth = run_depth(
        _functions(counted).withColumn("counted", control & ~labeled), weight,
        "decl", "counted", "idx", "line", "tok", "kind", "inside", "kind_of_block", "close_line",
    )
    body = (this.tok == "{") & (kind == "func") & (F.col("inside") == 0)
    nested = F.when(F.col("counted") & (F.col("depth") < beyond), F.col("depth"))
    deepest = (
        depth.groupBy(*KEY, "decl")
        .agg(
            (F.max(nested) + 1).alias("deepest"),
            F.min_by("line", "idx").alias("line"),
            _name().alias("name"),
            F.min(F.when(body, F.struct("idx", "close_line")))["close_line"].alias("end_line"),
        )
        .filter(F.col("deepest").isNotNull())
    )
    limited = with_limits(deepest, limits, "go", "max_nesting_depth")
    limit = F.col("limit_max_nesting_depth")
    found = limited.filter(F.col("deepest") >= limit)
    return report(
        found, "go/deep-nesting", language="go", line_end=F.col("end_line"),
        severity=F.when(F.col("deepest") >= limit + 2, "high").otherwise("medium"),
        message=say("Function '", F.col("name"), "' nests ", F.col("deepest"),
                    " levels deep (threshold: ", limit.cast("int"), ")."),
        remediation="Return early, move inner blocks into functions, or use a table of cases.",
        ordinal=F.col("decl"),
    )


def god_struct(rows: DataFrame, limits=None) -> DataFrame:
    """Methods per receiver type in one file."""
    r1, r2, r3, r4 = (F.col(c) for c in ("r1", "r2", "r3", "r4"))
    # receiver is `(T)`, `(*T)`, `(t T)` or `(t *T)`
    receiver = (
        F.when(r2 == ")", r1)
        .when((r1 == "*") & (r3 == ")"), r2)
        .when(r3 == ")", r2)
        .when((r2 == "*") & (r4 == ")"), r3)
    )
    # the first token of a method is a row of its own, with what follows it
    names = {f"r{i}": F.col(f"n{i + 1}") for i in range(1, 5)}
    methods = (
        rows.filter(_declares() & (F.col("n1") == "("))
        .withColumns(names)
        .withColumn("receiver", receiver)
        .filter(F.col("receiver").isNotNull())
        .groupBy(*KEY, "receiver")
        .agg(F.count("*").alias("methods"), F.min_by("line", "idx").alias("line"))
    )
    limited = with_limits(methods, limits, "go", "god_struct_method_count")
    limit = F.col("limit_god_struct_method_count")
    return report(
        limited.filter(F.col("methods") > limit), "go/god-struct", language="go",
        severity=F.when(F.col("methods") > limit * 2, "high").otherwise("medium"),
        message=say("Type '", F.col("receiver"), "' has ", F.col("methods"), " methods in one file."),
        remediation=say("Split '", F.col("receiver"), "' into types that each do one thing."),
        ordinal=F.col("receiver"),
    )


def magic_number(rows: DataFrame, limits=None) -> DataFrame:
    """Literals outside top-level constants and named top-level variables."""
    order = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("idx") == F.col("stmt")
    top = starts & (F.col("inside") == 0)
    # the top-level declaration a token belongs to, and the spec inside `var ( ... )`
    marked = rows.withColumn("head", F.last(F.when(top, F.struct("idx", "tok", "n1")), ignorenulls=True).over(order))
    grouped = starts & (F.col("inside") == 1) & (F.col("head.n1") == "(")
    marked = marked.withColumn(
        "spec",
        F.last(
            F.when(grouped, F.struct("idx", this.tok.alias("name"))).when(top, F.struct("idx", this.n1.alias("name"))),
            ignorenulls=True,
        ).over(order),
    )
    named = (F.col("head.tok") == "var") & (F.length("spec.name") > 1)
    literal = (
        (F.col("kind") == "number")
        & ~this.tok.endswith("i")
        & ~F.col("path").endswith("_test.go")
        & ~this.tok.rlike("^0[xX]")
        & ~(this.tok.rlike("^0[0-9_bBoO]") & ~this.tok.contains(".") & ~this.tok.rlike("^[0-9_]+[eE]") & (F.length(this.tok) >= 3))
        & ~((F.col("head.tok") == "const") | named)
    )
    limited = with_limits(marked.filter(literal), limits, "go", "magic_number_allowed")
    # the allow-list holds the spelling of a literal, so 1.0 is not 1
    allowed = F.transform(
        "limit_magic_number_allowed",
        lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string")),
    )
    return report(
        limited.filter(~F.array_contains(allowed, this.tok)), "go/magic-number", language="go",
        message=say("Number `", this.tok, "` has no name that tells what it means."),
        remediation=say("Give ", this.tok, " a name with `const` and use the name."),
        ordinal=F.col("idx"),
    )


def _parameters(rows: DataFrame) -> DataFrame:
    """Parameters of declarations, one row per name, with field number and type.

    Tokens of the parameter bracket are cut at commas. A piece that is only a name
    takes the type of the next piece that has both, as in ``a, b any``. Each row has the
    ``line`` and the ``name`` of its declaration.
    """
    top = F.col("inside") == 0
    decl = Window.partitionBy(*KEY, "decl").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    # the parameter bracket is the first one, or the second one after a receiver
    every = Window.partitionBy(*KEY, "decl")
    listed = (
        _functions(rows)
        .withColumn("name", F.min(F.when((F.col("kind") == "word") & top & (this.tok != "func"), F.struct("idx", "tok"))).over(every)["tok"])
        .withColumn("decl_line", F.first("line").over(decl))
        .withColumn("group", F.sum(F.when(top & (this.tok == "("), 1).otherwise(0)).over(decl))
        .withColumn("wanted", F.first(F.when(this.n1 == "(", 2).otherwise(1)).over(decl))
        .withColumn("closed", F.sum(F.when(top & (this.tok == ")"), 1).otherwise(0)).over(decl))
        .filter((F.col("group") == F.col("wanted")) & (F.col("closed") < F.col("wanted")) & ~top)
    )
    comma = (this.tok == ",") & (F.col("inside") == 1)
    pieces = (
        listed.withColumn("piece", F.sum(F.when(comma, 1).otherwise(0)).over(decl))
        .filter(~comma)
        .groupBy(*KEY, "decl", "piece")
        .agg(
            F.sort_array(F.collect_list(F.struct("idx", "tok"))).alias("toks"),
            F.min("decl_line").alias("line"),
            F.min("name").alias("name"),
        )
        .withColumn("text", F.array_join(F.transform("toks", lambda t: t["tok"]), " "))
    )
    name = r"^(?!(?:func|map|chan|struct|interface) )[\p{L}_][\p{L}\p{N}_]* "
    typed = F.col("text").rlike(name + r"(?!\. )")
    back = every.orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = every.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.withColumn("typed", typed.cast("int"))
        .withColumn("named", F.max("typed").over(every) == 1)
        .select(
            *KEY,
            "decl",
            "line",
            "name",
            "piece",
            F.when(
                F.col("named"),
                F.last(
                    F.when(F.col("typed") == 1, F.regexp_replace("text", name, "")), ignorenulls=True
                ).over(back),
            )
            .otherwise(F.col("text"))
            .alias("type"),
            # unnamed parameters are a field each
            F.when(F.col("named"), F.coalesce(F.sum("typed").over(ahead), F.lit(0)))
            .otherwise(F.col("piece"))
            .alias("field"),
        )
    )


def empty_interface_abuse(rows: DataFrame) -> DataFrame:
    """Three or more parameters of type ``any`` / ``interface{}``, by name."""
    found = (
        _parameters(rows)
        .filter(F.col("type").isin("any", "interface { }"))
        .groupBy(*KEY, "decl", "line", "name")
        .agg(F.count("*").alias("loose"))
        .filter(F.col("loose") >= 3)
    )
    return report(
        found, "go/empty-interface-abuse", language="go",
        message=say("Function '", F.col("name"), "' takes ", F.col("loose"),
                     " parameters of any type, so the compiler checks none of them."),
        remediation="Use concrete types, type parameters, or a small interface.",
        ordinal=F.col("decl"),
    )


def context_not_first(rows: DataFrame) -> DataFrame:
    """``context.Context`` in a later field while the first field is something else."""
    is_context = F.col("type") == "context . Context"
    found = (
        _parameters(rows)
        .groupBy(*KEY, "decl", "line", "name")
        .agg(
            F.max(F.when(is_context, F.col("field"))).alias("last_context"),
            F.min(F.when(is_context, F.col("field"))).alias("first_context"),
        )
        .filter((F.col("first_context") > 0) & (F.col("last_context") > 0))
    )
    return report(
        found, "go/context-not-first", language="go",
        message=say("Function '", F.col("name"), "' takes a context.Context after other parameters."),
        remediation=say("Make the context the first parameter of ", F.col("name"), "."),
        ordinal=F.col("decl"),
    )


def large_interface(rows: DataFrame, limits=None) -> DataFrame:
    """Members of each named interface, embedded ones included."""
    p2 = F.col("p2")
    opened = (
        (F.col("kind_of_block") == "interface")
        & p2.rlike(r"^[\p{L}_]")
        & (
            (F.col("p3") == "type")
            # a spec inside `type ( ... )`
            | ((F.col("stmt") == F.col("idx") - 2) & (F.col("around") == "group"))
        )
    )
    starts = (F.col("idx") == F.col("stmt")) | (this.p1 == ";")
    member = starts & (F.col("around") == "interface") & ~this.tok.isin(")", "]", "}")
    # a bracket stands for itself, a member for the bracket around it
    shares = F.array_compact(
        F.array(
            F.when(opened, F.struct(F.col("idx").alias("open"), F.struct("line", p2.alias("name")).alias("head"), F.lit(0).alias("n"))),
            F.when(member, F.struct(F.col("encl").alias("open"), F.lit(None).cast("struct<line:int,name:string>").alias("head"), F.lit(1).alias("n"))),
        )
    )
    sized = (
        enclosing_kind(rows)
        .select(*KEY, F.explode(shares).alias("s"))
        .groupBy(*KEY, F.col("s.open").alias("encl"))
        .agg(F.max("s.head").alias("head"), F.sum("s.n").alias("members"))
        .filter(F.col("head").isNotNull() & (F.col("members") > 0))
        .select(*KEY, "encl", "head.line", "head.name", "members")
    )
    limited = with_limits(sized, limits, "go", "max_interface_methods")
    limit = F.col("limit_max_interface_methods")
    return report(
        limited.filter(F.col("members") > limit), "go/large-interface", language="go",
        severity=F.when(F.col("members") > limit * 2, "high").otherwise("medium"),
        message=say("Interface '", F.col("name"), "' has ", F.col("members"), " methods."),
        remediation=say("Split '", F.col("name"), "' so that each user asks only for what it calls."),
        ordinal=F.col("encl"),
    )


def init_side_effects(rows: DataFrame) -> DataFrame:
    """``init`` functions of more than five statements, blocks counted as one each."""
    kind = F.col("kind_of_block")
    decl = Window.partitionBy(*KEY, "decl").orderBy("idx")
    upto = decl.rowsBetween(Window.unboundedPreceding, 0)
    functions = _functions(rows).withColumn(
        "is_init", F.first((this.tok == "func") & (this.n1 == "init") & (this.n2 == "(")).over(upto)
    )
    # what follows the body, up to the next declaration, is not part of it
    inits = functions.filter("is_init").withColumn(
        "ended",
        F.coalesce(
            F.max(F.when((this.tok == "}") & (F.col("inside") == 0), 1)).over(
                decl.rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).filter("ended = 0")
    block_kinds = ("if", "else", "for", "switch", "select", "func", "bare")
    in_block = F.col("around").isin(*block_kinds)
    block = (this.tok == "{") & kind.isin(*block_kinds)
    starts = in_block & (F.col("idx") == F.col("stmt")) & ~this.tok.isin(")", "]", "}", ";")
    in_for = (F.col("last_control.tok") == "for") & (F.col("last_control.idx") >= F.col("stmt"))
    empty_part = (this.p1 == "for") | (in_for & (this.n1 == "{")) | (this.n1 == "}")
    points = [
        starts & ~((this.tok == "{") & (kind == "bare")),
        block,
        # `else if` is a statement of its own, and so are the parts of a header
        (this.tok == "if") & (this.p1 == "else"),
        (this.tok == ";") & in_block & ~empty_part,
        # the statement behind `case x:`, what a select case waits for, a type guard
        (this.tok == ":") & in_block & ~F.col("next_starts") & (this.n1 != "}"),
        (this.tok == "case") & (F.col("around") == "select"),
        (this.tok == "type") & (this.p1 == "(") & (this.n1 == ")") & (F.col("p2") == "."),
    ]
    total = sum((F.coalesce(p.cast("int"), F.lit(0)) for p in points), F.lit(0))
    found = (
        enclosing_kind(inits)
        .groupBy(*KEY, "decl")
        .agg(
            F.sum(total).alias("statements"),
            F.min("idx").alias("idx"),
            F.min_by("line", "idx").alias("line"),
            F.max_by("line", "idx").alias("end_line"),
        )
        .filter(F.col("statements") > 5)
    )
    return report(
        found, "go/init-side-effects", language="go", line_end=F.col("end_line"),
        message=say("init() runs ", F.col("statements"), " statements before main, hidden from tests."),
        remediation="Move the work into a function that the program calls and tests can call too.",
        ordinal=F.col("idx"),
    )


def enclosing_kind(rows: DataFrame) -> DataFrame:
    """Add ``around``, the kind of the block a token stands in directly."""
    opener = this.tok.isin("(", "[", "{")
    order = Window.partitionBy(*KEY).orderBy("idx")
    marked = rows.withColumn(
        "next_starts", F.coalesce(F.lead("stmt").over(order) == F.lead("idx").over(order), F.lit(True))
    )
    role = F.struct(F.col("inside").alias("place"), F.lit(False).alias("anchor"))
    anchor = F.struct(F.col("level").alias("place"), F.lit(True).alias("anchor"))
    spread = marked.select(
        "*", F.explode(F.when(opener, F.array(role, anchor)).otherwise(F.array(role))).alias("role")
    )
    at = (
        Window.partitionBy(*KEY, "role.place")
        .orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    kind = F.when(F.col("role.anchor"), F.coalesce(F.col("kind_of_block"), F.lit("group")))
    return (
        spread.withColumn("around", F.last(kind, ignorenulls=True).over(at))
        .filter(~F.col("role.anchor"))
        .drop("role")
    )


def _called(column_prefix: str = "n") -> Column:
    """Dotted name that follows a word, up to two dots; else ``<expr>``."""
    c = [F.col(f"{column_prefix}{i}") for i in range(1, 7)]
    return (
        F.when((c[1] == "(") & (c[0] != "func"), c[0])
        .when((c[1] == ".") & (c[3] == "("), say(c[0], ".", c[2]))
        .when((c[1] == ".") & (c[3] == ".") & (c[5] == "("), say(c[0], ".", c[2], ".", c[4]))
        .otherwise("<expr>")
    )


def defer_in_loop(rows: DataFrame) -> DataFrame:
    """Each ``defer`` once per loop around it within the file's functions."""
    any_defer = this.tok == "defer"
    around = enclosing(
        rows.withColumn("called", _called()).withColumn("plain", ~F.coalesce(this.p1 == ".", F.lit(False))),
        any_defer, ["idx", "line", "called", "plain", "stmt", "inside"],
        ["kind_of_block", "stmt", "inside"], own=any_defer,
    )
    # a defer inside another defer's call, both in the loop, is not looked at: the bracket of that
    # call stands in the other's statement, behind it
    itself = F.col("outer").isNull()
    in_statement = Window.partitionBy(*KEY, "at_stmt", "at_inside").orderBy("at").rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_defer = Window.partitionBy(*KEY, "idx")
    loops = (
        around.withColumn("at_stmt", F.when(itself, F.col("stmt")).otherwise(F.col("outer.stmt")))
        .withColumn("at_inside", F.when(itself, F.col("inside")).otherwise(F.col("outer.inside")))
        .withColumn("at", F.when(itself, F.col("idx")).otherwise(F.col("outer.idx")))
        .withColumn("before", F.max(F.when(itself, F.col("idx"))).over(in_statement))
        .withColumn("defer_at", F.max(F.when(~itself, F.col("before"))).over(per_defer))
        .filter(F.col("plain") & (F.col("outer.kind_of_block") == "for"))
        .filter(F.col("defer_at").isNull() | (F.col("defer_at") < F.col("outer.idx")))
    )
    return report(
        loops, "go/defer-in-loop", language="go",
        message=say("defer ", F.col("called"), "() stands in a loop; it runs when the function ends, not each round."),
        remediation="Put the loop body into a function of its own, or release the resource in the loop.",
        ordinal=say(F.col("idx"), ":", F.col("outer.idx")),
    )


def error_string_format(rows: DataFrame) -> DataFrame:
    """``errors.New(fmt.Sprintf(...))`` and nothing else in the outer call."""
    found = rows.filter(_sequence("errors.New"))
    return report(
        found, "go/error-string-format", language="go",
        message="errors.New(fmt.Sprintf(...)) spells out what fmt.Errorf does.",
        remediation="Call fmt.Errorf; %w in it keeps the wrapped error.",
        ordinal=F.col("idx"),
    )


def _loop_variable() -> Column:
    """Variable of a ``for`` header: key, or value when the key is blank."""
    n = [F.col(f"last_control.n{i}") for i in range(1, 7)]
    name_like = r"^[\p{L}_][\p{L}\p{N}_]*$"
    ranged = F.when(
        n[0].rlike(name_like) & n[1].isin(":=", "=") & (n[2] == "range") & (n[0] != "_"), n[0]
    ).when(
        n[0].rlike(name_like) & (n[1] == ",") & n[2].rlike(name_like) & n[3].isin(":=", "=") & (n[4] == "range"),
        F.when(n[0] != "_", n[0]).when(n[2] != "_", n[2]),
    )
    counted = F.when(
        n[0].rlike(name_like)
        & (
            (n[1].isin(":=", "=") & (n[2] != "range"))
            | ((n[1] == ",") & n[3].isin(":=", "=") & (n[4] != "range"))
        ),
        n[0],
    )
    return F.coalesce(ranged, counted)


def goroutine_closure_capture(rows: DataFrame) -> DataFrame:
    """``go func() {...}`` in a loop whose body names the loop's variable."""
    kind = F.col("kind_of_block")
    facts = rows.withColumn(
        "variable", F.when((this.tok == "{") & (kind == "for"), _loop_variable())
    ).withColumn(
        "started",
        # the body of a function literal that a `go` word starts
        F.when(
            (this.tok == "{") & (kind == "func") & (F.col("last_func.p1") == "go"),
            F.struct((F.col("last_func.idx") - 1).alias("idx"), F.col("last_func.line").alias("line")),
        ),
    )
    around = enclosing(
        facts, (F.col("kind") == "word") | F.col("started").isNotNull(), ["tok", "started"], ["started", "variable"]
    )
    # a word in the body, and the body in a loop with that variable, meet under its name
    named = F.when(F.col("started").isNull() & F.col("outer.started").isNotNull(), F.struct(
        F.col("outer.started").alias("go"), F.col("tok").alias("variable"), F.lit(None).cast("int").alias("loop")))
    looped = F.when(F.col("started").isNotNull() & F.col("outer.variable").isNotNull(), F.struct(
        F.col("started").alias("go"), F.col("outer.variable").alias("variable"), F.col("outer.idx").alias("loop")))
    found = (
        around.select(*KEY, F.coalesce(named, looped).alias("s"))
        .filter(F.col("s").isNotNull())
        .groupBy(*KEY, F.col("s.go.idx").alias("go_at"), F.col("s.go.line").alias("line"), F.col("s.variable").alias("variable"))
        .agg(F.collect_set("s.loop").alias("loops"), F.count_if(F.col("s.loop").isNull()).alias("uses"))
        .filter(F.col("uses") > 0)
        .select(*KEY, "go_at", "line", "variable", F.explode("loops").alias("loop"))
    )
    return report(
        found, "go/goroutine-closure-capture", language="go",
        message=say("The goroutine uses loop variable '", F.col("variable"), "' itself, not its value of this round."),
        remediation=say("Hand '", F.col("variable"), "' to the function as an argument."),
        ordinal=say(F.col("go_at"), ":", F.col("loop")),
    )


def sql_string_concat(rows: DataFrame) -> DataFrame:
    """SQL methods whose first argument is joined with ``+``."""
    # the operators that stand directly in the argument list
    weaker = ("==", "!=", "<", ">", "<=", ">=", "&&", "||")
    signs = ("(", ",", "+", "-", "*", "/", "%", *weaker)
    call, part = _sequence("sql"), this.tok.isin(",", "+", *weaker)
    end = F.coalesce(F.col("comma"), F.lit(2**31 - 1))
    found = (
        rows.filter(call | (part & F.col("encl").isNotNull()))
        # a call stands for its own bracket
        .withColumn("open", F.when(part, F.col("encl")).otherwise(F.col("idx")))
        .groupBy(*KEY, F.col("open").alias("idx"))
        .agg(
            F.max(F.when(~part, F.struct("line", this.p1.alias("method")))).alias("call"),
            F.min(F.when(this.tok == ",", F.col("idx"))).alias("comma"),
            F.min(F.when((this.tok == "+") & ~this.p1.isin(*signs), F.col("idx"))).alias("plus"),
            F.min(F.when(this.tok.isin(*weaker), F.col("idx"))).alias("weaker"),
        )
        .filter(F.col("call").isNotNull() & (F.col("plus") < end))
        .filter(F.col("weaker").isNull() | (F.col("weaker") > end))
        .select(*KEY, "idx", "call.line", "call.method")
    )
    return report(
        found, "go/sql-string-concat", language="go",
        message=say("The query text of ", F.col("method"), "() is joined from pieces, which opens it to SQL injection."),
        remediation=say("Write placeholders in the query of ", F.col("method"), "() and pass the values as arguments."),
        ordinal=F.col("idx"),
    )


def weak_rand(rows: DataFrame) -> DataFrame:
    """``rand.X()`` calls in files that import crypto or use sensitive names."""
    sensitive = F.lit(False)
    for part in SENSITIVE_WORDS:
        sensitive = sensitive | F.lower(this.tok).contains(part)
    order = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(
        F.when((F.col("inside") == 0) & (F.col("idx") == F.col("stmt")), F.struct("idx", "tok")),
        ignorenulls=True,
    ).over(order)
    crypto = F.col("kind").isin("string", "template") & this.tok.contains("crypto") & (F.col("head.tok") == "import")
    suspect = crypto | ((F.col("kind") == "word") & sensitive)
    found = (
        rows.filter((F.col("idx") == F.col("stmt")) | F.col("kind").isin("string", "template", "word"))
        .withColumn("head", head)
        .withColumn("suspect", F.max(F.coalesce(suspect, F.lit(False))).over(Window.partitionBy(*KEY)))
        .filter(F.col("suspect") & _sequence("rand"))
    )
    return report(
        found, "go/weak-rand", language="go",
        message=say("rand.", this.n2, "() feeds code that handles secrets, but its numbers can be guessed."),
        remediation="Draw security-relevant values from crypto/rand.",
        ordinal=F.col("idx"),
    )


# Rule ids and their queries, in reporting order.
RULES = {
    "go/unchecked-error": unchecked_error,
    "go/bare-goroutine": bare_goroutine,
    "go/deep-nesting": deep_nesting,
    "go/god-struct": god_struct,
    "go/magic-number": magic_number,
    "go/empty-interface-abuse": empty_interface_abuse,
    "go/context-not-first": context_not_first,
    "go/large-interface": large_interface,
    "go/init-side-effects": init_side_effects,
    "go/defer-in-loop": defer_in_loop,
    "go/error-string-format": error_string_format,
    "go/goroutine-closure-capture": goroutine_closure_capture,
    "go/tls-insecure-skip": tls_insecure_skip,
    "go/sql-string-concat": sql_string_concat,
    "go/weak-rand": weak_rand,
}
