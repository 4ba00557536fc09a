"""Code as relations: tokens, bracket pairs and blocks.

Every relation is keyed by ``(repo, path)``. The source rows are hash-partitioned
on that key once, *before* they are exploded into tokens; all windows and joins
below use the key (and more), so none of them shuffles again.

Nesting is never found by comparing intervals inside a file. It comes from
running sums over token order (``places``), or from ``enclosing``, which lays every wanted
token out once per bracket level around it and picks up the bracket by a window:
the work is tokens times depth, not tokens squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.places import JS_KINDS, placed
from lintlake.operators.words import GO_CONTROL, GO_KEYWORDS, GO_LINE_ENDERS, JS_CONTROL, JS_TYPE_WORDS  # noqa: F401

KEY = ("repo", "path")

# The shapes of tokens. Alternatives are tried in this order.
# Repeats are possessive, so long strings and comments do not use the stack.
JS_REGEX = r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
# A slash begins a regular expression after one of these, however far off; so the two are found
# as one match, with what lies between, and taken apart afterwards.
JS_BEFORE_REGEX = (
    r"(?:===|!==|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|%=|&=|\|=|\^=|[(,=:\[!&|?{};+]"
    r"|(?<![\p{L}\p{N}_$.#])(?:return|typeof|case|throw|delete|void|in|of|yield|await|else|do)(?![\p{L}\p{N}_$]))"
)
JS_GAP = r"(?:\s++|//[^\n]*+|/\*(?s:.*?)\*/)*+"
# A word that a regular expression can follow, from its first letter.
JS_BEFORE_WORD = (
    r"(?:return|t(?:ypeof|hrow)|case|d(?:elete|o)|void|in|of|yield|await|else)(?![\p{L}\p{N}_$])"
)
# What begins at a character is told from few alternatives first; the long ones, with regular expressions,
# are left for where one can begin.
JS_TOKENS = (
    rf"\A\s*+{JS_REGEX}"
    r"|\n"
    r"|(?=\S)(?:"
    rf"(?!{JS_BEFORE_WORD})[\p{{L}}_$#][\p{{L}}\p{{N}}_$]*+"
    r"|[)\]]"
    # with no slash behind the blanks, no regular expression and no comment before one
    r"|[(,:\[{};](?!\s*+/)"
    r"|=(?![=>]|\s*+/)"
    r"|\.(?![.0-9])"
    r"|//[^\n]*+"
    r"|/\*(?s:.*?)\*/"
    r"|`(?:[^`\\]|\\(?s:.))*+`"
    r"|\"(?:[^\"\\\n]|\\(?s:.))*+\""
    r"|'(?:[^'\\\n]|\\(?s:.))*+'"
    r"|0[xXbBoO][0-9a-fA-F_]++n?"
    r"|(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]++)?n?"
    rf"|{JS_BEFORE_REGEX}{JS_GAP}{JS_REGEX}"
    r"|[\p{L}_$#][\p{L}\p{N}_$]*+"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?="
    r"|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<"
    r"|[^\s])"
)
GO_TOKENS = (
    r"//[^\n]*+"
    r"|/\*(?s:.*?)\*/"
    r"|`[^`]*+`"
    r"|\"(?:[^\"\\\n]|\\.)*+\""
    r"|'(?:[^'\\\n]|\\.)*+'"
    r"|0[xXbBoO][0-9a-fA-F_]++i?"
    r"|(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]++)?i?"
    r"|[\p{L}_][\p{L}\p{N}_]*+"
    r"|<<=|>>=|&\^=|\.\.\.|:=|<-|&&|\|\||==|!=|<=|>=|\+\+|--|<<|>>|&\^"
    r"|\+=|-=|\*=|/=|%=|&=|\|=|\^="
    r"|\n|[^\s]"
)
TOKEN_SHAPES = {"go": GO_TOKENS, "typescript": JS_TOKENS, "javascript": JS_TOKENS}


#: So much text makes some half a million tokens.
CHARS_PER_TASK = 1_000_000


def by_file(src: DataFrame) -> DataFrame:
    """The one shuffle of the source: rows of a file together, files spread.

    The number of partitions is given, so they are not merged by the size of the text:
    the tokens that come out of it take some hundred times as much. It grows with the text, which
    one narrow pass measures, so that a task sorts its tokens in memory however much there is.
    """
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not src.isStreaming:
        chars = src.agg(F.sum(F.length("content"))).first()[0] or 0
        parts = max(parts, -(-chars // CHARS_PER_TASK))
    return src.repartition(parts, *KEY)


def _kind(tok: Column) -> Column:
    first = F.substring(tok, 1, 1)
    return (
        F.when(tok == "\n", "newline")
        .when(tok.startswith("//") | tok.startswith("/*"), "comment")
        .when((first == "`") | ((first == "}") & (F.length(tok) > 1)), "template")
        .when(first.isin('"', "'") & (F.length(tok) > 1), "string")
        .when((first == "/") & (F.length(tok) > 2), "regex")
        .when(tok.rlike(r"^\.?[0-9]"), "number")
        .when(tok.rlike(r"^[\p{L}_$#]"), "word")
        .otherwise("punct")
    )


def _all(text: Column, shape: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(shape), F.lit(group))


def _regexes_apart(toks: Column) -> Column:
    """Matches of a regular expression with what stands before it, as single tokens."""
    parts = f"^({JS_BEFORE_REGEX})({JS_GAP})({JS_REGEX})$"
    space = rf"^(\s++)({JS_REGEX})$"

    def split(tok: Column) -> Column:
        part = lambda i: F.regexp_extract(tok, parts, i)
        gap = _all(part(2), r"//[^\n]*+|/\*(?s:.*?)\*/|\n")
        first = F.substring(tok, 1, 1)
        plain = ~tok.contains("/") | first.isin("/", "`", '"', "'")
        return (
            F.when(plain, F.array(tok))
            .when(tok.rlike(parts), F.concat(F.array(part(1)), gap, F.array(part(3))))
            .when(tok.rlike(space), F.concat(_all(F.regexp_extract(tok, space, 1), r"\n"), F.array(F.regexp_extract(tok, space, 2))))
            .otherwise(F.array(tok))
        )

    return F.flatten(F.transform(toks, split))


# What stands in ``${}``, with braces up to one level deep.
_IN_TEMPLATE = r"\$\{((?:[^{}`]|\{[^{}`]*+\})*+)\}"


def _templates_apart(toks: Column) -> Column:
    """Template literals as what they are: texts joined by ``+`` with bracketed code."""

    def split(tok: Column) -> Column:
        texts, inner = F.split(tok, _IN_TEMPLATE, -1), _all(tok, _IN_TEMPLATE, 1)
        after = lambda i: F.concat(F.lit("}"), F.get(texts, i + 1), F.when(i + 1 < F.size(inner), "${").otherwise(""))
        code = F.transform(
            inner,
            lambda x, i: F.concat(
                F.array(F.lit("+"), F.lit("(")), _regexes_apart(_all(x, JS_TOKENS)), F.array(F.lit(")"), F.lit("+")), F.array(after(i))
            ),
        )
        whole = F.concat(F.array(F.concat(F.get(texts, F.lit(0)), F.lit("${"))), F.flatten(code))
        return F.when(tok.startswith("`") & tok.rlike(_IN_TEMPLATE), whole).otherwise(F.array(tok))

    return F.flatten(F.transform(toks, split))


def _tokens_of(text: Column, language: str) -> Column:
    """The tokens of a text. What takes matches apart looks at each, so only where there are such."""
    toks = _all(text, TOKEN_SHAPES[language])
    if language == "go":
        return toks
    apart = lambda t: F.when(F.exists(t, _may_part), _templates_apart(_regexes_apart(t))).otherwise(t)
    # an array of one, so the matches are found once for all that is said of them
    return F.get(F.transform(F.array(toks), apart), F.lit(0))


def _may_part(tok: Column) -> Column:
    """A match that can be more than one token: a regular expression behind others, a template with code."""
    return (tok.contains("/") & ~F.substring(tok, 1, 1).isin("/", "`", '"', "'")) | (tok.contains("${") & tok.startswith("`"))


def token_lists(src: DataFrame, language: str) -> DataFrame:
    """``(repo, path, toks)`` of each text, those of one file together."""
    found = by_file(src.select(*KEY, "content")).sortWithinPartitions(*KEY)
    return found.select(*KEY, _tokens_of(F.col("content"), language).alias("toks"))


def tokens(src: DataFrame, language: str) -> DataFrame:
    """``(repo, path, pos, tok, kind, line)`` with comments and newlines kept."""
    toks = _tokens_of(F.col("content"), language)
    # files in order, so the sort of their tokens finds them sorted
    found = by_file(src.select(*KEY, "content")).sortWithinPartitions(*KEY).select(*KEY, F.posexplode(toks).alias("pos", "tok"))
    before = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return found.select(
        *KEY,
        "pos",
        "tok",
        _kind(F.col("tok")).alias("kind"),
        (F.lit(1) + F.coalesce(F.sum(_newlines(F.col("tok"))).over(before), F.lit(0)))
        .cast("int")
        .alias("line"),
    )


def _newlines(tok: Column) -> Column:
    return F.length(tok) - F.length(F.replace(tok, F.lit("\n"), F.lit("")))


def code(lists: DataFrame, language: str) -> DataFrame:
    """Tokens that are code, with neighbours, bracket level, statement and block kind.

    ``idx`` counts code tokens from 1. ``p1..p8`` / ``n1..n6`` are the tokens before
    and after, ``fresh`` tells that a line ends before it. ``level`` is the bracket depth, counting a bracket into its own;
    ``inside`` is the depth of the place the token stands in, ``encl`` the opening
    bracket of that place and ``stmt`` the first token of the statement there.
    ``last_*`` is the latest such token of that place. On opening brackets ``close``,
    ``close_line``, ``last_line``, ``after`` and ``after2`` tell of their closing one. ``kind_of_block`` is set on
    ``{`` rows. Made of ``token_lists`` in one pass over files (``places``), with no join, no sort of
    tokens and no shuffle beyond the one of the source; what a query does not use of this is not computed.
    """
    found = placed(lists, language == "go").select("*", F.posexplode("encl").alias("i", "_encl"))
    own = lambda name: F.get(F.col(name), F.col("i"))
    here = F.col("i") + F.col("ahead")
    tok = F.get(F.col("toks"), here)
    bracket = tok.isin("(", "[", "{", ")", "]", "}")

    def of(at: Column, fact: str) -> Column:
        """A fact of the token at a place of the chunk."""
        if fact in ("idx", "line", "prev_line", "inside"):
            return F.get(F.col(fact), at)
        step = 0 if fact == "tok" else int(fact[1:]) * (-1 if fact[0] == "p" else 1)
        return F.get(F.col("toks"), at + step)

    def close(fact: str) -> Column:
        return F.when(own("close") >= 0, of(own("close"), fact))

    def latest(name: str, *facts: str) -> Column:
        at = own(name)
        return F.when(at >= 0, F.struct(*[of(at, f).alias(f) for f in ("idx", *facts)]))

    def latest_idx(name: str) -> Column:
        return F.when(own(name) > 0, F.struct(own(name).alias("idx")))

    nexts = [f"n{i}" for i in range(1, 7)]
    prev_line = F.when(of(here, "idx") > 1, of(here, "prev_line"))
    rows = found.select(
        *KEY,
        own("pos").alias("pos"),
        tok.alias("tok"),
        _kind(tok).alias("kind"),
        of(here, "line").alias("line"),
        of(here, "idx").alias("idx"),
        *[of(here, f"p{i}").alias(f"p{i}") for i in range(1, 9)],
        *[of(here, n).alias(n) for n in nexts],
        F.when(of(here, "p1").isNotNull(), _kind(of(here, "p1"))).alias("p1_kind"),
        prev_line.alias("prev_line"),
        (of(here, "inside") + F.when(bracket, 1).otherwise(0)).alias("level"),
        (prev_line < of(here, "line")).alias("fresh"),
        of(here, "inside").alias("inside"),
        close("idx").alias("close"),
        close("line").alias("close_line"),
        close("prev_line").alias("last_line"),
        close("n1").alias("after"),
        close("n2").alias("after2"),
        F.when(F.col("_encl") > 0, F.col("_encl")).alias("encl"),
        own("stmt").alias("stmt"),
        latest("func", "line", "inside", "p1", *nexts).alias("last_func"),
        latest("control", "tok", "line", "p1", "p2", *nexts).alias("last_control"),
        latest("type", "tok", "line", "n1").alias("last_type"),
        latest("open", "line", "p1", "p2", "p3").alias("last_open"),
        latest("shut", "n1").alias("last_close"),
        latest_idx("assign").alias("last_assign"),
        latest_idx("comma").alias("last_comma"),
        # where an expression such as a call chain begins
        latest("head", "line").alias("last_head"),
        *([] if language == "go" else [F.get(F.array(*[F.lit(k) for k in JS_KINDS]), own("block")).alias("kind_of_block")]),
        F.spark_partition_id().alias("_part"),
    )
    # always true, and no plan knows it: so conditions on these columns are not moved below them, where
    # each would hold the look-ups of its columns as often as it names them, and grow too long to compile
    rows = rows.filter(F.col("_part") >= 0).drop("_part")
    if language == "go":
        return rows.select("*", F.when(F.col("tok") == "{", _go_block()).alias("kind_of_block"))
    return rows


def _go_block() -> Column:
    """What a ``{`` of Go code opens, judged from its row of ``code``."""
    since = F.col("stmt")
    control = F.when(F.col("last_control.idx") >= since, F.col("last_control.idx"))
    func = F.when(
        (F.col("last_func.idx") >= since)
        # a comma in the same place ends the header of a function value
        & (F.coalesce(F.col("last_comma.idx"), F.lit(0)) < F.col("last_func.idx")),
        F.col("last_func.idx"),
    )
    p1 = F.col("p1")
    return (
        F.when(p1.isin("struct", "interface"), p1)
        .when(p1 == "else", "else")
        .when((p1 == "}") & (F.col("p2") == "{"), "literal")
        .when(func.isNotNull() & (control.isNull() | (func > control)), "func")
        # `range []T{...}` is a value, not the body of the loop
        .when(control.isNotNull() & ((F.col("p2") != "]") | (p1 == ")")), F.col("last_control.tok"))
        .when(p1.isNull() | p1.isin(";", "{", "}", ":") | (F.col("idx") == since), "bare")
        .otherwise("literal")
    )


def _js_header() -> Column:
    """Token before the parenthesis that belongs to a ``{`` of JS/TS code."""
    p1 = F.col("p1")
    open_at = F.col("last_open.idx")
    typed = (
        (F.col("last_close.idx") >= F.col("stmt"))
        & (F.col("last_close.n1") == ":")
        & ~p1.isin("=", ",", "(", ":", "[", "?", "&&", "||", "=>")
        # an initialiser or a further argument between them ends the header
        & (F.coalesce(F.col("last_assign.idx"), F.lit(0)) < open_at)
        & (F.coalesce(F.col("last_comma.idx"), F.lit(0)) < open_at)
    )
    return F.when((p1 == ")") | typed, F.col("last_open"))


def js_type_name() -> Column:
    """Name of a class or another block of a type; NULL when it has none."""
    return F.when(~F.col("last_type.n1").isin("{", "extends", "implements"), F.col("last_type.n1"))


def js_name() -> Column:
    """Name of a function, method or class block; NULL when it has none."""
    q1 = _js_header()["p1"]
    kind = F.col("kind_of_block")
    return (
        F.when((kind == "function") & ~q1.isin("function", "*"), q1)
        .when(kind == "method", q1)
        .when(kind.isin(*JS_TYPE_WORDS), js_type_name())
    )


def js_head_line() -> Column:
    """Line where the header of a function, method or class block begins."""
    kind = F.col("kind_of_block")
    return F.coalesce(
        F.when(kind.isin(*JS_TYPE_WORDS), F.col("last_type.line"))
        .when((kind == "function") & (F.col("last_func.idx") >= F.col("stmt")), F.col("last_func.line"))
        .when(
            (kind == "arrow") & (F.col("p2") == ")"), F.col("last_open.line")
        )
        .when(kind.isin("function", "method"), _js_header()["line"]),
        F.col("line"),
    )


def pairs(rows: DataFrame, *keep: str) -> DataFrame:
    """``(repo, path, bracket, open, close, open_line, close_line, after)`` of brackets."""
    return rows.filter(F.col("tok").isin("(", "[", "{") & F.col("close").isNotNull()).select(
        *KEY,
        F.col("tok").alias("bracket"),
        F.col("idx").alias("open"),
        "close",
        F.col("line").alias("open_line"),
        "close_line",
        "after",
        *keep,
    )


_ITSELF = -(2**31)


def enclosing(
    rows: DataFrame, wanted: Column, item: list[str], outer: list[str], own: Column | None = None
) -> DataFrame:
    """Each wanted token once per bracket around it.

    Output: key, the ``item`` columns, and a struct ``outer`` with ``idx`` and the
    ``outer`` columns of that bracket's row. In one place the bracket around a token
    is simply the last one opened at that level, so a window finds it.
    Tokens of ``own`` come once more with ``outer`` NULL, for themselves: what a rule would
    join to the brackets around other tokens comes out of the same pass.
    """
    opener = F.col("tok").isin("(", "[", "{")
    depths = F.when(wanted & (F.col("inside") > 0), F.sequence(F.lit(1), F.col("inside")))
    if own is not None:
        # no bracket has that level, also where closing ones are too many
        itself = F.when(own, F.array(F.lit(_ITSELF))).otherwise(F.array().cast("array<int>"))
        depths = F.concat(itself, F.coalesce(depths, F.array().cast("array<int>")))
    as_item = F.transform(
        depths, lambda d: F.struct(d.alias("place"), F.lit(False).alias("anchor"))
    )
    as_anchor = F.when(
        opener, F.array(F.struct(F.col("level").alias("place"), F.lit(True).alias("anchor")))
    )
    none = F.array().cast("array<struct<place:int,anchor:boolean>>")
    spread = rows.select(
        *KEY,
        *dict.fromkeys(["idx", *item, *outer]),
        F.explode(
            F.concat(F.coalesce(as_item, none), F.coalesce(as_anchor, none))
        ).alias("role"),
    ).select("*", "role.place", "role.anchor")
    seen = (
        Window.partitionBy(*KEY, "place")
        .orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = spread.select(
        *KEY,
        *item,
        "anchor",
        "place",
        F.last(
            F.when(F.col("anchor"), F.struct(*dict.fromkeys(["idx", *outer]))), ignorenulls=True
        )
        .over(seen)
        .alias("outer"),
    )
    return found.filter(
        ~F.col("anchor") & (F.col("outer").isNotNull() | (F.col("place") == _ITSELF))
    ).drop("anchor", "place")


def run_depth(rows: DataFrame, weight: Column, *keep: str) -> DataFrame:
    """Running sum of ``weight`` of the open blocks, as ``depth`` before each row.

    ``rows`` must hold all brackets; ``weight`` is given on opening brackets. On a
    block's own row ``depth`` does not count that block.
    """
    opener = F.col("tok").isin("(", "[", "{")
    closer = F.col("tok").isin(")", "]", "}")
    # only brackets share a level here, so before a closing one stands its opening one
    level = Window.partitionBy(*KEY, "level", "_bracket").orderBy("idx")
    order = (
        Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    )
    own = F.when(opener, F.coalesce(weight, F.lit(0))).otherwise(0)
    stepped = rows.withColumn("_own", own).withColumn("_bracket", opener | closer).withColumn(
        "_step",
        F.when(closer, -F.coalesce(F.lag("_own").over(level), F.lit(0))).otherwise(F.col("_own")),
    )
    return stepped.select(
        *KEY, *keep, F.coalesce(F.sum("_step").over(order), F.lit(0)).cast("int").alias("depth")
    )


def code_rows(src: DataFrame, language: str) -> DataFrame:
    """``code`` straight from source files."""
    return code(token_lists(src, language), language)


def blocks(rows: DataFrame) -> DataFrame:
    """Every ``{`` pair with its kind: one row per block."""
    return pairs(rows, "level", "inside", "encl", "kind_of_block").filter(
        F.col("bracket") == "{"
    )
