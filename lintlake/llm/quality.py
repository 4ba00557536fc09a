"""Quality rules as weak supervision.

Each rule looks at measures of a text and votes good (1), bad (-1) or abstains (0). Nobody says
which rules are right: expectation-maximisation over the counts of vote patterns estimates how
often each rule is right on good and on bad texts, and the posterior probability of being good
decides, not a requirement that all rules pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lintlake.llm.shared import arrow_schema, as_rows, cut, ddl, from_rows, ids_and_texts, row_wise

MEASURES = {
    "doc_id": "long",
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_lines": "long",
    "n_closed_lines": "long",
    "n_upper_words": "long",
    "n_plain_words": "long",
    "n_distinct_words": "long",
}
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: What may close a line of prose.
CLOSERS = (b".", b"!", b"?", b'"', b"'", b":", b";", b")", b"\xc2\xbb", b"\xe2\x80\x9d", b"\xe2\x80\xa6")
#: At most this many rules, so that the driver sees at most 3 to this power vote patterns.
MOST_RULES = 10


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def _share(part: str, whole: str, percent: float, above: bool) -> Column:
    """Exact in whole numbers: 100 * part against percent * whole."""
    left, right = 100 * F.col(part), percent * F.col(whole)
    return left > right if above else left <= right


def default_rules() -> tuple[Rule, ...]:
    return (
        Rule("length", F.col("n_words") < 15, F.col("n_words") >= 40),
        Rule("symbols", _share("n_symbols", "n_words", 25, True), _share("n_symbols", "n_words", 3, False)),
        Rule("repetition", _share("n_repeat_words", "n_words", 20, True), _share("n_repeat_words", "n_words", 5, False)),
        Rule("duplicate_lines", _share("n_dup_lines", "n_lines", 30, True), (F.col("n_lines") > 2) & _share("n_dup_lines", "n_lines", 10, False)),
        Rule("word_length", _share("word_chars", "n_words", 1200, True) | _share("word_chars", "n_words", 200, False), _share("word_chars", "n_words", 900, False) & _share("word_chars", "n_words", 300, True)),
        Rule("upper_case", _share("n_upper_words", "n_words", 50, True), _share("n_upper_words", "n_words", 10, False)),
        Rule("closed_lines", _share("n_closed_lines", "n_lines", 10, False), _share("n_closed_lines", "n_lines", 60, True)),
        Rule("plain_words", _share("n_plain_words", "n_words", 55, False), _share("n_plain_words", "n_words", 80, True)),
        Rule("variety", (F.col("n_words") >= 40) & (F.col("n_words") < 2000) & _share("n_distinct_words", "n_words", 15, False), _share("n_distinct_words", "n_words", 30, True)),
    )


def measures(docs: DataFrame) -> DataFrame:
    """The columns of :data:`MEASURES` for each row, over whole texts (null: no words).

    Words are runs of characters other than ASCII white space. Repeated rows are measured
    each, an empty table gives an empty one, other columns are left out.
    """
    return ids_and_texts(docs).mapInArrow(_measured, ddl(MEASURES))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return row_wise(batches, _measure, arrow_schema(MEASURES))


def _measure(doc_id: int | None, text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # on bytes, exactly the six ASCII white space characters
    n = len(words)
    joined = b"".join(words)
    seen: set[bytes] = set()
    lines = closed = repeated_lines = 0
    for line in data.split(b"\n"):
        if body := line.strip():
            lines += 1
            closed += body.endswith(CLOSERS)
            if line in seen:
                repeated_lines += 1
            else:
                seen.add(line)
    distinct = set(words)
    # a word's form decides, so each form is looked at once
    upper = {w for w in distinct if w.isupper() and len(w) > 1}
    odd = {w for w in distinct if not w.strip(b".,;:!?\"'()-").isalpha() and w.isascii()}
    return (
        doc_id,
        n,
        len(joined) - _continuation(joined),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        repeated_lines,
        repeat_words(words),
        lines,
        closed,
        sum(map(upper.__contains__, words)) if upper else 0,
        n - (sum(map(odd.__contains__, words)) if odd else 0),
        len(distinct),
    )


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuation(data: bytes) -> int:
    """Bytes of UTF-8 that begin no code point."""
    return 0 if data.isascii() else len(data) - len(data.translate(None, _CONTINUATION))


def repeat_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words which the text has twice or more."""
    starts = len(words) - window + 1
    if starts < 2:
        return 0
    runs = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(first := set(runs)) == starts:
        return 0
    once: set[tuple] = set()
    twice: set[tuple] = set()
    del first
    for run in runs:
        if run in once:
            twice.add(run)
        else:
            once.add(run)
    covered = end = 0
    for at, run in enumerate(runs):
        if run in twice:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def vote(measured: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``measured`` with a tinyint per rule, ``vote_<name>``."""
    zero = F.lit(0)
    return measured.withColumns({f"vote_{r.name}": F.when(r.bad, -1).when(r.good, 1).otherwise(zero).cast("tinyint") for r in rules})


@dataclass(frozen=True)
class Model:
    """``prior``: share of good texts; per rule the chances that a vote is right on a good and
    on a bad text."""

    prior: float
    right_good: dict[str, float]
    right_bad: dict[str, float]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, a in self.right_good.items():
            b = self.right_bad[name]
            total = total + F.when(F.col(f"vote_{name}") > 0, math.log(a / (1 - b))).when(F.col(f"vote_{name}") < 0, math.log((1 - a) / b)).otherwise(F.lit(0.0))
        return total


def fit(voted: DataFrame, rules: Sequence[Rule], rounds: int = 50, right: float = 0.95, caught: float = 0.4, good: float = 0.85, weight: float = 0.02) -> Model:
    """Expectation-maximisation over all rows, as counts of vote patterns.

    The driver gets one row per pattern, at most 3 ** :data:`MOST_RULES` however large the
    input. ``right`` (a vote on a good text is right), ``caught`` (one on a bad text is; low, as a
    rule sees one kind of bad text) and ``good`` (share of good texts) are where the
    estimates start and, with ``weight`` of all rows, what they are drawn to; that keeps the
    classes from changing places, and a rule that never votes keeps its start. No rows: the
    start is the model.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    names = [r.name for r in rules]
    rows = voted.groupBy(*(f"vote_{n}" for n in names)).count().collect()
    patterns = sorted((tuple(r[: len(names)]), r[len(names)]) for r in rows)
    total = sum(c for _, c in patterns)
    pull = weight * total
    prior, a, b = good, [right] * len(names), [caught] * len(names)
    for _ in range(rounds if total else 0):
        good_sum, hits = 0.0, [[0.0, 0.0, 0.0, 0.0] for _ in names]  # good right, good all, bad right, bad all
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                if v:
                    odds += math.log(a[j] / (1 - b[j])) if v > 0 else math.log((1 - a[j]) / b[j])
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good_sum += p * count
            for j, v in enumerate(votes):
                if v:
                    h = hits[j]
                    h[0] += p * count * (v > 0)
                    h[1] += p * count
                    h[2] += (1 - p) * count * (v < 0)
                    h[3] += (1 - p) * count
        prior = min(0.99, max(0.01, (good_sum + good * pull) / (total + pull)))
        a = [min(0.999, max(0.6, (h[0] + right * pull) / (h[1] + pull))) for h in hits]
        b = [min(0.999, max(0.02, (h[2] + caught * pull) / (h[3] + pull))) for h in hits]
    return Model(prior, dict(zip(names, a, strict=True)), dict(zip(names, b, strict=True)))


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated runs."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: the measures, each vote, ``base_failed``, ``p_good`` and ``kept``.

    A text that passes the base is kept if its posterior reaches ``least``; the model is
    estimated on those, as the base has settled the rest. An empty or null text has no
    words and fails the base. The measures are checkpointed, so texts are read once.
    """
    rules = default_rules() if rules is None else rules
    voted = vote(cut(measures(docs)), rules)
    model = fit(voted.where(~base_failed()), rules)
    p = 1 / (1 + F.exp(-model.log_odds()))
    return voted.withColumns({"base_failed": base_failed(), "p_good": p}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns as they are.

    The measures ride on the row itself, so rows that share an id are judged one by one and
    nothing is joined; the texts are read twice, once for the model and once for the filter.
    """
    rules = default_rules() if rules is None else rules
    model = fit(vote(measures(docs).where(~base_failed()), rules), rules)
    shaped, names = as_rows(docs)
    out = StructType(shaped.schema.fields + StructType.fromDDL(ddl({k: t for k, t in MEASURES.items() if k != "doc_id"})).fields)
    place = names.index("text")
    voted = vote(shaped.mapInArrow(lambda batches: _beside(batches, place), out), rules)
    kept = voted.where(~base_failed() & (1 / (1 + F.exp(-model.log_odds())) >= least))
    return kept.select(*from_rows(kept, names))


def _beside(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema({k: t for k, t in MEASURES.items() if k != "doc_id"})
    for batch in batches:
        rows = [_measure(None, t)[1:] for t in batch.column("row").field(place).cast(pa.string()).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=["row", *schema.names])
