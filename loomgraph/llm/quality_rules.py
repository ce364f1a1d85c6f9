"""Quality rules as a short-circuit cascade of Column expressions, ordered by rejections per cost on a sample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Rows of the sample on which rule costs and selectivities are estimated. The order it gives changes speed, not results.
SAMPLE_ROWS = 2000


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable stands for it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(ws: Column) -> Column:
    """Words that lie in windows of WINDOW words whose words occur at two or more places of the text.

    Windows are compared by a 64-bit hash within one text. Only texts in which some window comes again pay for the sort
    that finds the places.
    """
    def hashes(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)])
        )

    def covered(hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            is_hash = lambda y, x: F.coalesce(y["h"] == x["h"], F.lit(False))
            same = F.filter(s, lambda x, j: is_hash(F.get(s, j - 1), x) | is_hash(F.get(s, j + 1), x))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct(
            (acc["n"] + (p + WINDOW - F.greatest(acc["end"], p)).cast("long")).alias("n"), (p + WINDOW).alias("end")
        )
        return F.aggregate(_let(placed, again), zero, step, lambda acc: acc["n"])

    none = F.lit(0).cast("long")
    distinct = lambda hs: F.size(F.array_distinct(hs)) == F.size(hs)
    counted = lambda ws: _let(hashes(ws), lambda hs: F.when(distinct(hs), none).otherwise(covered(hs)))
    # the words are bound as well: a filter that is pushed through the projection must not cut the text for each window
    return _let(ws, lambda w: F.when(F.size(w) <= WINDOW, none).otherwise(counted(w)))


@dataclass(frozen=True)
class Measures:
    """What rules ask of a document: columns that are there already, or expressions that are evaluated only when asked."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_repeat_words: Column
    dup_lines: Callable[[Callable[[Column, Column], Column]], Column]

    @property
    def letters(self) -> Column:
        return F.length(F.regexp_replace(self.text, r"\P{L}+", ""))

    @property
    def capitals(self) -> Column:
        return F.length(F.regexp_replace(self.text, r"\P{Lu}+", ""))


@dataclass(frozen=True)
class Rule:
    """A name, the condition under which a document is rejected, and the work it takes, in passes over the text."""

    name: str
    rejects: Callable[[Measures], Column]
    passes: float


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m.n_words < 20, 0.1),
        Rule("repeated_windows", lambda m: F.lit(100) * m.n_repeat_words > F.lit(30) * m.n_words, 8.0),
    ]


def default_rules() -> list[Rule]:
    """Rules of the cascade beside the base ones; thresholds are per word or per character, so alike at every length."""
    return [
        Rule("symbols_per_word", lambda m: m.n_symbols > F.lit(0.5) * m.n_words, 1.0),
        Rule("word_length", lambda m: ~m.word_chars.between(2 * m.n_words, 15 * m.n_words), 0.5),
        Rule("duplicate_lines", lambda m: m.dup_lines(lambda dup, n: F.lit(2) * dup > n), 2.0),
        Rule("letters", lambda m: F.lit(2) * m.letters < m.word_chars, 2.0),
        Rule("capitals", lambda m: F.lit(2) * m.capitals > m.letters, 4.0),
        Rule("exclamations", lambda m: F.lit(2) * F.regexp_count(m.text, F.lit("!!")) > m.n_words, 1.0),
    ]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))


def _word_chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, "")).cast("long")


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def _repeated_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def lazy(text: Column, ws: Column) -> Measures:
    """Measures of a text and its words that are made where a rule asks for them, and not before."""
    counted = lambda body: _let(_lines(text), lambda x: body(_repeated_lines(x), F.size(x)))
    return Measures(text, F.size(ws).cast("long"), _word_chars(ws), _symbols(text), repeat_words(ws), counted)


def made() -> Measures:
    """The columns of measured()."""
    c = F.col
    return Measures(
        _text(), c("n_words"), c("word_chars"), c("n_symbols"), c("n_repeat_words"), lambda body: body(c("n_dup_lines"), c("n_lines"))
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text."""
    cut = docs.withColumn("__words", words(F.col("text"))).withColumn("__lines", _lines(_text()))
    return cut.select(
        *docs.columns, F.size("__words").cast("long").alias("n_words"), _word_chars(F.col("__words")).alias("word_chars"),
        _symbols(_text()).alias("n_symbols"), F.size("__lines").cast("long").alias("n_lines"),
        _repeated_lines(F.col("__lines")).alias("n_dup_lines"), repeat_words(F.col("__words")).alias("n_repeat_words"),
    )


def plan_cascade(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules in falling order of rejections per cost, both estimated on the first `rows` documents that Spark hands out.

    A rule's cost is the characters that it reads on the sample: the passes it takes over each text, times their lengths.
    No clock is read, so the same files give the same order. One job finds all verdicts; only they and the lengths come to
    the driver, and only as many tasks run as it takes to get them. Of equal rules the cheaper one goes first, then the
    one given first. An empty table keeps the order given.
    """
    if not rules:
        return []
    verdicts = F.array(*[F.coalesce(r.rejects(made()), F.lit(False)).cast("int") for r in rules])
    sample = measured(docs.select("text")).select(F.length(_text()).alias("n"), verdicts.alias("hit")).limit(rows).collect()
    read = sum(r.n + 1 for r in sample)
    rejected = [sum(r.hit[k] for r in sample) for k in range(len(rules))]
    order = sorted(range(len(rules)), key=lambda k: (-rejected[k] / (rules[k].passes * read), rules[k].passes, k) if read else k)
    return [rules[k] for k in order]


def cascade(rules: list[Rule], m: Measures) -> Column:
    """The name of the first rule that rejects, null if none does; later rules and their measures are not evaluated."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(r.rejects(m), F.lit(r.name))
    return out


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs with the measures, base_failed, kept and rejected_by (the first rule of the cascade that rejects).

    A null, empty or blank text has no words, so it fails the base rule. Ties and repeated rows are judged alike, a text of
    any length as a whole; the verdict doesn't depend on the order of the rules. Columns of docs with the names of measures
    are not allowed here; keep_good takes any.
    """
    ordered = plan_cascade(docs, default_rules() if rules is None else rules)
    out = measured(docs)
    few, repeated = (r.rejects(made()) for r in base_rules())
    out = out.withColumn("base_failed", few | repeated)
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered, made())))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows that every rule lets through, with the columns of docs, whatever their names.

    Base rules take part in the cascade. Words are cut once; all else is made when the cascade comes to a rule that asks
    for it, so a rejected document never pays for the rules after the one that rejects it.
    """
    ordered = plan_cascade(docs, base_rules() + (default_rules() if rules is None else rules))
    rows = docs.select(F.struct("*").alias("row"), "text")
    verdict = _let(words(F.col("text")), lambda w: cascade(ordered, lazy(_text(), w)))
    return rows.where(verdict.isNull()).select("row.*")


def op7(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
