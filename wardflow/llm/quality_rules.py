"""Quality rules: a threshold table compiled into one Spark projection.

Native on every path: text statistics are built-in array and string functions
and the rules become one boolean column, so a scan of the corpus is a single
projection without shuffle or user function.

Defined cases: a null text counts as an empty one; an empty text has no words
and fails the base rules; ratios of an empty text are 0; other columns, also
nulls and names such as ``n_words``, pass through ``keep_good`` untouched.
Repeated rows are judged row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, temp_name, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages the corpus holds.
STOP_WORDS = (
    "the of and to in is that it for was on are as with his they at be this have from or by an not a "
    "der die das und in zu den von ist mit des auf für im dem nicht ein eine als auch es "
    "le la les de et des en un une du est que qui dans pour pas au sur par avec ce "
    "el los las del que y en se por con no para su una al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """``value`` (SQL over the statistics) must lie in ``[low, high]`` once the text has ``min_words`` words."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The method's own rules, tried on texts that pass the base rules.
RULES = (
    Rule("length", "n_words", low=10),
    Rule("mean_word_length", "word_chars / n_words", low=2.0, high=15.0),
    Rule("symbol_ratio", "n_symbols / n_words", high=0.3, min_words=10),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", high=0.5),
    Rule("repeat_word_ratio", "n_repeat_words / n_words", high=0.2),
    Rule("stop_word_ratio", "n_stop_words / n_words", low=0.02, min_words=30),
)


def _repeat_words(ws: Column) -> Column:
    """Words covered by a WINDOW-word window that occurs at least twice in ``ws``.

    Windows are compared by a 64-bit hash over their words; only texts with an
    equal pair pay for the sort that finds the positions.
    """
    n = F.size(ws)

    def from_hashes(hs: Column) -> Column:
        def covered(starts: Column) -> Column:
            m = F.size(starts)
            gaps = F.transform(
                starts,
                lambda p, i: F.when(i + 1 < m, F.least(F.lit(WINDOW), F.get(starts, i + 1) - p)).otherwise(WINDOW),
            )
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        def repeated(pairs: Column) -> Column:
            same = lambda a, b: F.get(pairs, a)["h"] == F.get(pairs, b)["h"]
            flags = F.filter(
                pairs,
                lambda x, i: ((i > 0) & same(i, i - 1)) | ((i + 1 < F.size(pairs)) & same(i, i + 1)),
            )
            return F.sort_array(F.transform(flags, lambda x: x["i"]))

        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(
            let(let(pairs, repeated), covered)
        )

    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]),
    )
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, from_hashes))


def text_stats(text: Column) -> Column:
    """Struct of whole-text statistics of one string column (all bigint)."""
    text = F.coalesce(text, F.lit(""))

    def of_words(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        lowered = F.transform(ws, lambda w: F.lower(w))
        stops = F.filter(lowered, lambda w: w.isin(*sorted(set(STOP_WORDS))))
        word_chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                          (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
            .alias("lines"),
            _repeat_words(ws).alias("n_repeat_words"),
            F.size(stops).cast("long").alias("n_stop_words"),
        )

    return let(words(text), of_words)


def compile_rules(stats: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) as expressions over the statistics struct."""
    fields = {
        "n_words": stats["n_words"], "word_chars": stats["word_chars"], "n_symbols": stats["n_symbols"],
        "n_lines": stats["lines"]["n"], "n_dup_lines": stats["lines"]["dup"],
        "n_repeat_words": stats["n_repeat_words"], "n_stop_words": stats["n_stop_words"],
    }
    base_failed = (fields["n_words"] < 10) | (100 * fields["n_repeat_words"] > 20 * fields["n_words"])
    ok = F.lit(True)
    for r in rules:
        num, _, den = r.value.partition(" / ")
        value = fields[num].cast("double")
        if den:
            value = F.when(fields[den] == 0, 0.0).otherwise(value / fields[den])
        test = F.lit(True)
        if r.low is not None:
            test = test & (value >= F.lit(float(r.low)))
        if r.high is not None:
            test = test & (value <= F.lit(float(r.high)))
        ok = ok & ((fields["n_words"] < r.min_words) | test)
    return base_failed, ~base_failed & ok


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with one struct column ``quality``: the statistics, ``base_failed`` and ``kept``.

    A column of ``docs`` that is itself called ``quality`` is replaced.
    """
    s = temp_name(docs, "stats")
    with_stats = docs.withColumn(s, text_stats(F.col(text_col)))
    base_failed, kept = compile_rules(F.col(s), rules)
    st = F.col(s)
    return with_stats.withColumn(
        "quality",
        F.struct(
            st["n_words"].alias("n_words"), st["word_chars"].alias("word_chars"),
            st["n_symbols"].alias("n_symbols"), st["lines"]["dup"].alias("n_dup_lines"),
            st["n_repeat_words"].alias("n_repeat_words"), st["n_stop_words"].alias("n_stop_words"),
            st["lines"]["n"].alias("n_lines"), base_failed.alias("base_failed"), kept.alias("kept"),
        ),
    ).drop(s)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, columns unchanged."""
    s = temp_name(docs, "stats")
    staged = docs.withColumn(s, text_stats(F.col(text_col)))
    return staged.where(compile_rules(F.col(s), rules)[1]).drop(s)
