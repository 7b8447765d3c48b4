"""Quality rules: one threshold table compiled into one projection.

Every measure and every rule is a Spark expression; no user function and no shuffle. A text is split into words once, a
text that repeats no three-word window (a hash set tells) never reaches the sort that finds which words are repeated.

Defined results: a null or blank text has no words and is not kept; ties do not arise; repeated rows are judged alike;
further columns pass untouched, whatever their names. Windows are compared by their 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.llm.common import BLANKS, field

SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages in use.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "by", "this", "are",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "est",
    "der", "die", "das", "und", "den", "von", "mit", "sich", "ein", "eine", "auf", "nicht", "ist", "zu",
    "el", "los", "las", "y", "que", "del", "se", "con", "por", "una", "su", "al",
)


@dataclass(frozen=True)
class Rule:
    """Keep a text whose ``measure`` lies in [low, high]; None leaves an end open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Lengths are in words and code points, ratios are shares of the named total.
RULES = (
    Rule("n_words", 50, None),
    Rule("repeat_word_ratio", None, 0.5),
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.05),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (also inside its lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words between blanks; empty for a null text."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def windows_of(words: Column) -> Column:
    """One hash per three-word window."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    rows = F.arrays_zip(
        F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"), F.slice(words, F.lit(3), n).alias("c")
    )
    return F.transform(rows, lambda w: F.xxhash64(w["a"], w["b"], w["c"]))


def _covered(windows: Column) -> Column:
    """Words that lie in a window found more than once."""

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        return F.transform(
            s,
            lambda x, i: F.when(
                ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"]))
                | ((i < last) & (x["h"] == F.get(s, F.least(i + 1, last))["h"])),
                x["i"],
            ),
        )

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.sort_array(F.filter(let(placed, repeated), lambda p: p.isNotNull()))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n"), (p + 3).alias("end")),
        lambda s: s["n"],
    )


def measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures as further columns, each named with ``prefix``."""
    kept = [field(c) for c in docs.columns]
    p, body = prefix, F.coalesce(field(text), F.lit(""))
    out = docs.select(*kept, words_of(body).alias(f"{p}words"), F.split(body, "\n").alias(f"{p}lines"))
    w = F.col(f"{p}words")
    full = F.filter(F.col(f"{p}lines"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = out.select(*kept, w, windows_of(w).alias(f"{p}windows"), full.alias(f"{p}lines"))
    n, windows, lines = F.size(w), F.col(f"{p}windows"), F.col(f"{p}lines")
    unique = F.size(F.array_distinct(windows)) == F.size(windows)
    stops = list(dict.fromkeys(STOP_WORDS))
    return out.select(
        *kept,
        n.cast("long").alias(f"{p}n_words"),
        F.length(F.translate(body, BLANKS, "")).cast("long").alias(f"{p}word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias(f"{p}n_symbols"),
        F.size(lines).cast("long").alias(f"{p}n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        F.when(unique, F.lit(0)).otherwise(_covered(windows)).cast("long").alias(f"{p}n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias(f"{p}n_stop_words"),
    )


def ratios(prefix: str = "") -> dict[str, Column]:
    """The measures that rules may name."""

    def m(name: str) -> Column:
        return field(prefix + name)

    words = F.greatest(m("n_words"), F.lit(1))
    return {
        "n_words": m("n_words"),
        "word_chars": m("word_chars"),
        "mean_word_length": m("word_chars") / words,
        "symbol_ratio": m("n_symbols") / F.greatest(m("word_chars"), F.lit(1)),
        "stop_word_ratio": m("n_stop_words") / words,
        "dup_line_ratio": m("n_dup_lines") / F.greatest(m("n_lines"), F.lit(1)),
        "repeat_word_ratio": m("n_repeat_words") / words,
    }


def compiled(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """The threshold table as one boolean expression."""
    known, verdict = ratios(prefix), F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (known[rule.measure] >= rule.low)
        if rule.high is not None:
            verdict = verdict & (known[rule.measure] <= rule.high)
    return verdict


def base_failed(prefix: str = "") -> Column:
    """Under 50 words, or more than half of the words in repeated windows."""
    n, again = field(prefix + "n_words"), field(prefix + "n_repeat_words")
    return (n < 50) | (100 * again > 50 * n)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, measures, ``base_failed`` and ``kept``."""
    out = measures(docs.select(field(key), field(text)), text)
    out = out.select("*", base_failed().alias("base_failed"))
    return out.select(
        field(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & compiled(rules)).alias("kept"), "n_lines", "n_stop_words",
    )


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    prefix = "quality rule "
    own, verdict = [field(c) for c in docs.columns], f"{prefix}verdict"
    # the row number keeps the verdict where it is: pushed into the filter, its parts would be evaluated once per rule
    settled = (~base_failed(prefix) & compiled(rules, prefix)) & (F.monotonically_increasing_id() >= 0)
    judged = measures(docs, text, prefix).select(*own, settled.alias(verdict))
    return judged.where(field(verdict)).select(*own)
