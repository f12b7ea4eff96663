"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition that rejects a text. `plan_cascade` runs every rule on a
sample, takes its seconds and the share of texts that it rejects, and sorts the
rules by rejections per second. A rule is repeated over the sample until its own time outweighs that of the job. `passes` nests them in that order in one CASE
expression: a text that a rule has rejected meets none of the later rules. The order
changes the cost, never the verdict.

Null and empty texts have no words: all counts are 0 and the base rule on the number
of words rejects them. Repeated rows are judged each by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.text import free_name, let, whole, words
from colwright.sources.shared import kept

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Texts to be expected in the sample on which cost and selectivity are estimated; it decides the order alone.
SAMPLE_ROWS = 500
# A rule is repeated until its job takes this many seconds more than one without a rule, or so often.
OUTWEIGHS = 0.4
MOST_REPEATS = 256


@dataclass(frozen=True)
class Rule:
    """A name and the condition that rejects, as a function of the text, its words and their number."""

    name: str
    rejects: Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _many_symbols(text: Column, word: Column, n: Column) -> Column:
    return 10 * F.regexp_count(text, F.lit(r"[#*$%&|<>]")) > 3 * n


def _few_lettered(text: Column, word: Column, n: Column) -> Column:
    return 10 * F.size(F.filter(word, lambda w: w.rlike(r"\p{L}"))) < 6 * n


def _odd_lengths(text: Column, word: Column, n: Column) -> Column:
    return let(F.length(F.array_join(word, "")), lambda chars: (chars < 2 * n) | (chars > 20 * n))


def _shouting(text: Column, word: Column, n: Column) -> Column:
    return 2 * F.regexp_count(text, F.lit("!!")) > n


def _same_lines(text: Column, word: Column, n: Column) -> Column:
    return let(_lines(text), lambda a: 2 * (F.size(a) - F.size(F.array_distinct(a))) > F.size(a))


RULES = (
    Rule("many_symbols", _many_symbols),
    Rule("few_lettered_words", _few_lettered),
    Rule("odd_word_lengths", _odd_lengths),
    Rule("shouting", _shouting),
    Rule("same_lines", _same_lines),
)


def repeat_words(word: Column, n: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text, the first one included.

    Windows are compared by 64-bit hashes. Only texts in which a hash comes twice are
    sorted, so that equal windows become neighbours: n log n, whatever repeats.
    """
    windows = F.when(
        n >= 3,
        F.transform(F.slice(word, F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def twice(ranked: Column) -> Column:
        return F.filter(
            ranked,
            lambda x, k: F.get(ranked, k - 1)["h"].eqNullSafe(x["h"]) | F.get(ranked, k + 1)["h"].eqNullSafe(x["h"]),
        )

    def covered(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = F.transform(let(ranked, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(at)))

    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and base_failed.

    The new columns replace columns of these names.
    """
    require(df, text)
    word, body = free_name(df, "__words"), whole(text)
    df = df.withColumn(word, words(body))
    n = F.size(col(word))
    dup_lines = let(_lines(body), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(col(word), "")),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words(col(word), n),
    }
    df = df.withColumns({k: v.cast("bigint") for k, v in counts.items()}).drop(word)
    few = F.col("n_words") < MIN_WORDS
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return df.withColumn("base_failed", few | repeated)


def plan_cascade(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> list[Estimate]:
    """The rules in order of rejections per second, both measured on about SAMPLE_ROWS different texts.

    The sample holds the texts with the lowest hashes, so it is the same whenever and however the rows are dealt. Seconds are those of one
    pass over the sample, without the job around it. Rules that tie stay in the given order; so do those that reject nothing,
    and all rules if there are no rows.
    """
    require(df, text)
    body, hashed = whole(text), F.pmod(F.xxhash64(whole(text)), F.lit(1 << 40))
    limit = (1 << 40) * min(1.0, SAMPLE_ROWS / max(1, df.count()))
    drawn = df.select(hashed.alias("h"), body.alias("text")).where(F.col("h") < F.lit(limit)).groupBy("h").agg(F.max("text").alias("text"))
    sample = kept(drawn.coalesce(1).withColumn("words", words(F.col("text"))), "quality-sample")

    def timed(rejects: Column, repeats: int) -> tuple[float, float]:
        """Seconds of the faster of two runs, and the share of rejected texts."""
        again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        job = again.agg(F.avg(rejects.cast("double")).alias("share"))
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            share = job.first()["share"] or 0.0
            runs.append(time.perf_counter() - began)
        return min(runs), share

    found = []
    empty: dict[int, float] = {}
    for rule in rules:
        rejects = rule.rejects(F.col("text"), F.col("words"), F.size("words"))
        repeats = 1
        while True:
            if repeats not in empty:
                empty[repeats] = timed(F.size("words") + F.length("text") + F.col("again") < 0, repeats)[0]
            seconds, share = timed(rejects, repeats)
            if seconds - empty[repeats] >= OUTWEIGHS or repeats >= MOST_REPEATS:
                break
            repeats *= 4
        found.append(Estimate(rule, max(seconds - empty[repeats], 1e-6) / repeats, share))
    return sorted(found, key=lambda e: -e.rejected / e.seconds)


def passes(cascade: Sequence[Estimate], text: Column, word: Column, last: Column | None = None) -> Column:
    """`last` (default: true) if no rule rejects; the first that does ends the evaluation."""
    last = F.lit(True) if last is None else last
    verdict = None
    for step in cascade:
        rejects = step.rule.rejects(text, word, F.size(word))
        verdict = F.when(rejects, False) if verdict is None else verdict.when(rejects, False)
    return last if verdict is None else verdict.otherwise(last)


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """`measure`, and kept: false if the base rules fail, else the verdict of the cascade."""
    cascade = plan_cascade(df, text, rules)
    verdict = let(words(whole(text)), lambda word: passes(cascade, whole(text), word))
    return measure(df, text).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict))


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows whose text passes the base rules and the cascade, with their own columns."""
    cascade = plan_cascade(df, text, rules)

    def good(word: Column) -> Column:
        n = F.size(word)
        repeats = F.when(100 * repeat_words(word, n) > MAX_REPEAT_PERCENT * n, False).otherwise(True)
        return F.when(n < MIN_WORDS, False).otherwise(passes(cascade, whole(text), word, repeats))

    return df.filter(let(words(whole(text)), good))
