"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row (name, numerator, denominator, low, high): the text fails the rule unless
``low * denominator <= numerator <= high * denominator`` in whole hundredths.  The metrics are
native array and string functions over the whole text; no user functions.

Defined results: null and empty texts have no words and fail; repeated rows and tied values are
judged one by one; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.llm.textops import SEPARATOR_PATTERN, WORD_PATTERN

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "en": "the be to of and that have with in on is for it as was are this by from at an or not which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec ce il plus pas",
    "es": "de la que el en y los se del las un por con una su para es al lo como más o pero",
}


@dataclass(frozen=True)
class Rule:
    """``low`` and ``high`` are hundredths of ``numerator / denominator`` (None: no bound)."""

    name: str
    numerator: str
    denominator: str | None
    low: int | None
    high: int | None


#: the production table; a text is kept if it passes every row
RULES = (
    Rule("too_few_words", "n_words", None, 5000, None),
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("shouting", "n_marks", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR_PATTERN, -1), lambda w: w != "")


def with_metrics(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """Append the metric columns, each named ``prefix`` + metric."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    def runs_removed(text: Column, pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("bigint")

    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(
        "*",
        text.alias(prefix + "text"),
        words_of(text).alias(prefix + "words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_PATTERN)).alias(prefix + "lines"),
    )
    # 3-word windows by their start, with a 64-bit hash
    windows = F.slice(
        F.transform(
            c("words"),
            lambda w, i: F.struct(F.xxhash64(w, F.get(c("words"), i + 1), F.get(c("words"), i + 2)).alias("h"), i.alias("i")),
        ),
        F.lit(1), F.greatest(F.size(c("words")) - 2, F.lit(0)),
    )
    second = first.select("*", F.sort_array(windows).alias(prefix + "windows"))
    # neighbours in hash order that are equal: both starts belong to a repeated window
    starts = F.flatten(
        F.filter(
            F.zip_with(
                c("windows"), F.slice(c("windows"), F.lit(2), F.greatest(F.size(c("windows")), F.lit(1))),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
            ),
            lambda pair: pair.isNotNull(),
        )
    )
    third = second.select("*", F.array_distinct(starts).alias(prefix + "starts"))
    covered = F.array_distinct(F.flatten(F.transform(c("starts"), lambda i: F.array(i, i + 1, i + 2))))
    metrics = {
        "n_words": F.size(c("words")).cast("bigint"),
        "word_chars": runs_removed(c("text"), SEPARATOR_PATTERN),
        "n_symbols": runs_removed(c("text"), r"[^#*$%&|<>]+"),
        "n_marks": runs_removed(c("text"), r"[^!?]+"),
        "n_stop_words": F.size(F.filter(c("words"), lambda w: F.lower(w).isin(stop))).cast("bigint"),
        "n_lines": F.size(c("lines")).cast("bigint"),
        "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("bigint"),
        "n_repeat_words": F.size(covered).cast("bigint"),
    }
    return third.select(*[F.col(f"`{n}`") for n in docs.columns], *[m.alias(prefix + n) for n, m in metrics.items()])


def compile_rules(rules: tuple[Rule, ...] = RULES, prefix: str = "_q_") -> tuple[Column, Column]:
    """(kept, names of the failed rules) as two column expressions over the metrics."""
    passed = {}
    for rule in rules:
        top = F.col(prefix + rule.numerator) * 100
        bottom = F.col(prefix + rule.denominator) if rule.denominator else F.lit(1)
        holds = F.lit(True)
        if rule.low is not None:
            holds &= top >= bottom * rule.low
        if rule.high is not None:
            holds &= top <= bottom * rule.high
        passed[rule.name] = holds
    kept = F.lit(True)
    for holds in passed.values():
        kept &= holds
    failed = F.filter(F.array(*[F.when(~holds, F.lit(name)) for name, holds in passed.items()]), lambda x: x.isNotNull())
    return kept, failed


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prefix: str = "_q_") -> DataFrame:
    """``docs`` with its metrics, ``<prefix>kept`` and ``<prefix>failed``."""
    kept, failed = compile_rules(rules, prefix)
    return with_metrics(docs, prefix).select("*", kept.alias(prefix + "kept"), failed.alias(prefix + "failed"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, columns as they are."""
    prefix = "_q_"
    while any(name.lower().startswith(prefix) for name in docs.columns):
        prefix = "_" + prefix
    kept, _ = compile_rules(rules, prefix)
    # a filter is not pushed below a row id, so the metrics are computed once by name and not
    # spelled out, each inside the others, in one huge condition
    judged = with_metrics(docs, prefix).select(
        *[F.col(f"`{n}`") for n in docs.columns], kept.alias(prefix + "kept"), F.monotonically_increasing_id().alias(prefix + "row")
    )
    return judged.where(F.col(prefix + "kept") & (F.col(prefix + "row") >= 0)).select(*[F.col(f"`{n}`") for n in docs.columns])
