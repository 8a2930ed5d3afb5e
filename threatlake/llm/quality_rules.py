"""Quality rules as a short-circuit cascade of column expressions.

Every rule is a predicate "reject".  Its cost (seconds a row) and its selectivity (share of rows
it rejects) are measured on a sample; the cascade asks the rules in the order of rejections per
second, and a row that one rule rejects is not shown to the next.  The verdict is the same in any
order, so a machine that measures other seconds gives the same rows.

Null and empty texts have no words and fail the base.  Texts of any length are worked on in one
row, in near linear time.  Repeated rows get equal results; an empty table gives no rows.  Result
columns replace columns of the same name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threatlake.functions.columns import let
from threatlake.llm.common import SPACE_CLASS, free_name, split_words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``reject`` reads the text and the base counts; null means it passes."""

    name: str
    reject: Column


def rules() -> list[Rule]:
    """The production rules; thresholds leave room for unusual but sound texts."""
    n_words = F.col("n_words")
    text = F.coalesce(F.col("text"), F.lit(""))

    def share_of(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return [
        Rule("symbols", 10 * F.col("n_symbols") > n_words),
        Rule("word_length", (F.col("word_chars") < 2 * n_words) | (F.col("word_chars") > 12 * n_words)),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 2) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("shouting", 2 * share_of(r"\p{Lu}") > F.col("word_chars")),
        Rule("exclamation", 5 * share_of(r"[!?]") > n_words),
        Rule("letters", 2 * share_of(r"\p{L}") < F.col("word_chars")),
        Rule("ellipsis_lines", 3 * share_of(r"(?m)(?:\.\.\.|…)[\x20\x09\x0B-\x0D]*$") > F.col("n_lines")),
        Rule("bullet_lines", 10 * share_of(r"(?m)^[\x20\x09]*[-*•]") > 9 * F.col("n_lines")),
    ]


def base(docs: DataFrame) -> DataFrame:
    """Add the base counts.

    Words, lines and window hashes are each made once a row and handed on inside one expression;
    as columns of their own the optimizer would copy them into the lambdas that read them.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(whole, " \t\x0b\x0c\r", "")
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    if_lines = F.when(F.instr(blank, "\n") > 0, lines).otherwise(F.array(whole))

    def counts(w: Column, n: Column, rows: Column) -> Column:
        hashes = F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), n - WINDOW),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))
        dup = F.size(rows) - F.size(F.array_distinct(rows))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(rows).cast("long").alias("n_lines"),
            dup.cast("long").alias("n_dup_lines"),
            let(hashes, repeated_words).cast("long").alias("n_repeat_words"),
        )

    counted = let(
        split_words(F.col("text"), SPACE_CLASS),
        lambda w: let(F.size(w), lambda n: let(if_lines, lambda rows: counts(w, n, rows))),
    )
    base = free_name(docs, "_base")
    with_counts = docs.withColumn(base, counted)
    fields = ("n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words")
    counted_rows = with_counts.withColumns(
        {f: F.col(base)[f] for f in fields} | {"n_symbols": _count_of(F.col("text"), SYMBOLS)}
    ).drop(base)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted_rows.withColumn("base_failed", failed)


def _count_of(text: Column, symbols: str) -> Column:
    left = F.char_length(text) - F.char_length(F.translate(text, symbols, ""))
    return F.when(text.rlike(f"[{symbols}]"), left).otherwise(F.lit(0)).cast("long")


def repeated_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Most texts have no such window, which a hash set tells at once.  Else the hashes are sorted
    with their places, those with an equal neighbour are kept, and each window adds the words up
    to the next one's start.
    """

    def places(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)

        def repeated(pair: Column, i: Column) -> Column:
            # get() is null beyond the ends, so that comparison is false there.
            left = F.get(sorted_pairs, i - 1)["h"] == pair["h"]
            right = F.get(sorted_pairs, i + 1)["h"] == pair["h"]
            return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

        return F.array_sort(F.transform(F.filter(sorted_pairs, repeated), lambda p: p["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(
            at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    counted = let(F.array_sort(pairs), lambda s: let(places(s), covered))
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(counted)


def measure(counted: DataFrame, given: list[Rule], sample_rows: int = 2000) -> list[dict]:
    """Cost and selectivity of every rule on at most ``sample_rows`` rows.

    The sample only decides the order, never a verdict.
    """
    sample = counted.where(~F.col("base_failed")).limit(sample_rows).cache()
    try:
        total = max(1, sample.count())
        found = []
        for rule in given:
            started = time.perf_counter()
            hit = sample.agg(F.count_if(F.coalesce(rule.reject, F.lit(False)))).first()[0]
            seconds = time.perf_counter() - started
            found.append({"rule": rule, "cost": seconds / total, "selectivity": hit / total})
        return found
    finally:
        sample.unpersist()


def order(measured: list[dict]) -> list[Rule]:
    """Most rejections per second first; ties by name."""
    rate = lambda m: m["selectivity"] / max(m["cost"], 1e-12)
    return [m["rule"] for m in sorted(measured, key=lambda m: (-rate(m), m["rule"].name))]


def first_rejection(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ordered:
        chain = chain.when(F.coalesce(rule.reject, F.lit(False)), F.lit(rule.name))
    return chain


def score(docs: DataFrame, given: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The documents with the base counts, ``rejected_by`` and ``kept``."""
    counted = base(docs)
    ordered = order(measure(counted, given or rules(), sample_rows))
    return (
        counted.withColumn("rejected_by", first_rejection(ordered))
        .withColumn("kept", F.col("rejected_by").isNull())
    )
