"""Quality rules: per-document counts, and host verdicts from shrunk failure rates.

Everything here is DataFrame functions; no Python runs on the executors.

Rules of a document: ``short`` (fewer than ``min_words`` words), ``repeats`` (more than
``max_repeat_pct`` per cent of its words lie in repeated 8-word windows), ``symbols``
(more than ``max_symbols_per_word`` markup characters a word) and ``dup_lines`` (more than
``max_dup_line_pct`` per cent of its worded lines repeat an earlier one). The failures of each
rule are counted by host; the empirical beta prior of a rule is fitted to the hosts' rates by
moments, and a host is rejected if a shrunk rate exceeds ``max_host_rate``.

Null or empty text: no words, so ``short`` fails. A null host is a host of its own. Repeated
rows count each. Documents of an empty table: none. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import BLANK_CLASS, words_of, written

WINDOW = 8
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "dup_lines")


def _repeat_words(windows: Column, pairs: Column) -> Column:
    """Words covered by windows that occur twice or more, from (hash, start) in hash order."""
    n = F.size(pairs)
    at = lambda i: F.get(pairs, i)["h"]
    twice = lambda i: (at(i) == at(i - 1)) | (at(i) == at(i + 1))
    starts = F.sort_array(
        F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(twice(i), F.lit(False))), lambda i: F.get(pairs, i)["i"])
    )
    ahead = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(ahead, F.lit(0), lambda total, x: total + x)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Counts of each document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^" + BLANK_CLASS[1:]))
    df = docs.select(
        *keep,
        words_of(F.col(text)).alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )
    df = df.select(
        *keep,
        "n_symbols",
        F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    # Hashes of 2, 4 and 8 consecutive words: each from two of the size before.
    for step, (a, b) in {1: ("_h", "_h2"), 2: ("_h2", "_h4"), 4: ("_h4", "_h8")}.items():
        df = df.withColumn(b, F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))).drop(a)
    df = df.withColumn("_w", F.when(F.col("_n") >= WINDOW, F.slice("_h8", 1, F.greatest(F.col("_n") - (WINDOW - 1), F.lit(1))))).drop("_h8")
    # Only the few documents with a repeated window go on to the sort.
    df = df.withColumn("_dup", F.size(F.array_distinct("_w")) < F.size("_w"))
    numbered = F.zip_with("_w", F.sequence(F.lit(0), F.size("_w") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_p", F.when(F.col("_dup"), F.sort_array(numbered)))
    repeated = F.when(F.col("_dup"), _repeat_words(F.col("_w"), F.col("_p"))).otherwise(F.lit(0))
    return df.select(*keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"))


def failures(min_words: int, max_repeat_pct: int, max_symbols_per_word: int, max_dup_line_pct: int) -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < min_words,
        "repeats": 100 * F.col("n_repeat_words") > max_repeat_pct * n,
        "symbols": F.col("n_symbols") > max_symbols_per_word * n,
        "dup_lines": 100 * F.col("n_dup_lines") > max_dup_line_pct * F.col("n_lines"),
    }


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    min_words: int = 20,
    max_repeat_pct: int = 30,
    max_symbols_per_word: int = 4,
    max_dup_line_pct: int = 50,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """Counts, ``base_failed`` (short or repeats), ``host_failed`` and ``kept`` of every document.

    The counts are written once; the hosts' sums are combined before they are dealt out, and the
    prior of a rule is four numbers. The host table joins back by host without a broadcast hint:
    its size follows the number of hosts, so the planner decides by its measured size."""
    measured = written(measure(docs, text, (doc_id, host)), "quality")
    failed = failures(min_words, max_repeat_pct, max_symbols_per_word, max_dup_line_pct)
    key = [F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(host).isNull().alias("_no_host")]
    hosts = measured.groupBy(*key).agg(F.count("*").alias("_n"), *[F.sum(failed[r].cast("long")).alias(f"_f_{r}") for r in RULES])
    moments = hosts.agg(
        F.sum("_n").alias("n"),
        *[F.sum(f"_f_{r}").alias(f"f_{r}") for r in RULES],
        *[F.var_pop(F.col(f"_f_{r}") / F.col("_n")).alias(f"v_{r}") for r in RULES],
    ).first()
    bad = F.lit(False)
    for r in RULES:
        alpha, strength = beta_prior(moments[f"f_{r}"] or 0, moments["n"] or 0, moments[f"v_{r}"] or 0.0)
        bad = bad | ((F.col(f"_f_{r}") + F.lit(alpha)) / (F.col("_n") + F.lit(strength)) > max_host_rate)
    verdicts = hosts.select("_host", "_no_host", bad.alias("host_failed"))
    base = failed["short"] | failed["repeats"]
    return (
        measured.withColumns({"_host": F.coalesce(F.col(host), F.lit("")), "_no_host": F.col(host).isNull(), "base_failed": base})
        .join(verdicts, ["_host", "_no_host"])
        .drop("_host", "_no_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )


def beta_prior(failed: int, n: int, variance: float) -> tuple[float, float]:
    """(alpha, alpha + beta) by moments, the strength held between 1 and a million."""
    mean = failed / n if n else 0.0
    strength = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6) if variance > 0 else 1e6
    return mean * strength, strength
