"""Quality rules: a learned decision list over text statistics, applied as one ordered conditional expression.

Statistics and verdict are built-in Spark expressions. The list is learned by sequential covering: rules that
reject are grown one threshold at a time by information gain on one part of the labelled statistics and pruned
on another. The learner sees a contingency table, counts of labelled documents by binned statistics, from a
bounded sample of labelled rows; everything else runs over all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Labelled rows the list is learned from: the first in the order of a seeded hash of their id.
SAMPLE_ROWS = 20_000
#: Words in a window that counts as repeated.
WINDOW = 5
#: The statistics a rule may test; ratios, so that they mean the same for any length of text.
FEATURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "mean_word", "upper_ratio", "bang_ratio", "line_words")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the parts of FEATURES.

    A null text has no words. Windows compare by the hash of their words within one document; each document is
    handled by itself with arrays, in time n log n of its own length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_words", F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    d = d.withColumns({"_lines": lines, "_x": F.transform("_words", lambda w: F.xxhash64(w))})
    # Runs of WINDOW word hashes; those that would pass the end of the text are null and go.
    run = F.transform("_x", lambda x, i: F.when(i <= F.size("_x") - WINDOW, F.xxhash64(x, *[F.get("_x", i + k) for k in range(1, WINDOW)])))
    d = d.withColumn("_h", F.when(n >= WINDOW, F.array_compact(run)))
    # Most texts repeat no window: only the others are sorted, to bring equal hashes together.
    d = d.withColumn("_w", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    twice = F.filter("_w", lambda x, i: ((i > 0) & (F.get("_w", i - 1)["h"] == x["h"])) | (F.get("_w", i + 1)["h"] == x["h"]))
    d = d.withColumn("_r", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.aggregate("_r", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    return d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_n_lines": F.size("_lines"),
            "_n_distinct": F.size(F.array_distinct("_words")),
            "_n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "_n_bang": F.regexp_count(text, F.lit(r"[!?]")),
        }
    ).drop("_words", "_lines", "_x", "_h", "_w", "_r")


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "distinct_ratio": F.col("_n_distinct") / F.sqrt(words),
        "mean_word": F.col("word_chars") / words,
        "upper_ratio": F.col("_n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bang_ratio": F.col("_n_bang") / words,
        "line_words": F.col("n_words") / F.greatest(F.col("_n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold); a document that meets all of them is rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.tests:
            out = out & ((F.col(name) <= value) if sign == "<=" else (F.col(name) > value))
        return out

    def meets(self, row: dict) -> bool:
        return all(row[f] <= v if s == "<=" else row[f] > v for f, s, v in self.tests)


def _split(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """Two thirds to grow on and one third to prune on, by each row's own bin pattern counts."""
    grow, prune = [], []
    for i, r in enumerate(rows):
        (prune if i % 3 == 2 else grow).append(r)
    return grow, prune


def _counts(rows: list[dict]) -> tuple[float, float]:
    return sum(r["bad"] for r in rows), sum(r["good"] for r in rows)


def _grow(rows: list[dict], max_tests: int) -> list[tuple[str, str, float]]:
    """Adds the test of the largest information gain until no good document is covered."""
    tests: list[tuple[str, str, float]] = []
    bad, good = _counts(rows)
    while good and bad and len(tests) < max_tests:
        best = (1e-9, None)
        had = math.log2(bad / (bad + good))
        for f in FEATURES:
            by: dict[float, list[float]] = {}
            for r in rows:
                x = by.setdefault(r[f], [0.0, 0.0])
                x[0] += r["bad"]
                x[1] += r["good"]
            b = g = 0.0
            values = sorted(by)
            for v, after in zip(values, values[1:], strict=False):
                b, g = b + by[v][0], g + by[v][1]
                for sign, p, q in (("<=", b, g), (">", bad - b, good - g)):
                    if p and (gain := p * (math.log2(p / (p + q)) - had)) > best[0]:
                        best = (gain, (f, sign, (v + after) / 2))
        if best[1] is None:
            break
        tests.append(best[1])
        rows = [r for r in rows if Rule((best[1],)).meets(r)]
        bad, good = _counts(rows)
    return tests


def _prune(tests: list, rows: list[dict]) -> list:
    """Drops final tests while that does not lower (bad - good) / (bad + good) on the rows held back."""
    def worth(t):
        b, g = _counts([r for r in rows if Rule(tuple(t)).meets(r)])
        return (b - g) / (b + g) if b + g else -1.0

    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def learn(rows: list[dict], max_rules: int = 8, max_tests: int = 4, least: float = 0.75) -> tuple[Rule, ...]:
    """The ordered rules from rows of (FEATURES.., bad, good) counts. A rule needs a precision of ``least`` on all
    rows left; learning ends at the first one below it. No labelled rows, or none that is bad: no rules."""
    rules: list[Rule] = []
    rows = sorted(rows, key=lambda r: (tuple(r[f] for f in FEATURES), r["bad"], r["good"]))
    while rows and len(rules) < max_rules:
        grow, prune = _split(rows)
        if not _counts(grow)[0]:
            break
        tests = _prune(_grow(grow, max_tests), prune)
        if not tests:
            break
        rule = Rule(tuple(tests))
        covered = [r for r in rows if rule.meets(r)]
        bad, good = _counts(covered)
        if bad < 3 or bad / (bad + good) < least:
            break
        rules.append(rule)
        rows = [r for r in rows if not rule.meets(r)]
    return tuple(rules)


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[dict]:
    """Counts of bad and good labelled documents by binned FEATURES; at most SAMPLE_ROWS labelled rows enter.

    Labels that are null, and labels of documents that are not there, do not count.
    """
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    sample = sample.orderBy(F.xxhash64(F.col("_id"), F.lit(6)), "_id", "_label").limit(SAMPLE_ROWS)
    # At most SAMPLE_ROWS pairs of numbers are broadcast.
    known = docs.select(id_col, text_col).join(F.broadcast(sample), F.col(id_col) == F.col("_id"))
    stats = with_counts(known, text_col).select("_label", *[c.cast("double").alias(n) for n, c in features().items()])
    stats = stats.groupBy(*[F.round(F.col(f), 3).alias(f) for f in FEATURES]).agg(F.sum(F.when(F.col("_label") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("_label") != 0, 1).otherwise(0)).alias("good"))
    return [r.asDict() for r in stats.collect()]


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``rule`` (which rule rejects, from 1; null: none) and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept", *FEATURES]
    d = with_counts(docs.drop(*names), text_col).withColumns(features())
    hit = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        hit = F.when(rule.column(), F.lit(i)).otherwise(hit)
    d = d.withColumns({"base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), "rule": hit})
    # The ever true test of a row number keeps a filter on ``kept`` above this projection; pushed below, it would
    # compute every statistic once more for each place where the condition mentions it.
    computed = F.monotonically_increasing_id() >= 0
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull() & computed).drop("_n_lines", "_n_distinct", "_n_upper", "_n_bang", *FEATURES)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` judged by rules learned from ``labels``: see ``apply_rules``.

    Every input row gives one row. Null and empty texts fail the base rule (fewer than 10 words). Repeated rows
    get equal verdicts. Columns of the input that are named like the added ones are replaced.
    """
    return apply_rules(docs, learn(labelled_statistics(docs, labels, id_col, text_col, label_col)), text_col)


def op6_quality_rules(spark, sf_dir):
    """Contract query: doc_id, the counts, base_failed and kept of every row of ``documents``, and which rule rejects it; see
    ``judge`` for null and empty texts, repeated rows and empty tables."""
    from .common import load

    docs = judge(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
