"""Quality rules: a learned decision list of threshold conjunctions over text statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import Workspace, held_out, let
from siteledger.llm.sketch import word_array

#: Quantiles of each statistic that serve as thresholds.
QUANTILES = (0.05, 0.2, 0.5, 0.8, 0.9, 0.95)
MAX_RULES = 12
MAX_LITERALS = 3
#: A rule stays only if this share of what it covers in the pruning part is of low quality.
MIN_PRECISION = 0.6
MIN_COVER = 5

STATISTICS = ("n_words", "word_length", "symbol_share", "dup_lines", "repeat_share", "upper_share", "bang_share")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            twice = F.filter(
                p,
                lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)),
            )
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                places,
                start,
                lambda seen, i: F.struct(i.alias("last"), (seen["n"] + F.least(F.lit(3), i - seen["last"])).alias("n")),
                lambda seen: seen["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(0)

    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) >= 3, let(runs, of)).otherwise(0)


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper, bangs)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        word_array(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")),
    )
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return docs.select(
        "doc_id",
        counts.alias("_c"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        without("[A-Z]+").cast("long").alias("upper"),
        without("[!]+").cast("long").alias("bangs"),
    ).select(
        "doc_id", F.col("_c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_c.r").alias("n_repeat_words"), "upper", "bangs"
    )


def _statistics() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("upper") / chars,
        "bang_share": F.col("bangs") / words,
    }


@dataclass(frozen=True)
class Literal:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = _statistics()[self.statistic]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def rule_column(rule: Rule) -> Column:
    out = rule[0].column()
    for literal in rule[1:]:
        out = out & literal.column()
    return out


def decision_list(rules: list[Rule]) -> Column:
    """TRUE for what no rule rejects: the rules as one ordered conditional expression."""
    if not rules:
        return F.lit(True)
    chain = F.when(rule_column(rules[0]), F.lit(False))
    for rule in rules[1:]:
        chain = chain.when(rule_column(rule), F.lit(False))
    return chain.otherwise(F.lit(True))


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """An ordered list of rules for label 0, from `labelled` (statistics, label 0/1, doc_id).

    Spark counts the labelled rows per cell of the thresholds; what reaches the driver is one
    count per filled cell, at most (len(QUANTILES) + 1) ** len(STATISTICS) of them and
    never more than there are labelled rows. The rules are then grown and pruned on counts.
    """
    values = _statistics()
    quantiles = labelled.select(
        *(F.percentile_approx(v, list(QUANTILES), 1000).alias(s) for s, v in values.items())
    ).first()
    thresholds = {s: sorted({float(q) for q in quantiles[s] or []}) for s in values}
    codes = [
        sum((F.when(v >= t, 1).otherwise(0) for t in thresholds[s]), F.lit(0)).alias(s) for s, v in values.items()
    ]
    pruning = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("_prune")
    cells = labelled.select(*codes, pruning, "label").groupBy(*STATISTICS, "_prune").agg(
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("_bad"), F.count(F.lit(1)).alias("_all")
    )
    rows = sorted((tuple(r[s] for s in STATISTICS), r["_prune"], r["_bad"], r["_all"]) for r in cells.collect())
    return _cover(rows, thresholds)


def _cover(rows, thresholds) -> list[Rule]:
    """Sequential covering: grow a rule, prune it, set aside what it covers, go on."""
    literals = [
        (k, above, step)
        for k, s in enumerate(STATISTICS)
        for step in range(1, len(thresholds[s]) + 1)
        for above in (True, False)
    ]
    holds = lambda lit, codes: (codes[lit[0]] >= lit[2]) == lit[1]
    rules, left = [], rows
    while len(rules) < MAX_RULES:
        rule, inside = [], [r for r in left if not r[1]]
        while len(rule) < MAX_LITERALS:
            bad, every = sum(r[2] for r in inside), sum(r[3] for r in inside)
            if not bad or bad == every:
                break
            best = None
            for lit in literals:
                b = a = 0
                for r in inside:
                    if holds(lit, r[0]):
                        b, a = b + r[2], a + r[3]
                if b < MIN_COVER or a == every:
                    continue
                gain = b * (math.log2(b / a) - math.log2(bad / every))
                if best is None or gain > best[0]:
                    best = (gain, lit)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            inside = [r for r in inside if holds(best[1], r[0])]
        rule = _pruned(rule, [r for r in left if r[1]], holds)
        if not rule:
            break
        covered = lambda r, rule=rule: all(holds(lit, r[0]) for lit in rule)
        rules.append(rule)
        left = [r for r in left if not covered(r)]
    name = lambda lit: Literal(STATISTICS[lit[0]], lit[1], thresholds[STATISTICS[lit[0]]][lit[2] - 1])
    return [tuple(map(name, rule)) for rule in rules]


def _pruned(rule, rows, holds):
    """The beginning of a rule that is best on the pruning part, or nothing."""
    best, out = None, []
    for n in range(1, len(rule) + 1):
        inside = [r for r in rows if all(holds(lit, r[0]) for lit in rule[:n])]
        bad, every = sum(r[2] for r in inside), sum(r[3] for r in inside)
        if not every or bad / every < MIN_PRECISION:
            continue
        worth = (2 * bad - every) / every * math.log(1 + every)
        if best is None or worth > best:
            best, out = worth, rule[:n]
    return out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base verdict and learned verdict of each row of `docs(doc_id, text)`.

    Rules are learned from `labels(doc_id, quality)`, for the rows that are not held out;
    rows without a label, a text or a doc_id take no part in that, and without any labelled
    row there are no rules. A null or empty text has no words and fails the base. Rows may
    repeat; other columns are ignored. The statistics are written once, and rules are learned
    and applied on them.
    """
    work = Workspace(docs.sparkSession)
    stats = work.keep("statistics", text_statistics(docs))
    marks = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    rules = learn_rules(stats.filter(~held_out()).filter("n_words > 0").join(marks, "doc_id"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(decision_list(rules)).alias("kept"),
    )
