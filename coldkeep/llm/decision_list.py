"""Quality rules: statistics of whole texts and a learned decision list over them.

Statistics are DataFrame functions over each row; no text is shuffled. The list is learned by sequential
covering on labelled statistics: a rule grows one threshold condition at a time, the one
with the largest information gain for rejected texts (quality 0) among the quantiles of each statistic, on two thirds
of the rows; it is cut back to the prefix that is best on the last third, and kept
if it is precise there; the rows that it covers go, and the next rule is grown. Each step is one grouped
count of binned statistics, so the driver sees counts per statistic and bin only. The rules
become one ordered Spark conditional: first rule that holds rejects, otherwise the text is kept.

Learning reads at most about `FIT_ROWS` labelled rows (by a hash of the id); statistics and
verdicts cover all rows.

Defined results: a null or empty text has no words, fails the base test and is not kept; without labels of both kinds the
list is empty and only the base test decides; labels that are null or whose document is missing are
ignored, of several labels of a document the lowest counts; repeated rows are judged each; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.frames import joined_with
from coldkeep.session import written

FIT_ROWS = 60_000
QUANTILES = 24
MOST_RULES = 12
MOST_CONDITIONS = 3
LEAST_PRECISION = 0.75
LEAST_COVER = 8

LEAST_WORDS, MOST_REPEATED = 50, 50  # of the base test
_BLANK = " \t\n\x0b\f\r"

#: Name and SQL of what the rules may test; all from the statistics of a row.
FEATURES = {
    "words": "n_words", "word_length": "word_chars / w", "symbols": "n_symbols / w", "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / w", "capitals": "n_capitals / greatest(word_chars, 1)", "exclaims": "n_exclaims / w",
    "digits": "n_digits / greatest(word_chars, 1)", "words_a_line": "n_words / greatest(n_lines, 1)", "distinct_words": "n_distinct / w",
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text, one row per row."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def removed(chars: str) -> Column:
        return (F.length("t") - F.length(F.translate("t", chars, ""))).cast("long")

    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.length(F.translate("t", _BLANK, "")).cast("long").alias("word_chars"), removed("#*$%&|<>").alias("n_symbols"),
        removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"), removed("!").alias("n_exclaims"), removed("0123456789").alias("n_digits"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.transform(F.filter(F.split("t", r"[\x20\x09-\x0D]+", -1), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("words"))
    n = F.size("words")
    window = F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(
        h, F.get("words", i + 1), F.get("words", i + 2)))
    rows = cut.select(
        "doc_id", "word_chars", "n_symbols", "n_capitals", "n_exclaims", "n_digits", n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), window.alias("windows"))
    # windows with their places, in order of the window, only where one repeats
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("placed", placed).drop("windows")
    again = F.filter(F.transform("placed", lambda x, j: F.when(
        (F.get("placed", j - 1)["h"] == x["h"]) | (F.get("placed", j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("placed").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("placed")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound!r}D"


Rule = tuple[Condition, ...]


def featured(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("w", F.greatest(F.col("n_words"), F.lit(1)))
    return rows.withColumns({name: F.expr(sql).cast("double") for name, sql in FEATURES.items()})


def _holds(rule: Rule) -> Column:
    return F.expr(" and ".join(c.sql() for c in rule))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(rows: DataFrame, bounds: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.expr(
        f"size(filter(array({', '.join(f'{b!r}D' for b in bs)}), b -> b < {f}))").alias("bin")) for f, bs in bounds.items()])
    while len(rule) < MOST_CONDITIONS:
        at = rows.filter(_holds(rule)) if rule else rows
        counts = at.select("bad", F.explode(pairs).alias("x")).groupBy("x.f", "x.bin").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        by = {f: [[0, 0] for _ in range(len(bs) + 1)] for f, bs in bounds.items()}
        for c in counts:
            by[c["f"]][c["bin"]] = [c["p"], c["n"]]
        whole = next(iter(by.values()))
        p0, n0 = sum(x[0] for x in whole), sum(x[1] for x in whole)
        if not p0 or not n0:
            break
        best = (0.0, None)
        for f, bins in sorted(by.items()):
            p = n = 0
            for bound, x in zip(bounds[f], bins):
                p, n = p + x[0], n + x[1]
                for gain, condition in ((_gain(p, n, p0, n0), Condition(f, False, bound)), (_gain(p0 - p, n0 - n, p0, n0), Condition(f, True, bound))):
                    if gain > best[0] + 1e-9:
                        best = (gain, condition)
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def learn(spark: SparkSession, rows: DataFrame) -> list[Rule]:
    """Rules from rows with the features, `bad` (0 or 1) and `part` (0, 1: grow, 2: prune)."""
    some = rows.agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n"), *[
        F.percentile_approx(f, [i / QUANTILES for i in range(1, QUANTILES)], 2000).alias(f) for f in FEATURES]).collect()[0]
    if not some["p"] or some["p"] == some["n"]:
        return []
    bounds = {f: sorted(set(some[f])) for f in FEATURES}
    rules: list[Rule] = []
    left = rows
    while len(rules) < MOST_RULES:
        rule = _grow(left.filter("part < 2"), bounds)
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        sums = left.filter("part = 2").agg(*[F.sum(F.when(_holds(r), x).otherwise(0)).alias(f"{k}{i}") for i, r in enumerate(prefixes)
                                             for k, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).collect()[0]
        told = [(sums[f"p{i}"] or 0, sums[f"n{i}"] or 0) for i in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n >= LEAST_COVER else -1.0 for p, n in told]
        best = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = told[best]
        if worth[best] < 0 or p < LEAST_PRECISION * (p + n):
            break
        rules.append(prefixes[best])
        left = left.filter(~_holds(prefixes[best]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional of the list."""
    kept = F.when(F.col("base_failed"), False)
    for rule in rules:
        kept = kept.when(_holds(rule), False)
    return kept.otherwise(True)


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the four base statistics, base_failed and kept of every document."""
    rows = written(spark, statistics(docs), "statistics")
    told = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, FIT_ROWS / max(1, told.count()))
    told = told.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < max(1, round(share * (1 << 20))))
    fit = joined_with(featured(rows.filter("not base_failed")), told, "doc_id", 16).select(
        *FEATURES, (F.col("quality") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)).alias("part"))
    rules = learn(spark, written(spark, fit, "fit"))
    return featured(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict(rules).alias("kept"))
