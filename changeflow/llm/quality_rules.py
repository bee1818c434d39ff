"""Operator 9: quality rules.

Text statistics are DataFrame expressions over one row. From labelled
statistics a decision list is learned by sequential covering: each rule is a
conjunction of thresholds grown greedily by information gain on two thirds of
the labelled rows and pruned on the rest; accepted rules become one ordered
``CASE WHEN`` expression. The driver sees histograms of fixed size only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import SPACE_CLASS, let, read, save, words

WINDOW = 3
MIN_WORDS = 50
# Candidate thresholds per statistic, rules in a list, conditions in a rule.
BINS = 64
MAX_RULES = 8
MAX_CONDITIONS = 3
# A rule is accepted when, of the pruning rows it covers, at least MIN_COVER are bad
# and at most one in ten is good.
MIN_COVER = 3
# Ids of labelled documents are broadcast when they number fewer.
BROADCAST_IDS = 2_000_000
MIN_PRECISION = 0.9

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct_words"]
# Statistics a rule may test, each a whole number of thousandths.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
}
FEATURES = [*RATIOS, "n_words"]


def _repeat_words(w: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in ``w``, the first occurrence included.

    Windows are compared by 64-bit hash. Sorting (hash, position) puts equal
    windows side by side; each repeated window start covers the words up to the
    next start, WINDOW at most.
    """
    n = F.size(w)
    zipped = F.slice(F.arrays_zip(*[F.slice(w, i + 1, F.greatest(n, F.lit(1))) for i in range(WINDOW)]), 1, F.greatest(n - WINDOW + 1, F.lit(0)))
    marked = F.sort_array(F.transform(zipped, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("p"))))

    def starts(s: Column) -> Column:
        twin = lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    return let(let(marked, starts), covered)


def _per_thousand(num: Column, den: Column) -> Column:
    return F.floor(num * 1000 / F.greatest(den, F.lit(1))).cast("long")


def statistics(text: Column) -> Column:
    """The counts of COUNTS for one text as a struct of longs (null text: all 0 but n_lines)."""
    t = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            count(r"\p{Lu}").alias("n_upper"),
            count(r"[!?]").alias("n_marks"),
            count(r"[0-9]").alias("n_digits"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        )

    return let(words(t), of)


def features(stats: Column) -> Column:
    """The thresholded statistics of FEATURES from a ``statistics`` struct."""
    ratios = [_per_thousand(stats[a], stats[b]).alias(name) for name, (a, b) in RATIOS.items()]
    return F.struct(*ratios, stats["n_words"].alias("n_words"))


def base_failed(stats: Column) -> Column:
    """The fixed rule: under 50 words, or more than half of the words in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 50)


def _condition(c: tuple[str, str, int]) -> str:
    name, op, value = c
    return f"f.{name} {op} {value}"


def _conjunction(conditions: list[tuple[str, str, int]]) -> str:
    return " AND ".join(_condition(c) for c in conditions) or "true"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL gain of narrowing (p0, n0) covered rows to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _histograms(rows: DataFrame, cuts: dict[str, list[int]]) -> dict[str, list[tuple[int, int]]]:
    """Per statistic: (bad, good) counts of the rows between neighbouring cuts. At most FEATURES x (BINS + 1) rows leave Spark."""
    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(v) for v in cuts[name]]), lambda v: v <= F.col("f")[name]))

    bins = F.array(*[F.struct(F.lit(name).alias("name"), bin_of(name).alias("bin")) for name in cuts])
    table = rows.select("bad", F.explode(bins).alias("b")).groupBy("b.name", "b.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    out = {name: [(0, 0)] * (len(v) + 1) for name, v in cuts.items()}
    for r in table.collect():
        out[r["name"]][r["bin"]] = (int(r["p"]), int(r["n"]))
    return out


def _best_condition(hist: dict, cuts: dict) -> tuple[float, tuple[str, str, int] | None, int]:
    """The threshold of highest gain over the covered rows, and the good rows it still covers."""
    best: tuple[float, tuple[str, str, int] | None, int] = (0.0, None, 0)
    for name in sorted(cuts):
        p0, n0 = (sum(x[i] for x in hist[name]) for i in (0, 1))
        below_p = below_n = 0
        for value, (p, n) in zip(cuts[name], hist[name]):
            below_p, below_n = below_p + p, below_n + n
            for op, a, b in (("<", below_p, below_n), (">=", p0 - below_p, n0 - below_n)):
                if (g := _gain(a, b, p0, n0)) > best[0] + 1e-9:
                    best = (g, (name, op, value), b)
    return best


def learn_rules(labelled: DataFrame) -> list[list[tuple[str, str, int]]]:
    """Sequential covering over rows (f: FEATURES struct, bad 0/1, grow boolean).

    Returns ordered conjunctions that mark rejected rows; none for an empty table
    or one without both classes.
    """
    got = labelled.agg(F.sum("bad").alias("p"), F.count("*").alias("n"),
                       *[F.percentile_approx(F.col("f")[x], [i / BINS for i in range(1, BINS)], 10000).alias(x) for x in FEATURES]).first()
    if not got["p"] or got["p"] == got["n"]:
        return []
    cuts = {x: sorted({int(v) for q in got[x] for v in (q, q + 1)}) for x in FEATURES}
    rules: list[list[tuple[str, str, int]]] = []
    left = labelled
    while len(rules) < MAX_RULES:
        rule: list[tuple[str, str, int]] = []
        while len(rule) < MAX_CONDITIONS:
            _, best, good = _best_condition(_histograms(left.where("grow").where(_conjunction(rule)), cuts), cuts)
            if best is None:
                break
            rule.append(best)
            if not good:
                break
        if not rule:
            break
        shorter = [F.sum(F.when(F.expr(_conjunction(rule[:k])), v)).alias(f"{x}{k}") for k in range(1, len(rule) + 1) for x, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
        seen = left.where("NOT grow").agg(*shorter).first()
        covered = {k: (int(seen[f"p{k}"] or 0), int(seen[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)}
        k = max(covered, key=lambda k: (round((covered[k][0] + 1) / (sum(covered[k]) + 2), 4), -k))
        if covered[k][0] < MIN_COVER or covered[k][0] < MIN_PRECISION * sum(covered[k]):
            break
        rules.append(rule[:k])
        left = left.where(f"NOT ({_conjunction(rule[:k])})")
    return rules


def verdict(rules: list[list[tuple[str, str, int]]], stats: Column, feats: Column) -> Column:
    """The ordered expression: false at the base rule or the first matching conjunction, else true."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        hit = F.lit(True)
        for name, op, value in rule:
            hit = hit & (feats[name] >= value if op == ">=" else feats[name] < value)
        out = out.when(hit, F.lit(False))
    return out.otherwise(F.lit(True))


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of labelled documents that pass the base rule; one with several labels counts as bad if any is."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    open_rows = stats.where(~base_failed(F.col("s")))
    return open_rows.join(marks.select(F.col("doc_id").alias("label_id"), "quality"), F.col("doc_id") == F.col("label_id")).select(
        features(F.col("s")).alias("f"), (F.col("quality") == 0).cast("int").alias("bad"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"))


def learn(docs: DataFrame, labels: DataFrame) -> list[list[tuple[str, str, int]]]:
    """Rules learned from all labelled documents of ``docs``.

    The labelled ids select the documents by broadcast when they are few enough;
    otherwise the statistics of all documents are joined. Texts are not shuffled.
    """
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct()
    known = docs.select("doc_id", "text")
    if ids.count() <= BROADCAST_IDS:
        known = known.join(F.broadcast(ids), "doc_id", "left_semi")
    stats = save(known.select("doc_id", statistics(F.col("text")).alias("s")), "rule-stats")
    return learn_rules(save(_labelled(stats, labels), "rule-rows"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, statistics, base_failed, kept.

    Null and empty texts have no words and fail the base rule. Rows of a null
    doc_id get their verdict like any other; they never serve as labelled rows.
    Without labels only the base rule applies. Only doc_id and text are read.
    """
    stats = save(docs.select("doc_id", statistics(F.col("text")).alias("s")), "rule-stats")
    rules = learn_rules(save(_labelled(stats, labels), "rule-rows"))
    s = F.col("s")
    return stats.select("doc_id", "s.*", base_failed(s).alias("base_failed"), verdict(rules, s, features(s)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged; no shuffle of texts."""
    rules = learn(docs, labels)
    rejected = let(statistics(F.col("text")), lambda s: verdict(rules, s, features(s)))
    return docs.where(rejected)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
