"""Quality rules as a learned decision list, with DataFrame functions only.

Statistics of each text are computed by built-in functions in one pass and written once. Sequential covering then
learns from the statistics of labelled rows. In each step one rule is grown for either outcome, to reject and to keep: it
starts empty and takes the threshold condition that raises the information gain on a growing part of the rows most; it
is pruned on the other part as long as that doesn't lower its worth. Of the two the one that tells more about the rows
that are left goes to the end of the list, the rows that it covers are set aside, and the next step begins. Rules that
keep protect what they cover from later ones, so that their order matters. The list is emitted as one ordered Spark
conditional expression; a text that no rule covers is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

WINDOW = 5
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: The base rule.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Labelled rows that the list is fitted on, at most; thresholds tried for each statistic; rules and conditions.
TRAINING_ROWS = 20_000
THRESHOLDS = 40
MAX_RULES, MAX_CONDITIONS = 12, 3
#: A rule must be right this often on the pruning rows, and cover so many of them; one that keeps must besides be wrong on
#: no more than this part of what is usual among the rows that are left.
PRECISION, SUPPORT, USUAL = 0.9, 5, 0.25

#: What rules may ask about: name, and its expression over the counted statistics.
RATIOS = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
}


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside 5-word windows found twice or more: from sorted (hash, place) pairs, only if any hash repeats."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(sorted_pairs: Column) -> Column:
        twice = F.filter(sorted_pairs, lambda p, j: (F.get(sorted_pairs, j + 1)["h"] == p["h"]) | (F.get(sorted_pairs, j - 1)["h"] == p["h"]))
        return F.array_sort(F.transform(twice, lambda p: p["i"]))

    def step(state: Column, i: Column) -> Column:
        return F.struct((state["n"] + i + WINDOW - F.greatest(i, state["upto"])).alias("n"), (i + WINDOW).alias("upto"))

    # one-element arrays name a value inside an expression, so that it is computed once
    marked = F.transform(F.array(pairs), places)[0]
    total = F.aggregate(marked, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step)["n"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counted statistics) of every whole text. Null texts have no words and no lines."""
    own = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    own = own.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.slice("words", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    own = own.withColumn("hashes", F.transform(windows, lambda w, i: F.xxhash64(w, *[F.get(F.col("words"), i + k) for k in range(1, WINDOW)])))
    return own.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("text", F.lit(r"[!?,.;:]")).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.threshold if self.above else table[self.name] <= self.threshold

    def sql(self) -> str:
        return f"{RATIOS[self.name]} {'>=' if self.above else '<='} {self.threshold!r}D"


Conditions = tuple[Condition, ...]


@dataclass(frozen=True)
class Rule:
    conditions: Conditions
    keep: bool


def _covered(rule: Conditions, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, bool)
    for c in rule:
        inside &= c.holds(table)
    return inside


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Conditions:
    rule: Conditions = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        before = math.log2(max(p, 1e-9) / (p + n))
        best: tuple[float, Condition | None, np.ndarray | None] = (1e-6, None, None)
        for name, values in table.items():
            for t in np.unique(np.quantile(values[inside], np.linspace(0, 1, THRESHOLDS))):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    now = inside & c.holds(table)
                    a, b = (now & bad).sum(), (now & ~bad).sum()
                    if a and (gain := a * (math.log2(a / (a + b)) - before)) > best[0]:
                        best = (gain, c, now)
        if best[1] is None:
            break
        rule, inside = (*rule, best[1]), best[2]
    return rule


def _worth(rule: Conditions, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    inside = _covered(rule, table, len(bad))
    p, n = (inside & bad).sum(), (inside & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def _best(table: dict[str, np.ndarray], wanted: np.ndarray, grow: np.ndarray, prune: np.ndarray, precision: float) -> tuple[float, Conditions] | None:
    """A rule for the wanted rows, grown on some of the rows and pruned on others; with the wanted rows of the latter that it
    covers beyond their usual share. None if it isn't precise enough."""
    if (grow & wanted).sum() < SUPPORT or not (prune & wanted).any():
        return None
    rule = _grow({k: v[grow] for k, v in table.items()}, wanted[grow])
    held, right = {k: v[prune] for k, v in table.items()}, wanted[prune]
    while len(rule) > 1:
        shorter = max((rule[:i] for i in range(1, len(rule))), key=lambda r: _worth(r, held, right))
        if _worth(shorter, held, right) < _worth(rule, held, right):
            break
        rule = shorter
    inside = _covered(rule, held, len(right))
    hit = int((inside & right).sum())
    if not rule or inside.sum() < SUPPORT or hit < precision * inside.sum():
        return None
    return hit - float(right.mean()) * float(inside.sum()), rule


def learn(table: dict[str, np.ndarray], bad: np.ndarray, draw: np.ndarray) -> list[Rule]:
    """Ordered rules. ``draw`` in [0, 1) splits the rows: two thirds to grow rules on, one third to prune them.

    A rule that rejects comes first wherever a precise one is found; one that keeps takes clean rows away, so that others may
    become precise. Rows that no rule decides stay, unless nearly all such rows were bad: then the last rule, which has no
    condition, rejects them.
    """
    rules: list[Rule] = []
    grow, prune = draw < 2 / 3, draw >= 2 / 3
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, p = left & grow, left & prune
        if not p.any():
            break
        best, keep = _best(table, bad, g, p, PRECISION), False
        if best is None:
            best, keep = _best(table, ~bad, g, p, max(PRECISION, 1 - USUAL * float(bad[p].mean()))), True
        if best is None or keep and best[0] <= 0:
            break
        rules.append(Rule(best[1], keep))
        left &= ~_covered(best[1], table, len(bad))
    p = left & prune
    if rules and p.sum() >= SUPPORT and bad[p].mean() >= PRECISION and bad[left & grow].mean() >= PRECISION:
        rules.append(Rule((), False))
    while rules and rules[-1].keep:
        rules.pop()
    return rules


def expression(rules: list[Rule]) -> Column:
    """True for a text that is kept: the first rule that holds decides, and without one the text stays."""
    decided = "true"
    for rule in reversed(rules):
        decided = f"CASE WHEN {' AND '.join(c.sql() for c in rule.conditions) or 'true'} THEN {str(rule.keep).lower()} ELSE {decided} END"
    return F.expr(decided)


def train(found: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", training_rows: int = TRAINING_ROWS) -> list[Rule]:
    """Learn from statistics of labelled rows that pass the base rule, at most ``training_rows`` by hash of the key.

    Null labels are passed over; of several labels of a key the lowest counts. Without labels of both kinds there is
    no rule.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("row_key")).agg(F.min(label).alias("label"))
    rows = found.withColumnRenamed(key, "row_key").where(~base_failed()).join(chosen, "row_key")
    mixed = F.xxhash64(F.col("row_key").cast("string"), F.lit("rules"))
    named = [F.expr(e).alias(n) for n, e in RATIOS.items()]
    sample = rows.orderBy(F.xxhash64(F.col("row_key").cast("string")), "row_key").limit(training_rows).select("label", (F.pmod(mixed, F.lit(1 << 20)) / (1 << 20)).alias("draw"), *named).collect()
    if not sample:
        return []
    table = {n: np.array([r[n] for r in sample], float) for n in RATIOS}
    return learn(table, np.array([r.label == 0 for r in sample]), np.array([r.draw for r in sample]))


def apply(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics, base_failed, kept) of every row; repeated rows are rows of their own, null texts fail the base rule."""
    found = cut_lineage(statistics(df, key, text))
    rules = train(found, labels, key)
    out = found.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & expression(rules))
