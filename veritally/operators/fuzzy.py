"""Fuzzy product search: indel similarity of names, re-ranked, with price and quantity clues.

One query is compared with all distinct names, whose number is bounded; the ratio is a pandas function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.numbers import similarity

#: Cut-off, numbers kept, and weights of the two ratios and of the clues.
CUT_OFF, FIRST, KEPT = 55.0, 200, 40
WIDE, PLAIN = 0.6, 0.4
NAME, PRICE, QUANTITY = 0.85, 0.10, 0.05


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one string a row."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        matched = row & places.get(c, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if a == b else 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    return max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 100.0
    return max(ratio(both, left), ratio(both, right), ratio(left, right)) if both else ratio(left, right)


def weighted_ratio(a: str, b: str) -> float:
    """The published weighting: token ratios at 0.95, and partial ones at 0.9 or 0.6 where the lengths differ much."""
    if not a or not b:
        return 0.0
    plain, tokens = ratio(a, b), max(token_sort(a, b), token_set(a, b)) * 0.95
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(plain, tokens)
    scale = 0.9 if longer < 8 else 0.6
    return max(plain, partial_ratio(a, b) * scale, tokens * scale)


@F.pandas_udf(StructType([StructField("wide", DoubleType()), StructField("plain", DoubleType())]))
def ratios(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    pairs = [(weighted_ratio(a or "", b or ""), ratio(a or "", b or "")) for a, b in zip(left, right, strict=True)]
    return pd.DataFrame(pairs, columns=["wide", "plain"])


def similar_names(names: DataFrame, query: str) -> DataFrame:
    """(name, score in 0..1) of the best 40 names: 200 by the wide ratio, ranked again by both."""
    scored = names.select("name").distinct().withColumn("r", ratios(F.col("name"), F.lit(query))).where(F.col("r.wide") >= CUT_OFF)
    first = scored.orderBy(F.desc("r.wide"), "name").limit(FIRST)
    score = (WIDE * F.col("r.wide") + PLAIN * F.col("r.plain")) / 100
    return first.select("name", score.alias("score")).orderBy(F.desc("score"), "name").limit(KEPT)


def clue_score(name_score: Column, price: Column, asked_price: Column, quantity: Column, asked_quantity: Column, unsafe: Column, exact: Column) -> Column:
    """1 for an exact identifier, else the weighted sum, at most 0.99; unsafe rows get no clue."""
    none = F.lit(0.0)
    clues = PRICE * F.coalesce(similarity(price, asked_price), none) + QUANTITY * F.coalesce(similarity(quantity, asked_quantity), none)
    return F.when(exact, 1.0).otherwise(F.least(F.lit(0.99), NAME * name_score + F.when(unsafe, none).otherwise(clues)))
