"""Queries that must stay in proportion to their input where it has many equal texts, or documents in a small file."""

from __future__ import annotations

import re

from veritally import plans
from veritally.operators import access as X
from veritally.operators import learning as B
from veritally.operators import match as M

QUERIES = plans.queries()


def test_documents_of_a_small_file_are_learned_from_by_all_cores(spark, small):
    found = QUERIES["e19_learned_templates"](spark, small)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_value_needs_no_pattern_of_its_own():
    for line in ("INV-1 INV-1-2 INV-1", "xINV-1 INV-1x INV-1", "aa aaa aa-a aa", "é1 1é 1", "a.b a.b. aab", ""):
        for value in ("INV-1", "aa", "1", "a.b"):
            wanted = [m.span() for m in re.finditer(rf"(?<![\w-]){re.escape(value)}(?![\w-])", line)]
            assert list(B.standing(line, value)) == wanted


def test_equal_descriptions_are_compared_once(spark):
    """400 lines and 401 items hold three and two sets of words: all of some 160,000 pairs share a word, and six pairs of sets do."""
    lines = spark.range(400).selectExpr("id AS k", "case when id = 7 then 'bolt blue hot' when id % 2 = 0 then 'red bolt' else 'bolt  RED' end AS description")
    items = spark.range(400).selectExpr("cast(id as string) AS parent", "case when id % 2 = 0 then 'Blue bolt' else 'bolt, red' end AS item_desc")
    twice = items.unionByName(items.where("parent = '0'").selectExpr("parent", "'Red bolt' AS item_desc"))
    found = M.description_candidates(lines, twice, ["k"])
    rows = {(r.k, r.rank): (r.parent, r.score) for r in found.collect()}
    assert len(rows) == 2_000
    red = sorted([str(i) for i in range(400) if i % 2] + ["0"], reverse=True)[:5]
    assert all(rows[k, n + 1] == (p, 1.0) for k in range(400) if k != 7 for n, p in enumerate(red))
    blue = sorted([str(i) for i in range(400) if i % 2 == 0], reverse=True)[:5]
    assert [rows[7, n] for n in range(1, 6)] == [(p, 0.667) for p in blue]
    assert most_joined(found) < 10_000


def most_joined(found) -> int:
    """The most rows that a join of an executed query gives out; nothing is known of plans that adaptive execution left."""
    total, waiting = 0, [found._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
            continue
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            total = max(total, node.metrics().apply("numOutputRows").value())
        if "QueryStage" in node.nodeName():
            waiting.append(node.plan())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return total


def test_rows_of_a_frequent_word_are_cut_before_they_meet_probes(spark):
    """200 probes share words with all 2,000 rows: not 400,000 rows but each probe's first 20 leave the joins."""
    probes = spark.range(200).selectExpr("id AS probe", "case when id % 2 = 0 then 'red bolt' else 'blue bolt' end AS value")
    probes = probes.unionByName(spark.sql("SELECT 1000L AS probe, explode(array('green', 'ring of', NULL)) AS value UNION ALL SELECT 1001L, 'none'"))
    rows = spark.range(2_000).selectExpr("2000 - id AS item", "case when id % 500 = 3 then 'Green' when id % 500 = 7 then 'ring' when id % 3 = 0 then 'Red bolt' else 'bolt, blue bolt' end AS name")
    rows = rows.unionByName(rows.where("item = 4").selectExpr("item", "'red' AS name"))
    found = X.by_description(probes, rows, "name", ["item"], 20)
    assert found.columns == ["probe", "item", "name"]
    got = {}
    for r in found.collect():
        got.setdefault(r.probe, []).append(r.item)
    named = [(r.item, set(r.name.lower().replace(",", "").split())) for r in rows.collect()]
    for probe, wanted in ((0, {"red", "bolt"}), (1, {"blue", "bolt"}), (199, {"blue", "bolt"}), (1000, {"green", "ring"})):
        assert sorted(got[probe]) == sorted({i for i, w in named if w & wanted})[:20]
    assert len(got) == 201 and most_joined(found) < 10_000
