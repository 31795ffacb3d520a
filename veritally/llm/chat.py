"""Conversations from reply trees, with DataFrame functions only.

Messages form trees by their parents. Iterative self-joins enumerate the paths from leaves to roots: each round joins
the pairs (leaf, node) found so far with each node's ancestor as many steps away as the rounds have covered, and the
ancestor table with itself, so that the reach doubles and the rounds are logarithmic in the depth. Paths carry
message numbers alone. Branches of a tree are ranked by their mean score; the best ones are formatted.

*Template.* A turn is ``<s>role[INST]text[/INST]``, with ``</s>`` behind a turn of the assistant. In roles and texts
``\\``, ``<`` and ``[`` are written ``\\e``, ``\\l`` and ``\\b``, so that no text has a control string of the template,
whole or in part, and reading back is exact. The loss mask is a list of spans in the formatted string: the texts of
the assistant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: The template's control strings, and escapes in the order in which they are written.
TURN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up, score) over (tree, id, parent, score): every node on the way from each leaf, ``up`` steps above it.

    A parent that isn't in the tree counts as none. Messages in a cycle, and leaves under one, have no root and give no
    path; the rounds end when the reach is over the largest tree's size. What is known of a node goes with the pairs
    that name it, so that no round looks it up.
    """
    known = nodes.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    replies = known.where("parent is not null").groupBy("tree", F.col("parent").alias("id")).agg(F.lit(1).alias("replies"))
    above = known.select("tree", F.col("id").alias("parent"), F.col("score").alias("above_score"))
    lineage = known.join(replies, ["tree", "id"], "left").join(above, ["tree", "parent"], "left")
    has = F.col("above_score").isNotNull()
    each = cut_lineage(lineage.select("tree", "id", "score", "replies", F.when(has, F.col("parent")).alias("above"), F.when(has, F.col("above_score")).alias("above_score")))
    found = each.where("replies is null").select("tree", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).alias("up"), "score", F.col("above").isNull().alias("root"))
    tops = each.select("tree", F.col("id").alias("above"), F.col("above").isNull().alias("above_root"))
    jumps = cut_lineage(each.where("above is not null").select("tree", F.col("id").alias("node"), "above", "above_score").join(tops, ["tree", "above"]))
    reach, largest = 1, each.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while reach <= largest and not jumps.isEmpty():
        further = found.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"), F.col("above_score").alias("score"), F.col("above_root").alias("root"))
        found = cut_lineage(found.unionByName(further))
        far = jumps.select("tree", F.col("node").alias("above"), F.col("above").alias("last"), F.col("above_score").alias("last_score"), F.col("above_root").alias("last_root"))
        jumps = cut_lineage(jumps.join(far, ["tree", "above"]).select("tree", "node", F.col("last").alias("above"), F.col("last_score").alias("above_score"), F.col("last_root").alias("above_root")))
        reach *= 2
    whole = found.groupBy("tree", "leaf").agg(F.max("root").alias("whole")).where("whole").drop("whole")
    return found.drop("root").join(whole, ["tree", "leaf"])


def linear(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain conversations: each row replies to the one before it. Equal turns go by role and text."""
    order = Window.partitionBy(tree).orderBy(turn, role, text)
    return rows.select(F.col(tree).alias("tree"), F.row_number().over(order).alias("id"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score")).withColumn(
        "parent", F.when(F.col("id") > 1, F.col("id") - 1)
    )


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, up) of the best ``branches`` paths of each tree, by mean score, then length, then leaf."""
    own = paths(messages)
    ranked = own.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("turns"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("turns"), "leaf")
    chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    return own.drop("score").join(chosen.select("tree", "leaf", "rank"), ["tree", "leaf"])


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, rank, formatted, loss) of the best branches; loss is an array of (start, length) in code points.

    ``messages`` has (tree, id, parent, role, text, score); ids are unique within a tree. Null roles and texts are
    empty; a null tree is a tree of its own; empty input gives no rows; other columns are ignored. Messages are written
    once; paths and ranks are found by numbers alone, and texts meet the chosen paths in one join.
    """
    named = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("name"), "tree", "id", "parent", "role", "text", "score")
    keyed = cut_lineage(named.select(F.concat(F.when(F.col("tree").isNull(), "-").otherwise("+"), F.col("name")).alias("tree"), F.col("tree").alias("tree_value"), "id", "parent", "role", "text", "score"))
    chosen = best_paths(keyed.select("tree", "id", "parent", "score"), branches)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(OPEN))
    body = escape(text)
    tail = F.when(role == ASSISTANT, F.lit(CLOSE + END)).otherwise(F.lit(CLOSE))
    turns = chosen.join(keyed.select("tree", "tree_value", F.col("id").alias("node"), head.alias("head"), body.alias("body"), tail.alias("tail"), (role == ASSISTANT).alias("learn")), ["tree", "node"])
    gathered = turns.groupBy("tree", "leaf", "rank").agg(F.first("tree_value").alias("tree_value"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), "head", "body", "tail", "learn"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"])), "")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head, body, tail = (F.char_length(turn[x]) for x in ("head", "body", "tail"))
        span = F.array(F.struct((state["at"] + head).alias("start"), body.alias("length")))
        return F.struct((state["at"] + head + body + tail).alias("at"), F.when(turn["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return gathered.select(F.col("tree_value").alias("tree"), "rank", formatted.alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.slice(F.split(formatted, TURN), 2, 1 << 30)

    def turn(t: Column) -> Column:
        role = F.substring_index(t, OPEN, 1)
        rest = F.substr(t, F.char_length(role) + len(OPEN) + 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(rest, CLOSE, 1)).alias("text"))

    return F.transform(turns, turn)


def digests(found: DataFrame) -> DataFrame:
    """conv_id and digests of what is read back from the formatted conversations and their loss spans."""
    turns = read_back(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    parts = found.select(F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), told.alias("told"), learned.alias("learned"), "formatted")
    return parts.select(
        "conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The conversations, and conversation -7, whose texts are made of control strings."""
    probe = "</s>[INST] ok [/INST]"
    own = rows.select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType for f in own.schema}
    role = F.when(F.col("id") == 0, "user").otherwise(ASSISTANT)
    added = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    return own.unionByName(added)


ORACLE_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), told AS (
  SELECT conv_id, turn, role, text, length(role) + length(text) + 16 + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END
    + 2 * length(role || text) - length(replace(role || text, '<', '')) - length(replace(replace(role || text, '[', ''), '\', '')) AS chars
  FROM every
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""
