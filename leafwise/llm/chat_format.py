"""Operator 6, chat formatting of reply trees.

Messages name their parent.  ``branches`` enumerates root-to-leaf paths with iterative self-joins: every leaf
starts a path of one message, and in round r each path is extended by the message 2^r steps above each of its
ends, while the table of 2^r-step ancestors is joined with itself; a tree of depth d takes log2(d) rounds.
Branches are ranked by the mean score of their messages, and each chosen branch becomes one conversation text
with loss spans over the assistant's words.

Template: ``<|turn|>role<|text|>text<|end|>\\n`` per turn.  Control strings inside roles and texts get a
backslash after their first character (one more where there are some already), which ``unescape`` takes back.

Defined results: null texts and roles are empty; a null tree id is a tree of its own; a parent that does not
exist makes its child a root; rows that repeat a message id within a tree are one message, the smallest row (by
parent, score, role, text) counts; messages that descend from a cycle of parents have no root and yield no branch;
equal scores go to the smaller leaf id; null scores count as 0; repeated turns of a conversation are separate
turns (ordered by role, then text); an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.llm.common import saved
from leafwise.sources.tables import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that are control strings of this template or of common chat templates, without their first character.
TAILS = r"(\|(?:turn|text|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS>>)"


def escape(c):
    return F.regexp_replace(c, r"([<\[])(\\*)" + TAILS, r"$1\\$2$3")


def unescape(c):
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + TAILS, r"$1$2$3")


def one_each(messages: DataFrame, *columns: str) -> DataFrame:
    """One row per tree and message id: the smallest by parent, score and ``columns``."""
    row = F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score"), *[F.coalesce(c, F.lit("")).alias(c) for c in columns])
    return messages.groupBy("tree_id", "message_id").agg(F.min(row).alias("row")).select("tree_id", "message_id", "row.*")


def branches(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """Chosen root-to-leaf paths: tree_id, leaf_id, branch (rank from 1), score, up (steps above the leaf), message_id.

    messages: tree_id, message_id, parent_id, score; ``keep`` is the number of branches per tree (None: all)."""
    nodes = saved(one_each(messages), "nodes")
    same = lambda a, b: F.col(f"{a}.tree_id").eqNullSafe(F.col(f"{b}.tree_id"))
    jump = saved(nodes.alias("c").where("parent_id is not null").join(
        nodes.select("tree_id", "message_id").alias("p"), same("c", "p") & (F.col("c.parent_id") == F.col("p.message_id")))
        .select("c.tree_id", F.col("c.message_id").alias("low"), F.col("p.message_id").alias("high")), "jump")
    first = jump
    leaves = nodes.alias("n").join(jump.alias("j"), same("n", "j") & (F.col("n.message_id") == F.col("j.high")), "left_anti")
    paths = leaves.select("tree_id", F.col("message_id").alias("leaf_id"), F.lit(0).cast("long").alias("up"), "message_id")
    largest = nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 1
    for r in range(max(1, math.ceil(math.log2(largest)) + 1)):
        if jump.limit(1).count() == 0:
            break
        higher = paths.alias("p").join(jump.alias("j"), same("p", "j") & (F.col("p.message_id") == F.col("j.low"))).select(
            "p.tree_id", "leaf_id", (F.col("up") + (1 << r)).alias("up"), F.col("high").alias("message_id"))
        paths = saved(paths.unionByName(higher), "paths")
        jump = saved(jump.alias("a").join(jump.alias("b"), same("a", "b") & (F.col("a.high") == F.col("b.low")))
                     .select("a.tree_id", "a.low", "b.high"), "jump")
    # A rooted path ends at a message without a parent in the table.
    roots = nodes.alias("n").join(first.alias("j"), same("n", "j") & (F.col("n.message_id") == F.col("j.low")), "left_anti")
    scored = paths.alias("p").join(nodes.alias("n"), same("p", "n") & (F.col("p.message_id") == F.col("n.message_id")))
    rooted = scored.join(roots.select(F.col("tree_id").alias("rt"), F.col("message_id").alias("rm")),
                         F.col("rt").eqNullSafe(F.col("p.tree_id")) & (F.col("rm") == F.col("p.message_id")), "left")
    ranked = (rooted.groupBy("p.tree_id", "leaf_id").agg(F.avg("n.score").alias("score"), F.count("rm").alias("rooted"))
              .where("rooted > 0").withColumn("branch", F.row_number().over(
                  W.partitionBy("tree_id").orderBy(F.desc("score"), F.asc("leaf_id")))))
    if keep is not None:
        ranked = ranked.where(F.col("branch") <= keep)
    return paths.alias("p").join(ranked.alias("r"), same("p", "r") & (F.col("p.leaf_id") == F.col("r.leaf_id"))).select(
        "p.tree_id", "p.leaf_id", "branch", "r.score", "up", "message_id")


def format_branches(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """One conversation per chosen branch: tree_id, leaf_id, branch, formatted, loss_spans (start, end in code
    points of ``formatted``: the assistant's texts).  messages: tree_id, message_id, parent_id, score, role, text."""
    chosen = branches(messages, keep)
    said = one_each(messages, "role", "text").select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "role", "text")
    turns = chosen.join(said, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m"))).select(
        "tree_id", "leaf_id", "branch", (-F.col("up")).alias("at"),
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learnt"))
    key = ["tree_id", "leaf_id", "branch"]
    # Where each turn's text begins: a running sum over its branch, on the partitioning that the grouping uses as well.
    before = F.sum(F.length("head") + F.length("body") + len(END)).over(
        W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    begin = (F.coalesce(before, F.lit(0)) + F.length("head")).cast("int")
    joined = turns.withColumn("begin", begin).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("at", "head", "body", "learnt", "begin"))).alias("turns"))
    return joined.select(
        "tree_id", "leaf_id", "branch",
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learnt"]),
                    lambda t: F.struct(t["begin"].alias("start"), (t["begin"] + F.length(t["body"])).alias("end")))
        .alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds what the formatted text says: turns (role, text) and loss_text (what the spans cover, unescaped)."""
    parts = F.split("formatted", r"<\|end\|>\n", -1)
    body = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p):
        cut = F.split(p, r"<\|text\|>", 2)
        return F.struct(unescape(F.substring(cut[0], len(TURN) + 1, 2 ** 31 - 1)).alias("role"), unescape(cut[1]).alias("text"))
    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return conversations.withColumns({"turns": F.transform(body, turn), "loss_text": F.concat_ws("", under)})


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees with one branch: each turn answers the one before."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return conversations.select(F.col("conv_id").alias("tree_id"), at.alias("message_id"), "role", "text").select(
        "tree_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"),
        F.lit(0.0).alias("score"), "role", "text")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    messages = saved(conversation_messages(rows.unionByName(extra)), "messages")
    back = read_back(format_branches(messages))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


Q = {"op6_chat_format": op6_chat_format}
SQL = {"op6_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|(?:turn|text|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS esc,
         regexp_replace(role, '([<\[])(\\*)(\|(?:turn|text|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS esc_role
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(esc_role) + 8 + length(esc) + 8)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""}
