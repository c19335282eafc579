"""Chat formatting of reply trees, in DataFrame functions throughout.

Messages name their parents. Iterative self-joins that double the distance to the ancestor each time find every message's depth and
path score; each tree's leaves, the ends of its branches, are ranked by the score of their path, and the chosen leaves' paths are
enumerated by the same doubled steps. Each chosen path is one conversation, formatted by a fixed template:

    <s>[SYS] text </s>    <s>[INST] text </s>    <s>[ANS] text </s>    <s>[ROLE=hex] text </s>

for system, user, assistant and any other role (hex of its UTF-8; a null role is empty), a line feed after each turn. A control
string inside a text gets a backslash before it and before the backslashes that precede it; taking one backslash away again
gives the text back. The loss mask is the list of the places of assistant texts in the formatted string.

Defined results: null texts are empty; messages with equal ids in a tree are all turns of it, in the order of their texts; a parent that
isn't there makes a message a root; messages in a cycle belong to no path and are left out; ties between leaves go to the smaller id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MARKS = {"system": "SYS", "user": "INST", "assistant": "ANS"}
CONTROL = r"</?s>|\[/?(?:SYS|INST|ANS|ROLE=[0-9A-F]*)\]"
TURN = r"(?s)<s>\[(SYS|INST|ANS|ROLE=[0-9A-F]*)\] (.*?) </s>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*(?:{CONTROL}))", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*(?:{CONTROL}))", "$1")


def _mark(role: Column) -> Column:
    known = F.when(F.lit(False), F.lit(""))
    for name, mark in MARKS.items():
        known = known.when(role == name, F.lit(mark))
    return known.otherwise(F.concat(F.lit("ROLE="), F.hex(F.coalesce(role, F.lit("")).cast("binary"))))


def _role(mark: Column) -> Column:
    known = F.when(F.lit(False), F.lit(""))
    for name, m in MARKS.items():
        known = known.when(mark == m, F.lit(name))
    return known.otherwise(F.decode(F.unhex(F.substring_index(mark, "=", -1)), "UTF-8"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Of messages (tree_id, msg_id, parent_id, role, text, score): the paths from root to leaf of each tree's best leaves, as rows
    (tree_id, rank, depth, role, text). A path's score is the sum of its messages' scores; the longer path wins a tie, then the
    smaller leaf. The joins are on (tree, message); their number grows with the logarithm of the depth."""
    ids = messages.groupBy("tree_id", "msg_id").agg(
        F.min("parent_id").alias("up"), F.sum(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("sum")
    )
    nodes = written(ids, "chat-nodes")
    n_nodes = nodes.count()
    there = nodes.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"))
    known = (F.col("tree_id").eqNullSafe(F.col("t"))) & (F.col("up") == F.col("m"))
    first = written(nodes.join(there, known, "left").select("tree_id", "msg_id", F.col("m").alias("up"), F.lit(1).cast("long").alias("far"), "sum"), "chat-hops")
    # far: messages passed so far, the message's own included, and sum their scores; hops: those who still have an ancestor above,
    # the 2^k-th; ended: those whose root is reached
    hops, ended = [first.where("up IS NOT NULL")], first.where("up IS NULL").drop("up")
    while not hops[-1].isEmpty() and 1 << (len(hops) - 1) <= n_nodes:  # beyond, only messages in cycles still have ancestors
        last = hops[-1]

        def jumped(to: DataFrame, up: Column, last: DataFrame = last) -> DataFrame:
            above = to.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), up.alias("up2"), F.col("far").alias("far2"), F.col("sum").alias("sum2"))
            both = last.join(above, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")))
            return both.select("tree_id", "msg_id", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("sum") + F.col("sum2")).alias("sum"))

        done = written(jumped(ended, F.lit(None).cast(last.schema["up"].dataType)).drop("up"), "chat-ended")
        hops.append(written(jumped(last, F.col("up")), "chat-hops"))
        ended = ended.unionByName(done)
    parents = nodes.select(F.col("tree_id").alias("t"), F.col("up").alias("m")).where("m IS NOT NULL").distinct()
    leaves = ended.join(parents, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("m")), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc("sum"), F.desc("far"), "msg_id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = written(chosen.select("tree_id", "rank", "msg_id", F.col("far").alias("depth")), "chat-paths")
    for k in reversed(range(len(hops))):
        step = hops[k].select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "up")
        above = paths.join(step, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("m"))).select(
            "tree_id", "rank", F.col("up").alias("msg_id"), (F.col("depth") - (1 << k)).alias("depth")
        )
        paths = written(paths.unionByName(above), "chat-paths")
    paths = paths.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "rank", "depth")
    return paths.join(
        messages.select("tree_id", "msg_id", "role", "text"), F.col("t").eqNullSafe(F.col("tree_id")) & (F.col("m") == F.col("msg_id"))
    ).select("tree_id", "rank", "depth", "role", F.coalesce("text", F.lit("")).alias("text"))


def formatted(paths: DataFrame) -> DataFrame:
    """One row per path: tree_id, rank, formatted and mask, an array of (start, length) in code points from 0 of the assistant texts as
    they stand there, escaped."""
    turns = paths.select(
        "tree_id", "rank",
        F.struct("depth", F.col("text").alias("t"), F.concat(F.lit("<s>["), _mark(F.col("role")), F.lit("] ")).alias("head"), escaped(F.col("text")).alias("body"),
                 (F.coalesce(F.col("role"), F.lit("")) == "assistant").alias("loss")).alias("turn"),
    )
    whole = turns.groupBy("tree_id", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    tail = " </s>\n"
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["head"])
        n = F.length(t["body"]).cast("long")
        span = F.struct(begin.alias("start"), n.alias("length"))
        return F.struct((begin + n + len(tail)).alias("at"), F.when(t["loss"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return whole.select("tree_id", "rank", text.alias("formatted"), F.aggregate("turns", empty, step, lambda s: s["spans"]).alias("mask"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Of formatted conversations: tree_id, rank, turns (array of role and text, unescaped) and loss_text, all that the mask covers."""
    marks = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    turns = F.zip_with(marks, bodies, lambda m, b: F.struct(_role(m).alias("role"), unescaped(b).alias("text")))
    loss = F.concat_ws("", F.transform("mask", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return conversations.select("tree_id", "rank", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as reply trees: each turn answers the one before it, however turns are numbered."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("msg_id"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return numbered.select(F.col("conv_id").alias("tree_id"), "msg_id", parent.alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the registered query, read back from formatted conversations."""
    each = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read_back(conversations).select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(each, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, regexp_replace(t, '(\\*(?:</?s>|\[/?(?:SYS|INST|ANS|ROLE=[0-9A-F]*)\]))', '\\\1', 'g') AS body,
      CASE coalesce(role, '') WHEN 'system' THEN 'SYS' WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'ANS' ELSE 'ROLE=' || hex(coalesce(role, '')) END AS mark FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || t || chr(10), '' ORDER BY turn, role NULLS FIRST, t)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(mark) + length(body) + 12)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
