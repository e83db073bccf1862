"""Operator 4: chat formatting of reply trees.

Messages name their parent. Root-to-leaf paths are enumerated by iterative self-joins that double the known distance to
an ancestor in each round, so a tree of depth d takes log2(d) joins; branches are ranked by the sum of their messages'
scores, and each chosen path is formatted as one conversation:

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside roles and texts are escaped: a backslash goes before every backslash, and between the
signs of each `<|`, so that no control string is left and taking one backslash away from each pair restores the text. The loss mask covers the escaped text of each
assistant turn, which starts after the header and ends before `<|im_end|>`.

Defined results: a null text or role is empty; a null conversation id is a conversation of its own; rows that repeat a
message (same conversation and turn) are turns of their own, in the order of role and text; a message whose parent does
not exist is a root, and so is, in a circle of parents, each message whose parent has a greater number; ties of branches go to the smaller
leaf; texts are formatted whole, however long; an empty table gives no conversations but those added.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """Undo escaped(): a backslash stands before each bar and backslash that was escaped."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as reply trees without branches: node numbers in order, the parent is the turn before."""
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.withColumn("node", at).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversation(conv_id: Column) -> Column:
    """A key that a null id has to itself."""
    return F.coalesce(conv_id.cast("string"), F.lit("none"))


def paths(messages: DataFrame) -> DataFrame:
    """c (key of the conversation), leaf, node, height (steps above the leaf) of all messages on all root-to-leaf paths.

    Pointer doubling: `up` holds (node, ancestor 2^k steps above); members at distance d gain those at distance d + 2^k.
    Only numbers are joined; roles and texts stay behind. No path is longer than its conversation: what has an ancestor
    farther away than that comes from a circle, whose backward links are then cut.
    """
    m = written(messages.select(conversation(F.col("conv_id")).alias("c"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    longest = m.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    known = m.select("c", F.col("node").alias("parent")).distinct()
    links = written(m.join(known, ["c", "parent"], "left_semi").select("c", "node", F.col("parent").alias("above")).where("node <> above").distinct())
    while True:
        leaves = m.join(links.select("c", F.col("above").alias("node")).distinct(), ["c", "node"], "left_anti").select("c", F.col("node").alias("leaf")).distinct()
        member = leaves.select("c", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height"))
        up, step = links, 1
        while step <= longest and not up.isEmpty():
            more = member.join(up, ["c", "node"]).select("c", "leaf", F.col("above").alias("node"), (F.col("height") + step).alias("height"))
            member = written(member.union(more))
            far = up.select("c", F.col("above").alias("mid"), "node").join(up.select("c", F.col("node").alias("mid"), "above"), ["c", "mid"]).select("c", "node", "above")
            up, step = written(far.distinct()), step * 2
        if up.isEmpty():
            return member.join(m.select("c", "node", "score").dropDuplicates(["c", "node"]), ["c", "node"])
        circles = up.select("c", F.col("above").alias("node")).distinct()  # after so many steps up, all are on a circle
        links = written(links.join(circles.where("true").withColumn("round", F.lit(True)), ["c", "node"], "left").where("round is null or above < node").drop("round"))


def ranked(members: DataFrame, best: int | None = None) -> DataFrame:
    """Branches of each conversation by score, best first; `best` keeps so many of each."""
    total = members.groupBy("c", "leaf").agg(F.sum("score").alias("branch_score"), F.count("*").alias("n_turns"))
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("branch_score"), "leaf"))
    out = total.withColumn("branch", rank)
    return out if best is None else out.where(F.col("branch") <= best)


def format_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """conv_id, branch, branch_score, formatted and loss_spans (start and length in code points) of each chosen path.

    messages: conv_id, node (unique in its conversation), parent (null at roots), role, text, score.
    """
    members = paths(messages)
    chosen = ranked(members, best)
    said = messages.select(conversation(F.col("conv_id")).alias("c"), "conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit("\n"))
    turn = F.struct((-F.col("height")).alias("k"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == LEARNED).alias("learned"))
    rows = members.join(chosen.select("c", "leaf", "branch", "branch_score"), ["c", "leaf"]).join(said, ["c", "node"])
    whole = rows.groupBy("c", "branch").agg(F.any_value("conv_id").alias("conv_id"), F.any_value("branch_score").alias("branch_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n")))
    # where each turn's body starts: lengths of all before it, summed along the path
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).cast("long").alias("at"),
            F.when(t["learned"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return whole.select("conv_id", "branch", "branch_score", F.array_join(parts, "").alias("formatted"), walk.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, from the formatted text and its loss mask alone."""
    body = F.regexp_replace("formatted", r"<\|im_end\|>\n\z", "")
    cut = F.split(body, r"<\|im_end\|>\n")
    # the header ends at its first line end; an escaped role has none of its own unless the role had
    turn = F.transform(cut, lambda t: F.regexp_replace(t, r"\A<\|im_start\|>", ""))
    n = F.when(F.col("formatted") == "", F.lit(0)).otherwise(F.size(turn)).cast("long")
    said = F.array_join(F.transform(turn, lambda t: F.concat(unescaped(t), F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select(
        "conv_id", n.alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
