"""Chat formatting from reply trees.

Messages name their parents. Pointer doubling (self-joins that halve the distance to the root)
gives every message its branch's length and score; leaves are ranked in their tree by the mean
score of their branch; the chosen branches are enumerated by the same pointers taken from far to
near, and each becomes one conversation.

A turn is ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. Inside roles and texts a backslash is put after every ``<`` that is
followed by any number of backslashes and a ``|``, so no control string can occur there, and taking
one backslash away restores the text. In roles ``%`` and line breaks are written ``%25`` and ``%0A``. The loss mask
is a list of (start, stop) code points of the formatted text that cover the assistant's texts.

Defined results: null roles and texts are empty; a null tree id is a tree of its own; messages whose
parent is null or missing are roots; a message on a cycle, or below one, has no root and is in no
conversation; rows of one tree and message id are one message, the least by (parent, role, text);
branches of equal score are ranked by the leaf's id; an empty table gives no rows; other columns are
ignored.

Scale: the joins are on (tree, message) and number twice the logarithm of the longest branch. A formatted
conversation is one row, so only a single branch meets in one task, never a whole tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstally.llm.frames import picked, stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """[(tree, id, up)] with ``up`` the ancestor 1, 2, 4, ... steps above; and tree, id, length, total of
    every message that reaches a root."""
    up = nodes.select("tree", "id", F.col("parent").alias("up")).join(
        nodes.select("tree", F.col("id").alias("up")), ["tree", "up"], "left_semi"
    ).select("tree", "id", "up")
    state = nodes.select("tree", "id", "score", F.lit(1).cast("long").alias("length")).join(
        up, ["tree", "id"], "left"
    ).withColumnRenamed("score", "total")
    levels, most = [], nodes.count()
    steps = 1
    while True:
        state = stored(state, "branches")
        level = state.where("up is not null").select("tree", "id", "up")
        if steps > most or level.isEmpty():
            return levels, state.where("up is null").select("tree", "id", "length", "total")
        levels.append(level)
        above = state.select(
            "tree", F.col("id").alias("up"), F.col("length").alias("more"),
            F.col("total").alias("added"), F.col("up").alias("next"),
        )
        # Only branches that have not reached their root take another step.
        moved = state.where("up is not null").join(above, ["tree", "up"]).select(
            "tree", "id", (F.col("total") + F.col("added")).alias("total"),
            (F.col("length") + F.col("more")).alias("length"), F.col("next").alias("up"),
        )
        state = state.where("up is null").select("tree", "id", "total", "length", "up").unionByName(moved)
        steps *= 2


def branches(
    messages: DataFrame, best: int | None = 1, tree_id: str = "tree_id", message_id: str = "message_id",
    parent_id: str = "parent_id", role: str = "role", text: str = "text", score: str = "score",
) -> DataFrame:
    """tree_id, leaf_id, rank, turn, role, text of the ``best`` branches of each tree (None: all)."""
    nodes = picked(
        messages, tree=tree_id, id=message_id, parent=parent_id, role=role, text=text, score=score
    ).select(
        F.struct("tree").alias("tree"), "id", "parent", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    nodes = stored(
        nodes.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "id", "m.*"),
        "messages",
    )
    levels, reach = _pointers(nodes)
    leaves = reach.join(nodes.select("tree", F.col("parent").alias("id")).where("id is not null").distinct(), ["tree", "id"], "left_anti")
    ranked = leaves.withColumn("mean", F.col("total") / F.col("length")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "id"))
    )
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    path = stored(
        ranked.select("tree", F.col("id").alias("leaf"), "rank", "id", (F.col("length") - 1).alias("turn")), "path"
    )
    for n, level in reversed(list(enumerate(levels))):
        higher = path.join(level, ["tree", "id"]).select(
            "tree", "leaf", "rank", F.col("up").alias("id"), (F.col("turn") - (1 << n)).alias("turn")
        )
        # Stored, as each step reads the path twice and plans would double with every level.
        path = stored(path.unionByName(higher), "path")
    return path.join(nodes.select("tree", "id", "role", "text"), ["tree", "id"]).select(
        F.col("tree.tree").alias("tree_id"), F.col("leaf").alias("leaf_id"), "rank", "turn", "role", "text"
    )


def formatted(turns: DataFrame) -> DataFrame:
    """tree_id, leaf_id, rank, formatted, loss (array of start, stop): one row per branch."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    key = [F.struct("tree_id").alias("tree"), "leaf_id", "rank"]
    own = turns.select(
        *key, "turn", (F.col("role") == LEARNED).alias("learned"), head.alias("head"), body.alias("body")
    ).withColumn("piece", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("tree", "leaf_id", "rank").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn(
        "start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    ).withColumn("stop", F.col("start") + F.length("body"))
    pieces = F.array_sort(F.collect_list(F.struct("turn", "piece")))["piece"]
    spans = F.array_sort(F.collect_list(F.when(F.col("learned"), F.struct("start", "stop"))))
    return placed.groupBy("tree", "leaf_id", "rank").agg(
        F.array_join(pieces, "").alias("formatted"), spans.alias("loss")
    ).select(F.col("tree.tree_id").alias("tree_id"), "leaf_id", "rank", "formatted", "loss")


def parsed(text: Column) -> Column:
    """The turns (array of role, text) of a formatted conversation."""
    turns = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda t: t != "")
    def turn(t: Column) -> Column:
        at = F.instr(t, "\n")
        return F.struct(
            unescaped_role(t.substr(F.lit(len(START) + 1), at - F.lit(len(START) + 1))).alias("role"),
            unescaped(t.substr(at + F.lit(1), F.length(t))).alias("text"),
        )
    return F.transform(turns, turn)


def learned_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(text.substr(s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))), ""
    )
