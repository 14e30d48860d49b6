"""Chat formatting of reply trees, in DataFrame functions alone.

Iterative self-joins double each message's jump towards the root, so trees of depth d take about
log2 d joins. Leaves stand for root-to-leaf paths and are ranked by the path's score; going back
through the saved jumps marks the messages of each chosen path, which is formatted as one
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch

END = "<|end|>"


def escape(text: Column) -> Column:
    """Reversible; the result has no ``<``, with which every control string begins."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#124;"), F.lit("|")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(escape(role), F.lit("|"), F.lit("&#124;")), F.lit("|>\n"), F.replace(escape(text), F.lit("&#124;"), F.lit("&amp;#124;")), F.lit(END))


def root_to_leaf_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """messages(tree_id, node_id, parent_id, score) -> (tree_id, leaf_id, rank, node_id, depth): the
    messages of each tree's ``keep`` best paths.

    Paths rank by the sum of their scores (null: 0), then length, then smaller leaf. A null parent, or
    one that is missing, makes a root. Messages on a cycle have no root and are left out, as are
    rows with null ids; of rows with the same id one stays.
    """
    base = messages.where("tree_id IS NOT NULL AND node_id IS NOT NULL").dropDuplicates(["tree_id", "node_id"])
    known = base.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    base = base.join(known, ["tree_id", "parent_id"], "left")
    jump = scratch(base.select("tree_id", "node_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).alias("depth")), "jump")
    jumps, rounds = [jump], 0
    while not jump.where("up IS NOT NULL").isEmpty() and rounds < 40:
        above = jump.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        done = jump.where("up IS NULL").select("tree_id", "node_id", "up", "total", "depth")
        jump = jump.where("up IS NOT NULL").join(above, ["tree_id", "up"]).select("tree_id", "node_id", F.col("up2").alias("up"), (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"), F.when(F.col("depth") < (1 << 30), F.col("depth") + F.coalesce("d2", F.lit(0))).otherwise(F.col("depth")).alias("depth"))
        jump = scratch(done.unionByName(jump), "jump")
        jumps.append(jump)
        rounds += 1
    parents = jumps[0].select("tree_id", F.col("up").alias("node_id")).where("node_id IS NOT NULL").distinct()
    leaves = jump.where("up IS NULL").join(parents, ["tree_id", "node_id"], "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("depth"), "node_id")
    path = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("tree_id", F.col("node_id").alias("leaf_id"), "rank", "node_id")
    for level in reversed(jumps[:-1]):
        up = level.where("up IS NOT NULL").select("tree_id", "node_id", "up")
        path = path.unionByName(path.join(up, ["tree_id", "node_id"]).select("tree_id", "leaf_id", "rank", F.col("up").alias("node_id")))
        path = scratch(path, "path")
    return path.join(jump.select("tree_id", "node_id", "depth"), ["tree_id", "node_id"]).select("tree_id", "leaf_id", "rank", "node_id", "depth")


def format_paths(messages: DataFrame, keep: int = 1, trained_role: str = "assistant") -> DataFrame:
    """messages(tree_id, node_id, parent_id, score, role, text) -> (tree_id, leaf_id, rank,
    formatted, loss_turns, loss_spans): a row per chosen path.

    A turn is ``<|role|>``, a line end, the text and ``<|end|>``; control strings in roles and texts
    are escaped reversibly. loss_turns marks the turns of trained_role; loss_spans has the start
    (from 1) and length of their texts in ``formatted``. Null roles and texts count as empty.
    """
    path = root_to_leaf_paths(messages, keep)
    own = messages.dropDuplicates(["tree_id", "node_id"]).select("tree_id", "node_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = path.join(own, ["tree_id", "node_id"]).withColumn("segment", _segment(F.col("role"), F.col("text")))
    turn = turn.withColumn("trained", F.col("role") == trained_role)
    head = F.length(F.substring_index("segment", "|>", 1)) + 3
    run = Window.partitionBy("tree_id", "leaf_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(run), F.lit(0)))
    turn = turn.withColumn("span", F.struct((F.col("at") + head + 1).alias("start"), (F.length("segment") - head - len(END)).cast("long").alias("length")))
    whole = turn.groupBy("tree_id", "leaf_id", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "segment", "trained", "span"))).alias("t"))
    return whole.select(
        "tree_id", "leaf_id", "rank", F.array_join(F.col("t.segment"), "").alias("formatted"), F.col("t.trained").alias("loss_turns"),
        F.transform(F.filter("t", lambda x: x["trained"]), lambda x: x["span"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted(tree_id, formatted, loss_turns) -> (tree_id, turns, loss): the turns as role and
    text, and the trained texts, unescaped, from the output alone."""
    segments = F.split("formatted", "<\\|end\\|>", -1)
    parts = F.slice(segments, F.lit(1), F.size(segments) - 1)
    role = lambda s: F.substring_index(F.substring(s, 3, 1 << 30), "|>", 1)
    turn = lambda s: F.struct(unescape(role(s)).alias("role"), unescape(s.substr(F.length(role(s)) + 6, F.length(s))).alias("text"))
    turns = formatted.select("tree_id", "formatted", "loss_turns", F.transform(parts, turn).alias("turns"))
    masked = F.filter(F.arrays_zip(F.col("turns.text").alias("text"), F.col("loss_turns").alias("on")), lambda x: x["on"])
    return turns.select("tree_id", "formatted", "turns", F.transform(masked, lambda x: x["text"]).alias("loss"))
