"""Reply trees to conversations: root-to-leaf paths, ranked branches, one formatted text each.

Built-in functions only. Self-joins double the reach of each node's pointer to an ancestor, and
with it the score and length of the branch above, so the rounds grow with the logarithm of the
deepest reply and a round has a row of five numbers per node. Branches are ranked by score and
length. Only for chosen leaves are paths listed: the pointers of all rounds, longest first, add
the ancestors that are still missing, a row per node of the path. Texts meet the chosen paths
once, at the end, where a conversation becomes one row.

Template of a turn: ``### role: text</turn>`` and a line feed. A backslash in a role or text
becomes ``\\-``, the turn end ``\\t``, the turn mark ``\\h`` and, in roles, a colon ``\\c``; so
no text can hold a control string, and what was written can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.session import remove_path, scratch_path
from faultline.sources.tables import write_stage

MARK, SPLIT, END = "### ", ": ", "</turn>\n"
_ESCAPES = (("\\", "\\-"), ("</turn>", "\\t"), ("###", "\\h"))
_COLON = (":", "\\c")


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in (*_ESCAPES, _COLON) if role else _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for plain, code in reversed((_ESCAPES[0], *((_COLON,) if role else ()), *_ESCAPES[1:])):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def linear(messages: DataFrame, tree: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as a tree table: each row answers the one before it.

    Rows of equal order follow by role and text; a null order comes first. Returns tree,
    node, parent, role, text.
    """
    at = Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), role, text)
    rows = messages.select(
        F.col(tree).alias("tree"), F.row_number().over(at).cast("bigint").alias("node"),
        F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.select("tree", "node", F.nullif(F.col("node") - 1, F.lit(0)).alias("parent"), "role", "text")


def _pointers(messages: DataFrame, score: Column | None) -> tuple[DataFrame, list[str]]:
    """Nodes that reach a root (tree, node, parent, score and size of the path), and where the pointers of each round are stored."""
    spark = messages.sparkSession
    nodes = messages.select(
        "tree", "node", "parent", F.coalesce((F.lit(0.0) if score is None else score).cast("double"), F.lit(0.0)).alias("score"))
    nodes = nodes.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(
        F.min("parent").alias("parent"), F.max("score").alias("score"))
    nodes, first_path = _staged(nodes, "reply-nodes")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    rooted = nodes.join(
        known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")) & (F.col("parent") != F.col("node")), "left")
    state, path = _staged(rooted.select(
        "tree", "node", F.col("n").alias("above"), F.col("n").alias("parent"), "score", F.lit(1).cast("bigint").alias("size")), "reply-pointers")
    stored = [path]
    largest = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    remove_path(spark, first_path)
    # After so many doublings only nodes on or below a cycle have an ancestor left.
    while 2 ** (len(stored) - 1) <= largest and not state.where(F.col("above").isNotNull()).isEmpty():
        upper = state.select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("next"), F.col("score").alias("s"), F.col("size").alias("l"))
        longer = state.where(F.col("above").isNotNull()).join(
            upper, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("n"))).select(
            "tree", "node", F.col("next").alias("above"), "parent", (F.col("score") + F.col("s")).alias("score"),
            (F.col("size") + F.col("l")).alias("size"))
        state, path = _staged(state.where(F.col("above").isNull()).unionByName(longer), "reply-pointers")
        stored.append(path)
    return state.where(F.col("above").isNull()).drop("above"), stored


def _leaves(state: DataFrame) -> DataFrame:
    """Nodes that nothing answers: tree, leaf, score, size."""
    parents = state.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    return state.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "score", "size")


def _listed(leaves: DataFrame, stored: list[str]) -> DataFrame:
    """Add path, the node ids from the root, to leaves; the stored pointers are deleted."""
    spark = leaves.sparkSession
    leaves, leaves_path = _staged(leaves, "reply-leaves")
    steps, path = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("up")), None
    for k in reversed(range(len(stored))):
        jumps = spark.read.parquet(stored[k]).where(F.col("above").isNotNull()).select(
            F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        more = steps.join(jumps, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("up") + 2 ** k).alias("up"))
        before, (steps, path) = path, _staged(steps.unionByName(more), "reply-steps")
        for old in (before, stored[k]):
            if old is not None:
                remove_path(spark, old)
    ids = steps.groupBy(F.col("tree").alias("t"), F.col("leaf").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("up"), "node"))).alias("steps"))
    listed = leaves.join(ids, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n")))
    return listed.select(*leaves.columns, F.transform("steps", lambda s: s["node"]).alias("path"))


def paths(messages: DataFrame, score: Column | None = None) -> DataFrame:
    """Every root-to-leaf path: tree, leaf, path (node ids from the root), score (sum along it).

    Takes tree, node, parent. A node without parent, with itself or with an unknown node as
    parent is a root. Nodes on or below a cycle have no root and so no path. Repeated rows
    of a node count once. Null scores count 0.
    """
    state, stored = _pointers(messages, score)
    return _listed(_leaves(state), stored).select("tree", "leaf", "path", "score")


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    return write_stage(df, path), path


def best(branches: DataFrame, per_tree: int = 1) -> DataFrame:
    """The best branches of each tree with their rank: higher score, then longer, then smaller leaf.

    Takes tree, leaf, score and path, or instead of the path its size.
    """
    size = F.col("size") if "size" in branches.columns else F.size("path")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), size.desc(), "leaf")
    return branches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)


def formatted(messages: DataFrame, chosen: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, rank, formatted, loss_spans (start from 0 and size, in code points).

    Null roles and texts are empty. The loss covers the texts of the ``learn`` role only. Of
    repeated rows of a node the first by role and text is said, once.
    """
    steps = chosen.select("tree", "rank", F.posexplode("path").alias("at", "node"))
    texts = messages.where(F.col("node").isNotNull()).select(
        F.col("tree").alias("t"), F.col("node").alias("n"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = steps.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
        "tree", "rank", "at", F.concat(F.lit(MARK), escaped(F.col("role"), role=True), F.lit(SPLIT)).alias("head"),
        escaped(F.col("text")).alias("body"), (F.col("role") == learn).alias("learnt"))
    order = Window.partitionBy("tree", "rank").orderBy("at", "head", "body")
    turns = turns.withColumn("last", F.lag("at").over(order)).where(~F.col("last").eqNullSafe(F.col("at"))).drop("last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    turns = turns.select(
        "tree", "rank", "at", "turn", "learnt", F.length("body").alias("size"),
        (F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")).cast("int").alias("start"))
    grouped = turns.groupBy("tree", "rank").agg(
        F.array_sort(F.collect_list(F.struct("at", "start", "size", "learnt", "turn"))).alias("turns"))
    return grouped.select(
        "tree", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["learnt"]),
            lambda t: F.struct(t["start"].alias("start"), t["size"].alias("size"))).alias("loss_spans"))


def turns_of(text: Column) -> Column:
    """The turns in a formatted text: an array of role and text."""
    parts = F.filter(F.split(text, END, -1), lambda t: t != "")
    head = lambda t: F.substring_index(t, SPLIT, 1)
    return F.transform(parts, lambda t: F.struct(
        unescaped(F.substr(head(t), F.lit(len(MARK) + 1)), role=True).alias("role"),
        unescaped(F.substr(t, F.length(head(t)) + len(SPLIT) + 1)).alias("text")))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(F.substr(text, s["start"] + 1, s["size"]))), "")


def conversations(messages: DataFrame, score: Column | None = None, per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """Tree table to formatted conversations: branches, ranks, paths of the chosen ones, texts."""
    state, stored = _pointers(messages, score)
    return formatted(messages, _listed(best(_leaves(state), per_tree), stored), learn)
