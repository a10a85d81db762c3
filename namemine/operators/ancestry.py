"""Ancestors in syntax trees by pointer jumping: rounds grow with the logarithm of a tree's depth, rows with its
nodes, so a chain of any depth costs neither a round a level nor a row for each pair of nodes above each other.

``ast`` tables need ``node_id, parent_id`` (null for a root). A node that many others point at is one row on the
joined side, so a skewed join splits the others' side alone. A table whose parents run in a circle raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namemine.session import stored

#: Rounds after which any tree is done: its depth is below two to this power.
_ROUNDS = 62


def _parents(ast: DataFrame) -> DataFrame:
    return ast.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("node_id")).distinct()


def nearest_marked(ast: DataFrame, marked: DataFrame) -> DataFrame:
    """``node_id, anc`` for every node: itself if it is in ``marked(node_id)``, else its nearest marked ancestor,
    null if there is none. Each round every pointer that hasn't arrived takes over the pointer of the node that it
    points at, so its reach doubles."""
    flags = marked.select("node_id", F.lit(True).alias("_m"), F.lit(False).alias("_p")).unionByName(_parents(ast).select("node_id", F.lit(False).alias("_m"), F.lit(True).alias("_p"))) \
        .groupBy("node_id").agg(F.max("_m").alias("_m"), F.max("_p").alias("_p"))
    start = ast.select("node_id", "parent_id").join(flags, "node_id", "left")
    own = F.coalesce("_m", F.lit(False))
    every = stored(start.select("node_id", F.when(own, F.col("node_id")).otherwise(F.col("parent_id")).alias("anc"),
                                (own | F.col("parent_id").isNull()).alias("there"), F.coalesce("_p", F.lit(False)).alias("inner")), "nearest")

    def jump(moving: DataFrame, state: DataFrame) -> DataFrame:
        step = state.select(F.col("node_id").alias("anc"), F.col("anc").alias("_anc"), F.col("there").alias("_there"))
        return moving.select("node_id", "anc").join(step, "anc", "left").select(
            "node_id", F.col("_anc").alias("anc"), F.coalesce("_there", F.lit(True)).alias("there"))  # an unknown parent ends the way

    # nothing points at a leaf: the rounds move inner nodes only, leaves follow their parent once
    state = every.where("inner").drop("inner")
    for _ in range(_ROUNDS):
        moving = state.where(~F.col("there"))
        if moving.isEmpty():
            leaves = every.where(~F.col("inner")).drop("inner")
            moved = jump(leaves.where(~F.col("there")), state)
            return state.unionByName(leaves.where("there")).unionByName(moved).select("node_id", "anc")
        state = stored(state.where("there").unionByName(jump(moving, state)), "nearest")
    raise ValueError("the parents of some nodes run in a circle")


def enclosing(ast: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs ``anc, node_id`` of a node of ``nodes(node_id)`` and a node of ``roots(node_id)`` that is an ancestor of
    it or itself. Rows are those pairs and the like ones among roots; no other node of a tree appears."""
    wanted = roots.select("node_id").distinct()
    near = nearest_marked(ast, wanted)
    first = nodes.select("node_id").distinct().join(near, "node_id").where(F.col("anc").isNotNull())
    above = ast.select("node_id", "parent_id").join(wanted, "node_id", "left_semi").join(near.select(F.col("node_id").alias("parent_id"), F.col("anc").alias("up")), "parent_id")
    known = stored(above.where(F.col("up").isNotNull()).select(F.col("node_id").alias("anc"), "up", F.lit(1).cast("long").alias("dist")), "nested")
    reach = 1
    while not (far := known.where(F.col("dist") == reach)).isEmpty():  # known: all pairs up to `reach` roots apart
        further = far.select("anc", F.col("up").alias("_mid")).join(known.select(F.col("anc").alias("_mid"), "up", (F.col("dist") + reach).alias("dist")), "_mid").drop("_mid")
        known = stored(known.unionByName(further), "nested")
        reach *= 2
    pairs = first.select("anc", "node_id")
    return pairs.unionByName(pairs.join(known, "anc").select(F.col("up").alias("anc"), "node_id"))


def jumps(ast: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(``node_id, anc`` of the 1st, 2nd, 4th, ... ancestor as far as a node has one; ``node_id, depth`` with 0 for roots)."""
    state = stored(ast.select("node_id", F.col("parent_id").alias("anc"), F.col("parent_id").isNotNull().cast("long").alias("depth")), "jump")
    levels = []
    for _ in range(_ROUNDS):
        moving = state.where(F.col("anc").isNotNull())
        if moving.isEmpty():
            return levels, state.select("node_id", "depth")
        levels.append(moving.select("node_id", "anc"))
        step = state.select(F.col("node_id").alias("_at"), F.col("anc").alias("_anc"), F.col("depth").alias("_more"))
        moved = moving.join(step, F.col("anc") == F.col("_at"), "left").select(
            "node_id", F.col("_anc").alias("anc"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))
        state = stored(state.where(F.col("anc").isNull()).unionByName(moved), "jump")
    raise ValueError("the parents of some nodes run in a circle")


def common_ancestors(ast: DataFrame, groups: DataFrame, key: str = "decl_id") -> DataFrame:
    """``key, anc``: the innermost node above (not at) all nodes of each group of ``groups(key, node_id)``; groups without one
    are left out. Members rise to the same depth and then by falling powers of two as long as they stay apart; members that
    meet are one row from then on."""
    # members' parents and all above them are inner nodes: only those jump
    inner = stored(ast.select("node_id", "parent_id").join(_parents(ast), "node_id", "left_semi"), "inner")
    levels, depth = jumps(inner)
    known = lambda nodes: nodes.where(F.col("parent_id").isNotNull()).select("node_id", F.col("parent_id").alias("anc"))
    parent = known(inner)
    members = groups.select(key, "node_id").join(known(ast), "node_id", "left").select(key, F.col("anc").alias("at"))
    rootless = members.where(F.col("at").isNull()).select(key).distinct()
    low = members.join(rootless, key, "left_anti").distinct().join(depth.select(F.col("node_id").alias("at"), "depth"), "at")
    least = low.groupBy(key).agg(F.min("depth").alias("least"))
    at = stored(low.join(least, key).select(key, "at", (F.col("depth") - F.col("least")).alias("rise")), "members")
    for j, level in enumerate(levels):
        bit = F.col("rise").bitwiseAND(1 << j) != 0
        up = at.where(bit).join(level.select(F.col("node_id").alias("at"), "anc"), "at").select(key, F.col("anc").alias("at"), "rise")
        at = stored(at.where(~bit).unionByName(up.withColumn("rise", F.col("rise").bitwiseAND(~(1 << j)))).distinct(), "members")
    at = at.select(key, "at") if levels else at.select(key, "at").distinct()

    def apart(rows: DataFrame, column: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo < hi").select(key)

    split = stored(at.join(apart(at, "at"), key, "left_semi"), "apart")
    met = at.join(split.select(key).distinct(), key, "left_anti").select(key, F.col("at").alias("anc"))
    for level in reversed(levels):
        lifted = split.join(level.select(F.col("node_id").alias("at"), "anc"), "at", "left")
        rising = apart(lifted, "anc")
        kept = split.join(rising, key, "left_anti")
        split = stored(kept.unionByName(lifted.join(rising, key, "left_semi").select(key, F.col("anc").alias("at")).distinct()), "apart")
    over = split.join(parent.select(F.col("node_id").alias("at"), "anc"), "at", "left").groupBy(key).agg(
        F.max("anc").alias("hi"), F.count_if(F.col("anc").isNull()).alias("none"), F.min("anc").alias("anc"))
    return met.unionByName(over.where("anc = hi AND none = 0").select(key, "anc"))
