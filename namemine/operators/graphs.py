"""Typed code graphs.

Edges: ``edges(graph_id, src, dst, edge_type)`` as a set (distinct rows). Token nodes are token
positions of a file; tree nodes are ``ast.node_id``. Data-flow edges are windows over token
rows (straight-line code) or a bounded frontier walk over a user-given ``cfg`` (branches).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namemine.functions.masks import mask_literal
from namemine.operators import sequences
from namemine.operators.ancestry import enclosing, nearest_marked
from namemine.session import ensure_checkpoint_dir

# Edge type names, the reversed-type prefix, the sub-graph depth.
REVERSED = "reversed"
NEXT_TOKEN = "NextToken"
LAST_LEXICAL_USE = "LastLexicalUse"
LAST_USE = "LastUse"
LAST_WRITE = "LastWrite"
CHILD = "Child"
COMPUTED_FROM = "ComputedFrom"
FORMAL_ARG_NAME = "FormalArgName"
RETURNS_TO = "ReturnsTo"
GUARDED_BY = "GuardedBy"
GUARDED_BY_NEGATION = "GuardedByNegation"
SUBGRAPH_DEPTH = 8

EDGE_COLUMNS = ["graph_id", "src", "dst", "edge_type"]


def reverse_edges(edges: DataFrame) -> DataFrame:
    """G1: every edge also backwards as ``reversed<Type>``; a reversed type loses the prefix."""
    back = edges.select(
        "graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), _reversed_type(F.col("edge_type")).alias("edge_type"),
    )
    return edge_dedup(edges.select(*EDGE_COLUMNS).unionByName(back))


def edge_dedup(edges: DataFrame) -> DataFrame:
    """Set semantics; edges with a null end are ignored."""
    return edges.dropna(subset=["src", "dst"]).dropDuplicates(EDGE_COLUMNS)


def _token_edge(df: DataFrame, dst: Column, edge_type: str) -> DataFrame:
    return edge_dedup(df.select(
        F.col("file_id").alias("graph_id"), F.col("pos").cast("bigint").alias("src"),
        dst.cast("bigint").alias("dst"), F.lit(edge_type).alias("edge_type"),
    ))


def next_token(tokens: DataFrame) -> DataFrame:
    """Each token -> the next token of the file (a window per chunk of the file with one
    halo row, so a long file is spread over tasks)."""
    c = sequences.chunked(tokens, before=0, after=1)
    nxt = c.withColumn("_next", F.lead("pos").over(Window.partitionBy("file_id", "_chunk").orderBy("pos")))
    return _token_edge(sequences.unchunk(nxt), F.col("_next"), NEXT_TOKEN)


def _previous_in_group(v: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each row with ``_prev`` = the position of the previous row of its group (file + ``group``).

    Group positions come from bucket offsets and the previous row is found by an equi-join on
    (group, position - 1), so a hot variable is never one window task."""
    keys = ["file_id", *group]
    g = sequences.group_positions(v, keys, ["pos"], out="_gp", coarse=F.floor(F.col("pos") / sequences.CHUNK))
    prev = g.select(*keys, (F.col("_gp") + 1).alias("_gp"), F.col("pos").alias("_prev"))
    return g.join(prev, [*keys, "_gp"], "left")


def last_lexical_use(tokens: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Variable token -> previous variable token with the same text (G13 adds ``is_target``
    to the partition to split target and non-target occurrences)."""
    v = tokens.where(F.col("decl_id").isNotNull())
    return _token_edge(_previous_in_group(v, ["token", *partition]), F.col("_prev"), LAST_LEXICAL_USE)


def rewire_target(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """The LastLexicalUse edges that a target variable changes in its own graph: occurrences of
    the target chain among themselves, other occurrences of its text among themselves -> edges with
    the target variable in ``target``. ``targets(file_id, token, target)``: a variable and its text;
    tokens of other texts keep their edges (G4) and aren't touched."""
    t = tokens.where(F.col("decl_id").isNotNull()).join(targets, ["file_id", "token"]) \
        .withColumn("is_target", F.col("decl_id") == F.col("target"))
    linked = _previous_in_group(t, ["target", "is_target"])
    e = linked.select("target", F.col("file_id").alias("graph_id"), F.col("pos").cast("bigint").alias("src"),
                      F.col("_prev").cast("bigint").alias("dst"), F.lit(LAST_LEXICAL_USE).alias("edge_type"))
    return e.dropna(subset=["dst"]).dropDuplicates(["target", *EDGE_COLUMNS])


def child_edges(ast: DataFrame) -> DataFrame:
    """Parent -> child; blank leaves and comments are left out."""
    kids = ast.where(F.col("parent_id").isNotNull() & ~F.col("is_comment") & (F.length(F.trim("text")) > 0))
    return edge_dedup(kids.select(
        F.col("method_id").alias("graph_id"), F.col("parent_id").alias("src"), F.col("node_id").alias("dst"),
        F.lit(CHILD).alias("edge_type"),
    ))


def last_use(tokens: DataFrame, self_edges: str | None = None) -> DataFrame:
    """Usage -> previous usage of the same declaration (straight-line code). ``self_edges`` names a flag of
    usages that are visited twice (operands of unary and compound assignments): their second visit finds the first
    one as the last use, an edge to themselves. Last writes (G7) don't change on a second visit."""
    v = tokens.where(F.col("decl_id").isNotNull())
    edges = _token_edge(_previous_in_group(v, ["decl_id"]), F.col("_prev"), LAST_USE)
    if self_edges is None:
        return edges
    return edges.unionByName(_token_edge(v.where(F.col(self_edges)), F.col("pos"), LAST_USE))


def last_write(tokens: DataFrame, chunk: int = sequences.CHUNK) -> DataFrame:
    """Usage -> latest write strictly before it (as-of join; the write position itself still
    sees the older write); see :func:`sequences.latest_flagged`."""
    v = tokens.where(F.col("decl_id").isNotNull())
    found = sequences.latest_flagged(v, ["file_id", "decl_id"], F.col("is_write"), "_lw", chunk=chunk)
    return _token_edge(found, F.col("_lw"), LAST_WRITE)


def straight_runs(cfg: DataFrame, chunk: int = sequences.CHUNK) -> DataFrame:
    """``file_id, pos, run``: the straight run of every node of ``cfg``, named by its first node. A run
    goes on from p to p + 1 while p has no other successor and p + 1 no other predecessor."""
    edges = cfg.select("file_id", "from", "to").distinct()
    outs = edges.groupBy("file_id", F.col("from").alias("pos")).agg(F.count("*").alias("n_out"))
    ins = edges.groupBy("file_id", F.col("to").alias("pos")).agg(F.count("*").alias("n_in"))
    on = (edges.where(F.col("to") == F.col("from") + 1)
          .join(outs.where("n_out = 1"), (edges["file_id"] == outs["file_id"]) & (edges["from"] == outs["pos"]), "left_semi")
          .join(ins.where("n_in = 1"), (edges["file_id"] == ins["file_id"]) & (edges["to"] == ins["pos"]), "left_semi")
          .select("file_id", F.col("to").alias("pos"), F.lit(False).alias("head")))
    nodes = edges.select("file_id", F.col("from").alias("pos")).union(edges.select("file_id", "to")).distinct()
    told = nodes.join(on, ["file_id", "pos"], "left").withColumn("head", F.coalesce("head", F.lit(True)))
    return sequences.latest_flagged(told, ["file_id"], F.col("head"), "run", inclusive=True, chunk=chunk).select("file_id", "pos", "run")


def flow_last_use_write(uses: DataFrame, cfg: DataFrame, max_rounds: int | None = None, chunk: int = sequences.CHUNK) -> DataFrame:
    """Last uses and last writes along a control-flow graph: from every use walk the ``cfg``
    backwards; every use (every write) of the same variable met first on some way is a last
    use (a last write) -> edges.

    ``uses(file_id, pos, decl_id, is_write)``, ``cfg(file_id, from, to)`` between token positions.
    Inside a straight run the answer is a scan. Only (variable, run) pairs whose first use isn't
    preceded by a marked one walk back, from run to run (a straight chain of any length takes no
    round), with a visited set, until the frontier is empty; ``max_rounds`` raises instead of dropping
    edges.
    """
    ensure_checkpoint_dir(uses.sparkSession)
    runs = straight_runs(cfg, chunk).checkpoint()
    to_run = runs.select("file_id", F.col("pos").alias("to"), "run").where(F.col("to") == F.col("run"))
    from_run = runs.select("file_id", F.col("pos").alias("from"), F.col("run").alias("before"))
    steps = cfg.select("file_id", "from", "to").distinct().join(to_run, ["file_id", "to"]).join(from_run, ["file_id", "from"]) \
        .select("file_id", F.col("run").alias("at"), F.col("before").alias("next")).distinct().checkpoint()
    # a use outside the graph is a run of its own that nothing flows into
    placed = uses.select("file_id", "pos", "decl_id", "is_write").join(runs, ["file_id", "pos"], "left") \
        .withColumn("run", F.coalesce("run", "pos"))
    kinds = F.explode(F.array(F.struct(F.lit(LAST_USE).alias("edge_type"), F.lit(True).alias("mark")),
                              F.struct(F.lit(LAST_WRITE).alias("edge_type"), F.col("is_write").alias("mark"))))
    marked = placed.withColumn("k", kinds).select("file_id", "decl_id", "run", "pos", "k.edge_type", "k.mark")
    keys = ["file_id", "decl_id", "edge_type", "run"]
    told = sequences.latest_flagged(marked, keys, F.col("mark"), "last", chunk=chunk).select(*keys, "pos", "mark", "last").checkpoint()
    held = told.where("mark").groupBy("file_id", "decl_id", "edge_type", F.col("run").alias("at")).agg(F.max("pos").alias("last")).checkpoint()
    # a variable that is nowhere marked (never written) has nothing to find: its uses don't walk
    starts = told.where(F.col("last").isNull()).join(held.select("file_id", "decl_id", "edge_type").distinct(), ["file_id", "decl_id", "edge_type"], "left_semi").checkpoint()
    front = starts.select(*keys).distinct().withColumn("at", F.col("run"))
    visited = front.limit(0)
    hits = []
    for r in count():
        if max_rounds is not None and r >= max_rounds:
            raise ValueError(f"the walk isn't over after {max_rounds} rounds")
        seen = front.join(steps, ["file_id", "at"]).select(*keys, F.col("next").alias("at")).distinct()
        fresh = seen.join(visited, [*keys, "at"], "left_anti").join(held, ["file_id", "decl_id", "edge_type", "at"], "left") \
            .select(*keys, "at", "last").checkpoint()
        if fresh.isEmpty():
            break
        hits.append(fresh.where(F.col("last").isNotNull()).select(*keys, "last"))
        visited = visited.unionByName(fresh.select(*keys, "at"))
        if (r + 1) % 8 == 0:
            visited = visited.checkpoint()
        front = fresh.where(F.col("last").isNull()).select(*keys, "at")
    found = told.where(F.col("last").isNotNull()).select("file_id", "pos", "last", "edge_type")
    if hits:
        back = reduce(DataFrame.unionByName, hits).distinct()
        found = found.unionByName(starts.drop("last").join(back, keys).select("file_id", "pos", "last", "edge_type"))
    return edge_dedup(found.select(
        F.col("file_id").alias("graph_id"), F.col("pos").cast("bigint").alias("src"),
        F.col("last").cast("bigint").alias("dst"), "edge_type"))


def subtree_closure(ast: DataFrame, nodes: DataFrame | None = None, max_depth: int | None = None, checkpoint_every: int = 4) -> DataFrame:
    """(ancestor, node, depth) for every node of ``nodes(node_id)`` (default: all of ``ast``) and each
    of its ancestors (depth >= 0), one join per level until no node has a parent left; ``max_depth``
    raises instead of dropping ancestors. Climb only from the nodes that a query asks for."""
    ensure_checkpoint_dir(ast.sparkSession)
    parent = ast.select("node_id", "parent_id").where(F.col("parent_id").isNotNull()) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    wanted = ast if nodes is None else nodes
    cur = wanted.select(F.col("node_id").alias("anc"), "node_id", F.lit(0).alias("depth")).distinct()
    out = cur
    for r in count():
        cur = cur.join(parent.withColumnRenamed("node_id", "anc"), "anc").select(
            F.col("parent_id").alias("anc"), "node_id", (F.col("depth") + 1).alias("depth"))
        cur = cur.checkpoint() if (r + 1) % checkpoint_every == 0 else cur.persist(StorageLevel.MEMORY_AND_DISK)
        if cur.isEmpty():
            break
        if max_depth is not None and r >= max_depth:
            raise ValueError(f"the tree is deeper than {max_depth} levels")
        out = out.unionByName(cur)
    return out


def computed_from(assigns: DataFrame, ast: DataFrame, idents: DataFrame) -> DataFrame:
    """Assigned variable -> every identifier inside the right-hand side.

    ``assigns(graph_id, target, rhs_root)``, ``idents(node_id)``.
    """
    inside = enclosing(ast, assigns.select(F.col("rhs_root").alias("node_id")), idents)
    rhs = assigns.join(inside.withColumnRenamed("anc", "rhs_root"), "rhs_root")
    return edge_dedup(rhs.select("graph_id", F.col("target").alias("src"), F.col("node_id").alias("dst"),
                                 F.lit(COMPUTED_FROM).alias("edge_type")))


def formal_arg_name(args: DataFrame, params: DataFrame) -> DataFrame:
    """Call argument -> parameter at the same position, only when argument and parameter
    counts are equal and both ends are identifiers (null node = not an identifier).

    ``args(graph_id, call_id, callee, ix, node_id)``, ``params(callee, ix, node_id)``.
    """
    na = args.groupBy("call_id", "callee").agg(F.count("*").alias("n"))
    npar = params.groupBy("callee").agg(F.count("*").alias("n"))
    calls = na.join(npar, ["callee", "n"], "left_semi").select("call_id", "callee")
    a = args.join(calls, ["call_id", "callee"], "left_semi")
    p = params.select("callee", "ix", F.col("node_id").alias("param_node"))
    return edge_dedup(a.join(p, ["callee", "ix"]).select(
        "graph_id", F.col("node_id").alias("src"), F.col("param_node").alias("dst"),
        F.lit(FORMAL_ARG_NAME).alias("edge_type"),
    ))


def returns_to(returns: DataFrame, ast: DataFrame,
               method_types: Sequence[str] = ("MethodDeclaration",),
               stop_types: Sequence[str] = ("LambdaExpr", "ClassOrInterfaceDeclaration")) -> DataFrame:
    """Return statement -> nearest enclosing method; none when a lambda or class comes first.

    ``returns(graph_id, node_id)``; nearest = the nearest ancestor of any of these types.
    """
    typed = ast.where(F.col("raw_type").isin(*method_types, *stop_types)).select("node_id", F.col("raw_type").alias("anc_type"))
    near = nearest_marked(ast, typed).select(F.col("node_id").alias("parent_id"), "anc")
    up = returns.join(ast.select("node_id", "parent_id"), "node_id").join(near, "parent_id")
    found = up.join(typed.withColumnRenamed("node_id", "anc"), "anc").where(F.col("anc_type").isin(*method_types))
    return edge_dedup(found.select(
        "graph_id", F.col("node_id").alias("src"), F.col("anc").alias("dst"), F.lit(RETURNS_TO).alias("edge_type"),
    ))


def guarded_by(branches: DataFrame, ast: DataFrame, idents: DataFrame) -> DataFrame:
    """Identifiers in a then / loop body whose variable also occurs in the condition ->
    GuardedBy the condition; in an else branch -> GuardedByNegation.

    ``branches(graph_id, cond_root, body_root, negated)``; ``idents(node_id, decl_id)``.
    """
    in_cond, in_body = (enclosing(ast, branches.select(F.col(c).alias("node_id")), idents).withColumnRenamed("anc", c) for c in ("cond_root", "body_root"))
    cond_vars = in_cond.join(idents, "node_id").select("cond_root", "decl_id").distinct()
    body = branches.join(in_body, "body_root").join(idents, "node_id")
    hit = body.join(cond_vars, ["cond_root", "decl_id"], "left_semi")
    return edge_dedup(hit.select(
        "graph_id", F.col("node_id").alias("src"), F.col("cond_root").alias("dst"),
        F.when(F.col("negated"), F.lit(GUARDED_BY_NEGATION)).otherwise(F.lit(GUARDED_BY)).alias("edge_type"),
    ))


def state_merge(*states: DataFrame) -> DataFrame:
    """G14 merge: add the multisets per key ``(decl_id, ident)`` -> counts."""
    u = states[0]
    for s in states[1:]:
        u = u.unionByName(s)
    return u.groupBy("decl_id", "ident").agg(F.count("*").alias("cnt"))


def state_distinct(state: DataFrame) -> DataFrame:
    """G14 distinct: every identifier once per key."""
    return state.select("decl_id", "ident").dropDuplicates()


def state_subtract(state: DataFrame, other: DataFrame) -> DataFrame:
    """G14 subtract: for keys present in both, remove every identifier that ``other`` holds."""
    keys = state.select("decl_id").distinct().join(other.select("decl_id").distinct(), "decl_id")
    drop = other.select("decl_id", "ident").distinct().join(keys, "decl_id", "left_semi")
    return state.join(drop, ["decl_id", "ident"], "left_anti")


def k_hop_subgraph(edges: DataFrame, roots: DataFrame, depth: int = SUBGRAPH_DEPTH,
                   checkpoint_every: int = 4) -> DataFrame:
    """From the roots of each variable ``roots(decl_id, graph_id, node)``, copy every
    out-edge of the nodes at distance 0..depth-1 together with its reverse -> (decl_id, edges…).

    Breadth-first with a visited set (a superset of a depth-first walk that never re-expands a
    node first met deep). At most ``depth`` rounds over the neighbours of each node; the frontier is persisted and checkpointed.
    Each edge is copied once, from its source; the reverse of a copy is another copy if the graph holds it and the walk
    was at its end, so only the others (see :func:`_missing_reverses`) are made and compared.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.dropDuplicates(EDGE_COLUMNS).select("graph_id", F.col("src").alias("node"), "dst", "edge_type").persist(StorageLevel.MEMORY_AND_DISK)
    near = e.select("graph_id", "node", "dst").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    keys = ["decl_id", "graph_id", "node"]
    visited = roots.select(*keys).distinct().withColumn("last", F.lit(depth <= 1)).persist(StorageLevel.MEMORY_AND_DISK)
    front = visited.drop("last")
    for r in range(depth - 1):
        nxt = front.join(near, ["graph_id", "node"]).select("decl_id", "graph_id", F.col("dst").alias("node")).distinct()
        nxt = nxt.join(visited, keys, "left_anti")
        nxt = nxt.checkpoint() if (r + 1) % checkpoint_every == 0 else nxt.persist(StorageLevel.MEMORY_AND_DISK)
        if nxt.isEmpty():
            break
        visited = visited.unionByName(nxt.withColumn("last", F.lit(r == depth - 2)))
        if (r + 1) % checkpoint_every == 0:
            visited = visited.checkpoint()
        front = nxt
    copied = visited.join(e, ["graph_id", "node"]).select("decl_id", "graph_id", F.col("node").alias("src"), "dst", "edge_type")
    return copied.unionByName(_missing_reverses(visited, e))


def _missing_reverses(visited: DataFrame, e: DataFrame) -> DataFrame:
    """The reverses of the edges copied from ``visited(decl_id, graph_id, node, last)`` that aren't copied edges themselves: those of edges
    without a reverse in the graph, and those that would begin at a node which the walk didn't reach, one step behind its ``last`` nodes."""
    there = e.select("graph_id", F.col("node").alias("_d"), F.col("dst").alias("_s"), F.col("edge_type").alias("_t"), F.lit(True).alias("paired"))
    alike = (F.col("e.graph_id") == F.col("t.graph_id")) & (F.col("dst") == F.col("_d")) & (F.col("node") == F.col("_s")) \
        & _reversed_type(F.col("edge_type")).eqNullSafe(F.col("_t"))
    told = e.alias("e").join(there.alias("t"), alike, "left").select(
        "e.graph_id", "node", "dst", _reversed_type(F.col("edge_type")).alias("edge_type"), F.coalesce("paired", F.lit(False)).alias("paired"))
    single, twin = told.where(~F.col("paired")), told.where("paired")

    def back(nodes: DataFrame, of: DataFrame) -> DataFrame:
        return nodes.join(of, ["graph_id", "node"]).select("decl_id", "graph_id", F.col("dst").alias("src"), F.col("node").alias("dst"), "edge_type")

    reached = visited.select("decl_id", "graph_id", F.col("node").alias("src"))
    behind = back(visited.where("last"), twin).join(reached, ["decl_id", "graph_id", "src"], "left_anti")
    return back(visited, single).unionByName(behind).dropDuplicates(["decl_id", *EDGE_COLUMNS])


def _reversed_type(t: Column) -> Column:
    return F.when(t.startswith(REVERSED), F.substr(t, F.lit(len(REVERSED) + 1))).otherwise(F.concat(F.lit(REVERSED), t))


def remove_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Remove edges and their reverses."""
    return edges.join(reverse_edges(removed), EDGE_COLUMNS, "left_anti")


def node_labels(nodes: DataFrame, target_col: str = "target", label: Column | None = None) -> DataFrame:
    """G17 (and D2): leaf -> masked text (T4 w.r.t. the target variable); inner node -> its
    class name without the first 3 and last 4 chars. ``label`` replaces the rule (D2)."""
    if label is None:
        label = F.when(
            F.col("is_leaf"), mask_literal(F.col("text"), F.col("lit_type"), F.col("decl_id"), F.col(target_col))
        ).otherwise(F.expr("substring(raw_type, 4, length(raw_type) - 7)"))
    return nodes.withColumn("label", label)


def graph_record(nodes: DataFrame, edges: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Per variable: node map ``{index: label}`` and edge lists per type of index pairs, with what
    ``variables(decl_id, file, name, types, span)`` says of it.

    ``nodes(decl_id, node, label)``; ``edges(decl_id, src, dst, edge_type)``; node indices are
    dense per variable in node order. A variable without nodes, or not among ``variables`` (no identifier, no usage), gets no record.

    Nodes and edges of a variable, which make one row in the end, are brought together once: an end's index is the number of
    nodes up to it, counted over the variable's nodes and edges in order of that end.
    """
    n = nodes.select("decl_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("string").alias("edge_type"), "label", F.lit(True).alias("_own"))
    rows = n.unionByName(edges.select("decl_id", "src", "dst", "edge_type", F.lit(None).cast("string").alias("label"), F.lit(False).alias("_own")))

    def index(end: str) -> Column:
        w = Window.partitionBy("decl_id").orderBy(F.col(end), F.col("_own").desc()).rowsBetween(Window.unboundedPreceding, 0)
        met = F.last(F.when(F.col("_own"), F.col(end)), ignorenulls=True).over(w) == F.col(end)
        return F.when(F.col("_own") | met, F.sum(F.col("_own").cast("int")).over(w) - 1).cast("int")

    placed = rows.withColumn("si", index("src")).withColumn("di", index("dst"))
    linked = ~F.col("_own") & F.col("si").isNotNull() & F.col("di").isNotNull()
    per_type = placed.where(F.col("_own") | linked).groupBy("decl_id", "_own", "edge_type").agg(
        F.sort_array(F.collect_list(F.when(~F.col("_own"), F.array("si", "di")))).alias("pairs"),
        F.collect_list(F.when(F.col("_own"), F.struct(F.col("si").alias("ix"), "label"))).alias("labels"))
    record = per_type.groupBy("decl_id").agg(
        F.map_from_entries(F.flatten(F.collect_list("labels"))).alias("node_labels"),
        F.map_from_entries(F.collect_list(F.when(~F.col("_own"), F.struct("edge_type", "pairs")))).alias("edges"))
    record = record.where(F.size("node_labels") > 0).withColumn("edges", F.when(F.size("edges") > 0, F.col("edges")))
    return record if variables is None else variables.join(record, "decl_id")
