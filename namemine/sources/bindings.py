"""Adapters that fill the logical tables (tokens, ast, feedback, beams) from the driver's data.


* **W** words: ``documents.text`` tokenised by a regex, project = ``source``, file = ``doc_id``.
* **E** events: ``events.event_type`` per user in (ts, event_id) order, project = ``user_id % 10``.
* **O** order tree: customer -> orders -> lineitem as an ``ast`` table.
* **F** feedback: ``events`` as put / recalculate / ignore / applied actions.
* **B** beams: ``embeddings`` as a beam-search output table.

Users with real source code bring their own ``tokens`` / ``ast`` tables made by any parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namemine.operators.sequences import group_positions
from namemine.session import ensure_checkpoint_dir, never_broadcast, stored
from namemine.sources.tables import read_table

# Fixed values of the word binding.
TOKEN_PATTERN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"
# A piece is a token with the blanks in front of it; offsets are running sums of piece lengths.
PIECE_PATTERN = r"\s*(?:" + TOKEN_PATTERN + ")"
BLANKS = " \t\n\u000b\f\r"
# Characters of texts whose token rows meet in one task.
TASK_CHARS = 1 << 22

TOKEN_COLUMNS = [
    "project", "file_id", "pos", "offset", "line", "token", "kind", "lit_type",
    "decl_id", "is_decl", "is_write",
]


def _first_in(token: Column, lo: str, hi: str) -> Column:
    """First char of ``token`` in [lo, hi] (a plain comparison, no regex per token)."""
    return F.substring(token, 1, 1).between(lo, hi)


def is_lower_word(token: Column) -> Column:
    return _first_in(token, "a", "z")


def is_upper_word(token: Column) -> Column:
    return _first_in(token, "A", "Z")


def is_number(token: Column) -> Column:
    return _first_in(token, "0", "9")


def token_kind(token: Column) -> Column:
    """ident = word starting lower-case (a variable), string = capitalised word (stands for a
    string literal), num = digits, punct = anything else."""
    return (
        F.when(is_lower_word(token), F.lit("ident"))
        .when(is_upper_word(token), F.lit("string"))
        .when(is_number(token), F.lit("num"))
        .otherwise(F.lit("punct"))
    )


def documents(spark: SparkSession, sf_dir: str, *cols: str, by_file: bool = False) -> DataFrame:
    """The documents table (selected columns); ``by_file`` hash-partitions it by document.

    Work that is done inside a row needs no shuffle of texts, unless the table lies in fewer files than there
    are cores to read them: then its rows are dealt out first. Where token rows of a file must
    meet, one shuffle of the texts lets rows made from them stay partitioned by file, so per-file windows
    and groups need no shuffle of token rows, which are many times larger.
    """
    cols = cols or ("doc_id", "text", "lang", "source", "n_chars")
    table = read_table(spark, sf_dir, "documents")
    if not by_file and len(table.inputFiles()) >= spark.sparkContext.defaultParallelism:
        return table.select(*cols)
    rows = table.select(*dict.fromkeys(["doc_id", *cols]))
    if not by_file:
        return rows.repartition("doc_id").select(*cols)
    chars = table.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), "doc_id").select(*cols)


def word_files(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    """``files(project, file_id, path, text, n_chars)`` from documents (whole texts; S2 clamps)."""
    docs = documents(spark, sf_dir, "source", "doc_id", "text", "n_chars", by_file=by_file)
    return docs.select(
        F.col("source").alias("project"),
        F.col("doc_id").alias("file_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        "text",
        F.col("n_chars"),
    )


def word_token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file with the token array (no shuffle; used by array-based n-gram counting)."""
    files = word_files(spark, sf_dir)
    return files.select(
        "project", "file_id",
        F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0).alias("tokens"),
    )


def word_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding W without what its files' other tokens decide (offset, line, declarations): ``project, file_id, pos,
    token, kind, lit_type, decl_id``, made row by row."""
    # the match stands inside the generator: of a column of matches, a size filter would be inferred and
    # pushed below the rows' deal, where it matches every text a second time
    files = word_files(spark, sf_dir)
    rows = files.select("project", "file_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0)).alias("pos", "token"))
    return rows.select("project", "file_id", "pos", "token", *_word_columns(F.col("token"), F.col("file_id")))


def _word_columns(token: Column, file_id: Column) -> list[Column]:
    return [
        token_kind(token).alias("kind"),
        F.when(is_upper_word(token), F.lit("string")).when(is_number(token), F.lit("number")).alias("lit_type"),
        F.when(is_lower_word(token), F.concat(file_id.cast("string"), F.lit(":"), token)).alias("decl_id"),
    ]


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding W: ``tokens`` rows from documents.

    ``decl_id`` = ``doc_id:token`` for words starting lower-case (variables), the first
    occurrence is the declaration; capitalised words stand for string literals.
    ``offset`` and ``line`` are running sums over the blank-prefixed pieces; Catalyst drops
    these windows when a query does not use them.
    """
    files = word_files(spark, sf_dir, by_file=True)
    # one regex pass: each piece is a token with the blanks in front of it; the token is the
    # piece without its leading blanks (\s of the pattern = these six chars)
    rows = files.select(
        "project", "file_id", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE_PATTERN), 0)).alias("pos", "piece")
    ).select(
        "project", "file_id", F.col("pos").cast("int").alias("pos"), "piece",
        F.ltrim("piece", F.lit(BLANKS)).alias("token"),
    )
    in_file = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # per-file windows first; the (file, token) window then reuses the file partitioning
    placed = rows.select(
        "project", "file_id", "pos",
        (F.sum(F.length("piece")).over(in_file) - F.length("token")).cast("int").alias("offset"),
        (F.sum(F.length("piece") - F.length(F.regexp_replace("piece", "\n", ""))).over(in_file))
        .cast("int").alias("line"),
        "token",
    )
    first_pos = F.min("pos").over(Window.partitionBy("file_id", "token"))
    return placed.select(
        "project", "file_id", "pos", "offset", "line", "token",
        *_word_columns(F.col("token"), F.col("file_id")),
        (is_lower_word(F.col("token")) & (F.col("pos") == first_pos)).alias("is_decl"),
        F.lit(False).alias("is_write"),
    )


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding C: the words of ``conversations`` in order of turns, a real vocabulary to rank names from.

    File = conversation, project = ``conv_id`` modulo 10, line = turn; tokens, kinds and variables as in
    binding W. Positions come from per-turn numbers, so a very long conversation is numbered by many tasks; rows
    without a conversation are left out, turns alike follow each other in order of role and text. Written once."""
    turns = read_table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select(
        "conv_id", F.coalesce("turn", F.lit(-1).cast("long")).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text")
    rows = turns.select("conv_id", "turn", "role", F.xxhash64("text").alias("_h"), F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0)).alias("i", "token"))
    placed = group_positions(rows, ["conv_id"], ["turn", "role", "_h", "i"], out="pos", coarse=F.col("turn"))
    firsts = placed.groupBy("conv_id", "token").agg(F.min("pos").alias("_first"))
    told = placed.join(never_broadcast(firsts), ["conv_id", "token"])
    return stored(told.select(
        (F.col("conv_id") % 10).alias("project"), F.col("conv_id").alias("file_id"), "pos", F.col("pos").alias("offset"), F.col("turn").alias("line"), "token",
        *_word_columns(F.col("token"), F.col("conv_id")),
        (is_lower_word(F.col("token")) & (F.col("pos") == F.col("_first"))).alias("is_decl"), F.lit(False).alias("is_write"),
    ), "conversation-tokens")


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding E: one token per event, per user ordered by (ts, event_id), 0-based ``pos``.

    ``decl_id`` = ``user_id:event_type``, first occurrence is the declaration, a purchase
    is a write, ``offset`` = ``event_id``.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    # positions from range partitions, so one very active user is numbered by many tasks
    ev = group_positions(ev, ["user_id"], ["ts", "event_id"], out="pos",
                         coarse=F.date_trunc("hour", F.col("ts")).cast("long"))
    rows = ev.select(
        (F.col("user_id") % 10).alias("project"),
        F.col("user_id").alias("file_id"),
        "pos",
        F.col("event_id").alias("offset"),
        F.lit(0).alias("line"),
        F.col("event_type").alias("token"),
        F.lit("ident").alias("kind"),
        F.lit(None).cast("string").alias("lit_type"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("decl_id"),
        (F.col("event_type") == "purchase").alias("is_write"),
    )
    # first occurrence by a (partially aggregated) group + equi-join, not a per-user window
    firsts = rows.groupBy("file_id", "token").agg(F.min("pos").alias("_first"))
    toks = rows.join(never_broadcast(firsts), ["file_id", "token"]).withColumn(
        "is_decl", F.col("pos") == F.col("_first")).select(*TOKEN_COLUMNS)
    # the token table feeds several branches of every event query: write it once to the
    # shared checkpoint folder instead of recomputing positions per branch
    ensure_checkpoint_dir(spark)
    return toks.checkpoint()


# ---------------------------------------------------------------------------------------------
# Binding O: customer -> orders -> lineitem as a syntax tree; customers are methods.
# ---------------------------------------------------------------------------------------------

# Node types of binding O (customer = method declaration, order = call, line = name).
O_TYPES = {"customer": "MethodDeclaration", "order": "MethodCallExpr", "line": "NameExpr"}
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

AST_COLUMNS = ["file_id", "method_id", "node_id", "parent_id", "child_ix", "raw_type", "op", "text",
               "start", "end", "is_comment", "is_stmt"]


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ast`` rows: customer node (root, id 3k), its orders (id 3k+1, ``child_ix`` by orderkey,
    range = orderkey), their lines (id -(2^31 orderkey + ix) - 1, ``child_ix`` by line attributes,
    range = quantity, text = return flag). A line index is a 32-bit number, so no two nodes
    share an id however many lines an order has."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *[
        c for c in LINE_ORDER if c not in ("l_returnflag",)])
    cnode = cust.select(
        F.col("c_nationkey").alias("file_id"), F.col("c_custkey").alias("method_id"),
        (F.col("c_custkey") * 3).alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"),
        F.lit(0).alias("child_ix"), F.lit(O_TYPES["customer"]).alias("raw_type"),
        F.col("c_name").alias("text"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"),
    )
    oc = orders.join(cust.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    onode = oc.select(
        F.col("c_nationkey").alias("file_id"), F.col("o_custkey").alias("method_id"),
        (F.col("o_orderkey") * 3 + 1).alias("node_id"), (F.col("o_custkey") * 3).alias("parent_id"),
        (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int").alias("child_ix"),
        F.lit(O_TYPES["order"]).alias("raw_type"), F.col("o_orderpriority").alias("text"),
        F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"),
    )
    lo = lines.join(oc.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "c_nationkey"), "l_orderkey")
    ix = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1).cast("int")
    lnode = lo.select("c_nationkey", "o_custkey", "l_orderkey", "l_returnflag", "l_quantity", ix.alias("ix")).select(
        F.col("c_nationkey").alias("file_id"), F.col("o_custkey").alias("method_id"),
        (-(F.col("l_orderkey") * F.lit(1 << 31) + F.col("ix")) - 1).alias("node_id"),
        (F.col("l_orderkey") * 3 + 1).alias("parent_id"), F.col("ix").alias("child_ix"),
        F.lit(O_TYPES["line"]).alias("raw_type"), F.col("l_returnflag").alias("text"),
        F.col("l_quantity").cast("bigint").alias("start"), F.col("l_quantity").cast("bigint").alias("end"),
    )
    nodes = cnode.unionByName(onode).unionByName(lnode)
    return nodes.select(
        *AST_COLUMNS[:6], F.lit(None).cast("string").alias("op"), "text", "start", "end",
        F.lit(False).alias("is_comment"), F.lit(False).alias("is_stmt"),
    )


def stored_order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`order_tree`, written once: for queries that read the tree at several steps, each of which would join and
    number all orders and lines again."""
    return stored(order_tree(spark, sf_dir), "order-tree")


def order_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``methods`` from customers: name = market segment + customer name (camel case), class =
    nation, no body every 11th customer, a constructor when the balance is negative, overriding
    every 5th; modifiers from the segment; return type = nation name."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment", "c_acctbal")
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = cust.join(nation, "c_nationkey", "left")
    return c.select(
        F.col("c_custkey").alias("method_id"), F.col("c_nationkey").alias("class_id"),
        F.concat(F.lower("c_mktsegment"), F.regexp_replace("c_name", "#", "")).alias("name"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("{ return "), F.lower("c_mktsegment"), F.lit("; }"))).alias("body"),
        (F.col("c_acctbal") < 0).alias("is_constructor"),
        (F.col("c_custkey") % 5 == 0).alias("has_super"),
        F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY").alias("is_public"),
        (F.col("c_mktsegment") == "FURNITURE").alias("is_private"),
        (F.col("c_custkey") % 2 == 0).alias("is_static"),
        F.coalesce(F.col("n_name"), F.lit("void")).alias("return_type"),
    )


def order_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``params(method_id, ix, type, name)``: a customer's orders in orderkey order; type from
    the order priority, name ``o<orderkey>``."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("method_id"), (F.row_number().over(w) - 1).cast("int").alias("ix"),
        F.regexp_replace("o_orderpriority", "^[0-9]-| ", "").alias("type"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"),
    )


# ---------------------------------------------------------------------------------------------
# Binding F: events as suggestion feedback; binding B: embeddings as beam-search output.
# ---------------------------------------------------------------------------------------------

# Fixed values of binding F: event type -> feedback action (signup is noise).
F_ACTIONS = {"view": "put", "click": "recalculate", "error": "ignore", "purchase": "applied"}


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feedback(ts, event_id, element, action, value)`` from events."""
    ev = read_table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    action = F.lit(None).cast("string")
    for k, v in F_ACTIONS.items():
        action = F.when(F.col("event_type") == k, F.lit(v)).otherwise(action)
    return ev.select("ts", "event_id", F.col("user_id").alias("element"), action.alias("action"), "value")


BEAM_STEPS = 5
DICT_SIZE = 25


def beam_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``beams(item, step, beam, token_id, logp)``: a label's vectors in order of their ids make
    items of 5 steps each (item = ``label:number``), beam = index of the value in the embedding,
    logp = the value, token_id = |trunc(value * 1000)| mod 25. Every vector and value is a cell."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    ranked = group_positions(emb, ["label"], ["vec_id"], out="rank", coarse=F.floor(F.col("vec_id") / 65536))
    item = F.concat_ws(":", F.col("label").cast("string"), F.floor(F.col("rank") / BEAM_STEPS).cast("string"))
    cells = ranked.select(item.alias("item"), (F.col("rank") % BEAM_STEPS).cast("int").alias("step"), F.posexplode("embedding").alias("beam", "v"))
    v = F.col("v").cast("double")
    return cells.select(
        "item", "step", F.col("beam").cast("int").alias("beam"),
        (F.abs((v * 1000).cast("int")) % DICT_SIZE).cast("int").alias("token_id"), v.alias("logp"),
    )


def beam_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dictionary(token_id, subtoken)`` = nation key -> lower-case nation name."""
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select(F.col("n_nationkey").alias("token_id"), F.lower("n_name").alias("subtoken"))
