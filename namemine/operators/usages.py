"""Usage mining.

Token rows: ``tokens(project, file_id, pos, offset, line, token, kind, lit_type, decl_id, is_decl, is_write)``.
Bounded windows run per (file, chunk of positions) with halo rows (``operators.sequences``), so
a very long file is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namemine.functions.lm import ORDER
from namemine.functions.masks import UNKNOWN_TOKEN, mask_literal
from namemine.operators import sequences
from namemine.operators.ancestry import common_ancestors, enclosing
from namemine.session import never_broadcast

# Tokens before / after a usage in a centred context, and their delimiter.
TOKENS_BEFORE = 20
TOKENS_AFTER = 20
TOKEN_DELIMITER = "▁"


def declarations(tokens: DataFrame) -> DataFrame:
    """All variables declared in a file."""
    return tokens.where(F.col("is_decl") & F.col("decl_id").isNotNull())


def with_declaration(tokens: DataFrame, together: bool = False) -> DataFrame:
    """Usages with the offset of their declaration (``decl_offset``), unnumbered; a reference
    without a declaration in its file is dropped. ``together`` as in :func:`usages`."""
    v = tokens.where(F.col("decl_id").isNotNull())
    if together:
        w = Window.partitionBy("file_id", "decl_id")
        told = v.where(F.col("file_id").isNotNull()).withColumn("_declared", F.max("is_decl").over(w)) \
            .withColumn("decl_offset", F.min(F.when(F.col("is_decl"), F.col("offset"))).over(w))
        return told.where("_declared").drop("_declared")
    decl = v.where(F.col("is_decl")).groupBy("file_id", "decl_id").agg(F.min("offset").alias("decl_offset"))
    return v.join(never_broadcast(decl), ["file_id", "decl_id"])


def usages(tokens: DataFrame, together: bool = False) -> DataFrame:
    """Declaration and references in the same file, ordered by offset -> adds ``usage_ix``.

    The declaration offset comes from a (partially aggregated) group joined back, and the usage
    index from range-partition positions, so a variable with a huge number of usages is not
    one task. A reference without a declaration in its file is dropped. Of tokens whose files lie in a task each already
    (``together``: binding W, hash-partitioned by file), both come from windows in those tasks, without a shuffle of token rows.
    """
    u = with_declaration(tokens, together)
    if together:
        w = Window.partitionBy("file_id", "decl_id").orderBy("offset", "pos")
        return u.withColumn("usage_ix", (F.row_number().over(w) - 1).cast("bigint"))
    return sequences.group_positions(u, ["file_id", "decl_id"], ["offset", "pos"], out="usage_ix",
                                     coarse=F.floor(F.col("offset") / sequences.CHUNK))


def left_ngrams(tokens: DataFrame, order: int = ORDER, together: bool = False) -> DataFrame:
    """For each usage the last ``order`` tokens (the usage last), every token of the same
    variable masked as <unknown> (T5) -> usage rows with ``ngram`` ARRAY<STRING>. ``together`` as in :func:`usages`."""
    before = F.collect_list(F.struct("token", "decl_id"))
    if together:
        win = tokens.withColumn("_w", before.over(Window.partitionBy("file_id").orderBy("pos").rowsBetween(-(order - 1), 0)))
    else:
        c = sequences.chunked(tokens, before=order - 1, after=0)
        win = sequences.unchunk(c.withColumn("_w", before.over(sequences.framed_window(["file_id"], order - 1, 0))))
    masked = F.transform(
        "_w",
        lambda e: F.when(e["decl_id"].isNotNull() & (e["decl_id"] == F.col("decl_id")), F.lit(UNKNOWN_TOKEN))
        .otherwise(e["token"]),
    )
    return usages(win.withColumn("ngram", masked).drop("_w"), together)


def centered_context(tokens: DataFrame, before: int = TOKENS_BEFORE, after: int = TOKENS_AFTER) -> DataFrame:
    """U4: ``before`` tokens + usage + ``after`` tokens, literals and target masked (T4),
    joined by U+2581 -> usage rows with ``context`` STRING."""
    w = sequences.framed_window(["file_id"], before, after)
    c = sequences.chunked(tokens, before=before, after=after)
    win = sequences.unchunk(c.withColumn("_w", F.collect_list(F.struct("token", "lit_type", "decl_id")).over(w)))
    masked = F.transform(
        "_w", lambda e: mask_literal(e["token"], e["lit_type"], e["decl_id"], F.col("decl_id"))
    )
    return usages(win.withColumn("context", F.array_join(masked, TOKEN_DELIMITER)).drop("_w"))


def distance_to_declaration(usage_rows: DataFrame) -> DataFrame:
    """``abs(declaration offset - usage offset)`` (usage rows with ``decl_offset``)."""
    return usage_rows.withColumn("distance", F.abs(F.col("offset") - F.col("decl_offset")))


def variable_features(usage_rows: DataFrame, ngram_col: str = "context") -> DataFrame:
    """One record per variable: name, n-gram list and feature lists in offset order, kind.

    ``variable(file_id, decl_id, variable, ngrams ARRAY<STRING>, other_features ARRAY<ARRAY<INT>>, kind)``;
    a variable's usages live in one file, so the group is bounded by the file size.
    """
    d = distance_to_declaration(usage_rows)
    g = d.groupBy("file_id", "decl_id").agg(
        F.min_by("token", F.struct("offset", "pos")).alias("variable"),
        F.sort_array(F.collect_list(F.struct("offset", "pos", F.col(ngram_col).alias("ng"), "distance")))
        .alias("u"),
        F.min_by("kind", F.struct("offset", "pos")).alias("kind"),
    )
    return g.select(
        "file_id", "decl_id", "variable",
        F.transform("u", lambda e: e["ng"]).alias("ngrams"),
        F.transform("u", lambda e: F.array(e["distance"].cast("int"))).alias("other_features"),
        "kind",
    )


def line_position(tokens: DataFrame) -> DataFrame:
    """0-based line of each token = newlines in the text before it (binding W computes it
    as a running sum over the blank-prefixed pieces)."""
    return tokens.select("file_id", "pos", "token", "line")


def type_list(decls: DataFrame, type_parents: DataFrame, type_col: str = "type") -> DataFrame:
    """U8: declared type followed by its direct supertypes (one level only), in parent order."""
    parents = type_parents.groupBy(F.col("type").alias(type_col)).agg(
        F.sort_array(F.collect_list("parent")).alias("_parents")
    )
    return decls.join(parents, type_col, "left").withColumn(
        "types", F.concat(F.array(F.col(type_col)), F.coalesce("_parents", F.array().cast("array<string>")))
    ).drop("_parents")


def scope_root(uses: DataFrame, ast: DataFrame) -> DataFrame:
    """Smallest tree node above all usages of a variable, ``uses(decl_id, node_id)``; a usage isn't above itself.
    Variables without a common ancestor get none (their file is the scope)."""
    return common_ancestors(ast, uses).withColumnRenamed("anc", "scope_root")


def scope_context(roots: DataFrame, ast: DataFrame, leaves: DataFrame, uses: DataFrame) -> DataFrame:
    """The tokens (leaves) inside each variable's scope root with a target flag ->
    (decl_id, node_id, is_target)."""
    inside = roots.join(enclosing(ast, roots.select(F.col("scope_root").alias("node_id")), leaves).withColumnRenamed("anc", "scope_root"), "scope_root")
    t = uses.select("decl_id", "node_id", F.lit(True).alias("is_target")).distinct()
    return inside.join(t, ["decl_id", "node_id"], "left").select(
        "decl_id", "node_id", F.coalesce("is_target", F.lit(False)).alias("is_target"))
