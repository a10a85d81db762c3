"""N-gram language model as DataFrame operators.

Model tables:

* ``ngrams(…by, n INT, ngram ARRAY<STRING>, cnt BIGINT)`` - counts of all n-grams, n = 1..order.
* ``contexts(…by, ctx ARRAY<STRING>, cnt BIGINT)`` - count of a context *followed by a token*
  (the empty context holds the number of tokens).

Windows never cross a file. Probabilities use the interpolation fixed in
``namemine.functions.lm``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namemine.operators import sequences
from namemine.functions.lm import (
    LAMBDA, ORDER, TOP_K, UNKNOWN, jm_fold, prefix_drop_last, suffix, usage_priority,
)
from namemine.session import never_broadcast, stored


def _cols(cols: Sequence[str] | str | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


# ---------------------------------------------------------------------------------------------
# windows over token rows
# ---------------------------------------------------------------------------------------------

def with_window(tokens: DataFrame, order: int = ORDER, file_cols: Sequence[str] = ("file_id",),
                token_col: str = "token", out: str = "win") -> DataFrame:
    """Add ``out`` = the last ``order`` tokens of the file, the current one last (U3 shape).

    The window runs per (file, chunk of positions) with the few rows it needs from the previous
    chunk copied in, so even a file holding a large share of all rows is spread over tasks.
    """
    c = sequences.chunked(tokens, before=order - 1, after=0)
    w = sequences.framed_window(file_cols, order - 1, 0)
    return sequences.unchunk(c.withColumn(out, F.collect_list(token_col).over(w)))


def _explode_suffixes(df: DataFrame, keep: Sequence[str], win: str = "win") -> DataFrame:
    """One row per suffix of ``win``: the n-grams ending at the current token."""
    grams = F.transform(F.sequence(F.lit(1), F.size(win)), lambda n: suffix(F.col(win), n))
    return df.select(*keep, F.explode(grams).alias("ngram"))


# ---------------------------------------------------------------------------------------------
# counting
# ---------------------------------------------------------------------------------------------

def ngram_counts(tokens: DataFrame, order: int = ORDER, by: Sequence[str] | str | None = None,
                 file_cols: Sequence[str] = ("file_id",), token_col: str = "token", dealt: bool = False) -> DataFrame:
    """M1: counts of every n-gram (n = 1..order) of every file, grouped by ``by`` (a model scope).

    Map-side partial aggregation absorbs the hot unigrams before the shuffle. Of a large vocabulary (``dealt``), where few
    windows are alike, each window is shuffled once instead of all its suffixes (:func:`_count_dealt`).
    """
    by = _cols(by)
    win = with_window(tokens, order, file_cols, token_col)
    if dealt:
        return _count_dealt(win.select(*by, "win"), by, order)
    grams = _explode_suffixes(win, by)
    return grams.groupBy(*by, F.size("ngram").alias("n"), "ngram").agg(F.count("*").alias("cnt"))


#: N-grams of this many tokens and more are counted where their last tokens are dealt to.
_DEALT = 3


def _count_dealt(windows: DataFrame, by: list[str], order: int, win: str = "win") -> DataFrame:
    """Counts of all suffixes of ``win`` (at most ``order`` tokens) of a large vocabulary, where few windows are alike.

    A window is shuffled once, to the task of its last tokens: there all its longer suffixes meet those of the other
    windows, so no row for each suffix is shuffled. Shorter n-grams follow from the counts of those one token longer, and
    from the windows at the beginning of a file, which are as short."""
    w, deep = F.col(win), min(_DEALT, order)
    dealt = windows.where(F.size(w) > 0).select(*by, w, F.xxhash64(F.slice(w, F.greatest(F.size(w) - deep + 1, F.lit(1)), deep)).alias("_h")).repartition(*by, "_h")
    grams = F.transform(F.sequence(F.least(F.size(w), F.lit(deep)), F.size(w)), lambda n: suffix(w, n))
    # equal n-grams have equal hashes: the hash only keeps the rows where they are
    counts = dealt.select(*by, "_h", F.explode(grams).alias("ngram")).groupBy(*by, "_h", "ngram").agg(F.count("*").alias("cnt")) \
        .select(*by, F.size("ngram").alias("n"), "ngram", "cnt")
    levels, rest = [counts.where(F.col("n") >= deep)], counts.where(F.col("n") <= deep)
    for n in range(deep - 1, 0, -1):
        shorter = F.when(F.size("ngram") > n, F.slice("ngram", 2, n)).otherwise(F.col("ngram"))
        # the size as an aggregate: a filter on it stays above, so the shuffle serves this level and the next
        rest = rest.select(*by, shorter.alias("ngram"), "cnt").groupBy(*by, "ngram").agg(F.max(F.size("ngram")).alias("n"), F.sum("cnt").alias("cnt")) \
            .select(*by, "n", "ngram", "cnt")
        levels.append(rest.where(F.col("n") == n))
    return reduce(DataFrame.unionByName, levels)


def ngram_counts_from_arrays(files: DataFrame, order: int = ORDER, by: Sequence[str] | str | None = None,
                             tokens_col: str = "tokens") -> DataFrame:
    """M1 for files given as one row with a token array (no window over token rows).

    Same result as :func:`ngram_counts`; used when the tokenizer yields arrays (binding W,
    the change-log stream R1).
    """
    by = _cols(by)
    t = F.col(tokens_col)
    # an empty file gives one empty window, dropped by the filter (sequence(1, 0) counts down)
    windows = F.filter(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))),
        lambda i: F.slice(t, F.greatest(F.lit(1), i - order + 1), F.least(i, F.lit(order))),
    ), lambda w: F.size(w) > 0)
    return _count_dealt(files.select(*by, F.explode(windows).alias("win")), by, order)


def context_counts(ngrams: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    """M2: count of each context followed by a token = sum over the n-grams that extend it."""
    by = _cols(by)
    return ngrams.groupBy(*by, prefix_drop_last(F.col("ngram")).alias("ctx")).agg(
        F.sum("cnt").alias("cnt")
    )


def add_counts(*models: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    """Add count tables (learn a project into a global model)."""
    by = _cols(by)
    u = models[0]
    for m in models[1:]:
        u = u.unionByName(m)
    return u.groupBy(*by, "n", "ngram").agg(F.sum("cnt").alias("cnt"))


def unlearn(ngrams: DataFrame, removed: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    """M3: subtract the counts of ``removed`` (same shape); drop n-grams that reach zero."""
    by = _cols(by)
    neg = removed.select(*by, "n", "ngram", (-F.col("cnt")).alias("cnt"))
    return (
        ngrams.select(*by, "n", "ngram", "cnt").unionByName(neg)
        .groupBy(*by, "n", "ngram").agg(F.sum("cnt").alias("cnt"))
        .where(F.col("cnt") > 0)
    )


def vocab_size(ngrams: DataFrame) -> Column:
    """V = number of distinct unigrams, as a scalar subquery (one value, computed once)."""
    return ngrams.where(F.col("n") == 1).select(F.count("*").cast("double")).scalar()


# ---------------------------------------------------------------------------------------------
# M6 / M7: probability and usage priority of sequences
# ---------------------------------------------------------------------------------------------

def _suffix_terms(seqs: DataFrame, ids: list[str], seq_col: str, ngrams: DataFrame,
                  contexts: DataFrame, scope: list[str], minus: tuple[DataFrame, DataFrame | None] | None = None,
                  minus_keys: Sequence[str] = ()) -> DataFrame:
    """Rows (ids, k, c_k, x_k) for k = 1..len(seq): count of the last k tokens and of its context.

    ``minus`` = (n-gram counts, context counts) keyed by ``minus_keys`` (columns of ``seqs``) are
    subtracted: leave-one-out without touching the model (M4, M5).
    """
    s = F.col(seq_col)
    keep = list(dict.fromkeys([*ids, *scope, *minus_keys]))
    # a row carries the suffix alone: its context is cut from it where it is asked for
    ex = seqs.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda k: suffix(s, k))).alias("g"))
    g = F.col("g")
    c = ngrams.select(*scope, F.col("ngram").alias("g"), F.col("cnt").alias("c"))
    # the empty context is one value for all sequences (of a scope): no key that holds a row of
    # every sequence; its rows are dealt by their own token and match nothing
    x = contexts.where(F.size("ctx") > 0).select(*[F.col(k).alias(f"_x_{k}") for k in scope], F.col("ctx").alias("_x_ctx"), F.col("cnt").alias("x"))
    asked = F.when(F.size(g) > 1, prefix_drop_last(g)).otherwise(F.concat(F.array(F.lit("")), g))
    same = reduce(lambda p, k: p & (F.col(k) == F.col(f"_x_{k}")), scope, asked == F.col("_x_ctx"))
    j = ex.join(never_broadcast(c), [*scope, "g"], "left").join(never_broadcast(x), same, "left").drop("_x_ctx", *[f"_x_{k}" for k in scope])
    if scope:  # one row a scope, a small table
        empty = F.col("x0")
        j = j.join(contexts.where(F.size("ctx") == 0).select(*scope, F.col("cnt").alias("x0")), scope, "left")
    else:
        empty = contexts.where(F.size("ctx") == 0).agg(F.sum("cnt").alias("x")).scalar()
    xx = F.coalesce(F.when(F.size(g) == 1, empty).otherwise(F.col("x")), F.lit(0))
    cc = F.coalesce("c", F.lit(0))
    if minus is not None:
        mc = minus[0].select(*minus_keys, F.col("ngram").alias("g"), F.col("cnt").alias("mc"))
        mx = minus[1].select(*[F.col(k).alias(f"_m_{k}") for k in minus_keys], F.col("ctx").alias("_m_ctx"), F.col("cnt").alias("mx"))
        own = reduce(lambda p, k: p & (F.col(k) == F.col(f"_m_{k}")), minus_keys, prefix_drop_last(g) == F.col("_m_ctx"))
        j = j.join(never_broadcast(mc), [*minus_keys, "g"], "left").join(never_broadcast(mx), own, "left")
        cc, xx = cc - F.coalesce("mc", F.lit(0)), xx - F.coalesce("mx", F.lit(0))
    return j.select(*ids, F.size(g).alias("k"), cc.alias("c"), xx.alias("x"))


def _dealt_terms(seqs: DataFrame, ids: list[str], seq_col: str, ngrams: DataFrame, scope: Sequence[str] = (),
                 own: DataFrame | None = None, minus_keys: Sequence[str] = ()) -> DataFrame:
    """As :func:`_suffix_terms` of models whose contexts aren't counted: the suffixes and the n-grams are dealt once, by their
    contexts. There a context's count is the sum of the n-grams that extend it, so no context is counted, written or joined.
    ``own`` (n-grams by ``minus_keys`` and scope) are dealt along and subtracted. The empty context's count isn't told here (``x`` of
    ``k`` = 1 is null), see :func:`_empty_contexts`."""
    s = F.col(seq_col)
    scope, minus_keys = list(scope), [k for k in minus_keys if own is not None]
    where = list(dict.fromkeys([*scope, *minus_keys]))

    def part(rows: DataFrame, g: Column, has: Sequence[str], cnt: Column, less: Column) -> DataFrame:
        keys = [F.col(k) if k in has else F.lit(None).cast(seqs.schema[k].dataType).alias(k) for k in dict.fromkeys([*ids, *where])]
        return rows.select(*keys, g.alias("g"), cnt.alias("cnt"), less.alias("less"))

    none = F.lit(None).cast("bigint")
    asked = part(seqs, F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda k: suffix(s, k))), [*ids, *where], none, none)
    told = ngrams.where(F.size("ngram") > 0)
    for k in scope:
        told = told.where(F.col(k).isNotNull())  # no sequence has the scope null
    both = asked.unionByName(part(told, F.col("ngram"), scope, F.col("cnt"), none))
    if own is not None:
        left = own.where(F.size("ngram") > 0)
        for k in where:
            left = left.where(F.col(k).isNotNull())
        both = both.unionByName(part(left, F.col("ngram"), where, none, F.col("cnt")))
    g = F.col("g")
    # the empty context is one value: its n-grams are dealt by their own token
    ctx = F.when(F.size(g) > 1, prefix_drop_last(g)).otherwise(g)
    both = both.select(*dict.fromkeys([*ids, *where]), F.size(g).alias("k"), ctx.alias("_ctx"), F.element_at(g, -1).alias("_t"), "cnt", "less").repartition(*scope, "_ctx", "k")
    at, by = [*scope, "_ctx", "k"], [*where, "_ctx", "k"]
    both = both.withColumn("c", F.sum("cnt").over(Window.partitionBy(*at, "_t"))).withColumn("x", F.sum("cnt").over(Window.partitionBy(*at)))
    c, x = F.coalesce("c", F.lit(0)), F.coalesce("x", F.lit(0))
    if own is not None:
        both = both.withColumn("mc", F.sum("less").over(Window.partitionBy(*by, "_t"))).withColumn("mx", F.sum("less").over(Window.partitionBy(*by)))
        c, x = c - F.coalesce("mc", F.lit(0)), x - F.coalesce("mx", F.lit(0))
    rows = both.where(F.col("cnt").isNull() & F.col("less").isNull())
    return rows.select(*ids, "k", c.alias("c"), F.when(F.col("k") > 1, x).alias("x"))


def _empty_contexts(rows: DataFrame, ngrams: DataFrame, scope: list[str], own: DataFrame | None, minus_keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``_x1``, the count of the empty context: all tokens (of the scope) less the own ones."""
    alone = ngrams.where(F.size("ngram") == 1)
    if scope:  # one row a scope, a small table
        rows = rows.join(alone.groupBy(*scope).agg(F.sum("cnt").alias("_x1")), scope, "left")
    else:
        rows = rows.withColumn("_x1", alone.agg(F.sum("cnt").alias("x")).scalar())
    x = F.coalesce("_x1", F.lit(0))
    if own is not None:
        less = own.where(F.size("ngram") == 1).groupBy(*minus_keys).agg(F.sum("cnt").alias("_m1"))
        rows = rows.join(never_broadcast(less), list(minus_keys), "left")
        x = x - F.coalesce("_m1", F.lit(0))
    return rows.withColumn("_x1", x).drop("_m1")


def _scored_sequences(seqs: DataFrame, key: list[str], ngrams: DataFrame, contexts: DataFrame | None, seq_col: str, lam: float, scope: list[str],
                      v: Column, minus: tuple[DataFrame, DataFrame | None] | None, minus_keys: Sequence[str], sizes: DataFrame | None) -> DataFrame:
    """Distinct sequences with their probability and the usage priority of what stands before their last token -> (key, p, prio)."""
    dealt = contexts is None and (minus is None or minus[1] is None)
    own = None if minus is None else minus[0]
    rows = seqs.select(*key).distinct()
    if dealt:  # told before the suffixes are made, of which there are many more
        rows = _empty_contexts(rows, ngrams, scope, own, minus_keys)
    # numbered and written once: suffixes and counts carry the number instead of the sequence
    distinct = stored(rows.withColumn("_seq", F.monotonically_increasing_id()), "sequences")
    if dealt:
        terms = _dealt_terms(distinct, ["_seq"], seq_col, ngrams, scope, own, minus_keys)
    else:
        terms = _suffix_terms(distinct, ["_seq"], seq_col, ngrams, context_counts(ngrams, scope) if contexts is None else contexts, scope, minus, minus_keys)
    folded = distinct.join(never_broadcast(terms.groupBy("_seq").agg(
        F.sort_array(F.collect_list(F.struct("k", "c", "x"))).alias("terms")
    )), "_seq")
    if dealt:
        folded = folded.withColumn("terms", F.transform(
            "terms", lambda t: F.struct(t["k"].alias("k"), t["c"].alias("c"), F.coalesce(t["x"], F.col("_x1")).alias("x"))))
    if sizes is not None:
        folded = folded.join(sizes, scope)
    before = F.transform(F.filter("terms", lambda t: t["k"] > 1), lambda t: t["x"])
    return folded.select(*key, jm_fold(F.col("terms"), v, lam).alias("p"), usage_priority(before).alias("prio"))


def jm_probability(seqs: DataFrame, ngrams: DataFrame, contexts: DataFrame | None = None,
                   ids: Sequence[str] | str = ("file_id", "pos"), seq_col: str = "win",
                   lam: float = LAMBDA, scope: Sequence[str] | str | None = None,
                   vocab: Column | None = None, minus: tuple[DataFrame, DataFrame | None] | None = None,
                   minus_keys: Sequence[str] = (), sizes: DataFrame | None = None) -> DataFrame:
    """M6: smoothed P(last token | previous tokens) for each sequence row -> (ids, p).
    ``sizes`` (scope columns, ``v``) gives each scope a vocabulary size of its own. Without ``contexts`` (and none in ``minus``, whose
    n-grams then carry the scope columns) contexts are counted where the n-grams are dealt by them.

    ``ids`` must identify a row of ``seqs``. The distinct sequences are scored once (code and
    event streams repeat the same short sequences very often): each is exploded into its
    suffixes, counts come from two equi-joins on the suffix and on its context, the terms are
    regrouped per sequence and folded in order of k; the rows get their value back by an
    equi-join on the sequence.
    """
    ids, scope = _cols(ids), _cols(scope)
    v = F.col("v") if sizes is not None else vocab if vocab is not None else vocab_size(ngrams)
    key = [*scope, *[k for k in minus_keys if k not in scope], seq_col]
    scored = _scored_sequences(seqs, key, ngrams, contexts, seq_col, lam, scope, v, minus, minus_keys, sizes)
    return seqs.select(*ids, *[k for k in key if k not in ids]).join(never_broadcast(scored), key).select(*ids, "p")


def priority_terms(seqs: DataFrame, contexts: DataFrame, ids: list[str], seq_col: str,
                   scope: list[str], minus_contexts: DataFrame | None = None,
                   minus_keys: Sequence[str] = ()) -> DataFrame:
    """Context counts of the contexts of lengths 1..L-1 that end just before the last token."""
    s = F.col(seq_col)
    body = prefix_drop_last(s)
    mk = [k for k in minus_keys if k not in ids]
    ex = seqs.where(F.size(s) > 1).select(
        *ids, *scope, *mk,
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size(body)), lambda k: suffix(body, k)))
        .alias("_i", "ctx"),
    )
    x = contexts.select(*scope, "ctx", F.col("cnt").alias("x"))
    j = ex.join(never_broadcast(x), [*scope, "ctx"], "left")
    xx = F.coalesce("x", F.lit(0))
    if minus_contexts is not None:
        mx = minus_contexts.select(*minus_keys, "ctx", F.col("cnt").alias("mx"))
        j = j.join(never_broadcast(mx), [*minus_keys, "ctx"], "left")
        xx = xx - F.coalesce("mx", F.lit(0))
    return j.select(*ids, (F.col("_i") + 1).alias("k"), xx.alias("x"))


def usage_priorities(seqs: DataFrame, contexts: DataFrame, ids: Sequence[str] | str = ("file_id", "pos"),
                     seq_col: str = "win", scope: Sequence[str] | str | None = None,
                     minus_contexts: DataFrame | None = None, minus_keys: Sequence[str] = ()) -> DataFrame:
    """M7: usage priority of each sequence -> (ids, prio BIGINT); 1 for a sequence of length 1."""
    ids, scope = _cols(ids), _cols(scope)
    terms = priority_terms(seqs, contexts, ids, seq_col, scope, minus_contexts, minus_keys)
    folded = terms.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("t"))
    pr = folded.select(*ids, usage_priority(F.transform("t", lambda e: e["x"])).alias("prio"))
    return seqs.select(*ids).join(never_broadcast(pr), ids, "left").select(
        *ids, F.coalesce("prio", F.lit(1).cast("bigint")).alias("prio")
    )


# ---------------------------------------------------------------------------------------------
# Candidates and ranked names per variable
# ---------------------------------------------------------------------------------------------

def successors(ngrams: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-``k`` successors of every context by (cnt desc, name) -> (ctx, name, cnt).

    ``row_number() <= k`` is planned as a WindowGroupLimit: a partial limit runs before the
    shuffle, so the hot empty context (the whole vocabulary) is cut to ``k`` rows per task.
    """
    s = ngrams.select(
        prefix_drop_last(F.col("ngram")).alias("ctx"),
        F.element_at("ngram", -1).alias("name"), "cnt",
    )
    w = Window.partitionBy("ctx").orderBy(F.col("cnt").desc(), F.col("name"))
    return s.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def candidates(usage_rows: DataFrame, ngrams: DataFrame, ids: Sequence[str] = ("file_id", "pos"),
               ngram_col: str = "ngram", k: int = TOP_K, known: DataFrame | None = None) -> DataFrame:
    """M9: names that may follow a usage's context: the union over every context suffix
    (the empty one included) of its top-``k`` successors -> (ids, name) distinct.

    The empty context is the same for every usage; its ``k`` names travel as one scalar
    array (a proven bound of ``k``) instead of a join on a single hot key. ``known`` (T2 table)
    keeps only names declared with the usage's ``kind`` (T3): the kinds of a name (few) join
    the successors, before these meet the usages, so frequent names are no hot keys.
    ``ids`` may be coarser than a usage (a variable): its usages' names are then brought together at once.
    """
    ids = list(ids)
    succ = successors(ngrams, k)
    kinds = F.array().cast("array<string>")
    extra = [] if known is None or "kind" in ids else ["kind"]
    if known is not None:
        of_name = known.groupBy(F.col("token").alias("name")).agg(F.collect_set("kind").alias("kinds"))
        succ = succ.join(of_name, "name")
    else:
        succ = succ.withColumn("kinds", kinds)
    body = prefix_drop_last(F.col(ngram_col))
    # sequence(1, 0) would count down, so rows with an empty body are left out here
    ex = usage_rows.where(F.size(body) > 0).select(
        *ids, *extra, F.explode(F.transform(F.sequence(F.lit(1), F.size(body)), lambda j: suffix(body, j))).alias("ctx")
    )
    heard = usage_rows.select(*ids, *extra)
    if "pos" not in ids:
        heard = heard.distinct()
    from_ctx = ex.join(never_broadcast(succ.where(F.size("ctx") > 0).select("ctx", "name", "kinds")), "ctx").select(*ids, *extra, "name", "kinds")
    top = succ.where(F.size("ctx") == 0).agg(F.collect_list(F.struct("name", "kinds"))).scalar()
    from_empty = heard.select(*ids, *extra, F.explode(top).alias("t")).select(*ids, *extra, "t.name", "t.kinds")
    both = from_ctx.unionByName(from_empty)
    if known is not None:
        both = both.where(F.array_contains(F.col("kinds"), F.col("kind")))
    return both.select(*ids, "name").distinct()


def context_table(ngrams: DataFrame, contexts: DataFrame | None, k: int = TOP_K, known: DataFrame | None = None) -> DataFrame:
    """One row per context: ``ctx, x`` (its count), ``top`` (its ``k`` best successors: name, cnt, and the kinds
    the name is known with) and ``cut`` (no other successor has a larger count; 0 if there is none)."""
    if contexts is None:
        return _dealt_context_table(ngrams, k, known)
    first = _with_kinds(successors(ngrams, k + 1), known)
    return _first_and_rest(first, k).join(never_broadcast(contexts.select("ctx", F.col("cnt").alias("x"))), "ctx").select("ctx", "x", "top", "cut")


def _with_kinds(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    return rows.join(known.groupBy(F.col("token").alias("name")).agg(F.collect_set("kind").alias("kinds")), "name", "left")


def _first_and_rest(first: DataFrame, k: int, *also: Column) -> DataFrame:
    ranked = first.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("r"), "name", "cnt", "kinds"))).alias("all"), *also)
    top = F.transform(F.slice("all", 1, k), lambda t: F.struct(t["name"].alias("name"), t["cnt"].alias("cnt"), t["kinds"].alias("kinds")))
    return ranked.withColumn("top", top).withColumn("cut", F.coalesce(F.get("all", F.lit(k))["cnt"], F.lit(0)))


def _dealt_context_table(ngrams: DataFrame, k: int, known: DataFrame | None) -> DataFrame:
    """The context table of n-grams alone: they meet the kinds of their last tokens, then go to their context once, where it is counted and its
    successors are placed. The empty context, which all tokens follow, is limited and counted before it is shuffled."""
    longer = ngrams.where(F.size("ngram") > 1).select(prefix_drop_last(F.col("ngram")).alias("ctx"), F.element_at("ngram", -1).alias("name"), "cnt")
    w = Window.partitionBy("ctx")
    placed = _with_kinds(longer, known).withColumn("_rk", F.row_number().over(w.orderBy(F.col("cnt").desc(), F.col("name")))).withColumn("_x", F.sum("cnt").over(w))
    more = _first_and_rest(placed.where(F.col("_rk") <= k + 1), k, F.max("_x").alias("x")).select("ctx", "x", "top", "cut")
    alone = ngrams.where(F.size("ngram") == 1)
    none = _first_and_rest(_with_kinds(successors(alone, k + 1), known), k).withColumn("x", alone.agg(F.sum("cnt").alias("x")).scalar())
    return more.unionByName(none.select("ctx", "x", "top", "cut"))


def _scored_bodies(bodies: DataFrame, table: DataFrame, v: Column, lam: float) -> DataFrame:
    """``bodies(body)`` distinct -> ``body, prio, cands``: each candidate's ``name, kinds``, its probability as far as
    the listed successors tell it (``low``), what others could add at most (``extra``) and the context lengths and
    weights that could (``open``)."""
    fields = "x", "top", "cut"
    asked = bodies.where(F.size("body") > 0).select("body", F.explode(F.transform(F.sequence(F.lit(1), F.size("body")), lambda j: suffix(F.col("body"), j))).alias("ctx"))
    met = asked.join(never_broadcast(table.where(F.size("ctx") > 0)), "ctx").groupBy("body").agg(F.collect_list(F.struct(F.size("ctx").alias("j"), *fields)).alias("met"))
    none = table.where(F.size("ctx") == 0).select(F.struct(F.lit(0).alias("j"), *fields)).scalar()  # the empty context is one value
    # scalars are columns of their own first: they may not stand inside a higher-order function
    told = bodies.join(never_broadcast(met), "body", "left").withColumn("none", none).withColumn("v", v)
    told = told.withColumn("met", F.array_sort(F.concat(F.array("none"), F.coalesce("met", F.array().cast(met.schema["met"].dataType)))))
    # a context's own suffixes are contexts too, so the lengths met are 0, 1, ..., h - 1
    h = F.size("met")
    live = F.transform("met", lambda m: F.struct(m["j"].alias("j"), m["top"].alias("top"), m["cut"].alias("cut"), (lam * F.pow(F.lit(1 - lam), F.size("met") - 1 - m["j"]) / m["x"]).alias("w")))
    told = told.select("body", "v", usage_priority(F.transform(F.filter("met", lambda m: m["j"] > 0), lambda m: m["x"])).alias("heard"), h.alias("h"), live.alias("live"))
    # longer contexts, unseen, halve the priority once each
    told = told.withColumn("prio", F.greatest(F.lit(1).cast("long"), F.expr("shiftright(IF(h > 1, heard, 0L), size(body) - h + 1)")))
    told = told.withColumn("rest", F.pow(F.lit(1 - lam), F.col("h")) / F.col("v"))
    names = F.array_distinct(F.flatten(F.transform("live", lambda i: F.transform(i["top"], lambda t: F.struct(t["name"].alias("name"), t["kinds"].alias("kinds"))))))

    def listed(i: Column, name: Column) -> Column:
        return F.get(F.filter(i["top"], lambda t: t["name"] == name), F.lit(0))["cnt"]

    def judge(c: Column) -> Column:
        low = F.aggregate("live", F.lit(0.0), lambda a, i: a + F.coalesce(i["w"] * listed(i, c["name"]), F.lit(0.0)))
        left = F.filter("live", lambda i: (i["cut"] > 0) & listed(i, c["name"]).isNull())
        return F.struct(
            c["name"].alias("name"), c["kinds"].alias("kinds"), (low + F.col("rest")).alias("low"),
            F.aggregate(left, F.lit(0.0), lambda a, i: a + i["w"] * i["cut"]).alias("extra"),
            F.transform(left, lambda i: F.struct(i["j"].alias("j"), i["w"].alias("w"))).alias("open"))

    return told.select("body", "prio", F.transform(names, judge).alias("cands"))


def rank_names(usage_rows: DataFrame, ngrams: DataFrame, contexts: DataFrame | None = None,
               known: DataFrame | None = None, k: int = TOP_K, lam: float = LAMBDA,
               ngram_col: str = "ngram") -> DataFrame:
    """Per variable, the ``k`` best names by ``sum over usages of P(name | usage context)
    * prio / sum(prio)`` -> (decl_id, name, p, rank).

    ``usage_rows`` come from U3 (masked left n-grams, usage last). Candidates (M9) are put at
    the last position only; other occurrences of the target stay <unknown>. ``known``
    (T2 table, optional) keeps only names declared with the usage's kind (T3).
    Ties are broken by name (see :func:`top_k`).

    The ranking is a bounded aggregation. A usage meets each of its contexts once, as a row with the context's count and
    its ``k`` best successors: priorities, candidates and nearly all counts come from that one join. A count that
    isn't among a context's best is at most the next one (``cut``), so each candidate has a lower and an
    upper sum; those whose upper sum stays below the variable's ``k``-th lower one are dropped, and only for the
    others are the missing counts looked up.
    """
    table = context_table(ngrams, contexts, k, known)
    u = usage_rows.select("decl_id", *([] if known is None else ["kind"]), prefix_drop_last(F.col(ngram_col)).alias("body"))
    alike = u.where(F.col("decl_id").isNotNull()).groupBy(*u.columns).agg(F.count("*").alias("times"))  # usages that can't be told apart count at once
    scored = _scored_bodies(alike.select("body").distinct(), table, vocab_size(ngrams), lam)
    fits = F.col("cands") if known is None else F.filter("cands", lambda c: F.array_contains(c["kinds"], F.col("kind")))
    # a variable's usages are dealt to one task, each with all its candidates in one row: sums, bounds and places need no more shuffles
    rows = alike.join(never_broadcast(scored), "body").select(
        "decl_id", "body", (F.col("prio") * F.col("times")).alias("prio"),
        F.transform(fits, lambda c: F.struct(c["name"].alias("name"), c["low"].alias("low"), c["extra"].alias("extra"), c["open"].alias("open"))).alias("cands"))
    w = Window.partitionBy("decl_id")
    dealt = rows.repartition("decl_id").withColumn("total", F.sum("prio").over(w))
    each = dealt.select("decl_id", "total", "body", "prio", F.explode("cands").alias("c"))
    asks = F.when(F.size("c.open") > 0, F.struct("body", "prio", F.col("c.open").alias("open")))
    bounds = each.groupBy("decl_id", F.col("c.name").alias("name")).agg(
        F.max("total").alias("total"), (F.sum(F.col("prio") * F.col("c.low")) / F.max("total")).alias("low"),
        (F.sum(F.col("prio") * F.col("c.extra")) / F.max("total")).alias("extra"), F.collect_list(asks).alias("asks"))
    placed = bounds.withColumn("_rk", F.row_number().over(w.orderBy(F.desc("low"))))
    least = F.coalesce(F.max(F.when(F.col("_rk") == k, F.col("low"))).over(w), F.lit(0.0))
    # a margin wider than what top_k rounds
    kept = placed.withColumn("_least", least).where(F.col("low") + F.col("extra") + 2e-12 >= F.col("_least"))
    # a name with nothing to ask goes along with a sequence that weighs nothing
    ask = kept.select("decl_id", "name", "total", "low", F.explode_outer("asks").alias("a")).select(
        "decl_id", "name", "total", "low", "a.body", "a.prio", F.explode_outer("a.open").alias("o"))
    gram = F.when(F.col("o").isNull(), F.array(F.lit(""), F.col("decl_id").cast("string"), F.col("name"))).otherwise(
        F.concat(suffix(F.col("body"), F.col("o.j")), F.array(F.col("name"))))
    grams = ask.select("decl_id", "name", "total", "low", gram.alias("ngram"), F.coalesce(F.col("prio") * F.col("o.w"), F.lit(0.0)).alias("w"))
    grams = grams.groupBy("decl_id", "name", "ngram").agg(F.max("total").alias("total"), F.max("low").alias("low"), F.sum("w").alias("w"))
    found = grams.join(never_broadcast(ngrams.select("ngram", "cnt")), "ngram", "left").select("decl_id", "name", "total", "low", (F.col("w") * F.coalesce("cnt", F.lit(0))).alias("more"))
    exact = found.repartition("decl_id").groupBy("decl_id", "name").agg((F.max("low") + F.sum("more") / F.max("total")).alias("p"))
    return top_k(exact, ["decl_id"], k)


def top_k(scored: DataFrame, by: Sequence[str], k: int = TOP_K, score: str = "p",
          name: str = "name") -> DataFrame:
    """At most ``k`` rows per group by (score desc, name) -> adds ``rank`` (1-based).

    Scores are compared on 12 digits: far below the smallest back-stop of a large vocabulary, and
    still the same whatever the order of a sum.
    """
    w = Window.partitionBy(*by).orderBy(F.round(F.col(score), 12).desc(), F.col(name))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------------------------------------
# M8: total probability of the real name
# ---------------------------------------------------------------------------------------------

def total_probability(usage_rows: DataFrame, ngrams: DataFrame, contexts: DataFrame | None = None,
                      ngram_col: str = "ngram", lam: float = LAMBDA) -> DataFrame:
    """M8: per variable ``sum(P * prio) / sum(prio)`` over its usages, P = probability of the
    variable's real name after its masked left context -> (decl_id, p)."""
    u = _named_usages(usage_rows, ngram_col)
    return _weighted(u, ["seq"], _scored_sequences(u, ["seq"], ngrams, contexts, "seq", lam, [], vocab_size(ngrams), None, (), None))


def _named_usages(usage_rows: DataFrame, ngram_col: str = "ngram") -> DataFrame:
    """Each usage's variable and its masked left context with the real name after it."""
    placed = usage_rows.where(F.col("file_id").isNotNull() & F.col("pos").isNotNull())
    return placed.select("decl_id", F.concat(prefix_drop_last(F.col(ngram_col)), F.array(F.col("token"))).alias("seq"))


def _weighted(usages: DataFrame, key: list[str], scored: DataFrame) -> DataFrame:
    """Per variable ``sum(p * prio) / sum(prio)``: the contexts that weigh a usage are those of its sequence, so both come from one lookup."""
    return usages.join(never_broadcast(scored), key).groupBy("decl_id").agg((F.sum(F.col("p") * F.col("prio")) / F.sum("prio")).alias("p"))


# ---------------------------------------------------------------------------------------------
# Context model (all target positions of a variable at once)
# ---------------------------------------------------------------------------------------------

def context_candidates(usage_rows: DataFrame, ngrams: DataFrame, known: DataFrame | None = None,
                       k: int = TOP_K) -> DataFrame:
    """Union over all target positions of the candidates after the context with every
    target masked -> (decl_id, kind, name) distinct, kind-filtered (T3) when ``known`` is given."""
    return candidates(usage_rows, ngrams, ["decl_id", "kind"], "ngram", k, known)


def union_positions(targets: DataFrame, scope_sizes: DataFrame, order: int = ORDER,
                    scope_col: str = "scope_id") -> DataFrame:
    """Positions scored for a variable: union of ``[idx, min(idx + order, n))`` over its target
    positions, each counted once -> (decl_id, scope, i)."""
    t = targets.join(scope_sizes, scope_col)
    return t.select(
        "decl_id", scope_col,
        F.explode(F.sequence(F.col("pos"), F.least(F.col("pos") + order, F.col("n")) - 1)).alias("i"),
    ).distinct()


def _masked_windows(scope_tokens: DataFrame, order: int, scope_col: str) -> DataFrame:
    """Windows of ``order`` tokens ending at every position that is scored for a variable -> (decl_id, scope, i, w).

    Scored are the positions ``[idx, idx + order)`` of the scope after each target position ``idx``, each once: those whose
    last ``order`` positions hold a target. So a position's variables are told by the rows of its own window, and no positions
    are made, compared and joined back."""
    c = sequences.chunked(scope_tokens, before=order - 1, after=0)
    near = Window.partitionBy(scope_col, "_chunk").orderBy("pos").rangeBetween(-(order - 1), 0)
    win = sequences.unchunk(c.withColumn("w", F.collect_list(F.struct("token", "decl_id")).over(sequences.framed_window([scope_col], order - 1, 0)))
                            .withColumn("_seen", F.collect_set("decl_id").over(near)))
    rows = win.where(F.col(scope_col).isNotNull() & F.col("pos").isNotNull())
    return rows.select(F.explode("_seen").alias("decl_id"), scope_col, F.col("pos").alias("i"), "w")


def _is_target(e: Column) -> Column:
    return e["decl_id"].isNotNull() & (e["decl_id"] == F.col("decl_id"))


def substitute(scope_tokens: DataFrame, cands: DataFrame, order: int = ORDER,
               scope_col: str = "scope_id") -> DataFrame:
    """Put each candidate at every target position; one row per scored position with the
    ``order``-token window ending there -> (decl_id, name, i, seq).

    Windows are built once per scope position; the candidate rows multiply only the scored
    positions of their own variable (at most ``k`` candidates per context suffix, M9).
    """
    rows = _masked_windows(scope_tokens, order, scope_col).join(never_broadcast(cands.select("decl_id", "name")), "decl_id")
    seq = F.transform("w", lambda e: F.when(_is_target(e), F.col("name")).otherwise(e["token"]))
    return rows.select("decl_id", "name", "i", seq.alias("seq"))


def context_logprob(scope_tokens: DataFrame, cands: DataFrame, ngrams: DataFrame,
                    contexts: DataFrame | None = None, order: int = ORDER,
                    scope_col: str = "scope_id", lam: float = LAMBDA) -> DataFrame:
    """``sum(log P)`` over the union of scored windows with the candidate substituted ->
    (decl_id, name, logprob). With ``cands`` = the real names this is M16.

    A scored position moves as one row with all names of its variable, not as one for each of them: a window with its targets
    masked (``pat``, ``at``) and the names that stand in (``names``) is a case, cases that are alike are scored once, and
    a position takes the values of its case."""
    if contexts is None:
        contexts = context_counts(ngrams)
    of = cands.groupBy("decl_id").agg(F.array_sort(F.collect_list(F.struct("name"))).alias("names"))
    rows = _masked_windows(scope_tokens, order, scope_col).join(never_broadcast(of), "decl_id").select(
        "decl_id", F.transform("w", lambda e: F.when(~_is_target(e), e["token"])).alias("pat"),
        F.array_join(F.transform("w", lambda e: F.when(_is_target(e), F.lit("1")).otherwise(F.lit("0"))), "").alias("at"), "names")
    rows = stored(rows.withColumn("_h", F.xxhash64("pat", "at", "names")), "scored-positions")
    key = ["_h", "pat", "at", "names"]  # the hash only shortens comparisons
    cases = stored(rows.select(*key).distinct().withColumn("_case", F.monotonically_increasing_id()), "cases")
    seq = F.transform("pat", lambda t, i: F.when(F.substring(F.col("at"), i + 1, F.lit(1)) == "1", F.col("name")).otherwise(t))
    asked = cases.select("_case", "pat", "at", F.explode(F.array_distinct("names")).alias("_n")).select("_case", "pat", "at", "_n.name")
    p = jm_probability(asked.select("_case", "name", seq.alias("seq")), ngrams, contexts, ids=["_case", "name"], seq_col="seq", lam=lam)
    told = p.groupBy("_case").agg(F.collect_list(F.struct("name", F.log("p").alias("lp"))).alias("told"))
    scored = cases.join(never_broadcast(told), "_case").drop("_case")
    each = rows.join(never_broadcast(scored), key).select("decl_id", "names", F.explode("told").alias("t"))
    times = F.size(F.filter("names", lambda n: n["name"].eqNullSafe(F.col("t.name"))))  # a name given twice counts twice
    return each.groupBy("decl_id", F.col("t.name").alias("name")).agg(F.sum(F.col("t.lp") * times).alias("logprob"))


def name_logprob(scope_tokens: DataFrame, ngrams: DataFrame, contexts: DataFrame | None = None,
                 order: int = ORDER, scope_col: str = "scope_id") -> DataFrame:
    """Log probability of the given name in its scope -> (decl_id, name, logprob)."""
    real = scope_tokens.where(F.col("decl_id").isNotNull()).groupBy("decl_id").agg(
        F.min_by("token", "pos").alias("name")
    )
    return context_logprob(scope_tokens, real, ngrams, contexts, order, scope_col)


def softmax(scored: DataFrame, by: Sequence[str] = ("decl_id",), col: str = "logprob",
            temperature: float = 6.0, out: str = "p") -> DataFrame:
    """Softmax with temperature, max-shifted, per group."""
    w = Window.partitionBy(*by)
    z = F.col(col) / temperature
    e = F.exp(z - F.max(z).over(w))
    return scored.withColumn(out, e / F.sum(e).over(w))


# ---------------------------------------------------------------------------------------------
# Mixing models, model choice, collisions
# ---------------------------------------------------------------------------------------------

def collision_filter(preds: DataFrame, visible: DataFrame, scope_col: str = "scope_id") -> DataFrame:
    """Drop names already visible in the variable's scope (``visible(scope, decl_id, name)``),
    except the variable's own name."""
    v = visible.select(scope_col, F.col("decl_id").alias("_other"), "name")
    clash = preds.join(never_broadcast(v), [scope_col, "name"]).where(F.col("_other") != F.col("decl_id")) \
        .select("decl_id", "name").distinct()
    return preds.join(never_broadcast(clash), ["decl_id", "name"], "left_anti")


def mix_rank(preds: DataFrame, prior_weight: int = 1, k: int = TOP_K, min_p: float = 0.001,
             visible: DataFrame | None = None, scope_col: str = "scope_id") -> DataFrame:
    """Merge model predictions ``(decl_id, [scope,] name, p, priority, model)``:
    ``sum(p * priority) / (prior_weight + sum of model priorities)`` per name, drop collisions,
    keep the ``k`` best, **then** drop those below ``min_p`` -> (decl_id, name, p, rank)."""
    keys = ["decl_id", scope_col] if visible is not None else ["decl_id"]
    psum = preds.select("decl_id", "model", "priority").distinct().groupBy("decl_id").agg(
        (F.sum("priority") + F.lit(prior_weight)).alias("psum")
    )
    scored = (
        preds.groupBy(*keys, "name").agg(F.sum(F.col("p") * F.col("priority")).alias("wp"))
        .join(never_broadcast(psum), "decl_id")
        .select(*keys, "name", (F.col("wp") / F.col("psum")).alias("p"))
    )
    if visible is not None:
        scored = collision_filter(scored, visible, scope_col)
    return top_k(scored, ["decl_id"], k).where(F.col("p") >= min_p)


def mix_probability(probs: DataFrame) -> DataFrame:
    """Per variable ``sum(p * priority) / sum(priority)``, 0 when no model has a priority.
    ``probs(decl_id, model, p, priority)``."""
    g = probs.groupBy("decl_id").agg(
        F.sum(F.col("p") * F.col("priority")).alias("wp"), F.sum("priority").alias("ps")
    )
    return g.select("decl_id", F.coalesce(F.col("wp") / F.nullif(F.col("ps"), F.lit(0)), F.lit(0.0)).alias("p"))


def unlikely_names(probs: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Variables whose name probability is below ``threshold``."""
    return probs.where(F.col("p") < threshold)


def model_scope(variables: DataFrame, ngrams: DataFrame, project_col: str = "project",
                global_scope: str = "global") -> DataFrame:
    """Model of each variable: its project's own model if there is one, else the
    unscoped (global) one; no model at all -> priority 0 -> (decl_id, model_scope, priority).

    ``ngrams`` carries a ``scope`` column; the priority of a model is its vocabulary size.
    """
    prio = ngrams.where(F.col("n") == 1).groupBy("scope").agg(F.count("*").alias("priority"))
    own = variables.withColumn("_scope", F.col(project_col).cast("string")).join(
        prio.withColumnRenamed("scope", "_scope"), "_scope", "left"
    ).withColumnRenamed("priority", "own_priority").drop("_scope")
    # the global model's priority is one value: a scalar subquery, no join
    glob = prio.where(F.col("scope") == global_scope).select(F.max("priority")).scalar()
    both = own.withColumn("global_priority", glob)
    return both.select(
        "decl_id",
        F.when(F.col("own_priority").isNotNull(), F.col(project_col).cast("string"))
        .when(F.col("global_priority").isNotNull(), F.lit(global_scope)).alias("model_scope"),
        F.coalesce("own_priority", "global_priority", F.lit(0)).alias("priority"),
    )


# ---------------------------------------------------------------------------------------------
# M4 / M5: leave-one-out without mutating the model
# ---------------------------------------------------------------------------------------------

def loo_probability(tokens: DataFrame, ngrams: DataFrame, contexts: DataFrame | None = None,
                    order: int = ORDER, lam: float = LAMBDA) -> DataFrame:
    """M4: P of every token given its left context with its own file forgotten:
    ``c = total(g) - file(g)``, ``x = total(ctx) - file(ctx)`` by two extra left joins on
    (file_id, n-gram); the vocabulary stays the global one -> (file_id, pos, p)."""
    if contexts is None:
        contexts = context_counts(ngrams)
    file_ng = ngram_counts(tokens, order, by="file_id")
    file_cx = context_counts(file_ng, by="file_id")
    seqs = with_window(tokens, order)
    return jm_probability(seqs, ngrams, contexts, ids=["file_id", "pos"], seq_col="win", lam=lam,
                          vocab=vocab_size(ngrams), minus=(file_ng, file_cx), minus_keys=["file_id"])


def loo_usage_probability(tokens: DataFrame, usage_rows: DataFrame, ngrams: DataFrame,
                          contexts: DataFrame | None = None, order: int = ORDER, lam: float = LAMBDA) -> DataFrame:
    """M5: M8 with the variable's own usage sequences forgotten first: the n-grams ending at
    each usage (its real, unmasked window) are subtracted per variable -> (decl_id, p)."""
    if contexts is None:
        contexts = context_counts(ngrams)
    ids = ["file_id", "pos"]
    real = with_window(tokens, order).where(F.col("decl_id").isNotNull()).select("decl_id", *ids, "win")
    own = _explode_suffixes(real, ["decl_id"]).groupBy("decl_id", "ngram").agg(F.count("*").alias("cnt"))
    own_cx = own.groupBy("decl_id", prefix_drop_last(F.col("ngram")).alias("ctx")).agg(F.sum("cnt").alias("cnt"))
    u, key = _named_usages(usage_rows), ["decl_id", "seq"]
    return _weighted(u, key, _scored_sequences(u, key, ngrams, contexts, "seq", lam, [], vocab_size(ngrams), (own, own_cx), ["decl_id"], None))
