"""Hand-worked goldens (FIXTURES.md section 3)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import token_rows
from namemine.functions import names
from namemine.operators import feedback, graphs, lm, trees, usages


@pytest.fixture(scope="module")
def model(spark):
    toks = token_rows(spark, {1: "a b a b a c".split(), 2: "b a c".split()})
    ng = lm.ngram_counts(toks, order=3)
    return toks, ng, lm.context_counts(ng)


def seq_df(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, win array<string>")


def test_context_counts(model):
    _, _, cx = model
    got = {" ".join(r["ctx"]): r["cnt"] for r in cx.collect()}
    assert got["a"] == 4 and got["b a"] == 3


def test_jm_probability(spark, model):
    _, ng, cx = model
    p = lm.jm_probability(seq_df(spark, [["b", "a", "a"], ["b", "a", "b"], ["b", "a", "c"], ["z", "q", "a"]]),
                          ng, cx, ids=["id"])
    got = {r["id"]: round(r["p"], 6) for r in p.collect()}
    assert got == {0: 0.097222, 1: 0.375, 2: 0.527778, 3: 0.388889}


def test_usage_priority(spark, model):
    _, _, cx = model
    pr = lm.usage_priorities(seq_df(spark, [["b", "a", "x"], ["x"]]), cx, ids=["id"])
    assert {r["id"]: r["prio"] for r in pr.collect()} == {0: 5, 1: 1}


def test_leave_one_file_out(spark, model):
    toks, ng, cx = model
    file_ng = lm.ngram_counts(toks.where("file_id = 2"), order=3, by="file_id")
    file_cx = lm.context_counts(file_ng, by="file_id")
    s = spark.createDataFrame([(2, i, ["b", "a", t]) for i, t in enumerate("abc")], "file_id long, id int, win array<string>")
    p = lm.jm_probability(s, ng, cx, ids=["file_id", "id"], minus=(file_ng, file_cx), minus_keys=["file_id"])
    got = {r["id"]: round(r["p"], 6) for r in p.collect()}
    assert got == {0: 0.104167, 1: 0.5, 2: 0.395833}


def test_softmax(spark):
    df = spark.createDataFrame([("v", "a", -1.0), ("v", "b", -2.0), ("v", "c", -4.0)], "decl_id string, name string, logprob double")
    got = {r["name"]: round(r["p"], 6) for r in lm.softmax(df).collect()}
    assert got == {"a": 0.407662, "b": 0.345078, "c": 0.24726}


def test_windows(spark):
    toks = token_rows(spark, {1: "x = y + x".split()}, decls={(1, 0): "x", (1, 4): "x", (1, 2): "y"})
    u = usages.left_ngrams(toks, order=3).where(F.col("decl_id") == "x")
    got = {r["pos"]: r["ngram"] for r in u.collect()}
    assert got == {0: ["<unknown>"], 4: ["y", "+", "<unknown>"]}


def test_chains(spark):
    toks = ["t"] * 10
    for p in (1, 5, 9):
        toks[p] = "i"
    df = token_rows(spark, {1: toks}, decls={(1, 1): "d1", (1, 5): "d2", (1, 9): "d1"})
    g4 = {(r["src"], r["dst"]) for r in graphs.last_lexical_use(df).collect()}
    assert g4 == {(5, 1), (9, 5)}
    g6 = {(r["src"], r["dst"]) for r in graphs.last_use(df).collect()}
    assert g6 == {(9, 1)}
    g13 = graphs.rewire_target(df, spark.createDataFrame([(1, "i", "d1")], "file_id int, token string, target string"))
    assert {(r["src"], r["dst"]) for r in g13.collect()} == {(9, 1)}


def test_union_of_windows(spark):
    t = spark.createDataFrame([("v", 0, p) for p in (3, 5, 17)], "decl_id string, scope_id int, pos int")
    n = spark.createDataFrame([(0, 20)], "scope_id int, n int")
    got = sorted(r["i"] for r in lm.union_positions(t, n, order=6).collect())
    assert got == list(range(3, 11)) + [17, 18, 19]


def test_subtokens(spark):
    df = spark.createDataFrame([("getHTTPServer_name2x",)], "s string")
    assert df.select(F.array_join(names.subtokens(F.col("s")), "|")).first()[0] == "get|http|server|name|x"


def test_latest_state(spark):
    from datetime import datetime
    ev = [(datetime(2024, 1, 1, 0, 0, i), i, 7, a, v) for i, (a, v) in enumerate(
        [("recalculate", None), ("put", 1.0), ("ignore", None), ("put", 2.0), ("recalculate", None)])]
    df = spark.createDataFrame(ev, "ts timestamp, event_id long, element long, action string, value double")
    r = feedback.latest_state(df).first()
    assert (r["value"], r["need_recalc"], r["ignore"]) == (2.0, True, False)


def _chain_tree(spark, depth_s, depth_t, c_s=0, c_t=1):
    """LCA node 0 with two branches going down depth_s / depth_t levels to one leaf each."""
    rows = [(0, None, 0, "Block")]
    nid = 1
    for depth, cix in ((depth_s, c_s), (depth_t, c_t)):
        parent = 0
        for level in range(depth):
            rows.append((nid, parent, cix if level == 0 else 0, "NameExpr" if level == depth - 1 else "Block"))
            parent, nid = nid, nid + 1
    data = [(1, 1, n, p, ix, rt, None, "x" if rt == "NameExpr" else "", n, n, False, False) for n, p, ix, rt in rows]
    return spark.createDataFrame(data, "file_id long, method_id long, node_id long, parent_id long, child_ix int, "
                                       "raw_type string, op string, text string, start long, end long, "
                                       "is_comment boolean, is_stmt boolean")


@pytest.mark.parametrize("ds,dt,cs,ct,kept", [(3, 4, 0, 1, 1), (4, 5, 0, 1, 0), (1, 1, 0, 3, 0)])
def test_path_filter(spark, ds, dt, cs, ct, kept):
    ast = _chain_tree(spark, ds, dt, cs, ct)
    assert trees.path_pairs(trees.leaf_chains(ast)).count() == kept


def test_mix_rank_threshold_after_limit(spark):
    ps = [0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.0009, 0.0008, 0.0007, 0.0006, 0.0005]
    preds = spark.createDataFrame([("v", f"n{i:02d}", p, 1, "m") for i, p in enumerate(ps)],
                                  "decl_id string, name string, p double, priority long, model string")
    assert lm.mix_rank(preds, prior_weight=0).count() == 7
