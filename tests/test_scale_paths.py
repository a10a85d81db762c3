"""Inputs beyond former limits: deep trees, long flows, chunked files, long texts, many lines, change logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import token_rows
from namemine.operators import feedback, graphs, lm, sequences, tokens, trees, usages
from namemine.plans import catalog
from namemine.sources import bindings as B
from namemine.sources import corpus
from namemine.streaming import jobs


def edges_of(df):
    return {(r["src"], r["dst"], r["edge_type"]) for r in df.collect()}


def test_closure_and_chains_of_a_deep_tree(spark):
    n = 70
    ast = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert graphs.subtree_closure(ast).count() == n * (n + 1) // 2
    leaf = ast.where(F.col("node_id") == n - 1)
    assert graphs.subtree_closure(ast, leaf).count() == n
    with pytest.raises(ValueError):
        graphs.subtree_closure(ast, leaf, max_depth=5)
    nodes = ast.withColumn("e", F.struct("node_id"))
    (r,) = trees.ancestor_chains(nodes, nodes.where(F.col("node_id") == n - 1)).collect()
    assert [e["node_id"] for e in r["chain"]] == list(range(n - 1, -1, -1))


def brute_flow(n, cfg, uses):
    """uses: {pos: (decl, is_write)}"""
    before = {}
    for a, b in cfg:
        before.setdefault(b, set()).add(a)
    out = set()
    for p, (d, _) in uses.items():
        for kind in ("LastUse", "LastWrite"):
            seen, todo = set(), [p]
            while todo:
                for q in before.get(todo.pop(), ()):
                    if q in seen:
                        continue
                    seen.add(q)
                    if uses.get(q, (None,))[0] == d and (kind == "LastUse" or uses[q][1]):
                        out.add((p, q, kind))
                    else:
                        todo.append(q)
    return out


def test_flow_through_branches_and_loops(spark):
    import random

    draw = random.Random(5)
    for _ in range(3):
        n = 30
        cfg = {(i, i + 1) for i in range(n - 1)} | {(draw.randrange(n), draw.randrange(n)) for _ in range(6)}
        uses = {p: (draw.choice("ab"), draw.random() < 0.3) for p in range(n) if draw.random() < 0.4}
        u = spark.createDataFrame([(1, p, d, w) for p, (d, w) in uses.items()], "file_id int, pos long, decl_id string, is_write boolean")
        c = spark.createDataFrame([(1, a, b) for a, b in cfg], "file_id int, from long, to long")
        assert edges_of(graphs.flow_last_use_write(u, c, chunk=4)) == brute_flow(n, cfg, uses)


def test_flow_along_ten_thousand_steps_takes_no_round(spark):
    n = 10_000
    cfg = spark.range(n - 1).select(F.lit(1).alias("file_id"), F.col("id").alias("from"), (F.col("id") + 1).alias("to"))
    u = spark.createDataFrame([(1, 0, "v", True), (1, n - 1, "v", False)], "file_id int, pos long, decl_id string, is_write boolean")
    assert edges_of(graphs.flow_last_use_write(u, cfg, max_rounds=1)) == {(n - 1, 0, "LastUse"), (n - 1, 0, "LastWrite")}


def test_chunks_change_nothing(spark, monkeypatch):
    words = "a b a c b a a d c b a e a b".split()
    toks = token_rows(spark, {1: words, 2: words[:5]}, {(f, i): f"{f}:{w}" for f, ws in ((1, words), (2, words[:5])) for i, w in enumerate(ws) if w in "abc"},
                      {(1, 2), (1, 7), (2, 0)}).withColumn("pos", F.col("pos").cast("long"))

    def everything():
        scope = toks.select(F.col("file_id").alias("scope_id"), "pos", "token", "decl_id")
        cands = spark.createDataFrame([("1:a", "x"), ("2:b", "y")], "decl_id string, name string")
        frames = [
            usages.left_ngrams(toks).select("decl_id", "pos", "usage_ix", F.array_join("ngram", " ")),
            usages.centered_context(toks).select("decl_id", "pos", "context"),
            graphs.next_token(toks), graphs.last_write(toks, chunk=sequences.CHUNK), graphs.last_use(toks), graphs.last_lexical_use(toks),
            lm.ngram_counts(toks).select(F.array_join("ngram", " "), "cnt"),
            lm.substitute(scope, cands).select("decl_id", "name", "i", F.array_join("seq", " ")),
        ]
        return [sorted(map(tuple, f.collect())) for f in frames]

    whole = everything()
    monkeypatch.setattr(sequences, "CHUNK", 3)
    monkeypatch.setattr(sequences.chunked, "__defaults__", (3, "pos"))
    assert everything() == whole


def test_long_text_and_many_lines(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    toks = B.word_tokens(spark, str(tmp_path))
    assert len(text) > 65_536 and toks.count() == 40_000
    assert toks.agg(F.max("offset")).first()[0] == len(text) - 5
    spark.createDataFrame([(1, 7, "c", "BUILDING", 1.0), (2, 7, "d", "BUILDING", 1.0)], "c_custkey long, c_nationkey long, c_name string, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(1500).select(F.lit(1).cast("long").alias("l_orderkey"), F.lit("N").alias("l_returnflag"), *[F.col("id").alias(c) for c in B.LINE_ORDER if c != "l_returnflag"])
    lines.unionByName(lines.limit(3).withColumn("l_orderkey", F.lit(2).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    ast = B.order_tree(spark, str(tmp_path))
    assert ast.count() == ast.select("node_id").distinct().count() == 4 + 1503


def test_scores_below_six_digits_still_rank(spark):
    scored = spark.createDataFrame([("v", "a", 1e-8), ("v", "b", 4e-7), ("v", "c", 4e-7)], "decl_id string, name string, p double")
    assert [r["name"] for r in lm.top_k(scored, ["decl_id"], 2).orderBy("rank").collect()] == ["b", "c"]


def test_read_corpus_projects(spark, tmp_path):
    root = tmp_path / "my-src" / "a.b" / "src"
    for p, name in (("proj1", "A.java"), ("src", "B.java"), ("proj1/deep", "C.java")):
        (root / p).mkdir(parents=True, exist_ok=True)
        (root / p / name).write_text(f"class {name}")
    (root / "proj1" / "skip.txt").write_text("no")
    got = {(r["project"], r["n_chars"], r["path"].rsplit("/", 1)[1]) for r in corpus.read_corpus(spark, str(root)).collect()}
    assert got == {("proj1", 12, "A.java"), ("src", 12, "B.java"), ("proj1", 12, "C.java")}


def test_change_log_learns_and_forgets_over_batches_and_restarts(spark, tmp_path):
    schema = "file_id long, text string, sign int"
    log = str(tmp_path / "log")

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)

    def counts():
        out = jobs.stream_ngram_counts(spark.readStream.schema(schema).parquet(log), str(tmp_path / "out"))
        return {" ".join(r["ngram"]): r["cnt"] for r in out.where("cnt > 0").collect()}

    add((1, "a b a", 1), (2, "b c", 1))
    first = counts()
    assert first["a"] == 2 and first["b"] == 2 and first["a b"] == 1
    add((2, "b c", -1), (3, "c c", 1))
    after = counts()  # a new run on the same folders: goes on where the first one stopped
    assert "b c" not in after and after["c"] == 2 and after["b"] == 1 and after["a b a"] == 1
    assert counts() == after


def test_rename_scores_of_a_list(spark):
    ev = spark.createDataFrame([("applied", [0.5]), ("ignored", [0.1, 0.2, 0.1]), ("view", [9.0]), ("ignored", [])], "action string, value array<double>")
    got = {tuple(r) for r in feedback.rename_stats(ev).collect()}
    assert got == {("applied", 0.5, 1), ("ignored", 0.1, 2), ("ignored", 0.2, 1)}


def test_contributors_mix_probabilities(spark):
    from namemine.operators.contributors import Contributors

    variables = spark.createDataFrame([("v",), ("w",)], "decl_id string")
    reg = Contributors()
    none = lambda v: v.selectExpr("decl_id", "'x' AS name", "1.0D AS p", "1L AS priority")
    reg.register("a", none, lambda v: v.selectExpr("decl_id", "0.5D AS p", "3L AS priority"))
    reg.register("b", none, lambda v: v.where("decl_id = 'v'").selectExpr("decl_id", "0.1D AS p", "1L AS priority"))
    got = {r["decl_id"]: round(r["p"], 6) for r in reg.probability(variables).collect()}
    assert got == {"v": 0.4, "w": 0.5}


def test_every_key_is_registered():
    assert len(catalog.QUERIES) >= 105


def test_names_up_a_hierarchy_of_kinds(spark):
    parents = {"param": "variable", "field": "variable", "variable": "element", "element": None, "label": "mark", "mark": None}
    assert tokens.supported_parents(parents, ["variable", "field"]) == {"param": "variable", "field": "field", "variable": "variable"}
    with pytest.raises(ValueError):
        tokens.supported_parents({"a": "b", "b": "a"}, ["c"])
    known = spark.createDataFrame([("variable", "x"), ("field", "y")], "kind string, token string")
    asked = [(k, n) for k in ("param", "field", "label", "unheard", None) for n in ("x", "y", None)]
    kept = tokens.kind_filter(spark.createDataFrame(asked, "kind string, name string"), known, tokens.supported_parents(parents, ["variable", "field"]))
    assert sorted((r["kind"], r["name"]) for r in kept.collect()) == [("field", "y"), ("param", "x")]
