"""Steps whose shuffles and rows must not grow faster than their input."""

from __future__ import annotations

import os

import pytest
from namemine.operators import checks, graphs, lm, trees, usages
from namemine.plans import catalog
from namemine.sources import sinks


@pytest.fixture()
def unsent(spark):
    """No join by broadcast: tables are large."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    return sum(" Exchange " in f" {line.lstrip(' :+-')}" for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def documents(spark, folder, texts):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(folder, "documents.parquet"))
    return str(folder)


def test_word_usages_move_texts_only(unsent, tmp_path):
    d = documents(unsent, tmp_path, ["an ox and an ox\nsaw an Ape 7", "ox", ""])
    used, far = (catalog.QUERIES[k](unsent, d) for k in ("usages", "distance_to_declaration"))
    assert exchanges(used) == exchanges(far) == 1
    ox = {(r.decl_id, r.pos, r.usage_ix) for r in used.collect() if r.decl_id.endswith("ox")}
    assert ox == {("0:ox", 1, 0), ("0:ox", 4, 1), ("1:ox", 0, 0)}
    assert {(r.pos, r.distance) for r in far.collect() if r.decl_id == "0:an"} == {(0, 0), (3, 10), (6, 20)}


def test_usages_without_a_declaration_are_dropped_in_either_form(spark):
    rows = [(0, 0, 5, "a", "x", False), (0, 1, 9, "a", "x", True), (0, 2, 1, "b", "y", False), (None, 0, 0, "a", "x", True), (0, 3, 2, "c", None, False)]
    toks = spark.createDataFrame(rows, "file_id long, pos int, offset int, token string, decl_id string, is_decl boolean")
    want = {(0, "x", 0, 9, 0), (0, "x", 1, 9, 1)}
    for together in (False, True):
        assert {(r.file_id, r.decl_id, r.pos, r.decl_offset, r.usage_ix) for r in usages.usages(toks, together=together).collect()} == want


def test_chunks_are_split_once(spark, tmp_path):
    q = catalog.QUERIES["subtokens"](spark, documents(spark, tmp_path, ["getName setName getName", "getName"]))
    assert {(r.subtoken, r.cnt) for r in q.collect()} == {("get", 3), ("set", 1), ("name", 4)}
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [chunk" in plan


def test_hits_of_conditions_are_not_shuffled(unsent):
    conds = unsent.createDataFrame([("0:1", 0, "if a and bb"), ("0:2", 0, "else bb"), ("1:0", 1, "a"), ("2:0", None, "a")], "cond_id string, method_id long, text string")
    params = unsent.createDataFrame([(0, 1, "int", "a"), (0, 0, "Box", "bb"), (1, 0, "int", "q"), (None, 0, "int", "a")], "method_id long, ix int, type string, name string")
    got = checks.captured_params(conds, params)
    assert exchanges(got) == 2
    assert {tuple(r) for r in got.collect()} == {("0:1", "Box bb, int a", "bb, a"), ("0:2", "Box bb", "bb")}


def test_subgraphs_are_copied_without_comparing_all_edges(spark):
    chain = [(0, i, i + 1, "Next") for i in range(6)] + [(0, i + 1, i, "reversedNext") for i in range(6)]
    edges = [*chain, *chain[:2], (0, 0, 9, "One"), (0, 1, 1, "Self"), (1, 0, 1, "reversedreversedX"), (1, 0, 1, "X"), (1, 1, 0, "reversedX"), (1, 3, 0, None)]
    starts = [("a", 0, 0), ("a", 0, 0), ("b", 0, 3), ("c", 1, 0), ("d", 1, 3), ("e", 2, 0)]

    def turned(e):
        t = e[3]
        return (e[0], e[2], e[1], None if t is None else t[len("reversed"):] if t.startswith("reversed") else f"reversed{t}")

    for depth in (1, 2, 4, 8):
        want = set()
        for v, g, n in starts:
            met = front = {n}
            for _ in range(depth - 1):
                front = {e[2] for e in edges if e[0] == g and e[1] in front} - met
                met = met | front
            copied = {e for e in edges if e[0] == g and e[1] in met}
            want |= {(v, *e) for e in copied | {turned(e) for e in copied}}
        got = graphs.k_hop_subgraph(spark.createDataFrame(edges, "graph_id long, src long, dst long, edge_type string"),
                                    spark.createDataFrame(starts, "decl_id string, graph_id long, node long"), depth)
        rows = [tuple(r) for r in got.select("decl_id", "graph_id", "src", "dst", "edge_type").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert got._jdf.queryExecution().sparkPlan().toString().startswith("Union")


def test_a_variables_nodes_and_edges_meet_once(unsent):
    nodes = unsent.createDataFrame([("v", 7, "x"), ("v", 3, "y"), ("v", 9, "z"), ("w", 1, "q")], "decl_id string, node long, label string")
    edges = unsent.createDataFrame([("v", 7, 3, "A"), ("v", 3, 9, "A"), ("v", 9, 9, "B"), ("v", 7, 4, "A"), ("u", 1, 1, "A")], "decl_id string, src long, dst long, edge_type string")
    got = graphs.graph_record(nodes, edges)
    assert exchanges(got) == 1
    assert {r.decl_id: (r.node_labels, r.edges) for r in got.collect()} == {
        "v": ({0: "y", 1: "x", 2: "z"}, {"A": [[0, 2], [1, 0]], "B": [[2, 2]]}), "w": ({0: "q"}, None)}


def test_chunks_number_keys_not_records(spark, tmp_path, monkeypatch):
    seen, plain = [], sinks.dense_index
    monkeypatch.setattr(sinks, "dense_index", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    rows = spark.createDataFrame([(k, "x" * 9, None) for k in (2, 1, None, 1)], "key long, text string, none string")
    sinks.write_chunked_json(rows, str(tmp_path / "c"), ["key"], per_file=3)
    assert "text" not in seen[0]
    back = {r.chunk: r.value for r in spark.read.text(str(tmp_path / "c")).collect()}
    one, two = '{"key":1,"text":"xxxxxxxxx"}', '{"key":2,"text":"xxxxxxxxx"}'
    assert back == {0: f'[{{"text":"xxxxxxxxx"}},{one},{one}]', 1: f"[{two}]"}


def test_leaves_are_moved_once_not_in_every_round(spark, monkeypatch):
    from namemine.operators import ancestry

    # a chain 0 - 1 - 2 - 3 with four leaves at each node, and a node id that comes twice
    nodes = [(0, None), (1, 0), (2, 1), (3, 2), (3, 2)] + [(100 + 4 * i + j, i) for i in range(4) for j in range(4)] + [(900, 77)]
    ast = spark.createDataFrame(nodes, "node_id long, parent_id long")
    sizes, plain = [], ancestry.stored
    monkeypatch.setattr(ancestry, "stored", lambda df, name: (lambda out: sizes.append((name, out.count())) or out)(plain(df, name)))
    near = [(r.node_id, r.anc) for r in ancestry.nearest_marked(ast, spark.createDataFrame([(1,)], "node_id long")).collect()]
    assert all(n <= 5 for name, n in sizes[1:])
    below = {1, 2, 3, *range(104, 116)}
    assert set(near) == {(n, 1 if n in below else None) for n, _ in nodes}
    assert near.count((112, 1)) == 2  # a row for each row of its parent
    sizes.clear()
    uses = spark.createDataFrame([("v", 112), ("v", 104), ("v", 104), ("w", 108), ("w", 109), ("x", 0), ("y", 900)], "decl_id string, node_id long")
    assert sorted(map(tuple, ancestry.common_ancestors(ast, uses).collect())) == [("v", 1), ("w", 2)]
    assert all(n <= 5 for name, n in sizes if name in ("jump", "inner"))
    flat = spark.createDataFrame([(1, None), (1, None), (2, 1), (3, 1)], "node_id long, parent_id long")
    assert list(map(tuple, ancestry.common_ancestors(flat, spark.createDataFrame([("v", 2), ("v", 3)], "decl_id string, node_id long")).collect())) == [("v", 1)]


def test_order_tree_is_made_once(spark, monkeypatch):
    from conftest import SMOKE_DIR
    from namemine.sources import bindings as B

    made, plain = [], B.order_tree
    monkeypatch.setattr(B, "order_tree", lambda *a: made.append(1) or plain(*a))
    q = catalog.QUERIES["guarded_by"](spark, SMOKE_DIR)
    assert made == [1] and "lineitem.parquet" not in str(q.inputFiles())


def test_variables_that_are_never_written_do_not_walk(spark):
    # a file cut into runs by loops; its "r" is read everywhere and written nowhere
    n = 8
    cfg = spark.createDataFrame([(0, i, i + 1) for i in range(n)] + [(0, i, i - 1) for i in range(1, n)], "file_id long, from long, to long")
    uses = spark.createDataFrame([(0, i, "r", False) for i in range(n)] + [(1, 3, "r", True)], "file_id long, pos long, decl_id string, is_write boolean")
    got = {tuple(r) for r in graphs.flow_last_use_write(uses, cfg, max_rounds=3).collect()}
    # last uses of neighbours take few rounds; last writes of "r" would take a round for each run
    assert got == {(0, i, j, "LastUse") for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n}


def test_positions_of_a_variable_come_from_their_windows(unsent):
    from namemine.operators import lm

    rows = [(0, 0, "a", "x"), (0, 1, "b", None), (0, 2, None, None), (0, 3, "c", None), (0, 4, "a", "x"), (0, 5, "d", "y"), (1, 0, "a", "z"), (None, 0, "a", "x")]
    scope = unsent.createDataFrame(rows, "scope_id long, pos long, token string, decl_id string")
    cands = unsent.createDataFrame([("x", "p"), ("x", "q"), ("x", "q"), ("y", "q"), ("u", "p")], "decl_id string, name string")
    subs = lm.substitute(scope, cands, order=2)
    assert exchanges(subs) == 3  # the windows and both sides of the names' join
    told = [(r.decl_id, r.name, r.i, tuple(r.seq)) for r in subs.collect()]
    # "q" is given twice for "x"; the row without a scope is left out
    want = [("x", v, i, s(v)) for v in ("p", "q", "q") for i, s in ((0, lambda v: (v,)), (1, lambda v: (v, "b")), (4, lambda v: ("c", v)), (5, lambda v: (v, "d")))]
    assert sorted(told) == sorted([*want, ("y", "q", 5, ("a", "q"))])
    ng = lm.ngram_counts(scope.withColumnRenamed("scope_id", "file_id").where("token IS NOT NULL"), order=2)
    p = {(r.decl_id, r.name, r.i): r.p for r in lm.jm_probability(subs.dropDuplicates(), ng, ids=["decl_id", "name", "i"], seq_col="seq").collect()}
    import math
    expected = {}
    for d, v, i, _ in told:
        expected[d, v] = expected.get((d, v), 0) + math.log(p[d, v, i])
    got = {(r.decl_id, r.name): r.logprob for r in lm.context_logprob(scope, cands, ng, order=2).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_suffixes_do_not_carry_their_sequence(unsent):
    from namemine.operators import lm

    seqs = unsent.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["b"])], "id long, win array<string>")
    ng = unsent.createDataFrame([(1, ["a"], 2), (1, ["b"], 2), (2, ["a", "b"], 1)], "n int, ngram array<string>, cnt long")
    got = lm.jm_probability(seqs, ng, ids=["id"])
    assert {r.id: round(r.p, 6) for r in got.collect()} == {1: 0.75, 2: 0.75, 3: 0.5}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate" in line and "win" in line.split("[", 1)[-1].split("]")[-1] for line in plan.splitlines())


def test_windows_are_counted_alike_either_way(spark):
    from helpers import token_rows
    from namemine.operators import lm

    toks = token_rows(spark, {1: list("abcabcab"), 2: list("ab"), 3: ["c"]})
    for by in (None, ["project", "file_id"]):
        one, two = (sorted(map(str, lm.ngram_counts(toks, by=by, dealt=d).collect())) for d in (False, True))
        assert one == two and len(one) > 10


def toy_model(spark):
    words = {0: "a b a b a c b", 1: "b a c a", 2: "c"}
    rows = [(f, i, i, t, "ident", f"{f}:{t}", t not in s.split()[:i]) for f, s in words.items() for i, t in enumerate(s.split())]
    toks = spark.createDataFrame(rows, "file_id long, pos int, offset int, token string, kind string, decl_id string, is_decl boolean")
    ng = lm.ngram_counts(toks)
    return usages.left_ngrams(toks), ng, lm.context_counts(ng), toks.select("kind", "token").distinct()


def test_a_name_is_weighed_in_the_lookup_of_its_probability(unsent):
    u, ng, cx, _ = toy_model(unsent)
    one, two = lm.total_probability(u, ng), lm.total_probability(u, ng, cx)
    assert {r.decl_id: round(r.p, 12) for r in one.collect()} == {r.decl_id: round(r.p, 12) for r in two.collect()}
    # contexts aren't counted apart from the n-grams
    assert exchanges(one) < exchanges(two)


def test_a_variables_names_are_judged_where_its_usages_lie(unsent):
    u, ng, cx, known = toy_model(unsent)
    for k in (1, 2, 10):
        one, two = (lm.rank_names(u, ng, c, known=known, k=k) for c in (None, cx))
        assert {(r.decl_id, r.name, round(r.p, 12), r["rank"]) for r in one.collect()} == {(r.decl_id, r.name, round(r.p, 12), r["rank"]) for r in two.collect()}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [decl_id") == 2 and "Join LeftSemi" not in plan


def test_leaves_meet_their_parents_chain_once(spark, monkeypatch):
    # 0 - 1 - 2 with three leaves at each, a leaf that is a root, a leaf below nothing
    nodes = [(0, None, 0), (1, 0, 0), (2, 1, 0)] + [(10 * i + 3 + j, i, j + 1) for i in range(3) for j in range(3)] + [(90, None, 0), (91, 77, 0)]
    ast = spark.createDataFrame([(1, 5, n, p, ix, "NameExpr", None, "t", n, n, False, False) for n, p, ix in nodes],
                                "file_id long, method_id long, node_id long, parent_id long, child_ix int, raw_type string, op string, text string, "
                                "start long, end long, is_comment boolean, is_stmt boolean")
    climbed, plain = [], trees.ancestor_chains
    monkeypatch.setattr(trees, "ancestor_chains", lambda n, s: climbed.append(s.count()) or plain(n, s))
    got = sorted((r.node_id, [e.node_id for e in r.chain]) for r in trees.leaf_chains(ast).collect())
    assert climbed == [3]
    want = [(10 * i + 3 + j, [10 * i + 3 + j, *range(i, -1, -1)]) for i in range(3) for j in range(3)]
    assert got == sorted([*want, (90, [90])])
