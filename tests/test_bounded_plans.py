"""Plans and tasks that stay small as tables grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpers import token_rows
from namemine.operators import evaluate


def test_prediction_lists_are_read_from_files(spark):
    files = {f: ["a", "b", "c", "a", "b"] for f in range(4)}
    toks = token_rows(spark, files, {(f, p): f"{f}:{t}" for f, ts in files.items() for p, t in enumerate(ts)})
    for scope in evaluate.SCOPES:
        for told in evaluate.predictions(toks, scope):
            plan = told._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Window" not in plan
            assert told.count() > 0


def test_counting_arrays_shuffles_windows_not_suffixes(spark):
    from namemine.operators import lm

    words = [f"w{i * i % 89}" for i in range(200)]
    files = spark.createDataFrame([(1, words), (2, words[:2]), (3, words[5:6]), (4, []), (5, None)], "file_id long, tokens array<string>")
    counts = lm.ngram_counts_from_arrays(files)
    expected: dict = {}
    for ws in (words, words[:2], words[5:6]):
        for i in range(len(ws)):
            for n in range(1, min(6, i + 1) + 1):
                g = tuple(ws[i - n + 1:i + 1])
                expected[g] = expected.get(g, 0) + 1
    assert {tuple(r["ngram"]): (r["n"], r["cnt"]) for r in counts.collect()} == {g: (len(g), c) for g, c in expected.items()}
    plan = counts.where("n >= 3")._jdf.queryExecution().sparkPlan().toString()
    # the suffixes are made above the windows' shuffle
    top = plan[:plan.index("Exchange")] if "Exchange" in plan else ""
    assert "Generate explode" in top


def test_token_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    from namemine.sources import bindings as B

    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab Cd 1\n"), 10).alias("text"),
                                  F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(80).alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(B, "TASK_CHARS", 100)
    assert B.documents(spark, str(tmp_path), "doc_id", "text", by_file=True).rdd.getNumPartitions() == 40 * 80 // 100
    toks = B.word_tokens(spark, str(tmp_path))
    assert toks.agg(F.count("*"), F.max("offset"), F.max("line")).first()[:] == (40 * 30, 78, 9)


def test_names_of_a_variable_are_brought_together_at_once(spark):
    from namemine.operators import lm, tokens, usages

    toks = token_rows(spark, {1: ["a", "b", "a", "b", "a", "c"], 2: ["b", "a"]}, {(1, p): f"1:{t}" for p, t in enumerate("ababac")} | {(2, 0): "2:b", (2, 1): "2:a"})
    u, ng, known = usages.left_ngrams(toks), lm.ngram_counts(toks), tokens.known_names(toks)
    by_usage = lm.candidates(u, ng, ["file_id", "pos"], known=known, k=1).join(u.select("file_id", "pos", "decl_id"), ["file_id", "pos"])
    expected = {(r["decl_id"], r["name"]) for r in by_usage.collect()}
    each = lm.candidates(u, ng, ["decl_id"], known=known, k=1)
    assert sorted((r["decl_id"], r["name"]) for r in each.collect()) == sorted(expected)
    whole = lm.context_candidates(u, ng, known, 1)
    assert {(r["decl_id"], r["name"]) for r in whole.collect()} == expected
    # no candidates of single usages, which are brought together afterwards
    left = whole._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "pos" not in left and "decl_id" in left


def test_masked_ngrams_of_files_together_are_not_shuffled(spark):
    from namemine.operators import usages

    words = [f"w{i * i % 13}" for i in range(60)]
    files = {1: words, 2: words[:3], 3: ["a"], 4: words[7:40]}
    toks = token_rows(spark, files, {(f, p): f"{f}:{t}" for f, ts in files.items() for p, t in enumerate(ts) if p % 3})
    lost = toks.limit(1).withColumn("file_id", F.lit(None).cast(toks.schema["file_id"].dataType))
    toks = toks.unionByName(lost).repartition(3, "file_id")
    cols = ["file_id", "pos", "decl_id", "usage_ix", "ngram"]
    whole, apart = (usages.left_ngrams(toks, together=t).select(*cols) for t in (True, False))
    assert whole.count() > 40 and sorted(map(str, whole.collect())) == sorted(map(str, apart.collect()))
    plan = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1  # the files' own


def test_model_joins_are_never_broadcast_by_an_estimate(spark, monkeypatch):
    """Stored tables of few words are small files of many rows, and their suffixes many more."""
    from namemine import session
    from namemine.operators import held_out, lm

    plans = []

    def stored(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return session.stored(df, name)

    for module in (evaluate, held_out, lm):
        monkeypatch.setattr(module, "stored", stored)
    files = {f: list("abcab")[:f + 2] for f in range(4)}
    toks = token_rows(spark, files, {(f, p): f"{f}:{t}" for f, ts in files.items() for p, t in enumerate(ts)})
    for scope in evaluate.SCOPES:
        plans.append(evaluate.predict(toks, scope)._jdf.queryExecution().sparkPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in line for line in joins) >= 20
    # only what has a row for each scope or kind may be sent to all
    assert not [line for line in joins if "Broadcast" in line and not any(f"{k}#" in line.split("]")[0] for k in ("project", "kind", "name"))]


def test_terms_without_counted_contexts_equal_joined_ones(spark):
    from namemine.operators import lm

    files = {f: [f"w{i * (f + 2) % 5}" for i in range(3 + 4 * f)] for f in range(5)} | {9: ["only"]}
    toks = token_rows(spark, files).withColumn("project", F.col("file_id") % 2)
    own = lm.ngram_counts(toks, by=["project", "file_id"])
    ng = lm.ngram_counts(toks, by="project")
    cx, own_cx = lm.context_counts(ng, "project"), lm.context_counts(own, "file_id")
    seqs = lm.with_window(toks).select("project", "file_id", "pos", "win").unionByName(
        spark.createDataFrame([(0, 77, 0, ["w1", "new"]), (1, 1, 500, ["new", "w0"]), (5, 1, 501, ["w1"]), (0, None, 502, ["w1", "w3"])], "project int, file_id long, pos int, win array<string>"))
    sizes = ng.where("n = 1").groupBy("project").agg(F.count("*").cast("double").alias("v"))
    how = {"ids": ["file_id", "pos"], "scope": "project", "sizes": sizes, "minus_keys": ["file_id"]}
    got = lm.jm_probability(seqs, ng, minus=(own, None), **how)
    want = lm.jm_probability(seqs, ng, cx, minus=(own, own_cx), **how)
    table = lambda df: sorted(((r["file_id"] or -1, r["pos"], round(r["p"], 12)) for r in df.collect()))
    assert len(table(got)) > 50 and table(got) == table(want)
