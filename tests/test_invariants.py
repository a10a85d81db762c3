
from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SMOKE_DIR
from helpers import token_rows
from namemine.operators import graphs, lm
from namemine.sources import bindings as B
from namemine.streaming import jobs, runner


def test_probabilities_sum_to_one(spark):
    toks = token_rows(spark, {1: "a b a b a c".split(), 2: "b a c d".split()})
    ng = lm.ngram_counts(toks, order=3)
    vocab = sorted(r["ngram"][0] for r in ng.where("n = 1").collect())
    seqs = spark.createDataFrame([(w, ["b", "a", w]) for w in vocab] + [("z" + w, ["q", "z", w]) for w in vocab],
                                 "id string, win array<string>")
    p = {r["id"]: r["p"] for r in lm.jm_probability(seqs, ng, ids=["id"]).collect()}
    assert abs(sum(p[w] for w in vocab) - 1) < 1e-9
    assert abs(sum(p["z" + w] for w in vocab) - 1) < 1e-9


def test_train_is_additive_and_unlearn_inverts(spark):
    toks = B.event_tokens(spark, SMOKE_DIR)
    a, b = toks.where("project < 5"), toks.where("project >= 5")
    whole = lm.ngram_counts(toks)
    added = lm.add_counts(lm.ngram_counts(a), lm.ngram_counts(b))
    assert whole.exceptAll(added).count() == 0 and added.exceptAll(whole).count() == 0
    back = lm.unlearn(whole, lm.ngram_counts(b))
    assert back.exceptAll(lm.ngram_counts(a)).count() == 0


def test_arrays_equal_windows(spark):
    arrays = B.word_token_arrays(spark, SMOKE_DIR)
    toks = B.word_tokens(spark, SMOKE_DIR)
    x = lm.ngram_counts_from_arrays(arrays)
    y = lm.ngram_counts(toks)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_reverse_twice_is_identity(spark):
    toks = B.event_tokens(spark, SMOKE_DIR)
    g = graphs.next_token(toks)
    once = graphs.reverse_edges(g)
    assert graphs.reverse_edges(once).exceptAll(once).count() == 0


def test_k_hop_monotone(spark):
    toks = B.event_tokens(spark, SMOKE_DIR)
    g = graphs.reverse_edges(graphs.next_token(toks).unionByName(graphs.last_use(toks)))
    roots = toks.where("pos = 0").select("decl_id", F.col("file_id").alias("graph_id"), F.col("pos").cast("bigint").alias("node"))
    small = graphs.k_hop_subgraph(g, roots, depth=2)
    big = graphs.k_hop_subgraph(g, roots, depth=4)
    assert small.exceptAll(big).count() == 0 and big.count() > small.count()


def test_stream_equals_batch(spark):
    schema = spark.read.parquet(f"{SMOKE_DIR}/events.parquet").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SMOKE_DIR)
    fb = ev.select("ts", "event_id", F.col("user_id").alias("element"),
                   F.when(F.col("event_type") == "view", "put").when(F.col("event_type") == "click", "recalculate")
                   .when(F.col("event_type") == "error", "ignore").alias("action"), "value")
    streamed = jobs.stream_latest_state(fb, runner.stream_dir(spark, "test_state"))
    from namemine.operators import feedback
    batch = feedback.latest_state(B.feedback_events(spark, SMOKE_DIR))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_shuffle_partitions_do_not_change_results(spark):
    import __spark_entry__ as entry
    q = entry.queries()["rank_names"]
    a = q(spark, SMOKE_DIR).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = q(spark, SMOKE_DIR).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
