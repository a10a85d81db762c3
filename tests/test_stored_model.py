"""A model stored in buckets: same probabilities, read by another session, no shuffle of the model."""

import re

from namemine.operators import lm
from namemine.sources import bindings as B
from namemine.sources import stored_model
from conftest import SMOKE_DIR


def scans_without_exchange(plan):
    """For each bucketed scan of a plan, the operators above it up to the join."""
    stack, found = [], []
    for line in plan.splitlines():
        m = re.match(r"^([ :+*|-]*)(.*)$", line)
        depth, text = len(m.group(1)), m.group(2)
        stack = [(d, t) for d, t in stack if d < depth] + [(depth, text)]
        if "FileScan" in text and "Bucketed: true" in text:
            above = [t.split(" ")[0].split("(")[0] for _, t in reversed(stack[:-1])]
            found.append(above[: next(i for i, t in enumerate(above) if "Join" in t or "Aggregate" in t) + 1])
    return found


def test_lookups_leave_the_stored_model_in_place(spark, tmp_path):
    toks = B.event_tokens(spark, SMOKE_DIR)
    ngrams, seqs, path = lm.ngram_counts(toks), lm.with_window(toks), str(tmp_path / "model")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted((r.file_id, r.pos, round(r.p, 9)) for r in lm.jm_probability(seqs, ngrams).collect())
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for _ in range(2):  # written again: replaced
            stored_model.write_buckets(ngrams, path, buckets)
        other = spark.newSession()
        counts, contexts = stored_model.read_buckets(spark, path)
        assert sorted(map(str, stored_model.read_buckets(other, path)[0].collect())) == sorted(map(str, ngrams.select("n", "ngram", "cnt").collect()))
        p = lm.jm_probability(seqs, counts, contexts)
        scans = scans_without_exchange(p._jdf.queryExecution().executedPlan().toString())
        assert sum(any("Join" in t for t in s) for s in scans) == 2 and not any("Exchange" in t for s in scans for t in s if "Join" in s[-1])
        assert sorted((r.file_id, r.pos, round(r.p, 9)) for r in p.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
