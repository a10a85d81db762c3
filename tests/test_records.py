"""Writers and counters: exact chunks with a closing one, full graph records, renames with score lists, second visits."""

import glob
import gzip
import json

import pytest

from helpers import token_rows  # noqa: F401
from namemine.operators import feedback, graphs
from namemine.sources import sinks


@pytest.mark.parametrize(("n", "sizes"), [(0, [0]), (7, [3, 3, 1]), (6, [3, 3, 0])])
def test_chunks_are_exact_and_closed(spark, tmp_path, n, sizes):
    rows = spark.range(n).selectExpr("id AS key", "named_struct('a', id) AS s", "map(cast(id AS string), array(id, id + 1)) AS m").repartition(4)
    sinks.write_chunked_json(rows, str(tmp_path / "c"), ["key"], per_file=3)
    got = []
    for i, size in enumerate(sizes):
        (file,) = glob.glob(str(tmp_path / "c" / f"chunk={i}" / "*.gz"))
        chunk = json.loads(gzip.open(file, "rt").read())
        assert len(chunk) == size
        got += chunk
    assert got == [{"key": i, "s": {"a": i}, "m": {str(i): [i, i + 1]}} for i in range(n)]
    assert len(glob.glob(str(tmp_path / "c" / "chunk=*"))) == len(sizes)


def test_renames_count_once_whatever_their_scores(spark):
    rows = [("ignored", [0.5, 0.25]), ("ignored", []), ("ignored", None), ("applied", [0.5]), ("noise", [1.0])]
    ev = spark.createDataFrame(rows, "action string, value array<double>")
    assert {tuple(r) for r in feedback.rename_counters(ev).collect()} == {("ignored", 3, 2), ("applied", 1, 1)}
    assert {tuple(r) for r in feedback.rename_stats(ev).collect()} == {("ignored", 0.5, 1), ("ignored", 0.25, 1), ("applied", 0.5, 1)}
    single = spark.createDataFrame([("ignored", 0.5), ("ignored", None), ("applied", 1.0)], "action string, value double")
    assert {tuple(r) for r in feedback.rename_counters(single).collect()} == {("ignored", 2, 1), ("applied", 1, 1)}


def test_second_visits_link_to_themselves(spark):
    rows = [(0, 0, "a", False), (0, 1, "a", True), (0, 2, "b", True), (0, 3, "a", False), (0, 4, None, True)]
    toks = spark.createDataFrame(rows, "file_id long, pos int, decl_id string, twice boolean")
    plain = {(1, 0), (3, 1)}
    assert {(r.src, r.dst) for r in graphs.last_use(toks).collect()} == plain
    assert {(r.src, r.dst) for r in graphs.last_use(toks, self_edges="twice").collect()} == plain | {(1, 1), (2, 2)}


def test_graph_records_of_known_variables(spark):
    nodes = spark.createDataFrame([("v", 3, "x"), ("v", 9, "<var>"), ("w", 1, "y")], "decl_id string, node long, label string")
    edges = spark.createDataFrame([("v", 3, 9, "NextToken"), ("v", 9, 3, "LastUse")], "decl_id string, src long, dst long, edge_type string")
    of = spark.createDataFrame([("v", "f.txt", "name", ["T", "U"], (4, 8))], "decl_id string, file string, name string, types array<string>, span struct<start: long, end: long>")
    (r,) = graphs.graph_record(nodes, edges, of).collect()  # w has no identifier
    assert (r.decl_id, r.file, r.name, r.types, r.span.start, r.span.end) == ("v", "f.txt", "name", ["T", "U"], 4, 8)
    assert r.node_labels == {0: "x", 1: "<var>"} and r.edges == {"NextToken": [[0, 1]], "LastUse": [[1, 0]]}
    assert {r.decl_id for r in graphs.graph_record(nodes, edges).collect()} == {"v", "w"}
