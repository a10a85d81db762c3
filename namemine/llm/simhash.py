"""SimHash near-dedup (operator 2) with pivot distance tables.

A text's fingerprint is the bitwise majority over the XXH64 values of its word shingles. Equal
fingerprints form one class. Classes meet where they agree on some blocks of bits: of
``max_bits + spare`` blocks a pair within ``max_bits`` bits agrees on ``spare`` at least, so one
key a choice of ``spare`` blocks loses no pair. In each bucket of such a key:

1. up to ``pivots`` members, picked by hash, are the reference fingerprints, and every member's
   Hamming distances to them are its row of the pivot distance table;
2. a member is linked to the first reference within ``max_bits`` (and so are the references), so a
   dense group of near copies becomes a few stars and its pairs are never listed;
3. only members that these stars leave in different components are paired; a pair is discarded
   if any coordinate of its two table rows differs by more than ``max_bits`` (by the triangle
   inequality it can't be near), and the survivors are verified on the fingerprints.

Components are exact: a pair is skipped only if it is already connected or proven far.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows
are in one class; a null ``doc_id`` never is the smallest unless all of its component are null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namemine.llm.components import connected_components
from namemine.llm.shared import only, stage_table
from namemine.session import never_broadcast

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SPARE = 3
PIVOTS = 8
#: Shingles counted at a time within a text.
STEP = 1 << 15

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit value of the fingerprint of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z only, and split at [\x20\x09-\x0D]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = end[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, n, STEP):
        some = b"".join([digest(joined[s:e], seed) for s, e in zip(start[at : at + STEP], end[at : at + STEP], strict=True)])
        by_byte = np.frombuffer(some, dtype=np.uint8).reshape(-1, 8) + _PLACE
        ones += np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(ones @ _BITS > n / 2).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text", name: str = "fp") -> DataFrame:
    """All columns of ``docs`` but for the text, and the fingerprint as a long ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at)
            values = [fingerprint((x.as_py() or "").encode(), shingle, seed) for x in texts]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], [*names, name])

    schema = docs.drop(text).schema.add(name, "long")
    return docs.mapInArrow(run, schema)


def _masks(max_bits: int, spare: int) -> list[int]:
    blocks = max_bits + spare
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, spare)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(classes: DataFrame, max_bits: int = MAX_BITS, spare: int = SPARE, pivots: int = PIVOTS) -> DataFrame:
    """``classes``: distinct ``fp``. Result: ``u, v``, pairs within ``max_bits`` bits that connect
    whatever is connected by such pairs."""
    masks = F.array(*[F.lit(m) for m in _masks(max_bits, spare)])
    keyed = classes.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    # references: the least member of each of `pivots` shares of a bucket, dealt by hash
    share = F.pmod(F.xxhash64("fp"), F.lit(pivots))
    least = keyed.groupBy("t", "key", share.alias("share")).agg(F.min("fp").alias("p"), F.count(F.lit(1)).alias("n"))
    buckets = (least.groupBy("t", "key").agg(F.sort_array(F.collect_list("p")).alias("pivots"), F.sum("n").alias("n"))
               .where("n > 1").drop("n"))
    table = stage_table(
        keyed.join(never_broadcast(buckets), ["t", "key"]).withColumn(
            "dist", F.transform("pivots", lambda p: _hamming(p, F.col("fp")).cast("byte"))), "pivot-table")
    near = F.get(F.filter("pivots", lambda p, i: F.get("dist", i) <= max_bits), F.lit(0))
    stars = table.select(near.alias("u"), F.col("fp").alias("v")).where("u <> v").distinct()
    stars = stage_table(stars, "stars")
    found = connected_components(stars)
    placed = (table.drop("pivots").join(never_broadcast(found), table["fp"] == found["node"], "left")
              .select("t", "key", "fp", "dist", F.coalesce("component", "fp").alias("c")))
    open_buckets = (placed.groupBy("t", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
                    .where("lo < hi").select("t", "key"))
    left = stage_table(placed.join(never_broadcast(open_buckets), ["t", "key"], "left_semi"), "apart")
    a = left.select("t", "key", *[F.col(c).alias(f"{c}_a") for c in ("fp", "dist", "c")])
    b = left.select("t", "key", *[F.col(c).alias(f"{c}_b") for c in ("fp", "dist", "c")])
    far = F.exists(F.zip_with("dist_a", "dist_b", lambda x, y: F.abs(x - y)), lambda d: d > max_bits)
    pairs = (a.join(never_broadcast(b), [a["t"] == b["t"], a["key"] == b["key"], F.col("c_a") < F.col("c_b"), ~far,
                        _hamming(F.col("fp_a"), F.col("fp_b")) <= max_bits])
             .select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v")).distinct())
    return found.select(F.col("component").alias("u"), F.col("node").alias("v")).unionByName(pairs)


def components(rows: DataFrame, smallest: Column, **how) -> DataFrame:
    """``rows`` has ``fp``. Result: ``fp, smallest``: the least of ``smallest`` (nulls aside) over
    the rows that are linked to the fingerprint's class."""
    classes = stage_table(rows.groupBy("fp").agg(F.min(smallest).alias("least")), "classes")
    found = connected_components(links(classes.select("fp"), **how))
    placed = stage_table(
        classes.join(never_broadcast(found), classes["fp"] == found["node"], "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("c")), "placed")
    by_component = placed.groupBy("c").agg(F.min("least").alias("smallest"))
    return placed.join(never_broadcast(by_component), "c").select("fp", "smallest")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest reachable doc_id)."""
    rows = stage_table(fingerprints(only(docs, doc_id="long", text="string"), shingle, seed), "fingerprints")
    found = components(rows, F.col("doc_id"), max_bits=max_bits)
    return rows.join(never_broadcast(found), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("smallest").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with one row left of each component: that with the smallest doc_id
    (a null one last; among repeated rows any one)."""
    columns, spot = docs.columns, "__row"
    while spot in columns:
        spot += "_"
    numbered = stage_table(docs.withColumn(spot, F.monotonically_increasing_id()), "numbered")
    slim = numbered.select(F.col(spot).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stage_table(fingerprints(slim, shingle, seed), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    kept = components(rows, order, max_bits=max_bits).select(F.col("smallest.row").alias("kept_row")).distinct()
    return numbered.join(never_broadcast(kept), numbered[spot] == kept["kept_row"], "left_semi").select(*[F.col(f"`{c}`") for c in columns])
