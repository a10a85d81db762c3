"""Target-distribution importance resampling (operator 12) with ranks by regular sampling.

Features of a text are its runs of one to three words; a feature's bucket is the CRC-32 of its bytes
modulo ``buckets``. The CRC of a run is put together from those of its words: appending n bytes is a linear
map, kept as a table for each n, so no feature is ever spelt out. Bucket counts of the documents and of
the target give a gain per bucket, an array that scores all features of a chunk of texts at once;
a text's weight is their sum, its score adds Gumbel noise that depends on the doc_id alone.

Ranks come from parallel sorting by regular sampling. Eligible rows are sorted within each run (a
partition) and written with their position; every run gives its rows at regular positions; the sorted samples
give regular splitters; rows go to the segment between two splitters, each segment is merged in its own task,
and segment sizes, added up in front of each segment, turn positions into exact ranks. Segments that
start behind the last drawn rank aren't exchanged at all. Ties are broken by doc_id and then by the row's place, so
splitters part equal keys as well, and no segment grows with a key. Runs and segments number at most ``RUNS``, so fewer than
``2 * RUNS ** 2`` slim samples reach the driver.

Defined cases: null and empty texts have no features, weight 0 and aren't eligible; a null doc_id draws
its noise from the empty id and comes last among ties; repeated rows have equal scores and follow each other in
rank, in any order; an empty target or table leaves counts of zero; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from namemine.llm.shared import only, stage_table
from namemine.llm.textkit import Words, chunks, words_of

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = "42"
#: Runs and segments of the sort at most.
RUNS = 512
#: Longer words are hashed one by one.
SHORT = 64


def _normal_bytes() -> np.ndarray:
    """A-Z lowered; ASCII that isn't part of a word becomes a space."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        out[first : last + 1] = 0x20
    return out


_NORMAL = _normal_bytes()


def _crc_of_bytes() -> np.ndarray:
    """The register after one byte, for the reflected polynomial that zlib uses."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_STEP = _crc_of_bytes()


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map ``table`` (4 x 256, one row a byte of the register) on each value."""
    t = table.reshape(4, 256)
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


@lru_cache(maxsize=64)
def _power(j: int) -> np.ndarray:
    """The map of 2 ** j zero bytes."""
    if j:
        return _apply(_power(j - 1), _power(j - 1))
    unit = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    return (unit >> np.uint32(8)) ^ _STEP[unit & 255]


@lru_cache(maxsize=512)
def after(n: int) -> np.ndarray:
    """The map that ``n`` further bytes work on a CRC."""
    table = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for j in range(n.bit_length()):
        if n >> j & 1:
            table = _apply(_power(j), table)
    return table


def word_crcs(w: Words) -> np.ndarray:
    """CRC-32 of each word's bytes."""
    length = w.end - w.start
    out = np.zeros(len(length), dtype=np.uint32)
    short = np.flatnonzero(length <= SHORT)
    order = short[np.argsort(-length[short], kind="stable")]
    start, size = w.start[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, side="left"))  # words longer than k
        crc[:m] = _STEP[(crc[:m] ^ w.data[start[:m] + k]) & 255] ^ (crc[:m] >> np.uint32(8))
    out[order] = ~crc
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(w.data[w.start[i] : w.end[i]].tobytes())
    return out


def feature_crcs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC-32) of all runs of one, two and three words, joined by one space."""
    one = word_crcs(w)
    sizes, which = np.unique(w.end - w.start, return_inverse=True)
    grown = np.concatenate([after(int(n) + 1) for n in sizes]) if len(sizes) else np.zeros(0, np.uint32)
    spaces = np.array([_apply(after(int(n)), np.array([zlib.crc32(b" ")], np.uint32))[0] for n in sizes], dtype=np.uint32)
    spaced = spaces[which] ^ one if len(one) else one  # CRC of a space and the word

    def append(crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = which[word] * 1024
        moved = grown[at + (crc & 255)] ^ grown[at + 256 + (crc >> 8 & 255)] ^ grown[at + 512 + (crc >> 16 & 255)] ^ grown[at + 768 + (crc >> 24)]
        return moved ^ spaced[word]

    second = np.flatnonzero(w.doc[:-1] == w.doc[1:])
    pairs = append(one[second], second + 1)
    pair_at = np.zeros(len(one), dtype=np.uint32)
    pair_at[second] = pairs
    third = np.flatnonzero(w.doc[:-2] == w.doc[2:])
    triples = append(pair_at[third], third + 2)
    return np.concatenate((w.doc, w.doc[second], w.doc[third])), np.concatenate((one, pairs, triples))


def features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a chunk's texts, and the texts' numbers of words."""
    w = words_of(_NORMAL[data], bounds)
    doc, crc = feature_crcs(w)
    return doc, (crc % np.uint32(buckets)).astype(np.int64), w.counts()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                total += np.bincount(features(data, bounds, buckets)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    rows = only(docs, text="string").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one a bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousand times the log ratio of target to raw, floored."""
    n = len(raw)
    s_all, t_all = float(raw.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, data, bounds in chunks(batch.column(1)):
                doc, bucket, counts = features(data, bounds, len(g))
                order = np.argsort(doc, kind="stable")
                sums = np.concatenate(([0], np.cumsum(g[bucket[order]])))  # whole numbers throughout
                n = np.bincount(doc, minlength=last - first)
                end = np.cumsum(n)
                n_words[first:last], n_features[first:last], weight[first:last] = counts, n, sums[end] - sums[end - n]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def score(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` with ``score``: the weight plus Gumbel noise in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def sorted_runs(rows: DataFrame, runs: int) -> DataFrame:
    """``rows`` sorted within each partition, with ``run`` and ``position`` in it, written."""
    few = rows.coalesce(runs).sortWithinPartitions(*_order()).withColumn("place", F.monotonically_increasing_id())
    told = few.withColumn("run", F.shiftright("place", 33)).withColumn("position", F.col("place").bitwiseAND((1 << 33) - 1)).drop("place")
    return stage_table(told, "runs")


def regular_splitters(runs: DataFrame, segments: int) -> np.ndarray:
    """``segments - 1`` splitters (fewer for few rows): regular positions of the sorted regular samples."""
    ends = runs.groupBy("run").agg((F.max("position") + 1).alias("n"))  # one a run
    step = F.greatest(F.lit(1), F.floor(F.col("n") / segments))
    samples = runs.join(F.broadcast(ends), "run").where(F.col("position") % step == 0).orderBy(*_order())
    keys = _keys(samples.select("score", "doc_id", "row").toArrow())
    at = np.unique((np.arange(1, segments) * len(keys)) // segments)
    return keys[at[at > 0]] if len(keys) else keys


def _keys(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Rows of (-score, null id, id, row): ascending is the order of ranks."""
    score, doc, row = (table.column(c) for c in ("score", "doc_id", "row"))
    none = np.asarray(doc.is_null())
    return np.stack((-np.asarray(score), none.astype(np.int64), np.asarray(doc.fill_null(0)), np.asarray(row)), axis=1)


def into_segments(runs: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``runs`` with ``segment``: the number of splitters at or before the row."""
    shared = runs.sparkSession.sparkContext.broadcast(splitters)  # at most RUNS keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        for batch in batches:
            keys = np.concatenate((cut, _keys(batch)))
            order = np.lexsort((np.arange(len(keys)), *keys.T[::-1]))  # a splitter before its equal
            segment = np.empty(len(keys), np.int64)
            segment[order] = np.cumsum(order < len(cut))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[len(cut) :])], [*batch.schema.names, "segment"])

    return runs.mapInArrow(run, T.StructType([*runs.schema.fields, T.StructField("segment", T.LongType())]))


def rank_top(rows: DataFrame, k: int, runs: int = RUNS) -> DataFrame:
    """``rows`` (``doc_id, score, row`` and others, ``row`` unique) with ``rank`` 1 to ``k`` by falling score, ties to
    the smaller doc_id; null beyond."""
    none = F.lit(None).cast("long")
    if k <= 0:
        return rows.withColumn("rank", none)
    spark = rows.sparkSession
    segments = max(1, min(runs, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sorted_ = sorted_runs(rows, segments)
    dealt = stage_table(into_segments(sorted_, regular_splitters(sorted_, segments)).drop("run", "position"), "segments")
    sizes = sorted((r["segment"], r["n"]) for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect())  # one a segment
    before, seen = {}, 0
    for s, n in sizes:
        if seen < k:
            before[s] = seen
        seen += n
    start = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    last = F.lit(max(before, default=-1)).cast("long")
    merged = dealt.where(F.col("segment") <= last).withColumn("local", F.row_number().over(Window.partitionBy("segment").orderBy(*_order())))
    place = F.element_at(start, F.col("segment")) + F.col("local")
    ranked = merged.withColumn("rank", F.when(place <= k, place)).drop("local")
    return ranked.unionByName(dealt.where(F.col("segment") > last).withColumn("rank", none)).drop("segment")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED, runs: int = RUNS) -> DataFrame:
    """A row per document: ``doc_id, n_features, weight, score, rank, n_words``. Of the N documents with at least
    ``min_words`` words, ``floor(percent * N / 100)`` are drawn and ranked."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = stage_table(score(weigh(docs, gain), seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    ranked = rank_top(scored.where(able), percent * n // 100, runs)
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
