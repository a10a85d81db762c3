"""Quality classifier by importance resampling (operator 5).

Two hashed n-gram models are counted: of all documents (raw) and of a target, the documents that
are labelled good. A feature is a word or a pair of words (or the pattern of a word said three
times, or of words said twice in turn), hashed to one of ``2 ** bits`` buckets and counted once a
document, so one document's repetitions weigh no more than one use. A bucket's probability is the share
of documents that hold it plus ``floor`` (at least two target documents' worth), its log ratio that of target to raw. The raw
model covers topics that nobody labelled; a ratio therefore counts as far as the labelled documents confirm it: the
ratio of target to all labelled documents must have the same sign, and the smaller of the two is taken. Towards zero
it gives way by ``dead`` nats, which hold at any size, and ``margin`` standard errors, which vanish as
the labels grow. Surplus and deficit count alike.

A document's log weight is the sum over its features divided by the root of their number. As in
rejection sampling, a weight counts up to an envelope: the log acceptance is ``min(0, log weight - envelope) /
temperature``. The envelope is set on a fifth of the labels, which the models don't see: it is the weight
that all but a ``loss`` of the good documents among them reach. So the share of good documents that goes doesn't
depend on the size of the table. Gumbel top-k sampling without replacement adds Gumbel noise that depends on the
doc_id and the seed alone and keeps the ``k`` largest; ``k`` is the expected number of acceptances
over all documents. All keys equal to the k-th stay.

The labels are bounded: of more than ``max_labels`` labelled documents those whose doc_ids hash lowest
make it. Of labelled copies of one text only one counts, on one side of the fit, so that copies prove nothing. Everything else covers all documents. Bucket counts are added up on the executors; only
buckets with a ratio other than zero (at most ``2 ** bits``, in fact a few thousand) reach the driver and
the tasks.

Defined cases: a null or empty text has no features and log weight 0; labels of unknown documents,
null labels and repeated labels count as the rows they are (a doc_id with any bad row isn't
target); repeated documents are judged alike; null doc_ids share their noise; without a target or without
labelled documents that aren't target all log weights are 0; without good documents held out the envelope takes all; an
empty table gives no rows; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namemine.llm.shared import only, stage_table
from namemine.llm.textkit import chunks, shingle_hashes, word_hashes, words_of

BITS = 20
MAX_LABELS = 60_000
FLOOR = 0.001
DEAD = 0.1
MARGIN = 2.0
LOSS = 0.01
TEMPERATURE = 0.01
SEED = 17
#: One labelled document in so many sets the envelope instead of the models.
HOLD = 5
#: Buckets of a block, the unit in which tasks hand on their counts.
BLOCK = 4096
_BINS = 1024
#: The bucket that every document holds; the two patterns have 0 and 1.
_EVERY = 2


class Labels(NamedTuple):
    """Sorted doc_ids: labelled and good ones that the models see, good ones held out."""

    labelled: np.ndarray
    target: np.ndarray
    held: np.ndarray


class Model(NamedTuple):
    """Buckets with a log ratio other than zero."""

    bits: int
    bucket: np.ndarray
    log_ratio: np.ndarray


def features(data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a chunk's texts, repeats included."""
    w = words_of(data, bounds, lower=True)
    h = word_hashes(w)
    pair, first = shingle_hashes(h, w.doc, 2)
    shift = np.uint64(64 - bits)
    same = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    thrice = np.flatnonzero(same[:-1] & same[1:])
    in_turn = np.flatnonzero(same[:-2] & same[2:] & (w.doc[3:] == w.doc[:-3]))
    doc = np.concatenate((w.doc, w.doc[first], w.doc[thrice], w.doc[in_turn]))
    patterns = np.concatenate((np.zeros(len(thrice), np.int64), np.ones(len(in_turn), np.int64)))
    return doc, np.concatenate(((h >> shift).astype(np.int64), (pair >> shift).astype(np.int64), patterns))


def _ngrams_once(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    doc, bucket = features(data, bounds, bits)
    once = np.unique(doc << bits | bucket)
    return once >> bits, once & ((1 << bits) - 1)


def label_sample(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Labels:
    """Of at most ``max_labels`` labelled documents one for each different text; good ones (quality 1, not toxic, and
    no copy judged otherwise) apart."""
    slim = only(labels, doc_id="long", quality="int", toxic="int").where("doc_id IS NOT NULL")
    judged = slim.groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    chosen = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    told = only(docs, doc_id="long", text="string").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    texts = told.join(F.broadcast(stage_table(chosen, "labels")), "doc_id").groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.min("good").alias("good"))
    rows = texts.withColumn("held", F.pmod("same", F.lit(HOLD)) == 0).orderBy("doc_id").toArrow()
    ids, good, held = (rows[c].to_numpy() for c in ("doc_id", "good", "held"))
    return Labels(ids[~held], ids[~held & good], ids[held & good])


def bucket_counts(docs: DataFrame, sample: Labels, bits: int = BITS) -> DataFrame:
    """``bucket, n_raw, n_labelled, n_target``: documents that hold each bucket, for buckets that occur."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)  # at most MAX_LABELS numbers
    size = 1 << bits
    block = min(BLOCK, size)
    names = ["raw", "labelled", "target"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, size), np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            among = [np.isin(ids, shared.value.labelled), np.isin(ids, shared.value.target)]
            total[0, _EVERY] += len(ids)
            for n, inside in enumerate(among, 1):
                total[n, _EVERY] += inside.sum()
            for first, last, data, bounds in chunks(batch.column(1)):
                doc, bucket = _ngrams_once(data, bounds, bits)
                doc, bucket = doc[bucket != _EVERY], bucket[bucket != _EVERY]
                total[0] += np.bincount(bucket, minlength=size)
                for n, inside in enumerate(among, 1):
                    total[n] += np.bincount(bucket[inside[first:last][doc]], minlength=size)
        for at in range(0, size, block):
            if total[0, at : at + block].any():
                each = [pa.ListArray.from_arrays(pa.array([0, block], pa.int32()), pa.array(x[at : at + block])) for x in total]
                yield pa.RecordBatch.from_arrays([pa.array([at // block], pa.int64()), *each], ["block", *names])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, block), np.int64)
        for batch in batches:
            for i, name in enumerate(names):
                total[i] += batch.column(name).flatten().to_numpy().reshape(-1, block).sum(axis=0)
        there = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(there + key[0].as_py() * block), *[pa.array(t[there]) for t in total]], ["bucket", *[f"n_{n}" for n in names]])

    slim = only(docs, doc_id="long", text="string")
    blocks = slim.mapInArrow(count, "block long, raw array<long>, labelled array<long>, target array<long>")
    return blocks.groupBy("block").applyInArrow(add, "bucket long, n_raw long, n_labelled long, n_target long")


def log_ratio(n_docs: int, n_labelled: int, n_target: int, floor: float = FLOOR, dead: float = DEAD, margin: float = MARGIN) -> Column:
    """The shrunk log ratio of a bucket's counts ``n_raw, n_labelled, n_target``."""
    least = max(floor, 2 / n_target)
    raw, labelled, target = (F.col(c) / n + least for c, n in (("n_raw", n_docs), ("n_labelled", n_labelled), ("n_target", n_target)))
    to_raw, to_labelled = F.log(target / raw), F.log(target / labelled)
    agreed = F.when(F.signum(to_raw) == F.signum(to_labelled), F.least(F.abs(to_raw), F.abs(to_labelled))).otherwise(0.0)
    error = F.sqrt((F.col("n_target") + 1) / (n_target * target) ** 2 + (F.col("n_labelled") + 1) / (n_labelled * labelled) ** 2)
    return F.signum(to_labelled) * F.greatest(F.lit(0.0), agreed - dead - margin * error)


def fit(docs: DataFrame, sample: Labels, bits: int = BITS, **shrink: float) -> Model:
    counts = stage_table(bucket_counts(docs, sample, bits), "buckets")
    every = counts.where(F.col("bucket") == _EVERY).select("n_raw", "n_labelled", "n_target").first()
    if every is None or not every["n_target"]:
        return Model(bits, np.zeros(0, np.int64), np.zeros(0))
    rows = counts.where(F.col("bucket") != _EVERY).select("bucket", log_ratio(*every, **shrink).alias("r")).where("r != 0").orderBy("bucket").toArrow()
    return Model(bits, rows["bucket"].to_numpy(), rows["r"].to_numpy())


def log_weights(column: pa.Array, model: Model) -> np.ndarray:
    """The log weight of each text."""
    out = np.zeros(len(column))
    table = np.zeros(1 << model.bits)
    table[model.bucket] = model.log_ratio
    for first, last, data, bounds in chunks(column):
        doc, bucket = _ngrams_once(data, bounds, model.bits)
        n = np.bincount(doc, minlength=last - first)
        out[first:last] = np.bincount(doc, weights=table[bucket], minlength=last - first) / np.sqrt(n + 1)
    return out


def with_log_weight(docs: DataFrame, model: Model) -> DataFrame:
    """``own`` (a struct of all columns of ``docs``) and ``log_weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = log_weights(batch.column(0).field(at).cast(pa.string()), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight)], ["own", "log_weight"])

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    return held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField("log_weight", T.DoubleType())]))


def envelope(rows: DataFrame, held: np.ndarray, loss: float = LOSS) -> float:
    """The log weight that all but a ``loss`` of the held-out good documents reach. ``rows`` has ``doc_id, log_weight``."""
    shared = rows.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(held, pa.int64())}))  # at most MAX_LABELS numbers
    known = np.sort(rows.join(F.broadcast(shared), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("log_weight").alias("w")).toArrow()["w"].to_numpy())
    return float(known[int(loss * len(known))]) if len(known) else float("-inf")


def log_acceptance(log_weight: Column, envelope: float, temperature: float = TEMPERATURE) -> Column:
    return F.least(F.lit(0.0), log_weight - envelope) / temperature


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    uniform = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting in ever narrower bins (``_BINS`` numbers a round)."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    left = k  # counted down from `high`
    while low < high:
        step = (high - low) / _BINS
        bin_of = F.least(F.floor((F.col(column) - low) / step), F.lit(_BINS - 1))
        inside = rows.where(F.col(column).between(low, high))
        bins = inside.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for b in bins:
            if left <= b["n"]:
                break
            left -= b["n"]
        if (b["lo"], b["hi"]) == (low, high):  # as narrow as doubles go
            break
        low, high = b["lo"], b["hi"]
    return low


def _weighted(docs: DataFrame, labels: DataFrame, seed: int, loss: float, max_labels: int, **how) -> tuple[DataFrame, float]:
    """(``own, log_weight, gumbel_key``, written once; the smallest key that stays)."""
    sample = label_sample(docs, labels, max_labels)
    rows = stage_table(with_log_weight(docs, fit(docs, sample, **how)), "weights")
    slim = rows.select(F.col("own.doc_id").cast("long").alias("doc_id"), "log_weight")
    accepted = log_acceptance(F.col("log_weight"), envelope(slim, sample.held, loss))
    keyed = rows.withColumn("gumbel_key", accepted + gumbel(F.col("own.doc_id").cast("long"), seed))
    expected = rows.agg(F.sum(F.exp(accepted))).first()[0]
    return keyed, kth_largest(keyed, "gumbel_key", round(expected or 0))


def sample(docs: DataFrame, labels: DataFrame, seed: int = SEED, loss: float = LOSS, max_labels: int = MAX_LABELS, **how) -> DataFrame:
    """A row per document: ``doc_id, log_weight, gumbel_key, kept``."""
    sized = only(docs, doc_id="long", text="string")
    rows, least = _weighted(sized, labels, seed, loss, max_labels, **how)
    return rows.select("own.doc_id", "log_weight", "gumbel_key", (F.col("gumbel_key") >= least).alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, seed: int = SEED, loss: float = LOSS, max_labels: int = MAX_LABELS, **how) -> DataFrame:
    """The rows of ``docs`` that the sample keeps."""
    rows, least = _weighted(docs, labels, seed, loss, max_labels, **how)
    return rows.where(F.col("gumbel_key") >= least).select("own.*")
