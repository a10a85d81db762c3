"""Best-fit packing (operator 13): large items are matched, small ones best-fit the gaps that remain.

Documents longer than a sequence are cut into full pieces behind a shorter first one. Piece lengths are whole
numbers up to the capacity, so their counts (one number a length) are all that a packing depends on. The
plan is made from these counts alone and works on whole groups of equal bins:

- pieces above a third of the capacity share a bin with at most one other such piece: from the longest down,
  each is matched with the longest that fits beside it (no matching leaves fewer bins);
- then, from the longest down, the others go where the smallest sufficient gap is, into a new bin if there is none.

A plan is a list of slots: so many pieces of a length, so many a bin, at an offset. Its size is bounded by the
capacity: a length splits at most two groups of bins, and a bin holds few different lengths. It is broadcast, and a
piece finds its place by its rank among the pieces of its length: its number in its own task plus the counts of
earlier tasks. Texts are read and tokenised once; no piece moves to a driver or a single task.

Defined cases: a null or empty text is the separator id alone; repeated rows are packed each; a null ``doc_id`` is
carried; which of several equally long pieces takes which slot follows the order of tasks; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from namemine.llm.packing import SEPARATOR, encoder
from namemine.llm.shared import only, stage_table

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_BATCH = 4000


class Slot(NamedTuple):
    """The ``count`` pieces of ``length`` from rank ``first`` on, ``per_bin`` in each bin from ``sequence`` on, the
    first of a bin at ``offset``."""

    length: int
    first: int
    count: int
    per_bin: int
    sequence: int
    offset: int


class _Bins:
    """``n`` equal bins: ``held`` lists (length, first rank, pieces a bin)."""

    def __init__(self, n: int, gap: int, held: list[tuple[int, int, int]]):
        self.n, self.gap, self.held = n, gap, held

    def split(self, n: int) -> _Bins:
        """Take the first ``n`` bins off."""
        taken = _Bins(n, self.gap, list(self.held))
        self.held = [(length, first + n * per, per) for length, first, per in self.held]
        self.n -= n
        return taken

    def put(self, length: int, first: int, per: int) -> None:
        self.held.append((length, first, per))
        self.gap -= length * per


def match_large(left: np.ndarray, capacity: int) -> list[_Bins]:
    """Bins of the pieces above a third of the capacity, at most two in each; ``left[s]`` becomes zero."""
    bins, rank = [], np.zeros(capacity + 1, dtype=np.int64)
    least = capacity // 3 + 1
    for size in range(capacity, least - 1, -1):
        while left[size]:
            fits = np.flatnonzero(left[least : max(least, min(size, capacity - size) + 1)])
            mate = int(fits[-1]) + least if len(fits) else 0
            n = int(left[size]) if not mate else int(min(left[size], left[mate])) if mate != size else int(left[size]) // 2
            if not n:  # one is left over, without an equal
                fits = fits[:-1]
                mate = int(fits[-1]) + least if len(fits) else 0
                n = 1
            group = _Bins(n, capacity, [])
            for s in (size, mate) if mate and mate != size else (size,):
                per = 2 if mate == size else 1
                group.put(s, int(rank[s]), per)
                rank[s] += n * per
                left[s] -= n * per
            bins.append(group)
    return bins


def fit_small(bins: list[_Bins], left: np.ndarray, capacity: int) -> list[_Bins]:
    """Place the other pieces, the longest first, where the gap is smallest."""
    open_: list[list[_Bins]] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, dtype=bool)
    done = []

    def shelve(group: _Bins) -> None:
        if group.gap:
            open_[group.gap].append(group)
            has[group.gap] = True
        else:
            done.append(group)

    for group in bins:
        shelve(group)
    for size in range(min(capacity // 3, len(left) - 1), 0, -1):
        count, rank = int(left[size]), 0
        while count:
            fits = np.flatnonzero(has[size:])
            gap = int(fits[0]) + size if len(fits) else capacity
            per = gap // size
            want = max(1, count // per)  # bins that take `per`, or one that takes the rest
            per = min(per, count)
            if len(fits):
                group = open_[gap].pop()
                has[gap] = bool(open_[gap])
                if group.n > want:
                    rest, group = group, group.split(want)
                    shelve(rest)
            else:
                group = _Bins(want, capacity, [])
            group.put(size, rank, per)
            rank += group.n * per
            count -= group.n * per
            shelve(group)
    return done + [g for groups in open_ for g in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Slot]:
    """``counts[s]`` pieces of each length ``s`` from 1 to ``capacity``: where they go."""
    left = np.array(counts, dtype=np.int64)
    slots, sequence = [], 0
    for group in fit_small(match_large(left, capacity), left, capacity):
        offset = 0
        for length, first, per in group.held:
            slots.append(Slot(length, first, group.n * per, per, sequence, offset))
            offset += length * per
        sequence += group.n
    return sorted(slots)


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces: full ones, the first may be shorter."""
    first = len(ids) % capacity
    if first:
        yield 0, ids[:first]
    for at in range(first, len(ids), capacity):
        yield at, ids[at : at + capacity]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """All pieces with the task (``part``) that made them and their number among that task's pieces of the same
    length (``nth``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen = [0] * (capacity + 1)
        separator = np.asarray([SEPARATOR], dtype="<u4")
        rows: list[tuple] = []
        ids_out: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int32() if i in (1, 5) else pa.int64()) for i, c in enumerate(columns)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids_out]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids_out).astype(np.int32))))
                names.append("ids")
            rows.clear()
            ids_out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.concatenate((encode(texts[i].as_py() or ""), separator))
                for n, (start, own) in enumerate(cut(ids, capacity)):
                    rows.append((doc, n, start, len(own), zlib.crc32(own), part, seen[len(own)]))
                    seen[len(own)] += 1
                    if with_ids:
                        ids_out.append(own)
                    if len(rows) >= _BATCH:
                        yield flush()
        if rows:
            yield flush()

    return only(docs, doc_id="long", text="string").mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


def place(ranked: DataFrame, slots: list[Slot]) -> DataFrame:
    """``ranked`` (with ``length`` and ``rank``) with ``sequence_id`` and ``offset``."""
    table = np.array(slots, dtype=np.int64).reshape(-1, len(Slot._fields))
    shared = ranked.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t[:, 0] << 48 | t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = t[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            arrays = [pa.array(slot[:, 4] + nth // slot[:, 3]), pa.array(slot[:, 5] + nth % slot[:, 3] * length)]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *arrays], [*kept, "sequence_id", "offset"])

    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(run, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, ``with_ids``, the
    token ids. ``tokenizer`` is a file that every executor has at the same path."""
    made = stage_table(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = stage_table(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    total = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one a length
        total[r["length"]] = r["n"]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = made.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    out = place(ranked, plan(total, capacity))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
