"""Embedding whitening (operator 11): covariance weighted by the multiplicity of equal vectors.

Entries become integers, ``x = floor(scale * c) + shift``, and rows with identical x vectors form one
group (compared on all entries). The fit runs over the distinct vectors with their counts (or one each)
as weights: exact integer sums S give the centre, a second pass multiplies the centred vectors
(``(C * w).T @ C``, one partial matrix a task, added up row by row on the executors), and the
eigenvectors of that d x d matrix come from the driver; nothing there grows with the rows. Each distinct
vector is whitened once and joined back to its rows by its digest (SHA-256 of x). Groups that hold at least
a ``HOT_SHARE``-th of the rows, of which there are at most ``HOT_SHARE``, are joined by broadcast, the
others by a shuffle, so copies of one vector never meet in one task.

Eigenvectors are signed so that their largest entry is positive.

Defined cases: rows whose vector is null or empty, or holds a null, NaN or infinite entry or one whose x
would leave 62 bits, are dropped, and so are rows of another length than the most frequent one (ties: the longer);
null and repeated ids are carried as rows; equal vectors get equal numbers; a component whose eigenvalue is
zero to double precision has a null ``whitened`` and no part in ``identity_error``; ``explained`` is null if all
vectors are equal; ``deviation`` is null beyond a long, ``deviation_exact`` (38 digits) beyond those;
fewer dimensions than components give as many components as dimensions; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namemine.llm.shared import only, stage_table

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
#: A vector with at least one in so many rows is joined back by broadcast.
HOT_SHARE = 1000
#: Tasks of a fitting pass at most: each hands on one d x d matrix.
PARTIALS = 8192
_LIMIT = 2.0**62


class Fit(NamedTuple):
    """Centre and components. ``total`` are the exact sums of ``n`` vectors; ``project`` (d x k) maps
    centred vectors to whitened ones; ``mean`` is the rounding left in the whitened mean."""

    n: int
    total: tuple[int, ...]
    project: np.ndarray
    explained: list[float | None]
    mean: np.ndarray


def integer_vectors(column: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> tuple[np.ndarray, pa.Array]:
    """(indices of the rows that remain, their x vectors as bytes of little-endian longs)."""
    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64())
    entry = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * entry)
    bad = ~(np.abs(x) < _LIMIT)  # NaN and infinite ones too
    before = np.concatenate(([0], np.cumsum(bad)))
    end = np.cumsum(length)
    start = end - length
    kept = np.flatnonzero((length > 0) & (before[end] == before[start]))
    whole = np.repeat(length > 0, length) & np.repeat(before[end] == before[start], length)
    values = np.ascontiguousarray(x[whole].astype(np.int64) + shift).astype("<i8")
    bounds = np.concatenate(([0], np.cumsum(8 * length[kept]))).astype(np.int64)
    return kept, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(kept), [None, pa.py_buffer(bounds), pa.py_buffer(values)]).cast(pa.binary())


def _coded(rows: DataFrame, scale: int, shift: int, with_x: bool) -> DataFrame:
    """``id, digest`` of the rows that remain, or ``digest, x``."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integer_vectors(batch.column(1), scale, shift)
            digest = pa.array([hashlib.sha256(v).digest() for v in x.to_pylist()], pa.binary())
            if with_x:
                yield pa.RecordBatch.from_arrays([digest, x], ["digest", "x"])
            else:
                size = pa.array(pc.binary_length(x).cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), digest, size], ["id", "digest", "size"])

    return rows.mapInArrow(code, "digest binary, x binary" if with_x else "id long, digest binary, size int")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The x vectors of a batch, one a row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, width)


def _few(distinct: DataFrame) -> DataFrame:
    return distinct.coalesce(PARTIALS)


def sums(distinct: DataFrame, width: int) -> list[int]:
    """The exact weighted sum of every dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for batch in batches:
            x, w = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            if not len(w):
                continue
            if float(np.abs(x).max()) * float(w.sum()) < _LIMIT:
                total += (w @ x).astype(object)
            else:
                total += w.astype(object) @ x.astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    parts = _few(distinct.select("x", "w")).mapInArrow(partial, "i int, s decimal(38,0)")
    return [int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("i").collect()]  # one a dimension


def centred(x: np.ndarray, n: int, total: tuple[int, ...]) -> np.ndarray:
    """``x - S / n`` with its whole part taken off in integers."""
    whole = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, total: tuple[int, ...]) -> list[int]:
    """``sum((n * x - S) ** 2)`` of each row, exact."""
    whole = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([s % n for s in total], dtype=object)
    near = x - whole
    if len(x) and (float(np.abs(near).max()) + 1) ** 2 * float(n) ** 2 * x.shape[1] < _LIMIT:
        d = n * near - rest.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * near.astype(object) - rest
    return [int(v) for v in (d * d).sum(axis=1)]


def scatter(distinct: DataFrame, width: int, n: int, total: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, sum of the centred vectors), added up on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width + 1, width))
        for batch in batches:
            c, w = centred(_matrix(batch.column(0), width), n, total), batch.column(1).to_numpy().astype(np.float64)
            gram[:width] += (c * w[:, None]).T @ c
            gram[width] += w @ c
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(list(gram), pa.list_(pa.float64()))], ["i", "g"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += batch.column("g").flatten().to_numpy().reshape(-1, width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["i", "g"])

    schema = "i int, g array<double>"
    rows = _few(distinct.select("x", "w")).mapInArrow(partial, schema).groupBy("i").applyInArrow(add, schema).orderBy("i").collect()  # d + 1 rows of d numbers
    both = np.array([r["g"] for r in rows])
    return both[:width] / n, both[width]


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """``distinct`` has ``x`` and its weight ``w``."""
    n = int(distinct.agg(F.sum("w")).first()[0])
    total = tuple(sums(distinct, width))
    cov, left = scatter(distinct, width, n, total)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = float(np.trace(cov))
    real = values > width * np.finfo(float).eps * max(values[0], 0.0)
    project = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
    explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in values]
    return Fit(n, total, project, explained, (left / n) @ project)


def whiten_distinct(distinct: DataFrame, width: int, model: Fit) -> DataFrame:
    """``digest, n_rows, w, deviation, deviation_exact, z``: one row a distinct vector."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)  # d x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            z = centred(x, m.n, m.total) @ m.project
            exact = deviations(x, m.n, m.total)
            z = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel(), from_pandas=True), z.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("n_rows"), batch.column("w"), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
                 pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)), z],
                ["digest", "n_rows", "w", "deviation", "deviation_exact", "z"])

    return distinct.mapInArrow(run, "digest binary, n_rows long, w long, deviation long, deviation_exact decimal(38,0), z array<double>")


def identity_error(whitened: DataFrame, model: Fit) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity, by size."""
    real = [i for i in range(model.project.shape[1]) if not np.isnan(model.project[0, i])]
    if not real:
        return None
    off = [F.col("z")[i] - float(model.mean[i]) for i in real]
    pairs = [(a, b) for a in range(len(real)) for b in range(a, len(real))]
    row = whitened.agg(*[F.sum(F.col("w") * off[a] * off[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] / model.n - (a == b)) for a, b in pairs)


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, weights: str = "counts") -> DataFrame:
    """A row per remaining row and component: ``<id>, component, n, deviation, whitened, explained,
    identity_error, deviation_exact``. ``weights``: "counts" fits over all rows, "one" over the distinct vectors."""
    if weights not in ("counts", "one"):
        raise ValueError(f"unknown weights {weights!r}")
    spark = rows.sparkSession
    slim = only(rows, **{id: "long", vector: "array<double>"})
    weight = F.col("n_rows") if weights == "counts" else F.lit(1).cast("long")
    groups = _coded(slim, scale, shift, True).groupBy("digest", "x").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("w", weight)
    groups = stage_table(groups, "distinct")
    size = groups.groupBy(F.octet_length("x").alias("size")).agg(F.sum("n_rows").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return spark.createDataFrame([], f"`{id}` long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    width = size["size"] // 8
    distinct = groups.where(F.octet_length("x") == size["size"])
    model = fit(distinct, width, components)
    whitened = stage_table(whiten_distinct(distinct, width, model), "whitened")
    error = identity_error(whitened, model)
    keyed = stage_table(_coded(slim, scale, shift, False).where(F.col("size") == size["size"]).drop("size"), "keyed")
    told = whitened.select("digest", "deviation", "deviation_exact", "z", (F.col("n_rows") * HOT_SHARE >= size["n"]).alias("hot"))
    hot = told.where("hot").drop("hot")  # at most HOT_SHARE rows
    rare = told.where("NOT hot").drop("hot")
    joined = keyed.join(F.broadcast(hot), "digest").unionByName(keyed.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rare, "digest"))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained])
    each = joined.select("id", "deviation", "deviation_exact", F.posexplode("z").alias("i", "whitened"))
    return each.select(
        F.col("id").alias(id), (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact")
