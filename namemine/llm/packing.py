"""Packing (operator 10): sum-of-squares online packing of token documents into windows.

Every task packs the documents of its own partition, in their order, without a shuffle. A level
array counts the partially filled windows of each fill level; a document goes to the level (or
a new window) after which the sum of the squared counts is smallest, ties to the fullest window.
A document's whole windows are cut off first; only its rest is placed by level. When a partition
ends, or more than ``max_open`` windows are open, the open windows are closed: the fullest take
pieces cut from the emptiest, so at most one window a partition is padded then.

Defined cases: a null or empty text is the separator id alone; repeated rows are packed each;
a null ``doc_id`` is carried; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from namemine.llm.shared import only

WINDOW = 1024
SEPARATOR = 0
#: Open windows a task keeps before it closes them.
MAX_OPEN = 4096
#: Chunks handed to the tokenizer at once.
ASK = 20_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])
IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))

#: Texts that the quick encoder takes: Latin letters and ASCII, whose character classes all
#: versions of Unicode agree on. Others go to the tokenizer itself.
_PLAIN = re.compile(r"[\n\r\t -~\u00a1-\u00ac\u00ae-\u024f]*")
#: The pre-token pattern of this tokenizer kind (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts a worker compares before it trusts the quick encoder.
TRIAL = 20


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """The tokenizer's ids of whole texts. For plain texts its vocabulary and pattern run in
    tiktoken's merge loop, which gives the same ids about four times as fast; a worker compares
    both on its first texts. Texts that hold a special token or characters beyond Latin are
    encoded by the tokenizer itself, and so is all if its kind isn't a byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = self._quick()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.trials = TRIAL

    def _quick(self):
        import tiktoken

        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        if (spec["model"]["type"], split.get("type"), split.get("add_prefix_space"), spec.get("normalizer")) != ("BPE", "ByteLevel", False, None):
            return None
        byte = _byte_of_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte for c in token)}
        for token in spec["added_tokens"]:
            ranks.pop(token["content"].encode(), None)
        return tiktoken.Encoding("same", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _by_tokenizer(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.quick is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._by_tokenizer(text)
        ids = self.quick.encode_to_numpy(text)
        if self.trials:
            self.trials -= 1
            if not np.array_equal(ids, self._by_tokenizer(text)):
                self.quick = None
                return self._by_tokenizer(text)
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


class Packer:
    """Sum-of-squares packing of one stream of documents; ``emit`` takes finished windows."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """Put a piece of ``size`` < window tokens; the window's pieces if it is now full."""
        n, w = self.count, self.window
        levels = np.flatnonzero(n[1 : w - size + 1]) + 1
        best, cost = 0, 2 * n[size] + 1
        if len(levels):
            after = levels + size
            change = 1 - 2 * n[levels] + np.where(after < w, 2 * n[after] + 1, 0)
            i = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= cost:
                best = int(levels[i])
        if best:
            pieces = self.open[best].pop()
            n[best] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if best + size == w:
            return pieces
        self.open[best + size].append(pieces)
        n[best + size] += 1
        self.n_open += 1
        return None

    def close(self) -> Iterator[list[tuple]]:
        """Empty all open windows: the fullest take what they lack from the emptiest."""
        left = [(level, pieces) for level in range(self.window, 0, -1) for pieces in self.open[level]]
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.n_open = 0
        i, j = 0, len(left) - 1
        while i <= j:
            level, pieces = left[i]
            i += 1
            while level < self.window and i <= j:
                _, source = left[j]
                doc, start, ids, total = source.pop()
                take = min(len(ids), self.window - level)
                pieces.append((doc, start, ids[:take], total))
                if take < len(ids):
                    source.append((doc, start + take, ids[take:], total))
                level += take
                if not source:
                    j -= 1
            yield pieces


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, max_open: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    packer = Packer(window, max_open)
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    rows: list[list] = [[] for _ in PIECES.fields]
    ids_out: list[np.ndarray] = []
    sequence = 0

    def emit(pieces: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in pieces:
            for column, value in zip(rows, (doc, start, len(ids), zlib.crc32(ids), total, base + sequence, offset), strict=True):
                column.append(value)
            if with_ids:
                ids_out.append(ids)
            offset += len(ids)
        sequence += 1

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in rows]
        names = PIECES.names
        if with_ids:
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids_out]))).astype(np.int32)
            flat = np.concatenate(ids_out).astype(np.int32) if ids_out else np.zeros(0, np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
            names = [*names, "ids"]
            ids_out.clear()
        for c in rows:
            c.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    separator = np.asarray([SEPARATOR], dtype="<u4")
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, doc in enumerate(doc_ids):
            ids = np.concatenate((encode(texts[i].as_py() or ""), separator))
            whole = len(ids) - len(ids) % window
            for at in range(0, whole, window):
                emit([(doc, at, ids[at : at + window], len(ids))])
            if whole < len(ids):
                full = packer.place((doc, whole, ids[whole:], len(ids)), len(ids) - whole)
                if full:
                    emit(full)
                if packer.n_open > packer.max_open:
                    for pieces in packer.close():
                        emit(pieces)
            if len(rows[0]) >= 4000:
                yield flush()
    for pieces in packer.close():
        emit(pieces)
    if rows[0]:
        yield flush()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, max_open: int = MAX_OPEN, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, ``with_ids``, the token ids themselves. ``tokenizer`` is a file that every executor
    has at the same path. ``sequence_id`` is the partition's number times 2**40 plus a count,
    so windows of different tasks never meet and a task run again gives the same rows."""
    schema = T.StructType([*PIECES.fields, IDS]) if with_ids else PIECES
    slim = only(docs, doc_id="long", text="string")
    return slim.mapInArrow(lambda it: _pack(it, tokenizer, window, max_open, with_ids), schema)
