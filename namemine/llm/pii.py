"""Personal data by a semi-Markov conditional random field (operator 9).

Fixed rules give base spans (email, ip, card, phone). The field adds spans in formats that the
rules miss. It runs on *islands*, runs of neighbouring words that hold a digit or ``@``; elsewhere
every feature is zero and the best reading is "no entity", so leaving those words out changes
nothing. An island is cut into atoms (letters, digits, single characters). Candidate segments are
all spans of up to ``MAX_ATOMS`` atoms and ``MAX_CHARS`` characters; features look at a whole span and
its neighbours (shape, digits, separators, check digit, bounds); dynamic programming over ends
and bounded lengths chooses boundaries and types together.

The weights are trained by likelihood (forward and backward sums over all segmentations) on the
base spans of a bounded sample of documents, ``SAMPLE_DOCS`` with lowest hash, and on formats
generated from a fixed seed (numbers without a plus, dotted separators, and look-alikes that are no
personal data). Only this sample reaches the driver.

Defined cases: a null or empty text has no spans; repeated rows are read each; a null ``doc_id`` is
carried; an empty table gives no rows (the generated formats alone train the field); other
columns are ignored or passed on. An island is read whole, as a stream: features are held for
``BLOCK_ATOMS`` atoms at a time, values for the last ``MAX_ATOMS``, and two bytes and a bound for each atom.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namemine.llm.shared import only

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS, MAX_CHARS = 16, 64
BLOCK_ATOMS = 512
SAMPLE_DOCS = 400
SAMPLE_ISLANDS = 300
MAX_SAMPLE_CHARS = 20_000
EPOCHS, RATE, PENALTY = 12, 0.5, 1e-3
SEED = 9

# Fixed by the definition of the base spans.
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CUE = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.DOTALL)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(parts: list[str]) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in parts)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of runs of words with a cue."""
    start = end = -1
    for m in _WORD.finditer(text):
        if _CUE.search(m[0]):
            start, end = (m.start() if start < 0 else start), m.end()
        elif start >= 0:
            yield start, end
            start = -1
    if start >= 0:
        yield start, end


_EMAIL_SHAPE = re.compile(r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}")
_NUMBERS = re.compile(r"\+?[(]?[0-9][0-9 ().-]*[0-9]")
N_FEATURES = 20


def span_features(text: str, start: int, end: int) -> list[float] | None:
    """Features of a whole span; None if it can't be an entity (no edge of one, or no cue)."""
    first, last = text[start], text[end - 1]
    if not (last.isalnum() and (first.isalnum() or first in "+(")):
        return None
    span = text[start:end]
    digits = _digits(span)
    mail = "@" in span
    if not mail and len(digits) < 7:
        return None
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    further = text[end + 1] if end + 1 < len(text) else " "
    numbers = _NUMBERS.fullmatch(span) is not None
    separators = {c for c in span if not c.isalnum() and c not in "+()"}
    dotted = span.split(".")
    quad = len(dotted) == 4 and all(p.isdigit() and p.isascii() for p in dotted)
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    n = len(digits)
    check = numbers and 12 <= n <= 19 and luhn(digits)
    return [
        1.0,
        float(mail and _EMAIL_SHAPE.fullmatch(span) is not None),
        float(mail and span.count("@") != 1),
        float(quad and _is_ip(dotted)),
        float(quad),
        float(check),
        float(numbers and 12 <= n <= 19 and not check),
        float(numbers and first == "+" and 9 <= n <= 15),
        float(numbers and n == 10 and len(groups) == 3 and [len(g) for g in groups] == [3, 3, 4]),
        float(numbers and "(" in span and ")" in span and span.find("(") < span.find(")")),
        float(span.count("(") != span.count(")")),
        float(numbers),
        float(len(separators) > 1),
        float(n < 9 and not mail),
        float(n > 15 and not mail),
        float(before.isalnum() or before in "+.@-_/#"),
        float(after.isalnum() or after in "@_/%"),
        float(after in ".-:" and further.isalnum()),
        float(numbers and n == 10 and len(groups) == 1),
        float(not numbers and not mail),
    ]


def best_spans(text: str, start: int, end: int, weights: np.ndarray) -> list[Span]:
    """Entities of the best segmentation of an island; ties go to no entity, then the shorter span."""
    bounds = array("q", [start])
    steps, kinds = bytearray(1), bytearray(1)  # atoms of the entity that ends the best reading so far (0: none), its kind
    value = [0.0]
    atoms = _ATOM.finditer(text, start, end)
    while block := list(islice(atoms, BLOCK_ATOMS)):
        done = len(bounds)
        bounds.extend(m.end() for m in block)
        ends, rows = [], []
        for j in range(done, len(bounds)):
            for i in range(j - 1, max(-1, j - 1 - MAX_ATOMS), -1):
                if bounds[j] - bounds[i] > MAX_CHARS:
                    break
                f = span_features(text, bounds[i], bounds[j])
                if f is not None:
                    ends.append((i, j))
                    rows.append(f)
        score = np.asarray(rows, dtype=float).reshape(len(rows), N_FEATURES) @ weights
        kind, top = score.argmax(axis=1).tolist(), score.max(axis=1).tolist()
        at = 0
        for j in range(done, len(bounds)):
            best, step, its = value[-1], 0, 0
            while at < len(ends) and ends[at][1] == j:
                i = ends[at][0]
                if value[i - j] + top[at] > best + 1e-9:  # value ends with that of j - 1
                    best, step, its = value[i - j] + top[at], j - i, kind[at]
                at += 1
            value.append(best)
            steps.append(step)
            kinds.append(its)
        del value[:-MAX_ATOMS]
    out, j = [], len(bounds) - 1
    while j:
        if steps[j]:
            out.append((KINDS[kinds[j]], bounds[j - steps[j]], bounds[j]))
        j -= steps[j] or 1
    return out[::-1]


class Lattice:
    """Candidate segments of one island: ``ends[j]`` lists (i, row of ``features``)."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.bounds = [start, *[start + m.end() for m in _ATOM.finditer(text[start:end])]]
        n = len(self.bounds) - 1
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        rows = []
        self.at: list[tuple[int, int]] = []
        for j in range(1, n + 1):
            for i in range(j - 1, max(-1, j - 1 - MAX_ATOMS), -1):
                if self.bounds[j] - self.bounds[i] > MAX_CHARS:
                    break
                f = span_features(text, self.bounds[i], self.bounds[j])
                if f is not None:
                    self.ends[j].append((i, len(rows)))
                    self.at.append((i, j))
                    rows.append(f)
        self.features = np.asarray(rows, dtype=float).reshape(len(rows), N_FEATURES)

    def best(self, weights: np.ndarray) -> list[Span]:
        """The best segmentation's entities."""
        return best_spans(self.text, self.bounds[0], self.bounds[-1], weights)

    def gradient(self, weights: np.ndarray, gold: set[Span]) -> np.ndarray:
        """Observed minus expected features: the gradient of the log-likelihood."""
        score = self.features @ weights
        n = len(self.bounds) - 1
        total = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[i] + total[r] for i, r in self.ends[j]]])
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for r, (i, j) in enumerate(self.at):
            starts[i].append((j, r))
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *[behind[j] + total[r] for j, r in starts[i]]])
        i, j = (np.asarray(x, dtype=int) for x in zip(*self.at, strict=True))
        expected = np.exp(ahead[i][:, None] + score + behind[j][:, None] - ahead[n])
        seen = np.zeros_like(expected)
        for r, (a, b) in enumerate(self.at):
            for k, kind in enumerate(KINDS):
                seen[r, k] = (kind, self.bounds[a], self.bounds[b]) in gold
        return self.features.T @ (seen - expected)


def generated(seed: int = SEED, count: int = 12) -> list[tuple[str, set[Span]]]:
    """Examples in formats that the base rules miss, and look-alikes without an entity."""
    draw = random.Random(seed)

    def number(n: int) -> str:
        return "".join(draw.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = number(15)
        return head + next(d for d in "0123456789" if luhn(head + d))

    out = []

    def add(kind: str | None, value: str) -> None:
        text = f"word {value} next"
        out.append((text, {(kind, 5, 5 + len(value))} if kind else set()))

    for _ in range(count):
        a, b, c = number(3), number(3), number(4)
        for value in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}"):
            add("phone", value)
        d = card()
        for value in (d, " ".join(d[i : i + 4] for i in (0, 4, 8, 12)), ".".join(d[i : i + 4] for i in (0, 4, 8, 12))):
            add("card", value)
        add("ip", ".".join(str(draw.randrange(256)) for _ in range(4)))
        add("email", f"user{number(2)}@mail{number(1)}.example.org")
        wrong = d[:-1] + str((int(d[-1]) + 1) % 10)
        for value in (wrong, number(10), number(8), f"{number(4)}-{number(2)}-{number(2)}", f"{number(1)}.{number(2)}.{number(3)}", "0x" + number(12) + "f",
                      f"{number(4)}-{number(4)}", f"id-{number(9)}", f"{a}.{b}.{number(5)}.{number(6)}", f"{number(5)}.{number(9)}", f"{number(24)}", f"x{number(7)}y{number(3)}"):
            add(None, value)
    return out


def train(texts: list[str], epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights ``[feature, kind]`` from the base spans of ``texts`` and the generated formats."""
    examples = []
    for text in texts:
        spans = set(base_spans(text))
        for start, end in islands(text):
            if len(examples) < SAMPLE_ISLANDS:
                examples.append((Lattice(text, start, end), spans))
    for text, spans in generated(seed):
        examples += [(Lattice(text, start, end), spans) for start, end in islands(text)]
    examples = [x for x in examples if len(x[0].features)]
    weights = np.zeros((N_FEATURES, len(KINDS)))
    squares = np.full_like(weights, 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(examples)
        for lattice, gold in examples:
            g = lattice.gradient(weights, gold) - PENALTY * weights
            squares += g * g
            weights += RATE * g / np.sqrt(squares)
    return weights


def all_spans(text: str, weights: np.ndarray, base: list[Span] | None = None) -> list[Span]:
    """Base spans and, where they overlap none, the field's, by start and kind."""
    base = base_spans(text) if base is None else base
    starts: list[int] = []  # of base spans, overlapping ones joined
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    added = []
    if _CUE.search(text):
        for start, end in islands(text):
            for x in best_spans(text, start, end, weights):
                k = bisect_left(starts, x[2]) - 1
                if k < 0 or ends[k] <= x[1]:
                    added.append(x)
    return sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by ``<KIND>``; overlapping spans become one, named
    after the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> np.ndarray:
    """Train on the documents with a cue whose doc_id and text hash lowest. Hashes choose them
    first, so that no more than the chosen texts ever leave the executors."""
    slim = only(docs, doc_id="long", text="string").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= MAX_SAMPLE_CHARS))
    slim = slim.select(F.xxhash64("doc_id", "text").alias("hash"), "text")
    lowest = slim.select("hash").distinct().orderBy("hash").limit(sample).collect()
    rows = slim.where(F.col("hash") <= lowest[-1].hash).distinct().orderBy("hash", "text").collect() if lowest else []
    return train([r.text for r in rows])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text) if _CUE.search(text) else []
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(all_spans(text, weights, base)))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                                             ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)


def redact_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with every span replaced in ``text`` and ``n_chars`` (if there) set anew; a null text
    and its n_chars stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(names.index("text")).to_pylist()
            new = [t if not t or not _CUE.search(t) else redact(t, all_spans(t, weights)) for t in old]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, columns[names.index("text")].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                was = columns[at].to_pylist()
                columns[at] = pa.array([n if t == o else len(t) for n, t, o in zip(was, new, old, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
