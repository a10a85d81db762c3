"""Benchmark decontamination (operator 6), native.

Every run of ``width`` consecutive words of a benchmark item is a window (a shorter item is one
window). The windows form a hash set that goes to all executors; in each document's word array,
positions whose window hash is in the set are picked and verified on the words themselves. Only
hit windows are then joined to their items, so documents aren't shuffled.

The set goes into the plan only while the benchmark has at most ``max_set`` different windows;
beyond that, document windows are joined to the benchmark's by hash and words. Both ways give the
same rows.

Defined cases: a null or empty text has no words, is never hit and (as an item) never occurs;
repeated rows are answered each; a null ``doc_id`` is carried; a null ``item_id`` is left out of
the items; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namemine.llm.shared import only, stage_table

WIDTH = 10
MAX_SET = 200_000
#: What lies between words, in text that has no A-Z left (fixed by the definition of a word).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_ASCII_BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: A word before A-Z are lowered.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case; on pure ASCII texts lower() does just that, and faster."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The normalised words of a text, in order."""
    inner = F.btrim(lowered(F.coalesce(text, F.lit(""))), F.lit(_ASCII_BETWEEN))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BETWEEN + "+"))


def _windows_at(length: int) -> str:
    """SQL for the start positions (from 0) of all runs of ``length`` of the words ``w``."""
    return f"CASE WHEN size(w) >= {length} THEN sequence(0, size(w) - {length}) ELSE array() END"


def _per_words(sql: str) -> Column:
    """``sql`` over the words as ``w``. The lambda binds them, so that they are made once a text
    however often ``sql`` names them and wherever the optimizer moves it."""
    return F.expr(f"get(transform(array(words), w -> {sql}), 0)")


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, window`` (space-joined words)``, length, hash``, distinct."""
    items = only(benchmark, item_id="long", text="string").select("item_id", words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.lit(width), F.size("words")))
    starts = items.withColumn("at", F.explode(F.expr("sequence(0, size(words) - length)")))
    run = starts.withColumn("run", F.expr("slice(words, at + 1, length)"))
    return run.select("item_id", F.array_join("run", " ").alias("window"), "length", F.xxhash64("run").alias("hash")).distinct()


def _hits_by_set(windows: DataFrame) -> str:
    """SQL for the array of ``at, length, window`` of verified hits among the words ``w``."""
    found = windows.select("length", "hash", "window").distinct().collect()  # at most MAX_SET
    parts = []
    for length in sorted({r["length"] for r in found}):
        own = [r for r in found if r["length"] == length]
        hashes = ",".join(f"{r['hash']}L" for r in own)
        texts = ",".join(f"'{r['window']}'" for r in own)  # words hold no quote and no backslash
        run = f"slice(w, at + 1, {length})"
        kept = f"filter({_windows_at(length)}, at -> xxhash64({run}) IN ({hashes}) AND array_join({run}, ' ') IN ({texts}))"
        parts.append(f"transform({kept}, at -> struct(at, {length} AS length, array_join({run}, ' ') AS window))")
    return f"concat({', '.join(parts)})" if parts else f"CAST(array() AS {_NO_HITS})"


_NO_HITS = "array<struct<at:int,length:int,window:string>>"


def _fits(windows: DataFrame, max_set: int) -> bool:
    return windows.select("window").distinct().limit(max_set + 1).count() <= max_set


def _hits_by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """As ``_hits_by_set``, for a benchmark of any size: ``docs`` with ``row, words``."""
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most `width`
    keys = windows.select("length", "hash", "window").distinct()
    slots = F.flatten(F.array(*[_per_words(f"transform({_windows_at(n)}, at -> struct(at, {n} AS length, xxhash64(slice(w, at + 1, {n})) AS hash))") for n in lengths]))
    slim = docs.select("row", "words", F.explode(slots).alias("s"))
    run = F.expr("array_join(slice(words, s.at + 1, s.length), ' ')")
    told = slim.select("row", F.col("s.at").alias("at"), F.col("s.length").alias("length"), F.col("s.hash").alias("hash"), run.alias("window"))
    hit = told.join(keys, ["length", "hash", "window"], "left_semi")
    return hit.groupBy("row").agg(F.collect_list(F.struct("at", "length", "window")).alias("hits"))


def _hit_words(hits: Column) -> Column:
    """The places of words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))


def with_hits(docs: DataFrame, windows: DataFrame, text: str = "text", max_set: int = MAX_SET) -> DataFrame:
    """``docs`` with ``n_words`` and ``hits`` (array of ``at, length, window``) in ``scan``."""
    told = docs.withColumn("words", words(F.col(text)))
    if _fits(windows, max_set):
        return told.withColumn("scan", _per_words(f"struct(size(w) AS n_words, {_hits_by_set(windows)} AS hits)")).drop("words")
    told = stage_table(told.withColumn("row", F.monotonically_increasing_id()), "windows")
    found = _hits_by_join(told, windows)
    hits = F.coalesce("hits", F.array().cast(_NO_HITS))
    return told.join(found, "row", "left").withColumn("scan", F.struct(F.size("words").alias("n_words"), hits.alias("hits"))).drop("row", "words", "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_set: int = MAX_SET) -> DataFrame:
    """A row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    windows = stage_table(benchmark_windows(benchmark, width), "benchmark-windows")
    told = with_hits(only(docs, doc_id="long", text="string"), windows, max_set=max_set)
    rows = stage_table(
        told.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("scan.n_words").cast("long").alias("n_words"),
                    F.size(_hit_words(F.col("scan.hits"))).cast("long").alias("n_hit"), F.array_distinct("scan.hits.window").alias("hit_windows")), "hits")
    hit = rows.where("n_hit > 0").select("row", F.explode("hit_windows").alias("window"))
    items = (hit.join(windows.select("item_id", "window"), "window").where("item_id IS NOT NULL").select("row", "item_id").distinct()
             .groupBy("row").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    named = rows.join(items, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return named.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` without the documents that any window hits."""
    return _clean(docs, benchmark, width, max_set, spans=False)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` with hit words (and the space after each) taken out of their texts; the text of
    a document without a hit stays as it is."""
    return _clean(docs, benchmark, width, max_set, spans=True)


def _clean(docs: DataFrame, benchmark: DataFrame, width: int, max_set: int, spans: bool) -> DataFrame:
    windows = stage_table(benchmark_windows(benchmark, width), "benchmark-windows")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("text").cast("string").alias("text"))
    told = with_hits(held, windows, max_set=max_set)
    if not spans:
        return told.where(F.size("scan.hits") == 0).select("own.*")
    gaps, kept = F.split("text", _WORD), F.regexp_extract_all("text", F.lit(f"({_WORD})"), 1)
    pieces = F.transform("kept", lambda w, i: F.when(F.array_contains("out", i), "").otherwise(F.concat(w, F.element_at("gaps", i + 2))))
    done = told.withColumn("out", _hit_words(F.col("scan.hits"))).withColumn("kept", kept).withColumn("gaps", gaps)
    rest = F.when(F.size("out") == 0, F.col("text")).otherwise(F.concat(F.element_at("gaps", 1), F.array_join(pieces, "")))
    fields = [F.col(f"own.`{c}`") if c != "text" else rest.alias("text") for c in docs.columns]
    return done.select(*fields)
