"""Small fixtures: token tables built from literal token lists (tests only)."""

from __future__ import annotations

from pyspark.sql import functions as F


def token_rows(spark, files: dict, decls: dict | None = None, writes: set | None = None):
    """``files`` = {file_id: [tokens]}; ``decls`` = {(file_id, pos): decl_id}."""
    decls = decls or {}
    writes = writes or set()
    rows = []
    for fid, toks in files.items():
        seen = set()
        for pos, t in enumerate(toks):
            d = decls.get((fid, pos))
            rows.append((0, fid, pos, pos, 0, t, "ident", None, d, d is not None and d not in seen, (fid, pos) in writes))
            if d is not None:
                seen.add(d)
    schema = ("project int, file_id long, pos int, offset long, line int, token string, kind string, "
              "lit_type string, decl_id string, is_decl boolean, is_write boolean")
    return spark.createDataFrame(rows, schema)


def as_dict(df, key, val):
    return {tuple(r[k] for k in key) if isinstance(key, (list, tuple)) else r[key]: r[val] for r in df.collect()}


def ngram_key(arr):
    return F.concat_ws(" ", arr)
