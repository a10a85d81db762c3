"""Independent DuckDB SQL for every checked key (the correctness oracle).

Each string runs on the driver's pre-registered views. Shared bindings are written as
CTE fragments so each key reads the raw tables itself.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def oracle(key: str, sql: str) -> None:
    ORACLE[key] = sql.strip()


# ---------------------------------------------------------------------------------------------
# binding fragments
# ---------------------------------------------------------------------------------------------

# Binding E: events as token rows.
E_TOK = """
e_raw AS (
  SELECT user_id % 10 AS project, user_id AS file_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         event_id AS "offset", event_type AS token,
         CAST(user_id AS VARCHAR) || ':' || event_type AS decl_id,
         event_type = 'purchase' AS is_write
  FROM events),
e_tok AS (
  SELECT *, pos = min(pos) OVER (PARTITION BY file_id, token) AS is_decl FROM e_raw)"""

# Windows of the last 6 tokens of a file, the current token last.
E_WIN = E_TOK + """,
e_win AS (
  SELECT *, list(token) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS w
  FROM e_tok)"""

# Model tables over binding E: n-gram counts, context counts, vocabulary size.
E_MODEL = E_WIN + """,
e_grams AS (
  SELECT list_slice(w, len(w) - n + 1, len(w)) AS g FROM e_win, range(1, 7) r(n) WHERE n <= len(w)),
e_ng AS (SELECT g AS ngram, count(*) AS cnt FROM e_grams GROUP BY g),
e_cx AS (SELECT list_slice(ngram, 1, len(ngram) - 1) AS ctx, sum(cnt) AS cnt FROM e_ng GROUP BY 1),
e_v AS (SELECT count(*) AS v FROM e_ng WHERE len(ngram) = 1)"""


def jm_sql(seq_table: str, ids: str, seq: str, ng: str, cx: str, v: str, extra_where: str = "",
           minus: tuple[str, str, str] | None = None) -> str:
    """Closed form of the interpolated probability for rows of ``seq_table``:
    P = sum_{k<=H} 0.5 * 0.5^(H-k) * c_k / x_k + 0.5^H / V, H = last k before the first unseen context.
    ``minus`` = (n-gram table, context table, key column) subtracted per key (leave-one-out)."""
    c, x, mj = "coalesce(ng.cnt, 0)", "coalesce(cx.cnt, 0)", ""
    if minus is not None:
        mng, mcx, key = minus
        c += " - coalesce(mng.cnt, 0)"
        x += " - coalesce(mcx.cnt, 0)"
        mj = f"""
  LEFT JOIN {mng} mng ON mng.{key} = s.{key} AND mng.ngram = list_slice(s.{seq}, len(s.{seq}) - r.k + 1, len(s.{seq}))
  LEFT JOIN {mcx} mcx ON mcx.{key} = s.{key} AND mcx.ctx = list_slice(s.{seq}, len(s.{seq}) - r.k + 1, len(s.{seq}) - 1)"""
    sel = ", ".join(f"s.{i.strip()} AS {i.strip()}" for i in ids.split(","))
    return f"""
jm_t AS (
  SELECT {sel}, r.k, {c} AS c, {x} AS x
  FROM {seq_table} s, range(1, 7) r(k)
  LEFT JOIN {ng} ng ON ng.ngram = list_slice(s.{seq}, len(s.{seq}) - r.k + 1, len(s.{seq}))
  LEFT JOIN {cx} cx ON cx.ctx = list_slice(s.{seq}, len(s.{seq}) - r.k + 1, len(s.{seq}) - 1){mj}
  WHERE r.k <= len(s.{seq}) {extra_where}),
jm_h AS (
  SELECT {ids}, coalesce(min(k) FILTER (WHERE x <= 0), max(k) + 1) - 1 AS h FROM jm_t GROUP BY ALL),
jm_p AS (
  SELECT {ids}, sum(CASE WHEN k <= h THEN 0.5 * pow(0.5, h - k) * c / x ELSE 0 END)
                + pow(0.5, h) / (SELECT v FROM {v}) AS p
  FROM jm_t JOIN jm_h USING ({ids}) GROUP BY {ids}, h)"""


# ---------------------------------------------------------------------------------------------
# M: language model
# ---------------------------------------------------------------------------------------------

oracle("ngram_counts", f"""
WITH {E_MODEL}
SELECT CAST(len(ngram) AS INTEGER) AS n, array_to_string(ngram, ' ') AS ngram, cnt FROM e_ng
""")

oracle("context_counts", f"""
WITH {E_MODEL}
SELECT CAST(len(ctx) AS INTEGER) AS n_ctx, array_to_string(ctx, ' ') AS ctx, CAST(cnt AS BIGINT) AS cnt
FROM e_cx
""")

oracle("jm_probability", f"""
WITH {E_MODEL}, {jm_sql('e_win', 'file_id, pos', 'w', 'e_ng', 'e_cx', 'e_v')}
SELECT file_id, pos, round(p, 6) AS p FROM jm_p
""")

oracle("stored_probability", ORACLE["jm_probability"])

oracle("usage_priority", f"""
WITH {E_MODEL},
pr_t AS (
  SELECT s.file_id, s.pos, r.k, coalesce(cx.cnt, 0) AS x
  FROM e_win s, range(1, 6) r(k)
  LEFT JOIN e_cx cx ON cx.ctx = list_slice(s.w, len(s.w) - r.k, len(s.w) - 1)
  WHERE r.k <= len(s.w) - 1),
pr_z AS (
  SELECT file_id, pos, k,
         CASE WHEN k < coalesce(min(k) FILTER (WHERE x = 0) OVER (PARTITION BY file_id, pos), 99)
              THEN x ELSE 0 END AS x
  FROM pr_t),
pr AS (
  SELECT file_id, pos,
         list_reduce(list_prepend(0::BIGINT, list(x::BIGINT ORDER BY k)), lambda a, x: a // 2 + x) AS prio
  FROM pr_z GROUP BY ALL)
SELECT e_win.file_id, e_win.pos, CAST(greatest(1, coalesce(prio, 0)) AS BIGINT) AS prio
FROM e_win LEFT JOIN pr USING (file_id, pos)
""")

# Usages of binding E with the masked left n-gram (U3): all tokens of the target -> <unknown>.
E_USAGE = E_MODEL + """,
e_lw AS (
  SELECT *, list({'t': token, 'd': decl_id}) OVER (PARTITION BY file_id ORDER BY pos
              ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lw
  FROM e_tok),
e_use AS (
  SELECT file_id, pos, "offset", decl_id, token,
         list_transform(lw, lambda e: CASE WHEN e.d = decl_id THEN '<unknown>' ELSE e.t END) AS ng,
         row_number() OVER (PARTITION BY file_id, decl_id ORDER BY "offset", pos) - 1 AS usage_ix
  FROM e_lw)"""

oracle("left_ngram", f"""
WITH {E_USAGE}
SELECT decl_id, pos, usage_ix, array_to_string(ng, ' ') AS ngram FROM e_use
""")

# Candidates per usage (M9 + T3), the n-gram ranking (M10) over binding E.
E_CAND = E_USAGE + """,
body AS (SELECT file_id, pos, decl_id, token, list_slice(ng, 1, len(ng) - 1) AS b, ng FROM e_use),
succ AS (
  SELECT list_slice(ngram, 1, len(ngram) - 1) AS ctx, ngram[len(ngram)] AS name, cnt,
         row_number() OVER (PARTITION BY list_slice(ngram, 1, len(ngram) - 1)
                            ORDER BY cnt DESC, ngram[len(ngram)]) AS rk
  FROM e_ng),
cand AS (
  SELECT DISTINCT b.file_id, b.pos, b.decl_id, b.b, s.name
  FROM body b, range(0, 6) r(j)
  JOIN succ s ON s.rk <= 10 AND s.ctx = list_slice(b.b, len(b.b) - r.j + 1, len(b.b))
  WHERE r.j <= len(b.b)),
cand_known AS (
  SELECT * FROM cand WHERE name IN (SELECT token FROM e_tok WHERE is_decl)),
pr_t AS (
  SELECT b.file_id, b.pos, r.k, coalesce(cx.cnt, 0) AS x
  FROM body b, range(1, 6) r(k)
  LEFT JOIN e_cx cx ON cx.ctx = list_slice(b.b, len(b.b) - r.k + 1, len(b.b))
  WHERE r.k <= len(b.b)),
pr_z AS (
  SELECT file_id, pos, k,
         CASE WHEN k < coalesce(min(k) FILTER (WHERE x = 0) OVER (PARTITION BY file_id, pos), 99)
              THEN x ELSE 0 END AS x
  FROM pr_t),
pr_f AS (
  SELECT file_id, pos, list_reduce(list_prepend(0::BIGINT, list(x::BIGINT ORDER BY k)), lambda a, x: a // 2 + x) AS prio
  FROM pr_z GROUP BY ALL),
prio AS (
  SELECT b.file_id, b.pos, b.decl_id, greatest(1, coalesce(pr_f.prio, 0)) AS prio
  FROM body b LEFT JOIN pr_f USING (file_id, pos)),
tot AS (SELECT decl_id, sum(prio) AS total FROM prio GROUP BY decl_id)"""

E_RANK = E_CAND + """,
seqs AS (SELECT file_id, pos, decl_id, name, list_append(b, name) AS s FROM cand_known),
""" + jm_sql('seqs', 'file_id, pos, name', 's', 'e_ng', 'e_cx', 'e_v') + """,
agg AS (
  SELECT s.decl_id, s.name, sum(jm_p.p * prio.prio) / tot.total AS p
  FROM jm_p JOIN seqs s USING (file_id, pos, name) JOIN prio USING (file_id, pos) JOIN tot ON tot.decl_id = s.decl_id
  GROUP BY s.decl_id, s.name, tot.total),
rk AS (SELECT *, row_number() OVER (PARTITION BY decl_id ORDER BY round(p, 12) DESC, name) AS rank FROM agg)"""

oracle("rank_names", f"""
WITH {E_RANK}
SELECT decl_id, name, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10
""")

# Context model over binding E (scope = the user's whole sequence).
def e_context(cands: str) -> str:
    return E_CAND + f""",
cc AS ({cands}),
sizes AS (SELECT file_id, max(pos) + 1 AS n FROM e_tok GROUP BY file_id),
upos AS (
  SELECT DISTINCT decl_id, file_id, i FROM (
    SELECT t.decl_id, t.file_id, unnest(range(t.pos, least(t.pos + 6, z.n))) AS i
    FROM e_tok t JOIN sizes z USING (file_id))),
cwin AS (
  SELECT file_id, pos AS i, list({{'t': token, 'd': decl_id}}) OVER (PARTITION BY file_id ORDER BY pos
             ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS w
  FROM e_tok),
sub AS (
  SELECT u.decl_id, c.name, u.i,
         list_transform(w.w, lambda e: CASE WHEN e.d = u.decl_id THEN c.name ELSE e.t END) AS s
  FROM upos u JOIN cwin w USING (file_id, i) JOIN cc c ON c.decl_id = u.decl_id),
""" + jm_sql('sub', 'decl_id, name, i', 's', 'e_ng', 'e_cx', 'e_v') + """,
lp AS (SELECT decl_id, name, sum(ln(p)) AS logprob FROM jm_p GROUP BY decl_id, name),
sm_e AS (
  SELECT decl_id, name, logprob, exp(logprob / 6 - max(logprob / 6) OVER (PARTITION BY decl_id)) AS e FROM lp),
sm AS (SELECT decl_id, name, logprob, e / sum(e) OVER (PARTITION BY decl_id) AS p FROM sm_e)"""

E_CC = "SELECT DISTINCT decl_id, name FROM cand_known"
E_REAL = "SELECT decl_id, arg_min(token, pos) AS name FROM e_tok GROUP BY decl_id"

oracle("context_candidates", f"""
WITH {E_CAND}
SELECT DISTINCT decl_id, name FROM cand_known
""")

oracle("substitute", f"""
WITH {e_context(E_CC)}
SELECT decl_id, name, i, array_to_string(s, ' ') AS seq FROM sub
""")

oracle("context_logprob", f"""
WITH {e_context(E_CC)}
SELECT decl_id, name, round(logprob, 6) AS logprob FROM lp
""")

oracle("softmax", f"""
WITH {e_context(E_CC)}
SELECT decl_id, name, round(p, 6) AS p FROM sm
""")

oracle("top10", f"""
WITH {e_context(E_CC)},
r AS (SELECT decl_id, name, round(p, 6) AS p,
             row_number() OVER (PARTITION BY decl_id ORDER BY round(p, 12) DESC, name) AS rank FROM sm)
SELECT decl_id, name, p, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")

oracle("name_logprob", f"""
WITH {e_context(E_REAL)}
SELECT decl_id, name, round(logprob, 6) AS logprob FROM lp
""")

oracle("total_probability", f"""
WITH {E_CAND},
seqs AS (SELECT file_id, pos, decl_id, list_append(b, token) AS s FROM body),
{jm_sql('seqs', 'file_id, pos', 's', 'e_ng', 'e_cx', 'e_v')}
SELECT s.decl_id, round(sum(jm_p.p * prio.prio) / sum(prio.prio), 6) AS p
FROM jm_p JOIN seqs s USING (file_id, pos) JOIN prio USING (file_id, pos)
GROUP BY s.decl_id
""")

# Binding W: documents tokenised by regex; lower-case words are variables, capitalised words
# stand for string literals, digits are numbers.
W_TOK = r"""
w_arr AS (
  SELECT source AS project, doc_id AS file_id, n_chars,
         regexp_extract_all(text, '\s*(?:[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s])') AS pieces,
         regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]') AS toks
  FROM documents),
w_raw AS (
  SELECT project, file_id, CAST(unnest(range(len(toks))) AS INTEGER) AS pos,
         unnest(pieces) AS piece, unnest(toks) AS token
  FROM w_arr),
w_tok AS (
  SELECT project, file_id, pos,
         CAST(sum(length(piece)) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
              - length(token) AS INTEGER) AS "offset",
         CAST(sum(length(piece) - length(replace(piece, chr(10), '')))
              OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line,
         token,
         CASE WHEN regexp_matches(token, '^[a-z]') THEN 'ident'
              WHEN regexp_matches(token, '^[A-Z]') THEN 'string'
              WHEN regexp_matches(token, '^[0-9]') THEN 'num' ELSE 'punct' END AS kind,
         CASE WHEN regexp_matches(token, '^[A-Z]') THEN 'string'
              WHEN regexp_matches(token, '^[0-9]') THEN 'number' END AS lit_type,
         CASE WHEN regexp_matches(token, '^[a-z]') THEN CAST(file_id AS VARCHAR) || ':' || token END AS decl_id,
         regexp_matches(token, '^[a-z]') AND pos = min(pos) OVER (PARTITION BY file_id, token) AS is_decl
  FROM w_raw)"""

# Vocabulary of binding W: idx by (cnt desc, token), 1-based.
W_VOCAB = W_TOK + """,
w_vocab AS (
  SELECT row_number() OVER (ORDER BY cnt DESC, token) AS idx, token, cnt
  FROM (SELECT token, count(*) AS cnt FROM w_tok GROUP BY token))"""

W_USE = W_TOK + """,
w_decl AS (SELECT file_id, decl_id, "offset" AS decl_offset FROM w_tok WHERE is_decl),
w_use AS (
  SELECT t.*, d.decl_offset,
         row_number() OVER (PARTITION BY t.file_id, t.decl_id ORDER BY t."offset", t.pos) - 1 AS usage_ix
  FROM w_tok t JOIN w_decl d ON d.file_id = t.file_id AND d.decl_id = t.decl_id)"""

oracle("corpus_scan", f"""
SELECT source AS project, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents GROUP BY source
""")

oracle("size_guard", f"""
SELECT doc_id AS file_id, CAST(length(substr(text, 1, 5000)) AS INTEGER) AS clamped_chars,
       octet_length(encode(text)) <= 125 * 1024 AS kept
FROM documents
""")

oracle("project_split", f"""
SELECT doc_id AS file_id, CASE WHEN source IN ('src0', 'src1') THEN 'test' ELSE 'train' END AS split
FROM documents
WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18', 'src19')
""")

oracle("file_stats", f"""
SELECT source || '/' || CAST(doc_id AS VARCHAR) AS path, CAST(length(text) AS INTEGER) AS n_chars FROM documents
""")

oracle("tokenize", f"""
WITH {W_TOK}
SELECT file_id, pos, "offset", token, kind FROM w_tok
""")

oracle("known_names", f"""
WITH {W_TOK}
SELECT DISTINCT kind, token FROM w_tok WHERE is_decl
""")

oracle("kind_filter", f"""
WITH {W_TOK}
SELECT kind, count(*) AS n_kept
FROM w_tok t
WHERE kind IN ('ident') AND EXISTS (SELECT 1 FROM w_tok k WHERE k.is_decl AND k.kind = t.kind AND k.token = t.token)
GROUP BY kind
""")

oracle("kind_filter_hierarchy", """
WITH said AS (SELECT role AS kind, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM conversations),
told AS (SELECT *, CASE WHEN kind IN ('user', 'assistant') THEN 'speaker' WHEN kind IN ('tool', 'system') THEN 'machine' END AS parent FROM said),
known AS (SELECT DISTINCT parent, name FROM told WHERE kind IN ('user', 'system'))
SELECT kind, count(*) AS n_kept, count(DISTINCT name) AS n_names FROM told SEMI JOIN known USING (parent, name) GROUP BY kind
""")

oracle("mask_literals", f"""
WITH {W_TOK},
m AS (
  SELECT CASE WHEN lit_type = 'string' THEN CASE WHEN length(token) > 10 THEN '<str>' ELSE token END
              WHEN lit_type = 'number' THEN CASE WHEN token IN ('0', '1', '32', '64') THEN token ELSE '<num>' END
              WHEN decl_id IS NOT NULL THEN '<var>'
              ELSE token END AS masked
  FROM w_tok)
SELECT masked, count(*) AS cnt FROM m GROUP BY masked
""")

oracle("vocab_build", f"""
WITH {W_VOCAB}
SELECT idx, token, cnt FROM w_vocab
""")

oracle("vocab_cutoff", f"""
WITH {W_VOCAB}
SELECT idx, token, cnt FROM w_vocab WHERE cnt >= 5
""")

oracle("encode", f"""
WITH {W_VOCAB}
SELECT t.file_id, t.pos, v.idx FROM w_tok t LEFT JOIN w_vocab v ON v.token = t.token
""")

oracle("decode", f"""
WITH {W_VOCAB}
SELECT t.file_id, t.pos, coalesce(v2.token, '<unknown>') AS word
FROM w_tok t LEFT JOIN w_vocab v ON v.token = t.token LEFT JOIN w_vocab v2 ON v2.idx = v.idx
""")

oracle("model_priority", f"""
WITH {W_TOK}
SELECT project, count(DISTINCT token) AS priority FROM w_tok GROUP BY project
""")

oracle("declarations", f"""
WITH {W_TOK}
SELECT decl_id, pos, token FROM w_tok WHERE is_decl AND decl_id IS NOT NULL
""")

oracle("usages", f"""
WITH {W_USE}
SELECT decl_id, pos, usage_ix FROM w_use
""")

oracle("distance_to_declaration", f"""
WITH {W_TOK}
SELECT decl_id, pos, CAST("offset" - min("offset") OVER (PARTITION BY decl_id) AS INTEGER) AS distance FROM w_tok WHERE decl_id IS NOT NULL
""")

oracle("line_position", f"""
WITH {W_TOK}
SELECT file_id, pos, token, line FROM w_tok
""")

oracle("mask_target", f"""
WITH {W_USE},
w_lw AS (
  SELECT file_id, pos, list({{'t': token, 'd': decl_id}}) OVER (PARTITION BY file_id ORDER BY pos
              ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lw
  FROM w_tok)
SELECT u.decl_id, u.pos,
       array_to_string(list_transform(l.lw, lambda e: CASE WHEN e.d = u.decl_id THEN '<unknown>' ELSE e.t END), ' ') AS ngram
FROM w_use u JOIN w_lw l USING (file_id, pos)
""")

oracle("centered_context", f"""
WITH {E_TOK},
lw AS (
  SELECT *, list({{'t': token, 'd': decl_id}}) OVER (PARTITION BY file_id ORDER BY pos
              ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS lw
  FROM e_tok)
SELECT decl_id, pos,
       array_to_string(list_transform(lw, lambda e: CASE WHEN e.d = decl_id THEN '<var>' ELSE e.t END), '▁') AS context
FROM lw
""")

oracle("variable_features", f"""
WITH {E_TOK},
lw AS (
  SELECT *, list({{'t': token, 'd': decl_id}}) OVER (PARTITION BY file_id ORDER BY pos
              ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS lw,
         min("offset") FILTER (WHERE is_decl) OVER (PARTITION BY file_id, decl_id) AS decl_offset
  FROM e_tok),
u AS (
  SELECT decl_id, "offset", pos, token,
         array_to_string(list_transform(lw, lambda e: CASE WHEN e.d = decl_id THEN '<var>' ELSE e.t END), '▁') AS ctx,
         abs("offset" - decl_offset) AS distance
  FROM lw)
SELECT decl_id, arg_min(token, "offset") AS variable,
       string_agg(ctx, chr(9) ORDER BY "offset", pos) AS ngrams,
       string_agg(CAST(distance AS VARCHAR), ',' ORDER BY "offset", pos) AS other_features,
       'ident' AS kind
FROM u GROUP BY decl_id
""")

E_GRAMS = E_WIN + """,
e_g AS (SELECT project, file_id, list_slice(w, len(w) - n + 1, len(w)) AS g FROM e_win, range(1, 7) r(n) WHERE n <= len(w))"""

oracle("unlearn_file", f"""
WITH {E_GRAMS},
kept AS (SELECT g FROM e_g WHERE file_id <> (SELECT min(file_id) FROM e_tok))
SELECT CAST(len(g) AS INTEGER) AS n, array_to_string(g, ' ') AS ngram, count(*) AS cnt FROM kept GROUP BY g
""")

oracle("file_model", f"""
WITH {E_GRAMS}
SELECT file_id, CAST(len(g) AS INTEGER) AS n, array_to_string(g, ' ') AS ngram, count(*) AS cnt
FROM e_g GROUP BY file_id, g
""")

oracle("accumulate_model", f"""
WITH {E_GRAMS}
SELECT CAST(len(g) AS INTEGER) AS n, array_to_string(g, ' ') AS ngram, count(*) AS cnt FROM e_g GROUP BY g
""")

E_PRED = E_RANK + """,
ngram_pred AS (SELECT decl_id, name, p, (SELECT v FROM e_v) AS priority, 'ngram' AS model FROM rk WHERE rank <= 10),
""" + e_context(E_CC).split(E_CAND + ",", 1)[1].replace("jm_", "cm_") + """,
ctx_pred AS (
  SELECT decl_id, name, p, (SELECT v FROM e_v) AS priority, 'context' AS model FROM (
    SELECT decl_id, name, p,
           row_number() OVER (PARTITION BY decl_id ORDER BY round(p, 12) DESC, name) AS rank FROM sm)
  WHERE rank <= 10),
preds AS (SELECT * FROM ngram_pred UNION ALL SELECT * FROM ctx_pred),
visible AS (SELECT file_id, decl_id AS other, token AS name FROM e_tok WHERE is_decl),
dscope AS (SELECT DISTINCT decl_id, file_id FROM e_tok),
clash AS (
  SELECT DISTINCT p.decl_id, p.name FROM preds p JOIN dscope d USING (decl_id)
  JOIN visible v ON v.file_id = d.file_id AND v.name = p.name AND v.other <> p.decl_id)"""

oracle("collision_filter", f"""
WITH {E_PRED}
SELECT decl_id, name FROM ngram_pred p WHERE NOT EXISTS (
  SELECT 1 FROM clash c WHERE c.decl_id = p.decl_id AND c.name = p.name)
""")

oracle("mix_rank", f"""
WITH {E_PRED},
psum AS (SELECT decl_id, sum(priority) + 1 AS psum FROM (SELECT DISTINCT decl_id, model, priority FROM preds) GROUP BY decl_id),
sc AS (
  SELECT p.decl_id, p.name, sum(p.p * p.priority) / any_value(s.psum) AS p
  FROM preds p JOIN psum s USING (decl_id) GROUP BY p.decl_id, p.name),
kept AS (SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM clash c WHERE c.decl_id = sc.decl_id AND c.name = sc.name)),
r AS (SELECT *, row_number() OVER (PARTITION BY decl_id ORDER BY round(p, 12) DESC, name) AS rank FROM kept)
SELECT decl_id, name, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND p >= 0.001
""")

E_MIXP = e_context(E_REAL) + """,
seqs AS (SELECT file_id, pos, decl_id, list_append(b, token) AS s FROM body),
""" + jm_sql('seqs', 'file_id, pos', 's', 'e_ng', 'e_cx', 'e_v').replace('jm_', 'tp_') + """,
tp AS (
  SELECT s.decl_id, sum(tp_p.p * prio.prio) / sum(prio.prio) AS p
  FROM tp_p JOIN seqs s USING (file_id, pos) JOIN prio USING (file_id, pos) GROUP BY s.decl_id),
probs AS (
  SELECT decl_id, p, (SELECT v FROM e_v) AS priority FROM tp
  UNION ALL SELECT decl_id, exp(logprob), (SELECT v FROM e_v) FROM lp),
mixp AS (
  SELECT decl_id, coalesce(sum(p * priority) / nullif(sum(priority), 0), 0) AS p FROM probs GROUP BY decl_id)"""

oracle("mix_probability", f"""
WITH {E_MIXP}
SELECT decl_id, round(p, 6) AS p FROM mixp
""")

oracle("unlikely_names", f"""
WITH {E_MIXP}
SELECT decl_id, round(p, 6) AS p FROM mixp WHERE p < 0.001
""")

oracle("model_scope", f"""
WITH {E_GRAMS},
uni AS (SELECT DISTINCT project, g FROM e_g WHERE len(g) = 1),
own AS (SELECT project, count(*) AS priority FROM uni WHERE project < 5 GROUP BY project),
gmodel AS (SELECT count(DISTINCT g) AS priority FROM uni),
vars AS (SELECT DISTINCT decl_id, project FROM e_tok)
SELECT v.decl_id,
       CASE WHEN o.priority IS NOT NULL THEN CAST(v.project AS VARCHAR) ELSE 'global' END AS model_scope,
       coalesce(o.priority, (SELECT priority FROM gmodel), 0) AS priority
FROM vars v LEFT JOIN own o USING (project)
""")


# ---------------------------------------------------------------------------------------------
# X: trees (binding O has a fixed depth: customer -> order -> line)
# ---------------------------------------------------------------------------------------------

def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def sql_normalized(x: str) -> str:
    s = f"lower({x})"
    s = f"regexp_replace({s}, '\\\\n', '', 'g')"
    s = f"regexp_replace({s}, '//s+', '', 'g')"
    s = f"regexp_replace({s}, '[\"'',]', '', 'g')"
    return f"regexp_replace({s}, '[^ -~]', '', 'g')"


def sql_normalize(x: str, default: str) -> str:
    n = sql_normalized(x)
    return (f"CASE WHEN regexp_replace({n}, '[^A-Za-z]', '', 'g') <> '' THEN regexp_replace({n}, '[^A-Za-z]', '', 'g') "
            f"WHEN replace({n}, ' ', '_') <> '' THEN replace({n}, ' ', '_') ELSE '{default}' END")


def sql_subtokens(x: str) -> str:
    """No look-around in RE2: insert blanks at the camel-case boundaries, then split."""
    spaced = f"regexp_replace(regexp_replace({sql_trim(x)}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    parts = f"string_split_regex({spaced}, '_|[0-9]|\\s+')"
    normed = f"list_transform({parts}, lambda p: CASE WHEN p = '' THEN '' ELSE {sql_normalize('p', '')} END)"
    return f"list_filter({normed}, lambda p: p <> '')"


O_TREE = """
o_o AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority,
         CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) - 1 AS INTEGER) AS oi
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
o_l0 AS (
  SELECT l.l_orderkey, l.l_returnflag, CAST(l.l_quantity AS BIGINT) AS q, o.o_custkey, o.oi,
         CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
              l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS li
  FROM lineitem l JOIN o_o o ON o.o_orderkey = l.l_orderkey),
o_l AS (SELECT *, CAST(min(li) OVER (PARTITION BY l_orderkey, q) AS INTEGER) AS lc FROM o_l0),
o_ol AS (SELECT * FROM o_o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM o_l)),
o_leaf AS (
  SELECT o_custkey AS m, -(l_orderkey * 2147483648 + li) - 1 AS node_id, l_returnflag AS text, 2 AS d, oi, li, lc FROM o_l
  UNION ALL
  SELECT o_custkey, o_orderkey * 3 + 1, o_orderpriority, 1, oi, NULL, oi FROM o_ol
  UNION ALL
  SELECT c_custkey, c_custkey * 3, c_name, 0, NULL, NULL, 0 FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM o_o)),
o_pairs AS (
  SELECT s.m, CASE WHEN s.oi = t.oi THEN 2 ELSE s.d + t.d END AS len, s.text AS s_text, t.text AS t_text, s.oi AS s_oi, s.li AS s_li, t.oi AS t_oi, t.li AS t_li,
         CASE WHEN s.oi = t.oi THEN 'Nm' || s.lc || '|Cal|Nm' || t.lc
              ELSE CASE WHEN s.d = 2 THEN 'Nm' || s.lc || '|Cal|' ELSE 'Cal' || s.oi || '|' END || 'Mth'
                   || CASE WHEN t.d = 2 THEN '|Cal' || t.oi || '|Nm' || t.lc ELSE '|Cal' || t.oi END END AS path
  FROM o_leaf s JOIN o_leaf t ON s.m = t.m AND s.d > 0 AND t.d > 0
   AND ((s.oi = t.oi AND s.d = 2 AND t.d = 2 AND s.li < t.li AND t.lc - s.lc <= 2)
        OR (s.oi < t.oi AND t.oi - s.oi <= 2)))"""

O_METHODS = """
o_m AS (
  SELECT c.c_custkey AS method_id, lower(c.c_mktsegment) || replace(c.c_name, '#', '') AS name,
         CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE '{ return ' || lower(c.c_mktsegment) || '; }' END AS body,
         c.c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') AS is_public, c.c_mktsegment = 'FURNITURE' AS is_private,
         c.c_custkey % 2 = 0 AS is_static, coalesce(n.n_name, 'void') AS return_type
  FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
o_ml AS (
  SELECT method_id, CASE WHEN len(""" + sql_subtokens("name") + """) > 0
                         THEN array_to_string(""" + sql_subtokens("name") + """, '|')
                         ELSE """ + sql_normalize("name", "BLANK") + """ END AS label
  FROM o_m WHERE body IS NOT NULL)"""

O_CONTEXTS = O_TREE + "," + O_METHODS + """,
o_lab AS (
  SELECT *, array_to_string(""" + sql_subtokens("s_text") + """, '|') AS s_lab,
            array_to_string(""" + sql_subtokens("t_text") + """, '|') AS t_lab
  FROM o_pairs WHERE len <= 8),
o_ctx AS (
  SELECT m AS method_id, count(*) AS n,
         string_agg(s_lab || ',' || path || ',' || t_lab, ' ' ORDER BY s_oi, coalesce(s_li, -1), t_oi, coalesce(t_li, -1)) AS ctxs,
         string_agg(s_lab || ',' || path || ',' || t_lab, ' ' ORDER BY s_oi, coalesce(s_li, -1), t_oi, coalesce(t_li, -1))
           FILTER (WHERE true) AS ctxs2
  FROM o_lab GROUP BY m)"""

oracle("tree_leaves", f"""
WITH {O_TREE}
SELECT m AS method_id, node_id, text FROM o_leaf
""")

oracle("child_id", f"""
WITH {O_TREE}
SELECT c_custkey * 3 AS node_id, 0 AS child_id FROM customer
UNION ALL SELECT o_orderkey * 3 + 1, oi FROM o_o
UNION ALL SELECT -(l_orderkey * 2147483648 + li) - 1, lc FROM o_l
""")

oracle("leaf_pairs", f"""
WITH {O_TREE}
SELECT m AS method_id, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM o_leaf GROUP BY m
""")

oracle("path_filter", f"""
WITH {O_TREE}
SELECT m AS method_id, count(*) AS n_kept, count(*) FILTER (WHERE len <= 3) AS n_kept_3 FROM o_pairs GROUP BY m
""")

oracle("short_types", f"""
SELECT 'MethodDeclaration' AS type, 'Mth' AS short_type, count(*) AS n_nodes FROM customer
UNION ALL SELECT 'MethodCallExpr', 'Cal', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'NameExpr', 'Nm', count(*) FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
""")

oracle("path_string", f"""
WITH {O_TREE}
SELECT path, count(*) AS cnt FROM o_pairs GROUP BY path
""")

oracle("path_contexts", f"""
WITH {O_CONTEXTS}
SELECT c.method_id, l.label || ' ' || c.ctxs AS line FROM o_ctx c JOIN o_ml l USING (method_id)
""")

oracle("context_cap", f"""
WITH {O_CONTEXTS}
SELECT c.method_id, ' ' || l.label || ' ' || c.ctxs || repeat(' ', CAST(greatest(0, 999 - c.n) AS INTEGER)) AS capped
FROM o_ctx c JOIN o_ml l USING (method_id)
""")

oracle("method_label", f"""
WITH {O_METHODS}
SELECT method_id, label FROM o_ml
""")

oracle("method_text", f"""
WITH {O_METHODS},
o_p AS (
  SELECT o_custkey AS method_id,
         string_agg(regexp_replace(o_orderpriority, '^[0-9]-| ', '', 'g') || ' o' || o_orderkey, ',' ORDER BY o_orderkey) AS ps
  FROM orders GROUP BY o_custkey)
SELECT m.method_id,
       CASE WHEN body IS NULL THEN '' ELSE
         CASE WHEN is_public THEN 'public ' WHEN is_private THEN 'private ' ELSE '' END
         || CASE WHEN is_static THEN 'static ' ELSE '' END
         || return_type || ' ' || name || '(' || coalesce(p.ps, '') || ') ' || body END AS method_text
FROM o_m m LEFT JOIN o_p p USING (method_id)
""")

oracle("method_length", f"""
WITH c0 AS (SELECT source, replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), ' ') AS clean FROM documents),
c1 AS (SELECT source, CASE WHEN starts_with(clean, '{{' || chr(10)) THEN {sql_trim('substr(clean, 4)')} ELSE clean END AS c1 FROM c0),
c2 AS (SELECT source, CASE WHEN suffix(c1, chr(10) || '}}') THEN {sql_trim('substr(c1, 1, length(c1) - 2)')} ELSE c1 END AS c2 FROM c1),
ln AS (
  SELECT source, CASE WHEN c2 = '' THEN 0 ELSE len(list_filter(string_split(c2, chr(10)), lambda l:
           {sql_trim('l')} NOT IN ('{{', '}}', '') AND NOT starts_with({sql_trim('l')}, '/')
           AND NOT starts_with({sql_trim('l')}, '*'))) END AS length
  FROM c2)
SELECT source, CAST(length AS INTEGER) AS length, count(*) AS n_methods FROM ln GROUP BY ALL
""")

oracle("normalise_name", f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, substr({sql_normalize('line', 'BLANK')}, 1, 50) AS name FROM l
""")

oracle("subtokens", f"""
WITH ch AS (SELECT unnest(regexp_extract_all(text, '\\S+')) AS chunk FROM documents),
st AS (SELECT unnest({sql_subtokens('chunk')}) AS subtoken FROM ch)
SELECT subtoken, count(*) AS cnt FROM st GROUP BY subtoken
""")

oracle("leaf_label", f"""
WITH {W_TOK},
t AS (SELECT DISTINCT token, kind FROM w_tok),
s AS (SELECT token, kind, {sql_subtokens('token')} AS sub, substr({sql_normalize('token', 'BLANK')}, 1, 50) AS name FROM t)
SELECT token, kind,
       CASE WHEN len(sub) > 0 THEN array_to_string(sub, '|')
            WHEN kind = 'num' AND name NOT IN ('0', '1', '32', '64') THEN '<NUM>'
            ELSE name END AS label
FROM s
""")


# ---------------------------------------------------------------------------------------------
# G: graphs (binding E token graphs; binding O tree graphs)
# ---------------------------------------------------------------------------------------------

E_EDGES = E_TOK + """,
e_nt AS (
  SELECT file_id AS graph_id, CAST(pos AS BIGINT) AS src,
         CAST(lead(pos) OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS dst, 'NextToken' AS edge_type FROM e_tok),
e_lu AS (
  SELECT file_id AS graph_id, CAST(pos AS BIGINT) AS src,
         CAST(lag(pos) OVER (PARTITION BY file_id, decl_id ORDER BY pos) AS BIGINT) AS dst, 'LastUse' AS edge_type FROM e_tok),
e_lw AS (
  SELECT file_id AS graph_id, CAST(pos AS BIGINT) AS src,
         CAST(max(CASE WHEN is_write THEN pos END) OVER (PARTITION BY file_id, decl_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS dst, 'LastWrite' AS edge_type FROM e_tok),
e_base AS (
  SELECT DISTINCT * FROM (SELECT * FROM e_nt UNION ALL SELECT * FROM e_lu UNION ALL SELECT * FROM e_lw) WHERE dst IS NOT NULL),
e_g AS (
  SELECT DISTINCT * FROM (
    SELECT * FROM e_base
    UNION ALL SELECT graph_id, dst, src, 'reversed' || edge_type FROM e_base))"""

oracle("reverse_edges", f"""
WITH {E_EDGES}
SELECT * FROM e_g
""")

oracle("edge_dedup", f"""
WITH {E_EDGES}
SELECT edge_type, count(*) AS n_edges FROM (
  SELECT DISTINCT * FROM (SELECT * FROM e_nt UNION ALL SELECT * FROM e_nt UNION ALL SELECT * FROM e_lu) WHERE dst IS NOT NULL)
GROUP BY edge_type
""")

oracle("next_token", f"""
WITH {E_EDGES}
SELECT * FROM e_nt WHERE dst IS NOT NULL
""")

oracle("last_lexical_use", f"""
WITH {E_TOK}
SELECT * FROM (
  SELECT file_id AS graph_id, CAST(pos AS BIGINT) AS src,
         CAST(lag(pos) OVER (PARTITION BY file_id, token ORDER BY pos) AS BIGINT) AS dst, 'LastLexicalUse' AS edge_type
  FROM e_tok) WHERE dst IS NOT NULL
""")

oracle("last_use", f"""
WITH {E_EDGES}
SELECT * FROM e_lu WHERE dst IS NOT NULL
""")

oracle("last_write", f"""
WITH {E_EDGES}
SELECT * FROM e_lw WHERE dst IS NOT NULL
""")

oracle("remove_edge", f"""
WITH {E_EDGES}
SELECT * FROM e_g g WHERE NOT EXISTS (
  SELECT 1 FROM e_lw w WHERE w.dst IS NOT NULL AND w.graph_id = g.graph_id
    AND ((w.src = g.src AND w.dst = g.dst AND g.edge_type = 'LastWrite')
      OR (w.src = g.dst AND w.dst = g.src AND g.edge_type = 'reversedLastWrite')))
""")

oracle("rewire_target", f"""
WITH {E_TOK},
tg AS (SELECT file_id, token, decl_id AS target FROM e_tok WHERE is_decl),
r AS (
  SELECT tg.target, t.file_id AS graph_id, CAST(t.pos AS BIGINT) AS src,
         CAST(lag(t.pos) OVER (PARTITION BY tg.target, t.file_id, t.token, t.decl_id = tg.target ORDER BY t.pos) AS BIGINT) AS dst
  FROM e_tok t JOIN tg ON tg.file_id = t.file_id AND tg.token = t.token)
SELECT DISTINCT target, graph_id, src, dst FROM r WHERE dst IS NOT NULL
""")

oracle("state_sets", f"""
WITH {E_TOK},
st AS (SELECT CAST(file_id AS VARCHAR) AS decl_id, token AS ident,
              pos <= max(pos) OVER (PARTITION BY file_id) / 2 AS first FROM e_tok),
a AS (SELECT decl_id, ident FROM st WHERE first),
b AS (SELECT decl_id, ident FROM st WHERE NOT first)
SELECT decl_id, ident, count(*) AS cnt, 'merge' AS op FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT DISTINCT decl_id, ident, 1, 'distinct' FROM a
UNION ALL SELECT decl_id, ident, count(*), 'subtract' FROM a
  WHERE NOT (decl_id IN (SELECT decl_id FROM b) AND (decl_id, ident) IN (SELECT decl_id, ident FROM b))
  GROUP BY ALL
""")

oracle("flow_last_use_write", f"""
WITH RECURSIVE {E_TOK},
sizes AS (SELECT file_id, max(pos) AS last FROM e_tok GROUP BY file_id),
cfg AS (
  SELECT c.* FROM (
    SELECT file_id, pos AS frm, pos + 1 AS dst FROM e_tok
    UNION ALL SELECT file_id, pos, pos + 2 FROM e_tok WHERE token = 'click'
    UNION ALL SELECT file_id, pos, pos - 3 FROM e_tok WHERE token = 'signup' AND pos >= 3) c
  JOIN sizes s USING (file_id) WHERE c.dst <= s.last),
walk(kind, file_id, decl_id, u, here) AS (
  SELECT k.kind, file_id, decl_id, pos, pos FROM e_tok, (VALUES ('LastUse'), ('LastWrite')) k(kind)
  UNION
  SELECT w.kind, w.file_id, w.decl_id, w.u, c.frm
  FROM walk w JOIN cfg c ON c.file_id = w.file_id AND c.dst = w.here
  LEFT JOIN e_tok t ON t.file_id = c.file_id AND t.pos = c.frm AND t.decl_id = w.decl_id AND (w.kind = 'LastUse' OR t.is_write)
  WHERE t.pos IS NULL)
SELECT DISTINCT w.file_id AS graph_id, CAST(w.u AS BIGINT) AS src, CAST(c.frm AS BIGINT) AS dst, w.kind AS edge_type
FROM walk w JOIN cfg c ON c.file_id = w.file_id AND c.dst = w.here
JOIN e_tok t ON t.file_id = c.file_id AND t.pos = c.frm AND t.decl_id = w.decl_id AND (w.kind = 'LastUse' OR t.is_write)
""")

oracle("k_hop_subgraph", f"""
WITH RECURSIVE {E_EDGES},
reach(decl_id, graph_id, node, hop) AS (
  SELECT decl_id, file_id, CAST(pos AS BIGINT), 0 FROM e_tok
  UNION
  SELECT r.decl_id, r.graph_id, g.dst, r.hop + 1 FROM reach r JOIN e_g g ON g.graph_id = r.graph_id AND g.src = r.node
  WHERE r.hop < 7),
vis AS (SELECT DISTINCT decl_id, graph_id, node FROM reach),
cp AS (SELECT v.decl_id, g.graph_id, g.src, g.dst, g.edge_type FROM vis v JOIN e_g g ON g.graph_id = v.graph_id AND g.src = v.node),
both_dirs AS (
  SELECT * FROM cp
  UNION ALL SELECT decl_id, graph_id, dst, src,
    CASE WHEN starts_with(edge_type, 'reversed') THEN substr(edge_type, 9) ELSE 'reversed' || edge_type END FROM cp)
SELECT DISTINCT decl_id, src, dst, edge_type FROM both_dirs
""")

E_RECORDS = f"""
WITH RECURSIVE {E_EDGES},
reach(decl_id, graph_id, node, hop) AS (
  SELECT decl_id, file_id, CAST(pos AS BIGINT), 0 FROM e_tok
  UNION
  SELECT r.decl_id, r.graph_id, g.dst, r.hop + 1 FROM reach r JOIN e_g g ON g.graph_id = r.graph_id AND g.src = r.node
  WHERE r.hop < 7),
vis AS (SELECT DISTINCT decl_id, graph_id, node FROM reach),
cp AS (SELECT v.decl_id, g.graph_id, g.src, g.dst, g.edge_type FROM vis v JOIN e_g g ON g.graph_id = v.graph_id AND g.src = v.node),
sub AS (
  SELECT DISTINCT * FROM (SELECT * FROM cp
  UNION ALL SELECT decl_id, graph_id, dst, src,
    CASE WHEN starts_with(edge_type, 'reversed') THEN substr(edge_type, 9) ELSE 'reversed' || edge_type END FROM cp)),
nodes AS (SELECT DISTINCT decl_id, graph_id, src AS node FROM sub),
lab AS (
  SELECT n.decl_id, count(*) AS n_nodes, count(*) FILTER (WHERE t.decl_id = n.decl_id) AS n_target_nodes
  FROM nodes n JOIN e_tok t ON t.file_id = n.graph_id AND t.pos = n.node GROUP BY n.decl_id),
ed AS (SELECT decl_id, count(*) AS n_edges, count(DISTINCT edge_type) AS n_types FROM sub GROUP BY decl_id),
recs AS (
  SELECT t.decl_id, CAST(t.file_id AS VARCHAR) AS file, t.token AS name, t."offset" AS span_start, t."offset" + length(t.token) AS span_end,
         n_nodes, n_types, n_edges, n_target_nodes
  FROM e_tok t JOIN lab USING (decl_id) JOIN ed USING (decl_id) WHERE t.is_decl)"""

oracle("graph_record", f"""
{E_RECORDS}
SELECT decl_id, file, name, 'ident' AS types, span_start, span_end, CAST(n_nodes AS INTEGER) AS n_nodes, CAST(n_types AS INTEGER) AS n_types,
       CAST(n_edges AS INTEGER) AS n_edges, CAST(n_target_nodes AS INTEGER) AS n_target_nodes
FROM recs
""")

oracle("self_edges", f"""
WITH {E_EDGES}
SELECT * FROM e_lu WHERE dst IS NOT NULL
UNION ALL SELECT file_id, CAST(pos AS BIGINT), CAST(pos AS BIGINT), 'LastUse' FROM e_tok WHERE is_write
""")


oracle("child_edges", f"""
WITH {O_TREE}
SELECT o_custkey AS graph_id, o_custkey * 3 AS src, o_orderkey * 3 + 1 AS dst, 'Child' AS edge_type FROM o_o
UNION ALL SELECT o_custkey, l_orderkey * 3 + 1, -(l_orderkey * 2147483648 + li) - 1, 'Child' FROM o_l
""")

oracle("computed_from", f"""
WITH {O_TREE}
SELECT a.o_custkey AS graph_id, -(a.l_orderkey * 2147483648 + a.li) - 1 AS src, -(b.l_orderkey * 2147483648 + b.li) - 1 AS dst,
       'ComputedFrom' AS edge_type
FROM o_l a JOIN o_l b ON a.l_orderkey = b.l_orderkey AND a.li = 0 AND b.li > 0
""")

oracle("formal_arg_name", f"""
WITH {O_TREE},
calls AS (SELECT a.o_custkey, a.o_orderkey AS call_o, b.o_orderkey AS callee_o FROM o_o a JOIN o_o b ON a.o_custkey = b.o_custkey AND b.oi = a.oi + 1),
na AS (SELECT l_orderkey, count(*) AS n FROM o_l GROUP BY l_orderkey),
ok AS (SELECT c.* FROM calls c JOIN na x ON x.l_orderkey = c.call_o JOIN na y ON y.l_orderkey = c.callee_o WHERE x.n = y.n)
SELECT ok.o_custkey AS graph_id, -(a.l_orderkey * 2147483648 + a.li) - 1 AS src, -(p.l_orderkey * 2147483648 + p.li) - 1 AS dst,
       'FormalArgName' AS edge_type
FROM ok JOIN o_l a ON a.l_orderkey = ok.call_o JOIN o_l p ON p.l_orderkey = ok.callee_o AND p.li = a.li
WHERE a.l_returnflag <> 'N' AND p.l_returnflag <> 'N'
""")

oracle("returns_to", f"""
WITH {O_TREE}
SELECT l.o_custkey AS graph_id, -(l.l_orderkey * 2147483648 + l.li) - 1 AS src, l.o_custkey * 3 AS dst, 'ReturnsTo' AS edge_type
FROM o_l l JOIN o_o o ON o.o_orderkey = l.l_orderkey
WHERE l.l_returnflag = 'R' AND o.o_orderpriority <> '1-URGENT'
""")

oracle("guarded_by", f"""
WITH {O_TREE},
st AS (SELECT o_orderkey, o_orderstatus FROM orders),
cond AS (SELECT o_custkey, o_orderkey FROM o_o WHERE oi = 0),
cv AS (SELECT DISTINCT c.o_custkey, c.o_orderkey AS cond_o, l.l_returnflag FROM cond c JOIN o_l l ON l.l_orderkey = c.o_orderkey)
SELECT DISTINCT b.o_custkey AS graph_id, -(l.l_orderkey * 2147483648 + l.li) - 1 AS src, cv.cond_o * 3 + 1 AS dst,
       CASE WHEN st.o_orderstatus = 'O' THEN 'GuardedByNegation' ELSE 'GuardedBy' END AS edge_type
FROM o_o b JOIN st ON st.o_orderkey = b.o_orderkey JOIN o_l l ON l.l_orderkey = b.o_orderkey
JOIN cv ON cv.o_custkey = b.o_custkey AND cv.l_returnflag = l.l_returnflag
WHERE b.oi > 0
""")

oracle("node_labels", f"""
WITH {O_TREE},
lab AS (
  SELECT c_custkey AS graph_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM o_o) THEN 'hodDeclara' ELSE c_name END AS label FROM customer
  UNION ALL SELECT o_custkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM o_l) THEN 'hodCall' ELSE o_orderpriority END FROM o_o
  UNION ALL SELECT o_custkey, l_returnflag FROM o_l)
SELECT graph_id, label, count(*) AS cnt FROM lab GROUP BY ALL
""")


# ---------------------------------------------------------------------------------------------
# B, I, F, E, D
# ---------------------------------------------------------------------------------------------

B_CELLS = """
b_r AS (SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step FROM embeddings),
b_v AS (SELECT CAST(label AS VARCHAR) || ':' || CAST(step // 5 AS VARCHAR) AS item, CAST(step % 5 AS INTEGER) AS step,
               CAST(unnest(range(len(embedding))) AS INTEGER) AS beam, CAST(unnest(embedding) AS DOUBLE) AS v FROM b_r),
b_c AS (SELECT item, step, beam, CAST(abs(CAST(trunc(v * 1000) AS INTEGER)) % 25 AS INTEGER) AS token_id, v AS logp
        FROM b_v WHERE beam < 10),
b_d AS (SELECT n_nationkey AS token_id, lower(n_name) AS subtoken FROM nation),
b_s AS (
  SELECT c.item, c.beam,
         coalesce(max(d.subtoken) FILTER (WHERE c.step = 0), '')
         || coalesce(string_agg(upper(substr(d.subtoken, 1, 1)) || substr(d.subtoken, 2), '' ORDER BY c.step)
                     FILTER (WHERE c.step > 0 AND d.subtoken IS NOT NULL AND d.subtoken NOT IN ('<PAD>', '<UNK>')), '') AS name,
         exp(sum(c.logp)) AS score
  FROM b_c c LEFT JOIN b_d d USING (token_id) GROUP BY c.item, c.beam)"""

oracle("beam_transpose", f"""
WITH {B_CELLS}
SELECT item, beam, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY step) AS token_ids, CAST(count(*) AS INTEGER) AS n_steps
FROM b_c GROUP BY item, beam
""")

oracle("beam_score", f"""
WITH {B_CELLS}
SELECT item, beam, name, round(score, 6) AS score FROM b_s
""")

oracle("beam_filter", f"""
WITH {B_CELLS}
SELECT item, beam, name, round(score, 6) AS score FROM b_s
WHERE length(name) > 0 AND name <> lower(name) AND name NOT IN ('<UNK>', '<PAD>')
""")

oracle("eligible_methods", f"""
WITH {O_METHODS}
SELECT m.method_id, m.name FROM o_m m JOIN customer c ON c.c_custkey = m.method_id
WHERE m.body IS NOT NULL AND NOT c.c_acctbal < 0 AND NOT c.c_custkey % 5 = 0
""")

oracle("method_name_findings", f"""
WITH {E_RANK},
sug AS (SELECT decl_id, name FROM rk WHERE rank <= 10),
cur AS (SELECT decl_id, token AS name FROM e_tok WHERE is_decl)
SELECT decl_id AS element, name FROM cur
WHERE decl_id IN (SELECT decl_id FROM sug) AND (decl_id, name) NOT IN (SELECT decl_id, name FROM sug)
""")

DOC_LINES = """
d_l AS (
  SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no,
         unnest(string_split(text, chr(10))) AS text
  FROM documents)"""

oracle("long_conditions", f"""
WITH {DOC_LINES}
SELECT doc_id, line_no, CAST(length(text) AS INTEGER) AS length FROM d_l WHERE length(text) > 100
""")

oracle("captured_params", f"""
WITH {DOC_LINES}, {W_TOK},
c AS (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR) AS cond_id, doc_id, text FROM d_l WHERE length(text) > 100),
p AS (SELECT file_id, pos, kind, token FROM w_tok WHERE is_decl AND decl_id IS NOT NULL)
SELECT cond_id, string_agg(p.kind || ' ' || p.token, ', ' ORDER BY p.pos) AS declared,
       string_agg(p.token, ', ' ORDER BY p.pos) AS call
FROM c JOIN p ON p.file_id = c.doc_id AND contains(c.text, p.token)
GROUP BY cond_id
""")

oracle("pick_free_name", f"""
WITH {E_RANK},
sug AS (SELECT r.decl_id, d.file_id, r.name, r.p FROM rk r JOIN (SELECT DISTINCT decl_id, file_id FROM e_tok) d USING (decl_id) WHERE r.rank <= 10),
sib AS (SELECT file_id, token AS name, decl_id AS owner FROM e_tok WHERE is_decl),
free AS (SELECT * FROM sug s WHERE NOT EXISTS (
  SELECT 1 FROM sib WHERE sib.file_id = s.file_id AND sib.name = s.name AND sib.owner <> s.decl_id)),
best AS (SELECT decl_id, name, row_number() OVER (PARTITION BY decl_id ORDER BY p DESC, name DESC) AS r FROM free)
SELECT decl_id AS element, name FROM best WHERE r = 1
""")

oracle("rename_stats", f"""
SELECT CASE event_type WHEN 'purchase' THEN 'applied' ELSE 'ignored' END AS action, value AS score, count(*) AS cnt
FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL
""")

oracle("rename_counters", """
SELECT CASE event_type WHEN 'purchase' THEN 'applied' ELSE 'ignored' END AS action, count(*) AS n_renames,
       CAST(sum(CASE event_type WHEN 'purchase' THEN 1 ELSE event_id % 3 END) AS BIGINT) AS n_scores
FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL
""")

oracle("latest_state", f"""
WITH p AS (
  SELECT user_id, value, ts, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM events WHERE event_type = 'view'),
lp AS (SELECT user_id, value, ts, event_id FROM p WHERE r = 1)
SELECT lp.user_id AS element, lp.value,
       EXISTS (SELECT 1 FROM events e WHERE e.user_id = lp.user_id AND e.event_type = 'click'
               AND (e.ts > lp.ts OR (e.ts = lp.ts AND e.event_id > lp.event_id))) AS need_recalc,
       EXISTS (SELECT 1 FROM events e WHERE e.user_id = lp.user_id AND e.event_type = 'error'
               AND (e.ts > lp.ts OR (e.ts = lp.ts AND e.event_id > lp.event_id))) AS "ignore"
FROM lp
""")

oracle("suggestion_edit", f"""
WITH ev AS (
  SELECT user_id AS element, event_type, value, 'n' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) AS name
  FROM events),
u AS (
  SELECT element, name, value AS score FROM ev WHERE event_type = 'view'
  UNION ALL SELECT element, name, -1.0 FROM ev WHERE event_type = 'click')
SELECT * FROM u WHERE (element, name) NOT IN (SELECT element, name FROM ev WHERE event_type = 'error')
""")

# Rankings by the project's own model with the variable's file forgotten, on E_CAND's usages.
def own_jm(seq_table: str, ids: str, out: str) -> str:
    """The interpolated probability of ``seq_table`` (file_id, project, s) by project counts less the file's."""
    own = ", ".join(f"s.{i.strip()}" for i in ids.split(","))
    return f"""
{out}_t AS (
  SELECT {own}, s.project, r.k, coalesce(ng.cnt, 0) - coalesce(mng.cnt, 0) AS c, coalesce(cx.cnt, 0) - coalesce(mcx.cnt, 0) AS x
  FROM {seq_table} s, range(1, 7) r(k)
  LEFT JOIN p_ng ng ON ng.project = s.project AND ng.ngram = list_slice(s.s, len(s.s) - r.k + 1, len(s.s))
  LEFT JOIN p_cx cx ON cx.project = s.project AND cx.ctx = list_slice(s.s, len(s.s) - r.k + 1, len(s.s) - 1)
  LEFT JOIN f_ng mng ON mng.file_id = s.file_id AND mng.ngram = list_slice(s.s, len(s.s) - r.k + 1, len(s.s))
  LEFT JOIN f_cx mcx ON mcx.file_id = s.file_id AND mcx.ctx = list_slice(s.s, len(s.s) - r.k + 1, len(s.s) - 1)
  WHERE r.k <= len(s.s)),
{out}_h AS (
  SELECT {ids}, coalesce(min(k) FILTER (WHERE x <= 0), max(k) + 1) - 1 AS h FROM {out}_t GROUP BY ALL),
{out}_p AS (
  SELECT {ids}, sum(CASE WHEN k <= h THEN 0.5 * pow(0.5, h - k) * c / x ELSE 0 END) + pow(0.5, h) / any_value(v) AS p
  FROM {out}_t JOIN {out}_h USING ({ids}) JOIN p_v USING (project) GROUP BY {ids}, h)"""


E_OWN = """
f_grams AS (SELECT project, file_id, list_slice(w, len(w) - n + 1, len(w)) AS g FROM e_win, range(1, 7) r(n) WHERE n <= len(w)),
f_ng AS (SELECT project, file_id, g AS ngram, count(*) AS cnt FROM f_grams GROUP BY ALL),
f_cx AS (SELECT file_id, list_slice(ngram, 1, len(ngram) - 1) AS ctx, sum(cnt) AS cnt FROM f_ng GROUP BY ALL),
p_ng AS (SELECT project, ngram, sum(cnt) AS cnt FROM f_ng GROUP BY ALL),
p_cx AS (SELECT project, list_slice(ngram, 1, len(ngram) - 1) AS ctx, sum(cnt) AS cnt FROM p_ng GROUP BY ALL),
p_v AS (SELECT project, count(*) AS v FROM p_ng WHERE len(ngram) = 1 GROUP BY project),
o_body AS (SELECT b.*, b.file_id % 10 AS project FROM body b),
o_need AS (SELECT DISTINCT file_id, project, list_slice(b, len(b) - r.j + 1, len(b)) AS ctx FROM o_body, range(0, 6) r(j) WHERE r.j <= len(b)),
o_all AS (
  SELECT n.file_id, n.ctx, p.ngram[len(p.ngram)] AS name, p.cnt - coalesce(f.cnt, 0) AS cnt
  FROM o_need n JOIN p_ng p ON p.project = n.project AND list_slice(p.ngram, 1, len(p.ngram) - 1) = n.ctx
  LEFT JOIN f_ng f ON f.file_id = n.file_id AND f.ngram = p.ngram),
o_succ AS (SELECT *, row_number() OVER (PARTITION BY file_id, ctx ORDER BY cnt DESC, name) AS r FROM o_all WHERE cnt > 0),
o_cand AS (
  SELECT DISTINCT b.file_id, b.project, b.pos, b.decl_id, b.b, s.name
  FROM o_body b, range(0, 6) r(j)
  JOIN o_succ s ON s.r <= 10 AND s.file_id = b.file_id AND s.ctx = list_slice(b.b, len(b.b) - r.j + 1, len(b.b))
  WHERE r.j <= len(b.b) AND s.name IN (SELECT token FROM e_tok WHERE is_decl)),
o_seq AS (SELECT file_id, project, pos, decl_id, name, list_append(b, name) AS s FROM o_cand),
""" + own_jm("o_seq", "file_id, pos, name", "oj") + """,
op_t AS (
  SELECT b.file_id, b.pos, r.k, coalesce(cx.cnt, 0) - coalesce(mcx.cnt, 0) AS x
  FROM o_body b, range(1, 6) r(k)
  LEFT JOIN p_cx cx ON cx.project = b.project AND cx.ctx = list_slice(b.b, len(b.b) - r.k + 1, len(b.b))
  LEFT JOIN f_cx mcx ON mcx.file_id = b.file_id AND mcx.ctx = list_slice(b.b, len(b.b) - r.k + 1, len(b.b))
  WHERE r.k <= len(b.b)),
op_z AS (
  SELECT file_id, pos, k, CASE WHEN k < coalesce(min(k) FILTER (WHERE x = 0) OVER (PARTITION BY file_id, pos), 99) THEN x ELSE 0 END AS x
  FROM op_t),
op_f AS (
  SELECT file_id, pos, list_reduce(list_prepend(0::BIGINT, list(x::BIGINT ORDER BY k)), lambda a, x: a // 2 + x) AS prio FROM op_z GROUP BY ALL),
o_prio AS (SELECT b.file_id, b.pos, b.decl_id, greatest(1, coalesce(op_f.prio, 0)) AS prio FROM body b LEFT JOIN op_f USING (file_id, pos)),
o_tot AS (SELECT decl_id, sum(prio) AS total FROM o_prio GROUP BY decl_id),
o_agg AS (
  SELECT s.decl_id, s.name, sum(oj_p.p * o_prio.prio) / any_value(o_tot.total) AS p
  FROM oj_p JOIN o_seq s USING (file_id, pos, name) JOIN o_prio USING (file_id, pos) JOIN o_tot ON o_tot.decl_id = s.decl_id
  GROUP BY s.decl_id, s.name),
o_rk AS (SELECT *, row_number() OVER (PARTITION BY decl_id ORDER BY round(p, 12) DESC, name) AS rank FROM o_agg),
o_sub AS (
  SELECT u.decl_id, u.file_id, u.file_id % 10 AS project, c.name, u.i,
         list_transform(w.w, lambda e: CASE WHEN e.d = u.decl_id THEN c.name ELSE e.t END) AS s
  FROM upos u JOIN cwin w USING (file_id, i) JOIN (SELECT DISTINCT decl_id, name FROM o_cand) c ON c.decl_id = u.decl_id),
""" + own_jm("o_sub", "decl_id, name, i", "oc") + """,
o_lp AS (SELECT decl_id, name, sum(ln(p)) / 6 AS z FROM oc_p GROUP BY decl_id, name),
o_e AS (SELECT decl_id, name, exp(z - max(z) OVER (PARTITION BY decl_id)) AS e FROM o_lp),
o_sm AS (SELECT decl_id, name, e / sum(e) OVER (PARTITION BY decl_id) AS p FROM o_e),
o_ctx AS (SELECT *, row_number() OVER (PARTITION BY decl_id ORDER BY round(p, 12) DESC, name) AS rank FROM o_sm)"""

E_REC = E_PRED + """,
cands_ctx AS (
  SELECT decl_id, name, row_number() OVER (PARTITION BY decl_id ORDER BY round(p, 12) DESC, name) AS rank FROM sm),
""" + E_OWN + """,
answers AS (
  SELECT d.decl_id, t.token AS name, row_number() OVER (PARTITION BY d.decl_id ORDER BY t.cnt DESC, t.token) AS rank
  FROM e_tok d JOIN (SELECT file_id, token, count(*) AS cnt FROM e_tok GROUP BY ALL) t USING (file_id)
  WHERE d.is_decl AND d.pos > 0),
lists AS (
  SELECT 'global' AS scope, 'ngram' AS m, decl_id, name, rank FROM rk WHERE rank <= 10
  UNION ALL SELECT 'global', 'context', decl_id, name, rank FROM cands_ctx WHERE rank <= 10
  UNION ALL SELECT 'project', 'ngram', decl_id, name, rank FROM o_rk WHERE rank <= 10
  UNION ALL SELECT 'project', 'context', decl_id, name, rank FROM o_ctx WHERE rank <= 10
  UNION ALL SELECT s.scope, 'external', decl_id, name, rank FROM answers, (VALUES ('global'), ('project')) s(scope) WHERE rank <= 3),
joined AS (SELECT scope, m, decl_id, string_agg(name, '|' ORDER BY rank) AS names FROM lists GROUP BY ALL),
vars AS (SELECT decl_id, file_id, token AS ground_truth FROM e_tok WHERE is_decl AND length(token) > 0),
rec AS (
  SELECT v.decl_id, v.file_id, v.ground_truth, s.scope, coalesce(n.names, '') AS ngram, coalesce(c.names, '') AS context, coalesce(x.names, '') AS external
  FROM vars v CROSS JOIN (VALUES ('global'), ('project')) s(scope)
  LEFT JOIN joined n ON n.decl_id = v.decl_id AND n.scope = s.scope AND n.m = 'ngram'
  LEFT JOIN joined c ON c.decl_id = v.decl_id AND c.scope = s.scope AND c.m = 'context'
  LEFT JOIN joined x ON x.decl_id = v.decl_id AND x.scope = s.scope AND x.m = 'external')"""

oracle("prediction_records", f"""
WITH {E_REC}
SELECT decl_id, ground_truth, ngram, context, external, 0 AS line, 'ident' AS kind, scope FROM rec
""")

oracle("file_predictions", f"""
WITH {E_REC}
SELECT file_id, CAST(count(*) AS INTEGER) AS n_records,
       array_to_string(list_sort(list(decl_id || ':' || scope || ':' || ngram)), ',') AS records
FROM rec GROUP BY file_id
""")

oracle("contributors", f"""
WITH {E_PRED},
psum AS (SELECT decl_id, sum(priority) AS psum FROM (SELECT DISTINCT decl_id, model, priority FROM preds) GROUP BY decl_id),
sc AS (
  SELECT p.decl_id, p.name, sum(p.p * p.priority) / any_value(s.psum) AS p
  FROM preds p JOIN psum s USING (decl_id) GROUP BY p.decl_id, p.name),
r AS (SELECT *, row_number() OVER (PARTITION BY decl_id ORDER BY round(p, 12) DESC, name) AS rank FROM sc)
SELECT decl_id, name, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND p >= 0.001
""")

oracle("node_labeler", f"""
WITH {O_TREE},
lab AS (
  SELECT c_custkey AS graph_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM o_o) THEN 'MethodDeclaration' ELSE upper(c_name) END AS label FROM customer
  UNION ALL SELECT o_custkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM o_l) THEN 'MethodCallExpr' ELSE upper(o_orderpriority) END FROM o_o
  UNION ALL SELECT o_custkey, upper(l_returnflag) FROM o_l)
SELECT graph_id, label, count(*) AS cnt FROM lab GROUP BY ALL
""")



# ---------------------------------------------------------------------------------------------
# M1 on W, M4, M5, U8-U10, sinks, streams
# ---------------------------------------------------------------------------------------------

W_NGRAMS = """
wd AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]') AS t FROM documents),
wt AS (SELECT doc_id, unnest(t) AS t0, unnest(range(len(t))) AS i FROM wd),
wl AS (
  SELECT t0, lag(t0, 1) OVER w AS t1, lag(t0, 2) OVER w AS t2, lag(t0, 3) OVER w AS t3,
         lag(t0, 4) OVER w AS t4, lag(t0, 5) OVER w AS t5
  FROM wt WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
wg AS (
  SELECT 1 AS n, t0 AS g FROM wl
  UNION ALL SELECT 2, t1 || ' ' || t0 FROM wl WHERE t1 IS NOT NULL
  UNION ALL SELECT 3, t2 || ' ' || t1 || ' ' || t0 FROM wl WHERE t2 IS NOT NULL
  UNION ALL SELECT 4, t3 || ' ' || t2 || ' ' || t1 || ' ' || t0 FROM wl WHERE t3 IS NOT NULL
  UNION ALL SELECT 5, t4 || ' ' || t3 || ' ' || t2 || ' ' || t1 || ' ' || t0 FROM wl WHERE t4 IS NOT NULL
  UNION ALL SELECT 6, t5 || ' ' || t4 || ' ' || t3 || ' ' || t2 || ' ' || t1 || ' ' || t0 FROM wl WHERE t5 IS NOT NULL),
wn AS (SELECT CAST(n AS INTEGER) AS n, g AS ngram, count(*) AS cnt FROM wg GROUP BY n, g)"""

oracle("ngram_counts_words", f"""
WITH {W_NGRAMS}
SELECT n, ngram, cnt FROM wn
""")

oracle("stream_ngram_counts", f"""
WITH {W_NGRAMS}
SELECT n, ngram, CAST(cnt AS BIGINT) AS cnt FROM wn
""")

oracle("loo_counts", f"""
WITH {E_MODEL},
f_g AS (SELECT file_id, list_slice(w, len(w) - n + 1, len(w)) AS g FROM e_win, range(1, 7) r(n) WHERE n <= len(w)),
f_ng AS (SELECT file_id, g AS ngram, count(*) AS cnt FROM f_g GROUP BY ALL),
f_cx AS (SELECT file_id, list_slice(ngram, 1, len(ngram) - 1) AS ctx, sum(cnt) AS cnt FROM f_ng GROUP BY ALL),
{jm_sql('e_win', 'file_id, pos', 'w', 'e_ng', 'e_cx', 'e_v', minus=('f_ng', 'f_cx', 'file_id'))}
SELECT file_id, pos, round(p, 6) AS p FROM jm_p
""")

oracle("loo_usage", f"""
WITH {E_CAND},
own_g AS (
  SELECT t.decl_id, list_slice(w.w, len(w.w) - r.n + 1, len(w.w)) AS g
  FROM e_win w JOIN e_tok t USING (file_id, pos), range(1, 7) r(n) WHERE r.n <= len(w.w)),
own AS (SELECT decl_id, g AS ngram, count(*) AS cnt FROM own_g GROUP BY ALL),
own_cx AS (SELECT decl_id, list_slice(ngram, 1, len(ngram) - 1) AS ctx, sum(cnt) AS cnt FROM own GROUP BY ALL),
seqs AS (SELECT file_id, pos, decl_id, list_append(b, token) AS s FROM body),
{jm_sql('seqs', 'file_id, pos', 's', 'e_ng', 'e_cx', 'e_v', minus=('own', 'own_cx', 'decl_id'))},
lp_t AS (
  SELECT b.file_id, b.pos, r.k, coalesce(cx.cnt, 0) - coalesce(oc.cnt, 0) AS x
  FROM body b, range(1, 6) r(k)
  LEFT JOIN e_cx cx ON cx.ctx = list_slice(b.b, len(b.b) - r.k + 1, len(b.b))
  LEFT JOIN own_cx oc ON oc.decl_id = b.decl_id AND oc.ctx = list_slice(b.b, len(b.b) - r.k + 1, len(b.b))
  WHERE r.k <= len(b.b)),
lp_z AS (
  SELECT file_id, pos, k,
         CASE WHEN k < coalesce(min(k) FILTER (WHERE x <= 0) OVER (PARTITION BY file_id, pos), 99) THEN x ELSE 0 END AS x
  FROM lp_t),
lp_f AS (
  SELECT file_id, pos, list_reduce(list_prepend(0::BIGINT, list(x::BIGINT ORDER BY k)), lambda a, x: a // 2 + x) AS prio
  FROM lp_z GROUP BY ALL),
lprio AS (SELECT b.file_id, b.pos, greatest(1, coalesce(f.prio, 0)) AS prio FROM body b LEFT JOIN lp_f f USING (file_id, pos))
SELECT s.decl_id, round(sum(jm_p.p * lprio.prio) / sum(lprio.prio), 6) AS p
FROM jm_p JOIN seqs s USING (file_id, pos) JOIN lprio USING (file_id, pos)
GROUP BY s.decl_id
""")

oracle("type_list", f"""
SELECT c.c_custkey, n.n_name || coalesce('|' || r.r_name, '') AS types
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
""")

O_SCOPE = O_TREE + """,
o_var AS (
  SELECT CAST(o_custkey AS VARCHAR) || ':' || l_returnflag AS decl_id, o_custkey,
         CASE WHEN count(DISTINCT l_orderkey) = 1 THEN min(l_orderkey) * 3 + 1 ELSE o_custkey * 3 END AS scope_root,
         count(DISTINCT l_orderkey) = 1 AS in_order, min(l_orderkey) AS one_order, count(*) AS n_targets
  FROM o_l GROUP BY o_custkey, l_returnflag)"""

oracle("scope_root", f"""
WITH {O_SCOPE}
SELECT decl_id, scope_root FROM o_var
""")

oracle("scope_context", f"""
WITH {O_SCOPE}
SELECT decl_id,
       CASE WHEN in_order THEN (SELECT count(*) FROM o_l l WHERE l.l_orderkey = v.one_order)
            ELSE (SELECT count(*) FROM o_leaf f WHERE f.m = v.o_custkey) END AS n_tokens,
       n_targets
FROM o_var v
""")

oracle("vocab_read", f"""
WITH {W_VOCAB}
SELECT row_number() OVER (ORDER BY idx) AS idx, token, cnt, false AS gap FROM w_vocab WHERE cnt >= 2
""")

oracle("vocab_write", f"""
WITH {W_VOCAB}
SELECT CAST(cnt AS VARCHAR) || chr(9) || CAST(idx AS VARCHAR) || chr(9) || token AS line FROM w_vocab
""")

oracle("model_save", """
SELECT * FROM (VALUES ('ngrams', true), ('known_names', true), ('vocab', true)) t(part, written)
""")

oracle("model_load", f"""
WITH {E_MODEL}
SELECT CAST(len(ngram) AS INTEGER) AS n, array_to_string(ngram, ' ') AS ngram, cnt FROM e_ng
""")

oracle("usage_dataset_json", f"""
WITH {E_TOK}
SELECT project, CAST(file_id AS VARCHAR) AS path, CAST(count(*) AS INTEGER) AS n_vars FROM e_tok WHERE is_decl GROUP BY ALL
""")

oracle("chunked_json", f"""
{E_RECORDS},
placed AS (SELECT *, (row_number() OVER (ORDER BY decl_id) - 1) // 25 AS chunk FROM recs)
SELECT chunk, CAST(count(*) AS INTEGER) AS n_records, min(decl_id) AS first_decl, CAST(sum(n_nodes) AS INTEGER) AS n_nodes, CAST(sum(n_edges) AS INTEGER) AS n_edges
FROM placed GROUP BY chunk
UNION ALL SELECT count(*) // 25, 0, '', 0, 0 FROM recs HAVING count(*) % 25 = 0
""")

oracle("resume_antijoin", """
SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 2 = 1
""")

oracle("stream_rename_stats", ORACLE["rename_stats"])
oracle("stream_latest_state", ORACLE["latest_state"])

oracle("candidates", f"""
WITH {W_NGRAMS}, {W_TOK},
succ AS (
  SELECT n - 1 AS cn, CASE WHEN n = 1 THEN '' ELSE regexp_replace(ngram, ' [^ ]+$', '') END AS ctx,
         regexp_extract(ngram, '[^ ]+$') AS name, cnt FROM wn),
top AS (
  SELECT cn, ctx, name FROM (
    SELECT *, row_number() OVER (PARTITION BY cn, ctx ORDER BY cnt DESC, name) AS r FROM succ) WHERE r <= 10),
ml AS (
  SELECT file_id, pos, decl_id, kind,
         CASE WHEN lag(decl_id, 1) OVER w = decl_id THEN '<unknown>' ELSE lag(token, 1) OVER w END AS m1,
         CASE WHEN lag(decl_id, 2) OVER w = decl_id THEN '<unknown>' ELSE lag(token, 2) OVER w END AS m2,
         CASE WHEN lag(decl_id, 3) OVER w = decl_id THEN '<unknown>' ELSE lag(token, 3) OVER w END AS m3,
         CASE WHEN lag(decl_id, 4) OVER w = decl_id THEN '<unknown>' ELSE lag(token, 4) OVER w END AS m4,
         CASE WHEN lag(decl_id, 5) OVER w = decl_id THEN '<unknown>' ELSE lag(token, 5) OVER w END AS m5
  FROM w_tok WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
u AS (SELECT * FROM ml WHERE decl_id IS NOT NULL),
uc AS (
  SELECT file_id, pos, decl_id, kind, 1 AS cn, m1 AS ctx FROM u WHERE m1 IS NOT NULL
  UNION ALL SELECT file_id, pos, decl_id, kind, 2, m2 || ' ' || m1 FROM u WHERE m2 IS NOT NULL
  UNION ALL SELECT file_id, pos, decl_id, kind, 3, m3 || ' ' || m2 || ' ' || m1 FROM u WHERE m3 IS NOT NULL
  UNION ALL SELECT file_id, pos, decl_id, kind, 4, m4 || ' ' || m3 || ' ' || m2 || ' ' || m1 FROM u WHERE m4 IS NOT NULL
  UNION ALL SELECT file_id, pos, decl_id, kind, 5, m5 || ' ' || m4 || ' ' || m3 || ' ' || m2 || ' ' || m1 FROM u WHERE m5 IS NOT NULL),
c AS (
  SELECT uc.decl_id, uc.kind, top.name FROM uc JOIN top USING (cn, ctx)
  UNION ALL SELECT u.decl_id, u.kind, top.name FROM u, top WHERE top.cn = 0),
known AS (SELECT DISTINCT kind, token AS name FROM w_tok WHERE is_decl)
SELECT decl_id, count(DISTINCT name) AS n_names FROM c JOIN known USING (kind, name) GROUP BY decl_id
""")
