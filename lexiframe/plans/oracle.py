"""DuckDB statements equivalent to the registered queries (the correctness oracle).

DuckDB's regular expressions are RE2: ``\\w``/``\\s`` are ASCII there, so the
Unicode classes are spelled out.  ``strip_accents(lower(text))`` is DuckDB's
form of NFD -> lowercase -> strip marks.
"""

from __future__ import annotations

from lexiframe.plans.catalog import BATCH_SIZE, BPE_SMALL_SIZE, D_MODEL, EVAL_FRACTIONS, EVAL_STEPS, MAX_LENGTH, \
    RESUME_AT, SEED, SMOOTHING, SPLIT_FRACTIONS
from lexiframe.sources.corpus import _hex_threshold

_WORD_CHARS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"
_SPACE_CHARS = r"\t-\r\x{85}\p{Z}"
WORDS_RE = f"[{_WORD_CHARS}]+|[^{_WORD_CHARS}{_SPACE_CHARS}]+"
NONSPACE_RE = f"[^{_SPACE_CHARS}]"
HEADING_RE = r"(?sm)\A(.*?)^ ?(?:= )+([^\n]+) ?(?:= ?)+$"
NORM = "strip_accents(lower({}))"
T1 = _hex_threshold(SPLIT_FRACTIONS[0])
T2 = _hex_threshold(SPLIT_FRACTIONS[0] + SPLIT_FRACTIONS[1])

SPECIALS_SQL = ("SELECT * FROM (VALUES ('[UNK]', 0), ('[PAD]', 1), ('[CLS]', 2), ('[SEP]', 3), "
                "('[MASK]', 4), ('[EOS]', 5), ('[BOS]', 6)) s(token, id)")


def _words(expr: str) -> str:
    return f"regexp_extract_all({NORM.format(expr)}, '{WORDS_RE}')"


def _split_case(key: str, t1: str = T1, t2: str = T2) -> str:
    h = f"substr(md5('{SEED}:' || {key}::VARCHAR), 1, 4)"
    return f"CASE WHEN {h} < '{t1}' THEN 'train' WHEN {h} < '{t2}' THEN 'validation' ELSE 'test' END"


def _r(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)::DOUBLE"


def _ints(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


# alphabet of the normalised documents, numbered after the 7 specials
ALPHA_CTE = f"""alpha AS (
  SELECT token, (row_number() OVER (ORDER BY token) + 6)::BIGINT AS id FROM (
    SELECT DISTINCT unnest(regexp_extract_all({NORM.format('text')}, '{NONSPACE_RE}')) AS token
    FROM documents) a
),
amap AS (SELECT map(list(token), list(id)) AS m FROM alpha)"""


def _char_ids(text_expr: str) -> str:
    """ids of the characters of the words of a text (unknown -> 0)."""
    return (f"list_transform(flatten(list_transform({_words(text_expr)}, lambda w: regexp_extract_all(w, '.'))), "
            f"lambda c: coalesce(amap.m[c], 0))")


# LM sequences: non-empty docs, heading cleaned, [BOS] ids [EOS], truncated
LM_CTE = f"""{ALPHA_CTE},
enc AS (
  SELECT d.doc_id,
         list_concat([6], {_char_ids(f"regexp_replace(d.text, '{HEADING_RE}', '\\1\\2')")}, [5])[1:{MAX_LENGTH}] AS ids
  FROM documents d, amap WHERE d.text <> ''
),
idx AS (
  SELECT doc_id, ids, (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) - 1) AS idx FROM enc
),
b AS (
  SELECT doc_id, ids, idx // {BATCH_SIZE} AS batch_id, idx % {BATCH_SIZE} AS slot,
         max(len(ids)) OVER (PARTITION BY idx // {BATCH_SIZE}) AS L FROM idx
),
pb AS (
  SELECT doc_id, batch_id, slot, ids AS raw,
         list_concat(ids, list_transform(range(L - len(ids)), lambda x: 1)) AS ids,
         list_concat(list_transform(range(len(ids)), lambda x: 1), list_transform(range(L - len(ids)), lambda x: 0)) AS mask
  FROM b
)"""

# Pair-by-pair training as a recursion.  A step holds the words (kind 0: word, count, symbols each between two
# spaces) and the vocabulary (kind 1: token, id); it counts the pairs, takes the top one by (count, left id,
# right id), replaces it from left to right, and adds the merged token unless the vocabulary has it.
BPE_CTE = f"""{ALPHA_CTE},
wc AS (SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) w GROUP BY word),
train(step, kind, word, n, s) AS (
  SELECT 0, 0, word, n, list_aggregate(list_transform(regexp_extract_all(word, '.'), lambda c: ' ' || amap.m[c] || ' '), 'string_agg', '')
  FROM wc, amap
  UNION ALL SELECT 0, 1, token, id, NULL FROM ({SPECIALS_SQL} UNION ALL SELECT token, id FROM alpha) v
  UNION ALL
  SELECT * FROM (
    WITH sym AS (SELECT n, string_split(trim(s), '  ') AS t FROM train WHERE kind = 0 AND contains(s, '  ')),
    pr AS (SELECT n, unnest(t[:-2]) AS l, unnest(t[2:]) AS r FROM sym),
    top AS (SELECT l::BIGINT AS l, r::BIGINT AS r FROM pr GROUP BY l, r
            HAVING (SELECT count(*) FROM train WHERE kind = 1) < {BPE_SMALL_SIZE}
            ORDER BY sum(n) DESC, l::BIGINT, r::BIGINT LIMIT 1),
    made AS (SELECT top.l, top.r, a.word || b.word AS token FROM top
             JOIN train a ON a.kind = 1 AND a.n = top.l JOIN train b ON b.kind = 1 AND b.n = top.r),
    named AS (SELECT made.*, (SELECT n FROM train x WHERE x.kind = 1 AND x.word = made.token) AS old,
                     (SELECT max(n) + 1 FROM train WHERE kind = 1) AS new FROM made)
    SELECT t.step + 1, t.kind, t.word, t.n,
           replace(t.s, ' ' || named.l || '  ' || named.r || ' ', ' ' || coalesce(old, new) || ' ')
    FROM train t, named
    UNION ALL
    SELECT (SELECT max(step) + 1 FROM train), 1, token, new, NULL FROM named WHERE old IS NULL
  ) x
),
fin AS (SELECT * FROM train WHERE step = (SELECT max(step) FROM train)),
seg AS (SELECT word, list_transform(string_split(trim(s), '  '), lambda x: x::BIGINT) AS ids FROM fin WHERE kind = 0)"""


def _bpe_ids(docs: str) -> str:
    """``enc(doc_id, ids)`` of ``docs(doc_id, text)``: every word replaced by its segmentation."""
    return f"""dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
        FROM (SELECT doc_id, {_words('text')} AS w FROM ({docs}) d) x),
di AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM dw JOIN seg USING (word) GROUP BY doc_id),
bpe AS (SELECT d.doc_id, coalesce(di.ids, []) AS ids FROM ({docs}) d LEFT JOIN di USING (doc_id))"""


PAIRS_CTE = """c AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
  FROM conversations
),
pairs AS (SELECT conv_id, turn, text AS source, nt AS target FROM c WHERE role = 'user' AND nr = 'assistant')"""

SCORED_CTE = f"""s0 AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z, label,
         vec_id // {BATCH_SIZE} AS batch_id, CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS mask
  FROM embeddings
),
s1 AS (SELECT *, list_max(z) AS m FROM s0),
s2 AS (SELECT *, m + ln(list_sum(list_transform(z, lambda v: exp(v - m)))) AS lse FROM s1),
tl AS (
  SELECT *, lse - z[label + 1] AS loss,
         {1 - SMOOTHING} * (lse - z[label + 1]) + {SMOOTHING} * (lse - list_avg(z)) AS smooth_loss
  FROM s2
),
bl AS (
  SELECT batch_id, sum(loss * mask) / nullif(sum(mask), 0)::DOUBLE AS batch_loss,
         sum(smooth_loss * mask) / nullif(sum(mask), 0)::DOUBLE AS smooth_batch_loss,
         sum(mask)::BIGINT AS n_tokens
  FROM tl GROUP BY batch_id
),
ev AS (SELECT avg(batch_loss) AS eval_loss FROM bl),
hist AS (
  SELECT 0::BIGINT AS epoch, (batch_id * {BATCH_SIZE})::BIGINT AS step, smooth_batch_loss AS loss,
         (SELECT eval_loss FROM ev) AS val_loss
  FROM bl WHERE batch_id % {EVAL_STEPS // BATCH_SIZE} = 0
)"""


def _bleu_sql(pairs_sql: str) -> str:
    """Corpus BLEU over ``bp(pair_id, hyp, ref)`` (one reference each)."""
    return f"""WITH {pairs_sql},
ord AS (SELECT unnest([1, 2, 3, 4]) AS n),
hi AS (SELECT pair_id, hyp, n, unnest(range(0, greatest(len(hyp) - n + 1, 0))) AS i FROM bp, ord),
hc AS (SELECT pair_id, n, array_to_string(hyp[i + 1:i + n], chr(1)) AS gram, count(*) AS c FROM hi GROUP BY ALL),
ri AS (SELECT pair_id, ref, n, unnest(range(0, greatest(len(ref) - n + 1, 0))) AS i FROM bp, ord),
rc AS (SELECT pair_id, n, array_to_string(ref[i + 1:i + n], chr(1)) AS gram, count(*) AS rc FROM ri GROUP BY ALL),
cl AS (
  SELECT hc.pair_id, hc.n, sum(least(c, coalesce(rc, 0))) AS num, sum(c) AS total
  FROM hc LEFT JOIN rc USING (pair_id, n, gram) GROUP BY ALL
),
st AS (
  SELECT bp.pair_id, ord.n, len(hyp) AS hyp_len, len(ref) AS ref_len,
         coalesce(num, 0) AS num, greatest(coalesce(total, 0), 1) AS den
  FROM bp CROSS JOIN ord LEFT JOIN cl ON cl.pair_id = bp.pair_id AND cl.n = ord.n
),
pn AS (SELECT n, sum(num) AS num, sum(den) AS den FROM st GROUP BY n),
ln AS (SELECT sum(hyp_len) AS c, sum(ref_len) AS r FROM st WHERE n = 1),
agg AS (
  SELECT {", ".join(f"max(num) FILTER (WHERE n = {k}) AS num{k}, max(den) FILTER (WHERE n = {k}) AS den{k}" for k in range(1, 5))},
         (SELECT c FROM ln) AS c, (SELECT r FROM ln) AS r
  FROM pn
),
fin AS (
  SELECT *,
    CASE WHEN c > r THEN 1.0 WHEN c = 0 THEN 0.0 ELSE exp(1 - r::DOUBLE / c) END AS bp,
    {" + ".join(f"0.25 * ln(CASE WHEN num{k} = 0 THEN 2.2250738585072014e-308 ELSE num{k}::DOUBLE / den{k} END)" for k in range(1, 5))} AS logs
  FROM agg
)
SELECT {_r("CASE WHEN num1 = 0 THEN 0.0 ELSE bp * exp(logs) END")} AS bleu, {_r("bp")} AS brevity_penalty,
       {", ".join(_r(f"num{k}::DOUBLE / den{k}") + f" AS p{k}" for k in range(1, 5))},
       c::BIGINT AS hyp_len, r::BIGINT AS ref_len
FROM fin"""


def _bleu_stats_sql(pairs_sql: str) -> str:
    full = _bleu_sql(pairs_sql)
    head = full[:full.index("pn AS (")].rstrip().rstrip(",")
    return head + """
SELECT pair_id[1]::BIGINT AS conv_id, pair_id[2]::BIGINT AS turn, n::BIGINT AS n, num::BIGINT AS num, den::BIGINT AS den,
       hyp_len::BIGINT AS hyp_len, ref_len::BIGINT AS ref_len FROM st"""


_CONV_BP = PAIRS_CTE + f""",
bp AS (SELECT (conv_id, turn) AS pair_id, {_words('source')} AS hyp, {_words('target')} AS ref FROM pairs)"""

_DOC_BP = f"""dw AS (SELECT doc_id, {_words('text')} AS w FROM documents),
bp AS (
  SELECT pair_id, hyp, ref FROM (
    SELECT doc_id AS pair_id, w AS hyp, lead(w) OVER (ORDER BY doc_id) AS ref FROM dw) x
  WHERE ref IS NOT NULL
)"""

_ID_BP = f"""bp AS (SELECT doc_id AS pair_id, {_words('text')} AS hyp, {_words('text')} AS ref FROM documents)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["word_counts"] = f"""
SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) w GROUP BY word"""
    q["normalized_text"] = f"SELECT doc_id, {NORM.format('text')} AS norm_text FROM documents"
    q["pretokens"] = f"""
SELECT doc_id, len(w)::BIGINT AS n_words, array_to_string(w, ' ') AS words
FROM (SELECT doc_id, {_words('text')} AS w FROM documents) x"""
    para = "SELECT doc_id, string_split(text, chr(10)) AS s FROM documents"
    q["paragraphs"] = f"""
SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS para, unnest(s) AS text FROM ({para}) x"""
    q["clean_paragraphs"] = f"""
SELECT doc_id, para, regexp_replace(text, '{HEADING_RE}', '\\1\\2') AS text FROM (
  SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS para, unnest(s) AS text FROM ({para}) x
) y WHERE text <> ''"""
    q["export_lines"] = f"""
SELECT unnest(string_split(text, chr(10))) AS line FROM documents
WHERE regexp_matches(text, '{NONSPACE_RE}')"""
    q["doc_splits"] = f"SELECT doc_id, {_split_case('doc_id')} AS split FROM documents"
    q["dataset_info"] = f"""
SELECT {_split_case('doc_id')} AS split, count(*)::BIGINT AS n_rows, sum(length(text))::BIGINT AS n_chars,
       {_r('avg(length(text))')} AS avg_chars, max(length(text))::BIGINT AS max_chars
FROM documents GROUP BY 1"""
    q["prepared_train_scan"] = f"""
SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE {_split_case('doc_id')} = 'train'"""
    q["fetch_labeled"] = """
SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""
    q["parallel_pairs"] = f"WITH {PAIRS_CTE} SELECT conv_id, turn, source, target FROM pairs"
    q["parallel_reversed"] = f"WITH {PAIRS_CTE} SELECT conv_id, turn, target AS source, source AS target FROM pairs"
    q["bilingual_lines"] = f"""WITH {PAIRS_CTE}
SELECT conv_id, turn, 0::BIGINT AS side, source AS value FROM pairs
UNION ALL SELECT conv_id, turn, 1::BIGINT AS side, target AS value FROM pairs"""
    q["bilingual_export"] = f"""WITH {PAIRS_CTE},
v AS (SELECT source AS value FROM pairs UNION ALL SELECT target AS value FROM pairs)
SELECT unnest(string_split(value, chr(10))) AS line FROM v"""
    q["char_vocab"] = f"""WITH {ALPHA_CTE}
SELECT token, id::BIGINT AS id, 'special' AS kind FROM ({SPECIALS_SQL}) s
UNION ALL SELECT token, id, 'alphabet' AS kind FROM alpha"""
    q["char_pair_counts"] = f"""
WITH wc AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) w GROUP BY word),
ch AS (SELECT regexp_extract_all(word, '.') AS c, n FROM wc),
pi AS (SELECT c, n, unnest(range(1, len(c))) AS i FROM ch)
SELECT c[i] AS "left", c[i + 1] AS "right", sum(n)::BIGINT AS n FROM pi GROUP BY 1, 2"""
    q["bpe_vocab_small"] = f"""WITH RECURSIVE {BPE_CTE}
SELECT word AS token, n::BIGINT AS id,
       CASE WHEN n < 7 THEN 'special' WHEN n < 7 + (SELECT count(*) FROM alpha) THEN 'alphabet' ELSE 'merge' END AS kind
FROM fin WHERE kind = 1"""
    q["bpe_encode_small"] = f"""WITH RECURSIVE {BPE_CTE}, {_bpe_ids('SELECT doc_id, text FROM documents')}
SELECT doc_id, len(ids)::BIGINT AS n_ids, {_ints('ids')} AS ids_str FROM bpe"""
    lm_docs = f"SELECT doc_id, regexp_replace(text, '{HEADING_RE}', '\\1\\2') AS text FROM documents WHERE text <> ''"
    q["bpe_lm_batches_small"] = f"""WITH RECURSIVE {BPE_CTE}, {_bpe_ids(lm_docs)},
enc AS (SELECT doc_id, list_concat([6], ids, [5])[1:{MAX_LENGTH}] AS ids FROM bpe),
{LM_CTE[LM_CTE.index("idx AS ("):]}
SELECT doc_id, batch_id::BIGINT AS batch_id, slot::BIGINT AS slot, {_ints('ids')} AS ids_str, {_ints('mask')} AS mask_str
FROM pb"""
    q["encode_chars"] = f"WITH {LM_CTE} SELECT doc_id, len(ids)::BIGINT AS n_ids, {_ints('ids')} AS ids_str FROM enc"
    q["encode_unseen"] = f"""WITH {ALPHA_CTE},
e AS (SELECT c.conv_id, c.turn, {_char_ids('c.text')} AS ids FROM conversations c, amap)
SELECT conv_id, turn, len(ids)::BIGINT AS n_ids, len(list_filter(ids, lambda x: x = 0))::BIGINT AS n_unk,
       {_ints('ids')} AS ids_str FROM e"""
    web_ids = (f"list_transform(flatten(list_transform({_words('d.text')}, lambda w: regexp_extract_all(w, '.'))), "
               f"lambda c: wmap.m[c])")
    q["web_batches"] = f"""WITH tr AS (SELECT doc_id, text FROM documents WHERE {_split_case('doc_id')} = 'train'),
walpha AS (
  SELECT token, row_number() OVER (ORDER BY token)::BIGINT AS id FROM (
    SELECT DISTINCT unnest(regexp_extract_all({NORM.format('text')}, '{NONSPACE_RE}')) AS token FROM tr) a
),
wmap AS (SELECT map(list(token), list(id)) AS m, max(id) + 1 AS pad FROM walpha),
enc AS (SELECT d.doc_id, list_concat([0], {web_ids}, [0])[1:{MAX_LENGTH}] AS ids, wmap.pad FROM tr d, wmap),
idx AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) - 1 AS idx FROM enc),
b AS (SELECT *, idx // {BATCH_SIZE} AS batch_id, idx % {BATCH_SIZE} AS slot,
             max(len(ids)) OVER (PARTITION BY idx // {BATCH_SIZE}) AS L FROM idx)
SELECT doc_id, batch_id::BIGINT AS batch_id, slot::BIGINT AS slot,
  {_ints("list_concat(ids, list_transform(range(L - len(ids)), lambda x: pad))")} AS ids_str,
  {_ints("list_concat(list_transform(range(len(ids)), lambda x: 1), list_transform(range(L - len(ids)), lambda x: 0))")} AS mask_str
FROM b"""
    q["shuffle_batches"] = f"""
SELECT doc_id, idx::BIGINT AS idx, (idx // {BATCH_SIZE})::BIGINT AS batch_id, (idx % {BATCH_SIZE})::BIGINT AS slot
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) - 1 AS idx FROM documents) x"""
    q["lm_batches"] = f"""WITH {LM_CTE}
SELECT doc_id, batch_id::BIGINT AS batch_id, slot::BIGINT AS slot, len(raw)::BIGINT AS n_real,
       len(ids)::BIGINT AS padded_len, {_ints('ids')} AS ids_str, {_ints('mask')} AS mask_str FROM pb"""
    q["lm_collated"] = f"""WITH {LM_CTE}
SELECT batch_id::BIGINT AS batch_id, count(*)::BIGINT AS n_rows,
       array_to_string(list(doc_id ORDER BY slot), ' ') AS doc_ids, sum(len(ids))::BIGINT AS n_cells
FROM pb GROUP BY batch_id"""
    q["shifted_tokens"] = f"""WITH {LM_CTE},
sh AS (SELECT doc_id, batch_id, ids[2:] AS lab, mask[2:] AS lm FROM pb)
SELECT doc_id, batch_id::BIGINT AS batch_id, (generate_subscripts(lab, 1) - 1)::BIGINT AS pos,
       unnest(lab)::BIGINT AS label, unnest(lm)::BIGINT AS mask FROM sh"""
    q["scored_batches"] = f"""WITH {LM_CTE},
sh AS (SELECT batch_id, ids[2:] AS lab, mask[2:] AS lm FROM pb),
tk AS (SELECT batch_id, unnest(lab) AS label, unnest(lm) AS m FROM sh),
cnt AS (SELECT batch_id, label, count(*) AS c FROM tk WHERE m = 1 GROUP BY ALL),
tot AS (SELECT batch_id, sum(c) AS t FROM cnt GROUP BY ALL),
sc AS (SELECT tk.batch_id, CASE WHEN tk.m = 1 THEN -ln(cnt.c::DOUBLE / tot.t) ELSE 0.0 END AS loss, tk.m
       FROM tk LEFT JOIN cnt ON cnt.batch_id = tk.batch_id AND cnt.label = tk.label
       LEFT JOIN tot ON tot.batch_id = tk.batch_id)
SELECT batch_id::BIGINT AS batch_id, {_r('sum(loss * m) / nullif(sum(m), 0)')} AS batch_loss, sum(m)::BIGINT AS n_tokens
FROM sc GROUP BY batch_id"""
    sb = q["scored_batches"]
    q["lm_eval_loss"] = (sb[:sb.index("SELECT batch_id::BIGINT AS batch_id")] +
                         """, bl AS (SELECT batch_id, sum(loss * m) / nullif(sum(m), 0) AS batch_loss, sum(m) AS n_tokens
FROM sc GROUP BY batch_id)
SELECT """ + _r("avg(batch_loss)") + """ AS eval_loss,
       """ + _r("sum(batch_loss * n_tokens) / sum(CASE WHEN batch_loss IS NOT NULL THEN n_tokens END)") + """ AS token_weighted_loss,
       count(*)::BIGINT AS n_batches, """ + _r("exp(avg(batch_loss))") + """ AS perplexity FROM bl""")
    q["unpadded"] = f"""WITH {LM_CTE}
SELECT doc_id, len(raw)::BIGINT AS n_kept, (len(raw) - 1)::BIGINT AS last_pos, {_ints('raw')} AS kept_str FROM pb"""
    q["ids_to_tokens"] = f"""WITH {LM_CTE},
voc AS (SELECT map(list(id), list(token)) AS v FROM ({SPECIALS_SQL} UNION ALL SELECT token, id FROM alpha) u)
SELECT doc_id, array_to_string(list_transform(list_filter(raw, lambda x: x <> 5), lambda i: voc.v[i]), ' ') AS tokens
FROM pb, voc"""
    q["cadence_resume"] = f"""
SELECT batch_id::BIGINT AS batch_id, (batch_id * {BATCH_SIZE})::BIGINT AS step, count(*)::BIGINT AS n_rows FROM (
  SELECT (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) - 1) // {BATCH_SIZE} AS batch_id
  FROM documents) x
WHERE batch_id >= {RESUME_AT} AND batch_id % {EVAL_STEPS // BATCH_SIZE} = 0 GROUP BY batch_id"""
    q["mt_batches"] = f"""WITH {ALPHA_CTE}, {PAIRS_CTE},
e AS (
  SELECT p.conv_id, p.turn, ({_char_ids('p.source')})[1:{MAX_LENGTH}] AS s,
         list_concat([3], {_char_ids('p.target')}, [5])[1:{MAX_LENGTH}] AS t
  FROM pairs p, amap
),
ix AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || conv_id::VARCHAR || ':' || turn::VARCHAR), conv_id, turn) - 1 AS idx FROM e),
b AS (SELECT *, idx // {BATCH_SIZE} AS batch_id, idx % {BATCH_SIZE} AS slot,
             max(len(s)) OVER (PARTITION BY idx // {BATCH_SIZE}) AS ls, max(len(t)) OVER (PARTITION BY idx // {BATCH_SIZE}) AS lt FROM ix)
SELECT conv_id, turn, batch_id::BIGINT AS batch_id, slot::BIGINT AS slot,
  {_ints("list_concat(s, list_transform(range(ls - len(s)), lambda x: 1))")} AS source_str,
  {_ints("list_concat(list_transform(range(len(s)), lambda x: 1), list_transform(range(ls - len(s)), lambda x: 0))")} AS source_mask_str,
  {_ints("list_concat(t, list_transform(range(lt - len(t)), lambda x: 1))")} AS target_str,
  {_ints("list_concat(list_transform(range(len(t)), lambda x: 1), list_transform(range(lt - len(t)), lambda x: 0))")} AS target_mask_str
FROM b"""
    pe = (f"CASE WHEN d % 2 = 0 THEN sin(pos / pow(10000.0, d / {float(D_MODEL)})) "
          f"ELSE cos(pos / pow(10000.0, d / {float(D_MODEL)})) END")
    q["token_vectors"] = f"""WITH {LM_CTE},
tk AS (SELECT doc_id, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS token_id FROM enc),
j AS (SELECT tk.*, CAST(e.embedding AS DOUBLE[]) AS v FROM tk LEFT JOIN embeddings e ON e.vec_id = tk.token_id)
SELECT doc_id, pos::BIGINT AS pos, token_id::BIGINT AS token_id,
       {_r(f"list_sum(list_transform(range({D_MODEL}), lambda d: v[d + 1] + {pe}))")} AS checksum FROM j"""
    q["token_losses"] = f"""WITH {SCORED_CTE}
SELECT vec_id, {_r('loss')} AS loss, {_r('smooth_loss')} AS smooth_loss,
       (list_position(z, m) - 1)::BIGINT AS argmax, {_r('exp(m - lse)')} AS p_max FROM tl"""
    q["batch_losses"] = f"WITH {SCORED_CTE} SELECT batch_id::BIGINT AS batch_id, {_r('batch_loss')} AS batch_loss, n_tokens FROM bl"
    q["eval_loss"] = f"""WITH {SCORED_CTE}
SELECT {_r('avg(batch_loss)')} AS eval_loss,
       {_r('sum(batch_loss * n_tokens) / sum(CASE WHEN batch_loss IS NOT NULL THEN n_tokens END)')} AS token_weighted_loss,
       count(*)::BIGINT AS n_batches, sum(CASE WHEN batch_loss IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_empty_batches,
       {_r('exp(avg(batch_loss))')} AS perplexity FROM bl"""
    q["history"] = f"WITH {SCORED_CTE} SELECT epoch, step, {_r('loss')} AS loss, {_r('val_loss')} AS val_loss FROM hist"
    q["results"] = f"""WITH {SCORED_CTE}
SELECT {_r('arg_max(val_loss, step)')} AS val_loss, {_r('(SELECT eval_loss FROM ev)')} AS test_loss FROM hist"""
    tr_bp = f"""{ALPHA_CTE}, {PAIRS_CTE},
voc AS (SELECT map(list(id), list(token)) AS v FROM ({SPECIALS_SQL} UNION ALL SELECT token, id FROM alpha) u),
e AS (
  SELECT p.conv_id, p.turn, ({_char_ids('p.source')})[1:{MAX_LENGTH}] AS s,
         list_concat([3], {_char_ids('p.target')}, [5])[1:{MAX_LENGTH}] AS t
  FROM pairs p, amap
),
bp AS (
  SELECT (conv_id, turn) AS pair_id,
         list_transform(list_filter(list_concat([3], s)[1:{MAX_LENGTH}], lambda x: x <> 5), lambda i: voc.v[i]) AS hyp,
         list_transform(list_filter(t, lambda x: x <> 5), lambda i: voc.v[i]) AS ref
  FROM e, voc
)"""
    q["bleu_translation"] = _bleu_sql(tr_bp)
    q["bleu_conversations"] = _bleu_sql(_CONV_BP)
    q["bleu_sentence_stats"] = _bleu_stats_sql(_CONV_BP)
    q["bleu_documents"] = _bleu_sql(_DOC_BP)
    q["bleu_identity"] = _bleu_sql(_ID_BP)
    q["stream_prepared"] = f"""
SELECT doc_id, len({_words('text')})::BIGINT AS n_words, length({NORM.format('text')})::BIGINT AS norm_chars
FROM documents WHERE regexp_matches(text, '{NONSPACE_RE}')"""
    wb = q["web_batches"]
    nibble = "(strpos('0123456789ABCDEF', x[{}]) - 1)"
    q["web_byte_batches"] = f"""WITH tr AS (SELECT doc_id, text FROM documents WHERE {_split_case('doc_id')} = 'train'),
enc AS (SELECT doc_id, 257 AS pad, list_concat([0], list_transform(regexp_extract_all(hex(encode(text)), '..'),
        lambda x: {nibble.format(1)} * 16 + {nibble.format(2)} + 1), [0])[1:{MAX_LENGTH}] AS ids FROM tr),
{wb[wb.index("idx AS ("):]}"""
    split = _split_case("vec_id", _hex_threshold(EVAL_FRACTIONS[0]), _hex_threshold(sum(EVAL_FRACTIONS)))
    parted = SCORED_CTE[:SCORED_CTE.index("bl AS (")].replace("FROM embeddings", f", {split} AS split FROM embeddings", 1) + f"""
bl AS (SELECT split, batch_id, sum(loss * mask) / nullif(sum(mask), 0)::DOUBLE AS batch_loss,
              sum(smooth_loss * mask) / nullif(sum(mask), 0)::DOUBLE AS smooth_batch_loss FROM tl GROUP BY ALL),
ev AS (SELECT split, avg(batch_loss) AS eval_loss FROM bl GROUP BY split),
hist AS (SELECT 0::BIGINT AS epoch, (batch_id * {BATCH_SIZE})::BIGINT AS step, smooth_batch_loss AS loss,
                (SELECT eval_loss FROM ev WHERE split = 'validation') AS val_loss
         FROM bl WHERE split = 'train' AND batch_id % {EVAL_STEPS // BATCH_SIZE} = 0)"""
    q["split_results"] = f"""WITH {parted}
SELECT {_r('arg_max(val_loss, step)')} AS val_loss,
       {_r("(SELECT eval_loss FROM ev WHERE split = 'test')")} AS test_loss,
       (SELECT bleu FROM ({q["bleu_conversations"]}) b) AS test_bleu FROM hist"""
    q["history_records"] = f"WITH {parted} SELECT epoch, step, {_r('loss')} AS loss, {_r('val_loss')} AS val_loss FROM hist"
    q["resume_marker"] = f"""
SELECT batch_id::BIGINT AS batch_id, count(*)::BIGINT AS n_rows FROM (
  SELECT (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) - 1) // {BATCH_SIZE} AS batch_id
  FROM documents) x
WHERE batch_id >= {RESUME_AT + 1} GROUP BY batch_id"""
    q["encode_loaded"] = f"SELECT conv_id, turn, ids_str FROM ({q['encode_unseen']}) x"
    q["word_counts_of_files"] = f"""
SELECT word, count(*)::BIGINT AS n FROM (
  SELECT unnest({_words('text')}) AS word FROM documents WHERE regexp_matches(text, '{NONSPACE_RE}')) w GROUP BY word"""
    q["stream_encoded"] = f"""WITH {ALPHA_CTE},
e AS (SELECT d.doc_id, {_char_ids('d.text')} AS ids FROM documents d, amap WHERE regexp_matches(d.text, '{NONSPACE_RE}'))
SELECT doc_id, len(ids)::BIGINT AS n_ids, {_ints('ids')} AS ids_str FROM e"""
    q["specials_in_text"] = f"""WITH {ALPHA_CTE},
e AS (SELECT d.doc_id, list_concat([3], {_char_ids('d.text')}, [4], {_char_ids("'[mask]'")}, [5, 1]) AS ids
      FROM documents d, amap)
SELECT doc_id, len(ids)::BIGINT AS n_ids, {_ints('ids')} AS ids_str FROM e"""
    q["word_token_ids"] = f"""WITH {ALPHA_CTE}
SELECT w.word AS token, coalesce(v.id, 0)::BIGINT AS id
FROM (SELECT DISTINCT unnest({_words('text')}) AS word FROM documents) w
LEFT JOIN ({SPECIALS_SQL} UNION ALL SELECT token, id FROM alpha) v ON v.token = w.word"""
    q["edge_texts"] = f"""WITH e AS (
  SELECT doc_id, unnest([0, 1, 2, 3])::BIGINT AS form, unnest(['', ' ' || chr(9) || chr(10) || chr(160) || chr(8195),
         ' = = Title = =' || chr(10) || text, text]) AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, form, regexp_matches(text, '{NONSPACE_RE}')::BIGINT AS is_text, (text <> '')::BIGINT AS is_filled,
       regexp_replace(text, '{HEADING_RE}', '\\1\\2') AS text FROM e"""
    q["rows_by_position"] = """
SELECT row, doc_id, length(text)::BIGINT AS n_chars FROM (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, doc_id, text FROM documents) x
WHERE row IN (SELECT doc_id * 20 FROM documents)"""
    q["replaced_dataset"] = f"""WITH d AS (SELECT {_split_case('doc_id')} AS split, text FROM documents),
o AS (SELECT split, count(*)::BIGINT AS n_old, sum(length(text))::BIGINT AS c_old FROM d GROUP BY split),
n AS (SELECT split, count(*)::BIGINT AS n_new, sum(length({NORM.format('text')}))::BIGINT AS c_new FROM d
      WHERE regexp_matches(text, '{NONSPACE_RE}') GROUP BY split)
SELECT * FROM o LEFT JOIN n USING (split)"""
    as_of_parts = parted[:parted.index("ev AS (")].rstrip().rstrip(",")
    q["history_as_of"] = f"""WITH {as_of_parts},
tr AS (SELECT (batch_id * {BATCH_SIZE})::BIGINT AS step, smooth_batch_loss AS loss FROM bl WHERE split = 'train'),
va AS (SELECT (batch_id * {BATCH_SIZE})::BIGINT AS step, batch_loss AS val_loss FROM bl
       WHERE split = 'validation' AND batch_id % 3 = 1 AND batch_loss IS NOT NULL)
SELECT tr.step, {_r('loss')} AS loss, {_r('val_loss')} AS val_loss FROM tr ASOF LEFT JOIN va ON tr.step >= va.step"""
    q["dataset_columns"] = "\nUNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS name, '{t}' AS type, count(*)::BIGINT AS n_rows, "
        f"(count(*) - count({c}))::BIGINT AS n_nulls FROM documents"
        for i, (c, t) in enumerate((("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                                    ("n_chars", "bigint"))))
    q["stream_marked"] = f"""
SELECT doc_id, len({_words('text')})::BIGINT AS n_words, 1::BIGINT AS next_batch
FROM documents WHERE regexp_matches(text, '{NONSPACE_RE}')"""
    q["vocab_sizes"] = f"""WITH {ALPHA_CTE}
SELECT 'all' AS part, (count(*) + 7)::BIGINT AS vocab_size FROM alpha
UNION ALL SELECT 'alphabet', count(*)::BIGINT FROM alpha"""
    half = MAX_LENGTH // 2
    q["clipped_grown"] = f"""WITH {LM_CTE}
SELECT doc_id, {_ints(f'ids[1:{half}]')} AS clipped,
       {_ints(f"list_concat(ids[1:{half}], list_transform(range(16), lambda x: 1))")} AS grown FROM enc"""
    q["shifted_inputs"] = f"""WITH {LM_CTE}
SELECT doc_id, {_ints('ids[1:len(ids) - 1]')} AS input_str, {_ints('mask[1:len(mask) - 1]')} AS mask_str,
       {_ints('ids[2:]')} AS label_str FROM pb"""
    q["softmax_values"] = f"""WITH {SCORED_CTE}
SELECT vec_id, (generate_subscripts(z, 1) - 1)::BIGINT AS class, {_r('exp(unnest(z) - lse)')} AS p FROM tl"""
    return {k: v.strip() for k, v in q.items()}
