"""Oracle SQL (DuckDB dialect) for every SQL-checkable query.

Written independently of the Spark plans: plain SQL over the driver
tables. The only shared items are the fixed values (regex patterns,
template text, fixture constants) that both sides must agree on.
"""

from __future__ import annotations

from articlelab.functions.text import BOS, EOS, PROMPT_PARTS, SENTENCE_BOUNDARY, WORD_PATTERN, WS_CLASS
from articlelab.sources import tables as S

ORACLE: dict[str, str] = {}

WV_DIM = 8


def r6(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def sql_sentences(text: str, newlines: bool = True) -> str:
    t = f"replace({text}, chr(10), ' ')" if newlines else text
    return f"str_split(regexp_replace({t}, '{SENTENCE_BOUNDARY}', '\\1' || chr(1), 'g'), chr(1))"


def sql_words(s: str, lower: bool = True) -> str:
    w = f"regexp_extract_all({s}, '{WORD_PATTERN}')"
    return f"list_transform({w}, lambda w: lower(w))" if lower else w


def sql_sentence_tokens(text: str, lower: bool = True) -> str:
    per = f"list_transform({sql_sentences(text)}, lambda s: {sql_words('s', lower)})"
    return f"list_filter({per}, lambda l: len(l) > 0)"


def sql_flat_tokens(text: str, lower: bool = True) -> str:
    return f"flatten({sql_sentence_tokens(text, lower)})"


def sql_hash_vec_cols(token: str = "token", dim: int = WV_DIM) -> str:
    def block(i):
        return token if i < 8 else f"{token} || ':{i // 8}'"
    return ", ".join(
        f"(('0x' || substr(md5({block(i)}), {1 + 3 * (i % 8)}, 3))::INTEGER / 4095.0 - 0.5) AS v{i}"
        for i in range(dim))


def sql_has_vec(token: str = "token") -> str:
    return f"right(md5({token}), 1) <> '0'"


ORACLE["article_vectors"] = f"""
WITH d AS (SELECT doc_id, {sql_flat_tokens('text')} AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS token FROM d),
wv AS (SELECT token, {sql_hash_vec_cols()} FROM (SELECT DISTINCT token FROM t) WHERE {sql_has_vec()}),
s AS (SELECT t.doc_id, count(*) AS n_known,
             {", ".join(f"sum(v{i}) AS s{i}" for i in range(WV_DIM))}
      FROM t JOIN wv USING (token) GROUP BY t.doc_id)
SELECT d.doc_id, len(d.toks)::BIGINT AS n_tokens, coalesce(s.n_known, 0)::BIGINT AS n_known,
       {", ".join(r6(f"coalesce(s{i}, 0) / greatest(len(d.toks), 1)") + f" AS f{i}" for i in range(WV_DIM))}
FROM d LEFT JOIN s USING (doc_id)
"""


# --------------------------------------------------------------------------
# Fixture views as SQL
WS = WS_CLASS
ARTICLES = ("(SELECT doc_id, CASE quality WHEN 1 THEN 'human' ELSE 'gpt' END AS type, text "
            "FROM documents JOIN labels USING (doc_id))")
WIKIHOW = (f"(SELECT doc_id, '  ' || split_part(text, chr(10), 1) || '  ' || doc_id::VARCHAR AS title, "
           f"source AS headline, lang AS sectionLabel, "
           f"CASE WHEN doc_id % {S.WIKIHOW_NULL_EVERY} = 0 THEN NULL ELSE text END AS text FROM documents)")
DIRTY = (f"(SELECT doc_id, lang AS type, CASE WHEN doc_id % {S.DIRTY_NULL_EVERY} = 0 THEN NULL "
         f"WHEN doc_id % {S.DIRTY_BLANK_EVERY} = 0 THEN ' ' || chr(9) || ' ' ELSE text END AS text FROM documents)")
FEATURES = (f"(SELECT vec_id, label, CASE WHEN vec_id % {S.TEST_EVERY} = 0 THEN 'test' ELSE 'train' END AS split, "
            f"embedding FROM embeddings)")


def shuffle_key(id_expr: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || ({id_expr})::VARCHAR)"


WIKI_CLEAN = f"""(
  SELECT doc_id, original_row_number,
         regexp_replace(regexp_replace(regexp_replace(title, '^[{WS}]+|[{WS}]+$', '', 'g'),
                        '[{WS}]+', ' ', 'g'), '\\p{{Nd}}+$', '') AS title,
         headline, sectionLabel, wc::VARCHAR || ' words' AS length
  FROM (SELECT *, len(regexp_extract_all(text, '[^{WS}]+')) AS wc
        FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS original_row_number
              FROM {WIKIHOW} WHERE text IS NOT NULL))
  WHERE wc >= 40)"""

ORACLE["wikihow_subset"] = f"""
SELECT doc_id, original_row_number::BIGINT AS original_row_number, title, headline, sectionLabel, length
FROM (SELECT *, row_number() OVER (ORDER BY {shuffle_key('doc_id')}, doc_id) AS rn FROM {WIKI_CLEAN})
WHERE rn <= 200
"""

_P = [p.replace("'", "''") for p in PROMPT_PARTS]
ORACLE["prompt_queries"] = f"""
SELECT doc_id, '{_P[0]}' || title || '{_P[1]}' || length || '{_P[2]}' || headline || '{_P[3]}'
       || sectionLabel || '{_P[4]}' AS query
FROM {WIKI_CLEAN}
"""

ORACLE["type_counts"] = f"SELECT type, count(*)::BIGINT AS n FROM {ARTICLES} GROUP BY type"

ORACLE["conditional_counts"] = f"""
SELECT count(*)::BIGINT AS n_articles, count(*) FILTER (WHERE type = 'gpt')::BIGINT AS n_gpt,
       count(*) FILTER (WHERE type = 'human')::BIGINT AS n_human, count(DISTINCT type)::BIGINT AS n_types
FROM {ARTICLES}
"""

ORACLE["class_index"] = f"""
WITH m AS (SELECT type, (row_number() OVER (ORDER BY type) - 1)::BIGINT AS label
           FROM (SELECT DISTINCT type FROM {ARTICLES}))
SELECT doc_id, type, label FROM {ARTICLES} JOIN m USING (type)
"""

ORACLE["relabel_dense"] = f"""
WITH f AS (SELECT vec_id, split, (label * 3 + 1)::BIGINT AS raw_label FROM {FEATURES}),
m AS (SELECT raw_label, (row_number() OVER (ORDER BY raw_label) - 1)::BIGINT AS label
      FROM (SELECT DISTINCT raw_label FROM f))
SELECT vec_id, split, raw_label, label FROM f JOIN m USING (raw_label)
"""

ORACLE["unmapped_types"] = """
SELECT lang AS type, count(*)::BIGINT AS n FROM documents
WHERE lang NOT IN ('en', 'fr') GROUP BY lang
"""

ORACLE["shuffle_head"] = f"""
SELECT doc_id, rn::BIGINT AS row_no
FROM (SELECT doc_id, row_number() OVER (ORDER BY {shuffle_key('doc_id')}, doc_id) AS rn FROM documents)
WHERE rn <= 100
"""

ORACLE["train_test_split"] = f"""
SELECT doc_id, rn::BIGINT AS row_no,
       CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {shuffle_key('doc_id')}, doc_id) AS rn,
             count(*) OVER () AS n FROM documents)
"""

ORACLE["stratified_sample"] = f"""
SELECT doc_id, type, rn::BIGINT AS row_no
FROM (SELECT doc_id, type, row_number() OVER (PARTITION BY type ORDER BY {shuffle_key('doc_id')}, doc_id) AS rn
      FROM {ARTICLES} WHERE type IN ('human', 'gpt'))
WHERE rn <= 50
"""

BATCHED = """(SELECT doc_id, rn::BIGINT AS row_no, ((rn - 1) // 64)::BIGINT AS batch_no,
                     ceil(n / 64)::BIGINT AS n_batches
              FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n
                    FROM documents))"""

ORACLE["batch_slices"] = f"SELECT doc_id, row_no, batch_no, n_batches FROM {BATCHED}"

ORACLE["resume_pending"] = f"SELECT doc_id, batch_no FROM {BATCHED} WHERE batch_no NOT IN (0, 1, 2)"

ORACLE["blank_null_filter"] = f"""
SELECT doc_id, type, md5(text) AS text_md5 FROM {DIRTY}
WHERE text IS NOT NULL AND regexp_matches(text, '[^{WS}]')
"""

ORACLE["literal_type"] = f"""
SELECT doc_id, 'llama' AS type, length(text)::BIGINT AS n_chars FROM {DIRTY}
WHERE text IS NOT NULL AND regexp_matches(text, '[^{WS}]')
"""


# --------------------------------------------------------------------------
# Tokens, vocabulary, pooling, importance
def _joined(st: str) -> str:
    return f"array_to_string(list_transform({st}, lambda s: array_to_string(s, ' ')), chr(10))"


ORACLE["sentence_tokens"] = f"""
SELECT doc_id, len(st)::BIGINT AS n_sentences, len(flatten(st))::BIGINT AS n_tokens, md5({_joined('st')}) AS tokens_md5
FROM (SELECT doc_id, {sql_sentence_tokens('text')} AS st FROM documents)
"""

ORACLE["contraction_fix"] = f"""
SELECT conv_id, turn, len(t)::BIGINT AS n_tokens,
       ((length(j) - length(replace(j, ' n''t ', ''))) // 5)::BIGINT AS n_contractions,
       md5(replace(j, ' n''t ', 'n ''t ')) AS fixed_md5
FROM (SELECT conv_id, turn, t, array_to_string(t, ' ') AS j
      FROM (SELECT conv_id, turn, {sql_flat_tokens('text', lower=False)} AS t FROM conversations))
"""

ORACLE["boundary_tokens"] = f"""
SELECT conv_id, turn, len(w)::BIGINT AS n_sentences, len(flatten(w))::BIGINT AS n_tokens, md5({_joined('w')}) AS tokens_md5
FROM (SELECT conv_id, turn, list_transform({sql_sentence_tokens('text')}, lambda s: ['{BOS}'] || s || ['{EOS}']) AS w
      FROM conversations)
"""


def vocab_sql(table: str, lower: bool = True) -> str:
    return (f"(SELECT DISTINCT token FROM (SELECT unnest({sql_flat_tokens('text', lower)}) AS token FROM {table} "
            f"UNION ALL SELECT '{BOS}' UNION ALL SELECT '{EOS}'))")


ORACLE["vocabulary"] = f"SELECT token FROM {vocab_sql('documents')}"

ORACLE["vocab_update"] = f"""
WITH known AS (SELECT token FROM {vocab_sql('benchmark')} WHERE {sql_has_vec()}),
fresh AS (SELECT token FROM {vocab_sql('documents')} WHERE {sql_has_vec()} AND token NOT IN (SELECT token FROM known))
SELECT token, 'known' AS origin FROM known UNION ALL SELECT token, 'new' AS origin FROM fresh
"""

ORACLE["first_k_vectors"] = f"""
SELECT token, rn::BIGINT AS row_no
FROM (SELECT token, row_number() OVER (ORDER BY md5(token), token) AS rn
      FROM {vocab_sql('documents')} WHERE {sql_has_vec()})
WHERE rn <= 1000 OR token IN ('{BOS}', '{EOS}')
"""

BENCH_KEPT = f"""(
  SELECT item_id, sent_no, n_words, CASE WHEN len(k) > 0 THEN k ELSE ['{EOS}'] END AS kept
  FROM (SELECT item_id, sent_no, len(w) AS n_words, list_filter(w, lambda x: right(md5(x), 1) <> '0') AS k
        FROM (SELECT item_id, generate_subscripts(st, 1) - 1 AS sent_no, ['{BOS}'] || unnest(st) || ['{EOS}'] AS w
              FROM (SELECT item_id, {sql_sentence_tokens('text', lower=False)} AS st FROM benchmark))))"""

ORACLE["oov_fallback"] = f"""
SELECT item_id, sent_no::BIGINT AS sent_no, n_words::BIGINT AS n_words, len(kept)::BIGINT AS n_kept,
       md5(array_to_string(kept, ' ')) AS kept_md5
FROM {BENCH_KEPT}
"""

ORACLE["vocab_coverage"] = f"""
SELECT sum(n_words)::BIGINT AS n_words, sum(len(kept))::BIGINT AS n_kept,
       {r6('sum(len(kept)) * 100.0 / sum(n_words)')} AS pct
FROM {BENCH_KEPT}
"""

_VEC_LIST = "[" + ", ".join(f"('0x' || substr(md5(token), {1 + 3 * i}, 3))::INTEGER / 4095.0 - 0.5"
                            for i in range(WV_DIM)) + "]"

ORACLE["word_importance"] = f"""
WITH t AS (SELECT item_id, ['{BOS}'] || {sql_words('text', lower=False)} || ['{EOS}'] AS w FROM benchmark),
e AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM t),
k AS (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS tok_no
      FROM e WHERE {sql_has_vec()}),
v AS (SELECT item_id, tok_no, unnest({_VEC_LIST}) AS val, unnest(range({WV_DIM})) AS dim FROM k),
win AS (SELECT item_id, tok_no FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id, dim ORDER BY val DESC, tok_no) AS rn FROM v)
        WHERE rn = 1),
cnt AS (SELECT item_id, tok_no, count(*) AS n FROM win GROUP BY item_id, tok_no)
SELECT k.item_id, k.tok_no::BIGINT AS tok_no, k.token, coalesce(cnt.n, 0)::BIGINT AS n,
       {r6(f'coalesce(cnt.n, 0) * 100.0 / {WV_DIM}')} AS pct
FROM k LEFT JOIN cnt USING (item_id, tok_no)
"""


def conv_pool_sql(agg: str) -> str:
    return f"""
WITH s AS (SELECT conv_id, turn, generate_subscripts(st, 1) AS sent_no, unnest(st) AS toks
           FROM (SELECT conv_id, turn, {sql_sentence_tokens('text')} AS st FROM conversations)),
t AS (SELECT conv_id, turn, sent_no, unnest(toks) AS token FROM s),
wv AS (SELECT token, {sql_hash_vec_cols()} FROM (SELECT DISTINCT token FROM t) WHERE {sql_has_vec()}),
sv AS (SELECT conv_id, turn, sent_no, {", ".join(f"{agg}(v{i}) AS a{i}" for i in range(WV_DIM))}
       FROM t JOIN wv USING (token) GROUP BY conv_id, turn, sent_no),
dv AS (SELECT conv_id, turn, count(*) AS n_sentences, {", ".join(f"avg(a{i}) AS m{i}" for i in range(WV_DIM))}
       FROM sv GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, coalesce(dv.n_sentences, 0)::BIGINT AS n_sentences,
       {", ".join(r6(f"coalesce(m{i}, 0)") + f" AS f{i}" for i in range(WV_DIM))}
FROM conversations c LEFT JOIN dv USING (conv_id, turn)
"""


ORACLE["sentence_mean_vectors"] = conv_pool_sql("avg")
ORACLE["max_pool"] = conv_pool_sql("max")


# --------------------------------------------------------------------------
# Metrics over stored scores and run records
SCORES = f"""(SELECT vec_id, label, CASE WHEN vec_id % {S.TEST_EVERY} = 0 THEN 'test' ELSE 'train' END AS split,
       ((row_number() OVER (PARTITION BY vec_id % {S.TEST_EVERY} = 0, e ORDER BY vec_id) - 1) // {S.EVAL_BATCH})::BIGINT AS batch_id, e::BIGINT AS epoch,
       list_transform(list_concat(embedding, embedding)[(e - 1) * 10 + 1 : e * 10], lambda x: x::DOUBLE) AS logits
  FROM embeddings CROSS JOIN range(1, {S.SCORE_EPOCHS + 1}) AS t(e))"""

SCORED = f"""(SELECT *, list_position(logits, m) - 1 AS pred,
       ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) + m - logits[label + 1] AS loss,
       1.0 / list_sum(list_transform(logits, lambda x: exp(x - m))) AS p_max
  FROM (SELECT *, list_max(logits) AS m FROM {SCORES}))"""

BATCHES = f"""(SELECT split, epoch, batch_id, count(*) AS n,
       sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS correct, sum(loss) AS sum_loss, avg(loss) AS mean_loss
  FROM {SCORED} GROUP BY split, epoch, batch_id)"""

EPOCHS = f"""(SELECT split, epoch, sum(n) AS n, sum(correct) AS correct, sum(correct) / sum(n) AS accuracy,
       avg(mean_loss) AS loss, sum(sum_loss) / sum(n) AS row_loss
  FROM {BATCHES} GROUP BY split, epoch)"""

CONF = f"""(SELECT split, epoch, label::BIGINT AS true_label, pred::BIGINT AS pred_label, count(*)::BIGINT AS n
  FROM {SCORED} GROUP BY split, epoch, label, pred)"""

ORACLE["predictions"] = f"""
SELECT vec_id, epoch, split, label::BIGINT AS label, pred::BIGINT AS pred, {r6('p_max')} AS p_max FROM {SCORED}
"""

ORACLE["epoch_metrics"] = f"""
SELECT split, epoch, n::BIGINT AS n, correct::BIGINT AS correct, {r6('accuracy')} AS accuracy,
       {r6('loss')} AS loss, {r6('row_loss')} AS row_loss FROM {EPOCHS}
"""

ORACLE["batch_mean_loss"] = f"""
SELECT split, epoch, batch_id, n::BIGINT AS n, {r6('mean_loss')} AS mean_loss FROM {BATCHES}
"""

ORACLE["confusion_long"] = f"SELECT * FROM {CONF}"

ORACLE["confusion_dense"] = f"""
WITH c AS {CONF},
l AS (SELECT DISTINCT x FROM (SELECT true_label AS x FROM c UNION ALL SELECT pred_label FROM c)),
k AS (SELECT DISTINCT split, epoch FROM c)
SELECT k.split, k.epoch, a.x AS true_label, b.x AS pred_label, coalesce(c.n, 0)::BIGINT AS n
FROM k CROSS JOIN l AS a CROSS JOIN l AS b
LEFT JOIN c ON c.split = k.split AND c.epoch = k.epoch AND c.true_label = a.x AND c.pred_label = b.x
"""

ORACLE["confusion_at_epoch"] = f"""
SELECT split, epoch, true_label, pred_label, n
FROM (SELECT *, max(epoch) OVER (PARTITION BY split) AS last FROM {CONF})
WHERE epoch = least(5, last)
"""

ORACLE["weighted_f1_by_epoch"] = f"""
WITH c AS {CONF},
r AS (SELECT split, epoch, true_label AS cl, n AS sup, 0 AS prd, CASE WHEN true_label = pred_label THEN n ELSE 0 END AS tp FROM c
      UNION ALL SELECT split, epoch, pred_label, 0, n, 0 FROM c),
pc AS (SELECT split, epoch, cl, sum(sup) AS sup, sum(prd) AS prd, sum(tp) AS tp FROM r GROUP BY split, epoch, cl)
SELECT split, epoch,
       {r6('sum(CASE WHEN sup + prd > 0 THEN 2.0 * tp / (sup + prd) ELSE 0 END * sup) / sum(sup)')} AS f1,
       sum(sup)::BIGINT AS n
FROM pc GROUP BY split, epoch
"""

ORACLE["final_metrics"] = f"""
SELECT split, max(epoch) AS epoch, {r6('arg_max(accuracy, epoch)')} AS accuracy, {r6('arg_max(loss, epoch)')} AS loss
FROM {EPOCHS} GROUP BY split
"""

PAGE_PATHS = r"""(SELECT page_id, '/runs/' || regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1) || '/'
       || replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '_') || '.csv' AS path FROM pages)"""

ORACLE["run_names"] = rf"""
SELECT page_id, path,
       CASE WHEN ok THEN regexp_extract(base, '^(\w+)_(\w+)', 2) END AS ds_name,
       CASE WHEN ok THEN regexp_extract(base, '^(\w+)_(\w+)', 1) END AS embedder_name,
       ok AS matched,
       CASE WHEN ok THEN lower(regexp_extract(base, '^(\w+)_(\w+)', 2) || '_' || regexp_extract(base, '^(\w+)_(\w+)', 1)
                               || '_simplemlp') || '.json' END AS run_id
FROM (SELECT *, regexp_matches(base, '^(\w+)_(\w+)') AS ok
      FROM (SELECT page_id, path, split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1) AS base FROM {PAGE_PATHS}))
"""

RUNS = f"""(SELECT CASE WHEN epoch = 6 AND batch_id = 0 THEN 'W2V' || epoch ELSE 'W2V' || epoch || '_' || split END
              AS embedder_name, epoch, split, batch_id,
            CASE WHEN epoch = 3 AND split = 'test' AND batch_id = 0 THEN NULL ELSE correct / n END AS accuracy,
            mean_loss AS loss FROM {BATCHES})"""


def _emb_type(name: str) -> str:
    return f"lower(split_part({name}, '_', 1))"


def _cls_type(name: str) -> str:
    return (f"lower(CASE WHEN strpos({name}, '_') > 0 THEN substr({name}, strpos({name}, '_') + 1) "
            f"ELSE 'unknown' END)")


ORACLE["embedder_parts"] = f"""
SELECT embedder_name, {_emb_type('embedder_name')} AS embedding_type, {_cls_type('embedder_name')} AS class_type
FROM (SELECT DISTINCT embedder_name FROM {RUNS})
"""

ORACLE["missing_metrics"] = f"""
SELECT embedder_name, epoch, split, batch_id,
       ((accuracy IS NULL)::INT + (loss IS NULL)::INT)::BIGINT AS n_missing,
       concat_ws(',', CASE WHEN accuracy IS NULL THEN 'accuracy' END, CASE WHEN loss IS NULL THEN 'loss' END) AS missing
FROM {RUNS}
"""

VALID_RUNS = f"""(SELECT *, {_emb_type('embedder_name')} AS embedding_type, {_cls_type('embedder_name')} AS class_type
  FROM {RUNS} WHERE accuracy IS NOT NULL AND loss IS NOT NULL)"""

ORACLE["accuracy_by_embedding"] = f"""
SELECT embedding_type, class_type, {r6('avg(accuracy)')} AS mean_accuracy, count(accuracy)::BIGINT AS n_runs,
       {r6('stddev_samp(accuracy)')} AS std_accuracy
FROM {VALID_RUNS} GROUP BY embedding_type, class_type
"""

ORACLE["boost_accuracy_by_embedding"] = f"""
SELECT embedding_type, {r6('avg(accuracy)')} AS mean_accuracy, count(accuracy)::BIGINT AS n_runs,
       {r6('stddev_samp(accuracy)')} AS std_accuracy
FROM {VALID_RUNS} GROUP BY embedding_type
"""

ORACLE["runs_json_roundtrip"] = f"""
SELECT c.split, c.epoch, c.true_label, c.pred_label, c.n, {r6('e.accuracy')} AS accuracy
FROM {CONF} AS c JOIN {EPOCHS} AS e USING (split, epoch)
"""


# --------------------------------------------------------------------------
# Images and the embedded table
UNIT = """(SELECT vec_id, lo, hi, CASE WHEN hi > lo THEN list_transform(v, lambda x: (x - lo) / (hi - lo)) END AS u
  FROM (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi
        FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)))"""


def _image_stats_sql(side: int) -> str:
    return (f"len(p)::BIGINT AS n_pixels, {r6('list_sum(p) / len(p) / 255.0')} AS pix_mean, "
            f"{r6(f'list_sum(list_transform(range({side}), lambda i: p[i * {side} + i + 1])) / {side} / 255.0')} AS trace_mean, "
            f"{r6('list_max(p) / 255.0')} AS pix_max")


def _outer(u: str) -> str:
    return f"flatten(list_transform({u}, lambda a: list_transform({u}, lambda b: a * b * 255.0)))"


ORACLE["minmax_outer"] = f"""
SELECT vec_id, {r6('lo')} AS vmin, {r6('hi')} AS vmax, {_image_stats_sql(64)}
FROM (SELECT vec_id, lo, hi, {_outer('u')} AS p FROM {UNIT})
"""

# linear resampling from 64 to 100 points with half-pixel centres: point i sits at
# (i + 0.5) * 64 / 100 - 0.5, held inside 0..63, between its two neighbours
_AT = "greatest(0.0, least(63.0, (i + 0.5) * 64.0 / 100.0 - 0.5))"
_RESAMPLED = (f"list_transform(range(100), lambda i: u[floor({_AT})::INT + 1] * (1 - ({_AT} - floor({_AT}))) "
              f"+ u[least(floor({_AT})::INT + 1, 63) + 1] * ({_AT} - floor({_AT})))")
RESIZED = f"(SELECT vec_id, {_outer('r')} AS p FROM (SELECT vec_id, {_RESAMPLED} AS r FROM {UNIT}))"

ORACLE["resize_image"] = f"SELECT vec_id, {_image_stats_sql(100)} FROM {RESIZED}"

ORACLE["normalise_image"] = f"""
SELECT vec_id, {r6('list_sum(q) / len(q)')} AS mean, {r6('list_min(q)')} AS min, {r6('list_max(q)')} AS max
FROM (SELECT vec_id, list_transform(p, lambda x: (x / 255.0 - 0.5) / 0.5) AS q FROM {RESIZED})
"""

EMBEDDED = f"""
WITH a AS {ARTICLES},
sp AS (SELECT doc_id, type, text, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
       FROM (SELECT *, row_number() OVER (ORDER BY {shuffle_key('doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM a)),
d AS (SELECT doc_id, split, type, {sql_flat_tokens('text')} AS toks FROM sp),
t AS (SELECT doc_id, split, unnest(toks) AS token FROM d),
wv AS (SELECT token, {sql_hash_vec_cols()} FROM (SELECT DISTINCT token FROM t WHERE split = 'train') WHERE {sql_has_vec()}),
s AS (SELECT t.doc_id, {", ".join(f"sum(v{i}) AS s{i}" for i in range(WV_DIM))} FROM t JOIN wv USING (token) GROUP BY t.doc_id),
m AS (SELECT type, (row_number() OVER (ORDER BY type) - 1)::BIGINT AS label FROM (SELECT DISTINCT type FROM a)),
e AS (SELECT d.doc_id, d.split, m.label, len(d.toks) AS nt, {", ".join(f"coalesce(s{i}, 0) AS s{i}" for i in range(WV_DIM))}
      FROM d JOIN m USING (type) LEFT JOIN s USING (doc_id))
"""

ORACLE["embedded_table"] = EMBEDDED + f"""
SELECT doc_id, split, label, {", ".join(r6(f"s{i} / greatest(nt, 1)") + f" AS f{i}" for i in range(WV_DIM))} FROM e
"""

ORACLE["feature_metadata"] = EMBEDDED + f"""
SELECT split, {WV_DIM}::BIGINT AS min_width, {WV_DIM}::BIGINT AS max_width, count(DISTINCT label)::BIGINT AS n_classes,
       count(*)::BIGINT AS n_rows FROM e GROUP BY split
"""


# --------------------------------------------------------------------------
# Sinks read back by the sources
ORACLE["embedded_csv_roundtrip"] = ORACLE["embedded_table"]
ORACLE["runs_json_files"] = ORACLE["runs_json_roundtrip"]
ORACLE["batched_vectors"] = f"""
WITH v AS ({ORACLE["article_vectors"]}),
b AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::BIGINT AS batch_no FROM documents)
SELECT v.doc_id, b.batch_no, v.n_tokens, {", ".join(f"v.f{i}" for i in range(WV_DIM))}
FROM v JOIN b USING (doc_id)
"""


# --------------------------------------------------------------------------
# Wide vectors, over-budget joins, job ends, trainer steps
WIDE = 200


def _wide_summary(prefix: str, n: str | None = None) -> str:
    def of(i):
        return f"coalesce({prefix}{i}, 0)" + (f" / {n}" if n else "")
    every = " + ".join(of(i) for i in range(WIDE))
    return (", ".join(f"{r6(of(i))} AS f{i}" for i in (0, 63, 128, 199)) + f", {r6(every)} AS total")


ORACLE["wide_article_vectors"] = f"""
WITH d AS (SELECT doc_id, coalesce({sql_flat_tokens('text')}, []) AS toks FROM {DIRTY}),
t AS (SELECT doc_id, unnest(toks) AS token FROM d),
wv AS (SELECT token, {sql_hash_vec_cols(dim=WIDE)} FROM (SELECT DISTINCT token FROM t) WHERE {sql_has_vec()}),
s AS (SELECT t.doc_id, count(*) AS n_known, {", ".join(f"sum(v{i}) AS s{i}" for i in range(WIDE))}
      FROM t JOIN wv USING (token) GROUP BY t.doc_id)
SELECT d.doc_id, len(d.toks)::BIGINT AS n_tokens, coalesce(s.n_known, 0)::BIGINT AS n_known, {_wide_summary("s", "greatest(len(d.toks), 1)")}
FROM d LEFT JOIN s USING (doc_id)
"""


def _wide_sentences(agg: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce({sql_sentence_tokens('text')}, []) AS sents FROM {DIRTY}),
q AS (SELECT doc_id, unnest(range(1, len(sents) + 1)) AS k, sents FROM d),
t AS (SELECT doc_id, k, unnest(sents[k]) AS token FROM q),
wv AS (SELECT token, {sql_hash_vec_cols(dim=WIDE)} FROM (SELECT DISTINCT token FROM t) WHERE {sql_has_vec()}),
p AS (SELECT doc_id, k, {", ".join(f"{agg}(v{i}) AS p{i}" for i in range(WIDE))} FROM t JOIN wv USING (token) GROUP BY doc_id, k),
s AS (SELECT doc_id, count(*) AS n, {", ".join(f"avg(p{i}) AS s{i}" for i in range(WIDE))} FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_sentences, {_wide_summary("s")} FROM d LEFT JOIN s USING (doc_id)
"""


ORACLE["wide_sentence_vectors"] = _wide_sentences("avg")
ORACLE["wide_sentence_max"] = _wide_sentences("max")
ORACLE["article_vectors_cold"] = ORACLE["article_vectors"]
ORACLE["incremental_embed"] = ORACLE["article_vectors"]

ORACLE["csv_batches_resume"] = f"""
WITH r AS (SELECT type, text, row_number() OVER (ORDER BY doc_id) - 1 AS file_row FROM {DIRTY}),
a AS (SELECT *, (file_row // 64)::BIGINT AS batch_no FROM r WHERE text IS NOT NULL AND regexp_matches(text, '[^{WS}]')),
m AS (SELECT type, (row_number() OVER (ORDER BY type) - 1)::BIGINT AS label FROM (SELECT DISTINCT type FROM a)),
d AS (SELECT file_row, batch_no, label, {sql_flat_tokens('text')} AS toks FROM a JOIN m USING (type)),
t AS (SELECT file_row, unnest(toks) AS token FROM d),
wv AS (SELECT token, {sql_hash_vec_cols()} FROM (SELECT DISTINCT token FROM t) WHERE {sql_has_vec()}),
s AS (SELECT t.file_row, {", ".join(f"sum(v{i}) AS s{i}" for i in range(WV_DIM))} FROM t JOIN wv USING (token) GROUP BY t.file_row)
SELECT d.file_row, d.batch_no, d.label,
       {", ".join(r6(f"coalesce(s{i}, 0) / greatest(len(d.toks), 1)") + f" AS f{i}" for i in range(WV_DIM))}
FROM d LEFT JOIN s USING (file_row)
"""

ORACLE["split_first_rows"] = f"""
SELECT doc_id, CASE WHEN rn <= floor(300 * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {shuffle_key('doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 300
"""

ORACLE["many_classes"] = """
WITH r AS (SELECT l_orderkey, l_linenumber, 'c' || l_orderkey || '-' || l_linenumber AS type FROM lineitem),
m AS (SELECT type, (row_number() OVER (ORDER BY type) - 1)::BIGINT AS label FROM (SELECT DISTINCT type FROM r))
SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, label FROM r JOIN m USING (type)
"""

_SENT = f"""(SELECT doc_id, k, sents[k] AS toks FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1)) AS k
  FROM (SELECT doc_id, {sql_sentence_tokens('text')} AS sents FROM documents)))"""
ORACLE["user_encoder"] = f"""
WITH w AS (SELECT doc_id, k, unnest(toks) AS word FROM {_SENT}),
h AS (SELECT doc_id, k, ('0x' || substr(md5(word), 1, 7))::BIGINT % 16 AS dim,
        sum(CASE WHEN ('0x' || substr(md5(word), 32, 1))::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM w GROUP BY ALL),
n AS (SELECT doc_id, k, sqrt(sum(v * v)) AS norm FROM h GROUP BY doc_id, k),
c AS (SELECT doc_id, count(*) AS sentences FROM n GROUP BY doc_id),
f AS (SELECT doc_id, dim, sum(CASE WHEN norm > 0 THEN v / norm ELSE 0 END) AS v FROM h JOIN n USING (doc_id, k) GROUP BY doc_id, dim)
SELECT d.doc_id, {", ".join(r6(f"coalesce(max(CASE WHEN dim = {i} THEN v END), 0) / greatest(coalesce(max(c.sentences), 0), 1)") + f" AS f{i}" for i in range(16))}
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
"""

ORACLE["word2vec_train"] = f"""
SELECT doc_id, len(toks)::BIGINT AS n_tokens, 100::BIGINT AS width, true AS finite, len(toks) > 0 AS learnt
FROM (SELECT doc_id, {sql_flat_tokens('text')} AS toks FROM documents)
"""

_TRAIN = f"(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM {FEATURES} WHERE split = 'train')"
ORACLE["gradient_step"] = f"""
WITH t AS (SELECT label, unnest(x) AS v, unnest(range(64)) AS feature FROM {_TRAIN})
SELECT feature::BIGINT AS feature, k::BIGINT AS class, {r6("avg(v * (0.1 - CASE WHEN label = k THEN 1 ELSE 0 END))")} AS gradient
FROM t CROSS JOIN range(10) AS c(k) GROUP BY feature, k
"""

ORACLE["boosting_round"] = f"""
WITH t AS (SELECT label, unnest(x) AS v, unnest(range(64)) AS f FROM {_TRAIN}),
cuts(s, cut) AS (VALUES (0, -0.1), (1, 0.0), (2, 0.1)),
g AS (SELECT f, s, cut, label, count(*) FILTER (WHERE v <= cut) AS l, count(*) FILTER (WHERE v > cut) AS r FROM t CROSS JOIN cuts GROUP BY ALL),
i AS (SELECT f, s, cut, sum(l) AS nl, sum(r) AS nr, sum(l * l) AS l2, sum(r * r) AS r2, max(l) AS ml, max(r) AS mr,
        arg_max(label, (l, -label)) AS lc, arg_max(label, (r, -label)) AS rc FROM g GROUP BY f, s, cut),
b AS (SELECT *, 1 - (l2 / nl + r2 / nr) / (nl + nr) AS impurity FROM i WHERE nl > 0 AND nr > 0 ORDER BY round(impurity, 12), f, s LIMIT 1)
SELECT f::BIGINT AS feature, cut::DOUBLE AS threshold, lc::BIGINT AS left_class, rc::BIGINT AS right_class,
       {r6("(nl + nr - ml - mr) / (nl + nr)")} AS error FROM b
"""

ORACLE["boosting_vote"] = f"""
WITH f AS (SELECT vec_id, embedding AS x FROM {FEATURES}),
p AS (SELECT vec_id, CASE WHEN x[1]::DOUBLE <= 0.0 THEN 1 ELSE 2 END AS a, CASE WHEN x[6]::DOUBLE <= 0.05 THEN 2 ELSE 0 END AS b,
        CASE WHEN x[64]::DOUBLE <= -0.05 THEN 0 ELSE 1 END AS c FROM f),
v AS (SELECT vec_id, [1.5 * (a = k)::INT + 1.0 * (b = k)::INT + 0.75 * (c = k)::INT FOR k IN [0, 1, 2]] AS votes FROM p)
SELECT vec_id, (list_position(votes, list_max(votes)) - 1)::BIGINT AS pred FROM v
"""

ORACLE["run_files_many"] = f"""
WITH r AS {RUNS},
b AS (SELECT split_part(lower(embedder_name), '_', 1) AS embedding_type, accuracy FROM r),
a AS (SELECT embedding_type, avg(accuracy) AS mean_accuracy, count(*) AS n_runs FROM b WHERE accuracy IS NOT NULL GROUP BY embedding_type)
SELECT embedding_type AS what, {r6('mean_accuracy')} AS mean_accuracy, n_runs::BIGINT AS n FROM a
UNION ALL SELECT 'quarantine:accuracy', NULL, count(*)::BIGINT FROM b WHERE accuracy IS NULL
UNION ALL SELECT 'quarantine:broken', NULL, 1::BIGINT
"""


def _exact_round(i: int) -> str:
    """CTEs of boosting round ``i``: the best of all cuts under the weights ``w{i}``."""
    return f"""
c{i} AS (SELECT f, v, label, sum(w) AS w FROM t JOIN w{i} USING (vec_id) GROUP BY ALL),
g{i} AS (SELECT a.f, a.v, nv, k, coalesce(x.w, 0) AS w FROM (vals CROSS JOIN range(10) AS r(k)) a
         LEFT JOIN c{i} x ON x.f = a.f AND x.v = a.v AND x.label = a.k),
l{i} AS (SELECT f, v, nv, k, round(sum(w) OVER (PARTITION BY f, k ORDER BY v), 9) AS l, round(sum(w) OVER (PARTITION BY f, k), 9) AS every FROM g{i}),
i{i} AS (SELECT f, (v + nv) / 2 AS cut, sum(l) AS nl, sum(every - l) AS nr, sum(every) AS n, sum(l * l) AS l2, sum((every - l) * (every - l)) AS r2,
         max(l) AS ml, max(every - l) AS mr, arg_max(k, (l, -k)) AS lc, arg_max(k, (round(every - l, 9), -k)) AS rc
         FROM l{i} WHERE nv IS NOT NULL GROUP BY f, v, nv),
b{i} AS (SELECT *, (n - ml - mr) / n AS err, ln((ml + mr) / (n - ml - mr)) + ln(9) AS alpha FROM i{i}
         ORDER BY round(1 - (l2 / nl + r2 / nr) / n, 12), f, cut LIMIT 1),
w{i + 1} AS (SELECT vec_id, w * exp(CASE WHEN (CASE WHEN t.v <= cut THEN lc ELSE rc END) <> label THEN alpha ELSE 0 END) AS w
         FROM t JOIN b{i} ON t.f = b{i}.f JOIN w{i} USING (vec_id))"""


ORACLE["samme_exact_round"] = f"""
WITH t AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(64)) AS f FROM {_TRAIN}),
vals AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv FROM (SELECT DISTINCT f, v FROM t)),
w1 AS (SELECT DISTINCT vec_id, 1.0::DOUBLE AS w FROM t),{_exact_round(1)},{_exact_round(2)}
""" + " UNION ALL ".join(
    f"""SELECT {i}::BIGINT AS round, f::BIGINT AS feature, {r6("cut")} AS threshold, lc::BIGINT AS left_class, rc::BIGINT AS right_class,
{r6("err")} AS error, {r6("alpha")} AS alpha FROM b{i}""" for i in (1, 2))

_STEPS = 8     # of 32 rows: replicas of 128 rows on average never reach 256


def _local_step(s: int) -> str:
    """CTEs of step ``s`` of all replicas: weights ``p{s + 1}`` from ``p{s}``."""
    return f"""
z{s} AS (SELECT d.vec_id, d.replica, d.label, d.x, p.k, list_dot_product(d.x, p.w) AS z FROM dealt d JOIN p{s} p USING (replica) WHERE d.step = {s}),
e{s} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z{s}),
d{s} AS (SELECT replica, x, k, e / sum(e) OVER (PARTITION BY vec_id) - CASE WHEN label = k THEN 1 ELSE 0 END AS d FROM e{s}),
u{s} AS (SELECT replica, k, f, avg(v * d) AS g FROM (SELECT replica, k, d, unnest(x) AS v, unnest(range(65)) AS f FROM d{s}) GROUP BY replica, k, f),
g{s} AS (SELECT replica, k, list(g ORDER BY f) AS g FROM u{s} GROUP BY replica, k),
p{s + 1} AS (SELECT p.replica, p.k, CASE WHEN g.g IS NULL THEN p.w ELSE list_transform(list_zip(p.w, g.g), lambda q: q[1] - 0.5 * q[2]) END AS w
             FROM p{s} p LEFT JOIN g{s} g USING (replica, k))"""


ORACLE["local_sgd_round"] = f"""
WITH rows_ AS (SELECT vec_id, label, list_append(x, 1.0::DOUBLE) AS x FROM {_TRAIN}),
r AS (SELECT *, ('0x' || substr(md5('42:' || vec_id), 1, 7))::BIGINT % (SELECT greatest(1, count(*) // 128) FROM rows_) AS replica FROM rows_),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY replica ORDER BY md5('43:' || vec_id)) - 1) // 32 AS step FROM r),
p0 AS (SELECT replica, k, [0.0::DOUBLE FOR i IN range(65)] AS w FROM (SELECT DISTINCT replica FROM r) CROSS JOIN range(10) AS c(k)),{",".join(_local_step(s) for s in range(_STEPS))},
n AS (SELECT replica, count(*) AS n FROM r GROUP BY replica)
SELECT f::BIGINT AS feature, k::BIGINT AS class, {r6("sum(n * v) / sum(n)")} AS weight
FROM (SELECT k, n, unnest(w) AS v, unnest(range(65)) AS f FROM p{_STEPS} JOIN n USING (replica)) GROUP BY f, k
"""

ORACLE["mlp_step"] = f"""
WITH t AS (SELECT vec_id, label, x FROM {_TRAIN}),
w1 AS (SELECT j, [((i * 7 + j * 13) % 11 - 5) / 50.0::DOUBLE FOR i IN range(64)] AS w, (j * 5 % 7 - 3) / 50.0::DOUBLE AS b FROM range(128) AS r(j)),
w2 AS (SELECT k, [((a * 3 + k * 17) % 13 - 6) / 60.0::DOUBLE FOR a IN range(128)] AS w, (k * 11 % 5 - 2) / 50.0::DOUBLE AS b FROM range(10) AS r(k)),
back AS (SELECT j, [((j * 3 + k * 17) % 13 - 6) / 60.0::DOUBLE FOR k IN range(10)] AS w FROM range(128) AS r(j)),
a AS (SELECT vec_id, j, list_dot_product(x, w) + b AS a FROM t CROSS JOIN w1),
h AS (SELECT vec_id, list(greatest(a, 0) ORDER BY j) AS h FROM a GROUP BY vec_id),
o AS (SELECT vec_id, label, k, list_dot_product(h, w) + b AS o FROM h JOIN t USING (vec_id) CROSS JOIN w2),
e AS (SELECT *, exp(o - max(o) OVER (PARTITION BY vec_id)) AS e FROM o),
d AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) - CASE WHEN label = k THEN 1 ELSE 0 END AS d FROM e),
ds AS (SELECT vec_id, list(d ORDER BY k) AS d FROM d GROUP BY vec_id),
dh AS (SELECT vec_id, j, CASE WHEN a > 0 THEN list_dot_product(d, w) ELSE 0 END AS dh FROM a JOIN ds USING (vec_id) JOIN back USING (j)),
g AS (
  SELECT 'w1' AS layer, i AS r, j AS c, avg(v * dh) AS g FROM (SELECT j, dh, unnest(x) AS v, unnest(range(64)) AS i FROM dh JOIN t USING (vec_id)) GROUP BY i, j
  UNION ALL SELECT 'b1', 0, j, avg(dh) FROM dh GROUP BY j
  UNION ALL SELECT 'w2', a, k, avg(v * d) FROM (SELECT k, d, unnest(h) AS v, unnest(range(128)) AS a FROM d JOIN h USING (vec_id)) GROUP BY a, k
  UNION ALL SELECT 'b2', 0, k, avg(d) FROM d GROUP BY k),
w AS (
  SELECT 'w1' AS layer, unnest(range(64)) AS r, j AS c, unnest(w) AS w FROM w1 UNION ALL SELECT 'b1', 0, j, b FROM w1
  UNION ALL SELECT 'w2', unnest(range(128)), k, unnest(w) FROM w2 UNION ALL SELECT 'b2', 0, k, b FROM w2)
SELECT layer, r::BIGINT AS row, c::BIGINT AS col, {r6("g", 8)} AS gradient, {r6("w - 0.001 * g / (abs(g) + 1e-8)")} AS weight FROM g JOIN w USING (layer, r, c)
"""

_I = range(WV_DIM)
_HEX = "('0x' || substr(md5({}), {}, {}))::BIGINT"


def _mixed(x: str) -> str:
    return f"((xor({x}, ({x}) >> 16) * 73244475) % 4294967296)"


def _per_word(name: str, rows: str, value: str) -> str:
    """Moves of a lot's words times their touches, summed over lots."""
    return f"""
{name} AS (SELECT word, sum(n)::BIGINT AS n, {", ".join(f"sum(n * d{i}) / sum(n) AS d{i}" for i in _I)}
  FROM (SELECT lot, word, count(*) AS n, {", ".join(f"sum({value.format(i=i)}) AS d{i}" for i in _I)} FROM {rows} GROUP BY lot, word) GROUP BY word)"""


ORACLE["cbow_step"] = f"""
WITH d AS (SELECT doc_id, {sql_sentence_tokens('text')} AS toks FROM documents),
s AS (SELECT doc_id || ':' || i AS sid, t AS tokens FROM (SELECT doc_id, unnest(toks) AS t, unnest(range(len(toks))) AS i FROM d)),
tok AS (SELECT sid, len(tokens) AS len, unnest(tokens) AS word, unnest(range(len(tokens))) AS p FROM s),
vocab AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
l AS (SELECT greatest(1, ceil(sum(n) / 20000.0))::BIGINT AS lots, sum(n ** 0.75) AS whole FROM vocab),
pos AS (SELECT sid, {_HEX.format("'42:' || sid", 1, 7)} % lots AS lot, p, word, len FROM tok, l),
rates AS (SELECT word, n ** 0.75 * (lots * 2000 / whole) AS rate, lots FROM vocab, l),
drawn AS (SELECT word, lots, floor(rate)::BIGINT + CASE WHEN {_HEX.format("'42:' || word", 1, 7)} / 268435456.0 < rate - floor(rate) THEN 1 ELSE 0 END AS draws FROM rates),
each AS (SELECT word, lots, unnest(range(draws)) AS draw FROM drawn),
pools AS (SELECT lot, word, row_number() OVER (PARTITION BY lot ORDER BY word) - 1 AS k, count(*) OVER (PARTITION BY lot) AS size
  FROM (SELECT word, {_HEX.format("'42:' || word || ':' || draw", 1, 7)} % lots AS lot FROM each)),
sizes AS (SELECT DISTINCT lot, size FROM pools),
wv AS (SELECT word, {sql_hash_vec_cols('word')} FROM vocab),
ov AS (SELECT word, {sql_hash_vec_cols("word || '!'")} FROM vocab),
ctx AS (SELECT e.sid, e.p, e.lot, c.word FROM (SELECT * FROM pos CROSS JOIN range(-5, 6) AS o(o) WHERE len > 1 AND o <> 0) e
  JOIN pos c ON c.sid = e.sid AND c.p = e.p + e.o),
h AS (SELECT sid, p, lot, {", ".join(f"avg(v{i}) AS h{i}" for i in _I)} FROM ctx JOIN wv USING (word) GROUP BY sid, p, lot),
ex AS (SELECT sid, p, lot, word AS target FROM pos WHERE len > 1),
neg AS (SELECT sid, p, lot, target, {_mixed(_mixed("x"))} AS x, size
  FROM (SELECT sid, p, e.lot, target, size, ({_HEX.format("'42:0:' || sid", 1, 7)} + p * 40503 + j * 2246822519) % 4294967296 AS x
        FROM ex e JOIN sizes z ON z.lot = e.lot CROSS JOIN range(5) AS r(j))),
words AS (SELECT sid, p, lot, target AS word, 1 AS wanted FROM ex
  UNION ALL SELECT sid, p, n.lot, q.word, 0 FROM neg n JOIN pools q ON q.lot = n.lot AND q.k = xor(n.x, n.x >> 16) % n.size WHERE q.word <> target),
z AS (SELECT w.sid, w.p, w.lot, w.word, wanted, {" + ".join(f"h{i} * v{i}" for i in _I)} AS z, {", ".join(f"h{i}, v{i}" for i in _I)}
  FROM words w JOIN h ON h.sid = w.sid AND h.p = w.p JOIN ov ON ov.word = w.word),
g AS (SELECT *, 0.5 * (wanted - 1 / (1 + exp(-z))) AS g FROM z),
back AS (SELECT sid, p, {", ".join(f"sum(g * v{i}) AS b{i}" for i in _I)} FROM g GROUP BY sid, p),
cb AS (SELECT ctx.lot, ctx.word, {", ".join(f"b{i}" for i in _I)} FROM ctx JOIN back ON back.sid = ctx.sid AND back.p = ctx.p),{_per_word("din", "cb", "b{i}")},{_per_word("dout", "g", "g * h{i}")}
SELECT wv.word, coalesce(a.n, 0)::BIGINT AS n_in, coalesce(b.n, 0)::BIGINT AS n_out,
  {", ".join(r6(f"wv.v{i} + coalesce(a.d{i}, 0)") + f" AS in{i}" for i in _I)}, {", ".join(r6(f"ov.v{i} + coalesce(b.d{i}, 0)") + f" AS out{i}" for i in _I)}
FROM wv JOIN ov USING (word) LEFT JOIN din a USING (word) LEFT JOIN dout b USING (word)
"""

ORACLE["numbered_outliers"] = """
WITH d AS (
  SELECT doc_id, CASE WHEN doc_id = 0 THEN (-9223372036854775807 - 1)::BIGINT WHEN doc_id = 1 THEN 9223372036854775807
    WHEN doc_id % 50 = 2 THEN 1152921504606846976 + doc_id WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id * 1000 - 40000 END AS key
  FROM documents)
SELECT doc_id, key::BIGINT AS key, row_number() OVER (ORDER BY key, doc_id) AS row_no, count(*) OVER () AS n_rows FROM d
"""

_WIDE_LIST = "[" + ", ".join(
    f"('0x' || substr(md5({'token' if i < 8 else f'''token || ':{i // 8}' '''}), {1 + 3 * (i % 8)}, 3))::INTEGER / 4095.0 - 0.5" for i in range(200)) + "]"
ORACLE["word_importance_wide"] = ORACLE["word_importance"].replace(_VEC_LIST, _WIDE_LIST).replace(
    f"range({WV_DIM})", "range(200)").replace(f"/ {WV_DIM})", "/ 200)")


# --------------------------------------------------------------------------
# Learnt sentences, ordered tokeniser rules
from articlelab.functions import treebank as TB  # noqa: E402
from articlelab.operators import sentences as SE  # noqa: E402


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


STOPS_TEXT = "replace(replace(text, ' the ', ' Dr. '), ' de ', ' p.m. ')"


def sql_core(x: str) -> str:
    return f"regexp_replace({x}, '{_q(f'^{SE.OPENERS}+|{SE.CLOSERS}*[{WS_CLASS}]*$')}', '', 'g')"


def sql_kind(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '{SE.ELLIPSIS}') THEN 'ellipsis' WHEN regexp_matches({c}, '[!?]$') THEN 'mark' "
            f"WHEN regexp_matches({c}, '{SE.INITIAL}') THEN 'initial' WHEN regexp_matches({c}, '^[0-9]+([.,:-][0-9]+)*\\.$') THEN 'number' "
            f"WHEN regexp_matches({c}, '\\.$') THEN 'stop' ELSE 'none' END")


def sql_type(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{SE.NUMBER}') THEN '{SE.NUMBER_TYPE}' ELSE lower(regexp_replace({c}, '\\.$', '')) END"


def sql_together(a: str, b: str, ab: str, n: str) -> str:
    x = lambda m, p: f"(CASE WHEN ({m}) = 0 THEN 0 ELSE ({m}) * ln({p}) END)"
    a, b, ab, n = (f"({v})::DOUBLE" for v in (a, b, ab, n))
    p, p1, p2 = f"{b} / {n}", f"{ab} / {a}", f"({b} - {ab}) / ({n} - {a})"
    return (f"(-2 * ({x(ab, p)} + {x(f'{a} - {ab}', f'1 - {p}')} + {x(f'{b} - {ab}', p)} + {x(f'{n} - {a} - {b} + {ab}', f'1 - {p}')}"
            f" - CASE WHEN {ab} = 0 OR {ab} = {a} THEN 0 ELSE {x(ab, p1)} + {x(f'{a} - {ab}', f'1 - {p1}')} END"
            f" - CASE WHEN {n} <= {a} OR {b} = {ab} OR {n} - {a} - {b} + {ab} <= 0 THEN 0 ELSE {x(f'{b} - {ab}', p2)} + {x(f'{n} - {a} - {b} + {ab}', f'1 - {p2}')} END))")


_SCORES = f"""
docs AS (SELECT doc_id, regexp_extract_all({STOPS_TEXT}, '{SE.TOKEN}') AS raw FROM documents),
lists AS (SELECT doc_id, raw, list_transform(raw, lambda x: {sql_core('x')}) AS cores FROM docs),
texts AS (SELECT list_filter(cores, lambda x: x <> '') AS t FROM lists),
pairs AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(list_concat([NULL], t)) AS a, unnest(list_concat(t, [NULL])) AS b FROM texts WHERE len(t) > 0) GROUP BY a, b),
typed AS (SELECT {sql_type('a')} AS type, sum(CASE WHEN regexp_matches(a, '\\.$') THEN n ELSE 0 END) AS n_with,
  sum(CASE WHEN regexp_matches(a, '\\.$') THEN 0 ELSE n END) AS n_without FROM pairs WHERE a IS NOT NULL AND {sql_kind('a')} <> 'ellipsis' GROUP BY 1),
share AS (SELECT sum(n_with)::DOUBLE / sum(n_with + n_without) AS p FROM typed),
liked AS (SELECT type, n_with, n_without, -2 * (n_with * ln(p) + n_without * ln(1 - p) - n_with * ln(0.99::DOUBLE) - n_without * ln(1 - 0.99::DOUBLE)) AS ll,
  length(type) - length(replace(type, '.', '')) AS stops FROM typed, share WHERE n_with > 0 AND regexp_matches(type, '\\p{{L}}')),
scored AS (SELECT *, ll * exp(-(length(type) - stops)::DOUBLE) * (stops + 1) * pow((length(type) - stops)::DOUBLE, -n_without::DOUBLE) AS score FROM liked)"""

ORACLE["abbreviation_scores"] = f"""
WITH {_SCORES}
SELECT type, n_with::BIGINT AS n_with, n_without::BIGINT AS n_without, {r6('ll', 4)} AS log_likelihood, {r6('score')} AS score, score >= 0.3 AS is_abbreviation FROM scored
"""

def sql_first_pass(rows: str, n: str) -> str:
    return f"""(SELECT *, a IS NOT NULL AND (ka = 'mark' OR (ka IN ('stop', 'initial', 'number') AND NOT abbr)) AS ends FROM (
      SELECT x.*, coalesce(s.is_abbr, false) AND ka IN ('stop', 'initial') AS abbr FROM (
        SELECT a, b, {n} {sql_kind('a')} AS ka, {sql_type('a')} AS ta, {sql_type('b')} AS tb FROM {rows}) x
      LEFT JOIN (SELECT type, true AS is_abbr FROM scored WHERE score >= 0.3) s ON x.ta = s.type))"""


ORACLE["learnt_sentences"] = f"""
WITH {_SCORES},
first AS {sql_first_pass('pairs', 'n,')},
counts AS (SELECT tb AS type, sum(n) AS n, sum(CASE WHEN ends THEN n ELSE 0 END) AS at_break, bool_or(regexp_matches(b, '\\p{{L}}')) AS word
  FROM first WHERE b IS NOT NULL GROUP BY tb),
total AS (SELECT sum(n) AS total, sum(CASE WHEN ends THEN n ELSE 0 END) AS breaks FROM first WHERE b IS NOT NULL),
starters AS (SELECT type FROM counts, total WHERE at_break > 0 AND word AND {sql_together('breaks', 'n', 'at_break', 'total')} >= 30
  AND total::DOUBLE / breaks > n::DOUBLE / at_break),
bound AS (SELECT ta, tb, sum(n) AS times FROM first WHERE ka IN ('number', 'initial') AND ends AND regexp_matches(b, '\\p{{L}}') GROUP BY ta, tb),
tied AS (SELECT ta, tb FROM bound JOIN counts l ON l.type = ta JOIN counts r ON r.type = tb, total
  WHERE times > 1 AND {sql_together('l.n', 'r.n', 'times', 'total')} >= 7.88 AND total::DOUBLE / l.n > r.n::DOUBLE / times),
writing AS (SELECT tb AS type, bool_or(u) AS upper, bool_or(l) AS lower, bool_or(u AND inside) AS upper_inside, bool_or(l AND begins) AS lower_first
  FROM (SELECT tb, regexp_matches(b, '^\\p{{Lu}}') AS u, regexp_matches(b, '^\\p{{Ll}}') AS l, a IS NULL OR ends AS begins, NOT (a IS NULL OR ends) AND ka = 'none' AS inside
        FROM first WHERE b IS NOT NULL) WHERE u OR l GROUP BY tb),
places AS (SELECT doc_id, i, cores[i] AS a, cores[i + 1] AS b FROM (SELECT doc_id, cores, unnest(range(1, len(cores))) AS i FROM lists) WHERE regexp_matches(cores[i], '[.!?]$')),
distinct_ AS (SELECT DISTINCT a, b FROM places),
second AS (SELECT p.*, regexp_matches(b, '^\\p{{Lu}}') AS up, regexp_matches(b, '^\\p{{Ll}}') AS down, coalesce(w.lower, false) AS wl, coalesce(w.upper, false) AS wu,
    coalesce(w.upper_inside, false) AS wi, coalesce(w.lower_first, false) AS wf, s.type IS NOT NULL AS starter, t.ta IS NOT NULL AS tied
  FROM {sql_first_pass('distinct_', '')} p LEFT JOIN writing w ON w.type = p.tb LEFT JOIN starters s ON s.type = p.tb LEFT JOIN tied t ON t.ta = p.ta AND t.tb = p.tb),
decided AS (SELECT a, b, CASE WHEN ka = 'mark' THEN true WHEN tied THEN false
    WHEN (abbr OR ka = 'ellipsis') AND ka <> 'initial' THEN (up AND wl AND NOT wi) OR (up AND starter)
    WHEN ka IN ('initial', 'number') AND down AND (wu OR NOT wf) THEN false
    WHEN ka = 'initial' AND NOT (up AND wl AND NOT wi) AND up AND NOT wl THEN false ELSE ends END AS ends FROM second),
cuts AS (SELECT doc_id, list(i ORDER BY i) AS cuts FROM places p JOIN decided d ON p.a = d.a AND p.b = d.b WHERE d.ends GROUP BY doc_id),
sents AS (SELECT l.doc_id, CASE WHEN len(raw) > 0 THEN list_transform(list_zip(list_concat([0], coalesce(cuts, [])), list_concat(coalesce(cuts, []), [len(raw)])),
    lambda r: regexp_replace(array_to_string(list_slice(raw, r[1] + 1, r[2]), ''), '^[{WS_CLASS}]+|[{WS_CLASS}]+$', '', 'g')) ELSE [] END AS s
  FROM lists l LEFT JOIN cuts c USING (doc_id))
SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(31))) AS sentences_md5 FROM sents
"""


def sql_treebank(s: str) -> str:
    out = f"regexp_replace(regexp_replace({s}, '[{WS_CLASS}]+', ' ', 'g'), '^ | $', '', 'g')"
    apply = lambda x, rules: x if not rules else apply(f"regexp_replace({x}, '{_q(rules[0][0])}', '{_q(rules[0][1].replace('$', chr(92)))}', 'g')", rules[1:])
    out = apply(f"' ' || {apply(out, TB.BEFORE)} || ' '", TB.AFTER)
    return f"list_filter(string_split_regex({out}, ' +'), lambda x: x <> '')"


SPOKEN = "replace(replace(replace(text, ' de ', ' don''t '), ' the ', ' (it''s \"so\") '), ', ', ', I''ve ') || ' \"He cannot,\" she said; they won''t pay $3.50...'"

ORACLE["ordered_tokens"] = f"""
SELECT conv_id, turn, len(w)::BIGINT AS n_tokens, len(list_filter(w, lambda x: x = 'n''t'))::BIGINT AS n_contractions, md5(array_to_string(w, ' ')) AS tokens_md5
FROM (SELECT conv_id, turn, {sql_treebank(SPOKEN)} AS w FROM conversations)
"""

ORACLE["contractions_fixed"] = f"""
SELECT conv_id, turn, j <> replace(j, ' n''t ', 'n ''t ') AS changed, md5(replace(j, ' n''t ', 'n ''t ')) AS fixed_md5
FROM (SELECT conv_id, turn, array_to_string({sql_treebank(SPOKEN)}, ' ') AS j FROM conversations)
"""

ORACLE["image_folder"] = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda v: least(255, greatest(0, floor((v::DOUBLE + 0.5) * 256)))::BIGINT) AS r FROM embeddings),
g AS (SELECT vec_id, label, list_transform(r, lambda x: (((19595 * x + 38470 * (255 - x) + 7471 * ((x & 15) * 16) + 32768) >> 16) / 255.0 - 0.5) / 0.5) AS p FROM v)
SELECT vec_id, (SELECT count(DISTINCT 'class ' || o.label) FROM embeddings o WHERE 'class ' || o.label < 'class ' || g.label)::BIGINT AS label,
  8::INTEGER AS height, 8::INTEGER AS width, {r6("p[1]")} AS p1, {r6("p[10]")} AS p10, {r6("p[64]")} AS p64, {r6("list_sum(p)")} AS total FROM g
"""

ORACLE["vocabulary_stream"] = ORACLE["vocab_update"]

ORACLE["run_files_variant"] = f"""
WITH r AS {RUNS},
f AS (SELECT 'embedder_name' AS field, 'text' AS kind, 'text' AS expected FROM r
  UNION ALL SELECT 'accuracy', CASE WHEN epoch = 2 THEN 'text' ELSE 'number' END, 'number' FROM r WHERE accuracy IS NOT NULL
  UNION ALL SELECT 'f1_score', 'list', 'list' FROM r WHERE epoch = 5
  UNION ALL SELECT 'notes', 'object', 'unknown' FROM r WHERE split = 'test')
SELECT 'field:' || field AS what, kind || ':' || expected AS kind, count(*)::BIGINT AS n, NULL::DOUBLE AS value FROM f GROUP BY ALL
UNION ALL SELECT embedder_name, 'mean', count(*) FILTER (WHERE epoch = 5)::BIGINT, {r6("avg(accuracy)")} FROM r GROUP BY embedder_name
UNION ALL SELECT 'quarantine', 'broken', 1::BIGINT, NULL
"""


# --------------------------------------------------------------------------
# Jobs with their file ends
_F = ", ".join(r6(f"coalesce(s{i}, 0) / greatest(len(d.toks), 1)") + f" AS f{i}" for i in range(WV_DIM))
_SUMS = ", ".join(f"sum(v{i}) AS s{i}" for i in range(WV_DIM))

ORACLE["pretrained_from_file"] = f"""
WITH d AS (SELECT item_id, {sql_flat_tokens('text')} AS toks FROM benchmark),
t AS (SELECT item_id, unnest(toks) AS token FROM d),
wv AS (SELECT token, {sql_hash_vec_cols()} FROM (SELECT DISTINCT token FROM t) WHERE {sql_has_vec()}),
s AS (SELECT t.item_id, {_SUMS} FROM t JOIN wv USING (token) GROUP BY t.item_id)
SELECT d.item_id, len(d.toks)::BIGINT AS n_tokens, {_F} FROM d LEFT JOIN s USING (item_id)
"""

ORACLE["first_vectors_of_file"] = f"""
SELECT token, row_no, {", ".join(r6(f"v{i}") + f" AS v{i}" for i in range(WV_DIM))} FROM (
  SELECT token, row_number() OVER (ORDER BY token) AS row_no, {sql_hash_vec_cols()} FROM {vocab_sql('benchmark')} WHERE {sql_has_vec()})
WHERE row_no <= 200 OR token IN ('{BOS}', '{EOS}')
"""

#: Documents by their place in the CSV, split by the shuffled place.
_FILED = f"""
filed AS (SELECT doc_id, lang AS type, text, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
shuffled AS (SELECT *, row_number() OVER (ORDER BY {shuffle_key('place')}, place) AS rn, count(*) OVER () AS n FROM filed),
d AS (SELECT doc_id, type, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, coalesce({sql_flat_tokens('text')}, []) AS toks FROM shuffled),
t AS (SELECT doc_id, split, unnest(toks) AS token FROM d)"""

ORACLE["vocabulary_encoder_job"] = f"""
WITH {_FILED},
wv AS (SELECT token, {sql_hash_vec_cols()} FROM (SELECT DISTINCT token FROM t WHERE split = 'train') WHERE {sql_has_vec()}),
s AS (SELECT t.doc_id, {_SUMS} FROM t JOIN wv USING (token) GROUP BY t.doc_id)
SELECT d.doc_id, len(d.toks)::BIGINT AS n_tokens, {_F} FROM d LEFT JOIN s USING (doc_id)
"""

ORACLE["word_vector_job"] = f"WITH {_FILED} SELECT DISTINCT token, 16::BIGINT AS width, true AS learnt FROM t WHERE split = 'train'"

ORACLE["subset_job"] = f"""
WITH a AS (SELECT doc_id, type, doc_id || ':' || text AS text, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM {ARTICLES}),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {shuffle_key('place')}, place) AS rn FROM a)
SELECT type, doc_id, md5(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5 FROM r WHERE rn <= 20 AND type IN ('human', 'gpt')
"""

ORACLE["embed_files_job"] = f"""
WITH {_FILED},
m AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS label FROM (SELECT DISTINCT type FROM d WHERE type IS NOT NULL)),
wv AS (SELECT token, {sql_hash_vec_cols()} FROM (SELECT DISTINCT token FROM t) WHERE {sql_has_vec()}),
s AS (SELECT t.doc_id, {_SUMS} FROM t JOIN wv USING (token) GROUP BY t.doc_id)
SELECT split, label::BIGINT AS label, count(*)::BIGINT AS n, {", ".join(r6(f"sum(coalesce(s{i}, 0) / greatest(len(toks), 1))", 4) + f" AS f{i}" for i in range(WV_DIM))}
FROM d JOIN m USING (type) LEFT JOIN s USING (doc_id) GROUP BY split, label
"""

ORACLE["network_files_job"] = f"""
SELECT 'fixture' AS original_dataset_name, 'hash64' AS embedder_name, 2::BIGINT AS epochs, 32::BIGINT AS batch_size, 2::BIGINT AS n_losses,
  count(*) FILTER (WHERE split = 'train')::BIGINT AS n_train, count(*) FILTER (WHERE split = 'test')::BIGINT AS n_test,
  (65 * count(DISTINCT label))::BIGINT AS n_weights FROM {FEATURES}
"""

ORACLE["boosting_files_job"] = f"""
WITH t AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(64)) AS f FROM {_TRAIN}),
vals AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv FROM (SELECT DISTINCT f, v FROM t)),
w1 AS (SELECT DISTINCT vec_id, 1.0::DOUBLE AS w FROM t),{_exact_round(1)},
p AS (SELECT label AS true_label, CASE WHEN embedding[f + 1]::DOUBLE <= cut THEN lc ELSE rc END AS pred_label FROM {FEATURES}, b1 WHERE split = 'test'),
l AS (SELECT DISTINCT unnest([true_label, pred_label]) AS x FROM p),
a AS (SELECT {r6("avg((true_label = pred_label)::INT)")} AS accuracy FROM p)
SELECT y.x::BIGINT AS true_label, z.x::BIGINT AS pred_label, (SELECT count(*) FROM p WHERE true_label = y.x AND pred_label = z.x)::BIGINT AS n, accuracy
FROM l y CROSS JOIN l z CROSS JOIN a
"""

ORACLE["image_files_job"] = f"""
SELECT split, label::BIGINT AS label, count(u)::BIGINT AS n, 64::BIGINT AS height, {r6("avg(list_sum(u) * list_sum(u) * 255.0)", 3)} AS mean_total
FROM {UNIT} JOIN {FEATURES} USING (vec_id) GROUP BY split, label
"""

ORACLE["routed_runs_job"] = f"""
WITH r AS (SELECT * FROM {RUNS} WHERE accuracy IS NOT NULL)
SELECT 'network' AS kind, {_emb_type('embedder_name')} AS embedding_type, {_cls_type('embedder_name')} AS class_type, {r6('avg(accuracy)')} AS mean_accuracy, count(*)::BIGINT AS n_runs
FROM r WHERE split = 'train' GROUP BY ALL
UNION ALL SELECT 'boosting', {_emb_type('embedder_name')}, NULL, {r6('avg(accuracy)')}, count(*)::BIGINT FROM r WHERE split = 'test' GROUP BY ALL
"""

ORACLE["csv_projection"] = "SELECT lang AS language, count(*)::BIGINT AS n FROM documents GROUP BY lang"

ORACLE["row_lookup"] = f"""
SELECT (rn - 1)::BIGINT AS file_row, vec_id, 64::BIGINT AS width, {r6("list_sum(list_transform(embedding, lambda x: x::DOUBLE))")} AS total
FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings) WHERE rn IN (1, 8, 500)
"""

_SCORE = ", ".join(
    r6(f"list_dot_product(h, [((a * 3 + {k} * 17) % 13 - 6) / 60.0::DOUBLE FOR a IN range(128)]) + {k} / 100.0") + f" AS z{k}" for k in range(10))
ORACLE["score_network"] = f"""
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
w1 AS (SELECT j, [((i * 7 + j * 13) % 11 - 5) / 50.0::DOUBLE FOR i IN range(64)] AS w FROM range(128) AS r(j)),
h AS (SELECT vec_id, list(greatest(list_dot_product(x, w), 0) ORDER BY j) AS h FROM t CROSS JOIN w1 GROUP BY vec_id),
z AS (SELECT vec_id, {_SCORE} FROM h)
SELECT *, list_position([{", ".join(f"z{k}" for k in range(10))}], greatest({", ".join(f"z{k}" for k in range(10))})) - 1 AS pred FROM z
"""

ORACLE["embedded_given_map"] = f"""
WITH d AS (SELECT doc_id, CASE type WHEN 'human' THEN 5 ELSE 9 END AS label, {sql_flat_tokens('text')} AS toks FROM {ARTICLES}),
t AS (SELECT doc_id, unnest(toks) AS token FROM d),
wv AS (SELECT token, {sql_hash_vec_cols()} FROM (SELECT DISTINCT token FROM t) WHERE {sql_has_vec()}),
s AS (SELECT t.doc_id, {_SUMS} FROM t JOIN wv USING (token) GROUP BY t.doc_id)
SELECT d.doc_id, label::BIGINT AS label, {_F} FROM d LEFT JOIN s USING (doc_id)
"""

ORACLE["encoder_sentences"] = f"SELECT sum(len({sql_sentence_tokens('text')}))::BIGINT AS sentences, true AS timed FROM conversations"

ORACLE["result_views"] = f"""
WITH r AS (SELECT * FROM {RUNS} WHERE accuracy IS NOT NULL)
SELECT s AS series, 1::BIGINT AS epoch, count(*)::BIGINT AS n, {r6("avg(CASE WHEN ends_with(s, 'accuracies') THEN accuracy ELSE loss END)")} AS mean
FROM r CROSS JOIN (SELECT unnest(['training_accuracies', 'training_losses', 'testing_accuracies', 'testing_losses']) AS s) GROUP BY s
"""
