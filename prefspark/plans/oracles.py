"""DuckDB SQL with the same results as the registered queries.

Written straight from the definitions (pair joins, plain windows, long form),
not from the Spark plans, so that the two check each other.
"""

from __future__ import annotations

from ..functions import fixed

ORACLES: dict[str, str] = {}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _u(text: str) -> str:
    """Uniform double of an md5, as in functions.rand."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _bits(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def _ids(text: str) -> str:
    pattern = _lit(fixed.TOKEN_PATTERN)
    return (
        f"list_transform(regexp_extract_all({text}, {pattern}), "
        f"lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 50000)"
    )


def _spaced(value: str) -> str:
    return f"array_to_string({value}, ' ')"


# --- diversity -------------------------------------------------------------

_PAIRS = """
WITH n AS (SELECT label, count(*) AS n_outputs FROM embeddings GROUP BY label),
p AS (
  SELECT a.label, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
  GROUP BY a.label),
d AS (SELECT n.label, n.n_outputs, 1 - p.c AS diversity FROM n LEFT JOIN p USING (label))
"""
ORACLES["diversity_per_sample"] = (
    _PAIRS + "SELECT label, n_outputs, round(diversity, 6) AS diversity FROM d"
)
ORACLES["diversity_summary"] = (
    _PAIRS
    + "SELECT count(diversity) AS n, round(avg(diversity), 6) AS mean, "
    "round(stddev_samp(diversity) / sqrt(count(diversity)), 6) AS std_err FROM d"
)
_RECORD_PAIRS = """
WITH e AS (SELECT vec_id // 10 AS sample_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (
  SELECT a.sample_id, 1 - avg(list_cosine_similarity(a.v, b.v)) AS diversity
  FROM e a LEFT JOIN e b ON a.sample_id = b.sample_id AND a.vec_id < b.vec_id
  GROUP BY a.sample_id)
"""
ORACLES["diversity_of_records"] = (
    _RECORD_PAIRS + "SELECT sample_id, round(diversity, 6) AS diversity FROM d"
)
ORACLES["stream_eval_stats"] = (
    _RECORD_PAIRS
    + "SELECT 'r0' AS run, count(diversity) AS n, round(avg(diversity), 6) AS mean, "
    "round(stddev_samp(diversity) / sqrt(count(diversity)), 6) AS std_err FROM d"
)

# --- adapters --------------------------------------------------------------

_ASSISTANT = """
s AS (
  SELECT conv_id, min(turn) AS f, max(turn) AS l, count(*) AS n
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
m AS (
  SELECT c.conv_id, c.turn, c.text, c.role AS raw, s.f, s.l, s.n,
         CASE WHEN c.role = 'user' THEN 'user' ELSE 'assistant' END AS role
  FROM conversations c JOIN s USING (conv_id))
"""
ORACLES["hh_paired"] = f"""WITH {_ASSISTANT}
SELECT conv_id AS row_idx, 'chosen' AS side, turn AS pos, role, text AS content
FROM m WHERE n >= 2 AND turn <= l
UNION ALL
SELECT conv_id, 'rejected', turn, role, text FROM m WHERE n >= 2 AND turn < l
UNION ALL
SELECT conv_id, 'rejected', l, role, text FROM m WHERE n >= 2 AND turn = f"""
ORACLES["hh_unpaired"] = f"""WITH {_ASSISTANT}
SELECT conv_id AS row_idx, 'chosen' AS side, turn AS pos, role, text AS content
FROM m WHERE turn <= l"""
ORACLES["hh_prompt_only"] = f"""WITH {_ASSISTANT}
SELECT conv_id AS row_idx, CASE WHEN turn = l THEN 'reference' ELSE 'history' END AS side,
       turn AS pos, role, text AS content
FROM m WHERE turn <= l"""
for _name in ("hh_paired", "hh_unpaired"):
    ORACLES[f"{_name}_examples"] = f"""
SELECT row_idx, side, row_number() OVER (PARTITION BY row_idx, side ORDER BY pos) - 1 AS pos, role, content
FROM ({ORACLES[_name]})"""
ORACLES["hh_prompt_only_examples"] = f"""WITH {_ASSISTANT},
r AS (
  SELECT *, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1
                 THEN text || '<|im_end|>'
                 ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' END AS rendered FROM m)
SELECT conv_id AS sample_id,
       coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (turn < l), '') || '<|im_start|>assistant' || chr(10) AS prompt,
       coalesce(string_agg(role || ': ' || text, ' | ' ORDER BY turn) FILTER (turn < l), '') AS history,
       max(text) FILTER (turn = l) AS "references"
FROM r GROUP BY conv_id"""
ORACLES["hh_chatml_messages"] = f"""WITH {_ASSISTANT}
SELECT conv_id AS row_idx, turn AS pos,
       CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1
            THEN text || '<|im_end|>'
            ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' END AS rendered
FROM m WHERE turn <= l"""

_TLDR = """
t AS (
  SELECT doc_id AS row_idx, text AS prompt, lang,
         string_split(text, chr(10))[1] || ' #' || doc_id AS chosen,
         string_split(text, chr(10))[-1] || ' #' || doc_id AS rejected
  FROM documents)
"""


def _tldr_side(side: str) -> str:
    return (
        f"SELECT row_idx, '{side}' AS side, 0::BIGINT AS pos, 'user' AS role, prompt AS content FROM t "
        f"UNION ALL SELECT row_idx, '{side}', 1::BIGINT, 'assistant', {side} FROM t"
    )


ORACLES["tldr_paired"] = f"WITH {_TLDR} {_tldr_side('chosen')} UNION ALL {_tldr_side('rejected')}"
ORACLES["tldr_unpaired"] = f"WITH {_TLDR} {_tldr_side('chosen')}"
ORACLES["registered_adapter"] = f"""WITH {_TLDR}
SELECT row_idx, CASE side WHEN 'chosen' THEN 'rejected' ELSE 'chosen' END AS side, pos, role, content
FROM ({_tldr_side('chosen')} UNION ALL {_tldr_side('rejected')})"""
ORACLES["picked_template"] = f"""WITH {_TLDR}
SELECT row_idx, '<s>[INST]' || prompt || '[/INST]' || chosen || '</s>' AS trained,
       '<|im_start|>user' || chr(10) || prompt || '<|im_end|><|im_start|>assistant' || chr(10) AS generating FROM t"""
ORACLES["tldr_grouped_prompts"] = f"""WITH {_TLDR}
SELECT min(row_idx) AS sample_id, 0::BIGINT AS part,
       '<|im_start|>user' || chr(10) || prompt || '<|im_end|><|im_start|>assistant' || chr(10) AS prompt,
       count(*) AS n_references, string_agg(chosen, ' | ' ORDER BY row_idx) AS "references"
FROM t GROUP BY t.prompt"""
ORACLES["chatml_render"] = f"""WITH {_TLDR}
SELECT row_idx, '<|im_start|>user' || chr(10) || prompt || '<|im_end|><|im_start|>assistant' || chr(10)
       || chosen || '<|im_end|><|im_start|>assistant' || chr(10) AS conversation,
       chosen || '<|im_end|>' AS answer
FROM t"""
ORACLES["llama_render"] = f"""WITH {_TLDR}
SELECT row_idx, '<s>[INST]' || prompt || '[/INST]' || chosen || '</s>' AS conversation,
       '<s>' || chosen || '</s>' AS answer
FROM t"""
ORACLES["generate_plugin"] = f"""WITH {_TLDR},
g AS (
  SELECT min(row_idx) AS sample_id, count(*) AS n_references,
         length('<|im_start|>user' || chr(10) || prompt || '<|im_end|><|im_start|>assistant' || chr(10)) AS size
  FROM t GROUP BY prompt)
SELECT sample_id, size || ' characters, sample 0 | ' || size || ' characters, sample 1' AS outputs,
       n_references FROM g"""
ORACLES["resumed_generation"] = f"""WITH {_TLDR},
g AS (
  SELECT min(row_idx) AS sample_id, count(*) AS n_references,
         length('<|im_start|>user' || chr(10) || prompt || '<|im_end|><|im_start|>assistant' || chr(10)) AS size
  FROM t GROUP BY prompt)
SELECT sample_id, size || ' characters, sample 0, top 40 | ' || size || ' characters, sample 1, top 40' AS outputs,
       n_references FROM g"""
ORACLES["load_split"] = f"""WITH {_TLDR}
SELECT row_idx, 'valid1' AS split, length(chosen) AS chosen_chars FROM t WHERE lang <> 'en'"""
ORACLES["rows_by_id"] = """
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"""

# --- encoding and batching -------------------------------------------------

_PROMPT, _LENGTH = 96, 160


def _examples(least: int) -> str:
    """Encoded ids of conversations with at least ``least`` answers."""
    return f"""{_ASSISTANT},
r AS (
  SELECT *, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1
                 THEN text || '<|im_end|>'
                 ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' END AS rendered
  FROM m WHERE n >= {least}),
x AS (
  SELECT conv_id AS row_idx,
         coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (turn < l), '')
           || '<|im_start|>assistant' || chr(10) AS prompt,
         max(text) FILTER (turn = l) AS chosen, max(text) FILTER (turn = f) AS rejected
  FROM r GROUP BY conv_id),
i AS (
  SELECT row_idx, chosen AS reference_response, {_ids('prompt')} AS p,
         {_ids("chosen || '<|im_end|>'")} AS c, {_ids("rejected || '<|im_end|>'")} AS r
  FROM x),
k AS (
  SELECT row_idx, reference_response,
         p[greatest(len(p) - {_PROMPT} + 1, 1):] AS p, c, r
  FROM i),
e AS (
  SELECT row_idx, reference_response, p,
         c[1:{_LENGTH} - len(p)] AS c, r[1:{_LENGTH} - len(p)] AS r
  FROM k)"""


def _fill(value: str, size: str) -> str:
    return f"list_transform(range({size}), lambda z: {value})"


ORACLES["encode_truncate"] = f"""WITH {_examples(2)}
SELECT row_idx, {_spaced('p')} AS prompt_ids, {_spaced('c')} AS chosen_ids,
       {_spaced('r')} AS rejected_ids FROM e"""


def _side_columns(name: str, ids: str) -> str:
    return (
        f"{_spaced(f'p || {ids}')} AS {name}_input_ids, "
        f"{_spaced(_fill('1', f'len(p) + len({ids})'))} AS {name}_attention_mask, "
        f"{_spaced(_fill('-100', 'len(p)') + f' || {ids}')} AS {name}_labels"
    )


ORACLES["labels"] = f"""WITH {_examples(2)}
SELECT row_idx, {_side_columns('chosen', 'c')}, {_side_columns('rejected', 'r')} FROM e"""


def _padded_columns(name: str, ids: str) -> str:
    rest = f"padded_length - len(p) - len({ids})"
    return (
        f"{_spaced(f'p || {ids} || ' + _fill('1', rest))} AS {name}_input_ids, "
        f"{_spaced(_fill('1', f'len(p) + len({ids})') + ' || ' + _fill('0', rest))} AS {name}_attention_mask, "
        f"{_spaced(_fill('-100', 'len(p)') + f' || {ids} || ' + _fill('-100', rest))} AS {name}_labels"
    )


ORACLES["batch_pad_right"] = f"""WITH {_examples(2)},
b AS (SELECT *, (row_number() OVER (ORDER BY row_idx) - 1) // 16 AS batch_id FROM e),
w AS (SELECT *, max(len(p) + greatest(len(c), len(r))) OVER (PARTITION BY batch_id) AS padded_length FROM b)
SELECT row_idx, batch_id, padded_length,
       {_padded_columns('chosen', 'c')},
       {_padded_columns('rejected', 'r')}
FROM w"""
ORACLES["batch_pad_left"] = f"""WITH {_examples(1)},
b AS (SELECT *, (row_number() OVER (ORDER BY row_idx) - 1) // 16 AS batch_id FROM e),
w AS (SELECT *, max(len(p)) OVER (PARTITION BY batch_id) AS longest FROM b)
SELECT row_idx, batch_id, reference_response,
       {_spaced(_fill('1', 'longest - len(p)') + ' || p')} AS prompt_input_ids,
       {_spaced(_fill('0', 'longest - len(p)') + ' || ' + _fill('1', 'len(p)'))} AS prompt_attention_mask
FROM w"""
ORACLES["generation_prompt_ids"] = f"""WITH {_TLDR},
p AS (
  SELECT min(row_idx) AS sample_id,
         {_ids("'<|im_start|>user' || chr(10) || prompt || '<|im_end|><|im_start|>assistant' || chr(10)")} AS ids
  FROM t GROUP BY prompt)
SELECT sample_id, {_spaced('ids[greatest(len(ids) - 255, 1):]')} AS prompt_ids FROM p"""
ORACLES["generate_in_context"] = f"""WITH {_TLDR},
p AS (
  SELECT min(row_idx) AS sample_id,
         least(256, len({_ids("'<|im_start|>user' || chr(10) || prompt || '<|im_end|><|im_start|>assistant' || chr(10)")})) AS n
  FROM t GROUP BY prompt)
SELECT sample_id, n || ' ids, sample 0 | ' || n || ' ids, sample 1' AS outputs FROM p"""
ORACLES["tokenizer_plugin"] = f"""
SELECT doc_id, {_spaced("list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w))")} AS ids
FROM documents"""

# --- sampling and order ----------------------------------------------------

ORACLES["take_proportion"] = """
WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n
           FROM documents)
SELECT doc_id, lang, n_chars FROM r WHERE rn <= round_even(n * 28 / 100.0, 0)"""
ORACLES["seeded_shuffle"] = """
SELECT event_id, row_number() OVER (ORDER BY md5('7|' || event_id), event_id) AS row_no FROM events"""
ORACLES["seeded_shuffle_topn"] = """
SELECT doc_id, lang FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100"""
ORACLES["shuffled_batches"] = """
SELECT event_id, (row_number() OVER (ORDER BY md5('3|' || event_id), event_id) - 1) // 16 AS batch_id
FROM events"""


def _epoch(epoch: int, seed: int = 3, size: int = 16) -> str:
    """Places of an epoch: rounds in turn on both sides, and again while outside the table."""
    push = lambda turn, side: f"('0x' || substr(md5('{seed}|{epoch}|{turn}|' || {side}), 1, 8))::BIGINT"

    def image(source: str) -> str:
        sides = f"SELECT *, x // w AS l, x % w AS r FROM ({source})"
        for turn in range(4):
            moved = f"(l + {push(turn, 'r')}) % h AS l" if turn % 2 == 0 else f"(r + {push(turn, 'l')}) % w AS r"
            sides = f"SELECT * REPLACE ({moved}) FROM ({sides})"
        return f"SELECT event_id, n, h, w, l * w + r AS x FROM ({sides})"

    return (
        f"e{epoch} AS ({image('SELECT * FROM numbered')} UNION ALL {image(f'SELECT * FROM e{epoch} WHERE x >= n')}), "
        f"b{epoch} AS (SELECT event_id, x // {size} AS batch FROM e{epoch} WHERE x < n)"
    )


ORACLES["epoch_shuffled_batches"] = f"""
WITH RECURSIVE c AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS h FROM events),
numbered AS (
  SELECT event_id, n, h, (n + h - 1) // h AS w, row_number() OVER (ORDER BY event_id) - 1 AS x FROM events, c),
{_epoch(0)}, {_epoch(1)}
SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_no, b0.batch AS batch_0, b1.batch AS batch_1
FROM b0 JOIN b1 USING (event_id)"""
ORACLES["row_look_up"] = """
SELECT doc_id, lang, source, (SELECT count(*) FROM documents) AS corpus_rows FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lang)"""
ORACLES["asked_once"] = """
SELECT conv_id, turn, len(string_split(text, ' '))::VARCHAR AS answer FROM conversations"""
ORACLES["running_eval_stats"] = """
WITH c AS (SELECT event_id, value / 3 AS value FROM events)
SELECT event_id, count(value) OVER w AS seen, round(avg(value) OVER w, 6) AS running_mean,
       round(stddev_samp(value) OVER w / sqrt(count(value) OVER w), 6) AS running_std_err
FROM c WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""

# --- generation records ----------------------------------------------------

_GENERATED = """
g AS (
  SELECT conv_id AS sample_id,
         arg_min(text, turn) FILTER (role = 'user') AS question,
         arg_max(text, turn) FILTER (role = 'assistant') AS reference,
         count(*) FILTER (role = 'assistant') AS n_outputs,
         list(text ORDER BY turn) FILTER (role = 'assistant') AS outputs
  FROM conversations GROUP BY conv_id)
"""
ORACLES["generation_records"] = f"""WITH {_GENERATED}
SELECT sample_id, 0::BIGINT AS part, question,
       '<|im_start|>user' || chr(10) || question || '<|im_end|><|im_start|>assistant' || chr(10) AS prompt,
       n_outputs, coalesce(array_to_string(outputs, ' | '), '') AS outputs,
       coalesce(reference, '') AS "references"
FROM g"""

# --- log-probabilities and losses ------------------------------------------

ORACLES["token_logps"] = f"""
WITH e AS (
  SELECT vec_id // 8 AS seq_id, vec_id % 8 AS place, embedding,
         CASE WHEN (vec_id % 8) * 3 < 8 THEN -100
              ELSE {_bits('vec_id::VARCHAR')} % len(embedding) END AS label
  FROM embeddings),
s AS (
  SELECT seq_id, place, embedding, lead(label) OVER (PARTITION BY seq_id ORDER BY place) AS following,
         lead(label, 2) OVER (PARTITION BY seq_id ORDER BY place) AS after
  FROM e),
k AS (
  SELECT seq_id, place AS pos, embedding, CASE WHEN following = -100 THEN 0 ELSE following END AS y,
         following <> -100 OR coalesce(after <> -100, false) AS counted
  FROM s WHERE following IS NOT NULL)
SELECT seq_id, pos, counted::BIGINT AS counted,
       round(CASE WHEN counted THEN embedding[y + 1]::DOUBLE / 0.7::DOUBLE
         - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE / 0.7::DOUBLE)))) ELSE 0 END, 6) AS logp
FROM k"""

_SHARDED = f"""
e AS (
  SELECT vec_id // 8 AS seq_id, vec_id % 8 AS place, embedding,
         CASE WHEN (vec_id % 8) * 3 < 8 THEN -100
              ELSE {_bits('vec_id::VARCHAR')} % len(embedding) END AS label
  FROM embeddings),
s AS (
  SELECT seq_id, place AS pos, embedding, lead(label) OVER (PARTITION BY seq_id ORDER BY place) AS following,
         lead(label, 2) OVER (PARTITION BY seq_id ORDER BY place) AS after
  FROM e),
k AS (
  SELECT seq_id, pos, embedding, CASE WHEN following = -100 THEN 0 ELSE following END AS y,
         following <> -100 OR coalesce(after <> -100, false) AS counted
  FROM s WHERE following IS NOT NULL)"""


def _logp(sign: str, index: str, temperature: str) -> str:
    x = f"{sign}x::DOUBLE / {temperature}::DOUBLE"
    return f"{sign}embedding[{index}]::DOUBLE / {temperature}::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp({x}))))"


ORACLES["sharded_token_logps"] = f"""WITH {_SHARDED}
SELECT seq_id, pos, counted::BIGINT AS counted, round({_logp('', 'y + 1', '0.7')}, 6) AS logp,
       round({_logp('', '4', '1.5')}, 6) AS end_logp
FROM k"""

_TOKENS = f"""{_ASSISTANT},
a AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, text FROM m WHERE n >= 2 AND turn = l
  UNION ALL SELECT conv_id, 'rejected', text FROM m WHERE n >= 2 AND turn = f),
z AS (SELECT pair_id, side, len(regexp_extract_all(text, {_lit(fixed.TOKEN_PATTERN)})) AS n FROM a),
q AS (SELECT pair_id, side, n, unnest(range(n)) AS t FROM z WHERE n > 0),
lp AS (
  SELECT pair_id, side, n, t, t * 3 >= n AS counted,
         -4 * {_u("concat_ws('|', pair_id || ':' || side, t, 'policy_logp')")} AS pi,
         -4 * {_u("concat_ws('|', pair_id || ':' || side, t, 'ref_logp')")} AS rho,
         -4 * {_u("concat_ws('|', pair_id || ':' || side, t, 'policy_eos_logp')")} AS pe,
         -4 * {_u("concat_ws('|', pair_id || ':' || side, t, 'ref_eos_logp_gamma')")} AS re
  FROM q)"""
ORACLES["sequence_logp"] = f"""WITH {_TOKENS}
SELECT pair_id, side, round(sum(pi), 6) AS logp_sum, round(avg(pi), 6) AS logp_mean
FROM lp WHERE counted GROUP BY pair_id, side"""
ORACLES["policy_reference_join"] = f"""WITH {_TOKENS}
SELECT pair_id, side, round(sum(pi), 6) AS policy, round(sum(rho), 6) AS ref
FROM lp WHERE counted GROUP BY pair_id, side"""
ORACLES["sft_nll"] = f"""WITH {_TOKENS.replace("n >= 2", "n >= 1")},
b AS (
  SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch_id
  FROM z WHERE side = 'chosen' AND n > 0)
SELECT batch_id, count(*) AS n_tokens, round(-sum(pi) / count(*), 6) AS loss
FROM lp JOIN b USING (pair_id) WHERE side = 'chosen' AND counted GROUP BY batch_id"""


def _pairs(reduce: str) -> str:
    return f"""{_TOKENS},
p AS (
  SELECT pair_id, {reduce}(pi) FILTER (side = 'chosen') AS pc, {reduce}(pi) FILTER (side = 'rejected') AS pr,
         {reduce}(rho) FILTER (side = 'chosen') AS rc, {reduce}(rho) FILTER (side = 'rejected') AS rr
  FROM lp WHERE counted GROUP BY pair_id),
zz AS (SELECT *, (pc - pr) - (rc - rr) AS margin_logit FROM p)"""


def _log_sigmoid(x: str) -> str:
    return f"(-(greatest(-({x}), 0) + ln(1 + exp(-abs({x})))))"


ORACLES["dpo_sigmoid"] = f"""WITH {_pairs('sum')}
SELECT pair_id, round(margin_logit, 6) AS margin_logit,
       round(-{_log_sigmoid('0.1::DOUBLE * margin_logit')} * 0.9::DOUBLE
             - {_log_sigmoid('-0.1::DOUBLE * margin_logit')} * 0.1::DOUBLE, 6) AS loss
FROM zz"""
ORACLES["registered_loss"] = f"""WITH {_pairs('sum')}
SELECT pair_id, 'dpo' AS score_name, round(greatest(0.0::DOUBLE, 1 - 0.1::DOUBLE * margin_logit), 6) AS loss FROM zz"""
ORACLES["dpo_ipo"] = f"""WITH {_pairs('avg')}
SELECT pair_id, round(margin_logit, 6) AS margin_logit,
       round(pow(margin_logit - 5, 2), 6) AS loss FROM zz"""
# Phi(-a) = exp(-a*a/2) / sqrt(2 pi) * integral over t >= 0 of exp(-t*t/2 - a*t),
# by Simpson's rule; Phi(a) = 1 - Phi(-a).
ORACLES["dpo_normcdf"] = f"""WITH {_pairs('sum')},
y AS (SELECT pair_id, margin_logit, 0.1::DOUBLE * margin_logit AS x FROM zz),
st AS (SELECT range AS k FROM range(0, 4001)),
tail AS (
  SELECT pair_id, margin_logit, x,
         ln(sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
             * exp(-pow(k * 0.003::DOUBLE, 2) / 2 - abs(x) * k * 0.003::DOUBLE)) * 0.001::DOUBLE)
           - x * x / 2 - ln(2 * pi()) / 2 AS ln_tail
  FROM y, st GROUP BY pair_id, margin_logit, x)
SELECT pair_id, round(margin_logit, 6) AS margin_logit,
       round(CASE WHEN x < 0 THEN -ln_tail ELSE -ln(1 - exp(ln_tail)) END, 6) AS loss
FROM tail"""

_REWARDS = f"""{_pairs('sum')},
b AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch_id FROM zz),
s2 AS (
  SELECT batch_id, -{_log_sigmoid('0.1::DOUBLE * margin_logit')} AS loss,
         0.1::DOUBLE * (pc - rc) AS c, 0.1::DOUBLE * (pr - rr) AS r, pc, pr
  FROM b)"""
ORACLES["reward_metrics"] = f"""WITH {_REWARDS}
SELECT batch_id, round(avg(loss), 6) AS loss, round(avg(c), 6) AS rewards_chosen,
       round(avg(r), 6) AS rewards_rejected, round(avg(c + r), 6) AS rewards,
       round(avg(CASE WHEN c > r THEN 1.0::DOUBLE ELSE 0 END), 6) AS rewards_accuracy,
       round(avg(c - r), 6) AS rewards_margin, round(avg(pc), 6) AS logps_chosen,
       round(avg(pr), 6) AS logps_rejected
FROM s2 GROUP BY batch_id"""
ORACLES["reward_metrics_by_batch"] = f"""WITH {_REWARDS}
SELECT batch_id, round(avg(loss), 6) AS loss, round(sum(c), 6) AS rewards_chosen,
       round(sum(r), 6) AS rewards_rejected, round(sum(c) + sum(r), 6) AS rewards,
       CASE WHEN sum(c) > sum(r) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rewards_accuracy,
       round(sum(c) - sum(r), 6) AS rewards_margin, round(sum(pc), 6) AS logps_chosen,
       round(sum(pr), 6) AS logps_rejected
FROM s2 GROUP BY batch_id"""

_FLOW = f"""{_TOKENS},
lm AS (SELECT *, max(t) FILTER (counted) OVER (PARTITION BY pair_id, side) AS last FROM lp),
rw AS (
  SELECT pair_id, side, t, counted, CASE WHEN counted THEN pi ELSE 0 END AS pi, pe,
         CASE WHEN counted THEN rho ELSE 0 END AS rho,
         CASE WHEN counted THEN rho ELSE 0 END + re
           + CASE WHEN t = last AND side = 'rejected' THEN -8 * 0.1::DOUBLE ELSE 0 END AS reward
  FROM lm),
fl AS (
  SELECT *, reward - pe AS f, lead(reward - pe) OVER (PARTITION BY pair_id, side ORDER BY t) AS f_next
  FROM rw),
fs AS (
  SELECT pair_id, side,
         coalesce(sum(pow(f - f_next + pi, 2)) FILTER (counted AND f_next IS NOT NULL), 0) AS residual_loss,
         sum(reward) / count(*) FILTER (counted) AS reward,
         sum(pi - rho) AS kl
  FROM fl GROUP BY pair_id, side)"""
ORACLES["flow_from_logits"] = f"""WITH {_SHARDED},
lp AS (
  SELECT seq_id AS pair_id, CASE WHEN seq_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, pos AS t, counted,
         {_logp('', 'y + 1', '0.7')} AS pi, {_logp('-', 'y + 1', '0.7')} AS rho,
         {_logp('', '4', '1.0')} AS pe, {_logp('-', '4', '2.0')} AS re
  FROM k){_FLOW.removeprefix(_TOKENS)}
SELECT pair_id, side, round(residual_loss, 6) AS residual_loss, round(reward, 6) AS reward, round(kl, 6) AS kl FROM fs"""
for _name, _column in (("flow_residual", "residual_loss"), ("flow_rewards", "reward"), ("flow_kl", "kl")):
    ORACLES[_name] = f"WITH {_FLOW} SELECT pair_id, side, round({_column}, 6) AS {_column} FROM fs"
ORACLES["flow_metrics"] = f"""WITH {_FLOW}
SELECT round(avg(residual_loss), 6) AS loss, round(sum(kl), 6) AS kl, round(avg(reward), 6) AS rewards,
       round(avg(reward) FILTER (side = 'chosen'), 6) AS chosen_rewards,
       round(avg(reward) FILTER (side = 'rejected'), 6) AS rejected_rewards
FROM fs"""

# --- judged win rate -------------------------------------------------------


def _asked(task: str, mode: str | None, n: int, records: str = _GENERATED) -> str:
    opening, before_a, before_b, closing = (_lit(w) for w in fixed.JUDGE_WORDING[(task, mode)])
    query = "'USER: ' || question || chr(10)" if task == "hh" else "question"
    return f"""{records},
o AS (
  SELECT sample_id, question, reference, unnest(outputs) AS response,
         unnest(range(len(outputs))) AS idx
  FROM g WHERE reference IS NOT NULL),
sl AS (
  SELECT *, row_number() OVER (
      PARTITION BY sample_id ORDER BY md5(concat_ws('|', '0', 'out', sample_id, idx))) AS slot
  FROM o),
rq AS (
  SELECT sample_id, slot, sample_id || '|' || slot AS request_id, response, reference, question,
         ({_bits("concat_ws('|', '0', 'ab', sample_id, slot)")}) % 2 = 0 AS is_a
  FROM sl WHERE slot <= {n}),
pt AS (
  SELECT *, {opening} || {query} || {before_a} || CASE WHEN is_a THEN response ELSE reference END
         || {before_b} || CASE WHEN is_a THEN reference ELSE response END || {closing} AS judge_prompt
  FROM rq)"""


for _name, _args in (
    ("judge_requests", ("hh", None, 2)),
    ("judge_requests_concise", ("tldr", "concise", 1)),
    ("judge_requests_simple", ("tldr", "simple", 1)),
):
    ORACLES[_name] = f"""WITH {_asked(*_args)}
SELECT sample_id, slot, request_id, is_a::BIGINT AS response_is_a, judge_prompt FROM pt"""


def _judged(n: int, records: str = _GENERATED) -> str:
    return f"""{_asked('hh', None, n, records)},
cm AS (
  SELECT *, CASE WHEN {_u('request_id')} < 0.45::DOUBLE THEN 'More helpful: A'
                 WHEN {_u('request_id')} < 0.9::DOUBLE THEN 'More helpful: B'
                 WHEN {_u('request_id')} < 0.95::DOUBLE THEN 'More helpful: "A"'
                 ELSE 'no verdict' END AS completion
  FROM pt),
v AS (SELECT *, lower(regexp_extract(completion, '(?i)(more helpful): (.)', 2)) AS verdict FROM cm),
j AS (SELECT *, CASE verdict WHEN 'a' THEN is_a WHEN 'b' THEN NOT is_a END AS win FROM v),
ok AS (
  SELECT sample_id, any_value(reference) AS reference, list(win ORDER BY slot) AS wins
  FROM j GROUP BY sample_id HAVING count(win) = {n} AND count(*) = {n})"""


ORACLES["judge_verdicts"] = f"""WITH {_judged(2)}
SELECT request_id, verdict, win::BIGINT AS win FROM j"""
ORACLES["judge_plugin"] = f"""WITH {_asked('hh', None, 1)}
SELECT request_id, CASE WHEN length(judge_prompt) % 2 = 0 THEN 'a' ELSE 'b' END AS verdict,
       CASE WHEN length(judge_prompt) % 2 = 0 THEN is_a ELSE NOT is_a END::BIGINT AS win
FROM pt"""
ORACLES["slot_win_rate"] = f"""WITH {_judged(2)},
w AS (SELECT unnest(wins) AS win, unnest(range(2)) AS slot FROM ok)
SELECT slot, round(avg(win::INT), 6) AS win_rate FROM w GROUP BY slot"""
ORACLES["win_rate"] = f"""WITH {_judged(2)},
top AS (SELECT * FROM ok ORDER BY md5('0|' || sample_id), sample_id LIMIT 40),
w AS (SELECT unnest(wins) AS win, unnest(range(2)) AS slot FROM top),
sr AS (SELECT slot, avg(win::INT) AS rate FROM w GROUP BY slot)
SELECT round(avg(rate), 6) AS mean, round(stddev_pop(rate) / sqrt(count(*)), 6) AS std_err,
       round(min(rate), 6) AS "min", round(max(rate), 6) AS "max" FROM sr"""
ORACLES["judged_until_enough"] = f"""WITH {_judged(2)}
SELECT ok.sample_id, rq.reference AS reference_response, array_to_string(wins, ' ') AS wins
FROM ok JOIN rq ON rq.sample_id = ok.sample_id AND rq.slot = 1
ORDER BY md5('0|' || ok.sample_id), ok.sample_id LIMIT 25"""
ORACLES["stream_win_stats"] = f"""WITH {_judged(2)},
w AS (SELECT unnest(wins) AS win, unnest(range(2)) AS slot FROM ok),
sr AS (SELECT slot, avg(win::INT) AS rate FROM w GROUP BY slot)
SELECT 'r0' AS run, (SELECT count(*) FROM ok) AS n, round(avg(rate), 6) AS mean,
       round(stddev_pop(rate) / sqrt(count(*)), 6) AS std_err, round(min(rate), 6) AS "min", round(max(rate), 6) AS "max"
FROM sr"""
ORACLES["running_win_stats"] = f"""WITH {_judged(2)},
o2 AS (SELECT sample_id, wins, row_number() OVER (ORDER BY md5('0|' || sample_id), sample_id) AS row_no FROM ok),
w AS (SELECT sample_id, row_no, unnest(wins) AS win, unnest(range(2)) AS slot FROM o2),
sr AS (SELECT sample_id, row_no, sum(win::INT) OVER (PARTITION BY slot ORDER BY row_no) / row_no AS rate FROM w)
SELECT sample_id, row_no, round(avg(rate), 6) AS mean, round(stddev_pop(rate) / sqrt(count(*)), 6) AS std_err,
       round(min(rate), 6) AS "min", round(max(rate), 6) AS "max" FROM sr GROUP BY sample_id, row_no"""
_FOREIGN = _GENERATED.rstrip().removesuffix(")") + """),
dg AS (
  SELECT * EXCLUDE (sample_id), md5(concat_ws('|',
           '<|im_start|>user' || chr(10) || question || '<|im_end|><|im_start|>assistant' || chr(10),
           coalesce(array_to_string(outputs, '|'), ''), coalesce(reference, ''))) AS texts FROM g),
g2 AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', texts, row_number() OVER (PARTITION BY texts) - 1)), 1, 15))::BIGINT AS sample_id
  FROM dg)
"""
ORACLES["foreign_records_win_rate"] = f"""WITH {_judged(1, _FOREIGN).replace("FROM g WHERE", "FROM g2 WHERE")},
w AS (SELECT unnest(wins) AS win FROM ok)
SELECT round(avg(win::INT), 6) AS mean, 0.0::DOUBLE AS std_err, round(avg(win::INT), 6) AS "min",
       round(avg(win::INT), 6) AS "max", 1::BIGINT AS rejected_lines FROM w"""
ORACLES["comparison_records"] = f"""WITH {_judged(1)}
SELECT sample_id, reference AS reference_response, array_to_string(wins::VARCHAR[], ',') AS wins FROM ok"""
ORACLES["embed_outputs_diversity"] = """
WITH a AS (
  SELECT conv_id AS sample_id, turn, list_transform(
      string_split('a e i o u t n r s', ' '),
      lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE) AS v
  FROM conversations WHERE role = 'assistant'),
n AS (SELECT sample_id, count(*) AS n_outputs FROM a GROUP BY sample_id),
u AS (
  SELECT sample_id, turn, v,
         greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12::DOUBLE) AS norm
  FROM a),
d AS (
  SELECT x.sample_id, 1 - avg(list_dot_product(x.v, y.v) / (x.norm * y.norm)) AS diversity
  FROM u x JOIN u y ON x.sample_id = y.sample_id AND x.turn < y.turn GROUP BY x.sample_id)
SELECT sample_id, n_outputs, round(diversity, 6) AS diversity FROM n LEFT JOIN d USING (sample_id)"""
ORACLES["clean_response"] = """
SELECT doc_id, CASE WHEN regexp_matches(text, '[.!?]')
                    THEN regexp_replace(text, '[^.!?]*$', '') ELSE text END AS cleaned
FROM documents"""

# --- training log ----------------------------------------------------------

_LOG = """
lg AS (
  SELECT event_id // 5000 AS epoch, event_id // 20 AS batch, user_id % 2 AS rank,
         event_type AS metric, value, 16::BIGINT AS n_examples, ts
  FROM events),
rb AS (SELECT epoch, batch, metric, sum(value) AS value FROM lg GROUP BY epoch, batch, metric)
"""
ORACLES["train_interval_means"] = f"""WITH {_LOG},
iv AS (
  SELECT epoch, CASE WHEN batch % 8 = 0 THEN batch ELSE batch + 8 - batch % 8 END AS closing, metric,
         avg(value) AS value, count(*) AS n_batches, max(batch) AS batch
  FROM rb GROUP BY 1, 2, 3)
SELECT 'r0' AS run, epoch, batch, 'train/' || metric AS metric, round(value, 6) AS value, n_batches
FROM iv WHERE batch = closing"""
ORACLES["eval_batch_mean"] = f"""WITH {_LOG},
bm AS (SELECT batch, metric, avg(value) AS value FROM lg GROUP BY batch, metric)
SELECT 'r0' AS run, 'train' AS split, metric, round(avg(value), 6) AS value, 'batch' AS kind
FROM bm GROUP BY metric
UNION ALL
SELECT 'r0', 'train', metric, round(avg(value), 6), 'row' FROM lg GROUP BY metric"""
ORACLES["rank_reduce"] = f"""WITH {_LOG}
SELECT batch, 'train/' || metric AS metric, round(value, 6) AS value FROM rb"""
_COUNTS = f"""{_LOG},
sh AS (SELECT DISTINCT epoch, batch, rank, n_examples FROM lg),
ct AS (SELECT epoch, batch, sum(n_examples)::BIGINT AS n_examples FROM sh GROUP BY epoch, batch)"""
ORACLES["examples_seen"] = f"""WITH {_COUNTS}
SELECT epoch, batch, n_examples,
       (sum(n_examples) OVER (ORDER BY batch) - n_examples)::BIGINT AS examples_seen,
       row_number() OVER (ORDER BY batch) - 1 AS batches_seen,
       row_number() OVER (ORDER BY batch) AS update_steps
FROM ct"""
ORACLES["throughput"] = f"""WITH {_COUNTS},
st AS (SELECT batch, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM lg GROUP BY batch),
sp AS (SELECT batch, CASE WHEN a < z THEN z - a ELSE z - lag(z) OVER (ORDER BY batch) END AS us FROM st)
SELECT batch, n_examples,
       round(CASE WHEN us > 0 THEN n_examples / (us / 1e6::DOUBLE) END, 6) AS examples_per_sec
FROM ct JOIN sp USING (batch)"""
ORACLES["metrics_json"] = """
SELECT 'r0' AS run, event_id // 5000 AS epoch, event_id // 20 AS batch,
       round(avg(value) FILTER (event_type = 'click'), 6) AS click,
       round(avg(value) FILTER (event_type = 'error'), 6) AS error,
       round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase,
       round(avg(value) FILTER (event_type = 'signup'), 6) AS signup,
       round(avg(value) FILTER (event_type = 'view'), 6) AS view
FROM events GROUP BY 2, 3"""
ORACLES["stream_train_metrics"] = """
WITH c AS (SELECT ts, event_type, round(value * 100) AS cents FROM events)
SELECT 'r0' AS run, 'train' AS split, time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type AS metric,
       sum(cents) / count(*) AS cents, count(*) AS n
FROM c GROUP BY ALL"""
