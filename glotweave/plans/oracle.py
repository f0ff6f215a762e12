"""The same queries in DuckDB SQL."""

from __future__ import annotations

from glotweave.functions.text import LIGATURES, QUOTES_DASHES, THAANA_CLASSICAL, THAANA_MODERN, romanisation
from glotweave.operators.lexicon import DOMAINS

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{_WS}]+'), lambda t: t <> '')"


def _clean_english(c: str) -> str:
    out = f"translate(translate({c}, '‌‍', ''), {_q(QUOTES_DASHES[0])}, {_q(QUOTES_DASHES[1])})"
    for a, b in LIGATURES.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return _strip(f"regexp_replace(lower({out}), '[^a-zA-Z{_WS}]', '', 'g')")


def _clean_thaana(c: str) -> str:
    moved = f"translate(translate({c}, '‌‍', ''), {_q(THAANA_CLASSICAL)}, {_q(THAANA_MODERN)})"
    return _strip(f"regexp_replace({moved}, '[^\\x{{780}}-\\x{{7bf}}{_WS}]', '', 'g')")


def _round(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


_LINES = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no FROM documents)"
_CLEAN = f"{_LINES}, c AS (SELECT *, {_clean_english('line')} AS clean FROM l)"
_FOREIGN = f"""{_LINES}, w AS (SELECT doc_id, source, line_no, {_tokens('line')} AS ws FROM l),
t AS (SELECT doc_id, source, line_no, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)"""
_BENCH = f"""bt AS (SELECT item_id, unnest({_tokens('text')}) AS raw, generate_subscripts({_tokens('text')}, 1)::INT - 1 AS pos FROM benchmark),
b AS (SELECT item_id, pos, regexp_replace(lower(raw), '[^a-z]', '', 'g') AS word FROM bt WHERE regexp_replace(lower(raw), '[^a-z]', '', 'g') <> '')"""
_VOCABS = f"""{_CLEAN}, {_BENCH}, bench AS MATERIALIZED (SELECT DISTINCT word FROM b),
docs AS MATERIALIZED (SELECT DISTINCT unnest({_tokens('clean')}) AS word FROM c WHERE clean <> ''),
names AS (SELECT DISTINCT unnest({_tokens('lower(p_name)')}) AS word FROM part)"""
_KNOWN = f"""{_CLEAN}, {_BENCH}, p AS MATERIALIZED (SELECT DISTINCT word AS src, reverse(word) AS tgt FROM b),
wanted AS MATERIALIZED (SELECT src, tgt, unnest([true, false]) AS source, unnest([src, tgt]) AS word FROM p),
d AS (SELECT unnest({_tokens('clean')}) AS word FROM c WHERE clean <> ''),
known AS MATERIALIZED (SELECT DISTINCT word FROM d WHERE word IN (SELECT word FROM wanted)),
s AS (SELECT src, tgt, bool_or(source) AS in_src, bool_or(NOT source) AS in_tgt FROM wanted WHERE word IN (FROM known) GROUP BY ALL)"""
_SPACE = """e AS (SELECT vec_id::INT AS idx, 'w' || vec_id AS word, embedding::DOUBLE[] AS vec, label FROM embeddings),
s AS (SELECT (idx / 2)::INT AS idx, word, vec, label FROM (SELECT idx - idx % 2 AS idx, word, vec, label, idx % 2 AS r FROM e) WHERE r = 0),
t AS (SELECT (idx / 2)::INT AS idx, word, vec, label FROM (SELECT idx - idx % 2 AS idx, word, vec, label, idx % 2 AS r FROM e) WHERE r = 1)"""


#: As the operators have it: unit vectors are v / (|v| + 1e-9).
_COS = "list_inner_product(q.vec, c.vec) / ((sqrt(list_inner_product(q.vec, q.vec)) + 1e-9) * (sqrt(list_inner_product(c.vec, c.vec)) + 1e-9))"


def _knn(q: str, c: str, k: int, where: str = "true", score: str = _COS, more: str = "") -> str:
    return f"""SELECT * FROM (SELECT q.idx::BIGINT AS q, c.idx::BIGINT AS c, {score} AS score,
      row_number() OVER (PARTITION BY q.idx ORDER BY {score} DESC, c.idx) AS rank FROM {q} q JOIN {c} c ON {where} {more}) WHERE rank <= {k}"""


_RT = f"""n AS ({_knn('t', 't', 10, 'q.idx <> c.idx')}),
p AS (SELECT q, list_slice(list_reverse_sort(list_concat(list(score), [0.0::DOUBLE])), 1, 10) AS best FROM n GROUP BY q),
rt AS (SELECT q::INT AS idx, list_sum(best) / 10.0::DOUBLE AS r_t FROM p)"""


def _forms(c: str) -> str:
    out = f"lower({c})"
    for x in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{x}+', '{x}', 'g')"
    return f"regexp_replace({out}, '[uiea]$', '')"


def _roman(c: str, scheme: str) -> str:
    out = c
    for a, b in romanisation(scheme).items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return out


_TO_THAANA = "".join(chr(0x780 + i) for i in range(26))


def _thaana(c: str) -> str:
    return f"translate({c}, 'abcdefghijklmnopqrstuvwxyz', {_q(_TO_THAANA)})"


def _classical(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJK', {_q(THAANA_CLASSICAL)})"


def _domain(c: str) -> str:
    return f"CASE lower({c}) " + " ".join(f"WHEN {_q(k)} THEN {_q(d)}" for d, keys in DOMAINS.items() for k in keys) + " ELSE 'other' END"


_DOMAIN = _domain("english_word")
_KEYWORDS = sorted(k for keys in DOMAINS.values() for k in keys)
_GAPS = f"""n AS ({_knn('t', 's', 1)}),
g AS (SELECT t.idx, t.label, t.word AS english_word, s.word AS nearest_dhivehi, score FROM n JOIN t ON t.idx = n.q JOIN s ON s.idx = n.c)"""
_UNIT = "list_transform(vec, lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-8))"
_PAIR = "pr AS (SELECT s.idx AS pair_no, s.word AS src, t.word AS tgt, s.vec AS x, t.vec AS y FROM s JOIN t ON s.idx = t.idx)"
_ITEMS = """r AS (SELECT (s.idx // 20)::VARCHAR AS category, s.word AS a, t.word AS b FROM s JOIN t ON s.idx = t.idx),
items AS (SELECT p.category, p.a, p.b, q.a AS c, q.b AS d FROM r p JOIN r q ON p.category = q.category AND p.a <> q.a)"""
_PREDICT = f"""{_ITEMS}, u AS (SELECT idx, word, vec, list_transform(vec, lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-9)) AS u FROM e),
qs AS (SELECT i.*, list_transform(list_zip(ua.u, ub.u, uc.u), lambda z: z[2] + z[3] - z[1]) AS vec
       FROM items i JOIN u ua ON ua.word = i.a JOIN u ub ON ub.word = i.b JOIN u uc ON uc.word = i.c),
pred AS (SELECT category, a, b, c, d, arg_max(word, list_cosine_similarity(qv, vec)) AS predicted FROM
  (SELECT qs.category, qs.a, qs.b, qs.c, qs.d, qs.vec AS qv, e.word, e.vec FROM qs JOIN e ON e.word NOT IN (qs.a, qs.b, qs.c)) GROUP BY category, a, b, c, d)"""
_OUTLIER = """st AS (SELECT idx // 5 AS set_id, idx, word, vec FROM e),
full_sets AS (SELECT set_id, max_by(word, idx) AS gold FROM st GROUP BY set_id HAVING count(*) = 5),
m AS (SELECT a.set_id, a.word, a.idx, avg(list_cosine_similarity(a.vec, b.vec)) AS mean FROM st a JOIN st b ON a.set_id = b.set_id AND a.idx <> b.idx GROUP BY ALL),
o AS (SELECT m.set_id, min_by(word, mean) AS predicted, gold FROM m JOIN full_sets USING (set_id) GROUP BY m.set_id, gold)"""
_RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
_BLOCKS = f"""{_LINES}, n AS (SELECT *, {_strip('line')} AS s FROM l)"""

ORACLE: dict[str, str] = {
    "clean_english": f"WITH {_CLEAN} SELECT doc_id, line_no, clean FROM c WHERE clean <> ''",
    "clean_thaana": f"WITH {_LINES}, c AS (SELECT doc_id, line_no, {_clean_thaana(_classical(_thaana('line')))} AS clean FROM l) SELECT * FROM c WHERE clean <> ''",
    "clean_thaana_stats": f"WITH {_LINES}, c AS (SELECT {_clean_thaana('line')} AS clean FROM l) SELECT count(*) AS raw_lines, count(*) FILTER (clean <> '') AS clean_lines, count(*) FILTER (clean = '') AS dropped_lines FROM c",
    "clean_stats_by_source": f"WITH {_CLEAN} SELECT source, count(*) AS raw_lines, count(*) FILTER (clean <> '') AS clean_lines, count(*) FILTER (clean = '') AS dropped_lines FROM c GROUP BY ROLLUP (source)",
    "detect_script": f"""WITH {_LINES}, d AS (SELECT regexp_matches(line, '[a-zA-Z]') AS lat, regexp_matches(line, '[^\\x00-\\x7F]') AS wide, regexp_matches(line, '[\\x{{780}}-\\x{{7bf}}]') AS th FROM l)
      SELECT CASE WHEN lat AND NOT wide THEN 'latin' WHEN wide AND NOT lat THEN 'foreign' ELSE 'mixed' END AS english_view,
             CASE WHEN th AND NOT lat THEN 'thaana' WHEN lat AND NOT th THEN 'latin' ELSE 'mixed' END AS thaana_view, count(*) AS n FROM d GROUP BY ALL""",
    "foreign_token_contexts": f"""WITH {_FOREIGN} SELECT doc_id, line_no, word, array_to_string(list_slice(ws, greatest(i - 3, 1), i - 1), ' ') AS left_context,
      array_to_string(list_slice(ws, i + 1, i + 3), ' ') AS right_context FROM t WHERE regexp_matches(word, '[^\\x00-\\x7F]')""",
    "conversation_token_contexts": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations), w AS (SELECT {_tokens('line')} AS ws FROM l),
      t AS (SELECT len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
      SELECT least(i - 1, 3)::INT AS n_left, least(n - i, 3)::INT AS n_right, count(*) AS n, count(DISTINCT word) AS n_words FROM t WHERE regexp_full_match(word, '[a-zA-Z]+') GROUP BY ALL""",
    "foreign_tokens_topk": f"WITH {_FOREIGN} SELECT lower(word) AS token, count(*) AS n FROM t WHERE regexp_matches(word, '[^\\x00-\\x7F]') GROUP BY ALL ORDER BY n DESC, token LIMIT 20",
    "latin_token_counts": f"WITH {_FOREIGN} SELECT lower(word) AS token, count(*) AS n FROM t WHERE regexp_full_match(word, '[a-zA-Z]+') GROUP BY ALL",
    "unique_foreign_tokens": f"WITH {_FOREIGN} SELECT count(DISTINCT lower(word)) AS unique_tokens, count(*) AS total_tokens FROM t WHERE regexp_matches(word, '[^\\x00-\\x7F]')",
    "merge_sentences": f"""WITH {_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS rn FROM n WHERE s <> ''),
      g AS (SELECT doc_id, rn // 5 AS block_id, {_tokens("string_agg(s, ' ' ORDER BY rn)")} AS ws FROM r GROUP BY ALL)
      SELECT doc_id, block_id, len(ws)::BIGINT AS n_tokens, array_to_string(ws, ' ') AS line FROM g""",
    "merge_sentences_stream": f"""WITH {_BLOCKS}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS rn FROM n WHERE s <> ''),
      g AS (SELECT rn // 5 AS block_id, {_tokens("string_agg(s, ' ' ORDER BY rn)")} AS ws FROM r GROUP BY ALL)
      SELECT block_id, len(ws)::BIGINT AS n_tokens, array_to_string(ws, ' ') AS line FROM g""",
    "vocab_min_count": f"""WITH {_CLEAN}, w AS (SELECT unnest({_tokens('clean')}) AS word FROM c WHERE clean <> ''), v AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 3)
      SELECT (row_number() OVER (ORDER BY n DESC, word) - 1)::INT AS idx, word, n FROM v""",
    "vocab_semi": f"WITH {_KNOWN} SELECT src, tgt FROM p JOIN s USING (src, tgt) WHERE in_src AND in_tgt",
    "vocab_anti": f"WITH {_VOCABS} SELECT word FROM docs ANTI JOIN (FROM bench UNION ALL FROM names) x USING (word)",
    "vocab_missing": f"""WITH {_KNOWN} SELECT src, tgt, CASE WHEN NOT coalesce(in_src, false) AND NOT coalesce(in_tgt, false) THEN 'both'
      WHEN NOT coalesce(in_src, false) THEN 'source' ELSE 'target' END AS side FROM p LEFT JOIN s USING (src, tgt) WHERE NOT coalesce(in_src AND in_tgt, false)""",
    "seed_split": f"""WITH {_SPACE}, p AS (SELECT idx AS pair_no, word AS src, 'w' || (idx * 2 + 1) AS tgt FROM s),
      r AS (SELECT pair_no, row_number() OVER (ORDER BY md5(concat_ws('|', '42', pair_no, src, tgt))) - 1 AS place, count(*) OVER () AS n FROM p)
      SELECT pair_no, CASE WHEN place < greatest(10, floor(n * 0.8)) THEN 'train' ELSE 'test' END AS part FROM r""",
    "seed_split_sizes": f"WITH {_BENCH} SELECT least(count(*), greatest(10, floor(count(*) * 0.8)))::BIGINT AS n_train, (count(*) - least(count(*), greatest(10, floor(count(*) * 0.8))))::BIGINT AS n_test FROM b",
    "phonetic_pairs": f"""WITH {_BENCH}, p AS (SELECT *, lead(word) OVER (PARTITION BY item_id ORDER BY pos) AS next FROM b), f AS (SELECT *, {_forms('word')} AS x, {_forms('next')} AS y FROM p WHERE next IS NOT NULL)
      SELECT item_id, pos, word, next, {_round('1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y), 1)')} AS similarity FROM f""",
    "romanise": f"WITH {_BENCH}, w AS (SELECT DISTINCT {_thaana('word')} AS thaana FROM b) SELECT thaana, {_roman('thaana', 'default')} AS romanised, {_roman('thaana', 'full')} AS romanised_full FROM w",
    "transliterate_lines": f"""WITH w AS (SELECT item_id, {_tokens('text')} AS ws FROM benchmark)
      SELECT item_id, array_to_string(list_transform(ws, lambda t, i: CASE WHEN i % 2 = 1 THEN {_roman(_thaana('lower(t)'), 'full')} ELSE lower(t) END), ' ') AS line FROM w""",
    "diagnose_vocab": "SELECT vec_id::INT AS idx, 'w' || vec_id AS word FROM embeddings WHERE vec_id < 50",
    "norm_only": f"WITH {_SPACE}, u AS (SELECT idx, sqrt(list_inner_product(vec, vec)) AS n, {_UNIT} AS u FROM e) SELECT idx, {_round('n')} AS norm, {_round('u[1]')} AS first, {_round('list_sum(u)')} AS total FROM u",
    "center": f"""WITH {_SPACE}, u AS (SELECT idx, {_UNIT} AS u FROM e), m AS (SELECT avg(u[1]) AS a, avg(u[-1]) AS z FROM u)
      SELECT idx, {_round('u[1] - a')} AS first, {_round('u[-1] - z')} AS last FROM u, m""",
    "covariance": f"""WITH {_SPACE}, x AS (SELECT idx, unnest(vec) AS v, generate_subscripts(vec, 1)::INT - 1 AS k FROM e)
      SELECT a.k AS i, b.k AS j, {_round('covar_samp(a.v, b.v)', 8)} AS cov FROM x a JOIN x b ON a.idx = b.idx GROUP BY a.k, b.k""",
    "gap_scan": f"WITH {_SPACE}, {_GAPS} SELECT english_word, nearest_dhivehi, {_round('score', 4)} AS cosine_sim, score < 0.35 AS is_gap, {_DOMAIN} AS domain FROM g",
    "gap_by_domain": f"""WITH {_SPACE}, {_GAPS} SELECT label::VARCHAR AS domain, count(*) AS n_words, count(*) FILTER (score < 0.35) AS n_gaps,
      {_round('(count(*) FILTER (score < 0.35))::DOUBLE / count(*)')} AS gap_rate FROM g GROUP BY ROLLUP (label::VARCHAR)""",
    "gap_scan_excluding": f"WITH {_SPACE}, {_GAPS} SELECT english_word, nearest_dhivehi, {_round('score', 4)} AS cosine_sim, score < 0.4 AS is_gap, {_DOMAIN} AS domain FROM g WHERE idx < 10000 AND idx % 7 <> 0",
    "loan_scan": f"""WITH {_SPACE}, j AS (SELECT *, idx % 2 = 0 AS dv, translate(idx::VARCHAR, '0123456789', 'bdfklmnrst') AS digits FROM e),
      x AS (SELECT idx, vec, dv, CASE WHEN dv THEN translate(digits || 'a', 'bdfklmnrstau', 'ބދފކލމނރސތއު') ELSE digits || CASE WHEN label % 2 = 0 THEN 'a' ELSE 'u' END END AS w FROM j),
      d AS (SELECT *, {_roman('w', 'default')} AS romanised, idx % 50 = 0 AS entity FROM x WHERE dv),
      n AS ({_knn('d', 'x', 60, 'q.idx <> c.idx AND NOT q.entity')}),
      k AS (SELECT n.q, n.score, n.rank, x.w AS english, d.romanised, row_number() OVER (PARTITION BY n.q ORDER BY n.rank) AS r FROM n JOIN x ON x.idx = n.c AND NOT x.dv JOIN d ON d.idx = n.q),
      f AS (SELECT *, {_forms('romanised')} AS y, {_forms('english')} AS z FROM k WHERE r <= 20),
      h AS (SELECT *, 1 - levenshtein(y, z)::DOUBLE / greatest(length(y), length(z), 1) AS phon FROM f),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY phon DESC, rank) AS best FROM h WHERE phon > 0) WHERE best = 1)
      SELECT d.idx, d.romanised, CASE WHEN entity THEN 'named_entity' WHEN phon >= 0.3 AND score >= 0.2 THEN 'loanword' ELSE 'native_dhivehi' END AS category,
             coalesce(english, '') AS best_english_match, {_round('coalesce(phon, 0)', 4)} AS phonetic_score, {_round('coalesce(score, 0)', 4)} AS embed_score
      FROM d LEFT JOIN b ON b.q = d.idx""",
    "knn_top10": f"WITH {_SPACE}, n AS ({_knn('e', 'e', 10, 'q.idx <> c.idx')}) SELECT q, c, rank::INT AS rank, {_round('score')} AS score FROM n",
    "knn_pruned_top10": f"WITH {_SPACE}, n AS ({_knn('e', 'e', 10, 'q.idx <> c.idx')}) SELECT q, c, rank::INT AS rank, {_round('score')} AS score FROM n",
    "csls_rt": f"WITH {_SPACE}, {_RT} SELECT idx, {_round('r_t')} AS r_t FROM rt",
    "csls_topk": f"WITH {_SPACE}, {_RT}, k AS ({_knn('s', 't', 5, 'true', f'2 * {_COS} - rt.r_t', 'JOIN rt ON rt.idx = c.idx')}) SELECT q, c, rank::INT AS rank, {_round('score')} AS score FROM k",
    "heldout_p_at_k": f"""WITH {_SPACE}, {_RT}, {_PAIR},
      k1 AS ({_knn('s', 't', 50)}), k2 AS ({_knn('s', 't', 50, 'true', f'2 * {_COS} - rt.r_t', 'JOIN rt ON rt.idx = c.idx')}),
      h AS (SELECT pair_no, list_cosine_similarity(x, y) AS gold, k1.rank AS a, k2.rank AS b FROM pr LEFT JOIN k1 ON k1.q = pair_no AND k1.c = pair_no LEFT JOIN k2 ON k2.q = pair_no AND k2.c = pair_no),
      m AS (SELECT 'n_test_pairs' AS metric, count(*)::DOUBLE AS value FROM h UNION ALL SELECT 'mean_cosine_gold', avg(gold) FROM h
        UNION ALL SELECT 'cosine_P@' || k, avg((coalesce(a, 999) <= k)::INT) FROM h, (VALUES (1), (5), (10), (50)) v(k) GROUP BY k
        UNION ALL SELECT 'csls_P@' || k, avg((coalesce(b, 999) <= k)::INT) FROM h, (VALUES (1), (5), (10), (50)) v(k) GROUP BY k)
      SELECT metric, {_round('value')} AS value FROM m""",
    "rsa": f"""WITH {_SPACE}, {_PAIR}, d AS (SELECT 1 - list_cosine_similarity(a.x, b.x) AS dx, 1 - list_cosine_similarity(a.y, b.y) AS dy FROM pr a JOIN pr b ON a.pair_no < b.pair_no),
      k AS (SELECT dx, dy, {_RANKS.format('dx')} AS rx, {_RANKS.format('dy')} AS ry FROM d)
      SELECT (SELECT count(*) FROM pr) AS rsa_n_pairs, {_round('corr(dx, dy)')} AS rsa_pearson, {_round('corr(rx, ry)')} AS rsa_spearman FROM k""",
    "hubness_skew": f"""WITH {_SPACE}, n AS ({_knn('e', 'e', 10, 'q.idx <> c.idx')}), k AS (SELECT c, count(*) AS n FROM n GROUP BY c),
      h AS (SELECT coalesce(n, 0)::DOUBLE AS n FROM e LEFT JOIN k ON k.c = e.idx), m AS (SELECT avg(n) AS mu FROM h)
      SELECT {_round('avg((n - mu) ** 3) / avg((n - mu) ** 2) ** 1.5')} AS skew FROM h, m""",
    "coherence": f"""WITH {_SPACE}, n AS ({_knn('e', 'e', 10, 'q.idx <> c.idx')}),
      v AS (SELECT n.q, e.vec FROM n JOIN e ON e.idx = n.c), x AS (SELECT q, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM v),
      m AS (SELECT q, list(x ORDER BY k) AS m FROM (SELECT q, k, avg(x) AS x FROM x GROUP BY ALL) GROUP BY q)
      SELECT 'w' || v.q AS word, {_round('avg(list_inner_product(vec, m) / (sqrt(list_inner_product(vec, vec)) * (sqrt(list_inner_product(m, m)) + 1e-10)))', 4)} AS coherence
      FROM v JOIN m ON m.q = v.q GROUP BY v.q UNION ALL SELECT 'unknown', NULL""",
    "outlier": f"WITH {_SPACE}, {_OUTLIER} SELECT set_id, predicted, gold, predicted = gold AS correct FROM o",
    "outlier_accuracy": f"WITH {_SPACE}, {_OUTLIER} SELECT count(*) AS n_sets, {_round('avg((predicted = gold)::INT)')} AS accuracy FROM o",
    "analogy_items": f"WITH {_SPACE}, {_ITEMS} SELECT * FROM items",
    "analogy_eval": f"WITH {_SPACE}, {_PREDICT} SELECT * FROM pred",
    "analogy_accuracy": f"""WITH {_SPACE}, {_PREDICT} SELECT category, count(*) AS n_items, 0::BIGINT AS n_skipped, count(*) FILTER (predicted = d) AS n_correct, count(*) AS n_evaluated,
      {_round('avg((predicted = d)::INT)')} AS accuracy FROM pred GROUP BY ROLLUP (category)""",
    "analogy_sections": f"""WITH {_SPACE}, {_PREDICT} SELECT category::VARCHAR AS section, count(*) FILTER (predicted = d) AS n_correct, count(*) AS n_evaluated,
      {_round('avg((predicted = d)::INT)')} AS accuracy FROM pred GROUP BY ROLLUP (category) UNION ALL SELECT 'lost', 0, 0, NULL""",
    "kmeans_fit": "SELECT count(*) AS n, count(DISTINCT label) AS clusters, true AS nearer FROM embeddings",
    "word_similarity": f"""WITH {_SPACE}, {_PAIR}, k AS (SELECT ((pair_no * 37) % 101)::DOUBLE AS score, list_cosine_similarity(x, y) AS cos FROM pr),
      r AS (SELECT *, {_RANKS.format('score')} AS rs, {_RANKS.format('cos')} AS rc FROM k)
      SELECT count(*) AS n, {_round('corr(score, cos)')} AS pearson_r, {_round('corr(rs, rc)')} AS spearman_r, {_round('100.0 / (count(*) + 1)')} AS oov_ratio FROM r""",
    "aligned_space": f"""WITH {_SPACE}, n AS (SELECT count(*)::INT AS n FROM s) SELECT 'dv' AS lang, idx, word, 'dv_' || word AS key, {_round('vec[1]')} AS first FROM s
      UNION ALL SELECT 'en', idx + n, word, 'en_' || word, {_round('vec[1]')} FROM t, n""",
    "vec_lines": f"WITH {_SPACE} SELECT -1::BIGINT AS idx, count(*) || ' ' || max(len(vec)) AS line FROM e UNION ALL SELECT idx::BIGINT, word || ' ' || array_to_string(list_transform(vec, lambda x: printf('%.6f', x)), ' ') FROM e",
    "word_domains": f"""WITH {_SPACE}, k AS (SELECT idx, [{', '.join(_q(k) for k in [*_KEYWORDS, 'unknown'])}][idx % {len(_KEYWORDS) + 1} + 1] AS word, label FROM e),
      w AS (SELECT idx, CASE WHEN label % 2 = 0 THEN upper(word) ELSE word END AS word FROM k) SELECT idx, word, {_domain('word')} AS domain FROM w""",
    "procrustes_invariants": """WITH d AS (SELECT unnest(range(len(embedding)))::INT AS k FROM (FROM embeddings LIMIT 1)) SELECT 'orthogonal' AS mode, a.k AS i, b.k AS j, (a.k = b.k)::INT::DOUBLE AS value FROM d a, d b
      UNION ALL SELECT 'linear', a.k, b.k, 0.0::DOUBLE FROM d a, d b""",
    "whitened_covariance": "WITH d AS (SELECT unnest(range(len(embedding)))::INT AS k FROM (FROM embeddings LIMIT 1)) SELECT a.k AS i, b.k AS j, (a.k = b.k)::INT::DOUBLE AS cov FROM d a, d b",
    "spectrum_sums": f"""WITH {_SPACE}, x AS (SELECT 'source' AS side, idx, unnest(vec) AS v, generate_subscripts(vec, 1) AS k FROM s WHERE idx < 10000
        UNION ALL SELECT 'target', idx, unnest(vec), generate_subscripts(vec, 1) FROM t WHERE idx < 10000),
      g AS (SELECT a.side, a.k AS i, b.k AS j, sum(a.v * b.v) AS g FROM x a JOIN x b ON a.side = b.side AND a.idx = b.idx GROUP BY ALL)
      SELECT side, {_round('sum(g) FILTER (i = j)', 4)} AS squares, {_round('sum(g * g) / sum(g) FILTER (i = j)', 4)} AS fourths FROM g GROUP BY side""",
    "word2vec_epochs": "SELECT epoch::INT AS epoch, true AS lower FROM range(1, 4) t(epoch)",
    "word2vec": f"""WITH {_CLEAN}, w AS (SELECT unnest({_tokens('clean')}) AS word FROM c WHERE clean <> ''), v AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 3)
      SELECT (row_number() OVER (ORDER BY n DESC, word) - 1)::INT AS idx, word, 150 AS dims, true AS trained FROM v""",
    "explore": f"""WITH {_SPACE}, n AS ({_knn('e', 'e', 10, 'q.idx <> c.idx')}), f AS (SELECT n.q, min_by(e.word, n.rank) AS nearest, max_by(e.word, n.rank) AS tenth FROM n JOIN e ON e.idx = n.c GROUP BY n.q)
      SELECT word, true AS known, {_round('sqrt(list_inner_product(vec, vec))')} AS norm, nearest, tenth FROM e LEFT JOIN f ON f.q = e.idx UNION ALL SELECT 'unknown', false, NULL, NULL, NULL""",
    "merged_tokens": f"""WITH {_BLOCKS}, k AS (SELECT {_tokens('s')} AS ws FROM n WHERE s <> '') SELECT ceil(count(*) / 5.0)::BIGINT AS n_blocks, sum(len(ws))::BIGINT AS n_tokens FROM k""",
}
ORACLE |= {
    "coherence_totals": f"SELECT count(coherence) AS coherence_scored, count(*) - count(coherence) AS coherence_skipped, {_round('avg(coherence)', 4)} AS mean_coherence FROM ({ORACLE['coherence']})",
    "loan_categories": f"SELECT category, count(*) AS n, {_round('100.0 * count(*) / sum(count(*)) OVER ()')} AS percent FROM ({ORACLE['loan_scan']}) GROUP BY category",
}
