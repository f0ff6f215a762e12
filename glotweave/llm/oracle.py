"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP3 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_LEDGER = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), s AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_text_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN s ON s.doc_id IS NOT DISTINCT FROM w.doc_id
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_text_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
"""

OP8 = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       failed = 0 AS kept, failed
FROM f
"""

QUALITY_ABLATIONS = f"""{_LEDGER}, rules AS (
  SELECT * FROM (VALUES ('too_few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32)) v(rule, bit)
)
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_only,
       count(*) FILTER (failed = bit OR failed = 0) AS n_kept_without
FROM f, rules GROUP BY rule
"""

OP4 = f"""
WITH w AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), x AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS low FROM g) WHERE low < doc_id
), m AS (
  SELECT x.doc_id, x.word, x.i, coalesce(x.i - r.i < 13, false) AS gone
  FROM x ASOF LEFT JOIN r ON x.doc_id = r.doc_id AND x.i >= r.i
), s AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM m GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""

def _tokens(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'), "
        "'[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    )


_LOWER = "lower(coalesce(text, ''))"
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
_SPLIT = f"regexp_replace({_LOWER}, '({_UNSPACED})', ' \\1 ', 'g')"


def _seeded(x: str) -> str:
    """Verified pairs by spaced seeds of the token lists in d{x} and b{x}."""

    def seeds(side: str) -> str:
        return f"""
  SELECT id, i, 'a ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+5] || ' ' || ws[i+7] || ' ' || ws[i+8] AS s
  FROM (SELECT id, ws, unnest(range(0, len(ws) - 7)) AS i FROM {side}{x})
  UNION ALL
  SELECT id, i, 'b ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+4] || ' ' || ws[i+7] || ' ' || ws[i+8] || ' ' || ws[i+9] AS s
  FROM (SELECT id, ws, unnest(range(0, len(ws) - 8)) AS i FROM {side}{x})"""

    return f"""
h{x} AS (
  SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.i - bs.i AS shift FROM ({seeds("d")}) ds JOIN ({seeds("b")}) bs USING (s)
), a{x} AS (
  SELECT doc_id, item_id, shift, least(13, len(b.ws)) AS win, j, (b.ws[j + 1] = d.ws[j + shift + 1])::INT AS same
  FROM (
    SELECT h.*, unnest(range(greatest(0, -shift), least(len(b.ws), len(d.ws) - shift))) AS j
    FROM h{x} h JOIN d{x} d ON d.id = h.doc_id JOIN b{x} b ON b.id = h.item_id
  ) h JOIN d{x} d ON d.id = h.doc_id JOIN b{x} b ON b.id = h.item_id
), w{x} AS (
  SELECT doc_id, item_id, win, sum(same) OVER p AS n_agree, count(*) OVER p AS n
  FROM a{x} WINDOW p AS (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)
), f{x} AS (
  SELECT doc_id, item_id, n_agree, win FROM w{x} WHERE n >= win AND n_agree >= win - CASE WHEN win >= 10 THEN floor(win * 2 / 13) ELSE 0 END
)"""


#: Items in scripts without spaces and short ones are sought in tokens that are split further, the short ones whole.
OP7 = f"""
WITH d AS (SELECT doc_id AS id, {_tokens(_LOWER)} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id AS id, {_tokens(_LOWER)} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
b_odd AS (
  SELECT item_id AS id, {_tokens(_SPLIT)} AS ws FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL AND (len({_tokens(_LOWER)}) <= 7 OR regexp_matches(text, '{_UNSPACED}'))
), d_odd AS (
  SELECT doc_id AS id, {_tokens(_SPLIT)} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND (SELECT count(*) FROM b_odd) > 0
), {_seeded("")}, {_seeded("_odd")}, whole AS (
  SELECT DISTINCT p.id AS doc_id, s.id AS item_id, p.n
  FROM (
    SELECT id, n, ws[i : i + n - 1] AS part
    FROM (SELECT id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d_odd, (SELECT DISTINCT len(ws) AS n FROM b_odd WHERE len(ws) BETWEEN 1 AND 7))
  ) p JOIN b_odd s ON s.ws = p.part
)
SELECT doc_id, item_id, max({{'w': win, 'n': n_agree}})['n']::BIGINT AS n_agree, max(win)::BIGINT AS "window"
FROM (SELECT doc_id, item_id, win, n_agree FROM f UNION ALL SELECT doc_id, item_id, win, n_agree FROM f_odd UNION ALL SELECT doc_id, item_id, n, n FROM whole)
GROUP BY doc_id, item_id
"""

#: Without tool calls, which the generated conversations have none of; ``chat_tool_calls`` has them.
OP9 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
g AS (
  SELECT conv_id, turn // 512 AS part, count(*) AS n,
         string_agg('{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || to_json(coalesce(role, 'unknown'))::VARCHAR || '}', ','
                    ORDER BY turn, role, text) AS messages
  FROM t GROUP BY conv_id, turn // 512
)
SELECT conv_id, part, n AS n_messages, 0::BIGINT AS n_calls, 0::BIGINT AS n_bad_calls, 0::BIGINT AS n_orphans,
       '{"conv_id":' || conv_id || ',"messages":[' || messages || '],"part":' || part || '}' AS chat
FROM g
"""

#: Results follow their calls, a call that uses a result comes after it, and what nothing called is only counted.
CHAT_TOOL_CALLS = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (
  SELECT conv_id, turn, 0 AS k, role, text, '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || to_json(role)::VARCHAR || '}' AS message
  FROM t WHERE role <> 'assistant'
  UNION ALL
  SELECT conv_id, turn, 1, role, text, '{"role":"assistant","tool_call":{"arguments":{"limit":' || turn || ',"query":' || to_json(text)::VARCHAR
    || '},"id":"c' || turn || '","name":"search"}},{"content":' || length(text) || ',"role":"tool","tool_call_id":"c' || turn || '"}'
  FROM t WHERE role = 'assistant'
  UNION ALL
  SELECT conv_id, turn, 2, role, text, '{"errors":["no result"],"role":"assistant","tool_call":{"arguments":{"expression":{"$result":"c' || turn
    || '"}},"id":"d' || turn || '","name":"calculate"}}'
  FROM t WHERE role = 'assistant' AND turn >= 3
)
SELECT conv_id, 0::BIGINT AS part, count(*) + count(*) FILTER (k = 1) AS n_messages, count(*) FILTER (k > 0) AS n_calls,
       count(*) FILTER (k = 2) AS n_bad_calls, 0::BIGINT AS n_orphans,
       '{"conv_id":' || conv_id || ',"messages":[' || string_agg(message, ',' ORDER BY turn, role, text, k) || '],"part":0}' AS chat
FROM m GROUP BY conv_id
UNION ALL
SELECT conv_id, 1, 0, 0, 0, count(*), '{"conv_id":' || conv_id || ',"messages":[],"part":1}'
FROM t WHERE turn = 0 AND role = 'user' GROUP BY conv_id
"""

#: Order and offsets are MD5 values of ids, sources and texts.
OP5 = f"""
WITH n AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce('s' || source, '') || chr(1) || coalesce('t' || text, '')), 1, 15))::BIGINT AS fp
  FROM documents
), c AS (
  SELECT *, CASE WHEN size < 1024 THEN size ELSE 1024 + (length(bin(size)) - 11) * 64 + ((size - (1::BIGINT << (length(bin(size)) - 1))) * 64 >> (length(bin(size)) - 1)) END AS class
  FROM n
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM n GROUP BY source
), k AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM k
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target,
         floor(('0x' || substr(md5('17' || chr(1) || coalesce('s' || source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE * source_size)::HUGEINT AS u
  FROM l
), i AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, fp % 256, size, fp, doc_id)::HUGEINT AS i FROM c
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN ((i * floor(target)::HUGEINT + u) // source_size - ((i - 1) * floor(target)::HUGEINT + u) // source_size) * size ELSE 0 END)::BIGINT AS taken
FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source
"""

OP13 = """
WITH g AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS row
  FROM documents
), t AS (
  SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM g
), known AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 10
), lang AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM known GROUP BY ALL
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN known USING (lang, term) GROUP BY ALL
), own AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL
), grp AS (
  SELECT DISTINCT lang, source FROM g
), p AS (
  SELECT grp.lang, grp.source, known.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(own.total, 0) + 2 * lang.v) AS p,
         1 + (1000000000::HUGEINT * (known.n + 2)) // (lang.total + 2 * lang.v) AS q
  FROM grp JOIN known USING (lang) JOIN lang USING (lang)
  LEFT JOIN own ON own.lang = grp.lang AND own.source = grp.source
  LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = known.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), k AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= 10
"""

OP12 = """
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM t
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p
), g AS (
  SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS size FROM starts
), f AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, size, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), k AS (
  SELECT *, unnest(range(1, size)) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, k.a, k, x.n AS l, y.n AS r, (2000000::HUGEINT * k.a) // (x.n + y.n) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k + 1 :], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), sub AS (
  SELECT lang, w, a, size, n, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM c)
), longer AS (
  SELECT lang, array_to_string(w[i : i + n - 1], ' ') AS phrase, max(a) AS most FROM sub GROUP BY ALL
), kept AS (
  SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * most < 80 * a, true)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op5_source_mixing": OP5,
    "op3_line_dedup": OP3,
    "op4_substring_dedup": OP4,
    "op7_decontamination": OP7,
    "op8_quality_rules": OP8,
    "quality_ablations": QUALITY_ABLATIONS,
    "op9_chat_format": OP9,
    "chat_tool_calls": CHAT_TOOL_CALLS,
    "op12_collocations": OP12,
    "op13_source_divergence": OP13,
}
