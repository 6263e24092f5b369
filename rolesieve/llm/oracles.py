"""SQL for the queries that SQL can express."""

from __future__ import annotations

from rolesieve.llm import mixing, quality, rollups, secrets, substrings
from rolesieve.llm.common import WORD


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Base 32 of a SHA-1: five bits of the digest for each letter.
OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT, 1)), '')), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY hex)
"""

_REJECTS = " OR ".join(
    f"coalesce({r.rejects.replace(chr(92) * 2, chr(92)).replace('regexp_count(text,', 'matches(text,')}, false)" for r in quality.RULES)

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_text(WORD)}) AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_text(WORD)})) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2])) AS g FROM d WHERE len(w) > 2),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY doc_id),
m AS (SELECT d.doc_id, d.text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n.n, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)),
j AS (SELECT *, {quality.BASE_FAILED} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR {_REJECTS.replace('matches(', 'len(regexp_extract_all(').replace("')", "'))")}) AS kept FROM j
"""

OP4 = """
WITH RECURSIVE v AS (
    SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM v WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""

OP5 = f"""
WITH t AS (
    SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), {_text(rollups.TOKENIZERS['words-1'])})) AS a,
        len(regexp_extract_all(coalesce(text, ''), {_text(rollups.TOKENIZERS['words-2'])})) AS b
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT source, lang, CASE WHEN lang <> 'en' THEN 'words-2' ELSE 'words-1' END AS tokenizer,
    count(*) AS documents, sum(CASE WHEN lang <> 'en' THEN b ELSE a END)::BIGINT AS tokens
FROM t GROUP BY ALL
"""

_SEED = _text(mixing.SEED + ":")
OP6 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_text(WORD)}))::BIGINT AS size, md5({_SEED} || doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, ({list(mixing.WEIGHTS)})[1 + (k - 1) % {len(mixing.WEIGHTS)}] AS w, sum(source_size) OVER () AS total, k FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, k) AS i FROM w),
c AS (SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM o),
f AS (SELECT min(i) AS i FROM c WHERE 3 * source_size * weight >= rest * w),
t AS (SELECT source, source_size, (CASE WHEN c.i < f.i THEN 3 * source_size ELSE w * (SELECT rest FROM c x WHERE x.i = f.i)::DOUBLE / (SELECT weight FROM c x WHERE x.i = f.i) END)::DOUBLE AS target FROM c, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (size * len(list_filter([0, 1, 2], lambda n: 2 * (n * source_size + start) + size < 2 * round_even(target, 0))))::BIGINT AS taken FROM p
"""


def _spans(kind: int, rule: secrets.Rule) -> str:
    """All matches of a rule as structs, places from the lengths of what lies between."""
    pattern = _text(rule.pattern)
    return f"""
SELECT doc_id, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
    'start': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    'kind': {kind}, 'size': length(m[i]), 'value': length(g[i])}}), lambda s: s.value >= {rule.least})) AS s
FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS g, string_split_regex(text, {pattern}) AS b
    FROM t WHERE regexp_matches(text, {pattern}))"""


_KINDS = [r.kind for r in secrets.RULES]
OP7 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(_spans(k, r) for k, r in enumerate(secrets.RULES))}),
f AS (SELECT doc_id, s.kind AS kind, s.start AS start, ({_KINDS})[s.kind + 1] || ':' || s.start::BIGINT || ':' || (s.start + s.size)::BIGINT AS label FROM s),
a AS (SELECT doc_id, string_agg(label, ',' ORDER BY start, kind) AS spans, string_agg(label, ',' ORDER BY start, kind) FILTER (kind < {secrets.BASE}) AS base,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    step = "lambda d, i: xor(d >> 1, 3988292384 * (d & 1))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: list_reduce(range(0, 8), {step}, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"


OP11 = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, length(coalesce(text, ''))::BIGINT AS chars,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, token, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, token) AS p FROM t),
i AS (SELECT c, c - c % 100 AS base, {_crc32('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT i.c, 0 AS own, p, token, chars FROM i JOIN o ON o.c = i.base AND p <= h UNION ALL SELECT i.c, 1, p, token, chars FROM i JOIN o ON o.c = i.c AND p > h),
q AS (SELECT c, chars, row_number() OVER w AS depth, md5(string_agg(token, '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY c ORDER BY own, p)),
a AS (SELECT c, depth, key, chars, coalesce(lag(key) OVER (PARTITION BY c ORDER BY depth), '') AS parent FROM q UNION ALL SELECT c, 0, '', 0, NULL FROM i),
n AS (SELECT key, min(c) AS c, max(depth) AS depth, max(parent) AS parent, max(chars) AS chars, count(*) AS n_convs FROM a GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
s AS (SELECT a.key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars)::BIGINT AS saved_tokens FROM m JOIN a ON a.c = m.c AND a.depth <= m.depth GROUP BY a.key),
e AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max_by(key, depth) AS key FROM a GROUP BY c) GROUP BY key)
SELECT m.c AS conv_id, m.depth, p.c AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN s USING (key) LEFT JOIN e USING (key) LEFT JOIN n p ON p.key = m.parent
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), {_text(WORD)}) AS w FROM documents),
g AS (SELECT n, unnest(range(1, len(w) - {substrings.WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {substrings.WINDOW - 2}), lambda i: md5(array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ')))) AS g
    FROM d WHERE len(w) >= {substrings.WINDOW}),
r AS (SELECT n, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
p AS (SELECT DISTINCT n, i + k AS i FROM r, range(0, {substrings.WINDOW}) x(k)),
x AS (SELECT n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT n, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN p USING (n, i) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (n)
"""

_ENDING = "right(rtrim(text, E' \\t\\n\\x0b\\x0c\\r'), 1)"
# States: 0 before the first turn, 1 after s, 2 after u, 3 after a. Ways through a conversation row by row, the best into each state.
OP13 = f"""
WITH RECURSIVE t AS (
    SELECT conv_id AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations),
d AS (
    SELECT id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(0, CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM t WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, {_ENDING} AS ending FROM d),
f AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY id ORDER BY i) || initial AS pair FROM o),
ins(state, n, at_state, added) AS (VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''), (0, 1, 2, 'U'), (1, 1, 2, 'U'), (2, 1, 3, 'A'), (3, 1, 2, 'U'),
    (0, 2, 3, 'UA'), (1, 2, 3, 'UA'), (2, 2, 2, 'AU'), (3, 2, 3, 'UA')),
k(state, initial, target) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ids AS (SELECT DISTINCT conv_id AS id FROM conversations),
v AS (
    SELECT id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS rep FROM ids
    UNION ALL
    SELECT id, i, state, cost, audit, rep FROM (
        SELECT v.id, f.i, w.target AS state, v.cost + 5 * ins.n + w.cost AS cost, v.audit || repeat('I', ins.n) || w.edit AS audit,
            v.rep || replace(replace(ins.added, 'U', E'\\nuser:'), 'A', E'\\nassistant:') || w.line AS rep
        FROM v JOIN f ON f.id IS NOT DISTINCT FROM v.id AND f.i = v.i + 1 JOIN ins ON ins.state = v.state,
        LATERAL (
            SELECT ins.at_state AS target, 2 AS cost, 'D' AS edit, '' AS line
            UNION ALL SELECT CASE ins.at_state WHEN 2 THEN 3 ELSE 2 END, CASE f.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R',
                E'\\n' || CASE ins.at_state WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text WHERE f.fault IN ('', 'truncated')
            UNION ALL SELECT k.target, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', E'\\n' || f.role || ':' || f.text FROM k
                WHERE k.state = ins.at_state AND k.initial = f.initial AND f.fault IN ('', 'truncated')) w)
    QUALIFY row_number() OVER (PARTITION BY id, state ORDER BY cost, audit) = 1),
n AS (SELECT id, max(i) AS i FROM v GROUP BY id),
e AS (SELECT v.id, cost + 5 * ins.n AS cost, audit || repeat('I', ins.n) AS audit, rep || replace(replace(ins.added, 'U', E'\\nuser:'), 'A', E'\\nassistant:') AS rep
    FROM v JOIN n ON n.id IS NOT DISTINCT FROM v.id AND n.i = v.i JOIN ins USING (state) WHERE ins.at_state IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY v.cost + 5 * ins.n, audit || repeat('I', ins.n)) = 1),
c AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY id)
SELECT e.id AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, cost, audit, sha256(substr(rep, 2)) AS repaired_sha256
FROM e LEFT JOIN c ON c.id IS NOT DISTINCT FROM e.id
"""

ORACLES = {
    "op2_warc": OP2, "op3_quality_rules": OP3, "op4_vector_graph": OP4, "op5_token_rollup": OP5, "op6_mixing": OP6, "op7_secret_scan": OP7,
    "op11_prefix_trie": OP11,
    "op12_substring_dedup": OP12, "op13_structure_repair": OP13,
}
