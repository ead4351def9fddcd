"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality import ALPHA, DELTA, GOOD_WEIGHT, MAX_REPEAT_PERCENT, MIN_WORDS, RULES, WINDOW

_RENDER = "coalesce(array_to_string(list_transform({0}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '')"
_LOSS = "coalesce(list_sum(list_transform(list_filter({0}, lambda t: t.role = 'assistant'), lambda t: length(coalesce(t.text, '')) + 8)), 0)::BIGINT"

OP3 = f"""
WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
v AS (SELECT conv_id, t, list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].role = 'assistant' THEN i ELSE 0 END)) AS k FROM c),
u AS (SELECT *, coalesce(lead(t[k]) OVER ring, first_value(t[k]) OVER ring) AS reply FROM v WHERE k > 0 WINDOW ring AS (ORDER BY md5(conv_id::VARCHAR), conv_id)),
p AS (SELECT conv_id AS pair_id, t AS c, list_concat(t[1 : k - 1], [reply]) AS r FROM u UNION ALL SELECT conv_id, t, t FROM v WHERE k = 0),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, least(len(c), len(r)))::BIGINT AS n FROM p),
s AS (SELECT pair_id, n, c[1 : n] AS same, c[n + 1 : len(c)] AS c, r[n + 1 : len(r)] AS r FROM q)
SELECT pair_id, n AS n_common, {_RENDER.format('same')} AS prompt, {_RENDER.format('c')} AS chosen, {_RENDER.format('r')} AS rejected,
       {_LOSS.format('c')} AS chosen_loss_chars, {_LOSS.format('r')} AS rejected_loss_chars
FROM s
"""

_WORDS4 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS4} AS w FROM documents),
b AS (SELECT item_id, {_WORDS4} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""


def _quality() -> str:
    rate = ALPHA / len(RULES)
    cells = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {c}::DOUBLE AS cutoff, count(*) FILTER (y = 1) AS n, count(*) FILTER (y = 1 AND m_{r} > {c}::DOUBLE) AS k, "
        f"count(*) FILTER (y = 0 AND m_{r} > {c}::DOUBLE) AS bad FROM evidence GROUP BY stratum"
        for r in RULES for c in RULES[r][2]
    )
    ratios = ", ".join(f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a} / {b}::DOUBLE END AS m_{r}" for r, (a, b, _) in RULES.items())
    grid = sum(len(x[2]) for x in RULES.values())
    tail = (f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}::DOUBLE) + (n - i) * ln(1 - {rate!r}::DOUBLE))))")
    kept = " AND ".join(f"NOT coalesce(m_{r} > (SELECT cutoff FROM best WHERE best.stratum = b.lang AND rule = '{r}'), false)" for r in RULES)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS place FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_shouts,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {ratios} FROM m),
known AS (SELECT doc_id, min(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
evidence AS (SELECT lang AS stratum, b.*, y FROM b JOIN known USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL),
cells AS ({cells}),
certified AS (SELECT * FROM cells WHERE k < n * {rate!r}::DOUBLE AND {tail} <= {DELTA}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM evidence) * {grid})),
best AS (SELECT stratum, rule, arg_max(cutoff, (bad - {GOOD_WEIGHT} * k, cutoff)) AS cutoff FROM certified GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept FROM b
"""


_WINDOW12 = 35
OP12 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + {_WINDOW12 - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {_WINDOW12 - 2})) AS i FROM d WHERE len(w) >= {_WINDOW12})),
t AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
x AS (SELECT DISTINCT r, unnest(range(i, i + {_WINDOW12})) AS p FROM g JOIN t USING (s)),
k AS (SELECT d.r, count(x.p) AS n, string_agg(d.word, ' ' ORDER BY d.p) FILTER (x.p IS NULL) AS kept
      FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN x ON x.r = d.r AND x.p = d.p GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 4) AS s(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : len(w)], ' ') AS y FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, min({'score': ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT, 'k': k, 'l': l.f, 'r': r.f}) AS best
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x JOIN f r ON r.lang = k.lang AND r.phrase = y GROUP BY k.lang, k.phrase, a),
v AS (SELECT lang, phrase, max(a) AS cover FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE len(w) = 3) GROUP BY lang, phrase),
o AS (SELECT s.lang, s.phrase, a, best.l AS l, best.r AS r, best.score AS score FROM s LEFT JOIN v ON v.lang = s.lang AND v.phrase = s.phrase WHERE cover IS NULL OR 100 * cover < 50 * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op3_preference_format": OP3, "op4_winnowing": OP4, "op6_warc": OP6, "op7_quality_rules": _quality(), "op12_substrings": OP12, "op13_collocations": OP13}
