"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from gristmill.llm.decontaminate import SLACK
from gristmill.llm.licenses import PHRASES, TEMPLATES
from gristmill.llm.licenses import _required as required
from gristmill.llm.licenses import _tokens as token_set

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _words(pattern: str, text: str, fold: bool = True) -> str:
    return pattern.format(_FOLD.format(text) if fold else text)


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def licenses_sql() -> str:
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM w, unnest(range(1, len(ws) + 1)) r(i) WHERE {test}")
    templates = ", ".join(f"('{k}', [{_quoted(t)}], {required(len(t), 0.8)})" for k, t in ((k, token_set(v)) for k, v in TEMPLATES.items()))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS MATERIALIZED (SELECT doc_id, {_words(_ALNUM, "text")} AS ws FROM d),
p AS ({" UNION ALL ".join(places)}),
t(name, ts, need) AS (VALUES {templates}),
l AS (SELECT doc_id, list_distinct({_words(_ALNUM, "line")}) AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT doc_id, name, len(list_intersect(ts, ws))::DOUBLE / len(ts) AS share FROM l, t WHERE len(list_intersect(ts, ws)) >= need),
bp AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS b FROM p GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT x, ',' ORDER BY x) AS b FROM (SELECT doc_id, label AS x FROM p UNION SELECT doc_id, name FROM m) GROUP BY doc_id),
bm AS (SELECT doc_id, max(share) AS s FROM m GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, bp.l::BIGINT AS last_word, coalesce(bp.b, '') AS base_labels, coalesce(bl.b, '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(s, 0)::DOUBLE END AS score
FROM w LEFT JOIN bp USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN bm USING (doc_id)"""


def near_duplicates_sql() -> str:
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_words(_SPACED, "coalesce(text, '')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM w, unnest(range(1, len(ws))) r(i) UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
walk(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT x.v, w2.c FROM walk w2 JOIN both_ways x ON x.u = w2.id WHERE w2.c < x.v),
c AS (SELECT id, min(c) AS c FROM walk GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.id = doc_id"""


def warc_sql() -> str:
    digit = "(instr('0123456789abcdef', substr(sha, {0}, 1)) - 1)"
    # the 5 bits from bit 5 i on lie in the two hexadecimal digits from digit 5 i // 4 on
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((({digit.format('i * 5 // 4 + 1')} * 16 + {digit.format('i * 5 // 4 + 2')}) >> (3 - i * 5 % 4)) & 31)::INTEGER, 1)"
    return f"""WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), h AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) || '0' AS sha FROM d),
b AS (SELECT page_id, n, min(page_id) OVER (PARTITION BY sha) AS f, array_to_string(list_transform(range(0, 32), lambda i: {letter}), '') AS digest FROM h)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM b"""


def decontamination_sql() -> str:
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {_words(_ALNUM, "coalesce(text, '')")} AS ws FROM documents), b AS (SELECT item_id, {_words(_ALNUM, "coalesce(text, '')")} AS ws FROM benchmark),
i AS MATERIALIZED (SELECT item_id, least(10, len(ws)) AS m, ws FROM b WHERE len(ws) > 0),
sets AS MATERIALIZED (SELECT row_number() OVER () AS win, item_id, m, s AS words FROM (SELECT DISTINCT item_id, m, list_sort(list_distinct(ws[s:s + m - 1])) AS s FROM i, unnest(range(1, len(ws) - m + 2)) r(s))),
said AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
rare AS (SELECT win, arg_min(w, (c, w)) AS w FROM (SELECT win, unnest(words) AS w FROM sets) JOIN (SELECT w, count(*) AS c FROM said GROUP BY w) USING (w) GROUP BY win),
around AS MATERIALIZED (SELECT doc_id, win, p FROM said JOIN rare USING (w)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM (SELECT doc_id, item_id, words, m + {SLACK} - 1 AS far, p, ws FROM around JOIN sets USING (win) JOIN d USING (doc_id))
  WHERE list_has_all(ws[greatest(1, p - far):p + far], words) AND len(list_filter(range(greatest(1, p - far), p + 1), lambda a: list_has_all(ws[a:a + far], words))) > 0 GROUP BY doc_id),
iw AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(ws[s:s + m - 1], ' ') AS k FROM i, unnest(range(1, len(ws) - m + 2)) r(s)),
dw AS (SELECT doc_id, s, m, array_to_string(ws[s:s + m - 1], ' ') AS k FROM d, (SELECT DISTINCT m FROM i), unnest(range(1, len(ws) - m + 2)) r(s)),
h AS MATERIALIZED (SELECT doc_id, s, m, item_id FROM dw JOIN iw USING (m, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)"""


def substrings_sql() -> str:
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {_words(_SPACED, "coalesce(text, '')", False)} AS ws FROM documents),
k AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(ws) - 18)) r(i)),
x AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM x),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def ranked_search_sql() -> str:
    words = _words(_ALNUM, "coalesce(text, '')")
    return f"""WITH said AS (SELECT doc_id, unnest({words}) AS t FROM documents),
f AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM said GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id), c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
norm AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM n, c),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY t, docs),
q AS (SELECT DISTINCT item_id, unnest({words}) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN norm USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


ORACLES = {"op2_licenses": licenses_sql, "op5_near_duplicates": near_duplicates_sql, "op6_warc": warc_sql, "op8_decontamination": decontamination_sql, "op9_substrings": substrings_sql, "op13_ranked_search": ranked_search_sql}
