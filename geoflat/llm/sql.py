"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"

OP5 = rf"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

OP6 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ')
         ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
pairs AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON r.b = e.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(w.doc_id, coalesce(low.m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(low.m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id
"""

_RECORD = r"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || CAST(strlen({0}) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
  || {0} || chr(13) || chr(10) || chr(13) || chr(10)"""

OP1 = f"""
WITH r AS (
  SELECT coalesce(CAST(floor(page_id / 1024) AS BIGINT), -1) AS file, page_id, url,
         sha256({_RECORD.format("coalesce(html, '')")}) AS digest,
         strlen({_RECORD.format("coalesce(html, '')")}) AS length,
         sha256({_RECORD.format("('#' || substr(coalesce(html, ''), 2))")}) AS damaged
  FROM pages),
g AS (SELECT file, page_id, url, digest, length, damaged, count(*) AS copies FROM r GROUP BY ALL),
p AS (
  SELECT *, CAST(coalesce(sum(length * copies) OVER (PARTITION BY file
           ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest, length
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM g)
SELECT file, place AS "offset", page_id,
       CASE WHEN page_id % 131 = 7 THEN 'missing' ELSE 'changed' END AS status,
       digest AS primary_digest, CASE WHEN page_id % 131 = 7 THEN NULL ELSE damaged END AS replica_digest
FROM p WHERE page_id % 131 = 7 OR page_id % 97 = 11
UNION ALL
SELECT file, place + 1, page_id, 'extra', NULL, digest FROM p WHERE page_id % 173 = 3
"""


def op10() -> str:
    """The base counts and both distances, from the constants of ``quality_rules``; a distinct text
    that passes the base rules has one vote, and the pooled reference is over the texts of all
    languages."""
    from . import quality_rules as q

    ws, lists = r"[\x20\x09-\x0D]", q.COMMON_WORDS

    def chars(allowed: str) -> str:
        allowed = allowed.replace("'", "''").replace("\\u00", "\\x")
        return f"length(regexp_replace(t, '[^{allowed}]+', '', 'g'))"

    classes = ", ".join(chars(c) for c in q.CHAR_CLASSES.values())
    words = "CASE known " + " ".join(
        f"WHEN '{k}' THEN [" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in lists.items()) + " END"
    known = ", ".join(f"'{k}'" for k in lists)

    pool = "[" + ", ".join(f"'{w}'" for w in lists["*"]) + "]"

    def half(x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"

    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE '*' END AS known,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 4] AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS MATERIALIZED (
  SELECT w.doc_id, known, t, ws, length(t) AS n_chars, len(ws) AS n_words,
         length(regexp_replace(t, '{ws}+', '', 'g')) AS word_chars, {chars(q.SYMBOLS)} AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         [length(t) - length(regexp_replace(t, '{ws}+', '', 'g')), {classes}] AS ch, {words} AS list
  FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
c AS (SELECT *, list_transform(list, lambda x: len(list_filter(ws, lambda y: y = x))) AS wh FROM b),
h AS MATERIALIZED (
  SELECT doc_id, known, 'c' AS kind, unnest(range(1, len(ch) + 2)) AS i, n_chars AS n,
         list_append(ch, greatest(n_chars - list_sum(ch), 0)) AS counts
  FROM c WHERE n_chars >= {q.MIN_CHARS}
  UNION ALL
  SELECT doc_id, known, 'w', unnest(range(1, len(wh) + 2)), n_words,
         list_append(wh, greatest(n_words - list_sum(wh), 0)) FROM c WHERE n_words >= {q.MIN_WORDS}),
s AS MATERIALIZED (SELECT doc_id, known, kind, i, CAST(counts[i] AS DOUBLE) / n AS p FROM h),
ok AS MATERIALIZED (
  SELECT doc_id, sha256(array_to_string(ws, '')) AS digest, n_words,
         list_transform({pool}, lambda x: len(list_filter(ws, lambda y: y = x))) AS pc
  FROM c WHERE NOT (n_words < {q.MIN_TEXT_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)),
pooled AS (
  SELECT digest, n_words, unnest(range(1, len(pc) + 2)) AS i,
         list_append(pc, greatest(n_words - list_sum(pc), 0)) AS counts
  FROM ok WHERE n_words >= {q.MIN_WORDS}),
votes AS (
  SELECT known, digest, kind, i, p FROM s JOIN ok USING (doc_id) WHERE kind = 'c' OR known <> '*'
  UNION ALL
  SELECT '*', digest, kind, i, p FROM s JOIN ok USING (doc_id) WHERE kind = 'c' AND known <> '*'
  UNION ALL
  SELECT '*', digest, 'w', i, CAST(counts[i] AS DOUBLE) / n_words FROM pooled),
one AS (SELECT known, digest, kind, i, round(sum(CAST(round(p * 1e9) AS BIGINT)) / count(*)) AS v
        FROM votes GROUP BY ALL),
ref AS (SELECT known, kind, i, sum(CAST(v AS BIGINT)) / 1e9 / count(*) AS q FROM one GROUP BY ALL),
js AS (
  SELECT doc_id, kind, sqrt(greatest(sum({half('p')} + {half('q')}) / 2, 0)) AS d
  FROM s JOIN ref USING (known, kind, i) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {q.MIN_TEXT_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {q.MIN_TEXT_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words
            OR coalesce(jc.d > {q.MAX_CHAR_DISTANCE}, false) OR coalesce(jw.d > {q.MAX_WORD_DISTANCE}, false)) AS kept,
       round(jc.d, 6) AS char_distance, round(jw.d, 6) AS word_distance
FROM c LEFT JOIN (SELECT doc_id, d FROM js WHERE kind = 'c') jc USING (doc_id)
       LEFT JOIN (SELECT doc_id, d FROM js WHERE kind = 'w') jw USING (doc_id)
"""


def op11() -> str:
    """Diagonal voting over the same templates."""
    from . import license_scan as m

    rows = ", ".join(f"({t}, '{label}', {str(exact).lower()}, {n}, {at}, '{gram}')"
                     for t, label, exact, n, at, gram in m.template_grams(m.PHRASES, m.NOTICES))
    return rf"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS src, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{m.UPPER}', '{m.LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t(template, label, exact, t_words, place, t_gram) AS (VALUES {rows}),
g AS (SELECT src, i - 1 AS pos, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT src, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
d AS (SELECT src, template, label, exact, t_words, pos - place AS diagonal, min(pos) AS low, max(pos) AS high,
             list(place) AS places
      FROM g JOIN t ON gram = t_gram GROUP BY ALL),
a AS (SELECT *, CASE WHEN exact OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {m.GAP}
                THEN 1 ELSE 0 END AS apart
      FROM d WINDOW o AS (PARTITION BY src, template ORDER BY diagonal)),
n AS (SELECT *, sum(apart) OVER (PARTITION BY src, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM a),
s AS (SELECT src, template, label, exact, t_words, min(low) AS first_word, max(high) + {m.K} AS end_word,
             len(list_distinct(flatten(list_transform(flatten(list(places)), lambda p: range(p, p + {m.K}))))) AS covered
      FROM n GROUP BY src, template, label, exact, t_words, span),
v AS (SELECT *, covered / t_words AS share,
             CASE WHEN exact THEN covered = t_words
                  ELSE covered / t_words >= {m.MIN_SHARE} AND 2 * covered >= end_word - first_word END AS good FROM s),
r AS (SELECT *, good AND NOT exact AS rival FROM v),
c AS (SELECT *, CASE WHEN coalesce(first_word >= max(end_word) OVER o, true) THEN 1 ELSE 0 END AS open
      FROM r WINDOW o AS (PARTITION BY src, rival ORDER BY first_word, end_word, template
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, sum(open) OVER (PARTITION BY src, rival ORDER BY first_word, end_word, template
                                ROWS UNBOUNDED PRECEDING) AS chain FROM c),
f AS (SELECT *, good AND (exact OR row_number() OVER (PARTITION BY src, rival, chain
                ORDER BY share DESC, covered DESC, label, first_word, template) = 1) AS verified FROM h),
x AS (SELECT src, count(*) FILTER (verified AND exact) AS n_base,
             min(first_word) FILTER (verified AND exact) AS first_word,
             max(first_word) FILTER (verified AND exact) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND exact) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(share) AS score
      FROM f GROUP BY src)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN x USING (src)
"""


def op12() -> str:
    """The cost DP and the least audit as one recursion from the last turn to the first: each state
    holds its cost, padded to ten digits, and the audit, so that the least string is the answer."""

    def best(*ways: str) -> str:
        return f"least({', '.join(ways)})"

    def step(letter: str, cost: str, state: str) -> str:
        return (f"CASE WHEN {cost} IS NOT NULL THEN lpad(CAST(CAST(left({state}, 10) AS BIGINT) + {cost} AS VARCHAR), "
                f"10, '0') || '{letter}' || substr({state}, 11) END")

    cut = "(CASE WHEN f = 3 THEN 3 ELSE 0 END)"
    live = "f NOT IN (1, 2)"
    on = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    to = (2, 2, 3, 2)
    rows = []
    for s in range(4):
        keep = [step("K", f"(CASE WHEN {live} AND i = '{i}' THEN {cut} END)", f"v{t}") for i, t in on[s].items()]
        rows.append(best(step("D", "4", f"v{s}"), step("R", f"(CASE WHEN {live} THEN 3 + {cut} END)", f"v{to[s]}"), *keep)
                    + f" AS r{s}")
    u = best("r2", step("I", "3", "r3"))
    a = best("r3", step("I", "3", "r2"))
    first = [best("r0", step("I", "3", u)), best("r1", step("I", "3", u)), u, a]
    closed = ", ".join(f"{x} AS v{s}" for s, x in enumerate(first))
    return rf"""
WITH RECURSIVE
bits AS (SELECT unnest(range(256)) AS b),
crc_rows AS (SELECT b, list_reduce([CAST(b AS BIGINT)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
               lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM bits),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_rows),
raw AS (SELECT row_number() OVER () AS n, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
        FROM conversations),
fate AS (
  SELECT raw.*, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda j: CAST(ord(k[j]) AS BIGINT)),
           lambda c, x: xor(c // 256, t[1 + (xor(c, x) % 256)])), 4294967295) % 20 AS fate FROM raw, crc_table),
hurt AS (
  SELECT n, conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 0 THEN [] WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fate),
turns AS MATERIALIZED (
  SELECT *, row_number() OVER w AS p, left(role, 1) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n, copy) AS again,
         left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n, copy)),
faults AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN again > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS f FROM turns),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
dp AS (
  SELECT conv_id, n AS p, lpad('', 10, '0') AS v0, '0000000006II' AS v1, '0000000003I' AS v2, lpad('', 10, '0') AS v3
  FROM counts
  UNION ALL
  SELECT conv_id, p, {closed} FROM (
    SELECT dp.conv_id, dp.p - 1 AS p, {", ".join(rows)}
    FROM dp JOIN faults ON faults.conv_id IS NOT DISTINCT FROM dp.conv_id AND faults.p = dp.p)),
found AS (SELECT conv_id, CAST(left(v0, 10) AS BIGINT) AS cost, substr(v0, 11) AS audit FROM dp WHERE p = 0),
edits AS (
  SELECT conv_id, j, audit[j] AS e, length(replace(left(audit, j), 'I', '')) AS p
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM found)),
kept AS (
  SELECT edits.conv_id, j, e, role, text, row_number() OVER (PARTITION BY edits.conv_id ORDER BY j) AS q,
         first_value(e = 'K' AND i = 's') OVER (PARTITION BY edits.conv_id ORDER BY j) AS led
  FROM edits LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM edits.conv_id AND faults.p = edits.p AND e <> 'I'
  WHERE e <> 'D'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (q - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user'
                                  ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END,
                             chr(10) ORDER BY j) AS whole
  FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM o.conv_id
"""
