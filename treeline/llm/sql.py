"""DuckDB equivalents of the registered queries that SQL can express."""

from treeline.llm.licenses import REQUIRED, SLACK, TEMPLATES, THRESHOLD

ORACLE: dict[str, str] = {}

_WORDS = """regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE["op3_mixing"] = """
WITH RECURSIVE counted AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS src,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'),
                         lambda x: x <> ''))::BIGINT AS n_tokens,
         md5(concat_ws('|', 'mix', coalesce('=' || source, '-'),
                       coalesce(doc_id::VARCHAR, '-'), md5(coalesce(text, '')))) AS k
  FROM documents),
totals AS (SELECT src, sum(n_tokens)::BIGINT AS total FROM counted GROUP BY src HAVING sum(n_tokens) > 0),
grand AS (SELECT sum(total)::DOUBLE AS t, count(*) AS n FROM totals),
shares AS (SELECT src, total, total / t AS p, t, n FROM totals, grand),
natural_entropy AS (SELECT -sum(p * ln(p)) AS h, any_value(ln(n)) AS most FROM shares),
by_entropy(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1,
         CASE WHEN h >= 0.95 * most THEN (low + high) / 2 ELSE low END,
         CASE WHEN h >= 0.95 * most THEN high ELSE (low + high) / 2 END
  FROM (SELECT step, low, high, any_value(ln(n)) AS most,
               ln(sum(pow(p, (low + high) / 2)))
               - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p))
                 / sum(pow(p, (low + high) / 2)) AS h
        FROM by_entropy, shares WHERE step < 40 GROUP BY step, low, high)),
entropy_exponent AS (
  SELECT CASE WHEN (SELECT n FROM grand) < 2 OR h >= 0.95 * most THEN 1.0
              ELSE (SELECT (low + high) / 2 FROM by_entropy WHERE step = 40) END AS a
  FROM natural_entropy),
by_repeats(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1,
         CASE WHEN r > 4.0 THEN (low + high) / 2 ELSE low END,
         CASE WHEN r > 4.0 THEN high ELSE (low + high) / 2 END
  FROM (SELECT step, low, high,
               max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) AS r
        FROM by_repeats, shares WHERE step < 40 GROUP BY step, low, high)),
chosen AS (
  SELECT round(CASE WHEN (SELECT max(pow(p, a) / p) / sum(pow(p, a)) FROM shares) <= 4.0 THEN a
                    ELSE (SELECT (low + high) / 2 FROM by_repeats WHERE step = 40) END, 6) AS a
  FROM entropy_exponent),
weights AS (
  SELECT src, total, floor(round(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, chosen) * t, 3))::BIGINT
         AS allowed, ceil(total / 1000000.0)::BIGINT AS blocks
  FROM shares, chosen),
plan AS (SELECT *, allowed // total AS epochs, allowed % total AS rest FROM weights),
dealt AS (
  SELECT c.*, ('0x' || substr(k, 1, 15))::BIGINT % blocks AS block, epochs, rest
  FROM counted c JOIN plan USING (src) WHERE n_tokens > 0),
blocks AS (
  SELECT src, block, any_value(epochs) AS epochs, sum(n_tokens)::BIGINT AS tokens
  FROM dealt GROUP BY src, block),
placed AS (
  SELECT src, block, tokens, coalesce(sum(tokens) OVER (
           PARTITION BY src ORDER BY md5(concat_ws('|', 'mix', src, epochs, block)), block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM blocks),
rows_ AS (
  SELECT d.*, before, tokens, sum(n_tokens) OVER (
           PARTITION BY d.src, d.block ORDER BY md5(concat_ws('|', 'mix', epochs, k)), doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM dealt d JOIN placed p ON d.src = p.src AND d.block = p.block),
drawn AS (
  SELECT *, unnest(range(epochs + CASE WHEN before + tokens <= rest THEN 1
                                       WHEN before < rest AND before + run <= rest THEN 1
                                       ELSE 0 END)) AS epoch
  FROM rows_),
ranks AS (
  SELECT src, block, epoch, row_number() OVER (
           PARTITION BY src, epoch ORDER BY md5(concat_ws('|', 'mix', src, epoch, block)), block)
         AS block_rank
  FROM (SELECT src, block, unnest(range(epochs + 1)) AS epoch FROM blocks))
SELECT doc_id, source, n_tokens, d.epoch, d.block, block_rank,
       md5(concat_ws('|', 'mix', d.epoch, k)) AS doc_order
FROM drawn d JOIN ranks r ON d.src = r.src AND d.block = r.block AND d.epoch = r.epoch
"""

_FINGERPRINT = """
  SELECT doc_id, n_chars, next_id, txt, which,
         string_split(txt, chr(10)) AS lines,
         list_transform(list_filter(string_split(regexp_replace(txt, '([.!?]) +', '\\1' || chr(10), 'g'),
                                                 chr(10)), lambda s: s <> ''),
                        lambda s: ('0x' || substr(md5(s), 1, 15))::BIGINT) AS hashes
"""

ORACLE["op1_fingerprints"] = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (
  SELECT *, length(text) AS n_chars,
         coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM base WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) AS edited
  FROM ordered),
texts AS (
  SELECT doc_id, n_chars, next_id, text AS txt, 'own' AS which FROM edits
  UNION ALL SELECT doc_id, n_chars, next_id, edited, 'edited' FROM edits),
hashed AS ({_FINGERPRINT} FROM texts),
prints AS (
  SELECT doc_id, n_chars, next_id, txt, which, len(lines) AS paragraphs, len(hashes) AS sentences,
         array_to_string(list_transform(range(8), lambda k: format('{{:08x}}',
           list_sum(list_transform(lines, lambda p: ('0x' || substr(sha256(p), 8 * k + 1, 8))::BIGINT))::BIGINT
           & 4294967295)), '') AS sums,
         list_transform(range(60), lambda i: coalesce(list_sum(
           list_transform(hashes, lambda h: (h >> i) & 1)), 0)::BIGINT) AS counts
  FROM hashed),
lanes AS (
  SELECT *, list_transform(counts, lambda c: 2 * c - sentences) AS lane,
         concat_ws('-', sums, paragraphs, sentences, array_to_string(counts, '.')) AS fp
  FROM prints),
pairs AS (
  SELECT o.doc_id, o.n_chars, sha256(e.txt) AS edited_sha256, o.fp AS fingerprint,
         e.fp AS edited_fingerprint, n.fp AS next_fp, o.lane AS a, e.lane AS b, n.lane AS c
  FROM lanes o JOIN lanes e ON o.doc_id = e.doc_id AND e.which = 'edited'
  JOIN lanes n ON n.doc_id = o.next_id AND n.which = 'own'
  WHERE o.which = 'own'),
squares AS (
  SELECT *, list_sum(list_transform(range(1, 61), lambda i: (a[i] - b[i]) * (a[i] - b[i])))::DOUBLE AS ab,
         list_sum(list_transform(range(1, 61), lambda i: (a[i] - c[i]) * (a[i] - c[i])))::DOUBLE AS ac,
         list_sum(list_transform(a, lambda x: x * x))::DOUBLE AS aa,
         list_sum(list_transform(b, lambda x: x * x))::DOUBLE AS bb,
         list_sum(list_transform(c, lambda x: x * x))::DOUBLE AS cc
  FROM pairs)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0 WHEN aa + bb = 0 THEN 0.0
            ELSE greatest(0.0, 1.0 - ab / (aa + bb)) END AS near_edited,
       CASE WHEN fingerprint = next_fp THEN 1.0 WHEN aa + cc = 0 THEN 0.0
            ELSE greatest(0.0, 1.0 - ac / (aa + cc)) END AS near_next
FROM squares
"""

ORACLE["op4_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
starts AS (SELECT doc_id, ls, unnest(range(greatest(len(ls) - 3, 0) + 1)) AS pos FROM lines),
windows AS (
  SELECT doc_id, pos, array_to_string(ls[pos + 1:pos + 3], chr(10)) AS w FROM starts),
numbered AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth
  FROM windows WHERE trim(translate(w, chr(10) || chr(9) || chr(13), '   ')) <> ''),
gone AS (
  SELECT DISTINCT n.doc_id, n.pos + k AS i FROM numbered n, range(3) AS r(k) WHERE nth > 1),
each AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM lines),
marked AS (
  SELECT e.*, g.i IS NOT NULL AS removed
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_md5
FROM marked GROUP BY doc_id
"""

ORACLE["op9_url_filters"] = """
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r
  FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT c.page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(host, '(^|[.-])(spam|pills|casino|adult)([.-]|$)')
                        THEN 'block' ELSE 'allow' END) AS verdict
FROM cut c LEFT JOIN fitting f ON c.page_id = f.page_id
"""

_TEMPLATES = ",\n  ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)

# A notice: a run of words, SLACK times as long as its template, from one of its words on, that holds
# THRESHOLD of them and a phrase of every group that its label requires.
_REQUIRED = " ".join(
    f"WHEN '{label}' THEN " + " AND ".join(
        "(" + " OR ".join(f"contains(run, ' {phrase} ')" for phrase in group) + ")" for group in groups)
    for label, groups in REQUIRED.items())
ORACLE["op5_license_scan"] = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS ws FROM documents),
phrases(label, ph) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']),
  ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(ws) - len(ph) + 1),
         lambda i: ws[i + 1] = ph[1] AND ws[i + 1:i + len(ph)] = ph)) AS pos
  FROM docs, phrases WHERE list_contains(ws, ph[1])),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id),
templates(label, body) AS (VALUES
  {_TEMPLATES}),
wanted AS (
  SELECT label, list_distinct(tw) AS tw, ceil({SLACK} * len(tw))::BIGINT AS size,
         ceil({THRESHOLD} * len(list_distinct(tw)) - 1e-9) AS need
  FROM (SELECT label, {_WORDS.format('body')} AS tw FROM templates)),
starts AS (
  SELECT doc_id, label, tw, need, size, ws, unnest(list_filter(range(1, len(ws) + 1),
         lambda i: list_contains(tw, ws[i]))) AS i
  FROM docs, wanted WHERE len(list_intersect(ws, tw)) >= need),
runs AS (
  SELECT doc_id, label, len(list_intersect(list_distinct(ws[i:i + size - 1]), tw)) AS shared, need, len(tw) AS n,
         ' ' || array_to_string(ws[i:i + size - 1], ' ') || ' ' AS run FROM starts),
hits AS (
  SELECT doc_id, label, max(shared / n::DOUBLE) AS share FROM runs
  WHERE shared >= need AND CASE label {_REQUIRED} ELSE true END GROUP BY doc_id, label),
every AS (SELECT doc_id, label FROM hits UNION SELECT doc_id, label FROM places),
all_labels AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM docs d LEFT JOIN base b ON d.doc_id = b.doc_id LEFT JOIN all_labels a ON d.doc_id = a.doc_id
LEFT JOIN best s ON d.doc_id = s.doc_id
"""

ORACLE["op8_lm_scores"] = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs),
grams AS (
  SELECT doc_id, i, ws[i] AS w1, CASE WHEN i >= 2 THEN ws[i - 1] || ' ' || ws[i] END AS w2,
         CASE WHEN i >= 3 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS w3
  FROM spots),
c1 AS (SELECT w1 AS g, count(*) AS c FROM grams GROUP BY w1),
c2 AS (SELECT w2 AS g, count(*) AS c FROM grams WHERE i >= 2 GROUP BY w2),
c3 AS (SELECT w3 AS g, count(*) AS c FROM grams WHERE i >= 3 GROUP BY w3),
size AS (SELECT count(*)::DOUBLE AS n FROM grams),
counted AS (
  SELECT s.doc_id, s.i, c1.c AS u, c2.c AS b, c3.c AS t
  FROM grams s JOIN c1 ON w1 = c1.g LEFT JOIN c2 ON w2 = c2.g LEFT JOIN c3 ON w3 = c3.g),
beside AS (
  SELECT *, lag(u) OVER w AS u_before, lag(b) OVER w AS b_before
  FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
scored AS (
  SELECT doc_id, CASE WHEN t >= 2 THEN ln(t / b_before)
                      WHEN b >= 2 THEN ln(b / u_before) + ln(0.4) * (least(i, 3) - 2)
                      ELSE ln(u / n) + ln(0.4) * (least(i, 3) - 1) END AS s
  FROM beside, size),
sums AS (SELECT doc_id, sum(s) AS score FROM scored GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(score, 0), 4) AS score,
       round(CASE WHEN len(ws) > 0 THEN score / len(ws) END, 6) AS mean
FROM docs d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""

# crc32 bit by bit; a node's name is the row of its turns' digests.
ORACLE["op12_conversation_trie"] = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
bits(conv_id, s, t, v) AS (
  SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM counts
  UNION ALL
  SELECT conv_id, s, t + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END
  FROM (SELECT conv_id, s, t, CASE WHEN t % 8 = 0 THEN xor(v, ascii(substr(s, t // 8 + 1, 1))::BIGINT)
                                   ELSE v END AS w
        FROM bits WHERE t < 8 * length(s))),
ids AS (
  SELECT b.conv_id, xor(v, 4294967295) % 4 AS h, b.conv_id - b.conv_id % 20 AS base,
         least(xor(v, 4294967295) % 4, coalesce(c.n, 0)) AS taken
  FROM bits b LEFT JOIN counts c ON c.conv_id = b.conv_id - b.conv_id % 20
  WHERE t = 8 * length(s)),
rebuilt AS (
  SELECT i.conv_id, place, role, text FROM ids i JOIN turns t ON t.conv_id = i.base AND place <= taken
  UNION ALL
  SELECT i.conv_id, place - h + taken, role, text
  FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND place > h),
prefixes AS (
  SELECT conv_id, place, string_agg(sha256(length(role) || ':' || role || text), '')
           OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS name,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words
  FROM rebuilt),
nodes AS (
  SELECT name, place AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words
  FROM prefixes GROUP BY name, place
  UNION ALL
  SELECT '', 0, min(conv_id), count(*), 0 FROM ids HAVING count(*) > 0),
ends AS (
  SELECT name, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
  FROM (SELECT i.conv_id, coalesce(arg_max(name, place), '') AS name
        FROM ids i LEFT JOIN prefixes p USING (conv_id) GROUP BY i.conv_id) GROUP BY name),
children AS (
  SELECT left(name, length(name) - 64) AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtrees AS (
  SELECT a.name, sum((b.n_convs - 1) * b.words) AS saved, count(*) FILTER (c.name IS NULL) AS leaves
  FROM nodes a JOIN nodes b ON starts_with(b.name, a.name) LEFT JOIN children c ON c.name = b.name
  GROUP BY a.name)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.name = left(n.name, length(n.name) - 64)
JOIN subtrees s ON s.name = n.name LEFT JOIN children c ON c.name = n.name
LEFT JOIN ends e ON e.name = n.name
"""
