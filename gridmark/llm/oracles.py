"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SYMBOLS = r"[^#*$%&|<>]"

#: Fixed values of the quality rules: phrases of page furniture.
_PHRASES = (
    "accept all cookies", "we use cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "click here to", "sign up for our newsletter", "subscribe to our newsletter",
    "skip to content", "back to top", "share on facebook", "share on twitter", "powered by wordpress",
)

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
twice AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY r),
line AS (SELECT r, i, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w FROM (SELECT r, unnest(s) AS l, unnest(range(len(s))) AS i FROM (SELECT r, string_split(text, chr(10)) AS s FROM d))),
judged AS (SELECT r, i, l, len(w) AS n, greatest(length(regexp_replace(l, '{_SYMBOLS}', '', 'g')), len(regexp_extract_all(l, '!!+|\?\?+'))) AS marks,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS again, len(regexp_extract_all(l, '[»›•·]')) AS seps,
  regexp_matches(l, '[.!?…:;。！？：；।؟۔]["''”’»)\]）」』]*[\x20\x09-\x0D]*\z|[\x{{0E00}}-\x{{109F}}\x{{1780}}-\x{{17FF}}]') AS closed, {" OR ".join(f"contains(lower(l), '{p}')" for p in _PHRASES)} AS furniture FROM line),
alone AS (SELECT *, n > 0 AND (marks >= 0.3::DOUBLE * n OR (n >= 8 AND again >= 0.3::DOUBLE * n) OR (n <= 25 AND (seps >= 2 OR furniture))) AS own FROM judged),
opened AS (SELECT *, n BETWEEN 1 AND 25 AND NOT own AND NOT closed AS open, n BETWEEN 1 AND 3 AND NOT own AND NOT closed AS item FROM alone),
run AS (SELECT *, i - row_number() OVER (PARTITION BY r, item ORDER BY i) AS run, count(*) FILTER (open) OVER (PARTITION BY r) AS n_open, count(*) FILTER (n > 0) OVER (PARTITION BY r) AS n_full FROM opened),
verdict AS (SELECT *, own OR (open AND n_open >= 5 AND 2 * n_open >= n_full) OR (item AND count(*) OVER (PARTITION BY r, item, run) >= 4) AS fails FROM run),
byline AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS dup, coalesce(sum(length(l)) FILTER (fails), 0) AS lost FROM verdict GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '{_SYMBOLS}', '', 'g'))::BIGINT AS n_symbols,
  dup::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE lost::DOUBLE / length(text) END AS lost_share
  FROM d JOIN byline USING (r) LEFT JOIN covered c USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_share <= 0.3::DOUBLE AS kept FROM f"""


def _op4() -> str:
    from .license_scan import TEMPLATES, classes

    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{t.label}', {listed(t.words)})" for t in TEMPLATES if t.phrase)
    long = {k: n for n, members in classes(TEMPLATES).items() for k in members}
    notices = ", ".join(f"({long[k]}, '{t.label}', {listed(sorted(set(t.words)))}, {t.threshold}::DOUBLE)" for k, t in enumerate(TEMPLATES) if not t.phrase)
    blocks = " UNION ALL ".join(f"SELECT r, {n} AS n, w[s:s + {2 * n} - 1] AS w FROM (SELECT r, w, unnest(range(1, len(w) + 1, {n})) AS s FROM d)" for n in classes(TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrase(label, words) AS (VALUES {phrases}),
notice(n, label, words, least) AS (VALUES {notices}),
place AS (SELECT r, label, p FROM (SELECT r, label, words, w, unnest(range(0, len(w))) AS p FROM d CROSS JOIN phrase WHERE list_has_all(w, words)) WHERE w[p + 1:p + len(words)] = words),
base AS (SELECT r, count(*) AS n, min(p) AS a, max(p) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY r),
block AS ({blocks}),
hit AS (SELECT r, label, max(len(list_intersect(w, words)) / len(words)) AS share FROM block JOIN notice USING (n) WHERE len(list_intersect(w, words)) >= ceil(least * len(words) - 1e-9) GROUP BY ALL
  UNION ALL SELECT DISTINCT r, label, 1.0 FROM place),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.b::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, coalesce(e.share, 0)::DOUBLE AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN every e USING (r)"""


OP4 = _op4()

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 3], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least ON a = d.doc_id"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS bits, max(page_id) OVER (PARTITION BY hex) AS newest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: substr(bits, 1 + 5 * i + k, 1)::INT * (16 >> k::INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM b"""

#: CRC-32 byte by byte: the 256 remainders by bits, then a fold over the bytes of each different feature.
OP11 = r"""
WITH crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n::BIGINT) ORDER BY n) AS t FROM range(0, 256) r(n)),
d AS (SELECT row_number() OVER () AS r, doc_id, true AS own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT row_number() OVER () AS r, NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
gram AS (SELECT r, own, g, count(*) AS n FROM (SELECT r, own, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT r, own, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN range(1, 4) x(k))) GROUP BY ALL),
hashed AS (SELECT g, xor(list_reduce(list_transform(range(0, strlen(g)), lambda i: ('0x' || substr(hex(g), 2 * i::INT + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS b FROM (SELECT DISTINCT g FROM gram) CROSS JOIN crc),
per AS (SELECT r, own, b, sum(n) AS n FROM gram JOIN hashed USING (g) GROUP BY ALL),
total AS (SELECT b, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM per GROUP BY b),
size AS (SELECT sum(s) + 10000 AS s_all, sum(t) + 10000 AS t_all FROM total),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * s_all::DOUBLE / ((s + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS gain FROM total CROSS JOIN size),
weight AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM per JOIN gain USING (b) WHERE own GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM (SELECT * FROM d WHERE own) LEFT JOIN weight USING (r)),
drawn AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END::BIGINT AS rank FROM drawn"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
term AS (SELECT lang, t, sum(n)::HUGEINT AS n FROM tok GROUP BY lang, t HAVING count(*) >= 3),
own AS (SELECT lang, source, t, sum(tok.n)::HUGEINT AS n FROM tok JOIN term USING (lang, t) GROUP BY lang, source, t),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM term GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, v.v, v.n AS lang_n, coalesce((SELECT sum(own.n) FROM own WHERE own.lang = g.lang AND own.source = g.source), 0)::HUGEINT AS n FROM g JOIN v ON v.lang = g.lang),
p AS (SELECT gn.lang, gn.source, term.t, coalesce(own.n, 0) AS c, 1 + 1000000000 * (coalesce(own.n, 0) + 1) // (gn.n + gn.v) AS p, 1 + 1000000000 * (term.n + 1) // (gn.lang_n + gn.v) AS q
  FROM gn JOIN term ON term.lang = gn.lang LEFT JOIN own ON own.lang = gn.lang AND own.source = gn.source AND own.t = term.t),
near AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(near.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN near ON near.lang = x.lang AND near.source = x.source AND near.item = y.source),
told AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pair
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM told) WHERE rank <= 200"""

OP13 = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
fit AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM fit a JOIN fit b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.98::DOUBLE),
reach AS (SELECT r AS a, r AS b FROM e UNION SELECT x.a, link.b FROM reach x JOIN link ON link.a = x.b),
least AS (SELECT x.a AS r, min(e.vec_id) AS m FROM reach x JOIN e ON e.r = x.b GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m AS component_id, e.vec_id IS NOT DISTINCT FROM m AS kept FROM e JOIN least USING (r) LEFT JOIN n USING (r)"""

ORACLES = {"op3_quality_rules": OP3, "op4_license_scan": OP4, "op7_near_dedup": OP7, "op8_warc_zip": OP8, "op11_resampling": OP11, "op12_divergence": OP12, "op13_embedding_dedup": OP13}
