"""The operators' results in DuckDB SQL, where SQL can express them on whole tables."""

from . import licenses, secrets

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, b FROM reach JOIN edges ON a = seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON node = doc_id
"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0
), lens AS (SELECT DISTINCT m FROM win),
dw AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM d, lens WHERE len(w) >= m
), hits AS (SELECT doc_id, i, dw.m AS m, item_id FROM dw JOIN win USING (m, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op1() -> str:
    templates = ", ".join(f"({k}, '{t.label}', {t.words}, {list(t.must)}, {t.need(licenses.THRESHOLD)})" for k, t in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in licenses.BASE.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_LOWER}, '') AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{licenses.WORD}') AS w, string_split_regex(low, '\n[\x20\x09\x0B-\x0D]*\n') AS bl FROM d),
p(label, words) AS (VALUES {phrases}),
place AS (
  SELECT r, label, i - 1 AS start FROM (SELECT r, label, words, w, unnest(range(1, len(w) - len(words) + 2)) AS i FROM w, p WHERE len(w) >= len(words)) WHERE w[i:i + len(words) - 1] = words
),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_distinct(list(label)) AS bl FROM place GROUP BY 1),
t(k, label, words, must, need) AS (VALUES {templates}),
blocks AS (SELECT r, i, regexp_extract_all(bl[i], '{licenses.WORD}') AS b FROM (SELECT r, bl, unnest(range(1, len(bl) + 1)) AS i FROM w)),
near AS (
  SELECT r, i, k, label, words, must, need, b FROM blocks, t
  WHERE len(list_filter(must, lambda m: NOT contains(' ' || array_to_string(b, ' ') || ' ', ' ' || m || ' '))) = 0 AND len(list_intersect(words, b)) >= need
),
win AS (SELECT r, i, k, label, words, must, need, s, b[s + 1:s + {licenses.REACH} * len(words)] AS own FROM (SELECT *, unnest(range(0, len(b))) AS s FROM near)),
fit AS (
  SELECT r, i, k, label, s, {licenses.REACH} * len(words) AS reach, list_intersect(words, own) AS shared, len(list_intersect(words, own)) / len(words) AS score FROM win
  WHERE len(list_filter(must, lambda m: NOT contains(' ' || array_to_string(own, ' ') || ' ', ' ' || m || ' '))) = 0 AND len(list_intersect(words, own)) >= need
),
m AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY r, i, k ORDER BY len(shared) DESC, s) = 1),
kept AS (
  SELECT r, label, score FROM m x WHERE NOT EXISTS (
    SELECT 1 FROM m y WHERE y.r = x.r AND y.i = x.i AND y.s < x.s + x.reach AND x.s < y.s + y.reach AND (y.score > x.score OR y.score = x.score AND len(y.shared) > len(x.shared)) AND list_has_all(y.shared, x.shared))
),
more AS (SELECT r, list_distinct(list(label)) AS ml, max(score) AS best FROM kept GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.bl, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.bl, []), coalesce(ml, [])))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


def _op6() -> str:
    rules = ", ".join(f"""({k}, '{r.kind}', {r.base}, {r.group}, {r.least})""" for k, r in enumerate(secrets.RULES))
    quoted = {k: r.pattern.replace("'", "''") for k, r in enumerate(secrets.RULES)}
    matches = " ".join(f"WHEN {k} THEN regexp_extract_all(t, '{q}')" for k, q in quoted.items())
    gaps = " ".join(f"WHEN {k} THEN string_split_regex(t, '{q}')" for k, q in quoted.items())
    own = " ".join(f"WHEN {k} THEN regexp_extract(m, '{quoted[k]}', {r.group})" for k, r in enumerate(secrets.RULES) if r.group)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rule(k, kind, base, g, least) AS (VALUES {rules}),
f AS (SELECT r, k, kind, base, least, CASE k {matches} END AS ms, CASE k {gaps} END AS gs FROM d, rule),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
s AS (SELECT r, k, kind, base, least, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start FROM e),
ok AS (SELECT r, k, kind, base, start, kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT AS said FROM s WHERE length(CASE k {own} ELSE m END) >= least),
a AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY start, k) FILTER (base) AS base, string_agg(said, ',' ORDER BY start, k) AS spans FROM ok GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""


OP7 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(b[i:i + 199]) AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
dup AS (SELECT g FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN dup USING (g)),
numbered AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 199 AS z FROM numbered GROUP BY 1, 2),
edges AS (
  SELECT doc_id, z + 1 AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1, octet_length(b)) AS z, b FROM runs JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 1, min(a) - 1, any_value(b) FROM runs JOIN d USING (doc_id) GROUP BY doc_id
),
kept AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a))) AS sha FROM edges GROUP BY 1),
n AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(sha, sha256(b)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
head AS (SELECT g, min({'d': doc_id, 'i': i}) AS first FROM win GROUP BY 1),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM win JOIN head USING (g) WHERE {'d': doc_id, 'i': i} > first),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM words ANTI JOIN pos USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM pos GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_licenses": _op1(),
    "op3_minhash": OP3,
    "op4_decontaminate": OP4,
    "op6_secrets": _op6(),
    "op7_suffix_array": OP7,
    "op8_substrings": OP8,
}
