"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM s
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

OP2_LINKS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS grams
  FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
counted AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT s.doc_id, CASE WHEN len(grams) > 0 THEN min(s.doc_id) OVER (PARTITION BY grams) END AS class,
  CAST(len(grams) AS BIGINT) AS n_shingles, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM s LEFT JOIN counted USING (doc_id)
"""

_RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 4 AND n_dup_lines * 20 > n_words",
    "odd_word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}


def _each(form: str, between: str = ", ") -> str:
    return between.join(form.format(n=n, r=r) for n, r in _RULES.items())


OP4 = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (
  SELECT k, unnest(range(0, greatest(len(ws) - 7, 0))) AS i,
    unnest(list_transform(range(1, greatest(len(ws) - 6, 1)), lambda j: array_to_string(ws[j:j + 7], ' '))) AS g FROM w),
twice AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY k ORDER BY i) AS nx FROM twice) GROUP BY k),
s AS (
  SELECT w.k, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.k = w.k),
h AS (SELECT source, count(*) AS n, {_each("sum(CAST({r} AS INT)) AS {n}")} FROM s GROUP BY source),
m AS (SELECT {_each("avg({n} / n) AS {n}_m, var_pop({n} / n) AS {n}_v")} FROM h),
p AS (SELECT {_each("{n}_m, CASE WHEN {n}_v > 0 THEN greatest({n}_m * (1 - {n}_m) / {n}_v - 1, 2) ELSE 2 END AS {n}_k")} FROM m),
v AS (SELECT source, {_each("({n} + {n}_m * {n}_k) / (n + {n}_k) AS {n}_rate")} FROM h, p)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({_RULES["few_words"]} OR {_RULES["repeated_windows"]}) AS base_failed,
  NOT ({_RULES["few_words"]} OR {_RULES["repeated_windows"]})
    AND NOT ({_each("{n}_rate > 0.5", " OR ")})
    AND NOT ({_each("(({r}) AND {n}_rate > 0.02)", " OR ")}) AS kept
FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
"""

OP12 = r"""
WITH w AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws FROM documents),
win AS (
  SELECT k, unnest(range(1, greatest(len(ws) - 18, 1))) AS i,
    unnest(list_transform(range(1, greatest(len(ws) - 18, 1)), lambda j: array_to_string(ws[j:j + 19], ' '))) AS g FROM w),
again AS (SELECT k, i FROM (SELECT k, i, row_number() OVER (PARTITION BY g ORDER BY k, i) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 20)) AS i FROM again),
each AS (SELECT k, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS v FROM w),
kept AS (
  SELECT k, count(*) AS n, string_agg(v, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (k)
"""

# DuckDB has no crc32: the checksum is carried over the bytes of all distinct strings together, one byte a round.
OP13 = r"""
WITH RECURSIVE bits AS (
  SELECT b, 0 AS step, b AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
  UNION ALL
  SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
tab AS (SELECT b, c FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY doc_id, run),
named AS (
  SELECT row_number() OVER () AS k, run, times, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x:
    CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS bytes FROM runs),
crc AS (
  SELECT k, bytes, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM named
  UNION ALL
  SELECT k, bytes, i + 1, xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON tab.b = xor(crc.c, bytes[i + 1]) & 255 WHERE i < len(bytes)),
summed AS (SELECT k, xor(c, 4294967295) AS h FROM crc WHERE i = len(bytes)),
cut AS (
  SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM named JOIN summed USING (k)),
v AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
places AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS gap, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM places x JOIN places y ON x.gap = y.gap AND x.word <> y.word
  UNION SELECT places.word, v.word, v.n FROM places JOIN v ON places.less = v.word
  UNION SELECT v.word, places.word, places.n FROM places JOIN v ON places.less = v.word),
ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS nth FROM near),
told AS (
  SELECT v.word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form,
    CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM v LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) USING (word)),
up AS (
  SELECT word, word AS reached FROM told
  UNION ALL
  SELECT up.word, told.form FROM up JOIN told ON told.word = up.reached WHERE told.form IS NOT NULL)
SELECT told.word, told.form, up.reached AS root, told.n, told.n_near, told.form_n
FROM told JOIN up ON up.word = told.word JOIN told AS ends ON ends.word = up.reached AND ends.form IS NULL
"""

ORACLES = {"op4_quality_rules": OP4, "op2_ngram_jaccard_join": OP2, "op2_ngram_jaccard_links": OP2_LINKS,
           "op12_substring_dedup": OP12, "op13_spelling_variants": OP13}
