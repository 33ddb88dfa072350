"""DuckDB SQL of the operators that SQL can express in full."""

from __future__ import annotations

from . import quality as Q

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_TEXT = "coalesce(text, '')"
_LOW = f"translate({_TEXT}, '{_UPPER}', '{_LOWER}')"

REPEATS = f"""
WITH d AS (SELECT doc_id, encode({_TEXT}) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)),
c AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM w WHERE h IN (SELECT h FROM c)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s) GROUP BY doc_id, g),
p AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM r),
k AS (SELECT p.doc_id, sum(e - a + 1) AS gone, count(*) AS n, string_agg(hex(CASE WHEN a - 1 > f THEN b[f + 1:a - 1] ELSE ''::BLOB END), '' ORDER BY a) AS head, max(e) AS last FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b ELSE unhex(head || CASE WHEN last < octet_length(b) THEN hex(b[last + 1:octet_length(b)]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, {_TEXT} AS t, regexp_extract_all({_TEXT}, {_SPACED}) AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, line, regexp_extract_all(line, {_SPACED}) AS lw FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d)),
lw AS (SELECT doc_id, host, line, len(lw) AS n, regexp_replace(translate(array_to_string(lw, ' '), '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g') AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
dl AS (SELECT doc_id, host, norm, sum(n) AS words FROM lw GROUP BY ALL),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
freq AS (SELECT host, norm, holders FROM (SELECT host, norm, count(*) AS holders FROM dl GROUP BY ALL) JOIN hosts USING (host) WHERE holders >= {Q.LEAST_DOCS} AND holders >= least(docs * {Q.LEAST_PART}, {Q.MOST_DOCS})),
f AS (SELECT dl.*, holders FROM dl JOIN freq USING (host, norm)),
mainly AS (SELECT f.doc_id, sum(words) <= len(any_value(w)) * {Q.MAINLY} AS other FROM f JOIN d ON d.doc_id = f.doc_id GROUP BY f.doc_id),
gone AS (SELECT host, norm FROM f JOIN mainly USING (doc_id) GROUP BY ALL HAVING sum(CAST(other AS INTEGER)) >= {Q.LEAST_DOCS} AND sum(CAST(other AS INTEGER)) >= any_value(holders) * {Q.AMONG_OTHERS}),
lost AS (SELECT doc_id, sum(words) AS n FROM f JOIN gone USING (host, norm) GROUP BY doc_id),
x AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= n_words * {Q.DEPLETED} AS kept FROM x"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
k AS (SELECT o.a, o.b, o.o = x.n AND o.o = y.n AS same FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 90 * (x.n + y.n - o.o)),
reach(a, b) AS (SELECT a, b FROM k UNION SELECT reach.a, k.b FROM reach JOIN k ON k.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT least(d.doc_id, min(b)) FROM k WHERE k.a = d.doc_id AND same), d.doc_id) AS class_id,
  coalesce((SELECT least(d.doc_id, min(b)) FROM reach WHERE reach.a = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""

_LEAK_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_LEAK_WORDS}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, {_LEAK_WORDS}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS k, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dwin AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, k, item FROM dwin JOIN win USING (k, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: (CAST(reverse({_DIGITS})[i] AS INTEGER) * (2 - i % 2)) // 10 + (CAST(reverse({_DIGITS})[i] AS INTEGER) * (2 - i % 2)) % 10)) % 10 = 0"
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]


def _spans(k: int) -> str:
    """Matches of a kind: the texts between them give their places."""
    name, pattern, valid = _KINDS[k]
    return f"""m{k} AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, string_split_regex(t, '{pattern}') AS g FROM d),
u{k} AS (SELECT doc_id, f[i] AS m, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT doc_id, f, g, unnest(range(1, len(f) + 1)) AS i FROM m{k})),
s{k} AS (SELECT doc_id, {k} AS kind, '{name}:' || CAST(a AS BIGINT) || ':' || CAST(a + length(m) AS BIGINT) AS span, a FROM u{k} WHERE CASE WHEN length(m) > 0 THEN {valid} END)"""


PERSONAL = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents), {", ".join(_spans(k) for k in range(4))},
s AS ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(4))})
SELECT d.doc_id, {", ".join(f"count(CASE WHEN kind = {k} THEN 1 END) AS n_{x[0]}" for k, x in enumerate(_KINDS))}, sha256(coalesce(string_agg(span, ',' ORDER BY kind, a), '')) AS base_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"pii_base": PERSONAL, "op3_suffix_array_dedup": REPEATS, "op4_quality_rules": QUALITY, "op6_ngram_jaccard_join": JACCARD, "op10_benchmark_decontamination": LEAKS}
