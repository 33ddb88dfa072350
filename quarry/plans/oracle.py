"""The registered queries as DuckDB SQL."""

from __future__ import annotations

from ..functions.query import COMMON_WORDS, ES_ENDINGS
from ..functions.text import COMPOUNDS, PLACEHOLDERS, STOP_WORDS
from ..sources.records import LANGUAGES
from .queries import ASKED, DOC, PARSED


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _clean(t: str) -> str:
    t = f"regexp_replace(lower({t}), 'https?://[^\\s]+|www\\.[^\\s]+', '', 'g')"
    for p in PLACEHOLDERS:
        t = f"replace({t}, {_s(p)}, '')"
    for a, b in COMPOUNDS.items():
        t = f"replace({t}, {_s(a)}, {_s(b)})"
    return f"trim(regexp_replace(regexp_replace(replace({t}, '-', ' '), '[^a-z0-9\\s.,!?;:]', '', 'g'), '\\s+', ' ', 'g'))"


_LEMMA = "CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w END"
_STOP = ", ".join(map(_s, STOP_WORDS))
_LANG = " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in LANGUAGES.items())
_NO_PLACEHOLDER = " AND ".join(f"NOT contains(lower(t), {_s(p)})" for p in PLACEHOLDERS)

BASE = f"""
rec AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS doc_seq,
  CASE WHEN instr(text, chr(10)) > 0 THEN left(text, instr(text, chr(10)) - 1) ELSE text END AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) END AS summaries,
  CASE lang {_LANG} END AS genres,
  'source ' || lpad(regexp_extract(source, '([0-9]+)$', 1), 4, '0') AS stars FROM documents),
fld AS (SELECT doc_id, doc_seq, 'title' AS field, 0 AS field_seq, title AS t FROM rec UNION ALL SELECT doc_id, doc_seq, 'summaries', 1, summaries FROM rec
  UNION ALL SELECT doc_id, doc_seq, 'genres', 2, genres FROM rec UNION ALL SELECT doc_id, doc_seq, 'stars', 3, stars FROM rec),
cln AS (SELECT doc_id, doc_seq, field, field_seq, {_clean("t")} AS cleaned FROM fld WHERE t IS NOT NULL AND {_NO_PLACEHOLDER}),
wrd AS (SELECT doc_id, doc_seq, field, field_seq, list_filter(list_transform(list_filter(regexp_extract_all(cleaned, '[a-z0-9]+'),
  lambda w: w NOT IN ({_STOP}) AND regexp_full_match(w, '[a-z]+|[0-9]+')), lambda w: {_LEMMA}), lambda w: length(w) > 2 OR w IN ('tv', 'dc', 'mc')) AS toks FROM cln),
tok AS (SELECT doc_id, doc_seq, field, field_seq, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM wrd),
post AS (SELECT term, doc_id, doc_seq, field, field_seq, count(*) AS tf, list_sort(list(pos)) AS positions FROM tok GROUP BY ALL),
tdf AS (SELECT term, count(*) AS df FROM post GROUP BY term),
dl AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS doc_len FROM post GROUP BY doc_id),
m AS (SELECT count(*) AS n, avg(doc_len) AS avg_dl FROM dl)"""


# What the queries mean, written by hand: weights of title, summaries, genres and stars, and terms.
_MEANT = {
    "query": ((2.0, 0.5, 1.0, 1.0), "ther english eren tion"),
    "phrase": ((1.0, 1.0, 1.0, 1.0), "gnu general public license version"),
    "french": ((1.0, 1.0, 3.0, 1.0), "french que les"),
    "source": ((1.0, 1.0, 1.0, 2.0), "source 0007 source"),
}
_BATCH = {0: "query", 1: "phrase", 2: "french", 3: "source"}
_NGRAMS = ["gnu general public", "general public license", "public license version", "gnu general", "general public", "public license", "license version"]


def _contributions(name: str, query: str) -> str:
    weights, terms = _MEANT[query]
    case = " ".join(f"WHEN {_s(f)} THEN CAST({w} AS DOUBLE)" for f, w in zip(("title", "summaries", "genres", "stars"), weights, strict=True))
    rows = ", ".join(f"({i}, {_s(t)})" for i, t in enumerate(terms.split()))
    return f"""{name} AS (SELECT q.qpos, p.term, p.doc_id, p.doc_seq, p.field, p.field_seq, p.positions,
  (CASE p.field {case} END) * ln((m.n - t.df + CAST(0.5 AS DOUBLE)) / (t.df + CAST(0.5 AS DOUBLE)) + 1)
  * (p.tf * CAST(2.2 AS DOUBLE) / (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * (dl.doc_len / m.avg_dl)))) AS score
  FROM (VALUES {rows}) q(qpos, term) JOIN post p ON p.term = q.term JOIN tdf t ON t.term = q.term JOIN dl ON dl.doc_id = p.doc_id, m)"""


def _topk(source: str, k: int, more: str = "") -> str:
    return f"SELECT doc_id, {more}score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, fq, doc_seq) AS rank FROM ({source})) WHERE rank <= {k}"


def _phrases() -> str:
    """Position pairs of the consecutive words of each phrase."""
    words = ", ".join(f"({_s(p)}, {i}, {_s(w)})" for p in _NGRAMS for i, w in enumerate(p.split()))
    return f"""{_contributions("con", "phrase")},
ph(phrase, i, word) AS (VALUES {words}),
size AS (SELECT phrase, count(*) AS n, count(DISTINCT word) AS d FROM ph GROUP BY phrase),
place AS (SELECT doc_id, term, unnest(positions) AS pos FROM post WHERE term IN (SELECT word FROM ph)),
hold AS (SELECT phrase, doc_id FROM (SELECT ph.phrase, p.doc_id, count(DISTINCT ph.word) AS d FROM ph JOIN (SELECT DISTINCT doc_id, term FROM place) p ON p.term = ph.word GROUP BY ALL) x JOIN size USING (phrase) WHERE x.d = size.d),
pair AS (SELECT h.phrase, h.doc_id, p2.pos - p1.pos - 1 AS gap FROM hold h JOIN ph a ON a.phrase = h.phrase JOIN ph b ON b.phrase = h.phrase AND b.i = a.i + 1
  JOIN place p1 ON p1.doc_id = h.doc_id AND p1.term = a.word JOIN place p2 ON p2.doc_id = h.doc_id AND p2.term = b.word WHERE p2.pos > p1.pos),
stat AS (SELECT phrase, docs, coalesce(pairs, 0) AS pairs, CASE WHEN pairs > 0 THEN round(gap / pairs, 6) END AS mean_gap, docs >= 2 AND coalesce(gap / pairs, 1e300) <= 6 AS common
  FROM (SELECT phrase, count(*) AS docs FROM hold GROUP BY phrase) LEFT JOIN (SELECT phrase, count(*) AS pairs, CAST(sum(gap) AS DOUBLE) AS gap FROM pair GROUP BY phrase) USING (phrase)),
s1 AS (SELECT DISTINCT h.phrase, h.doc_id, p.pos FROM hold h JOIN ph a ON a.phrase = h.phrase AND a.i = 0 JOIN place p ON p.doc_id = h.doc_id AND p.term = a.word JOIN stat ON stat.phrase = h.phrase AND stat.common),
s2 AS (SELECT DISTINCT s.phrase, s.doc_id, p.pos FROM s1 s JOIN ph a ON a.phrase = s.phrase AND a.i = 1 JOIN place p ON p.doc_id = s.doc_id AND p.term = a.word AND p.pos > s.pos AND p.pos - s.pos <= 3),
s3 AS (SELECT DISTINCT s.phrase, s.doc_id, p.pos FROM s2 s JOIN ph a ON a.phrase = s.phrase AND a.i = 2 JOIN place p ON p.doc_id = s.doc_id AND p.term = a.word AND p.pos > s.pos AND p.pos - s.pos <= 3),
fit AS (SELECT DISTINCT phrase, doc_id FROM s2 JOIN size USING (phrase) WHERE n = 2 UNION ALL SELECT DISTINCT phrase, doc_id FROM s3)"""


def _batch() -> tuple[str, str]:
    parts = ", ".join(_contributions(f"con{i}", q) for i, q in _BATCH.items())
    union = " UNION ALL ".join(f"SELECT {i} AS query_id, doc_id, doc_seq, min(qpos) AS fq, round(sum(score), 6) AS score FROM con{i} GROUP BY doc_id, doc_seq" for i in _BATCH)
    return parts, f"SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fq, doc_seq) AS rank FROM ({union})) WHERE rank <= 10"


_ES = "(" + "|".join(ES_ENDINGS) + ")$"


def _plural(w: str) -> tuple[str, str]:
    base = f"CASE WHEN length({w}) <= 2 THEN '' WHEN {w} LIKE '%ies' AND length({w}) > 3 THEN {w}[:-4] || 'y' WHEN regexp_matches({w}, '{_ES}') THEN {w}[:-3] WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {w}[:-2] ELSE '' END"
    kind = f"CASE WHEN {w} LIKE '%ies' AND length({w}) > 3 THEN 'IES' WHEN regexp_matches({w}, '{_ES}') AND length({w}) > 3 THEN 'ES' WHEN {w} LIKE '%s' AND length({w}) > 1 THEN 'S' ELSE 'NONE' END"
    return base, kind


def _variants(w: str) -> str:
    return f"list_filter([{_plural(w)[0]}, CASE WHEN regexp_matches({w}, '[^aeiou]y$') THEN {w}[:-2] || 'ies' END, CASE WHEN regexp_matches({w}, '(s|x|z|ch|sh)$') THEN {w} || 'es' END, {w} || 's'], lambda x: x IS NOT NULL AND x <> '')"


def _spelling() -> str:
    rows = ", ".join(f"({_s(t)})" for t in ASKED)
    common = ", ".join(_s(w) for w in sorted(COMMON_WORDS))
    return f"""asked AS (SELECT given, lower(given) AS term, replace(lower(given), '-', '') AS look FROM (VALUES {rows}) v(given)),
pre AS (SELECT *, term = '' OR term IN ({common}) OR regexp_full_match(look, '[0-9]+') OR length(look) <= 2 AS plain, {_plural("look")[0]} AS base FROM asked),
cand AS (SELECT a.given, t.term AS candidate, t.df, CAST(levenshtein(a.look, t.term) AS INTEGER) AS distance,
  CAST({_plural("t.term")[1]} <> {_plural("a.look")[1]} AS INTEGER) AS other_class, CAST(length(t.term) <> length(a.look) AS INTEGER) AS other_length
  FROM pre a JOIN tdf t ON t.term[1] = a.look[1] AND abs(length(t.term) - length(a.look)) <= 2
  WHERE NOT a.plain AND t.df >= floor(greatest(2, 0.002 * (SELECT count(*) FROM documents))) AND levenshtein(a.look, t.term) <= CASE WHEN length(a.look) >= 5 THEN 1 ELSE 2 END),
near AS (SELECT given, candidate FROM (SELECT *, row_number() OVER (PARTITION BY given ORDER BY distance, other_class, other_length, -df, candidate) AS r FROM cand) WHERE r = 1),
var AS (SELECT given, term AS variant FROM (SELECT f.given, t.term, row_number() OVER (PARTITION BY f.given ORDER BY t.df DESC, t.term) AS r FROM (SELECT given, unnest({_variants("look")}) AS form FROM pre) f JOIN tdf t ON t.term = f.form) WHERE r = 1),
ruled AS (SELECT p.*, v.variant, n.candidate, CASE WHEN plain THEN 'plain' WHEN p.term IN (SELECT term FROM tdf) THEN 'known' WHEN look IN (SELECT term FROM tdf) THEN 'joined'
  WHEN base IN (SELECT term FROM tdf) THEN 'plural' WHEN variant IS NOT NULL THEN 'variant' WHEN candidate IS NOT NULL THEN 'nearest' ELSE 'unknown' END AS rule
  FROM pre p LEFT JOIN var v ON v.given = p.given LEFT JOIN near n ON n.given = p.given)"""


def _judged() -> str:
    parts, batch = _batch()
    ids = ", ".join(f"({i})" for i in _BATCH)
    return f"""{parts}, hit AS ({batch}), h5 AS (SELECT * FROM hit WHERE rank <= 5), qs(query_id) AS (VALUES {ids}),
good AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE quality = 1),
jd AS (SELECT qs.query_id, (SELECT count(DISTINCT doc_id) FROM h5 WHERE h5.query_id = qs.query_id) AS retrieved,
  (SELECT count(DISTINCT doc_id) FROM h5 WHERE h5.query_id = qs.query_id AND doc_id IN (SELECT doc_id FROM good)) AS hits,
  (SELECT min(rank) FROM h5 WHERE h5.query_id = qs.query_id AND doc_id IN (SELECT doc_id FROM good)) AS first_rank,
  (SELECT count(*) FROM good) AS judged, (SELECT count(DISTINCT doc_id) FROM good) AS relevant FROM qs)"""


_ITEMS = """it AS (SELECT doc_id AS seq, CASE WHEN doc_id % 11 = 0 THEN source ELSE 'tt' || lpad(CAST(doc_id % 900 AS VARCHAR), 7, '0') END AS id,
  lpad(CAST(n_chars AS VARCHAR), 4, '0') AS y, lang, source, doc_id, n_chars FROM documents)"""


def _findings() -> str:
    absent = ["first_page_summary", "mpaa", "gross_worldwide", "writers", "countries_of_origin", "summaries", "synopsis"]
    some = {"directors": "doc_id % 17 <> 0", "stars": "doc_id % 19 <> 0", "languages": "doc_id % 7 <> 0", "reviews": "doc_id % 6 = 0"}
    missing = {f: "true" for f in absent} | some
    rules = [(s, "schema", f, when) for f, when in missing.items() for s in ("missing", "warning")]
    rules += [("error", "gross_worldwide", "gross_worldwide", "true")]
    rules += [("error", "list", f, "true") for f in ("directors", "writers", "countries_of_origin", "summaries", "synopsis")]
    rules += [("error", "list", f, some[f]) for f in ("stars", "languages")]
    rules += [
        ("error", "id", "id", "NOT regexp_full_match(id, 'tt[0-9]{7,8}')"),
        ("error", "schema", "title", "doc_id % 13 = 0"), ("error", "title", "title", "doc_id % 13 = 0"),
        ("warning", "title", "title", "doc_id % 13 <> 0 AND doc_id % 5 = 0"),
        ("warning", "release_year", "release_year", "NOT regexp_full_match(y, '[0-9]{4}')"),
        ("placeholder", "rating", "rating", "doc_id % 3 = 0"),
        ("warning", "budget", "budget", "doc_id % 4 = 0"),
        ("warning", "list", "genres", "doc_id % 6 = 0 OR lang = source"),
        ("error", "schema", "directors", "doc_id % 17 = 0"),
        ("error", "schema", "stars", "doc_id % 19 = 0"), ("error", "list", "stars", "doc_id % 19 = 0"), ("warning", "list", "stars", "doc_id % 19 = 0"),
        ("placeholder", "list", "languages", "doc_id % 7 = 0"),
        ("warning", "links", "related_links", "true"),
        *[("warning", "links", "related_links", "doc_id % 6 = 0")] * 3,  # two bad ids and a duplicate
        ("error", "schema", "reviews", "doc_id % 6 IN (1, 4, 5)"),
        ("error", "reviews", "reviews", "doc_id % 6 IN (0, 1, 5)"),
        ("warning", "reviews", "reviews", "doc_id % 6 >= 2"), ("warning", "reviews", "reviews", "doc_id % 6 = 3"),
    ]
    rows = [f"SELECT {_s(s)} AS severity, {_s(r)} AS rule, {_s(f)} AS field, seq FROM it WHERE {when}" for s, r, f, when in rules]
    rows += ["SELECT 'error', 'unique', 'id', min(seq) FROM it GROUP BY id HAVING count(*) > 1"]
    return " UNION ALL ".join(rows)


def _parsed() -> str:
    """The query syntax once more, in SQL."""
    rows = ", ".join(f"({i}, {_s(q)})" for i, q in enumerate(PARSED))
    return f"""q(query, t) AS (VALUES {rows}),
part AS (SELECT query, ps[k] AS p, k FROM (SELECT query, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT query, list_filter(string_split_regex(translate(t, chr(34) || chr(39), '  '), '[[:space:]]+'), lambda x: x <> '') AS ps FROM q))),
named AS (SELECT *, regexp_full_match(p, '[a-zA-Z_]+:-?[0-9]*[.]?[0-9]+') AS fits, CASE split_part(p, ':', 1) WHEN 'summary' THEN 'summaries' ELSE split_part(p, ':', 1) END AS name FROM part),
known AS (SELECT *, fits AND name IN ('title', 'summaries', 'genres', 'stars') AS sets FROM named)"""


_PAGE_RECORDS = """SELECT 'p' || n AS id, 'Film ' || n || ' & Co' AS title,
  CASE WHEN n % 3 <> 0 THEN 'Plot of ' || n ELSE 'Summary not found.' END AS first_page_summary,
  CASE WHEN n % 3 = 1 THEN '19' || n ELSE 'Release year not found.' END AS release_year,
  CASE n % 4 WHEN 0 THEN 'C' || n WHEN 1 THEN 'P' || n WHEN 2 THEN 'LD' || n ELSE 'MPAA rating not found.' END AS mpaa,
  CASE n % 3 WHEN 0 THEN '$' || n WHEN 1 THEN 'Budget not found.' ELSE 'Budget tag not found.' END AS budget,
  CASE WHEN n % 2 = 0 THEN '$9' || n ELSE 'Gross worldwide tag not found.' END AS gross_worldwide,
  CASE n % 4 WHEN 0 THEN '8.' || n WHEN 1 THEN '7.' || n WHEN 2 THEN '6.5' ELSE 'Rating not found.' END AS rating,
  'Dir ' || n AS directors, CASE WHEN n % 2 = 0 THEN 'W1|W2' ELSE '' END AS writers, 'S' || n AS stars,
  'https://www.imdb.com/title/r' || n || '/?x' AS related_links, CASE WHEN n % 5 <> 0 THEN 'Drama|G' || n ELSE '' END AS genres,
  CASE WHEN n % 3 = 2 THEN 'L' || n || '|M' ELSE 'Languages not found.' END AS languages,
  CASE WHEN n % 2 = 1 THEN 'US' || n || '|FR' ELSE 'No countries of origin found.' END AS countries_of_origin,
  CASE WHEN n % 7 <> 0 THEN 'Sum ' || n || ' <1>|two' ELSE '' END AS summaries, CASE WHEN n % 7 <> 0 THEN 'Syn ' || n ELSE '' END AS synopsis,
  CASE WHEN n % 6 <> 0 THEN 'Fine ' || n || '/8|/N/A' ELSE '' END AS reviews FROM (SELECT page_id AS n FROM pages)"""


def oracle_sql() -> dict[str, str]:
    w = f"WITH {BASE}"
    parts, batch = _batch()
    base, kind = _plural("term")
    one = _contributions("con", "query")
    summed = "SELECT doc_id, doc_seq, min(qpos) AS fq, round(sum(score), 6) AS score FROM con GROUP BY doc_id, doc_seq"
    boosted = "SELECT doc_id, doc_seq, fq, CAST(coalesce(n, 0) AS INTEGER) AS n_phrases, round(base + coalesce(n, 0) * base * 0.5, 6) AS score FROM (SELECT doc_id, doc_seq, min(qpos) AS fq, sum(score) AS base FROM con GROUP BY doc_id, doc_seq) LEFT JOIN (SELECT doc_id, count(*) AS n FROM fit GROUP BY doc_id) USING (doc_id)"
    grams = ", ".join(f"({i}, {_s(p)}, {len(p.split())})" for i, p in enumerate(_NGRAMS))
    page = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
    return {
        "index_build": f"{w} SELECT (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM tok) AS tokens, (SELECT count(*) FROM tdf) AS terms, (SELECT count(*) FROM dl) AS documents",
        "processed_checks": f"{w} SELECT (SELECT count(*) FROM tok WHERE trim(term) = '') + (SELECT count(*) FROM (SELECT 1 FROM wrd WHERE len(toks) > 0 GROUP BY doc_id, field HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT doc_id, sum(len(toks)) AS n FROM wrd GROUP BY doc_id) x JOIN dl USING (doc_id) WHERE n <> doc_len) AS violations, count(DISTINCT doc_id) FILTER (len(toks) > 0) AS documents FROM wrd",
        "clean_text": f"{w} SELECT doc_id, field, cleaned FROM cln WHERE cleaned <> ''",
        "tokens_long": f"{w} SELECT doc_id, field, CAST(pos AS INTEGER) AS pos, term FROM tok",
        "postings": f"{w} SELECT term, doc_id, field, CAST(tf AS INTEGER) AS tf, array_to_string(positions, ' ') AS positions FROM post",
        "term_df": f"{w} SELECT term, df FROM tdf",
        "doc_lengths": f"{w} SELECT doc_id, doc_len FROM dl",
        "index_meta": f"{w} SELECT (SELECT n FROM m) AS total_documents, (SELECT count(*) FROM tok) AS total_tokens, (SELECT count(*) FROM tdf) AS unique_tokens, (SELECT round(avg_dl, 6) FROM m) AS avg_dl, CAST((SELECT count(DISTINCT field) FROM tok) AS INTEGER) AS n_fields, CAST((SELECT count(DISTINCT length(term)) FROM tok) AS INTEGER) AS n_lengths",
        "field_distribution": f"{w} SELECT field, count(DISTINCT doc_id) AS docs FROM tok GROUP BY field",
        "token_length_hist": f"{w} SELECT CAST(length(term) AS INTEGER) AS token_length, count(*) AS occurrences FROM tok GROUP BY ALL",
        "bm25_topk": f"{w}, {one} {_topk(summed, 20)}",
        "bm25_detail": f"{w}, {one} SELECT doc_id, term, round(sum(score), 6) AS score FROM con GROUP BY doc_id, term",
        "bm25_batch_topk": f"{w}, {parts} {batch}",
        "parsed_weights": f"WITH {_parsed()} SELECT q.query, f.field, CAST(coalesce((SELECT arg_max(greatest(0.0, CAST(split_part(p, ':', 2) AS DOUBLE)), k) FROM known WHERE known.query = q.query AND sets AND name = f.field), 1.0) AS DOUBLE) AS weight FROM q, (VALUES ('title'), ('summaries'), ('genres'), ('stars')) f(field)",
        "parsed_terms": f"WITH {_parsed()} SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY k) - 1 AS INTEGER) AS place, lower(p) AS term FROM known WHERE NOT sets",
        "sequential_phrase": f"{w}, pl AS (SELECT doc_id, term, unnest(positions) AS pos FROM post WHERE term IN ('gnu', 'general', 'public')) SELECT DISTINCT doc_id, doc_id IN (SELECT a.doc_id FROM pl a JOIN pl b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN pl c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'gnu' AND b.term = 'general' AND c.term = 'public') AS sequential FROM pl",
        "repeated_ids": f"{w}, each AS (SELECT doc_seq, CAST(doc_seq % 97 AS VARCHAR) AS id, CAST(sum(len(toks)) AS BIGINT) AS n FROM wrd GROUP BY doc_seq HAVING sum(len(toks)) > 0) SELECT id AS doc_id, min(doc_seq) AS doc_seq, arg_max(n, doc_seq) AS doc_len FROM each GROUP BY id",
        "validation_summary": f"WITH {_ITEMS}, f AS ({_findings()}) SELECT count(*) FILTER (severity = 'error' AND rule <> 'unique') + least(1, count(*) FILTER (rule = 'unique')) AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM f",
        "page_records": _PAGE_RECORDS,
        "query_ngrams": f"SELECT * FROM (VALUES {grams}) v(place, phrase, n)",
        "phrase_stats": f"{w}, {_phrases()} SELECT phrase, docs, pairs, mean_gap, common FROM stat",
        "phrase_boosted_topk": f"{w}, {_phrases()} {_topk(boosted, 20, 'n_phrases, ')}",
        "explain_doc": f"{w}, {one}, ex AS (SELECT * FROM con WHERE doc_id = {_s(DOC)}) SELECT {_s(DOC)} AS document_id, (SELECT round(sum(score), 6) FROM ex) AS total_score, (SELECT doc_len FROM dl WHERE doc_id = {_s(DOC)}) AS length, (SELECT round(avg_dl, 6) FROM m) AS avg_doc_length, field, round(sum(score), 6) AS x FROM ex GROUP BY field",
        "eval_metrics": f"{w}, {_judged()} SELECT round(avg(hits / 5.0), 6) AS precision_at_5, round(avg(CASE WHEN judged > 0 THEN hits / CAST(judged AS DOUBLE) ELSE 0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM jd",
        "eval_pass": f"{w}, {_judged()} SELECT query_id, round(hits / CAST(greatest(1, retrieved) AS DOUBLE), 6) AS precision, round(hits / CAST(greatest(1, relevant) AS DOUBLE), 6) AS recall, hits / CAST(greatest(1, retrieved) AS DOUBLE) >= 0.8 OR hits / CAST(greatest(1, relevant) AS DOUBLE) >= 0.8 AS passed FROM jd",
        "plural_forms": f"{w} SELECT term, {base} AS base, {kind} AS plural_class, array_to_string(list_sort(list_distinct({_variants('term')})), ' ') AS variants FROM tdf",
        "spell_candidates": f"{w}, {_spelling()} SELECT given, candidate, df, distance, other_class, other_length FROM cand",
        "spell_best": f"{w}, {_spelling()} SELECT given, CASE rule WHEN 'joined' THEN look WHEN 'variant' THEN variant WHEN 'nearest' THEN candidate ELSE term END AS corrected, rule FROM ruled",
        "df_summary": f"{w} SELECT min(df) AS min_df, max(df) AS max_df, round(avg(df), 6) AS mean_df, (SELECT df FROM (SELECT df, row_number() OVER (ORDER BY df) AS r, count(*) OVER () AS n FROM tdf) WHERE r = n // 2 + 1) AS median_df FROM tdf",
        "top_tokens": f"{w} SELECT term, count(*) AS freq FROM tok GROUP BY term ORDER BY freq DESC, min((doc_seq, field_seq, pos)) LIMIT 10",
        "index_integrity": f"{w} SELECT (SELECT count(*) FROM (SELECT doc_id FROM wrd WHERE len(toks) > 0 EXCEPT SELECT doc_id FROM post)) AS missing_docs, (SELECT count(*) FROM (SELECT term, count(*) AS n FROM post GROUP BY term) p FULL JOIN tdf USING (term) WHERE n IS DISTINCT FROM df) AS df_errors, (SELECT count(*) FROM post WHERE tf <> len(positions)) AS tf_errors",
        "field_coverage": f"{w} SELECT field, count(DISTINCT doc_id) AS docs, round(count(DISTINCT doc_id) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent FROM tok GROUP BY field",
        "preprocess_report": f"{w} SELECT (SELECT count(*) FROM documents) AS raw, (SELECT n FROM m) AS processed, round((SELECT n FROM m) * 100.0 / (SELECT count(*) FROM documents), 6) AS success_percent, (SELECT count(*) FROM tok) AS total_tokens, (SELECT count(*) FROM tdf) AS unique_tokens, round((SELECT count(*) FROM tok) / CAST((SELECT n FROM m) AS DOUBLE), 6) AS tokens_per_doc",
        "posting_samples": f"{w} SELECT term, CAST(r AS INTEGER) AS n, doc_id, field, CAST(tf AS INTEGER) AS tf, array_to_string(positions[1:3], ' ') AS positions FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_seq, field_seq) AS r FROM post WHERE term IN ('ther', 'english', 'license')) WHERE r <= 3",
        "findings": f"WITH {_ITEMS} SELECT severity, rule, field, count(*) AS n, count(DISTINCT seq) AS records FROM ({_findings()}) GROUP BY ALL",
        "findings_by_field": f"WITH {_ITEMS} SELECT field, count(*) AS n FROM ({_findings()}) WHERE severity = 'missing' GROUP BY field",
        "duplicate_ids": f"WITH {_ITEMS} SELECT id, count(*) AS n, min(seq) AS seq FROM it GROUP BY id HAVING count(*) > 1",
        "page_extract": f"SELECT page_id, trim(regexp_replace(regexp_extract(c, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title, CAST(len(regexp_extract_all(c, '(?i)<a\\s[^>]*href=')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(c, '(?i)<p\\b')) AS BIGINT) AS n_paragraphs FROM (SELECT page_id, {page} AS c FROM pages)",
        "link_frontier": "SELECT min('https://www.imdb.com/title/tt' || x || '/') AS url, 'tt' || x AS id FROM (SELECT unnest([CAST(doc_id * 2 AS VARCHAR), CAST(doc_id + 7 AS VARCHAR)]) AS x FROM documents) WHERE x NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 0) GROUP BY x",
        "sub_pages": "SELECT page_id, id, 'https://www.imdb.com/title/' || id || '/plotsummary' AS summary_url, 'https://www.imdb.com/title/' || id || '/reviews' AS reviews_url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'tt' || page_id END AS id FROM pages)",
    }


