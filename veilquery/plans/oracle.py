"""DuckDB SQL for the registered queries, written from the definitions and independent of the Spark plans."""

from __future__ import annotations

from veilquery.operators.surrogates import DIAL

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
PHONE = r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"
CARD = r"[0-9]{13,16}"
PATTERNS = [("Email", EMAIL), ("URL_IP", IP), ("Phone_fax", PHONE), ("ID", CARD)]
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+|[\x09-\x0D\x20]+|[^\x09-\x0D\x20]"


def found(tag: str, pattern: str) -> str:
    """Spans of one pattern: where they start follows from the lengths of the pieces around and before."""
    return f"""
SELECT doc, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::INT AS start, h[i] AS text, '{tag}' AS tag
FROM (SELECT doc_id AS doc, h, g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g FROM documents) WHERE len(h) > 0)"""


def _gold() -> str:
    out, kept = "", []
    for k, (tag, pattern) in enumerate(PATTERNS):
        out += f"f{k} AS (SELECT doc, start, start + length(text)::INT AS \"end\", tag, text FROM ({found(tag, pattern)})),\n"
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM e{j} o WHERE o.doc = f.doc AND o.start < f.\"end\" AND f.start < o.\"end\")" for j in kept)
        out += f"e{k} AS (SELECT * FROM f{k} f WHERE true{free}),\n"
        kept.append(k)
    return out + "gold AS (" + " UNION ALL ".join(f"SELECT * FROM e{k}" for k in kept) + ")"


GOLD = _gold()


def draw(text: str, n: int | str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 15))::BIGINT % {n})"


def run(name: str, salt: str) -> str:
    kind = draw(f"'{salt}|' || doc || '|' || start", 8)
    return f"""{name} AS (SELECT doc, start, CASE WHEN kind = 1 THEN "end" + 1 ELSE "end" END AS "end", CASE WHEN kind = 2 THEN 'ID' ELSE tag END AS tag, text FROM (SELECT *, {kind} AS kind FROM gold) WHERE kind <> 0)"""


TOKENS = f"""tok AS (
  SELECT doc, i, coalesce(sum(length(text)) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, text
  FROM (SELECT doc_id AS doc, unnest(range(0, len(t))) AS i, unnest(t) AS text FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS t FROM documents))),
tokens AS (SELECT doc, i::INT AS i, start, start + length(text)::INT AS "end", text FROM tok)"""
SENTENCES = r"""sents AS (
  SELECT *, sum(s) OVER (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING)::INT AS sent_id
  FROM (SELECT *, CASE WHEN (regexp_full_match(l1, '[\x09-\x0D\x20]+') AND (l2 IN ('.', '!', '?') OR contains(l1, chr(10)))) OR starts_with(l1, '===') OR (starts_with(text, '===') AND l1 IS NOT NULL) THEN 1 ELSE 0 END AS s
        FROM (SELECT *, lag(text, 1) OVER (PARTITION BY doc ORDER BY i) AS l1, lag(text, 2) OVER (PARTITION BY doc ORDER BY i) AS l2 FROM tokens)))"""
WORDS = r"words AS (SELECT * FROM tokens WHERE NOT regexp_full_match(text, '[\x09-\x0D\x20]+') AND NOT starts_with(text, '==='))"
CASED = r"[\p{Lu}\p{Lt}\p{Ll}]"
OTHER, CAPITAL = r"[^\p{Lu}\p{Lt}\p{Ll}]", r"[\p{Lu}\p{Lt}]"


def bio(name: str, spans: str) -> str:
    """Labels of tokens; spans that don't start and end with tokens leave O, and the first of overlapping ones wins."""
    return f"""{name}_in AS (
  SELECT t.doc, t.i, t.start, t."end", s.start AS a, s."end" AS b, s.tag, min(t.start) OVER w AS first, max(t."end") OVER w AS last
  FROM tokens t JOIN {spans} s ON t.doc = s.doc AND t.start >= s.start AND t."end" <= s."end" WINDOW w AS (PARTITION BY s.doc, s.start, s."end", s.tag)),
{name}_m AS (SELECT doc, i, arg_min(CASE WHEN start = a THEN 'B-' ELSE 'I-' END || tag, (a, b, tag)) AS label FROM {name}_in WHERE first = a AND last = b GROUP BY doc, i),
{name} AS (SELECT t.*, coalesce(m.label, 'O') AS label FROM tokens t LEFT JOIN {name}_m m USING (doc, i))"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(round_even(CASE WHEN {b} <> 0 THEN ({a})::DOUBLE / ({b}) END, 4), 0.0)"


SCORES = f"""precision, recall, {ratio('tp', 'tp + fp + fn')} AS accuracy, coalesce(round_even(CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) END, 4), 0.0) AS f1"""


def scored(columns: str, source: str) -> str:
    names = [c for c in columns.split(", ") if c]
    return f"SELECT {', '.join([*names, 'tp', 'fp', 'fn', 'tn'])}, {SCORES} FROM (SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall FROM ({source}))"


def both(gold: str, pred: str, keys: str = 'doc, start, "end", tag') -> str:
    return f"(SELECT {keys}, max(g) AS g, max(p) AS p FROM (SELECT DISTINCT {keys}, 1 AS g, 0 AS p FROM {gold} UNION ALL SELECT DISTINCT {keys}, 0, 1 FROM {pred}) GROUP BY ALL)"


COUNTS = "count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g = 0 AND p = 1) AS fp, count(*) FILTER (g = 1 AND p = 0) AS fn, 0::BIGINT AS tn"
ENTITY = f"SELECT coalesce(tag, 'overall') AS class_name, {COUNTS} FROM {both('gold', 'pred')} GROUP BY ROLLUP (tag)"
SPLIT = """split AS (SELECT doc_id, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'dev' ELSE 'test' END AS part
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents))"""


def scramble(text: str, key: str) -> str:
    """Drawn characters place by place; the key of a place is key|place from 0."""
    at = draw(f"({key}) || '|' || (i - 1)", "{n}")
    pick = lambda letters: f"substr('{letters}', 1 + {at.format(n=len(letters))}::INT, 1)"
    c = f"({text})[i:i]"
    return f"""coalesce(array_to_string(list_transform(range(1, length({text}) + 1), lambda i: CASE WHEN regexp_full_match({c}, '[0-9]') THEN {pick('0123456789')} WHEN regexp_full_match({c}, '[a-z]') THEN {pick('abcdefghijklmnopqrstuvwxyz')} WHEN regexp_full_match({c}, '[A-Z]') THEN {pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} ELSE {c} END), ''), '')"""


URL_KEPT = r"https?|www\.|\.(?:org|com|nl|de|be|co\.uk|gov|net|edu|care)"
SPAN_KEY = "'42|' || doc || '|' || tag || '|' || text"


def url(source: str) -> str:
    """(all columns of source, surrogate): the pieces between kept parts are scrambled, piece by piece."""
    return f"""SELECT * EXCLUDE (g, h), array_to_string(list_transform(range(1, len(g) + 1), lambda k: {scramble('g[k]', "key || '|' || (k - 1)")} || coalesce(h[k], '')), '') AS surrogate
FROM (SELECT *, string_split_regex(text, '{URL_KEPT}') AS g, regexp_extract_all(text, '{URL_KEPT}') AS h FROM ({source}))"""


EMAIL_TAIL = "CASE WHEN contains(text, '.') THEN regexp_extract(text, '(\\.[^.]*)$', 1) ELSE right(text, 1) END"
EMAILS = f"""SELECT * EXCLUDE (tail), {scramble('left(text, length(text) - length(tail))', 'key')} || tail AS surrogate FROM (SELECT *, {EMAIL_TAIL} AS tail FROM (SELECT *, {SPAN_KEY} AS key FROM gold WHERE tag = 'Email'))"""
CARDS = f"SELECT *, {scramble('text', 'key')} AS surrogate FROM (SELECT *, {SPAN_KEY} AS key FROM gold WHERE tag = 'ID')"
IPS = url(f"SELECT *, {SPAN_KEY} AS key FROM gold WHERE tag = 'URL_IP'")
MASKED = "text"
for _tag, _p in PATTERNS:
    MASKED = f"regexp_replace({MASKED}, '{_p}', '[{_tag.upper()}]', 'g')"
SHAPE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\p{L}0-9]', '-', 'g'), '\p{Lu}', 'A', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]', 'a', 'g'), '[0-9]', '#', 'g')"
TRIALS = f"""per AS (
  SELECT doc, sum(tp_a) AS tp_a, sum(fp_a) AS fp_a, sum(fn_a) AS fn_a, sum(tp_b) AS tp_b, sum(fp_b) AS fp_b, sum(fn_b) AS fn_b FROM (
    SELECT doc, g * p AS tp_a, (1 - g) * p AS fp_a, g * (1 - p) AS fn_a, 0 AS tp_b, 0 AS fp_b, 0 AS fn_b FROM {both('gold', 'a')}
    UNION ALL SELECT doc, 0, 0, 0, g * p, (1 - g) * p, g * (1 - p) FROM {both('gold', 'b')}) GROUP BY doc),
trials AS (
  SELECT trial, sum(CASE WHEN s THEN tp_b ELSE tp_a END) AS tp_a, sum(CASE WHEN s THEN fp_b ELSE fp_a END) AS fp_a, sum(CASE WHEN s THEN fn_b ELSE fn_a END) AS fn_a,
         sum(CASE WHEN s THEN tp_a ELSE tp_b END) AS tp_b, sum(CASE WHEN s THEN fp_a ELSE fp_b END) AS fp_b, sum(CASE WHEN s THEN fn_a ELSE fn_b END) AS fn_b
  FROM (SELECT *, trial > 0 AND {draw("'42|' || trial || '|' || doc", 2)} = 1 AS s FROM per, range(0, 10000) t(trial)) GROUP BY trial),
pr AS (SELECT trial, {ratio('tp_a', 'tp_a + fp_a')} AS pa, {ratio('tp_a', 'tp_a + fn_a')} AS ra, {ratio('tp_b', 'tp_b + fp_b')} AS pb, {ratio('tp_b', 'tp_b + fn_b')} AS rb FROM trials),
gaps AS (
  SELECT trial, 'precision' AS metric, round_even(abs(pa - pb), 6) AS gap FROM pr UNION ALL SELECT trial, 'recall', round_even(abs(ra - rb), 6) FROM pr
  UNION ALL SELECT trial, 'f1', round_even(abs(coalesce(round_even(CASE WHEN pa + ra <> 0 THEN 2 * pa * ra / (pa + ra) END, 4), 0) - coalesce(round_even(CASE WHEN pb + rb <> 0 THEN 2 * pb * rb / (pb + rb) END, 4), 0)), 6) FROM pr)"""
SPANS_OUT = 'doc AS doc_id, start, "end", tag, text'
DANGLING = "dangling AS (SELECT * REPLACE (CASE WHEN starts_with(label, 'B-') AND start % 2 = 0 THEN 'I-' || substr(label, 3) ELSE label END AS label) FROM labels)"
REPAIRED = """repaired AS (SELECT *, CASE WHEN starts_with(label, 'I-') AND coalesce(before = 'O' OR substr(before, 3) <> substr(label, 3), true) THEN 'B-' || substr(label, 3) ELSE label END AS fixed
  FROM (SELECT *, lag(label) OVER (PARTITION BY doc ORDER BY i) AS before FROM dangling))"""
LABELLED = f"{GOLD}, {TOKENS}, {bio('labels', 'gold')}"
TWO_LABELS = f"{GOLD}, {run('pred', 'run')}, {TOKENS}, {bio('la', 'gold')}, {bio('lb', 'pred')}, pairs AS (SELECT CASE WHEN la.label = 'O' THEN 'O' ELSE substr(la.label, 3) END AS gold, CASE WHEN lb.label = 'O' THEN 'O' ELSE substr(lb.label, 3) END AS pred FROM la JOIN lb USING (doc, i))"

SQL: dict[str, str] = {
    "mask_documents": f"WITH {GOLD}, n AS (SELECT doc, count(*) AS n FROM gold GROUP BY doc) SELECT doc_id, {MASKED} AS masked_text, coalesce(n, 0)::INT AS n_spans FROM documents LEFT JOIN n ON doc = doc_id",
    "mask_conversations": f"SELECT conv_id, turn, {MASKED} AS masked_text FROM conversations",
    "detect_all": f"WITH {GOLD} SELECT {SPANS_OUT} FROM gold",
    "phi_distribution": f"WITH {GOLD} SELECT tag, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM gold GROUP BY tag",
    "corpus_split": f"WITH {SPLIT} SELECT * FROM split",
    "phi_by_part_pivot": f"WITH {GOLD}, {SPLIT} SELECT tag, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'dev') AS dev, count(*) FILTER (part = 'test') AS test FROM gold JOIN split ON doc = doc_id GROUP BY tag",
    "tokenize": f'WITH {TOKENS} SELECT doc AS doc_id, i, start, "end", text FROM tokens',
    "sentence_segments": f'WITH {TOKENS}, {SENTENCES} SELECT doc AS doc_id, sent_id, min(start) AS start, max("end") AS "end", count(*) AS n_tokens FROM sents GROUP BY ALL',
    "word_shapes": f"WITH {TOKENS}, {WORDS} SELECT {SHAPE} AS shape, count(*) AS n FROM words GROUP BY 1",
    "token_context": f"WITH {TOKENS}, {SENTENCES} SELECT before2, before, token, after, after2, count(*) AS n FROM (SELECT lag(text, 2, '<PAD>') OVER w AS before2, lag(text, 1, '<PAD>') OVER w AS before, text AS token, lead(text, 1, '<PAD>') OVER w AS after, lead(text, 2, '<PAD>') OVER w AS after2 FROM sents WINDOW w AS (PARTITION BY doc, sent_id ORDER BY i)) GROUP BY ALL",
    "token_features": f"WITH {TOKENS}, {SENTENCES}, s AS (SELECT doc, sent_id, count(*) AS sent_length, arg_max(text, i) AS sent_end, sum(CASE WHEN text IN ('(', '[', '{{') THEN 1 WHEN text IN (')', ']', '}}') THEN -1 ELSE 0 END) <> 0 AS unmatched_bracket FROM sents GROUP BY ALL) SELECT sent_length, sent_end, unmatched_bracket, sum(sent_length)::BIGINT AS n FROM s GROUP BY ALL",
    "orthographic_flags": f"WITH {TOKENS}, {WORDS} SELECT regexp_matches(text, '{CAPITAL}') AND NOT regexp_matches(text, '\\p{{Ll}}') AS is_upper, regexp_full_match(text, '{OTHER}*{CAPITAL}\\p{{Ll}}*({OTHER}+{CAPITAL}\\p{{Ll}}*)*{OTHER}*') AS is_title, regexp_full_match(text, '\\p{{Nd}}+') AS is_digit, regexp_matches(text, '\\p{{Nd}}') AS has_digit, left(text, 1) AS prefix1, right(text, 3) AS suffix3, count(*) AS n FROM words GROUP BY ALL",
    "term_frequency": f"WITH {TOKENS}, {WORDS} SELECT lower(text) AS term, count(*) AS tf, count(DISTINCT doc) AS df FROM words GROUP BY 1",
    "vocabulary_size": f"WITH {TOKENS}, {WORDS} SELECT count(DISTINCT text) AS raw, count(DISTINCT lower(text)) AS normalised FROM words",
    "corpus_stats": f"WITH {TOKENS}, per AS (SELECT doc, count(*) AS tokens, count(*) FILTER (regexp_full_match(text, '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]+')) AS punctuation FROM tokens WHERE NOT regexp_full_match(text, '[\\x09-\\x0D\\x20]+') AND NOT starts_with(text, '===') GROUP BY doc), m AS (SELECT 'tokens' AS measure, tokens AS v FROM per UNION ALL SELECT 'punctuation', punctuation FROM per) SELECT measure, sum(v)::BIGINT AS total, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS std FROM m GROUP BY measure",
    "bio_encode": f"WITH {LABELLED} SELECT doc AS doc_id, i, start, \"end\", label FROM labels",
    "bio_to_biluo": f"WITH {LABELLED} SELECT doc AS doc_id, i, CASE WHEN starts_with(nxt, 'I') OR label = 'O' THEN label WHEN label[1] = 'B' THEN 'U' || substr(label, 2) ELSE 'L' || substr(label, 2) END AS biluo, label AS bio FROM (SELECT *, coalesce(lead(label) OVER (PARTITION BY doc ORDER BY i), '') AS nxt FROM labels)",
    "fix_dangling": f"WITH {LABELLED}, {DANGLING}, {REPAIRED} SELECT doc AS doc_id, i, label, fixed FROM repaired",
    "label_violations": f"WITH {LABELLED}, {DANGLING}, {REPAIRED} SELECT doc AS doc_id, i, label FROM repaired WHERE label <> fixed",
    "bio_to_spans": f"WITH {GOLD} SELECT doc AS doc_id, 'T' || (row_number() OVER (PARTITION BY doc ORDER BY start) - 1) AS ann_id, start, \"end\", tag FROM gold",
    "entity_metrics": f"WITH {GOLD}, {run('pred', 'run')} {scored('class_name', ENTITY)}",
    "macro_metrics": f"WITH {GOLD}, {run('pred', 'run')}, e AS ({scored('class_name', ENTITY)}) SELECT avg(f1) AS macro_f1, round_even(avg(accuracy), 4) AS macro_accuracy FROM e WHERE class_name <> 'overall'",
    "token_blind_metrics": f"WITH {TWO_LABELS} {scored('class_name', '''SELECT 'ENT' AS class_name, count(*) FILTER (gold <> 'O' AND pred <> 'O') AS tp, count(*) FILTER (gold = 'O' AND pred <> 'O') AS fp, count(*) FILTER (gold <> 'O' AND pred = 'O') AS fn, count(*) FILTER (gold = 'O' AND pred = 'O') AS tn FROM pairs''')}",
    "token_metrics": f"WITH {TWO_LABELS}, known AS (SELECT DISTINCT gold AS c FROM pairs), kept AS (SELECT * FROM pairs WHERE pred IN (SELECT c FROM known) OR pred = 'O'), per AS (SELECT c AS class_name, count(*) FILTER (gold = c AND pred = c) AS tp, count(*) FILTER (gold <> c AND pred = c) AS fp, count(*) FILTER (gold = c AND pred <> c) AS fn, count(*) FILTER (gold <> c AND pred <> c) AS tn FROM kept, known WHERE c <> 'O' GROUP BY c) {scored('class_name', '''SELECT * FROM per UNION ALL SELECT 'overall', coalesce(sum(tp), 0)::BIGINT, coalesce(sum(fp), 0)::BIGINT, coalesce(sum(fn), 0)::BIGINT, coalesce(sum(tn), 0)::BIGINT FROM per''')}",
    "annotator_agreement": f"WITH {GOLD}, {run('a', 'a')}, {run('b', 'b')}, n AS (SELECT tag, sum(g)::BIGINT AS n_a, sum(p)::BIGINT AS n_b, sum(g * p)::BIGINT AS n_both FROM {both('a', 'b', 'doc, start, \"end\", tag, text')} GROUP BY tag) SELECT *, CASE WHEN n_a = 0 THEN 'nan'::DOUBLE ELSE 2.0 * n_both / (n_a + n_b) END::DOUBLE AS f1 FROM n",
    "unflatten_tags": f"""WITH {GOLD}, {run('pred', 'run')}, flat(fine, coarse) AS (VALUES ('Email', 'URL_IP'), ('Phone_fax', 'Contact')),
p AS (SELECT doc, start, "end", coalesce(coarse, tag) AS tag FROM pred LEFT JOIN flat ON fine = tag), g AS (SELECT doc, start, "end", coalesce(coarse, tag) AS c, max(tag) AS tag FROM gold LEFT JOIN flat ON fine = tag GROUP BY ALL)
SELECT p.doc AS doc_id, p.start, p."end", coalesce(g.tag, p.tag) AS tag FROM p LEFT JOIN g ON p.doc = g.doc AND p.start = g.start AND p."end" = g."end" AND p.tag = g.c""",
    "run_summary": f"WITH {GOLD}, {run('a', 'a')}, {run('b', 'b')}, {SPLIT}, x AS (SELECT *, 'a' AS run_id FROM {both('gold', 'a')} UNION ALL SELECT *, 'b' FROM {both('gold', 'b')}), c AS ({scored('part, run_id', f'SELECT part, run_id, {COUNTS} FROM x JOIN split ON doc = doc_id GROUP BY part, run_id')}) SELECT * EXCLUDE (tn) FROM c",
    "significance_test": f"WITH {GOLD}, {run('a', 'a')}, {run('b', 'b')}, {TRIALS}, o AS (SELECT metric, gap AS observed FROM gaps WHERE trial = 0) SELECT metric, observed, count(*) FILTER (gap >= observed) AS as_large, (count(*) FILTER (gap >= observed) + 1.0)::DOUBLE / 10000 AS p_value FROM gaps JOIN o USING (metric) WHERE trial > 0 GROUP BY metric, observed",
    "surrogate_id": f"SELECT c_custkey, {scramble('c_name', chr(39) + '42|' + chr(39) + ' || c_custkey || ' + chr(39) + '|ID|' + chr(39) + ' || c_name')} AS surrogate FROM customer",
    "surrogate_email": f"WITH {GOLD} SELECT doc AS doc_id, start, surrogate FROM ({EMAILS})",
    "surrogate_url": f"SELECT page_id, surrogate FROM ({url(chr(83) + 'ELECT page_id, url AS text, ' + chr(39) + '42|' + chr(39) + ' || page_id || ' + chr(39) + '|URL_IP|' + chr(39) + ' || url AS key FROM pages')})",
    "surrogate_age": "SELECT l_orderkey, l_linenumber, 'aged ' || CASE WHEN l_partkey > 89 THEN 89 ELSE l_partkey END || ' or ' || CASE WHEN l_quantity > 89 THEN 89 ELSE l_quantity::INT END AS surrogate FROM lineitem",
    "surrogate_initials": """WITH m AS (
  SELECT c_custkey, substr(c_name, 1, 1) || '.' || upper(substr(c_mktsegment, 1, 1)) || '.' || lower(substr(c_mktsegment, 2, 2)) AS name,
         array_to_string(list_transform(list_sort(list_transform(range(97, 123), lambda c: md5('42|' || c_custkey || '|letters|' || chr(c::INT)) || chr(c::INT))), lambda x: right(x, 1)), '') AS p FROM customer)
SELECT c_custkey, translate(name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', p || upper(p)) AS surrogate FROM m""",
    "surrogate_zip": "SELECT c_custkey, '3512' || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || 'JE' AS surrogate FROM customer",
    "documents_without_annotations": f"WITH {GOLD} SELECT doc_id, length(text)::INT AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc FROM gold)",
    "documents_by_language": f"WITH {GOLD} SELECT lang, count(DISTINCT doc_id) AS n_docs, count(tag) AS n_spans FROM documents LEFT JOIN gold ON doc = doc_id GROUP BY lang",
} | {
    name: f"SELECT doc AS doc_id, start, start + length(text)::INT AS \"end\", tag, text FROM ({found(tag, pattern)})" for name, (tag, pattern) in zip(("detect_email", "detect_ip", "detect_phone", "detect_card"), PATTERNS, strict=True)
}
SQL["mask_custom_formatter"] = f"""WITH {GOLD}, cut AS (SELECT doc, list(struct_pack(s := start, e := "end", r := '<' || tag || ':' || length(text) || '>') ORDER BY start) AS l FROM gold GROUP BY doc)
SELECT doc_id, CASE WHEN l IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(l) + 1), lambda k: substr(text, 1 + coalesce(l[k - 1].e, 0), l[k].s - coalesce(l[k - 1].e, 0)) || l[k].r), '') || substr(text, 1 + l[len(l)].e) END AS masked_text
FROM documents LEFT JOIN cut ON doc = doc_id"""
SQL["masked_spans"] = f"""WITH {GOLD}, m AS (SELECT doc, start, tag, '[' || upper(tag) || ']' AS r, coalesce(sum(length('[' || upper(tag) || ']') - ("end" - start)) OVER (PARTITION BY doc ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM gold)
SELECT doc AS doc_id, (start + shift)::INT AS start, (start + shift + length(r))::INT AS "end", tag, r AS text FROM m"""
SQL["surrogate_date"] = f"""WITH d AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d FROM orders),
marks AS (SELECT d, unnest([make_date(year(d) - 1, 12, 21), make_date(year(d), 3, 21), make_date(year(d), 6, 21), make_date(year(d), 9, 23), make_date(year(d), 12, 21), make_date(year(d) + 1, 3, 21)]) AS m FROM (SELECT DISTINCT d FROM d)),
season AS (SELECT d, d - max(m) FILTER (m <= d) AS past, min(m) FILTER (m > d) - d - 1 AS left_ FROM marks GROUP BY d),
own AS (SELECT o_custkey, max(d) AS recent, min(past) AS past, min(left_) AS left_ FROM d JOIN season USING (d) GROUP BY o_custkey),
draws AS (SELECT *, 45 + {draw("'42|' || o_custkey || '|years'", 41)} AS years, CASE WHEN past >= left_ THEN -1 ELSE 1 END * (1 + {draw("'42|' || o_custkey || '|days'", 'greatest(past, left_, 1)')}) AS days FROM own),
near AS (SELECT o_orderkey, CASE WHEN date_sub('year', d, recent) > 89 THEN (d + to_years((date_sub('year', d, recent) - 89)::INT))::DATE ELSE d END AS d, years, days FROM d JOIN draws USING (o_custkey))
SELECT o_orderkey, ((d + to_years(years::INT))::DATE + days::INT)::DATE AS surrogate FROM near"""
SQL["corpus_shuffle"] = f"""WITH {GOLD}, own AS (SELECT DISTINCT doc, tag, text FROM gold),
ranked AS (SELECT tag, text, row_number() OVER (PARTITION BY tag ORDER BY md5('42|' || text), text) - 1 AS rank FROM (SELECT DISTINCT tag, text FROM own)),
mine AS (SELECT o.doc, o.tag, o.text, row_number() OVER (PARTITION BY o.doc, o.tag ORDER BY r.rank) - 1 AS i, count(*) OVER (PARTITION BY o.doc, o.tag) AS k, n - count(*) OVER (PARTITION BY o.doc, o.tag) AS free
         FROM own o JOIN ranked r USING (tag, text) JOIN (SELECT tag, count(*) AS n FROM ranked GROUP BY tag) USING (tag)),
others AS (SELECT d.doc, d.tag, r.text, row_number() OVER (PARTITION BY d.doc, d.tag ORDER BY r.rank) - 1 AS turn FROM (SELECT DISTINCT doc, tag FROM own) d JOIN ranked r ON r.tag = d.tag WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.doc = d.doc AND o.tag = d.tag AND o.text = r.text))
SELECT m.doc AS doc_id, m.tag, m.text, CASE WHEN free > 0 THEN o.text ELSE m.text END AS surrogate
FROM mine m LEFT JOIN others o ON o.doc = m.doc AND o.tag = m.tag AND o.turn = ({draw("'42|' || m.doc || '|' || m.tag", 'greatest(free, 1)')} + i) % greatest(free, 1)"""


def spelled(d: str, read: str = "d") -> str:
    """A date in the layout of its order: six of them, three with names of months. A name read that is long and short alike (May) counts as short."""
    month = lambda names: f"(CASE WHEN month({read}) = 5 THEN list_transform({names}, lambda x: x[:3]) ELSE {names} END)[month({d})]"
    nl = month("['januari', 'februari', 'maart', 'april', 'mei', 'juni', 'juli', 'augustus', 'september', 'oktober', 'november', 'december']")
    de = month("['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember']")
    days = "['Montag', 'Dienstag', 'Mittwoch', 'Donnerstag', 'Freitag', 'Samstag', 'Sonntag']"
    return f"""CASE o_orderkey % 6 WHEN 0 THEN strftime({d}, '%d-%m-%Y') WHEN 1 THEN strftime({d}, '%Y-%m-%d') WHEN 2 THEN strftime({d}, '%d ') || ({nl}) || strftime({d}, ' %Y')
WHEN 3 THEN CASE WHEN month({read}) = 5 THEN strftime({d}, '%b %d, %Y') ELSE strftime({d}, '%B %d, %Y') END WHEN 4 THEN {days}[isodow({d})] || strftime({d}, ' %d ') || ({de}) || strftime({d}, ' %Y') ELSE strftime({d}, '%d/%m/%y') END"""


ORDER_DAYS = "d AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"
SQL["parse_dates"] = f"WITH {ORDER_DAYS} SELECT o_orderkey::INT AS o_orderkey, {spelled('d')} AS text, d AS date, true AS has_year FROM d"
SQL["surrogate_date_texts"] = f"WITH {ORDER_DAYS}, n AS (SELECT *, ((d + to_years(12))::DATE - 5)::DATE AS later FROM d) SELECT o_orderkey::INT AS o_orderkey, {spelled('d')} AS text, {spelled('later')} AS surrogate FROM n"
SQL["parse_names"] = """WITH n AS (
  SELECT c_custkey, c_custkey % 4 AS k, ['Lucas', 'Annemarie', 'Özlem', 'J.'][c_custkey // 7 % 4 + 1] AS first, ['F.A.', 'Maria', 'Jan Piet'][c_custkey // 3 % 3 + 1] AS middle,
         ['de Groot', 'Janssen', 'van der Linden', '''t Hart', 'Bakker'][c_custkey // 5 % 5 + 1] AS last FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN first || ' ' || last WHEN 1 THEN 'Dhr. ' || first || ' ' || middle || ' ' || last WHEN 2 THEN last || ', ' || first ELSE 'Dr. ' || first || ' ' || last || ', Ph.D.' END AS text,
       CASE k WHEN 1 THEN 'Dhr.' WHEN 3 THEN 'Dr.' ELSE '' END AS title, first, CASE k WHEN 1 THEN middle ELSE '' END AS middle, last, CASE k WHEN 3 THEN ', Ph.D.' ELSE '' END AS suffix FROM n"""
SQL["parse_locations"] = """WITH n AS (SELECT s_suppkey, s_suppkey % 4 AS k, s_suppkey::VARCHAR AS number, lpad((s_suppkey % 9000)::VARCHAR, 4, '1') || ' AB' AS code FROM supplier)
SELECT s_suppkey, ['Parallelweg ' || number || ', ' || code || ' Groenlo', 'Waterkant ' || number || '-2, Arnhem-Zuid', 'De singel te Haarlem Nederland', 'Groenlo (Duitsland)'][k + 1] AS text, ['', '', 'Nederland', 'Duitsland'][k + 1] AS country,
       CASE k WHEN 0 THEN code ELSE '' END AS zip_code, ['Groenlo', 'Arnhem-Zuid', 'te Haarlem', 'Groenlo'][k + 1] AS place, ['Parallelweg', 'Waterkant', 'De singel', ''][k + 1] AS street, [number, number || '-2', '', ''][k + 1] AS house_number FROM n"""
SQL["training_fraction"] = f"WITH {TOKENS}, {SENTENCES} SELECT floor(count(*) * 0.25)::BIGINT AS n_sentences FROM (SELECT DISTINCT doc, sent_id FROM sents WHERE NOT regexp_full_match(text, '[\\x09-\\x0D\\x20]+'))"


def phones(source: str) -> str:
    """(all columns of source, surrogate): numbers by the numbering plan, place by place."""
    lists = {n: "[" + ", ".join(f"'{c}'" for c in values) + "]" for n, values in DIAL.items()}
    code = "CASE " + " ".join(f"WHEN area = {n} THEN {lists[n]}[1 + {draw("key || '|dial'", len(DIAL[n]))}]" for n in DIAL) + " ELSE '' END"
    area = "CASE " + " ".join(f"WHEN list_contains({lists[n]}, substr(digits, trunk + 1, {n})) THEN {n}" for n in sorted(DIAL, reverse=True)) + " ELSE 0 END"
    ahead = "length(regexp_replace(substr(body, 1, i - 1), '[^0-9]', '', 'g'))"
    own = f"({ahead} - trunk - area)"
    first = f"substr('123456789', 1 + {draw("key || '|0'", 9)}::INT, 1)"
    rest = f"substr('0123456789', 1 + {draw(f"key || '|' || {own}", 10)}::INT, 1)"
    place = f"CASE WHEN NOT regexp_full_match(body[i:i], '[0-9]') OR {ahead} < trunk THEN body[i:i] WHEN {ahead} < trunk + area THEN substr(code, {ahead} - trunk + 1, 1) WHEN {own} = 0 THEN {first} ELSE {rest} END"
    return f"""SELECT * EXCLUDE (body, digits, trunk, area, code), CASE WHEN length(digits) >= 7 THEN array_to_string(list_transform(range(1, length(body) + 1), lambda i: {place}), '') || substr(text, length(body) + 1) END AS surrogate
FROM (SELECT *, {code} AS code FROM (SELECT *, {area} AS area FROM (SELECT *, country + CASE WHEN substr(digits, country + 1, 1) = '0' THEN 1 ELSE 0 END AS trunk
FROM (SELECT *, CASE WHEN starts_with(body, '+31') THEN 2 WHEN starts_with(body, '0031') THEN 4 ELSE 0 END AS country, regexp_replace(body, '[^0-9]', '', 'g') AS digits
FROM (SELECT *, regexp_extract(text, '^[+0-9(][0-9()./ -]*') AS body FROM ({source}))))))"""


PHONES = phones(f"SELECT *, {SPAN_KEY} AS key FROM gold WHERE tag = 'Phone_fax'")
SURROGATES = f"""{GOLD}, made AS (
  SELECT doc, start, "end", tag, text, surrogate FROM ({EMAILS}) UNION ALL SELECT doc, start, "end", tag, text, surrogate FROM ({CARDS})
  UNION ALL SELECT doc, start, "end", tag, text, surrogate FROM ({IPS}) UNION ALL SELECT doc, start, "end", tag, text, surrogate FROM ({PHONES}))"""
TABLE = """numbered AS (SELECT doc::VARCHAR AS doc_id, 'T' || row_number() OVER (PARTITION BY doc ORDER BY start) AS ann_id, text, start, "end", tag, surrogate FROM made)"""


def spliced(fallback: str) -> str:
    return f"""WITH {SURROGATES},
cut AS (SELECT doc, start, "end", coalesce(lag("end") OVER (PARTITION BY doc ORDER BY start), 0) AS before, CASE WHEN coalesce(surrogate, '') = '' THEN {fallback} ELSE surrogate END AS put FROM made),
whole AS (SELECT doc, string_agg(substr(d.text, before + 1, start - before) || put, '' ORDER BY start) AS head, max("end") AS last FROM cut JOIN documents d ON d.doc_id = doc GROUP BY doc)
SELECT d.doc_id, coalesce(head || substr(d.text, last + 1), d.text) AS rewritten FROM documents d LEFT JOIN whole ON d.doc_id = doc"""


SQL["span_surrogates"] = f"WITH {SURROGATES} SELECT doc AS doc_id, start, tag, text, surrogate FROM made"
SQL["surrogate_documents"] = spliced("'[' || tag || ']'")
SQL["errors_ignore"] = spliced("text")
SQL["failed_replacements"] = f"WITH {SURROGATES} SELECT doc AS doc_id, start, tag, text FROM made WHERE coalesce(surrogate, '') = ''"
SQL["rewrite_table"] = f"WITH {SURROGATES}, {TABLE} SELECT *, NULL::VARCHAR AS manual_surrogate, false AS checked FROM numbered"
SQL["manual_override"] = f"WITH {SURROGATES}, {TABLE} SELECT doc_id, ann_id, CASE WHEN start % 3 = 0 THEN 'manual ' || ann_id ELSE surrogate END AS surrogate FROM numbered"
NUMBERS = "SELECT c_custkey, text, '42|' || c_custkey || '|Phone_fax|' || text AS key FROM (SELECT c_custkey, '+31 ' || ['6', '20', '113'][1 + c_custkey % 3] || '-' || lpad(c_custkey::VARCHAR, 8, '7') AS text FROM customer)"
SQL["surrogate_phone"] = f"SELECT c_custkey, text AS number, surrogate FROM ({phones(NUMBERS)})"
SQL["rule_tags_rewritten"] = """WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS k, lpad(c_custkey::VARCHAR, 7, '1') AS n FROM customer)
SELECT c_custkey, 29 AS start, (35 + length(k))::INT AS "end", 'Name' AS tag, 'Jansen' || k AS text FROM c
UNION ALL SELECT c_custkey, (47 + length(k))::INT, (54 + length(k))::INT, 'ID', n FROM c"""
SQL["dictionary_spans"] = r"""WITH w AS (
  SELECT doc_id, i, h[i] AS word, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::INT AS start
  FROM (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}''’-]+') AS h, string_split_regex(text, '[\p{L}\p{N}''’-]+') AS g FROM documents))),
n AS (SELECT doc_id, start, word, lead(word, 1) OVER o AS w1, lead(start + length(word), 1) OVER o AS e1, lead(word, 2) OVER o AS w2, lead(start + length(word), 2) OVER o AS e2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p(phrase, tag) AS (VALUES ('the of', 'A'), ('of the', 'A'), ('of the in', 'B'), ('de la', 'C'), ('der die', 'D')),
hit AS (
  SELECT doc_id, start, e1 AS "end", tag FROM n JOIN p ON p.phrase = lower(word || ' ' || w1) UNION ALL SELECT doc_id, start, e2, tag FROM n JOIN p ON p.phrase = lower(word || ' ' || w1 || ' ' || w2)),
best AS (SELECT doc_id, start, max("end")::INT AS "end", arg_max(tag, "end") AS tag FROM hit GROUP BY ALL)
SELECT b.doc_id, start, "end", tag, substr(d.text, start + 1, "end" - start) AS text FROM best b JOIN documents d USING (doc_id)"""
SQL["inline_markup"] = """WITH c AS (SELECT c_custkey, c_name || ' ' || c_mktsegment AS person, c_custkey::VARCHAR AS k FROM customer),
t AS (SELECT *, 'Naam ' || person || ' is < 9, nr ' || k || '.' AS plain FROM c)
SELECT c_custkey, plain, 5 AS start, (5 + length(person))::INT AS "end", 'PERSOON' AS tag, person AS text FROM t
UNION ALL SELECT c_custkey, plain, (17 + length(person))::INT, (17 + length(person) + length(k))::INT, 'ID', k FROM t"""
SQL["plugged_tagger"] = SQL["detect_email"]
SQL["merged_sentences"] = f"""WITH {LABELLED}, {DANGLING}, {SENTENCES},
j AS (SELECT s.doc, s.i, s.start, s."end", s.sent_id, d.label, s.i = min(s.i) OVER (PARTITION BY s.doc, s.sent_id) AS first FROM sents s JOIN dangling d USING (doc, i)),
m AS (SELECT *, greatest(0, sum((first AND label[1] <> 'I')::INT) OVER (PARTITION BY doc ORDER BY i) - 1)::INT AS merged FROM j)
SELECT doc AS doc_id, merged AS sent_id, min(start) AS start, max("end") AS "end", count(*) AS n_tokens FROM m GROUP BY doc, merged"""
SQL["space_tokens"] = f"WITH {TOKENS} SELECT doc AS doc_id, '<SPACE>' AS text, 'O' AS label, count(*) AS n FROM tokens WHERE regexp_full_match(text, '\\s+') GROUP BY doc"
SQL["escaped_blanks"] = f"WITH {TOKENS} SELECT regexp_replace(replace(text, chr(10), '#NEWLINE'), '\\s', '#SPACE', 'g') AS escaped, count(*) AS n FROM tokens GROUP BY 1"
SQL["development_holdout"] = "SELECT doc_id, CASE WHEN r <= ceil(n * 0.2) THEN 'dev' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)"
SQL["predefined_folds"] = f"WITH {SPLIT} SELECT *, CASE part WHEN 'train' THEN -1 ELSE 0 END AS fold FROM split WHERE part <> 'test'"
TWO_BIO = f"{GOLD}, {run('run', 'run')}, {TOKENS}, {bio('g', 'gold')}, {bio('p', 'run')}, pairs AS (SELECT doc, i, g.label AS gold, p.label AS pred FROM g JOIN p USING (doc, i))"
SQL["bio_report"] = f"""WITH {TWO_BIO}, names AS (SELECT gold AS label FROM pairs UNION SELECT pred FROM pairs),
c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) AS support, count(*) FILTER (pred = label) AS found FROM names JOIN pairs ON gold = label OR pred = label WHERE label <> 'O' GROUP BY label),
r AS (SELECT *, CASE WHEN found > 0 THEN tp / found ELSE 0.0 END::DOUBLE AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END::DOUBLE AS r FROM c)
SELECT label, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END::DOUBLE AS f1, support, (row_number() OVER (ORDER BY substr(label, 2), label[1]) - 1)::INT AS nth FROM r"""
SQL["metric_lines"] = f"WITH entity AS ({SQL['entity_metrics']}) SELECT class_name, printf('%-20s\ttp: %-5d - fp: %-5d - fn: %-5d - tn: %-5d - precision: %.4f - recall: %.4f - accuracy: %.4f - f1-score: %.4f', class_name, tp, fp, fn, tn, precision, recall, accuracy, f1) AS line FROM entity"
