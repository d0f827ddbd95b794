"""DuckDB SQL for the queries, by name."""

from __future__ import annotations

from .functions.patterns import EMAIL, PHONE, SSN
from .operators.generator import FORMS, POOLS, RANGES, SENTENCES, SHARES, parts_of

MARK = "chr(65535)"


def scan(docs: str, key: str = "doc_id") -> str:
    """CTEs up to `scan`: (key, label, rank, text, start, end) of the structured patterns in docs(key, text)."""
    parts = " UNION ALL ".join(
        f"SELECT {key}, '{label}' AS label, {i} AS rank, string_split(regexp_replace(text, '{p}', {MARK} || '\\0' || {MARK}, 'g'), {MARK}) AS parts FROM docs"
        for i, (label, p) in enumerate([("EMAIL", EMAIL), ("PHONE", PHONE), ("SSN", SSN)])
    )
    return f"""
WITH docs AS ({docs}), parts AS ({parts}), places AS (
  SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM parts WHERE len(parts) > 1
), scan AS (
  SELECT {key}, label, rank, parts[i] AS text, list_sum(list_transform(parts[1:i - 1], lambda x: length(x)))::INT AS start,
         (list_sum(list_transform(parts[1:i - 1], lambda x: length(x))) + length(parts[i]))::INT AS "end" FROM places
)"""


DOCS = scan("SELECT doc_id, coalesce(text, '') AS text FROM documents")
SENSITIVITY = "CASE label WHEN 'SSN' THEN 5 ELSE 4 END"
TOKENS = {
    "label": "'[' || label || ']'",
    "mask": "repeat('•', length(text))",
    "remove": "''",
    "partial": """CASE WHEN label = 'EMAIL' AND contains(text, '@') THEN substr(text, 1, least(1, strpos(text, '@') - 1)) || repeat('•', greatest(strpos(text, '@') - 2, 1))
      || substr(text, strpos(text, '@')) WHEN length(text) > 4 THEN repeat('•', length(text) - 4) || right(text, 4) ELSE repeat('•', length(text)) END""",
}


def redacted(strategy: str, least: int = 0) -> str:
    return DOCS + f""", tokens AS (
  SELECT *, {TOKENS[strategy]} AS token FROM scan WHERE {SENSITIVITY} >= {least}
), lists AS (
  SELECT doc_id, count(*) AS n, list({{'s': start, 'e': "end", 't': token}} ORDER BY start DESC, "end" DESC, rank) AS l FROM tokens GROUP BY doc_id
)
SELECT d.doc_id, sha256(CASE WHEN l IS NULL THEN d.text ELSE list_reduce(list_prepend({{'s': 0, 'e': 0, 't': d.text}}, l),
       lambda a, x: {{'s': 0, 'e': 0, 't': substr(a.t, 1, x.s) || x.t || substr(a.t, x.e + 1)}}).t END) AS redacted_sha256, coalesce(n, 0)::INT AS replaced
FROM docs d LEFT JOIN lists ON d.doc_id = lists.doc_id"""


ORDER_LINES = """
WITH order_lines AS (
  SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""
LINES = ORDER_LINES + """, lines AS (
  SELECT l_orderkey // 8 AS doc_id, (l_partkey % 500)::INT AS start, (l_partkey % 500 + l_quantity)::INT AS "end", l_returnflag AS label,
         l_linenumber::DOUBLE / 10 AS score, (l_orderkey * 8 + l_linenumber)::BIGINT AS seq, l_linestatus AS status FROM order_lines
)"""
#: White space of the Unicode class, with the separators that Python counts.
BLANK = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def snapped(start: str, end: str) -> str:
    floor = f"({start} + ({end} - {start}) * 3 // 4)"
    tail = rf"length(regexp_extract(substr(text, {floor} + 1, {end} - {floor}), '([^{BLANK}]*)\z'))"
    return f"(CASE WHEN {tail} < {end} - {floor} THEN {end} - {tail} ELSE {end} END)"


WINDOWS = f"""
WITH RECURSIVE w(doc_id, text, n, chunk_no, start, stop) AS (
  SELECT doc_id, text, length(text), 0, 0, CASE WHEN length(text) <= 1200 THEN length(text) ELSE {snapped("0", "1200")} END
  FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, chunk_no + 1, begin, CASE WHEN begin + 1200 < n THEN {snapped("begin", "(begin + 1200)")} ELSE n END
  FROM (SELECT *, greatest(stop - 200, start + 1) AS begin FROM w WHERE stop < n)
)
SELECT doc_id, chunk_no::INT AS chunk_no, start::INT AS start, (stop - start)::INT AS characters FROM w"""

ORDERED = DOCS + """, ordered AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, rank) - 1)::INT AS index FROM scan
)"""


def exported(line: str, head: str, before: str, between: str, after: str) -> str:
    return ORDERED + f""", lines AS (
  SELECT doc_id, {before} || string_agg({line}, {between} ORDER BY index) || {after} AS body FROM ordered GROUP BY doc_id
)
SELECT d.doc_id, {head} || coalesce(body, '') AS export FROM docs d LEFT JOIN lines l ON d.doc_id = l.doc_id"""


SIDES = LINES + """, pred AS (
  SELECT DISTINCT doc_id, start + CASE WHEN "end" - start > 40 THEN 1 ELSE 0 END AS start, "end", label FROM lines WHERE score >= 0.2
), gold AS (
  SELECT DISTINCT doc_id, start, "end", label FROM lines WHERE score <= 0.4
), pairs AS (
  SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, (p.doc_id IS NOT NULL)::INT AS p, (g.doc_id IS NOT NULL)::INT AS g
  FROM pred p FULL JOIN gold g ON p.doc_id = g.doc_id AND p.start = g.start AND p."end" = g."end" AND p.label = g.label
), counts AS (
  SELECT sum(p * g)::BIGINT AS hit, sum(p * (1 - g))::BIGINT AS extra, sum((1 - p) * g)::BIGINT AS miss FROM pairs
), ratios AS (
  SELECT *, CASE WHEN hit + extra = 0 THEN 0 ELSE hit / (hit + extra) END AS precision, CASE WHEN hit + miss = 0 THEN 0 ELSE hit / (hit + miss) END AS recall FROM counts
), scored AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ratios
)"""


def gold_ctes() -> str:
    """CTEs up to `sentences`: (doc_id, p), p being the list of texts and labels of a customer's sentence."""
    draw = lambda name, n: f"(('0x' || substr(md5(concat_ws('|', c_custkey, '{name}')), 1, 8))::BIGINT % {n})"
    fields = [f"{pool}[({draw(name, len(pool))} + 1)::INT] AS {name}" for name, pool in POOLS.items()]
    for name, (low, high, digits) in RANGES.items():
        number = f"({draw(name, high - low + 1)} + {low})::VARCHAR"
        fields.append(f"{number if digits == 1 else f"lpad({number}, {digits}, '0')"} AS {name}")
    fields += [f'{draw(label + "?", SHARES)} AS "{label}?"' for label in FORMS]
    joined = lambda form: " || ".join(x for literal, name in parts_of(form) for x in ([f"'{literal}'"] if literal else []) + ([name] if name else []))
    values = [f'CASE {" ".join(f"""WHEN "{label}?" < {below} THEN {joined(form)}""" for below, form in forms)} END AS {label}' for label, forms in FORMS.items()]
    cases = []
    for i, sentence in enumerate(SENTENCES):
        items = []
        for literal, label in parts_of(sentence):
            items += [f"{{'t': '{literal}', 'l': NULL::VARCHAR}}"] if literal else []
            items += [f"{{'t': {label}, 'l': '{label}'}}"] if label else []
        cases.append(f"WHEN {i} THEN [{', '.join(items)}]")
    return f"""
WITH drawn AS (SELECT c_custkey AS doc_id, {', '.join(fields)} FROM customer), filled AS (SELECT doc_id, {', '.join(values)} FROM drawn),
sentences AS (SELECT doc_id, CASE (doc_id % {len(SENTENCES)})::INT {' '.join(cases)} END AS p FROM filled)"""


VOCABULARY = """
WITH words AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS piece, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents
), vocab AS (
  SELECT piece, row_number() OVER (ORDER BY min({'d': doc_id, 'p': pos})) - 1 AS id, ltrim(piece, '▁') AS body FROM words GROUP BY piece
), used AS (
  SELECT DISTINCT unnest(string_split(text, ' ')) AS piece FROM benchmark
), flagged AS (
  SELECT *, regexp_matches(body, '^[\\x00-\\x7f\\p{Latin}]*\\z') AS latin, piece = 'the' OR body = '' OR regexp_matches(body, '^\\p{Nd}+\\z') AS safe FROM vocab
), kept AS (
  SELECT piece, id AS old_id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM flagged
  WHERE safe OR (length(body) <= 3 AND latin) OR piece IN (SELECT piece FROM used)
)"""

BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ORACLES = {
    "pii_scan": DOCS + ' SELECT doc_id, label, start, "end", text FROM scan',
    "pii_scan_pages": scan("SELECT page_id, coalesce(html, '') AS text FROM pages", "page_id") + ' SELECT page_id, label, start, "end", text FROM scan',
    "pii_label_counts": DOCS + """
SELECT label, CASE label WHEN 'EMAIL' THEN 'Email' WHEN 'PHONE' THEN 'Phone' ELSE 'National ID' END AS display,
       count(DISTINCT doc_id) AS documents, count(*) AS entities FROM scan GROUP BY label""",
    "pii_by_source": DOCS + """
SELECT source, lang, label, count(*) AS entities FROM scan JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id) GROUP BY ALL""",
    "doc_risk": DOCS + f""", per_doc AS (
  SELECT d.doc_id, count(label)::INT AS total, max({SENSITIVITY}) AS peak FROM docs d LEFT JOIN scan s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), risks AS (
  SELECT doc_id, total, (CASE WHEN total = 0 THEN 0 ELSE least(100, peak * 15 + least(25, total * 2)) END)::INT AS risk FROM per_doc
)
SELECT *, CASE WHEN risk >= 60 THEN 'High' WHEN risk >= 30 THEN 'Medium' WHEN risk > 0 THEN 'Low' ELSE 'None' END AS band FROM risks""",
    **{f"redact_{s}": redacted(s) for s in TOKENS},
    "redact_min_sensitivity": redacted("label", 5),
    "redact_mapping": DOCS + " SELECT DISTINCT doc_id, text AS value, arg_min('[' || label || ']', start * 10 - rank) OVER (PARTITION BY doc_id, text) AS token FROM scan",
    "clip_flags": f"""
SELECT doc_id, least(length(coalesce(text, '')), 2000)::INT AS characters, length(coalesce(text, '')) > 2000 AS truncated,
       NOT regexp_matches(substr(coalesce(text, ''), 1, 2000), '[^{BLANK}]') AS blank FROM documents""",
    "chunk_windows": WINDOWS,
    "batch_totals": scan("SELECT page_id, coalesce(html, '') AS text FROM pages", "page_id") + """
SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM scan) AS entities""",
    "analyze_distinct_texts": DOCS + f""", per_doc AS (
  SELECT d.doc_id, count(label)::INT AS total, max({SENSITIVITY}) AS peak FROM docs d LEFT JOIN scan s ON d.doc_id = s.doc_id GROUP BY d.doc_id
)
SELECT p.doc_id, total, (CASE WHEN total = 0 THEN 0 ELSE least(100, peak * 15 + least(25, total * 2)) END)::INT AS risk, false AS truncated
FROM per_doc p JOIN documents USING (doc_id)""",
    "gold_sentences": f"""{gold_ctes()}, pieces AS (
  SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM sentences
)
SELECT doc_id, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x.t))), 0)::INT AS start,
       (coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x.t))), 0) + length(p[i].t))::INT AS "end", p[i].l AS label, p[i].t AS text
FROM pieces WHERE p[i].l IS NOT NULL""",
    "markers": """
WITH m(word, label) AS (VALUES ('the', 'PER'), ('und', 'LOC')), parts AS (
  SELECT doc_id, word, label, string_split(text, word) AS parts FROM documents, m
), places AS (
  SELECT *, unnest(range(1, len(parts))) AS i FROM parts
)
SELECT doc_id, label, count(*) AS spans, sum(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(word))::BIGINT AS starts
FROM places GROUP BY doc_id, label""",
    "merge_islands": LINES + """, marked AS (
  SELECT *, max("end") OVER (PARTITION BY doc_id, label ORDER BY start, score DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lines
), numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR start - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label ORDER BY start, score DESC, seq) AS island FROM marked
)
SELECT doc_id, label, min(start) AS start, max("end") AS "end", max(score) AS score, min(seq) AS pos FROM numbered GROUP BY doc_id, label, island""",
    "resolve_overlaps": LINES + """, lists AS (
  SELECT doc_id, list({'k': [{'s': start, 'e': "end", 'l': label, 'c': score, 'q': seq}]} ORDER BY score DESC, start, seq) AS l FROM lines GROUP BY doc_id
), kept AS (
  SELECT doc_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a.k, lambda o: o.s < x.k[1].e AND x.k[1].s < o.e)) > 0 THEN a
    ELSE {'k': list_concat(a.k, x.k)} END).k) AS r FROM lists
)
SELECT doc_id, r.s AS start, r.e AS "end", r.l AS label, r.c AS score, r.q AS pos FROM kept""",
    "unmatched_spans": LINES + """
SELECT doc_id, start, "end", label, seq FROM lines a WHERE status = 'O' AND NOT EXISTS (
  SELECT 1 FROM lines b WHERE b.status = 'F' AND a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end")""",
    "repaired_spans": LINES + """, met AS (
  SELECT a.doc_id, a.seq, a.start, a."end", a.label, a.score, min({'s': b.start, 'e': b."end"}) AS m, count(b.start) AS k FROM lines a
  LEFT JOIN lines b ON b.status = 'F' AND a.doc_id = b.doc_id AND a.label = b.label AND a.start < b."end" AND b.start < a."end"
  WHERE a.status = 'O' GROUP BY ALL
)
SELECT doc_id, seq, CASE WHEN k > 0 THEN m.s ELSE start END AS start, CASE WHEN k > 0 THEN m.e ELSE "end" END AS "end", label,
       CASE WHEN k > 0 THEN greatest(score, 0.99) ELSE score END AS score, k > 0 AS verified FROM met""",
    "contained_spans": LINES + """, marked AS (
  SELECT *, max("end") OVER (PARTITION BY doc_id, label ORDER BY start, "end" DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lines
)
SELECT doc_id, start, "end", label, seq FROM marked WHERE before IS NULL OR "end" > before""",
    "deduped_spans": LINES + """
SELECT DISTINCT ON (doc_id, s, label) doc_id, s AS start, 30 AS "end", label, score, seq FROM (SELECT *, start % 20 AS s FROM lines) ORDER BY doc_id, s, label, score DESC, seq""",
    "label_join": """
WITH codes AS (SELECT ['PER', 'LOC', 'EMAIL', 'SSN', 'misc'][(l_partkey % 5 + 1)::INT] AS code, count(*) AS lines FROM lineitem GROUP BY 1),
dim(code, display, sensitivity, color, structured) AS (VALUES ('PER', 'Person', 4, '#e2504f', false), ('LOC', 'Location', 2, '#d99b2b', false),
  ('EMAIL', 'Email', 4, '#2a9d8f', true), ('SSN', 'National ID', 5, '#b5179e', true))
SELECT c.code, coalesce(display, 'Misc') AS display, coalesce(sensitivity, 2)::INT AS sensitivity, coalesce(color, '#94a3b8') AS color, coalesce(structured, false) AS structured, lines
FROM codes c LEFT JOIN dim d ON c.code = d.code""",
    "export_rows": ORDERED + ' SELECT doc_id, index, label, text, start, "end", 0.99::DOUBLE AS score, true AS verified FROM ordered',
    "export_jsonl": exported("to_json({'index': index, 'label': label, 'text': text, 'start': start, 'end': \"end\", 'score': 0.99::DOUBLE, 'verified': true})::VARCHAR", "''", "''", "chr(10)", "''"),
    "export_csv": exported("concat_ws(',', index, label, text, start, \"end\", '0.99', 'True')", "'index,label,text,start,end,score,verified' || chr(13) || chr(10)", "''", "chr(13) || chr(10)", "chr(13) || chr(10)"),
    "export_csv_browser": exported("concat_ws(',', index, label, '\"' || text || '\"', start, \"end\", '0.99', 'true')", "'index,label,text,start,end,score,verified'", "chr(10)", "chr(10)", "''"),
    "export_json": ORDERED + f""", per_doc AS (
  SELECT d.doc_id, length(d.text)::INT AS characters, count(label)::INT AS total, max({SENSITIVITY}) AS peak,
         coalesce(string_agg(start || ':' || label || ':' || o.text, ' ' ORDER BY index), '') AS labels
  FROM docs d LEFT JOIN ordered o ON d.doc_id = o.doc_id GROUP BY d.doc_id, d.text
)
SELECT doc_id, characters, total, (CASE WHEN total = 0 THEN 0 ELSE least(100, peak * 15 + least(25, total * 2)) END)::INT AS risk, sha256(labels) AS entities_sha256
FROM per_doc""",
    "dev_split": """
SELECT doc_id, row_number() OVER (ORDER BY md5('11|' || doc_id), doc_id) <= (SELECT greatest(1, floor(count(*) * 0.05)::BIGINT) FROM documents) AS is_dev FROM documents""",
    "span_scores": SIDES + " SELECT hit, extra, miss, precision, recall, f1 FROM scored",
    "span_fidelity": SIDES + """, docs AS (SELECT DISTINCT o_orderkey // 8 AS doc_id FROM orders), bad AS (SELECT DISTINCT doc_id FROM pairs WHERE p <> g)
SELECT f1 AS span_agreement, (SELECT avg((b.doc_id IS NULL)::INT)::DOUBLE FROM docs d LEFT JOIN bad b ON d.doc_id = b.doc_id) AS exact_documents FROM scored""",
    "bio_decode": (BIO_DECODE := ORDER_LINES + """, tokens AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS pos, (l_linenumber * 10)::INT AS start, (l_linenumber * 10 + 5)::INT AS "end",
         ['O', 'B-PER', 'I-PER', 'I-PER', 'B-EMAIL', 'I-EMAIL'][(l_partkey % 6 + 1)::INT] AS name, (l_partkey % 100) / 100 AS score FROM order_lines
), named AS (
  SELECT *, CASE WHEN name <> 'O' THEN substr(name, 3) END AS label FROM tokens
), opened AS (
  SELECT *, CASE WHEN label IS NOT NULL AND (name LIKE 'B%' OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY pos)) THEN 1 ELSE 0 END AS opens FROM named
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM opened
)
SELECT doc_id, min(start) AS start, max("end") AS "end", min(label) AS label, min(score) AS score FROM numbered WHERE label IS NOT NULL GROUP BY doc_id, span"""),
    "bio_decode_arrays": BIO_DECODE,
    "bio_encode": ORDER_LINES + """, t AS (
  SELECT l_orderkey AS doc_id, (l_linenumber * 10)::INT AS start, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INT AS pos FROM order_lines
), s AS (
  SELECT l_orderkey AS doc_id, l_linenumber * 20 AS a, l_linenumber * 20 + 15 AS b, ['PER', 'LOC', 'ODD'][(l_partkey % 3 + 1)::INT] AS label FROM order_lines
)
SELECT t.doc_id, pos, start, (CASE WHEN label = 'PER' THEN 1 WHEN label = 'LOC' THEN 3 ELSE 0 END + CASE WHEN label IN ('PER', 'LOC') AND start <> a THEN 1 ELSE 0 END)::INT AS code
FROM t LEFT JOIN s ON t.doc_id = s.doc_id AND start >= a AND start + 5 <= b""",
    "highlight_segments": ORDERED + """, chained AS (
  SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY index), 0) AS prev FROM ordered
), ends AS (
  SELECT d.doc_id, length(d.text) AS n, coalesce(arg_max("end", index), 0) AS last FROM docs d LEFT JOIN ordered o ON d.doc_id = o.doc_id GROUP BY ALL
), pieces AS (
  SELECT doc_id, index * 2 AS k, NULL AS label, start - prev AS characters FROM chained WHERE start > prev
  UNION ALL SELECT doc_id, index * 2 + 1, label, "end" - start FROM chained
  UNION ALL SELECT doc_id, 1000000000, NULL, n - last FROM ends WHERE last < n
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, label, characters::INT AS characters FROM pieces""",
    "distinct_texts": "SELECT count(*) AS documents, count(DISTINCT coalesce(text, '')) AS texts FROM documents",
    "upload_lines": rf"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS parts FROM documents)
)
SELECT doc_id, line_no::INT AS line_no, length(line)::INT AS characters FROM lines WHERE regexp_matches(line, '[^{BLANK}]')""",
    "pasted_lines": """
WITH lines AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(11), chr(12), chr(13), chr(160)))), lambda x: x <> '')) AS line FROM documents
), numbered AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list(line) AS l FROM lines GROUP BY doc_id)
)
SELECT doc_id, i::VARCHAR AS id, length(line)::INT AS characters FROM numbered""",
    "pasted_csv": """
WITH lines AS (
  SELECT doc_id, unnest(list_transform(string_split(text, chr(10))[2:], lambda x: CASE WHEN contains(x, ',') THEN substr(x, strpos(x, ',') + 1) ELSE '' END)) AS line FROM documents
), trimmed AS (
  SELECT doc_id, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13), chr(160))) AS line FROM lines
)
SELECT doc_id, count(*) AS rows, sum(length(line))::BIGINT AS characters FROM trimmed WHERE line <> '' GROUP BY doc_id""",
    "corpus_lines": """
WITH lines AS (SELECT trim(unnest(string_split(text, chr(10))), concat(' ', chr(9), chr(11), chr(12), chr(13), chr(160))) AS line FROM documents)
SELECT count(*) AS lines, count(DISTINCT line) AS unique_lines FROM lines WHERE length(line) > 15 AND length(line) < 600""",
    "dictionary_spans": """
WITH words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark), texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, word, ((length(text) - length(replace(text, word, ''))) // length(word))::BIGINT AS spans
FROM texts, words WHERE length(word) > 3 AND contains(text, word)""",
    "file_lines": rf"""
WITH ordered AS (
  SELECT lang, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT coalesce(lang, '-') AS lang, doc_id, string_split_regex(coalesce(text, ''), '{BREAKS}') AS parts FROM documents)
), numbered AS (
  SELECT dense_rank() OVER (ORDER BY lang) - 1 AS path_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS line_no, line FROM ordered
)
SELECT path_no::INT AS path_no, line_no, length(line)::INT AS characters FROM numbered WHERE regexp_matches(line, '[^{BLANK}]')""",
    "corpus_head": rf"""
WITH ordered AS (
  SELECT lang, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT coalesce(lang, '-') AS lang, doc_id, string_split_regex(coalesce(text, ''), '{BREAKS}') AS parts FROM documents)
), fitting AS (
  SELECT lang, doc_id, pos, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13), chr(160))) AS line FROM ordered
)
SELECT sha256(line) AS line_sha256 FROM fitting WHERE length(line) > 15 AND length(line) < 600 ORDER BY lang, doc_id, pos LIMIT 3000""",
    "vocabulary_trim": VOCABULARY + " SELECT piece, old_id, new_id FROM kept",
    "vocabulary_latin": VOCABULARY + " SELECT count(*) AS pieces, sum(length(piece))::BIGINT AS characters FROM flagged WHERE safe OR latin",
    "translated_ids": VOCABULARY + """
SELECT count(*) AS ids, count(*) FILTER (new_id IS NULL) AS pruned, max(new_id) AS last FROM vocab LEFT JOIN kept ON vocab.id = kept.old_id""",
    "added_tokens": VOCABULARY + """, every AS (
  SELECT piece, ltrim(piece, '▁') AS body FROM (SELECT piece FROM vocab UNION SELECT piece FROM used)
), keep AS (
  SELECT piece FROM every WHERE piece = 'the' OR body = '' OR regexp_matches(body, '^\\p{Nd}+\\z') OR regexp_matches(body, '^[\\x00-\\x7f\\p{Latin}]*\\z')
), renumbered AS (
  SELECT piece, id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM vocab WHERE piece IN (SELECT piece FROM keep)
)
SELECT u.piece AS content, coalesce(id, 1099511627776 + length(u.piece)) AS id, coalesce(new_id, 1099511627776 + length(u.piece)) AS new_id
FROM used u LEFT JOIN renumbered r ON u.piece = r.piece WHERE u.piece IN (SELECT piece FROM keep)""",
    "divergence_sample": VOCABULARY + """, lines AS (
  SELECT trim(unnest(string_split(text, chr(10))[1:500]), concat(' ', chr(9), chr(11), chr(12), chr(13), chr(160))) AS line FROM documents
), long AS (
  SELECT row_number() OVER () AS n, line FROM lines WHERE length(line) > 20
), marked AS (
  SELECT n, bool_or(k.piece IS NULL) AS changed FROM (SELECT n, unnest(string_split(line, ' ')) AS piece FROM long) w LEFT JOIN kept k ON w.piece = k.piece GROUP BY n
)
SELECT coalesce(avg(changed::INT), 0)::DOUBLE AS divergence, count(*) AS lines FROM marked""",
    "alias_chains": "SELECT c_custkey AS alias, (c_custkey - 1) // 10 * 10 + 1 AS target FROM customer WHERE c_custkey > 0 AND c_custkey % 10 <> 1",
    "reached_names": """
WITH RECURSIVE r(name) AS (SELECT c_custkey FROM customer WHERE c_custkey % 100 = 1 UNION SELECT c_custkey * 2 FROM r JOIN customer ON name = c_custkey)
SELECT c_custkey AS name, c_mktsegment FROM customer WHERE c_custkey IN (SELECT name FROM r)""",
    "streamed_entities": DOCS + ' SELECT doc_id, label, start, "end", text FROM scan',
}
