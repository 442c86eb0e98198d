"""The same results as ``catalog`` in DuckDB SQL, for checking.

DuckDB's RE2 has no look-around and no back-references, so the artifact rules are stated
in other words here: a repeated letter is one of 52 alternatives, a symbol token is its
span from first to last word character, and standalone punctuation is decided character
by character from both neighbours.
"""

from __future__ import annotations

import string

from palimpsest.operators.prompts import TEMPLATES, DEFAULT_SYSTEM
from palimpsest.operators.quality import COMMON_WORDS
from palimpsest.operators.tasks import TASK_TRAINING

SQL: dict[str, str] = {}

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"a-zA-Z0-9_\p{L}\p{N}"
SYM = r"@#$%^&*+=<>|`~\[\]{}"
SPECIAL = rf"""[^a-zA-Z0-9.,!?;:''"()\-_/{WS}]{{2,}}"""
TOKEN = f"[^{WS}]+"
RUNS = "|".join(f"{c}{{3,}}" for c in string.ascii_letters)
REPEAT = f"[{W}]*({RUNS})[{W}]*"
GENERAL = f"[{W}][^{WS}]*[{SYM}][^{WS}]*[{W}]"
GUARD = rf"(?:[{W}]{{1,2}}&[{W}]{{1,2}}|[{W}]+=[{W}]+|\p{{Nd}}+\*\p{{Nd}}+)"
LAST = rf"(^|[{WS}])([^{W}{WS}]*){GUARD}\n?$"
LAST_CORE = rf"(?:^|[{WS}])[^{W}{WS}]*({GUARD})\n?$"
EXCEPTIONS = r"^[a-zA-Z]{1,2}&[a-zA-Z]{1,2}$|^[a-zA-Z]+=+[a-zA-Z]+$|^[0-9]+\*[0-9]+$"
# Characters outside ASCII in the tables, mapped one to one to unused control characters:
# DuckDB counts edits in bytes.
ACCENTS = "èéêçÉÈÊößäüÄÖóíñÇÓÑÍÜ"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def special_list(t: str) -> str:
    return f"regexp_extract_all({t}, '{SPECIAL}')"


def general_list(t: str) -> str:
    """Candidates without exceptions; a guarded closing token keeps only its tail."""
    core = f"regexp_extract({t}, '{LAST_CORE}', 1)"
    return (
        f"list_filter(CASE WHEN {core} = '' THEN regexp_extract_all({t}, '{GENERAL}') "
        f"ELSE list_append(regexp_extract_all(regexp_replace({t}, '{LAST}', '\\1'), '{GENERAL}'), "
        f"regexp_extract({core}, '[&=*].*$')) END, "
        f"lambda x: NOT regexp_matches(x, '{EXCEPTIONS}'))"
    )


def repeat_list(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '{REPEAT}', 1), lambda x: x[1:1])"


def remove_special(t: str) -> str:
    return f"regexp_replace({t}, '{SPECIAL}', '', 'g')"


def remove_general(t: str) -> str:
    """A guarded closing token is cut back to its first word before the rest is removed."""
    cut = (
        rf"regexp_replace({t}, '((?:^|[{WS}])[^{W}{WS}]*)(?:([{W}]{{1,2}})&[{W}]{{1,2}}"
        rf"|([{W}]+)=[{W}]+|(\p{{Nd}}+)\*\p{{Nd}}+)(\n?)$', '\1\2\3\4\5')"
    )
    return f"regexp_replace({cut}, '{GENERAL}', '', 'g')"


def collapse(t: str) -> str:
    marked = f"regexp_replace({t}, '{REPEAT}', chr(1) || '\\1' || chr(1), 'g')"
    return f"regexp_replace({marked}, '\\x01([a-zA-Z])[a-zA-Z]*\\x01', '\\1', 'g')"


def stray(t: str) -> str:
    """Standalone punctuation goes by its neighbours in the text as it stood; then carets."""
    kept = (
        f"array_to_string(list_transform([regexp_extract_all({t}, '(?s).')], lambda l: "
        f"array_to_string(list_transform(l, lambda c, i: CASE WHEN c <> '^' "
        f"AND regexp_matches(c, '[^{W}{WS}]') "
        f"AND NOT coalesce(regexp_matches(l[i - 1], '[{W}]'), false) "
        f"AND NOT coalesce(regexp_matches(l[i + 1], '[{W}]'), false) THEN '' ELSE c END), '')), '')"
    )
    return rf"regexp_replace({kept}, '\^[{W}]{{0,4}}', '', 'g')"


def paren(t: str) -> str:
    return rf"regexp_replace({t}, '\([^)]*$', '')"


def spaces(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, ' {{4,}}', chr(10), 'g'), ' {{2,3}}', ' ', 'g')"


def tidy(t: str) -> str:
    return spaces(paren(stray(t)))


def ratio(k: str, n: str, digits: int, scale: int = 1) -> str:
    """``round(scale * (k / n), digits)``, half-even on the exact binary value."""
    unit = 10**digits
    power = 2**63 if scale == 1 else 2**55
    low = f"(({k})::HUGEINT * {unit * scale} // ({n}))"
    rest = f"(({k})::HUGEINT * {unit * scale} % ({n}))"
    stored = f"((({k})::DOUBLE / ({n}) * {scale} * {power}::DOUBLE)::HUGEINT * {2 * unit})"
    middle = f"((2 * {low} + 1) * {power}::HUGEINT)"
    return (
        f"(({low} + CASE WHEN 2 * {rest} > ({n}) THEN 1 WHEN 2 * {rest} < ({n}) THEN 0 "
        f"WHEN {stored} > {middle} THEN 1 WHEN {stored} < {middle} THEN 0 ELSE {low} % 2 END)::DOUBLE / {unit}::DOUBLE)"
    )


def ascii_only(t: str) -> str:
    codes = [*range(1, 9), *range(14, 32)][: len(ACCENTS)]
    return f"translate({t}, '{ACCENTS}', {' || '.join(f'chr({c})' for c in codes)})"


MESSY = f"""messy AS (
  SELECT doc_id, lang, text, {general_list('text')} AS g, {special_list('text')} AS s,
         {repeat_list('text')} AS r FROM documents),
flags AS (
  SELECT *, len(g) > 0 AS has_messy, len(s) > 0 AS has_special_messy, len(r) > 0 AS has_repeat_sequence,
         (len(g) > 0 OR len(s) > 0 OR len(r) > 0) AS any_messy FROM messy)"""

CLEANED = f"""base AS (
  SELECT doc_id, {strip("coalesce(text, '')")} AS t FROM documents),
found AS (
  SELECT doc_id, t, {special_list('t')} AS s, {general_list('t')} AS g, {repeat_list('t')} AS r,
         length(replace(t, ' ', '')) AS original_len FROM base),
profiled AS (
  SELECT *, len(s) > 0 AS special_pattern, len(g) > 0 AS general_pattern, len(r) > 0 AS repeat_chars,
         original_len < 20 AS short_transcript,
         NOT (len(s) > 0 OR len(g) > 0 OR len(r) > 0 OR original_len < 20) AS quality FROM found),
body AS (
  SELECT *, CASE WHEN quality THEN t WHEN short_transcript THEN ''
            ELSE {remove_general(remove_special(collapse('t')))} END AS b FROM profiled),
cleaned AS (SELECT *, {tidy('b')} AS semi_text FROM body)"""

ITEMS = """items AS (
  SELECT doc_id, CASE WHEN length(text) >= 40 THEN 'Item ' || md5(text) END AS title,
         CASE lang WHEN 'en' THEN 'Text' WHEN 'fr' THEN 'STILL IMAGE' WHEN 'de' THEN 'still image; text' END AS type,
         1935 + doc_id % 20 AS year, text AS transcript, source FROM documents),
manual AS (
  SELECT i.doc_id, i.title, upper(i.transcript) AS transcript
  FROM items i JOIN labels l USING (doc_id) WHERE l.quality = 1)"""

QUESTIONS = """questions AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

DICTIONARY = f"""dict AS (
  SELECT word, count(*) AS freq FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[{W}'']+')) AS word FROM benchmark) GROUP BY word)"""

ROW_TOKENS = rf"""row_tokens AS (
  SELECT DISTINCT doc_id, word FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[{W}'']+')) AS word FROM documents)
  WHERE length(word) > 2 AND NOT regexp_matches(word, '^[\p{{Nd}}²³¹⁰⁴-⁹₀-₉]+$'))"""

SUGGEST = f"""unknown AS (
  SELECT DISTINCT word AS token FROM row_tokens WHERE word NOT IN (SELECT word FROM dict)),
near AS (
  SELECT token, word, freq, levenshtein({ascii_only('token')}, {ascii_only('word')}) AS distance
  FROM unknown JOIN dict ON abs(length(token) - length(word)) <= 2),
suggested AS (
  SELECT token, first(word ORDER BY distance, freq DESC, word) AS correction
  FROM near WHERE distance <= 2 GROUP BY token)"""

# -- sources and sinks --------------------------------------------------------------------

SQL["csv_round_trip"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
SQL["csv_plain_round_trip"] = SQL["csv_round_trip"]
SQL["csv_by_ranges"] = SQL["csv_round_trip"]
SQL["csv_other_order"] = SQL["csv_round_trip"]
SQL["required_columns"] = """
SELECT unnest(['transcript', 'semi_clean_transcript', 'year']) AS column_name, (SELECT count(*) FROM documents) AS row_count"""
SQL["schema_difference"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'int' AS column_type, count({c}) AS filled FROM documents JOIN labels USING (doc_id)"
    for c in ("quality", "toxic")
)
SQL["json_results"] = """
SELECT doc_id, CASE WHEN contains(text, 'ß') THEN '' ELSE reverse(text) END AS response,
       CASE WHEN contains(text, 'ß') THEN 'unreadable' ELSE '' END AS error FROM documents"""
SUMMARY = f"""
WITH {MESSY}, c AS (SELECT count(*) AS n, count(*) FILTER (has_messy) AS m FROM flags)
SELECT 'Total Rows' AS metric, n::VARCHAR AS value FROM c
UNION ALL SELECT 'Messy Rows', m::VARCHAR FROM c
UNION ALL SELECT 'Clean Rows', (n - m)::VARCHAR FROM c
UNION ALL SELECT 'Percent Messy', format('{{:.1f}}%', {ratio('m', 'n', 1, 100)}) FROM c"""
SQL["report_tables"] = SUMMARY
SQL["variant_tables"] = f"""
WITH {CLEANED}
SELECT doc_id, t AS transcript, 'original' AS variant FROM cleaned
UNION ALL SELECT doc_id, semi_text, 'semi_clean' FROM cleaned"""
PLAN = """plan AS (
  SELECT page_id AS item_id, page::INTEGER AS page, url || '/' || page || '/full/pct:100/0/default.jpg' AS img_url,
         'documents/scans/' || page_id || '/' || page_id || '_page' || page || '.jpg' AS path, url
  FROM pages, unnest(range(1, 2 + length(url) % 3)) AS p(page))"""
SQL["page_image_plan"] = f"WITH {PLAN} SELECT item_id, page, img_url, path FROM plan"
SQL["pending_pages"] = (
    f"WITH {PLAN} SELECT path, item_id, page, img_url FROM plan WHERE NOT starts_with(url, 'https')"
)
SQL["pending_by_ledger"] = SQL["pending_pages"]

# -- fields -------------------------------------------------------------------------------

SQL["select_rename_drop"] = (
    "SELECT doc_id, text, lang AS language, source AS digital_collection FROM documents"
)
SQL["extract_year"] = """
SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year,
       substr(day(o_orderdate)::VARCHAR || year(o_orderdate)::VARCHAR, 1, 4) AS year_digits,
       strftime(o_orderdate, '%Y') AS year_run FROM orders"""
SQL["blank_and_length"] = f"""
SELECT doc_id, {strip("' ' || chr(9) || text || chr(10) || ' '")} AS original_transcript,
       length(replace(text, ' ', ''))::INTEGER AS original_len FROM documents"""
YEARS = """years AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y') ELSE '' END AS year FROM orders)"""
SQL["filter_years"] = f"""
WITH {YEARS} SELECT o_orderkey, year FROM years WHERE try_cast(year AS INTEGER) BETWEEN 1996 AND 1998"""
SQL["year_or_zero"] = f"""
WITH {YEARS} SELECT o_orderkey, coalesce(try_cast(year AS INTEGER), 0) AS year FROM years"""
SQL["drop_null_keys"] = "SELECT doc_id, doc_id AS item_number FROM documents WHERE lang <> 'fr'"


def bucket(t: str) -> str:
    n = f"length({strip(t)})"
    return (
        f"CASE WHEN {n} = 0 THEN 'empty' WHEN {n} <= 5 THEN '1-5' WHEN {n} <= 20 THEN '6-20' ELSE 'over_20' END"
    )


LENGTHS = """lengths AS (
  SELECT doc_id, type, CASE WHEN type = 'Text' THEN transcript WHEN type = 'STILL IMAGE' THEN source
    WHEN year % 2 = 0 THEN concat_ws(' of ', source, type, year) END AS t FROM items)"""
BUCKETS = f"buckets AS (SELECT doc_id, type, {bucket("coalesce(t, '')")} AS bucket FROM lengths)"
SQL["length_buckets"] = f"WITH {ITEMS}, {LENGTHS}, {BUCKETS} SELECT doc_id, bucket FROM buckets"
SQL["bucket_files"] = SQL["length_buckets"]
SQL["bucket_parts"] = SQL["length_buckets"]
SQL["listed_files"] = f"WITH {ITEMS}, {LENGTHS}, {BUCKETS} SELECT DISTINCT bucket FROM buckets"
SQL["split_by_bucket"] = f"""
WITH {ITEMS}, {LENGTHS}, {BUCKETS}
SELECT name AS bucket, count(b.bucket) AS row_count
FROM unnest(['empty', '1-5', '6-20', 'over_20']) AS n(name) LEFT JOIN buckets b ON b.bucket = name GROUP BY name"""
SQL["split_by_flag"] = f"""
WITH {MESSY} SELECT doc_id, CASE WHEN any_messy THEN 'unclean' ELSE 'clean' END AS part FROM flags"""
SQL["trainable_rows"] = f"""
WITH {ITEMS} SELECT doc_id, title, transcript FROM items
WHERE title IS NOT NULL AND length(title) > 0 AND length(transcript) >= 30"""
SQL["training_column"] = f"""
SELECT text FROM documents WHERE lang <> 'fr' AND regexp_matches(text, '[^{WS}]')"""
SQL["keep_and_combine"] = """
SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE '' END AS kept,
       CASE WHEN lang = 'en' AND text <> '' THEN text WHEN lang = 'de' THEN upper(replace(text, 'ß', 'SS')) ELSE '' END AS combined
FROM documents"""
SQL["apply_fixups"] = r"""
SELECT doc_id, regexp_replace(replace(regexp_replace(text, '^The ', 'THE½ '), '$$', 'S'), '([aeiou])&', '\1 and ', 'g') AS text
FROM documents"""
SQL["row_numbers"] = """
SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) + 1 AS row_no FROM documents"""
SQL["file_row_numbers"] = "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) + 1 AS row_no FROM documents"
SQL["example_rows"] = f"""
WITH {MESSY} SELECT doc_id, len(g)::INTEGER AS sequence_count, array_to_string(g, '¦') AS sequences,
  substr(text, 1, 100) || '...' AS preview FROM flags WHERE has_messy ORDER BY doc_id LIMIT 10"""
SQL["changed_rows"] = f"WITH {CLEANED} SELECT doc_id, t IS DISTINCT FROM semi_text AS changed FROM cleaned"

# -- joins --------------------------------------------------------------------------------

SQL["restrict_to_subset"] = """
WITH main AS (SELECT doc_id, lang, CASE WHEN lang <> 'fr' THEN doc_id END AS item_number FROM documents),
subset AS (SELECT item_number FROM main JOIN labels USING (doc_id))
SELECT doc_id, lang FROM main WHERE EXISTS (
  SELECT 1 FROM subset s WHERE s.item_number IS NOT DISTINCT FROM main.item_number)"""
UPPERED = ITEMS.replace("upper(i.transcript)", "upper(replace(i.transcript, 'ß', 'SS'))")
SQL["attach_column"] = f"""
WITH {UPPERED} SELECT i.doc_id, i.title, coalesce(length(m.transcript), -1)::INTEGER AS clean_length
FROM items i LEFT JOIN manual m ON m.title IS NOT DISTINCT FROM i.title"""
SQL["override_values"] = f"""
WITH {UPPERED}, latest AS (
  SELECT title, arg_max(transcript, doc_id) AS value FROM manual WHERE title IS NOT NULL GROUP BY title)
SELECT i.doc_id, coalesce(l.value, i.transcript) AS transcript, l.value IS NOT NULL AS overridden
FROM items i LEFT JOIN latest l ON l.title = i.title"""
SQL["missing_keys"] = f"""
WITH {ITEMS} SELECT DISTINCT title FROM manual
WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM items WHERE type = 'Text' AND title IS NOT NULL)"""
SQL["updated_sample"] = f"""
WITH {ITEMS} SELECT doc_id, title,
  CASE WHEN length(transcript) > 100 THEN substr(transcript, 1, 100) || '...' ELSE transcript END AS preview
FROM items WHERE title IN (SELECT title FROM manual WHERE title IS NOT NULL) ORDER BY doc_id LIMIT 3"""
SQL["zip_rows"] = """
SELECT row_no, doc_id, lang, coalesce(label_id, -1) AS label_id
FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id, lang FROM documents)
FULL JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id AS label_id FROM labels) USING (row_no)"""
SQL["find_rows"] = f"""
WITH {ITEMS}, numbered AS (SELECT title, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM items)
SELECT title, row_index, row_index + 2 AS row_number FROM numbered
WHERE title IN (SELECT title FROM manual WHERE title IS NOT NULL)"""
SQL["unknown_tokens"] = f"""
WITH {DICTIONARY}, {ROW_TOKENS} SELECT doc_id, word FROM row_tokens WHERE word NOT IN (SELECT word FROM dict)"""

# -- aggregates ---------------------------------------------------------------------------

TYPES = """count(*) FILTER (lower(type) = 'still image') AS still_image,
  count(*) FILTER (lower(type) = 'text') AS text,
  count(*) FILTER (lower(type) = 'still image; text') AS still_image_text,
  count(*) FILTER (type IS NULL OR lower(type) NOT IN ('still image', 'text', 'still image; text')) AS other,
  count(*) AS total"""
SQL["type_counts"] = f"WITH {ITEMS} SELECT {TYPES} FROM items"
SQL["type_counts_by_bucket"] = f"""
WITH {ITEMS}, {LENGTHS}, {BUCKETS} SELECT bucket, {TYPES} FROM buckets GROUP BY bucket"""
SUMMARY_COLUMNS = ", ".join(
    ["count(*) AS total_rows"]
    + [
        f"count(*) FILTER ({f}) AS {n}_rows, {ratio(f'count(*) FILTER ({f})', 'count(*)', 1, 100)} AS {n}_percent"
        for n, f in (("messy", "has_messy"), ("special_messy", "has_special_messy"), ("repeat", "has_repeat_sequence"))
    ]
    + [
        f"coalesce(sum(len({c})), 0)::BIGINT AS {n}_sequences_total"
        for n, c in (("messy", "g"), ("special_messy", "s"), ("repeat", "r"))
    ]
)
SQL["messy_summary"] = f"WITH {MESSY} SELECT {SUMMARY_COLUMNS} FROM flags"
SQL["messy_summary_by_language"] = f"WITH {MESSY} SELECT lang, {SUMMARY_COLUMNS} FROM flags GROUP BY lang"
for name, col, n in (
    ("top_general_sequences", "g", 50),
    ("top_special_sequences", "s", 50),
    ("top_repeat_sequences", "r", 15),
):
    SQL[name] = f"""
WITH {MESSY} SELECT sequence, count(*) AS occurrences FROM (SELECT unnest({col}) AS sequence FROM messy)
GROUP BY sequence ORDER BY occurrences DESC, sequence LIMIT {n}"""
SQL["flag_breakdown"] = f"WITH {MESSY} " + " UNION ALL ".join(
    f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS messy_rows, count(*) FILTER (NOT {f}) AS clean_rows FROM flags"
    for f in ("has_messy", "has_special_messy", "has_repeat_sequence", "any_messy")
)
HITS = "(has_messy::INT + has_special_messy::INT + has_repeat_sequence::INT)"
SQL["flag_overlap"] = f"WITH {MESSY} " + " UNION ALL ".join(
    f"SELECT '{n}' AS overlap, count(*) FILTER ({c}) AS row_count FROM flags"
    for n, c in (
        ("General Only", f"has_messy AND {HITS} = 1"),
        ("Special Only", f"has_special_messy AND {HITS} = 1"),
        ("Repeat Only", f"has_repeat_sequence AND {HITS} = 1"),
        ("Multi-Type", f"{HITS} > 1"),
    )
)
SQL["summary_table"] = SUMMARY
SQL["empty_counts"] = f"""
WITH {CLEANED} SELECT 'original_transcript' AS column_name, count(*) FILTER (NOT regexp_matches(t, '[^{WS}]')) AS empty_records FROM cleaned
UNION ALL SELECT 'semi_clean_transcript', count(*) FILTER (NOT regexp_matches(semi_text, '[^{WS}]')) FROM cleaned
UNION ALL SELECT 'language', count(*) FILTER (lang IS NULL OR lang = 'fr') FROM documents"""
SQL["all_null_rows"] = "SELECT count(*) FILTER (lang IS NULL OR lang = 'fr') AS null_rows FROM documents"
CHARS = ('"', ", ", "–", "—")


def compared(b_where: str) -> str:
    return f"""WITH {CLEANED},
a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, t AS value_a, true AS in_a FROM cleaned),
b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, semi_text AS value_b, true AS in_b FROM cleaned {b_where}),
pairs AS (SELECT row_no, value_a, value_b, in_a, in_b, in_a AND in_b AS both_in FROM a FULL JOIN b USING (row_no)),
facts AS (
  SELECT count(in_a) AS rows_a, count(in_b) AS rows_b, count(*) FILTER (both_in) AS overlap,
    count(*) FILTER (both_in AND value_a = value_b) AS same,
    count(*) FILTER (both_in AND {strip('value_a')} = {strip('value_b')}) AS stripped, """ + ", ".join(
        f"coalesce(bool_or(contains(value_{s}, {q(c)})), false) AS {s}{i}" for s in "ab" for i, c in enumerate(CHARS)
    ) + " FROM pairs)"


ISSUES = "array_to_string(list_filter([CASE WHEN rows_a = rows_b AND stripped > same THEN 'whitespace differences' END, " + ", ".join(
    f"CASE WHEN a{i} <> b{i} THEN {q('only one side has: ' + c)} END" for i, c in enumerate(CHARS)
) + "], lambda x: x IS NOT NULL), '¦') AS potential_issues"
SQL["compare_summary"] = compared("") + f"""
SELECT rows_a, rows_b, rows_a = rows_b AS rows_match, same AS exact_matches,
  round(same / overlap, 9) AS exact_match_rate, overlap - same AS total_differences,
  0::BIGINT AS nulls_a, 0::BIGINT AS nulls_b, {ISSUES} FROM facts"""
SQL["compare_differences"] = compared("") + """
SELECT row_no, value_a, value_b FROM pairs WHERE both_in AND value_a <> value_b ORDER BY row_no LIMIT 10"""
SQL["compare_samples"] = compared("") + " SELECT row_no, value_a, value_b FROM pairs WHERE row_no < 5"
SQL["compare_unequal_tables"] = compared("WHERE general_pattern") + f"""
SELECT rows_a, rows_b, rows_a = rows_b AS rows_match, same AS exact_matches_overlap,
  round(same / overlap, 9) AS exact_match_rate_overlap, {ISSUES} FROM facts"""

COMMON = ", ".join(q(w) for w in COMMON_WORDS)
GATE = rf"""toks AS (
  SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS words,
    list_filter(regexp_extract_all(lower(text), '[{W}]+'), lambda w: regexp_matches(w, '^[a-z]+$')) AS alpha FROM documents),
stats AS (
  SELECT doc_id, text, alpha, len(words) AS n, len(alpha) AS na,
    len(list_filter(words, lambda w: length(w) = 1)) AS n1,
    len(list_filter(words, lambda w: NOT regexp_matches(w, '^\p{{L}}+$'))) AS nx,
    length(array_to_string(alpha, '')) AS nc, len(list_distinct(alpha)) AS nd,
    len(list_filter(alpha, lambda w: w IN ({COMMON}))) AS nk FROM toks),
gate AS (
  SELECT doc_id, alpha, CASE
    WHEN NOT regexp_matches(text, '[^{WS}]') THEN 'blank'
    WHEN n < 20 THEN 'too_few_words'
    WHEN n1 / n > 0.3::DOUBLE THEN 'single_chars'
    WHEN nx / n > 0.5::DOUBLE THEN 'non_alpha'
    WHEN nc / greatest(1, na) < 3 THEN 'short_words'
    WHEN nd < na * 0.3::DOUBLE THEN 'low_variety'
    WHEN nk / na < 0.1::DOUBLE THEN 'few_common_words' ELSE '' END AS fail_reason FROM stats)"""
SQL["quality_counts"] = f"""
WITH {GATE} SELECT count(*) FILTER (fail_reason = '') AS passed, count(*) FILTER (fail_reason <> '') AS failed FROM gate"""
SQL["duplicate_rows"] = f"""
WITH {ITEMS}, n AS (SELECT doc_id, title, count(*) OVER (PARTITION BY title) AS c FROM items)
SELECT doc_id, title FROM n WHERE c > 1"""
SQL["distinct_keys"] = f"WITH {ITEMS} SELECT count(DISTINCT title) AS distinct_keys FROM items"
SQL["vocabulary"] = f"""
SELECT word, count(*) AS freq FROM (
  SELECT unnest(regexp_extract_all(lower(text || ' ' || source), '[{W}'']+')) AS word FROM documents) GROUP BY word"""
SQL["job_status"] = """
SELECT count(*) FILTER (NOT contains(text, 'ß')) AS succeeded, count(*) FILTER (contains(text, 'ß')) AS failed FROM documents"""

# -- text ---------------------------------------------------------------------------------

SQL["pattern_flags"] = f"""
WITH {MESSY} SELECT doc_id, has_special_messy AS special_pattern, has_messy AS general_pattern,
  has_repeat_sequence AS repeat_chars FROM flags"""
SQL["profile_rows"] = f"""
WITH {CLEANED} SELECT doc_id, original_len::INTEGER AS original_len, special_pattern, general_pattern, repeat_chars,
  short_transcript, quality,
  array_to_string(list_filter([CASE WHEN special_pattern THEN 'Special Char Artifacts' END,
    CASE WHEN general_pattern THEN 'General Artifacts' END, CASE WHEN repeat_chars THEN 'Repeat Chars' END,
    CASE WHEN original_len = 0 THEN 'Empty Transcript' WHEN short_transcript THEN 'Low Char Count' END],
    lambda x: x IS NOT NULL), '¦') AS issue_types,
  array_to_string(list_concat(list_concat(s, g), r), '¦') AS detected_artifacts FROM profiled"""
SQL["messy_rows"] = f"""
WITH {MESSY} SELECT doc_id, array_to_string(g, '¦') AS messy_sequences, array_to_string(s, '¦') AS special_messy_sequences,
  array_to_string(r, '¦') AS repeat_sequences, len(g)::INTEGER AS messy_count, has_messy,
  length(array_to_string(g, ''))::INTEGER AS total_messy_chars, len(s)::INTEGER AS special_messy_count, has_special_messy,
  length(array_to_string(s, ''))::INTEGER AS total_special_messy_chars, len(r)::INTEGER AS repeat_sequence_count,
  has_repeat_sequence, any_messy FROM flags"""
SQL["report_details"] = SQL["messy_rows"]
SQL["remove_patterns_a"] = f"SELECT doc_id, {remove_general(remove_special(collapse('text')))} AS text FROM documents"
SQL["remove_patterns_b"] = f"SELECT doc_id, {collapse(remove_general(remove_special('text')))} AS text FROM documents"
squeezed = "text"
for letter in string.ascii_letters:
    squeezed = f"regexp_replace({squeezed}, '{letter}{{3,}}', '{letter}', 'g')"
SQL["squeeze_repeats"] = f"SELECT doc_id, {squeezed} AS text FROM documents"
SQL["stray_punctuation"] = f"SELECT doc_id, {paren(stray(chr(39).join(['replace(text, ', '$', ', ', '^', ')'])))} AS text FROM documents"
SQL["space_runs"] = f"""
SELECT doc_id, {spaces("replace(replace(text, ',', '     '), '.', '  ')")} AS text FROM documents"""
SQL["semi_clean"] = f"WITH {CLEANED} SELECT doc_id, semi_text AS semi_clean_transcript FROM cleaned"
SQL["semi_clean_stream"] = SQL["semi_clean"]
SQL["semi_clean_messy"] = f"""
WITH {MESSY} SELECT doc_id, {tidy(collapse(remove_general(remove_special('text'))))} AS semi_clean_transcript
FROM flags WHERE any_messy"""
SQL["substitutions"] = r"""
SELECT doc_id, regexp_replace(replace(regexp_replace(replace(replace(text, '%', '_'), '|', '—'), '_{2,}', ' ', 'g'), '—', '-'),
  '\*{2,}', ' ', 'g') AS text FROM documents"""
SQL["messy_scores"] = f"""
WITH c AS (SELECT doc_id, length(text) AS n, {count('text', '[&<>^]')} + {count('text', f'[{WS}]{{2,}}|[^{WS}]{{15,}}')}
  + {count('text', '[a-z][A-Z]|[A-Z]{3,}[a-z]')} AS k FROM documents),
s AS (SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {ratio('k', 'n', 3)} END AS messy_score FROM c)
SELECT doc_id, messy_score, messy_score > 0.02::DOUBLE AS is_messy FROM s"""
SQL["condensed_text"] = f"SELECT doc_id, regexp_replace(text, '[{WS}]+', ' ', 'g') AS text FROM documents"
SQL["quality_gate"] = f"WITH {GATE} SELECT doc_id, fail_reason = '' AS quality_transcript, fail_reason FROM gate"
SQL["quality_gate_with_dictionary"] = f"""
WITH {GATE}, {DICTIONARY},
checked AS (SELECT doc_id, list_filter(alpha, lambda w: length(w) > 2) AS l FROM gate WHERE fail_reason = ''),
missed AS (
  SELECT doc_id, count(DISTINCT w) AS k FROM (SELECT doc_id, unnest(l) AS w FROM checked)
  WHERE w NOT IN (SELECT word FROM dict) GROUP BY doc_id),
bad AS (SELECT doc_id FROM checked JOIN missed USING (doc_id) WHERE k / len(l) > 0.5::DOUBLE)
SELECT doc_id, fail_reason = '' AND doc_id NOT IN (SELECT doc_id FROM bad) AS quality_transcript,
  CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN 'misspelled' ELSE fail_reason END AS fail_reason FROM gate"""
SQL["spelling_suggestions"] = f"WITH {DICTIONARY}, {ROW_TOKENS}, {SUGGEST} SELECT token, correction FROM suggested"
SQL["corrected_text"] = f"""
WITH {DICTIONARY}, {ROW_TOKENS}, {SUGGEST},
pieces AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[{W}'']+|[^{W}'']+') AS p FROM documents)),
fixed AS (
  SELECT doc_id, pos, CASE WHEN correction IS NULL THEN piece
    WHEN piece = upper(piece) AND piece <> lower(piece) AND NOT contains(piece, 'ß') THEN upper(replace(correction, 'ß', 'SS'))
    WHEN piece[1] = upper(piece[1]) AND piece[1] <> lower(piece[1]) THEN upper(correction[1]) || correction[2:]
    ELSE correction END AS out
  FROM pieces LEFT JOIN suggested ON token = lower(piece))
SELECT doc_id, string_agg(out, '' ORDER BY pos) AS corrected_transcript FROM fixed GROUP BY doc_id"""
SQL["correction_metrics"] = rf"""
WITH {CLEANED},
two AS (
  SELECT doc_id, t AS o, semi_text AS c, 'semi_clean_transcript' AS corrected_column FROM cleaned
  UNION ALL SELECT doc_id, t, regexp_replace(t, '(\$+)', '[\1]', 'g'), 'flagged' FROM cleaned),
sets AS (
  SELECT doc_id, corrected_column, list_distinct(regexp_extract_all(lower(o), '[{W}]+')) AS a,
    list_distinct(regexp_extract_all(lower(c), '[{W}]+')) AS b, {count('c', chr(92) + '[[^' + chr(92) + 'n]*?' + chr(92) + ']')} AS f FROM two),
n AS (SELECT *, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS d FROM sets)
SELECT doc_id, len(a)::INTEGER AS original_words, len(b)::INTEGER AS corrected_words, d::INTEGER AS different_words,
  CASE WHEN len(a) > 0 THEN round(d / len(a) * 100, 6) ELSE 0 END AS percent_changed, f::INTEGER AS flagged_words,
  'original_transcript' AS original_column, corrected_column FROM n"""
SQL["list_literals"] = f"""
WITH {CLEANED} SELECT doc_id, array_to_string(list_concat(list_concat(s, g), r), '¦') AS artifacts FROM profiled"""


def chunks(n: int) -> str:
    return f"""w AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS l FROM documents),
c AS (SELECT doc_id, unnest(range((len(l) + {n - 1}) // {n})) AS chunk_no, l FROM w),
chunks AS (
  SELECT doc_id, chunk_no::INTEGER AS chunk_no, array_to_string(l[chunk_no * {n} + 1 : chunk_no * {n} + {n}], ' ') AS chunk FROM c)"""


SQL["word_chunks"] = f"WITH {chunks(500)} SELECT doc_id, chunk_no, chunk FROM chunks"
SQL["rejoined_chunks"] = f"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ') AS text FROM documents
WHERE regexp_matches(text, '[^{WS}]')"""
SQL["sentence_split"] = f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s:.*?[.!?][{WS}]+|.+$)') AS l,
    regexp_matches(text, '[.!?][{WS}]+$') AS open_end FROM documents),
s AS (SELECT doc_id, CASE WHEN open_end OR len(l) = 0 THEN list_append(l, '') ELSE l END AS l FROM p),
k AS (SELECT doc_id, l, CASE WHEN floor(len(l) * 0.5::DOUBLE) >= len(l) THEN len(l) - 1
    WHEN floor(len(l) * 0.5::DOUBLE) <= 0 THEN 1 ELSE floor(len(l) * 0.5::DOUBLE)::BIGINT END AS k FROM s)
SELECT doc_id, array_to_string(l[1:k], '') AS first, coalesce(array_to_string(l[k + 1:], ''), '') AS second FROM k"""


def h(task: str, key: str) -> str:
    return f"('0x' || substr(md5('0|{task}|' || {key}), 1, 8))::BIGINT"


def uniform(lo: float, hi: float, task: str) -> str:
    return f"({lo}::DOUBLE + {hi - lo!r}::DOUBLE * ({h(task, 'doc_id')} / 4294967296.0::DOUBLE))"


def uniform_int(lo: str, hi: str, task: str) -> str:
    return f"({lo} + (({h(task, 'doc_id')} * (greatest({lo}, {hi}) - {lo} + 1)) >> 32))"


B, G, E = uniform(0.15, 0.25, "beginning"), uniform(0.30, 0.50, "middle_gap"), uniform(0.05, 0.15, "buffer")
SQL["split_ratios"] = f"""
SELECT doc_id, round({B}, 9) AS beginning, round({G}, 9) AS middle_gap, round({B} + {G} + {E}, 9) AS end_start,
  round({uniform(0.4, 0.7, 'mid_split')}, 9) AS mid_split FROM documents"""
SQL["parsed_ocr_results"] = """
SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE source END AS source,
  CASE WHEN lang = 'es' THEN '' ELSE text END AS ocr_transcript, CASE WHEN lang = 'es' THEN '' ELSE lang END AS notes,
  CASE WHEN lang = 'es' THEN '' ELSE upper(replace(text, 'ß', 'SS')) END AS fixed_transcript,
  CASE WHEN lang = 'es' THEN 'no JSON: ' || text ELSE '' END AS error FROM documents"""
SQL["parsed_spell_outputs"] = """
SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE text END AS spell_corrected_text,
  CASE WHEN lang = 'de' THEN '' ELSE lang END AS corrected_words,
  CASE WHEN lang = 'de' THEN '' ELSE source END AS corrections FROM documents"""

# -- datasets and generation --------------------------------------------------------------

TASKS = f"""{ITEMS},
w AS (
  SELECT doc_id, coalesce(title, '') AS title, year, {strip('transcript')} AS t,
    regexp_extract_all(transcript, '{TOKEN}') AS l FROM items),
n AS (SELECT *, len(l) AS n FROM w),
lim AS (
  SELECT *, greatest(5, floor(n * 0.2::DOUBLE)::BIGINT) AS flo, least(floor(n * 0.35::DOUBLE)::BIGINT, n - 10) AS fhi,
    greatest(5, floor(n * 0.4::DOUBLE)::BIGINT) AS hlo, least(n - 5, floor(n * 0.55::DOUBLE)::BIGINT) AS hhi,
    greatest(5, floor(n * 0.45::DOUBLE)::BIGINT) AS clo, least(n - 5, floor(n * 0.55::DOUBLE)::BIGINT) AS chi FROM n),
cut AS (
  SELECT *, {uniform_int('flo', 'fhi', 'first')} AS f, {uniform_int('hlo', 'hhi', 'half')} AS hs,
    {uniform_int('clo', 'chi', 'context')} AS cs FROM lim),
mid AS (SELECT *, least(floor(n * 0.5::DOUBLE)::BIGINT, n - f - 5) AS mhi FROM cut),
planned AS (
  SELECT *, f + {uniform_int('5::BIGINT', 'mhi', 'middle')} AS m,
    CASE WHEN n < 20 THEN 'too short' WHEN fhi <= flo OR mhi <= 5 THEN 'no valid middle section' ELSE '' END AS reason FROM mid),
tasks AS (
  SELECT doc_id AS original_index, 'missing_middle' AS task_type,
    'Fill in the missing information from the transcript for "' || title || '":' || chr(10) || array_to_string(l[1:f], ' ')
      || '... [this text is missing]... ' || array_to_string(l[m + 1:], ' ') AS input,
    'This is the missing text from the transcript for "' || title || '":' || chr(10) || chr(10) || array_to_string(l[f + 1:m], ' ') AS output
  FROM planned WHERE reason = '' AND n - m >= 5
  UNION ALL
  SELECT doc_id, 'complete_first_half',
    'Fill in the first half of the missing transcript for "' || title || '":' || chr(10) || '...' || array_to_string(l[hs + 1:], ' '),
    'Here is the rest of the missing text from the transcript for "' || title || '":' || chr(10) || chr(10) || array_to_string(l[1:hs], ' ')
  FROM planned WHERE reason = ''
  UNION ALL
  SELECT doc_id, 'complete_full', 'Give the complete transcript for "' || title || '".',
    'This is the complete transcript for "' || title || '":' || chr(10) || chr(10) || t FROM planned WHERE reason = ''
  UNION ALL
  SELECT doc_id, 'contextual_completion',
    'Based on the year, ' || year || ', and title, "' || title || '", complete this transcript:' || chr(10) || array_to_string(l[1:cs], ' ') || '...',
    'Here is the rest of the missing text...' || chr(10) || chr(10) || array_to_string(l[cs + 1:], ' ') FROM planned WHERE reason = '')"""
SQL["completion_tasks"] = f"WITH {TASKS} SELECT original_index, input, output, task_type FROM tasks"
SQL["skipped_documents"] = f"""
WITH {TASKS} SELECT doc_id AS original_index, n::INTEGER AS n_words, reason AS skip_reason FROM planned WHERE reason <> ''"""
SQL["title_training_text"] = f"""
WITH {ITEMS} SELECT doc_id, '### TITLE: ' || title || chr(10) || '### TRANSCRIPT:' || chr(10) || transcript || chr(10)
  || '### RESPONSE: ' || transcript AS text FROM items
WHERE title IS NOT NULL AND length(title) > 0 AND length(transcript) >= 30"""


def template(text: str, /, **cols: str) -> str:
    """SQL concatenation of a template's literals and the expressions named in braces."""
    out, rest = [], text
    while rest:
        literal, brace, tail = rest.partition("{")
        if literal:
            out.append(q(literal))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(cols[name])
    return " || ".join(out)


SQL["task_training_text"] = f"""
WITH {TASKS} SELECT original_index, task_type, {template(TASK_TRAINING, input='input', output='output')} AS text FROM tasks"""
SQL["qa_prompts"] = f"WITH {QUESTIONS} SELECT conv_id, turn, " + ", ".join(
    f"{template(TEMPLATES[n], text='question', system=q(DEFAULT_SYSTEM))} AS {n}_prompt" for n in ("qa", "examples", "chat")
) + " FROM questions"
SQL["correction_prompts"] = f"""
SELECT doc_id, {template(TEMPLATES['restore'], text='text')} AS restore_prompt,
  {template(TEMPLATES['proofread'], text='text')} AS proofread_prompt FROM documents"""
SQL["chat_messages"] = f"""
WITH {QUESTIONS} SELECT conv_id, turn, 0 AS position, 'system' AS role, {q(DEFAULT_SYSTEM)} AS content FROM questions
UNION ALL SELECT conv_id, turn, 1, 'user', question FROM questions"""
SQL["generated_replies"] = f"""
WITH {QUESTIONS}, p AS (
  SELECT conv_id, turn, {template(TEMPLATES['qa'], text='question', system=q(DEFAULT_SYSTEM))} AS p FROM questions)
SELECT conv_id, turn, sample::INTEGER AS sample, CASE WHEN contains(p, 'ß') THEN '' ELSE reverse(p) END AS response,
  CASE WHEN contains(p, 'ß') THEN 'unreadable' ELSE '' END AS error FROM p, unnest([1, 2, 3]) AS s(sample)"""
SQL["resumed_replies"] = SQL["generated_replies"]
SQL["wide_responses"] = f"""
WITH {QUESTIONS}, r AS (SELECT *, CASE WHEN contains(question, 'ß') THEN '' ELSE reverse(question) END AS r FROM questions)
SELECT conv_id, turn, question, answer, r AS response_1, r AS response_2 FROM r"""
SQL["answered_questions"] = f"""
WITH {QUESTIONS}, p AS (
  SELECT question, answer, {template(TEMPLATES['qa'], text='question', system=q(DEFAULT_SYSTEM))} AS p FROM questions, range(2)),
r AS (SELECT question, answer, CASE WHEN contains(p, 'ß') THEN '' ELSE reverse(p) END AS r FROM p)
SELECT question, answer, r AS response_1, r AS response_2 FROM r"""
SQL["cleaned_replies"] = f"""
WITH {QUESTIONS}, s AS (SELECT conv_id, turn, {strip('answer')} AS s FROM questions)
SELECT conv_id, turn, s AS after_prompt, s AS after_assistant, s AS unquoted, s AS after_response, s AS no_marker FROM s"""
SQL["corrected_columns"] = """
SELECT doc_id, CASE WHEN contains(text, 'ß') THEN text ELSE reverse(text) END AS text_cleaned,
  CASE WHEN lang = 'fr' THEN '' WHEN contains(source, 'ß') THEN source ELSE reverse(source) END AS source_cleaned FROM documents"""
SQL["token_rows"] = """
SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)::VARCHAR), ' ') AS tokens FROM documents"""
SQL["packed_tokens"] = f"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{TOKEN}')[1:256],
    lambda w: (length(w) * 1000 + unicode(w) % 1000)::VARCHAR) AS l FROM documents),
p AS (SELECT doc_id, array_to_string(list_concat(l, list_transform(range(256 - len(l)), lambda i: '7')), ' ') AS ids,
    array_to_string(list_concat(list_transform(l, lambda x: '1'), list_transform(range(256 - len(l)), lambda i: '0')), ' ') AS mask FROM w)
SELECT doc_id, ids AS input_ids, mask AS attention_mask, ids AS labels FROM p"""
SQL["partly_applied"] = f"""
SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE text END AS text,
  CASE WHEN lang = 'fr' THEN '' ELSE regexp_replace(text, '[{WS}]+', ' ', 'g') END AS text_cleaned FROM documents"""
SQL["selected_years"] = "SELECT doc_id, text AS transcript FROM documents WHERE 1935 + doc_id % 20 BETWEEN 1940 AND 1950"
SQL["merged_variants"] = f"""
WITH {CLEANED}, {UPPERED} SELECT c.doc_id, c.t AS original_transcript, c.semi_text AS semi_clean_transcript, m.transcript AS clean_transcript
FROM cleaned c JOIN manual m USING (doc_id)"""

# -- evaluation ---------------------------------------------------------------------------

ANSWERED = f"""{QUESTIONS},
words AS (SELECT *, regexp_extract_all(answer, '{TOKEN}') AS l FROM questions),
answered AS (
  SELECT conv_id, turn, question, answer, array_to_string(l[1:len(l) // 2], ' ') AS response_1,
    regexp_replace(answer, '[.,]', '', 'g') AS response_2, question AS response_3 FROM words)"""
SQL["unpivoted_models"] = f"WITH {ANSWERED} " + " UNION ALL ".join(
    f"SELECT conv_id, turn, 'response_{i}' AS model, response_{i} AS response FROM answered" for i in (1, 2, 3)
)


def scored(ref: str, models: tuple[int, ...]) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT conv_id, turn, 'response_{i}' AS model, coalesce({ref}, '') AS ref, coalesce(response_{i}, '') AS hyp FROM answered"
        for i in models
    )
    grams = " UNION ALL ".join(
        f"SELECT conv_id, turn, model, {n} AS n, side, unnest(list_transform(range(1, len(l) - {n - 2}), "
        f"lambda i: array_to_string(l[i:i + {n - 1}], ' '))) AS gram FROM sides WHERE len(l) >= {n}"
        for n in (1, 2, 3, 4)
    )
    return f"""WITH {ANSWERED},
pairs AS ({pairs}),
tok AS (SELECT *, regexp_extract_all(lower(ref), '{TOKEN}') AS r, regexp_extract_all(lower(hyp), '{TOKEN}') AS h FROM pairs),
sides AS (SELECT conv_id, turn, model, 'r' AS side, r AS l FROM tok UNION ALL SELECT conv_id, turn, model, 'h', h FROM tok),
grams AS ({grams}),
counts AS (
  SELECT conv_id, turn, model, n, gram, count(*) FILTER (side = 'r') AS cr, count(*) FILTER (side = 'h') AS ch
  FROM grams GROUP BY ALL),
matches AS (
  SELECT conv_id, turn, model, n, sum(least(cr, ch)) AS k, sum(ch) AS p FROM counts GROUP BY ALL HAVING sum(ch) > 0),
precision AS (
  SELECT conv_id, turn, model, min(k) FILTER (n = 1) AS k1, avg(CASE WHEN n > 1 THEN ln((k + 1) / (p + 1))
    WHEN k > 0 THEN ln(k / p) ELSE 0 END) AS lp FROM matches GROUP BY ALL),
js AS (
  SELECT conv_id, turn, model, sum(CASE WHEN pr > 0 THEN 0.5::DOUBLE * pr * log2(pr / ((pr + ph) / 2)) ELSE 0 END
      + CASE WHEN ph > 0 THEN 0.5::DOUBLE * ph * log2(ph / ((pr + ph) / 2)) ELSE 0 END) AS js
  FROM (SELECT conv_id, turn, model, cr / len(r) AS pr, ch / len(h) AS ph FROM counts JOIN tok USING (conv_id, turn, model)
        WHERE n = 1 AND len(r) > 0 AND len(h) > 0) GROUP BY ALL),
lcs AS (
  SELECT conv_id, turn, model, list_reduce(r, lambda row, t: list_reduce(
      list_transform(range(1, len(h) + 1), lambda j: CASE WHEN h[j] = t THEN 1 + coalesce(row[j - 1], 0) ELSE row[j] END),
      lambda got, c: list_append(got, greatest(c, coalesce(got[len(got)], 0))), []::BIGINT[]),
    list_transform(h, lambda x: 0::BIGINT)) AS row
  FROM (SELECT conv_id, turn, model, list_transform(r, lambda x: x) AS r, h FROM tok)),
scores AS (
  SELECT conv_id, turn, model,
    CASE WHEN len(r) + len(h) = 0 THEN 0 ELSE 2 * coalesce(lcs.row[len(lcs.row)], 0) / (len(r) + len(h)) END AS rouge_l,
    CASE WHEN coalesce(k1, 0) = 0 THEN 0 ELSE exp(least(0, 1 - len(r) / len(h)) + lp) END AS bleu,
    CASE WHEN len(r) = 0 AND len(h) = 0 THEN 0 WHEN len(r) = 0 OR len(h) = 0 THEN 1 ELSE js END AS jsd,
    CASE WHEN len(list_distinct(list_concat(r, h))) = 0 THEN 1
      ELSE len(list_intersect(list_distinct(r), list_distinct(h))) / len(list_distinct(list_concat(r, h))) END AS jaccard,
    CASE WHEN greatest(length(ref), length(hyp)) = 0 THEN 1
      ELSE 1 - levenshtein({ascii_only('ref')}, {ascii_only('hyp')}) / greatest(length(ref), length(hyp)) END AS levenshtein
  FROM tok LEFT JOIN precision USING (conv_id, turn, model) LEFT JOIN js USING (conv_id, turn, model)
    LEFT JOIN lcs USING (conv_id, turn, model))"""


ROUNDED = ", ".join(f"round({m}::DOUBLE, 6) AS {m}" for m in ("bleu", "jsd", "jaccard", "levenshtein"))
SQL["accuracy_scores"] = scored("answer", (1, 2, 3)) + f" SELECT conv_id, turn, model, {ROUNDED} FROM scores"
SQL["consistency_scores"] = scored("response_1", (2, 3)) + f" SELECT conv_id, turn, model, {ROUNDED} FROM scores"
SQL["rouge_l_scores"] = scored("answer", (1, 2, 3)) + (
    " SELECT conv_id, turn, model, round(rouge_l::DOUBLE, 6) AS rouge_l FROM scores"
)
SQL["mean_scores_wide"] = scored("answer", (1, 2, 3)) + " SELECT model, " + ", ".join(
    f"round(avg({m}::DOUBLE), 6) AS {m}" for m in ("bleu", "rouge_l", "jsd", "jaccard", "levenshtein")
) + " FROM scores GROUP BY model"
SQL["mean_scores"] = scored("answer", (1, 2, 3)) + " " + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, round(avg({m}::DOUBLE), 6) AS score FROM scores GROUP BY model"
    for m in ("bleu", "rouge_l", "jsd", "jaccard", "levenshtein")
)
