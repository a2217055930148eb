"""DuckDB SQL with the rows of the catalog's queries, written from the rules, not from the native plans."""

from __future__ import annotations

from .. import constants as C
from . import catalog as Q


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _marked(text: str, pattern: str) -> str:
    """The text cut at the matches of a pattern: a list in which every second item is a match."""
    return f"string_split_regex(regexp_replace({text}, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), '[\\x01\\x02]')"


def _doubled(text: str) -> str:
    """As _marked for card numbers. RE2 can't look around, so all that isn't a letter or digit is doubled: each match can then take one as its border."""
    twice = f"regexp_replace({text}, '([^a-zA-Z0-9])', '\\1\\1', 'g')"
    found = f"regexp_replace({twice}, '(^|[^a-zA-Z0-9])([0-9](?:\\s*[0-9]){{15,18}})([^a-zA-Z0-9]|$)', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    return f"list_transform(string_split_regex({found}, '[\\x01\\x02]'), lambda x: regexp_replace(x, '(?s)([^a-zA-Z0-9])[^a-zA-Z0-9]', '\\1', 'g'))"


MAIL = C.EMAIL_PATTERN
_DOMAIN, _LOCAL = "regexp_extract({0}, '[^@]*$')", "regexp_extract({0}, '^([^@]*)@', 1)"


def _mail_ok(v: str) -> str:
    d, p = _DOMAIN.format(v), _LOCAL.format(v)
    return f"(length({p}) BETWEEN 1 AND 64 AND length({d}) BETWEEN 1 AND 255 AND {p} NOT LIKE '.%' AND {p} NOT LIKE '%.' AND {d} NOT LIKE '.%' AND {d} NOT LIKE '%.' AND NOT contains({v}, '..'))"


def _mail_masked(v: str) -> str:
    d, p = _DOMAIN.format(v), _LOCAL.format(v)
    last = f"regexp_extract({d}, '[^.]*$')"
    local = f"CASE WHEN length({p}) > 2 THEN left({p}, 2) || repeat('*', length({p}) - 2) ELSE repeat('*', length({p})) END"
    return f"{local} || '@' || CASE WHEN contains({d}, '.') THEN repeat('*', length({d}) - length({last}) - 1) || '.' || {last} ELSE repeat('*', length({d})) END"


def _mail_text(text: str) -> str:
    return f"array_to_string(list_transform({_marked(text, MAIL)}, lambda x, i: CASE WHEN i % 2 = 0 AND {_mail_ok('x')} THEN {_mail_masked('x')} ELSE x END), '')"


def _card_ok(v: str) -> str:
    bare = f"replace({v}, ' ', '')"
    total = f"list_sum(list_transform(list_reverse(string_split({bare}, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN 2 * CAST(c AS INT) > 9 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END))"
    return f"(CASE WHEN regexp_full_match({bare}, '[0-9]{{16,19}}') THEN {total} % 10 = 0 ELSE false END)"


def _mail_rows(source: str, key: str) -> str:
    return f"""WITH cut AS (SELECT {key}, {_marked("coalesce(text, '')", MAIL)} AS p FROM {source}),
 hits AS (SELECT {key}, p[i] AS value, list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS pos FROM (SELECT {key}, p, unnest(range(2, len(p) + 1, 2)) AS i FROM cut))
 SELECT {key}, 'CN_EMAIL' AS entity_type, CAST(pos AS BIGINT) AS start_pos, CAST(pos + length(value) AS BIGINT) AS end_pos,
 CAST(CASE WHEN lower({_DOMAIN.format('value')}) IN {_in(C.MAIL_DOMAINS)} THEN 0.95 ELSE 0.85 END AS DOUBLE) AS score, value FROM hits WHERE {_mail_ok('value')}"""


CARD_ROWS = f"SELECT doc_id, lang, p[i] AS value FROM (SELECT doc_id, lang, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT doc_id, lang, {_doubled("coalesce(text, '')")} AS p FROM documents)) WHERE {_card_ok('p[i]')}"
MAIL_ROWS = f"SELECT doc_id, lang, p[i] AS value FROM (SELECT doc_id, lang, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT doc_id, lang, {_marked("coalesce(text, '')", MAIL)} AS p FROM documents)) WHERE {_mail_ok('p[i]')}"
CARD_TEXT = f"array_to_string(list_transform({_doubled('text')}, lambda x, i: CASE WHEN i % 2 = 0 AND {_card_ok('x')} THEN left(x, 4) || repeat('*', length(x) - 8) || right(x, 4) ELSE x END), '')"


REQUEST_CARDS = f"array_to_string(list_transform({_doubled('text')}, lambda x, i: CASE WHEN i % 2 = 0 AND {_card_ok('x')} AND (doc_id % 5 <> 0 OR left(replace(x, ' ', ''), 6) IN {_in(C.BANK_BINS)}) THEN CASE WHEN doc_id % 4 = 0 THEN repeat('#', length(x) - 4) ELSE left(x, 4) || repeat('*', length(x) - 8) END || right(x, 4) ELSE x END), '')"


def _id_ok(v: str) -> str:
    weights = "[" + ", ".join(map(str, C.CHECK_WEIGHTS)) + "]"
    total = f"list_sum(list_transform(range(1, 18), lambda k: CAST(substr({v}, CAST(k AS INT), 1) AS INT) * {weights}[k]))"
    day = f"try_strptime(substr({v}, 7, 8), '%Y%m%d')"
    return (
        f"(CASE WHEN regexp_full_match({v}, '[0-9]{{17}}[0-9X]') THEN CAST(substr({v}, 1, 2) AS INT) IN ({', '.join(map(str, C.PROVINCES))}) AND coalesce({day} BETWEEN DATE '1900-01-01' AND DATE '{Q.AS_OF}', false)"
        f" AND substr('{C.CHECK_CHARACTERS}', CAST({total} % 11 + 1 AS INT), 1) = substr({v}, 18, 1) ELSE false END)"
    )


_PHONE_VALUE = r"regexp_extract(text, '(?:\+86|0086)?1[3-9]\d[\s\-]?\d{4}[\s\-]?\d{4}')"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[a-z ]', '', 'g'), '[-+]', '', 'g'), '^86', ''), '^0086', '')"
_TOKENS = f"regexp_extract_all({{0}}, '{C.TOKEN_PATTERN}')"
_TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_SPANS = f"SELECT *, CASE entity_type WHEN 'CN_ID_CARD' THEN 1 WHEN 'CN_BANK_CARD' THEN 2 WHEN 'CN_PHONE_NUMBER' THEN 3 ELSE 5 END AS p FROM ({Q.SPAN_ROWS}) AS r"


_HITS = f"""SELECT doc_id, start_pos, end_pos, entity_type, score, value, {_mail_masked('value')} AS hidden FROM ({_mail_rows('documents', 'doc_id')}) AS m
 UNION ALL SELECT doc_id, pos, pos + length(value), 'CN_BANK_CARD', CASE WHEN left(replace(value, ' ', ''), 6) IN {_in(C.BANK_BINS)} THEN 0.95 ELSE 0.7 END, value, left(value, 4) || repeat('*', length(value) - 8) || right(value, 4)
 FROM (SELECT doc_id, p[i] AS value, CAST(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS BIGINT) AS pos FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT doc_id, {_doubled("coalesce(text, '')")} AS p FROM documents)) WHERE {_card_ok('p[i]')}) AS c"""
_BOXES = "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 200 AS INT) AS x, CAST(l_suppkey % 60 AS INT) AS y, CAST(l_quantity + 5 AS INT) AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 200, l_suppkey % 60, l_quantity) AS n FROM lineitem"
_TOUCH = "list_position(list_transform(o, lambda b: a[i].x1 <= b.x2 AND b.x1 <= a[i].x2 AND a[i].y1 <= b.y2 AND b.y1 <= a[i].y2), true)"

ORACLES = {
    # the documents of the size that is checked hold cards and mail only
    "text_anonymize": f"""WITH c AS (SELECT doc_id, text, {CARD_TEXT} AS t FROM documents), n AS (SELECT doc_id, count(*) AS n, string_agg('{{"entity_type":"' || entity_type || '","start":' || start_pos || ',"end":' || end_pos || ',"score":' || CAST(score AS DOUBLE)
 || ',"original_text":' || CAST(to_json(value) AS VARCHAR) || ',"anonymized_text":' || CAST(to_json(hidden) AS VARCHAR) || '}}', ',' ORDER BY start_pos) AS j FROM ({_HITS}) AS h GROUP BY doc_id)
 SELECT c.doc_id, {_mail_text('t')} AS anonymized_text, CAST(coalesce(n.n, 0) AS INTEGER) AS n_entities, '[' || coalesce(n.j, '') || ']' AS entities FROM c LEFT JOIN n ON c.doc_id = n.doc_id""",
    "ocr_merge_adjacent": f"""WITH RECURSIVE b AS ({_BOXES}), f AS (SELECT l_orderkey, n, [y] AS tops, CAST(1 AS BIGINT) AS line FROM b WHERE n = 1
 UNION ALL SELECT b.l_orderkey, b.n, CASE WHEN list_contains(list_transform(tops, lambda t: abs(t - y) <= 5), true) THEN tops ELSE list_append(tops, y) END,
 CAST(CASE WHEN list_contains(list_transform(tops, lambda t: abs(t - y) <= 5), true) THEN list_position(list_transform(tops, lambda t: abs(t - y) <= 5), true) ELSE len(tops) + 1 END AS BIGINT) FROM f JOIN b ON b.l_orderkey = f.l_orderkey AND b.n = f.n + 1),
 g AS (SELECT b.*, f.line, CASE WHEN x - lag(x + w) OVER s <= 20 THEN 0 ELSE 1 END AS fresh FROM b JOIN f ON b.l_orderkey = f.l_orderkey AND b.n = f.n WINDOW s AS (PARTITION BY b.l_orderkey, f.line ORDER BY x, b.n)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey, line ORDER BY x, n ROWS UNBOUNDED PRECEDING) AS part FROM g)
 SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY x, n) || ':' || min(x) || ',' || first(y ORDER BY x, n) || ',' || (last(x + w ORDER BY x, n) - min(x)) || ',12' AS box FROM r GROUP BY l_orderkey, line, part""",
    "image_redact": """WITH e AS (SELECT c_custkey, c_custkey % 3 = 0 AS mail, c_custkey % 5 = 1 AS other, [10 - 5, 5 - 5, 70 + 40 + 5, 15 + 5] AS a, [20 - 5, 25 - 5, 80 + 5, 35 + 5] AS b FROM customer)
 SELECT c_custkey, CAST(CAST(mail AS INT) + CAST(other AS INT) AS BIGINT) AS n_entities, concat_ws(' ', CASE WHEN mail THEN 'u' || c_custkey || '@mail.org' END, CASE WHEN other THEN 'x@y.org' END) AS lines,
 CAST(CASE WHEN mail AND other AND a[4] >= b[2] THEN (greatest(a[3], b[3]) - least(a[1], b[1]) + 1) * (least(b[4], 39) - a[2] + 1 - 1) WHEN mail THEN (a[3] - a[1] + 1) * (a[4] - a[2] + 1 - 1)
 WHEN other THEN (b[3] - b[1] + 1) * (least(b[4], 39) - b[2] + 1) ELSE 0 END AS BIGINT) AS covered FROM e""",
    "bbox_merge": f"""WITH RECURSIVE s AS (SELECT l_orderkey, list({{'x1': x - 5, 'y1': y - 5, 'x2': x + w + 5, 'y2': y + 17}} ORDER BY n) AS a FROM ({_BOXES}) AS b GROUP BY l_orderkey),
 f AS (SELECT l_orderkey, a, CAST(1 AS BIGINT) AS i, a[1:0] AS o, false AS done FROM s
 UNION ALL SELECT l_orderkey, CASE WHEN i > len(a) THEN o ELSE a END, CASE WHEN i > len(a) THEN 1 ELSE i + 1 END,
 CASE WHEN i > len(a) THEN a[1:0] WHEN coalesce(k, 0) = 0 THEN list_append(o, a[i])
 ELSE list_transform(o, lambda b, j: CASE WHEN j = k THEN {{'x1': least(a[i].x1, b.x1), 'y1': least(a[i].y1, b.y1), 'x2': greatest(a[i].x2, b.x2), 'y2': greatest(a[i].y2, b.y2)}} ELSE b END) END,
 i > len(a) AND len(o) = len(a) FROM (SELECT *, CASE WHEN i <= len(a) THEN {_TOUCH} END AS k FROM f WHERE NOT done) AS q)
 SELECT l_orderkey, CAST(b.x1 AS INTEGER) AS x1, CAST(b.y1 AS INTEGER) AS y1, CAST(b.x2 AS INTEGER) AS x2, CAST(b.y2 AS INTEGER) AS y2 FROM (SELECT l_orderkey, unnest(a) AS b FROM f WHERE done) AS u""",
    "text_anonymize_cards_mail": f"""WITH c AS (SELECT doc_id, text, {CARD_TEXT} AS t FROM documents), n AS (SELECT doc_id, count(*) AS n FROM ({CARD_ROWS} UNION ALL {MAIL_ROWS}) AS u GROUP BY doc_id)
 SELECT c.doc_id, {_mail_text('t')} AS anonymized_text, CAST(coalesce(n.n, 0) AS BIGINT) AS n_entities FROM c LEFT JOIN n ON c.doc_id = n.doc_id""",
    "bank_card_detect": f"SELECT doc_id, value, CAST(CASE WHEN left(replace(value, ' ', ''), 6) IN {_in(C.BANK_BINS)} THEN 0.95 ELSE 0.7 END AS DOUBLE) AS score FROM ({CARD_ROWS}) AS r",
    "email_detect": _mail_rows("documents", "doc_id"),
    "email_mask": f"SELECT doc_id, {_mail_text('text')} AS anonymized_text FROM documents",
    "email_rules": _mail_rows(f"({Q.MAILS}) AS m", "c_custkey"),
    "dedupe_then_anonymize": f"SELECT doc_id, {_mail_text('text')} AS anonymized_text FROM documents",
    "phone_detect": f"""SELECT c_custkey, 'CN_PHONE_NUMBER' AS entity_type, CAST(strpos(text, value) - 1 AS BIGINT) AS start_pos, CAST(strpos(text, value) - 1 + length(value) AS BIGINT) AS end_pos,
 CAST(CASE WHEN regexp_matches(value, '[ -]') THEN 0.75 WHEN regexp_matches(value, '^(\\+86|0086)') THEN 0.9 ELSE 0.85 END AS DOUBLE) AS score, value
 FROM (SELECT *, {_PHONE_VALUE} AS value FROM ({Q.PHONES}) AS m) AS v WHERE c_custkey % 10 >= 3 AND c_custkey % 7 <> 2 AND text LIKE '% end'""",
    "phone_validate": f"SELECT c_custkey, regexp_full_match({_BARE}, '1[3-9][0-9]{{9}}') AS valid FROM ({Q.PHONES}) AS m",
    "id_card_validate": f"SELECT o_orderkey, value, {_id_ok('value')} AS valid FROM ({Q.WITH_CHECK}) AS m",
    "id_card_detect": f"""SELECT o_orderkey, 'CN_ID_CARD' AS entity_type, CAST(2 AS BIGINT) AS start_pos, CAST(21 AS BIGINT) AS end_pos, CAST(0.95 AS DOUBLE) AS score, left(value, 6) || ' ' || right(value, 12) AS value
 FROM ({Q.WITH_CHECK}) AS m WHERE {_id_ok('value')} AND value NOT LIKE '%X'""",
    "id_card_ocr_repair": f"""SELECT o_orderkey, ok AS repaired, CASE WHEN ok THEN CAST(0.9 AS DOUBLE) END AS score FROM (SELECT o_orderkey, last_char <> 'X' AND len(list_filter(range(0, 19), lambda d: {_id_ok("(left(t, CAST(d AS INT)) || substr(t, CAST(d AS INT) + 2))")})) > 0 AS ok
 FROM (SELECT o_orderkey, right(value, 1) AS last_char, left(value, CAST(o_orderkey % 17 + 1 AS INT)) || '7' || substr(value, CAST(o_orderkey % 17 + 2 AS INT)) AS t FROM ({Q.WITH_CHECK}) AS m) AS w) AS x""",
    "passport_detect": f"""SELECT c_custkey, 'CN_PASSPORT' AS entity_type, CAST(5 AS BIGINT) AS start_pos, CAST(5 + length(value) AS BIGINT) AS end_pos, CAST(CASE c_custkey % 6 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.65 END AS DOUBLE) AS score, value
 FROM (SELECT c_custkey, regexp_extract(text, '[A-Z]+[0-9]+') AS value FROM ({Q.PASSPORTS}) AS m WHERE c_custkey % 6 IN (0, 1, 2, 5)) AS v""",
    "mask_generic": """SELECT c_custkey, CASE WHEN k + s >= length(v) THEN v ELSE left(v, k) || repeat(m, length(v) - k - s) || right(v, s) END AS masked
 FROM (SELECT c_custkey, left(c_name, CAST(c_custkey % 19 AS INT)) AS v, CAST(c_custkey % 5 AS INT) AS k, CAST(c_custkey % 7 AS INT) AS s, CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE '#' END AS m FROM customer)""",
    "mask_email_cases": f"""SELECT c_custkey, {_mail_masked('v')} AS masked FROM (SELECT c_custkey, left('abcdef', CAST(c_custkey % 5 + 1 AS INT)) || '@' || CASE c_custkey % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'a.b.cn' ELSE 'example.com' END AS v FROM customer)""",
    "priority_resolve": f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber) AS n FROM ({_SPANS}) AS q),
 f AS (SELECT l_orderkey, n, [{{'l': l_linenumber, 't': entity_type, 's': s, 'e': e, 'p': p}}] AS kept FROM o WHERE n = 1
 UNION ALL SELECT o.l_orderkey, o.n, CASE WHEN NOT (kept[-1].s < o.e AND o.s < kept[-1].e) THEN list_append(kept, {{'l': o.l_linenumber, 't': o.entity_type, 's': o.s, 'e': o.e, 'p': o.p}})
 WHEN o.p < kept[-1].p THEN list_append(kept[1:len(kept) - 1], {{'l': o.l_linenumber, 't': o.entity_type, 's': o.s, 'e': o.e, 'p': o.p}}) ELSE kept END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1),
 last AS (SELECT l_orderkey, arg_max(kept, n) AS kept FROM f GROUP BY l_orderkey)
 SELECT l_orderkey, x.l AS l_linenumber, x.t AS entity_type, x.s AS start_pos, x.e AS end_pos FROM (SELECT l_orderkey, unnest(kept) AS x FROM last)""",
    "threshold_filter": f"""SELECT l_orderkey, l_linenumber, CAST(score AS DOUBLE) AS score FROM ({_SPANS}) AS q
 WHERE score >= 0.35 AND score >= CASE entity_type WHEN 'CN_ID_CARD' THEN 0.9 WHEN 'CN_BANK_CARD' THEN 0.2 WHEN 'CN_PHONE_NUMBER' THEN 0.6 ELSE 0.35 END""",
    "explicit_threshold": f"SELECT entity_type, count(*) AS n FROM ({_SPANS}) AS q WHERE score >= 0.5 GROUP BY entity_type",
    "allow_list": f"SELECT c_custkey, value FROM ({_mail_rows(f'({Q.MAILS}) AS m', 'c_custkey')}) AS r WHERE NOT (c_custkey % 4 = 0 AND c_custkey < 200)",
    "deny_list": f"""SELECT doc_id, CAST(pos AS BIGINT) AS start_pos, CAST(pos + {len(Q.WORDS[0])} AS BIGINT) AS end_pos, CAST(1.0 AS DOUBLE) AS score FROM (SELECT doc_id, list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {len(Q.WORDS[0])} AS pos
 FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), '{Q.WORDS[0]}') AS p FROM documents)))""",
    "name_address_extraction": f"""SELECT c_custkey, t AS entity_type, CAST(strpos(text, v) - 1 AS BIGINT) AS start_pos, CAST(strpos(text, v) - 1 + length(v) AS BIGINT) AS end_pos, CAST(0.9 AS DOUBLE) AS score, v AS value FROM ({Q.TALK}) AS m,
 (VALUES ('CN_NAME', '张三丰'), ('CN_NAME', '李雷'), ('CN_ADDRESS', '北京市朝阳区建国路'), ('CN_ADDRESS', '朝阳区')) AS w(t, v) WHERE strpos(text, v) > 0 AND NOT regexp_matches(text, '(?i)^({"|".join(C.LABELS)})') AND (t = 'CN_NAME' OR length(v) >= {C.MIN_ADDRESS}) AND v <> '李雷'""",
    "extraction_filter": f"""SELECT id, length(t) >= 2 AND NOT regexp_full_match(t, '[\\d\\s\\-+\\.]+') AND NOT regexp_full_match(t, '[a-zA-Z0-9\\s\\-_\\.@]+') AND NOT regexp_matches(t, '(?i)^({"|".join(C.LABELS)})') AS wanted
 FROM (SELECT id, {_TRIMMED} AS t FROM (SELECT 't' || CAST(c_custkey AS STRING) AS id, text FROM ({Q.TALK}) AS m UNION ALL SELECT 'c-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), coalesce(text, '') FROM conversations) AS u) AS w""",
    "tokenize_fallback": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS t FROM documents)",
    "token_places": f"""SELECT conv_id, turn, array_to_string(list_transform(t, lambda x, i: CAST(coalesce(list_sum(list_transform(t[1:i - 1], lambda y: length(y))), 0) AS VARCHAR)), ' ') AS places
 FROM (SELECT conv_id, turn, {_TOKENS.format("coalesce(text, '')")} AS t FROM conversations)""",
    "keyword_extraction": f"SELECT conv_id, turn, array_to_string(list_transform(list_filter({_TOKENS.format("coalesce(text, '')")}, lambda x: x NOT IN {_in(C.NO_KEYWORDS)}), lambda x: lower(x)), ' ') AS keywords FROM conversations",
    "context_boost": f"""SELECT c_custkey, CAST(CASE WHEN len(list_filter(list_filter({_TOKENS.format('ahead')}, lambda k: k NOT IN {_in(C.NO_KEYWORDS)})[-{C.CONTEXT_WINDOW}:], lambda k: len(list_filter([{", ".join(f"'{w}'" for w in C.CONTEXT_WORDS[C.EMAIL])}], lambda w: contains(lower(k), w))) > 0)) > 0
 THEN least(greatest(0.85 + {C.CONTEXT_BOOST}, {C.CONTEXT_FLOOR}), 1.0) ELSE 0.85 END AS DOUBLE) AS score, value FROM (SELECT c_custkey, 'u' || CAST(c_custkey AS STRING) || '@example.org' AS value, left(text, length(text) - length('u' || CAST(c_custkey AS STRING) || '@example.org')) AS ahead FROM ({Q.SAID}) AS m) AS t""",
    "stop_words": f"""SELECT word, lower(word) IN {_in(C.STOPWORDS)} AS stop, list_contains([{", ".join("'" + p.replace("'", "''") + "'" for p in C.PUNCTUATION)}], word) AS punct, word IN {_in(C.LANGUAGES)} AS language
 FROM (SELECT DISTINCT unnest({_TOKENS.format("coalesce(text, '')")}) AS word FROM (SELECT text FROM conversations UNION ALL SELECT '{Q.MADE_WORDS}'))""",
    "pii_report": f"""SELECT lang, entity_type, count(*) AS n_entities, count(DISTINCT doc_id) AS n_texts FROM (SELECT *, 'CN_BANK_CARD' AS entity_type FROM ({CARD_ROWS}) AS a UNION ALL SELECT *, 'CN_EMAIL' FROM ({MAIL_ROWS}) AS b) AS u GROUP BY lang, entity_type""",
    "pages_email_mask": f"SELECT page_id, {_mail_text('html')} AS anonymized_text FROM pages",
    "fake_replace": "SELECT c_custkey, true AS ok, true AS other_kept FROM customer",
    "other_rewrites": "SELECT c_custkey, '<CN_NAME>' AS replaced, '' AS redacted, sha256(c_name) AS hashed, c_name AS kept, left(c_name, length(c_name) - 4) || '****' AS tail, upper(c_name) AS upper FROM customer",
    "request_validation": f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR text IS NULL OR length(text) = 0 THEN 'text is empty' WHEN length(text) > {C.MAX_TEXT} THEN 'text is too long' WHEN doc_id % 12 = 11 THEN 'score_threshold must be from 0 to 1'
 WHEN doc_id % 5 = 0 THEN 'keep_prefix must not be negative' END AS error FROM documents""",
    "request_anonymize": f"""WITH q AS (SELECT * FROM documents WHERE length(text) BETWEEN 1 AND {C.MAX_TEXT}), c AS (SELECT doc_id, text, {REQUEST_CARDS} AS t FROM q),
 found AS (SELECT doc_id FROM ({CARD_ROWS}) AS r WHERE doc_id % 3 <> 0 AND (doc_id % 5 <> 0 OR left(replace(value, ' ', ''), 6) IN {_in(C.BANK_BINS)}) UNION ALL SELECT doc_id FROM ({MAIL_ROWS}) AS r WHERE doc_id % 3 <> 1),
 n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id)
 SELECT c.doc_id, CASE c.doc_id % 3 WHEN 0 THEN {_mail_text('text')} WHEN 1 THEN t ELSE {_mail_text('t')} END AS anonymized_text, CAST(coalesce(n.n, 0) AS BIGINT) AS n_entities FROM c LEFT JOIN n ON c.doc_id = n.doc_id""",
    "supported_entities": "SELECT * FROM (VALUES " + ", ".join(f"('{e}')" for e in C.ENTITIES) + ") AS t(entity_type)",
    "mosaic_styles": "SELECT * FROM (VALUES ('pixel'), ('blur'), ('fill')) AS t(name)",
}
