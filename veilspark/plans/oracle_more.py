"""DuckDB SQL for the queries of requests and images, written from the rules."""

from __future__ import annotations

from .. import constants as C
from . import catalog as Q
from . import catalog_images as I
from . import catalog_requests as R
from .oracle import _HITS, _SPANS, _TOKENS, CARD_TEXT, MAIL, _in, _mail_masked, _mail_ok, _mail_rows, _mail_text, _marked

_LABELLED = f"regexp_matches(text, '(?i)^({'|'.join(C.LABELS)})')"


def _everywhere(source: str, key: str, word: str) -> str:
    return f"""SELECT {key}, 'CN_NAME' AS entity_type, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {len(word)} AS BIGINT) AS start_pos,
 CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + i * {len(word)} AS BIGINT) AS end_pos, CAST(1.0 AS DOUBLE) AS score, '{word}' AS value
 FROM (SELECT {key}, p, unnest(range(1, len(p))) AS i FROM (SELECT {key}, string_split(text, '{word}') AS p FROM ({source}) AS m) AS q) AS h"""


def _replaced(text: str, made: str) -> str:
    return f"array_to_string(list_transform({_marked(text, MAIL)}, lambda x, i: CASE WHEN i % 2 = 0 AND {_mail_ok('x')} THEN {made} ELSE x END), '')"


_VALID = f"length(d.text) BETWEEN 1 AND {C.MAX_TEXT}"
_SHOTS = """SELECT c_custkey, c_custkey % 3 = 0 AS mail, c_custkey % 5 = 1 AS other FROM customer"""
#: Nearest pixel of 2 x 3 cells over an area of 25 x 35: down, then up again.
_CELL_Y = "5 + CAST(floor((floor((y - 5 + 0.5) * 2 / 25) + 0.5) * 25 / 2) AS INT)"
_CELL_X = "10 + CAST(floor((floor((x - 10 + 0.5) * 3 / 35) + 0.5) * 35 / 3) AS INT)"

ORACLES = {
    "request_analyze": f"""SELECT h.doc_id, entity_type, start_pos, end_pos, CAST(score AS DOUBLE) AS score, value FROM ({_HITS}) AS h JOIN documents d ON d.doc_id = h.doc_id
 WHERE {_VALID} AND (h.doc_id % 5 <> 0 OR score >= 0.8) AND CASE h.doc_id % 3 WHEN 0 THEN entity_type = 'CN_EMAIL' WHEN 1 THEN entity_type = 'CN_BANK_CARD' ELSE true END""",
    "json_results": f"""SELECT m.c_custkey, '{{"original_text":"' || text || '","anonymized_text":"' || {_mail_text('text')} || '","pii_entities":[' || CASE WHEN h.value IS NULL THEN '' ELSE '{{"entity_type":"CN_EMAIL","start":' || start_pos || ',"end":' || end_pos || ',"score":' || score
 || ',"original_text":"' || value || '","anonymized_text":"' || {_mail_masked('value')} || '"}}' END || '],"has_pii":' || CASE WHEN h.value IS NULL THEN 'false' ELSE 'true' END || '}}' AS result
 FROM ({Q.MAILS}) AS m LEFT JOIN ({_mail_rows(f'({Q.MAILS}) AS m', 'c_custkey')}) AS h ON h.c_custkey = m.c_custkey""",
    "response_envelope": f"""SELECT CAST(CASE WHEN error IS NULL THEN 200 ELSE 400 END AS INTEGER) AS code, coalesce(error, 'success') AS message, CASE WHEN error IS NULL THEN CAST(doc_id AS VARCHAR) ELSE 'none' END AS data FROM (
 SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR text IS NULL OR length(text) = 0 THEN 'text is empty' WHEN length(text) > {C.MAX_TEXT} THEN 'text is too long' WHEN doc_id % 12 = 11 THEN 'score_threshold must be from 0 to 1' WHEN doc_id % 5 = 0 THEN 'keep_prefix must not be negative' END AS error FROM documents) AS v""",
    "custom_recognizer": f"""SELECT o_orderkey, {_mail_text("regexp_replace(text, 'ORD-[0-9]{4,}', '<ORDER_NO>', 'g')")} AS anonymized_text, CAST(1 + len(regexp_extract_all(text, 'ORD-[0-9]{{4,}}')) AS BIGINT) AS n_entities FROM ({R.REFERENCES}) AS m""",
    "name_lists": f"{_everywhere(Q.TALK, 'c_custkey', '张三丰')} UNION ALL {_everywhere(Q.TALK, 'c_custkey', 'and')}",
    "extraction_keys": f"""SELECT c_custkey, 'CN_NAME' AS entity_type, CAST(strpos(text, v) - 1 AS BIGINT) AS start_pos, CAST(strpos(text, v) - 1 + length(v) AS BIGINT) AS end_pos, CAST(0.9 AS DOUBLE) AS score, v AS value
 FROM ({Q.TALK}) AS m, (VALUES ('张三丰'), ('李雷')) AS w(v) WHERE strpos(text, v) > 0 AND NOT {_LABELLED}""",
    "replace_operators": f"SELECT c_custkey, {_replaced('text', repr('[MAIL]'))} AS anonymized_text FROM ({Q.MAILS}) AS m",
    "requested_operators": f"""SELECT doc_id, {_replaced('t', "left(x, 1) || repeat('#', length(x) - 3) || right(x, 2)")} AS anonymized_text FROM (SELECT doc_id, {CARD_TEXT} AS t FROM documents) AS c""",
    "encrypt_rewrite": "SELECT c_custkey, c_name AS decrypted, false AS shown FROM customer",
    "settings_by_name": f"""SELECT l_orderkey, l_linenumber, s AS start_pos, e AS end_pos, CAST(score AS DOUBLE) AS score FROM ({_SPANS}) AS q
 WHERE score >= 0.1 AND score >= CASE entity_type WHEN 'CN_EMAIL' THEN 0.8 WHEN 'CN_ID_CARD' THEN 0.4 ELSE 0.5 END""",
    "position_best": f"""SELECT l_orderkey, l_linenumber, s AS start_pos, e AS end_pos, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, s, e ORDER BY score DESC, l_linenumber) AS n FROM ({R.CROWDED}) AS q) AS r WHERE n = 1""",
    "contained_drop": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, s, s - e, l_linenumber) AS n FROM ({R.CROWDED}) AS q WHERE score > 0)
 SELECT l_orderkey, l_linenumber, s AS start_pos, e AS end_pos, CAST(score AS DOUBLE) AS score FROM o AS a WHERE NOT EXISTS (SELECT 1 FROM o AS b WHERE b.l_orderkey = a.l_orderkey AND b.entity_type = a.entity_type AND b.n < a.n AND b.s <= a.s AND a.e <= b.e)""",
    "phone_merge": f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, score DESC, l_linenumber, e) AS n FROM ({_SPANS}) AS q),
 f AS (SELECT l_orderkey, n, s, e, true AS kept FROM o WHERE n = 1
 UNION ALL SELECT o.l_orderkey, o.n, CASE WHEN f.s < o.e AND o.s < f.e THEN f.s ELSE o.s END, CASE WHEN f.s < o.e AND o.s < f.e THEN f.e ELSE o.e END, NOT (f.s < o.e AND o.s < f.e) FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1)
 SELECT o.l_orderkey, o.l_linenumber, o.s AS start_pos, o.e AS end_pos, CAST(o.score AS DOUBLE) AS score FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n WHERE f.kept""",
    "tokenize_plugged": f"""SELECT conv_id, turn, array_to_string(CASE WHEN t = '' THEN [] WHEN length(t) % 5 = 0 THEN {_TOKENS.format('t')} ELSE string_split(t, ' ') END, '|') AS tokens FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) AS c""",
    "request_metrics": f"""SELECT (SELECT count(*) FROM customer) AS n_texts, count(DISTINCT c_custkey) AS n_with_pii, count(*) AS n_entities FROM ({_mail_rows(f'({Q.MAILS}) AS m', 'c_custkey')}) AS h""",
    "stream_email_mask": f"SELECT doc_id, {_mail_text('text')} AS anonymized_text FROM documents",
    "service_health": "SELECT 'healthy' AS status",
    "image_file_checks": f"""SELECT c_custkey, CASE WHEN kind NOT IN {_in(C.IMAGE_FORMATS)} THEN 'unsupported image format: ' || kind WHEN size > {C.MAX_IMAGE_BYTES} THEN 'image is too large' END AS error
 FROM (SELECT c_custkey, size, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS kind FROM ({I.FILES}) AS m) AS f""",
    "image_form_fields": f"""SELECT c_custkey, array_to_string(CAST(CAST(entities AS JSON) AS VARCHAR[]), ' ') AS entities, array_to_string(CAST(CAST(allow_list AS JSON) AS VARCHAR[]), ' ') AS allow_list,
 coalesce(TRY_CAST(trim(p[1]) AS INTEGER), -1) AS red, coalesce(TRY_CAST(trim(p[2]) AS INTEGER), -1) AS green, coalesce(TRY_CAST(trim(p[3]) AS INTEGER), -1) AS blue FROM (SELECT *, string_split(fill_color, ',') AS p FROM ({I.FORMS}) AS m) AS f""",
    "image_entity_rows": f"""SELECT c_custkey, 'CN_EMAIL' AS entity_type, 'u' || c_custkey || '@mail.org' AS text, 10 AS left_x, 5 AS top_y, 100 AS width, 10 AS height, CAST(0.85 AS DOUBLE) AS score FROM ({_SHOTS}) AS s WHERE mail
 UNION ALL SELECT c_custkey, 'CN_EMAIL', CASE c_custkey % 5 WHEN 0 THEN 'ok@qq.com' ELSE 'x@y.org' END, 20, 25, 60, 10, CASE c_custkey % 5 WHEN 0 THEN 0.95 ELSE 0.85 END FROM customer WHERE c_custkey % 5 < 2""",
    "image_request_redact": """WITH e AS (SELECT c_custkey, c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 3 = 0 AS mail,
 c_custkey % 11 <> 0 AND (c_custkey % 5 = 0 OR (c_custkey % 5 = 1 AND c_custkey % 7 >= 3 AND c_custkey % 13 <> 0)) AS other, [10 - 5, 5 - 5, 70 + 40 + 5, 15 + 5] AS a, [20 - 5, 25 - 5, 80 + 5, 35 + 5] AS b FROM customer)
 SELECT c_custkey, CAST(CAST(mail AS INT) + CAST(other AS INT) AS BIGINT) AS n_entities, concat_ws(' ', CASE WHEN mail THEN 'u' || c_custkey || '@mail.org' END, CASE WHEN other THEN CASE c_custkey % 5 WHEN 0 THEN 'ok@qq.com' ELSE 'x@y.org' END END) AS lines,
 CAST(CASE WHEN c_custkey % 17 = 0 THEN -1 WHEN mail AND other THEN (a[3] - a[1] + 1) * 39 WHEN mail THEN (a[3] - a[1] + 1) * a[4] WHEN other THEN (b[3] - b[1] + 1) * (39 - b[2] + 1) ELSE 0 END AS BIGINT) AS covered FROM e""",
    "ocr_shapes": """SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'a' || c_custkey || chr(10) || 'b' WHEN 3 THEN 'a' || c_custkey || chr(10) || 'b' WHEN 4 THEN '' ELSE 'a' || c_custkey END AS text,
 CASE c_custkey % 5 WHEN 4 THEN '' WHEN 1 THEN c_custkey || ',5,50,20 ' || c_custkey || ',5,50,20' WHEN 3 THEN c_custkey || ',5,50,20 ' || c_custkey || ',5,50,20' ELSE c_custkey || ',5,50,20' END AS places,
 CAST(CASE c_custkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence FROM customer""",
    "image_round_trip": """SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, 6 AS height, CAST(7 + n_nationkey % 4 AS INTEGER) AS width,
 md5(unhex(repeat(printf('%02x%02x%02x', CAST(255 - n_nationkey AS INT), CAST(n_nationkey * 5 % 256 AS INT), CAST(n_nationkey * 9 % 256 AS INT)), CAST(6 * (7 + n_nationkey % 4) AS INT)))) AS digest, CAST(NULL AS VARCHAR) AS error FROM nation""",
    "mosaic_pixels": f"""WITH g AS (SELECT n_nationkey, name, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(c AS INT) AS c FROM nation, (VALUES ('fill'), ('pixel')) AS s(name), range(0, {I.HEIGHT}) AS a(y), range(0, {I.WIDTH}) AS b(x), range(0, 3) AS d(c)),
 p AS (SELECT *, name = 'pixel' AND y BETWEEN 5 AND 29 AND x BETWEEN 10 AND 44 AS coarse FROM g),
 v AS (SELECT *, CASE WHEN name = 'fill' AND y BETWEEN 5 AND 30 AND x BETWEEN 10 AND 45 THEN c + 1 ELSE ((CASE WHEN coarse THEN {_CELL_Y} ELSE y END) * 7 + (CASE WHEN coarse THEN {_CELL_X} ELSE x END) * 13 + c * 29 + n_nationkey * 31) % 256 END AS byte FROM p)
 SELECT n_nationkey, name, md5(unhex(string_agg(printf('%02x', CAST(byte AS INT)), '' ORDER BY y, x, c))) AS digest FROM v GROUP BY n_nationkey, name""",
}
