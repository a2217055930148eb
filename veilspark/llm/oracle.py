"""DuckDB SQL with the rows of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from .quality_rules import LADDERS, SETS
from .slots import N_SLOTS

#: All pairs that share a shingle, by counting, and the least id of what links reach. For small tables.
OP5 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM split
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS shared FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (n_a + n_b - shared)
), reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT l.b, x.r FROM reach x JOIN links l ON l.a = x.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM sets s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""

#: All windows of 50 bytes, as 100 hexadecimal digits, with the least id that holds each. For small tables. Texts are cut
#: into stretches of 256 windows first, because places in long strings are counted from their beginning.
OP10 = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), stretches AS (SELECT doc_id, c, substr(h, CAST(512 * c + 1 AS BIGINT), 512 + 98) AS p FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 255) // 256)) AS c FROM texts)
), windows AS (SELECT doc_id, 256 * c + k AS k, substr(p, CAST(2 * k + 1 AS BIGINT), 100) AS w FROM (SELECT doc_id, c, p, unnest(range(0, least(256, length(p) // 2 - 49))) AS k FROM stretches WHERE length(p) >= 100)
), least_of AS (SELECT w, min(doc_id) AS m FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM windows JOIN least_of USING (w) WHERE m < doc_id
), runs AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS e FROM (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM hits) GROUP BY doc_id, run
), gaps AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past FROM runs
), cut AS (
  SELECT g.doc_id, sum(g.e - g.a) AS removed, count(*) AS spans, string_agg(substr(h, CAST(2 * past + 1 AS BIGINT), CAST(2 * (a - past) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS kept
  FROM gaps g JOIN texts t ON t.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.doc_id = t.doc_id
"""

#: CRC-32 of UTF-8 texts byte by byte, a fold over the slots for the map, and counts for the places. For small tables.
OP2 = f"""
WITH RECURSIVE step AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY i) AS t FROM range(256) AS r(i)
), crcs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM documents, step
), slotted AS (SELECT doc_id, CAST(size AS BIGINT) AS size, crc, CAST(CAST('0x' || left(md5(concat_ws(':', doc_id, crc)), 8) AS BIGINT) % {N_SLOTS} AS INTEGER) AS v FROM crcs
), held AS (SELECT CAST(i AS INTEGER) AS v, coalesce(sum(size), 0) AS bytes, count(size) AS n FROM range({N_SLOTS}) AS r(i) LEFT JOIN slotted ON v = i GROUP BY i
), inorder AS (SELECT v, bytes, v % 8 AS shard, row_number() OVER (ORDER BY bytes DESC, v DESC) AS k FROM held
), share AS (SELECT ceil(sum(bytes) / 8) AS share FROM held
), fold AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS INTEGER) AS v, CAST(-1 AS BIGINT) AS shard, [CAST(0 AS HUGEINT) FOR x IN range(8)] AS load
  UNION ALL
  SELECT k, v, target, list_transform(load, lambda y, i: CASE WHEN i = target + 1 THEN y + bytes ELSE y END) FROM (
    SELECT o.k, o.v, o.bytes, f.load, CAST(CASE WHEN f.load[o.shard + 1] + o.bytes <= share THEN o.shard ELSE list_position(f.load, list_min(f.load)) - 1 END AS BIGINT) AS target FROM fold f JOIN inorder o ON o.k = f.k + 1, share)
), placed AS (SELECT f.v, f.shard, coalesce(sum(n) OVER (PARTITION BY f.shard ORDER BY f.v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM fold f JOIN held h ON h.v = f.v)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(ahead + row_number() OVER (PARTITION BY s.v ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, s.v AS virtual_slot, 2 AS version FROM slotted s JOIN placed p ON p.v = s.v
"""

_WIDE = ", ".join(LADDERS)
#: The rules with their cutoffs: halves of the labelled documents by CRC-32 of the id, proposals, and binomial sums in
#: place of bounds (the upper bound exceeds a share if and only if so few or fewer are likelier than the error level).
OP7 = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM split)
), twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeated AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(8) AS k(j) GROUP BY r
), counts AS (
  SELECT s.r, doc_id, stratum, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[!?]')) AS n_shouts, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '[0-9]')) AS n_digits,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_twins FROM split s LEFT JOIN repeated p ON p.r = s.r
), measured AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_share, CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0.0 END AS shout_share,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN n_twins / n_words ELSE 0.0 END AS twin_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars, CASE WHEN word_chars > 0 THEN n_digits / word_chars ELSE 0.0 END AS digit_share FROM counts
), long AS (UNPIVOT (SELECT r, stratum, base_failed, {_WIDE} FROM measured) ON {_WIDE} INTO NAME rule VALUE v
), good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), held AS (
  SELECT r, stratum, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, x: xor(a >> 1, 3988292384 * (a & 1)))) % 2 = 1 AS first FROM measured JOIN good USING (doc_id) WHERE NOT base_failed
), ladder AS (SELECT * FROM (VALUES {", ".join(f"('{rule}', {i}, {c})" for rule, steps in LADDERS.items() for i, c in enumerate(steps))}) AS x(rule, i, cutoff)
), sets AS (SELECT * FROM (VALUES {", ".join(f"({level}, {budget}, {back})" for level, (budget, back) in enumerate(SETS))}) AS x(level, budget, back)
), seen AS (SELECT h.stratum, rule, i, count(*) AS n, count(*) FILTER (WHERE v > cutoff) AS k FROM held h JOIN long USING (r) JOIN ladder USING (rule) WHERE first GROUP BY h.stratum, rule, i
), strictest AS (SELECT stratum, level, back, rule, max(i) AS i FROM seen, sets WHERE k <= budget * n GROUP BY stratum, level, back, rule
), proposed AS (SELECT stratum, level, rule, cutoff FROM strictest s JOIN ladder l USING (rule) WHERE l.i = s.i - s.back
), second AS (SELECT h.r, h.stratum, level FROM held h, sets WHERE NOT first AND h.stratum IN (SELECT stratum FROM seen)
), failed AS (SELECT DISTINCT r, p.level FROM long g JOIN proposed p ON p.stratum = g.stratum AND p.rule = g.rule WHERE v > cutoff
), tried AS (SELECT s.stratum, s.level, count(*) AS n, count(f.r) AS k FROM second s LEFT JOIN failed f ON f.r = s.r AND f.level = s.level GROUP BY s.stratum, s.level
), bounds AS (SELECT stratum, level, k < n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) <= 0.05 / (SELECT greatest(1, count(DISTINCT stratum)) FROM seen) AS ok FROM tried
), passed AS (SELECT stratum, level, bool_and(ok) OVER (PARTITION BY stratum ORDER BY level) AS ok FROM bounds
), chosen AS (SELECT stratum, max(level) AS level FROM passed WHERE ok GROUP BY stratum
), gone AS (SELECT r FROM failed f JOIN measured m USING (r) JOIN chosen c ON c.stratum = m.stratum AND c.level = f.level)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM gone) AS kept FROM measured
"""

ORACLES = {"op2_virtual_slots": OP2, "op7_risk_controlled_rules": OP7, "op5_multi_order_join": OP5, "op10_suffix_dedup": OP10}
