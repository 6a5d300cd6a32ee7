"""The queries of the operators of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.decontaminate import find_leaks
from quillspan.llm.language import identify_languages
from quillspan.llm.line_dedup import dedup_lines
from quillspan.llm.mixing import mix_documents
from quillspan.llm.near_dup import near_dup_groups
from quillspan.llm.quality_classifier import classify_quality
from quillspan.llm.quality_rules import BOILERPLATE, clean_documents
from quillspan.llm.quotations import link_quotations
from quillspan.llm.sharding import shard_documents
from quillspan.llm.structure import repair_damaged
from quillspan.llm.token_counts import count_tokens
from quillspan.llm.url_filter import filter_urls
from quillspan.llm.whitening import whiten
from quillspan.session import table


#: The vocabulary of op5: a file that the driver can open.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_groups(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sharding, op2_line_dedup, op3_decontamination, op4_quality_rules, op5_token_counts, op6_quality_classifier, op7_minhash_near_dup, op8_chat_formatting, op9_source_mixing, op10_url_filter, op11_structure_repair, op12_embedding_whitening, op13_language_id)
    return {f.__name__: f for f in every}


#: Space characters that separate words, for DuckDB's regular expressions.
_S = r"[\x20\x09-\x0D]"

_OP2 = rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, p, i, line, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(i, 2) OVER w AS i3 FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, p) AS nth FROM windows WHERE l3 IS NOT NULL) WHERE nth > 1
), starts AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 3 THEN 0 ELSE 1 END AS fresh FROM later)
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 2 AS b FROM starts GROUP BY doc_id, run
), spans AS (
  SELECT r.doc_id, r.b - r.a + 1 AS n, x.i AS i1, y.i AS i2 FROM runs r JOIN filled x ON x.doc_id = r.doc_id AND x.p = r.a JOIN filled y ON y.doc_id = r.doc_id AND y.p = r.b
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = l.doc_id AND l.i BETWEEN s.i1 AND s.i2) GROUP BY l.doc_id
), removed AS (
  SELECT doc_id, sum(n) AS n FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def quality_rules_sql(boilerplate: dict[str, tuple[str, ...]]) -> str:
    """op4's SQL for phrases of any characters: signs of patterns stand for themselves, quotes are doubled."""
    phrases = "|".join(re.escape(p).replace("\\ ", " ") for of_language in boilerplate.values() for p in of_language).replace("'", "''")
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM base
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base
), filled AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') AS solid FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT doc_id, line, len(w) AS n, (NOT regexp_matches(line, '[.!?:;"'')\]…”’»›。！？][\x20\x09-\x0D]*$')
      OR 10 * (length(solid) - length(regexp_replace(solid, '[#*$%&|<>~^=@]', '', 'g'))) > length(solid)
      OR (len(list_filter(w, lambda x: x LIKE '%!!')) >= 3 AND 10 * len(list_filter(w, lambda x: x LIKE '%!!')) >= 3 * len(w))
      OR length(solid) - length(regexp_replace(solid, '[|>]', '', 'g')) >= 3
      OR regexp_matches(line, '(?i)(?:{phrases})')) AS fails FROM filled
), per_doc AS (
  SELECT doc_id, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost_words, sum(fails::INT) AS lost_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM judged GROUP BY doc_id
), grams AS (
  SELECT doc_id, p, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM base WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p+1, p+2, p+3, p+4]) AS q FROM again) GROUP BY doc_id
), figures AS (
  SELECT c.*, CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(l.lost_words, 0) AS BIGINT) AS lost_words, CAST(coalesce(l.lost_lines, 0) AS BIGINT) AS lost_lines
  FROM counted c LEFT JOIN per_doc l ON l.doc_id = c.doc_id LEFT JOIN covered v ON v.doc_id = c.doc_id
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_words <= 50 * n_words AS kept
FROM figures
"""


_HOST = "regexp_replace(substr(url, strpos(url, '://') + 3), '[/?#].*$', '', 's')"
_OP10 = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_replace(substr(url, strpos(url, '://') + 3 + length({_HOST})), '[?#].*$', '', 's') ELSE '' END AS path FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host = '' OR regexp_matches(host, 'spam|adult|casino|free-bets|porn') OR path LIKE '%.exe' OR path LIKE '%.zip' THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_MARKS = r"^[ \t]*((?:>[ \t]*)+)"
_OP8 = rf"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS raw FROM conversations
), levelled AS (
  SELECT *, length(regexp_replace(regexp_extract(raw, '{_MARKS}', 1), '[^>]', '', 'g')) AS level, regexp_replace(raw, '{_MARKS}', '') AS line FROM lines
), marked AS (
  SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM levelled
), parts AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY i) AS part, trim(regexp_replace(lower(line), '{_S}+', ' ', 'g')) AS bare FROM marked
), passages AS (
  SELECT conv_id, turn, part, level, trim(regexp_replace(lower(string_agg(line, chr(10) ORDER BY i)), '{_S}+', ' ', 'g')) AS p FROM parts GROUP BY conv_id, turn, part, level
), followed AS (
  SELECT conv_id, turn, bare AS a, lead(bare, 1) OVER w AS b, lead(bare, 2) OVER w AS c, lead(bare, 3) OVER w AS d FROM parts WHERE level = 0 AND bare <> '' WINDOW w AS (PARTITION BY conv_id, turn, part ORDER BY i)
), runs AS (
  SELECT conv_id, turn, a AS p FROM followed UNION SELECT conv_id, turn, a || ' ' || b FROM followed UNION SELECT conv_id, turn, a || ' ' || b || ' ' || c FROM followed
  UNION SELECT conv_id, turn, a || ' ' || b || ' ' || c || ' ' || d FROM followed UNION SELECT conv_id, turn, p FROM passages WHERE level = 0
), quotes AS (
  SELECT *, len(string_split(p, ' ')) AS n FROM passages WHERE level > 0 AND p <> ''
), linked AS (
  SELECT q.conv_id, q.turn, q.level, q.p, min(r.turn) AS first FROM quotes q JOIN runs r ON r.conv_id = q.conv_id AND r.p = q.p AND r.turn < q.turn WHERE q.n < 5 GROUP BY ALL
  UNION ALL SELECT q.conv_id, q.turn, q.level, q.p, min(o.turn) FROM quotes q JOIN passages o ON o.conv_id = q.conv_id AND o.level = 0 AND o.turn < q.turn AND contains(' ' || o.p || ' ', ' ' || q.p || ' ') WHERE q.n >= 5 GROUP BY ALL
), parents AS (
  SELECT conv_id, turn, arg_max(first, -level * 1000000000 + first) AS parent FROM linked GROUP BY conv_id, turn
), threads AS (
  SELECT c.conv_id, c.turn, c.turn AS thread FROM conversations c LEFT JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.turn WHERE p.parent IS NULL
  UNION ALL SELECT p.conv_id, p.turn, t.thread FROM parents p JOIN threads t ON t.conv_id = p.conv_id AND t.turn = p.parent
), counts AS (
  SELECT conv_id, turn, count(*) AS n, max(level) AS depth FROM quotes GROUP BY conv_id, turn
), own AS (
  SELECT conv_id, turn, string_agg(raw, chr(10) ORDER BY i) AS t FROM levelled WHERE level = 0 GROUP BY conv_id, turn
)
SELECT c.conv_id, c.turn, c.role, CAST(coalesce(k.n, 0) AS BIGINT) AS n_quotes, p.parent, CAST(coalesce(k.depth, 0) AS BIGINT) AS depth, h.thread,
  CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY h.thread, c.turn) - 1 AS BIGINT) AS position,
  CASE WHEN c.text IS NULL THEN NULL ELSE regexp_replace(coalesce(o.t, ''), '^{_S}+|{_S}+$', '', 'g') END AS text
FROM conversations c LEFT JOIN counts k ON k.conv_id = c.conv_id AND k.turn = c.turn LEFT JOIN threads h ON h.conv_id = c.conv_id AND h.turn = c.turn
LEFT JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.turn LEFT JOIN own o ON o.conv_id = c.conv_id AND o.turn = c.turn
"""

_OP11 = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, bytes
), bad AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, (VALUES (1), (2)) AS copies(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM bad
), faulty AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM placed
), pairs AS (
  SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial AS pair FROM faulty
), follow(s, r, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserted(s, t, letters, cost) AS (
  SELECT s, s, '', 0 FROM (VALUES (0), (1), (2), (3)) AS v(s) UNION ALL SELECT s, t, 'I', 5 FROM follow WHERE r <> 's'
  UNION ALL SELECT f.s, g.t, 'II', 10 FROM follow f JOIN follow g ON g.s = f.t WHERE f.r <> 's' AND g.r <> 's'
), best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, i.t AS s, i.letters AS audit, i.cost FROM conversations, inserted i WHERE i.s = 0
  UNION ALL
  SELECT conv_id, p, s, audit, cost FROM (
    SELECT b.conv_id, f.p, i.t AS s, b.audit || m.letter || i.letters AS audit, b.cost + m.cost + i.cost AS cost,
      row_number() OVER (PARTITION BY b.conv_id, i.t ORDER BY b.cost + m.cost + i.cost, b.audit || m.letter || i.letters) AS nth
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.p = b.p + 1
    JOIN (SELECT s, s AS t, 'D' AS letter, '' AS r, 2 AS cost FROM (VALUES (0), (1), (2), (3)) AS v(s) UNION ALL SELECT s, t, 'K', r, 0 FROM follow UNION ALL SELECT s, t, 'R', r, 1 FROM follow WHERE r <> 's') AS m0
      ON m0.s = b.s AND (m0.letter = 'D' OR (f.fault IN ('fine', 'truncated') AND (m0.letter = 'R' OR m0.r = f.initial)))
    CROSS JOIN LATERAL (SELECT m0.t AS t, m0.letter AS letter, m0.cost + CASE WHEN m0.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost) AS m
    JOIN inserted i ON i.s = m.t
  ) WHERE nth = 1
), figures AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM faulty GROUP BY conv_id
), wrong AS (
  SELECT conv_id, count(*) AS illegal FROM pairs WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id
), solved AS (
  SELECT c.conv_id, coalesce(f.rows, 0) AS rows, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(w.illegal, 0) AS illegal, b.cost, b.audit
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN wrong w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
  JOIN (SELECT conv_id, p, cost, audit, row_number() OVER (PARTITION BY conv_id, p ORDER BY cost, audit) AS nth FROM best WHERE s IN (0, 3)) b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.p = coalesce(f.rows, 0) AND b.nth = 1
), letters AS (
  SELECT conv_id, j, substr(audit, j, 1) AS letter, length(regexp_replace(left(audit, j), 'I', '', 'g')) AS p, length(regexp_replace(left(audit, j), 'D', '', 'g')) AS q FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM solved)
), made AS (
  SELECT l.conv_id, l.j, l.q, l.letter, f.role, f.text, max(CASE WHEN l.q = 1 AND l.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS headed
  FROM letters l LEFT JOIN faulty f ON l.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.p = l.p WHERE l.letter <> 'D'
), digest AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (q - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM made GROUP BY conv_id
)
SELECT s.conv_id, s.rows, s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, CAST(s.cost AS BIGINT) AS cost, s.audit, coalesce(d.h, sha256('')) AS repaired_sha256
FROM solved s LEFT JOIN digest d ON d.conv_id IS NOT DISTINCT FROM s.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """op1 has none only for want of a CRC function in DuckDB; it, op3, op5, op6, op7, op9, op12 and op13 are tested against brute force."""
    return {"op2_line_dedup": _OP2, "op4_quality_rules": quality_rules_sql(BOILERPLATE), "op8_chat_formatting": _OP8, "op10_url_filter": _OP10, "op11_structure_repair": _OP11}
