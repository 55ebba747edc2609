"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segspark.llm.chat import op1
from segspark.llm.decontam import op9
from segspark.llm.imatch import op8
from segspark.llm.langid import op5
from segspark.llm.lines import op2
from segspark.llm.packing import op6
from segspark.llm.pages import op4
from segspark.llm.quality import op7
from segspark.llm.simhash import op3
from segspark.llm.token_files import op10


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1,
        "op2_line_dedup": op2,
        "op3_simhash": op3,
        "op4_html_extraction": op4,
        "op5_language_id": op5,
        "op6_packing": op6,
        "op7_quality": op7,
        "op8_imatch": op8,
        "op9_decontamination": op9,
        "op10_token_files": op10,
    }


_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
cut AS (
  SELECT *, length('<|im_start|>' || replace(replace(role, '\', '\\'), chr(10), '\' || chr(10)) || chr(10) ||
      regexp_replace(replace(text, '\', '\\'), '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g') || '<|im_end|>' || chr(10)) AS n,
    row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS turns FROM turns
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sums AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM cut)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR pos = turns)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR pos = turns)::BIGINT AS n_examples
FROM sums GROUP BY conv_id"""

_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
lost AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN lost USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_DECONTAM = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i + 1:i + least(13, len(ws))], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0)),
starts AS (
  SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM grams) WHERE len(ws) >= n),
hits AS (
  SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(ws[i + 1:i + n], ' ') AS gram FROM starts) JOIN grams USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _CHAT, "op2_line_dedup": _LINES, "op9_decontamination": _DECONTAM}
