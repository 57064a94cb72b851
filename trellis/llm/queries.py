"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import bpe, chat, counts, idfiles, jaccard, media, packing, pii, quality, suffix
from trellis.llm.common import written

#: A conversation that says the template's control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return chat.read_examples(written(chat.format_examples(said.unionByName(hostile)), "examples"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(_documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_documents(spark, sf_dir), n=4, threshold=(85, 100), count_links=True)


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir))


def op6_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_documents(spark, sf_dir))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.stored_and_read(_documents(spark, sf_dir))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op9_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.written_and_read(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_prefix_targets, op2_suffix_dedup, op3_personal_data, op4_jaccard_join, op5_tree_bpe, op6_robust_quality, op7_token_counts, op8_media_columns, op9_cost_packing, op10_id_files)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 6 + length(role) + 1 + 8 + length(regexp_replace(text, '<(\\*)(/?turn>)', '<\\\1\2', 'g')) AS chars FROM said
), run AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix,
         lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_last FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM run GROUP BY conv_id
"""


#: Every 200-byte piece of every text, as hexadecimal digits; runs of repeated ones, and what lies between.
OP2_SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2, 2000)) AS part FROM t WHERE len(h) >= 400),
cut AS MATERIALIZED (SELECT doc_id, part, substr(h, 2 * part + 1, 4398) AS h FROM p),
starts AS MATERIALIZED (SELECT doc_id, part + i AS pos, md5(substr(h, 2 * i + 1, 400)) AS piece FROM (SELECT doc_id, part, h, unnest(range(0, least(2000, len(h) // 2 - 199))) AS i FROM cut WHERE len(h) >= 400)),
twice AS (SELECT piece FROM starts GROUP BY piece HAVING count(*) > 1),
hit AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200, true) AS fresh FROM starts JOIN twice USING (piece)),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 200 AS b FROM (SELECT doc_id, pos, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hit) GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT doc_id, coalesce((SELECT max(b) FROM runs r WHERE r.doc_id = t.doc_id), 0), len(h) // 2 FROM t)
SELECT t.doc_id, len(any_value(t.h)) // 2 AS n_bytes, CAST(coalesce((SELECT sum(b - a) FROM runs r WHERE r.doc_id = t.doc_id), 0) AS BIGINT) AS n_removed,
  (SELECT count(*) FROM runs r WHERE r.doc_id = t.doc_id) AS n_spans, sha256(unhex(string_agg(substr(t.h, 2 * kept.a + 1, 2 * (kept.b - kept.a)), '' ORDER BY kept.a))) AS kept_sha256
FROM t JOIN kept USING (doc_id) GROUP BY t.doc_id
"""

#: All pairs that share a shingle; components by labels that fall until none does.
OP4_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 3], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1) + 1))) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.size + nb.size - common)
), component(doc_id, least) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT l.b, min(c.least) FROM component c JOIN links l ON l.a = c.doc_id JOIN recurring.component o ON o.doc_id = l.b WHERE c.least < o.least GROUP BY l.b
)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.least AS component_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links
FROM documents d JOIN component c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_prefix_targets": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op4_jaccard_join": OP4_SQL}
