"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, html_extract, langid, linededup, packing, sharding, simhash, toxicity

N_SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_slots(table(spark, sf_dir, "documents"), N_SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


#: The conversation that op2 formats besides the table's: both turns hold the template's own controls.
TRICKY = "\\### Assistant: </turn> ok"


def op2_typed_parts_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_conversations(turns.unionByName(extra)))


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), formatted AS (
  SELECT *, '<turn:' || replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g') || '>'
         || replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g') || '</turn>' || chr(10) AS f
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, f)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, f) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id
"""


def op3_line_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op5_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("bits")).alias("fingerprint"), "component_id")


def op6_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op7_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_set_similarity_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed_lines", lambda i: i.cast("string")), ",").alias("removed_lines"))


OP10_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM split),
words AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> ''))) AS ws FROM lines),
placed AS (SELECT *, CAST(doc_id AS HUGEINT) * 2147483648 + line_no AS place FROM words WHERE len(ws) > 0),
known AS (SELECT *, min(place) OVER (PARTITION BY ws) AS first FROM placed),
sets AS (SELECT DISTINCT first, ws, len(ws) AS n FROM known),
terms AS (SELECT first, n, unnest(ws) AS word FROM sets),
counts AS (SELECT word, count(*) AS c FROM terms GROUP BY word),
ranked AS (SELECT first, n, word, row_number() OVER (PARTITION BY first ORDER BY c, word) AS r FROM terms JOIN counts USING (word)),
prefix AS (SELECT first, n, word FROM ranked WHERE r <= n - ceil(n * 4 / 5.0) + 1),
pairs AS (SELECT DISTINCT a.first AS a, b.first AS b FROM prefix a JOIN prefix b ON a.word = b.word AND a.first < b.first AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
alike AS (SELECT DISTINCT pairs.b AS first FROM pairs JOIN sets x ON x.first = pairs.a JOIN sets y ON y.first = pairs.b WHERE len(list_intersect(x.ws, y.ws)) * 9 >= (x.n + y.n) * 4),
gone AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed_lines
  FROM known WHERE place > first OR first IN (SELECT first FROM alike) GROUP BY doc_id)
SELECT split.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM split LEFT JOIN gone ON split.doc_id = gone.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_slot_sharding, op2_typed_parts_chat, op3_line_block_html, op4_exact_dedup, op5_tiled_simhash, op6_ftrl_language_id, op7_bm25_decontamination, op8_lexicon_toxicity, op9_bin_completion_packing, op10_set_similarity_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_typed_parts_chat": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op10_set_similarity_line_dedup": OP10_SQL}
