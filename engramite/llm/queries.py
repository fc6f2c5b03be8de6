"""Queries over the training-data tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.llm import chat, decontaminate, katz, minhash, packing, pii, quality, secrets, toxicity, warc
from engramite.llm.common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near or exact copy among the documents with the document that represents its group."""
    return minhash.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "duplicate_of")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document, from a ledger that starts empty."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass the whole cascade."""
    return quality.kept(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of words that a document shares with a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT least(len(w), 8) AS n, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS g FROM b, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS t(i) WHERE len(w) >= 1),
n AS (SELECT DISTINCT n FROM p),
s AS (SELECT r, doc_id, i - 1 AS a, i - 1 + n AS z, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM d, n, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
h AS (SELECT DISTINCT r, doc_id, a, z FROM s SEMI JOIN p USING (n, g)),
m AS (SELECT *, max(z) OVER (PARTITION BY r ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
k AS (SELECT *, sum(CASE WHEN coalesce(reach, -1) < a THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY a, z) AS isle FROM m)
SELECT doc_id, CAST(min(a) AS INTEGER) AS first_word, CAST(max(z) AS INTEGER) AS after_word FROM k GROUP BY r, doc_id, isle
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every toxic document with its probability."""
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability and perplexity of every document by the trigram model of all documents, with every n-gram in it."""
    return katz.scored(table(spark, sf_dir, "documents"))


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, streamed back as chunks with running digests."""
    rows = warc.chunked(spark, table(spark, sf_dir, "pages"))
    return rows.select("record_id", "target_uri", "content_length", "chunk_no", F.length("payload").alias("n_bytes"), "sha256", F.sha2("payload", 256).alias("chunk_sha256"), "last")


def op7_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunk table of all pages: payloads, and the file and offset that tell repeated records apart."""
    return warc.chunked(spark, table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as canonical JSON with linked tool calls."""
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op8_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with their assistants' messages as tool calls, linked to results that come too early or never."""
    return chat.formatted(chat.called(table(spark, sf_dir, "conversations")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal identifier in every document, by source characters."""
    return pii.findings(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets.oracle(), "op3_quality_rules": quality.oracle(), "op4_decontaminate": OP4_SQL, "op6_katz_scoring": katz.ORACLE, "op7_warc_chunks": warc.ORACLE, "op8_chat_format": chat.ORACLE, "op8_chat_tool_calls": chat.CALLED_ORACLE}
