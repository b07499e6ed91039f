"""Schemas of the tables that an engine keeps, and creation of those that are missing."""

from pyspark.sql import SparkSession

VERSION = 1
TABLES = {
    "sessions": "session_id string, created_at timestamp, last_seen_at timestamp",
    "documents": "doc_id string, session_id string, filename string, byte_size int, sha256 string, page_count int, status string, stage string, error_code string, primary_language string, direction string, languages array<struct<code:string,share:double>>, sections array<struct<title:string,page:int>>, warnings array<struct<code:string,pages:array<int>>>, storage_key string, created_at timestamp, updated_at timestamp, expires_at timestamp",
    "document_pages": "doc_id string, page_number int, width float, height float, text string, char_count int, language string, direction string, extraction string, ocr_confidence float",
    "document_chunks": "chunk_id string, doc_id string, chunk_index int, page_start int, page_end int, section_title string, language string, direction string, content string, search_text string, char_start int, char_end int, overlap_chars int, token_count int, terms array<string>",
    "chunk_embeddings": "chunk_id string, model string, dims int, embedding array<float>",
    "messages": "message_id string, conversation_id string, role string, kind string, content string, mode string, grounded boolean, citations array<struct<id:string,chunk_id:string,page_start:int,page_end:int,snippet:string>>, created_at timestamp",
    "ingest_jobs": "doc_id string, stage string, cursor string, lease_id string, lease_until timestamp, attempts int, parked_until timestamp, last_error string, created_at timestamp, updated_at timestamp",
    "ingest_stage_data": "doc_id string, kind string, item int, data string",
    "rate_counters": "key string, window_start timestamp, count int",
    "upload_tickets": "pathname string, session_id string, max_bytes bigint, issued_at timestamp, expires_at timestamp, claimed_at timestamp, document_id string, released_at timestamp",
}


def migrate(spark: SparkSession, database: str) -> int:
    """Creates the tables that are missing; running it again changes nothing. Returns the schema's version."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")
    return VERSION
