"""Table schemas.  Reads and appends are checked against them; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame

PAGE = "source_filename string, page_number long, page_text string, source string, ocr_failed boolean"
CHUNK = "source_filename string, matter string, document_type string, provenance string, page_number long, section string, char_start long, char_end long, text string, embedding_text string"
LINE_MAP = "doc_id long, page long, line long, char_start long, char_end long"
DOCUMENT = "id long, matter_slug string, filename string, stored_path string, checksum string, status string, reason string, updated string, doc_type string, source_json string, digest_version string, size_bytes long"
FACT = "doc_id long, fact_type string, page long, char_start long, char_end long, span string, fact_key string, value map<string,string>"
REPORT = "filename string, sha256 string, type string, page_count long, status string, reason string"
AUDIT = "id long, prev_hash string, entry_hash string, ts string, event string, matter_slug string, detail string"

# fixed values: states that the tables' status columns can have
DOCUMENT_STATES = ("queued", "parsing", "ready", "needs_review", "failed")
JOB_STATES = ("queued", "running", "done", "error", "cancelled")
CELL_STATES = ("found", "potentially_missing", "not_confirmed")
REVIEW_STATES = ("confirmed", "dismissed")


def require(df: DataFrame, ddl: str, what: str) -> DataFrame:
    """``df`` if it has exactly the columns and types of ``ddl``, else ValueError: an older table must be rebuilt, not appended to."""
    want = df.sparkSession.createDataFrame([], ddl).dtypes
    if df.dtypes != want:
        raise ValueError(f"{what} has columns {df.dtypes}, not {want}; rebuild it")
    return df
