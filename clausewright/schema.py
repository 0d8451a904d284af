"""Declared schemas."""

from __future__ import annotations

SOURCE = "struct<title:string,bylaw_id:string,pdf_url:string>"
MESSAGE = "struct<fromMe:boolean,text:string,timestamp:string>"
REQUEST = f"query string, city string, conversation_context array<{MESSAGE}>, timestamp string"
RESPONSE = f"status string, message string, ai_response string, ai_error string, retrieved_sources array<{SOURCE}>, city string, timestamp string"
#: Log lines come in two shapes, with and without status and query; this is both.
LOG = RESPONSE + ", query string"
CHAPTER_INDEX = "bylaw_id string, title string, pdf_url string, pos int"
PAGE_BYLAW = "url string, title string, bylaw_number string, last_passed string, last_amended string, fetched_at string, text string, hash string"
PDF_BYLAW = "title string, pdf_url string, year string, bylaw_number string, fetched_at string, text string, hash string"
BASE_DOCUMENT = "title string, url string, text string, bylaw_number string, fetched_at string"
CHUNK = (
    "collection string, city string, bylaw_id string, title string, url string, bylaw_number string, chunk_index int, chunk_text string, content_sha256 string, "
    "fetched_at string, ingested_at string, embedding array<float>, embedding_model string, embedding_dim int"
)
CITY_REQUEST = "city string, email string, notes string"
FEEDBACK = "feedback string, email string"
