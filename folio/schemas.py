"""Schemas of the stages."""

from pyspark.sql import types as T

PAGE = T.StructType.fromDDL if False else (
    "book_id string, book_key string, book_title string, source string, source_path string, source_sha256 string, "
    "pdf_page_index int, page_number int, page_label string, document_type string, text string"
)
HIT = (
    "query_id string, chunk_id string, text string, book_title string, source string, page_number int, chapter_title string, "
    "section_title string, part_title string, hierarchy_path string, semantic_similarity double, bm25_score double, "
    "rrf_score double, rerank_score double, metadata_score double, final_score double"
)
