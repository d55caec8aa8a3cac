"""Settings, with their defaults and lower bounds."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

FALSE_WORDS = ("0", "false", "no", "off")


def _whole(name: str, default: int, least: int) -> int:
    return max(least, int(os.environ.get(name, default)))


def _flag(name: str) -> bool:
    return os.environ.get(name, "true").strip().lower() not in FALSE_WORDS


@dataclass(frozen=True)
class EngineConfig:
    """Built from the environment by default.

    embedder: texts -> vectors. reranker: (queries, passages) -> scores. rewriter, generator: Column functions of
    (instructions, prompt), as `functions.models.text_model` makes them from a Python model; a rewriter made with
    failed="" leaves a question on which it fails to the expansion. The model names, the device and the temperature are
    for the caller who makes the models.
    """

    books_dir: str = field(default_factory=lambda: os.environ.get("RAG_BOOKS_DIR", "").strip())
    min_page_characters: int = field(default_factory=lambda: _whole("RAG_MIN_PAGE_CHARACTERS", 40, 20))
    min_clean_characters: int = 60
    chunk_size: int = field(default_factory=lambda: _whole("RAG_CHUNK_SIZE", 1200, 700))
    chunk_overlap: int = field(default_factory=lambda: _whole("RAG_CHUNK_OVERLAP", 180, 80))
    min_chunk_characters: int = 120
    school_scope_only: bool = field(default_factory=lambda: _flag("RAG_SCHOOL_SCOPE_ONLY"))
    aap_body_start: int = field(default_factory=lambda: _whole("RAG_AAP_BODY_START_PAGE", 13, 1))
    pnp_body_start: int = field(default_factory=lambda: _whole("RAG_PNP_BODY_START_PAGE", 17, 1))
    embedding_batch: int = field(default_factory=lambda: _whole("RAG_EMBEDDING_BATCH_SIZE", 24, 1))
    embedding_device: str = field(default_factory=lambda: os.environ.get("RAG_EMBEDDING_DEVICE", "").strip())
    embedding_model: str = field(default_factory=lambda: os.environ.get("RAG_EMBEDDING_MODEL", "intfloat/multilingual-e5-base"))
    index_dir: str = field(default_factory=lambda: os.environ.get("RAG_CHROMA_DIRECTORY", "chroma_db"))
    reranker_model: str = field(default_factory=lambda: os.environ.get("RAG_RERANKER_MODEL", "cross-encoder/mmarco-mMiniLMv2-L12-H384-v1"))
    rewriter_model: str = field(default_factory=lambda: os.environ.get("RAG_QUERY_REWRITER_MODEL", "llama-3.3-70b-versatile"))
    llm_model: str = field(default_factory=lambda: os.environ.get("RAG_LLM_MODEL", "llama-3.3-70b-versatile"))
    llm_temperature: float = field(default_factory=lambda: float(os.environ.get("RAG_LLM_TEMPERATURE", "0.1")))
    dense_results: int = field(default_factory=lambda: _whole("RAG_DENSE_RESULTS_PER_QUERY", 60, 20))
    bm25_results: int = field(default_factory=lambda: _whole("RAG_BM25_RESULTS_PER_QUERY", 50, 20))
    rerank_limit: int = field(default_factory=lambda: _whole("RAG_RERANK_CANDIDATE_LIMIT", 90, 30))
    rrf_constant: int = field(default_factory=lambda: _whole("RAG_RRF_CONSTANT", 60, 1))
    final_k: int = field(default_factory=lambda: _whole("RAG_FINAL_K", 5, 1))
    enable_rewrite: bool = field(default_factory=lambda: _flag("RAG_ENABLE_LLM_REWRITE"))
    context_characters: int = 12000
    weights_file: str = field(default_factory=lambda: os.environ.get("RAG_WEIGHTS_FILE", os.path.join("evaluation", "retrieval_weights.json")))
    rewrite_instructions: str = field(default_factory=lambda: REWRITE_INSTRUCTIONS)
    answer_instructions: str = field(default_factory=lambda: ANSWER_INSTRUCTIONS)
    embedder: Callable | None = None
    reranker: Callable | None = None
    rewriter: Callable | None = None
    generator: Callable | None = None

    def __post_init__(self) -> None:
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")


#: What the rewriter is told, in words of our own; EngineConfig takes others
REWRITE_INSTRUCTIONS = """You turn a question, asked in Arabic or English, into one search query for textbooks on the nutrition of school children and adolescents.
Give the query alone, in English, in 5 to 20 words of a clinical textbook; translate silently where needed.
Keep the condition, the topic, the age group and what is wanted. Never answer, explain, apologise or ask anything back, and add no label, quote or list."""
#: What the generator is told, in words of our own; EngineConfig takes others
ANSWER_INSTRUCTIONS = """You answer questions on the nutrition of children from the numbered sources you are given, and from nothing else.
Write in the response language of the input. The child's profile comes with it: use it where the sources bear on it, and never ask for it again.
Put the matching [SOURCE N] after every factual claim. Make up no fact, amount, conversion, diagnosis, treatment or dose; where an amount is not in the sources, say that it varies with age and need.
Say nothing of prompts, models or retrieval, and add no general disclaimer; warn only where the question itself calls for it.
To an open question give a practical overview as a Markdown table with the columns Food group or nutrient, Why it matters, Practical food examples, Practical amount or note, with the rows that the sources support: protein foods, vegetables, fruit, grains and energy foods, dairy and other calcium-rich foods, healthy fats, water, minerals and vitamins.
Measure in grams, kilograms, milliliters, liters, cups, tablespoons and teaspoons, never in ounces, fluid ounces or pounds.
Answer what the sources support, if only a part. Only if they support nothing, return exactly NO_RELIABLE_CONTEXT."""
#: Fixed values
WEIGHTS = {"rerank": 0.62, "semantic": 0.25, "rrf": 0.08, "metadata": 0.05, "bm25": 0.0}
QUERY_WEIGHTS = (1.0, 0.90, 0.78)
BM25_SOURCE_WEIGHT = 0.22
NO_RELIABLE = "NO_RELIABLE_CONTEXT"
NO_CONTEXT = "I could not find enough reliable information in the available references to answer this question accurately. Please rephrase the nutrition question."
