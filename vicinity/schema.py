"""Table schemas and option defaults shared by the whole library."""

from __future__ import annotations

from dataclasses import dataclass

NOTES = "path STRING, title STRING, content STRING, mtime BIGINT"
LINKS = "src STRING, dst STRING"
CHUNKS = (
    "path STRING, title STRING, content STRING, chunk_index INT, "
    "total_chunks INT, embedding ARRAY<FLOAT>"
)
INDEX = CHUNKS + ", path_hash STRING, last_updated TIMESTAMP"
STATE = "path STRING, mtime BIGINT"
ERRORED = (
    "path STRING, error STRING, attempts INT, mtime BIGINT, "
    "last_tried_at TIMESTAMP"
)
CHANGES = "path STRING, reason STRING, mtime BIGINT, old_path STRING, attempts INT"
EVENTS = (
    "ts TIMESTAMP, seq BIGINT, kind STRING, path STRING, old_path STRING, "
    "mtime BIGINT"
)
USAGE = "ts TIMESTAMP, tokens BIGINT"

# Defaults and constants that results depend on.
SEMANTIC_CHUNK_TOKENS = 512
CHUNK_OVERLAP = 100
CHUNKS_PER_SOURCE_CHUNK = 15
TEXT_SEARCH_FACTOR = 3
MAX_ATTEMPTS = 3
EMBED_BATCH = 32
PAYLOAD_BUDGET_BYTES = 8192
CONTEXT_SAFETY_FACTOR = 0.5
BYTES_PER_TOKEN = 2
ASCII_CHARS_PER_TOKEN = 4
ASCII_RATIO = 0.8
RETENTION_DAYS = 30
PREVIEW_ROWS = 100
ERROR_TEXT_CHARS = 100
MIN_SEARCH_CHARS = 3
MIN_SUGGEST_CHARS = 1
EXPORT_VERSION = 1


@dataclass(frozen=True)
class Options:
    """User-facing settings with their defaults."""

    exclude_globs: tuple[str, ...] = ("Templates/", "Archive/", ".trash/", "Excalidraw/")
    exclude_regexes: tuple[str, ...] = ()
    include_frontmatter: bool = False
    show_source_chunk: bool = False
    sidebar_count: int = 10
    bottom_count: int = 5
    min_similarity: float = 0.0
    indexing_delay_seconds: int = 1
    display_mode: str = "smart"
    chunk_size: int = SEMANTIC_CHUNK_TOKENS
    chunk_overlap: int = CHUNK_OVERLAP
    counter: object = "bytes"
    batch_size: int = EMBED_BATCH
    max_attempts: int = MAX_ATTEMPTS
    on_empty: str = "keep"
    reuse_vectors: bool = False

    @property
    def result_count(self) -> int:
        """Results fetched per note so that every view can be served."""
        return max(self.sidebar_count, self.bottom_count)


def columns(ddl: str) -> list[str]:
    """Column names of one of the DDL strings above."""
    return [part.split()[0] for part in ddl.split(", ")]
