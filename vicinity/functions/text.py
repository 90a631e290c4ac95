"""Column expressions over note text and paths. All stay inside the JVM."""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinity.functions.regexes import RegexDialectError, compile_java
from vicinity.schema import ERROR_TEXT_CHARS, MIN_SEARCH_CHARS

log = logging.getLogger(__name__)

_FRONTMATTER = r"\A---[ \t]*\r?\n(?s:.*?)(?<=\n)---[ \t]*(?:\r?\n|\z)"

# Message shown for the first rule with a matching substring, in order.
GPU_RULES = (
    (("webgpu", "WebGPU"), "GPU acceleration failed - try disabling GPU in settings"),
    (
        ("Failed to get GPU adapter",),
        "GPU not available - disable GPU acceleration in settings",
    ),
)
NETWORK_RULES = (
    (("network", "fetch"), "Network error - check your internet connection"),
)
LOCAL_SERVER_RULES = (
    (
        ("Cannot connect",),
        "Cannot connect to Ollama server - check if Ollama is running",
    ),
    (
        ("not available",),
        "Model not found - check if model is installed in Ollama",
    ),
)
CLOUD_RULES = (
    (
        ("API key not valid", "INVALID_API_KEY", "API_KEY_INVALID"),
        "Invalid API key - check your Google AI Studio API key",
    ),
    (
        ("quota exceeded", "RESOURCE_EXHAUSTED"),
        "API quota exceeded - check your Google AI Studio usage limits",
    ),
    (
        ("model not found", "MODEL_NOT_FOUND", "models/"),
        "Model not found - check if the model ID is correct",
    ),
    (("PERMISSION_DENIED",), "Permission denied - check your API key permissions"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def note_title(path: Column | str) -> Column:
    """File name without its extension."""
    return F.regexp_extract(_col(path), r"([^/]*?)(?:\.[^./]*)?$", 1)


def strip_frontmatter(content: Column | str) -> Column:
    """Remove a leading ``---`` block; text without one is unchanged."""
    text = _col(content)
    return F.when(text.startswith("---"), F.regexp_replace(text, _FRONTMATTER, "")).otherwise(text)


def exclude_content(content: Column | str, patterns, strict: bool = False) -> Column:
    """Delete all matches of each pattern, in list order.

    An invalid pattern is skipped with a warning, or raises when ``strict``. Patterns
    are checked before the job starts, since one bad pattern would fail every task.
    """
    out = _col(content)
    for pattern in patterns:
        try:
            java = compile_java(pattern)
        except RegexDialectError as err:
            if strict:
                raise
            log.warning("skipping regular expression: %s", err)
            continue
        out = F.regexp_replace(out, java, "")
    return out


def nonempty_content(df, col: str = "content"):
    """Rows with some content; null counts as empty."""
    return df.filter(F.col(col) != "")


def embed_text(title: Column | str, content: Column | str, chunk_index: Column | str) -> Column:
    """Text handed to the embedder: the first chunk carries the note's title."""
    return F.when(
        _col(chunk_index) == 0, F.concat(_col(title), F.lit("\n\n"), _col(content))
    ).otherwise(_col(content))


def path_hash(path: Column | str) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 path."""
    return F.sha2(_col(path).cast("binary"), 256)


def classify_error(message: Column | str, custom_rules=()) -> Column:
    """Readable message for an error text: first matching rule, else the cut text."""
    text = _col(message)
    rules = (*custom_rules, *GPU_RULES, *NETWORK_RULES, *LOCAL_SERVER_RULES, *CLOUD_RULES)
    out = None
    for needles, shown in rules:
        for needle in needles:
            hit = text.contains(needle)
            out = F.when(hit, shown) if out is None else out.when(hit, shown)
    cut = F.concat(F.substring(text, 1, ERROR_TEXT_CHARS), F.lit("..."))
    return out.when(F.length(text) > ERROR_TEXT_CHARS, cut).otherwise(text)


def min_query_length(df, n: int = MIN_SEARCH_CHARS, col: str = "text"):
    """Queries long enough to run, in UTF-16 units; a character beyond them counts as two."""
    units = F.length(col) + F.length(F.regexp_replace(col, r"[^\x{10000}-\x{10FFFF}]", ""))
    return df.filter(units >= n)


def link_text(title: Column | str) -> Column:
    """Wiki-style link to a note."""
    return F.concat(F.lit("[["), _col(title), F.lit("]]"))


def normalized_text(text: Column | str) -> Column:
    """Trimmed text with each run of white space turned into one blank."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))
