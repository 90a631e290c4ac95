"""Glob patterns over note paths, compiled to one regular expression.

A list of globs becomes a single anchored pattern literal, so the predicate is an
ordinary column expression: it needs no Python worker and no join.

Dialect: ``*`` and ``?`` stay within a path segment, ``**`` starting a segment spans
segments, no wildcard matches the leading dot of a segment, ``[...]`` and ``{a,b}``
work, ``!x`` negates. Extended groups are refused rather than guessed at.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_GLOB_CHARS = 65536

_VISIBLE = r"(?!\.)"
_SEGMENT = rf"{_VISIBLE}[^/]+"
_TREE = rf"(?:{_VISIBLE}[^/]*(?:/{_VISIBLE}[^/]*)*)"


class UnsupportedGlob(ValueError):
    """A construct of the dialect this library does not cover."""


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch in "_/ " or ord(ch) > 127 else "\\" + ch


def _closing(glob: str, start: int, opening: str, closing: str) -> int:
    """Index of the bracket closing the one at ``start``, or -1."""
    depth, i = 0, start
    while i < len(glob):
        if glob[i] == "\\":
            i += 1
        elif glob[i] == opening:
            depth += 1
        elif glob[i] == closing:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def _split_commas(body: str) -> list[str]:
    parts, depth, last, i = [], 0, 0, 0
    while i < len(body):
        if body[i] == "\\":
            i += 1
        elif body[i] == "{":
            depth += 1
        elif body[i] == "}":
            depth -= 1
        elif body[i] == "," and depth == 0:
            parts.append(body[last:i])
            last = i + 1
        i += 1
    return [*parts, body[last:]]


def _char_class(body: str) -> str:
    negated = body[0] in "!^"
    inner = body[1:] if negated else body
    inner = re.sub(r"([\[&])", r"\\\1", inner)
    if negated:
        return f"[^{inner}]" if "/" in inner else f"[^{inner}/]"
    return f"[{inner}]"


def _brace(body: str, at_start: bool, closes: bool) -> str | None:
    parts = _split_commas(body)
    if len(parts) > 1:
        return "(?:" + "|".join(_translate(p, at_start, closes) for p in parts) + ")"
    ends = body.split("..")
    if len(ends) < 2:
        return None
    if len(ends) != 2 or any(len(e) != 1 or not e.isalnum() for e in ends):
        raise UnsupportedGlob(f"brace range {{{body}}}")
    low, high = sorted(ends)
    return f"[{low}-{high}]"


def _translate(glob: str, at_start: bool = True, closes: bool = True) -> str:
    """Regex for a glob fragment.

    ``at_start``: the fragment begins a path segment. ``closes``: nothing follows it.
    """
    out: list[str] = []
    i, start = 0, at_start
    while i < len(glob):
        ch = glob[i]
        rest = glob[i + 1 :]
        if ch in "?*+@!" and rest.startswith("("):
            raise UnsupportedGlob(f"extended group in {glob!r}")
        if ch in "(|)":
            raise UnsupportedGlob(f"group or alternation in {glob!r}")
        if ch == "\\" and rest:
            out.append(_literal(rest[0]))
            i, start = i + 2, False
            continue
        if ch == "*":
            stars = len(glob[i:]) - len(glob[i:].lstrip("*"))
            end = i + stars
            if stars > 1 and start:
                if glob.startswith("/", end):
                    while glob.startswith("/**", end) and glob[end + 3 : end + 4] in ("", "/"):
                        end += 3
                    if end == len(glob):
                        out.append(_TREE)
                        i = end
                        continue
                    out.append(rf"(?:{_SEGMENT}/)*")
                    i, start = end + 1, True
                    continue
                if end == len(glob) and closes and out and out[-1] == "/":
                    out[-1] = rf"(?:/{_TREE})?"
                    i = end
                    continue
                out.append(_TREE)
            elif start:
                out.append(rf"{_VISIBLE}(?=[^/])[^/]*")
            else:
                out.append("[^/]*")
            i, start = end, False
            continue
        if ch == "?":
            out.append(rf"{_VISIBLE}[^/]" if start else "[^/]")
        elif ch == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                out.append((_VISIBLE if start else "") + _char_class(glob[i + 1 : end]))
                i = end
        elif ch == "{":
            end = _closing(glob, i, "{", "}")
            body = (
                _brace(glob[i + 1 : end], start, closes and end == len(glob) - 1)
                if end > 0
                else None
            )
            if body is None:
                out.append(r"\{")
            else:
                out.append(body)
                i = end
        else:
            out.append(_literal(ch))
        start = ch == "/"
        i += 1
    return "".join(out)


def glob_to_regex(glob: str) -> str | None:
    """Unanchored regex of one glob, ``None`` for one that never matches.

    Globs over ``MAX_GLOB_CHARS`` never match either, and are warned about.
    """
    if len(glob) > MAX_GLOB_CHARS:
        warnings.warn(f"glob of {len(glob)} characters matches nothing: {glob[:60]}...", stacklevel=2)
        return None
    if not glob:
        return None
    if glob.endswith("/"):
        glob += "**"
    negated = False
    while glob.startswith("!") and not glob.startswith("!("):
        negated, glob = not negated, glob[1:]
    glob = glob.removeprefix("./")
    regex = _translate(glob)
    return rf"(?!(?:{regex})$)[\s\S]*" if negated else regex


def combined_regex(patterns) -> str | None:
    """One anchored pattern for a list of globs, ``None`` when nothing can match.

    A glob whose pattern the engine refuses, as a class with its ends the wrong way
    round, matches nothing and is warned about; the others hold.
    """
    parts = []
    for glob in patterns:
        regex = glob_to_regex(glob)
        if regex is not None and not _compiles(regex):
            warnings.warn(f"glob matches nothing: {glob!r}", stacklevel=2)
        elif regex is not None:
            parts.append(regex)
    return "^(?:" + "|".join(parts) + r")\z" if parts else None


def _compiles(regex: str) -> bool:
    """Whether the engine that runs the pattern takes it."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(regex)
    except Exception:  # noqa: BLE001
        return False
    return True


def is_excluded(path: Column | str, patterns) -> Column:
    """True where any glob matches the path. Never null."""
    regex = combined_regex(patterns)
    if regex is None:
        return F.lit(False)
    column = F.col(path) if isinstance(path, str) else path
    return F.coalesce(column.rlike(regex), F.lit(False))


def exclude_paths(df, patterns, col: str = "path"):
    """Rows whose path no glob matches."""
    return df.filter(~is_excluded(col, patterns))


def valid_globs(lines) -> tuple[list[str], list[tuple[int, str]]]:
    """Split entered lines into usable globs and ``(line number, text)`` errors."""
    good: list[str] = []
    bad: list[tuple[int, str]] = []
    for number, line in enumerate(lines, start=1):
        text = line.strip()
        if not text:
            continue
        try:
            regex = glob_to_regex(text)
            usable = regex is not None and _compiles(regex)
        except UnsupportedGlob:
            usable = False
        (good if usable else bad).append(text if usable else (number, text))
    return good, bad
