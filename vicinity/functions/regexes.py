"""Translate ECMAScript regular expressions to the dialect Spark runs.

Users write patterns for an ECMAScript engine; Spark's ``regexp_replace`` runs
``java.util.regex``. The dialects agree on most syntax. The parts that differ are
rewritten here so that one pattern means the same in both, and syntax that only
one side accepts is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# The character classes of ECMAScript.
SPACE = r"\t\n\x0B\f\r\x20\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
LINE_END = r"\n\r\u2028\u2029"
WORD = "A-Za-z0-9_"

_OUTSIDE = {
    "s": f"[{SPACE}]",
    "S": f"[^{SPACE}]",
    "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    "B": f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
    "0": r"\x00",
    "v": r"\x0B",
}
_INSIDE = {"s": SPACE, "S": f"[^{SPACE}]", "b": r"\x08", "0": r"\x00", "v": r"\x0B"}
# With the flags below Java's own anchors stop at line feeds; the other line ends are added.
_FLAGS = "(?md)"
_BARE = {
    ".": f"[^{LINE_END}]",
    "^": r"(?:^|(?<=[\r\u2028\u2029]))",
    "$": r"(?:$|(?=[\r\u2028\u2029]))",
}
_GROUP_OPEN = re.compile(r"\(\?(?::|=|!|<=|<!|<[A-Za-z][A-Za-z0-9]*>)")
_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})")


class RegexDialectError(ValueError):
    """The pattern is not valid in the source dialect or cannot be carried over."""


def translate(pattern: str) -> str:
    """Java pattern equal to ``new RegExp(pattern, "gm")``."""
    out: list[str] = []
    i, in_class, after_quantifier = 0, False, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if i + 1 == len(pattern):
                raise RegexDialectError("pattern ends with a backslash")
            table = _INSIDE if in_class else _OUTSIDE
            if pattern[i + 1] == "b" and not in_class:
                out.append(_word_boundary(pattern, i))
            else:
                out.append(table.get(pattern[i + 1], pattern[i : i + 2]))
            i, after_quantifier = i + 2, False
            continue
        if in_class:
            if ch == "]":
                in_class = False
            out.append("\\" + ch if ch in "[&" else ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            if pattern.startswith("[]", i):  # matches nothing
                out.append("(?!)")
                i, in_class = i + 2, False
                continue
            if pattern.startswith("[^]", i):  # matches anything
                out.append(r"[\s\S]")
                i, in_class = i + 3, False
                continue
        if ch == "(" and pattern.startswith("(?", i) and not _GROUP_OPEN.match(pattern, i):
            raise RegexDialectError(f"group syntax at {i}: {pattern!r}")
        quantifier = _QUANTIFIER.match(pattern, i) if out else None
        if quantifier:
            if after_quantifier and quantifier.group() != "?":
                raise RegexDialectError(f"nothing to repeat at {i}: {pattern!r}")
            out.append(quantifier.group())
            i, after_quantifier = quantifier.end(), True
            continue
        if ch == "{":
            out.append(r"\{")
        else:
            out.append(_BARE.get(ch, ch))
        i, after_quantifier = i + 1, False
    if in_class:
        raise RegexDialectError(f"unterminated class: {pattern!r}")
    return _FLAGS + "".join(out)


def _word_boundary(pattern: str, at: int) -> str:
    """A boundary beside a plain word character needs to look one way only."""
    before, after = pattern[:at], pattern[at + 2 :]
    if re.match(r"\w(?![*?{])", after, re.ASCII):
        return f"(?<![{WORD}])"
    if re.search(r"(?:^|[^\\\w])\w+$", before, re.ASCII) and not re.search(
        r"[(\[{<\\][^)\]}>]*$", before
    ):
        return f"(?![{WORD}])"
    return _OUTSIDE["b"]


def compile_java(pattern: str) -> str:
    """Translate and check with the engine that will run it."""
    java = translate(pattern)
    spark = SparkSession.active()
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as err:
        raise RegexDialectError(f"invalid pattern {pattern!r}") from err
    return java


def valid_patterns(patterns) -> tuple[list[str], list[tuple[int, str]]]:
    """Split entered lines into usable patterns and ``(line number, text)`` errors.

    Blank lines are skipped; line numbers start at 1.
    """
    good: list[str] = []
    bad: list[tuple[int, str]] = []
    for number, line in enumerate(patterns, start=1):
        if not line.strip():
            continue
        try:
            compile_java(line)
        except RegexDialectError:
            bad.append((number, line))
        else:
            good.append(line)
    return good, bad
