"""Encode whole texts by encoding each distinct piece of text once.

A text is cut where no token can reach across. Pieces repeat a lot, so each process keeps
what it has found for the latest ones in two generations of bounded size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np

#: Pieces in one generation, and characters of texts whose new pieces are encoded at once.
GENERATION = 400_000
SLICE = 1 << 21


class PieceCache:
    """Values of pieces; ``compute`` gets the new ones of a slice together."""

    def __init__(self, compute: Callable[[list[str]], list], generation: int = GENERATION):
        self.compute, self.generation = compute, generation
        self.young: dict = {}
        self.old: dict = {}

    def known(self, pieces: Iterable[str]) -> dict:
        """Those of the pieces that are there, with their values."""
        return {p: v for p in pieces if (v := self.young.get(p) or self.old.get(p))}

    def values(self, pieces: Iterable[str]) -> dict:
        """A table with at least the values of these pieces."""
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        new = []
        for piece in set(pieces).difference(self.young):
            found = self.old.get(piece)
            if found is None:
                new.append(piece)
            else:
                self.young[piece] = found
        self.young.update(zip(new, self.compute(new)))
        return self.young


def in_slices(texts: Iterable[str], size: int = SLICE) -> Iterator[list[str]]:
    """Consecutive texts, about ``size`` characters at a time; a longer one stands alone."""
    held, chars = [], 0
    for text in texts:
        if held and chars + len(text) > size:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


_SPACE_FIRST = re.compile(r" \s")
_SPACE_LAST = re.compile(r"[^\S ] ")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_level_pieces(text: str) -> list[str]:
    """Cut before each single space between characters that are not white space.

    The pattern of byte-level BPE takes such a space to the word after it, so it always
    begins a new word there.
    """
    if "\0" in text or _SPACE_FIRST.search(text) or _SPACE_LAST.search(text):
        first, *rest = _SINGLE_SPACE.split(text)
        return [first, *(" " + r for r in rest)]
    return text.replace(" ", "\0 ").split("\0")


#: White space as Unicode defines it; str.split() also cuts at the four separators 1C to 1F.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters whose lower case depends on what is around them, or is several characters.
_CONTEXT = re.compile("[\u03a3\u0130]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def word_pieces(text: str, special: Iterable[str] = ()) -> list[str]:
    """The words between white space, which the tokenizers with word ends drop.

    In lower case, as they read them, so that more words are the same; but not where that
    would make a ``special`` token, which they look for in the text as it is.
    """
    if not _CONTEXT.search(text):
        lower = text.lower()
        if all(lower.count(s) == text.count(s) for s in special if s in lower):
            text = lower
    if _SEPARATORS.search(text):
        return [w for w in _WHITE.split(text) if w]
    return text.split()


@lru_cache(maxsize=8)
def _tokenizer(path: str, special: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return tokenizer


def _plain(piece: str, word_ends: bool) -> bool:
    """One word of letters, after a space if the file is byte-level."""
    return piece.isalpha() if word_ends else piece[:1] == " " and piece[1:].isalpha()


@lru_cache(maxsize=8)
def _encoder(path: str, word_ends: bool, special: bool) -> Callable:
    tokenizer = _tokenizer(path, special)
    marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if special else []
    cut = partial(word_pieces, special=marks) if word_ends else byte_level_pieces
    # Two bytes an id in the cache, if that is enough.
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    mark = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    for token, number in tokenizer.get_vocab().items():
        mark[number] = token.endswith("</w>") if word_ends else token.startswith("\u0120")

    def together(pieces: list[str]) -> list[bytes] | None:
        """Words of letters in one call; their ids are told apart by the word's last or first token."""
        text = (" " if word_ends else "").join(pieces)
        (found,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, dtype=kind)
        cuts = np.flatnonzero(mark[ids]) + word_ends
        if len(cuts) != len(pieces) or len(ids) == 0:
            return None
        bounds = [0, *cuts.tolist()] if word_ends else [*cuts.tolist(), len(ids)]
        flat, width = ids.tobytes(), kind.itemsize
        return [flat[width * x : width * y] for x, y in zip(bounds, bounds[1:])]

    def apart(pieces: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, dtype=kind).tobytes() for e in found]

    stops = {mark: apart([mark])[0] for mark in ".,"}

    def compute(pieces: list[str]) -> list[bytes]:
        # A stop after letters is a word of its own, so only the letters are looked up.
        cores = [p[:-1] if p[-1:] in stops else p for p in pieces]
        letters = {c for c in cores if _plain(c, word_ends)}
        known = cache.known(letters)
        plain = list(letters.difference(known))
        known.update(zip(plain, together(plain) or apart(plain)))
        rest = [p for p, c in zip(pieces, cores) if c not in known]
        known.update(zip(rest, apart(rest)))
        return [known[p] if p in known else known[c] + stops[p[-1]] for p, c in zip(pieces, cores)]

    cache = PieceCache(compute)

    def encode(texts: Iterable[str]) -> Iterator[bytes]:
        for part in in_slices(texts):
            cuts = [cut(text) for text in part]
            get = cache.values(chain.from_iterable(cuts)).__getitem__
            for pieces in cuts:
                yield np.frombuffer(b"".join(map(get, pieces)), kind).astype("<u4").tobytes()

    return encode


def encode_bytes(
    texts: Iterable[str], path: str, word_ends: bool, special: bool = False
) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    The same ids as the tokenizers library gives for the whole text with the file at
    ``path`` and ``add_special_tokens=False``. A special token written out in the text is
    its one id with ``special``, as is the library's default, or else plain text. ``word_ends`` tells the kind of the file: words
    without white space, or byte-level.
    """
    return _encoder(path, word_ends, special)(texts)
