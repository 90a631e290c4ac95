"""SentencePiece encoding by a table of each prefix's last token.

The encoding of a prefix ends in one token, which is the same whatever follows the prefix
in a text whose encoding has a boundary there. An automaton over the vocabulary finds the
tokens that end at a position. The one that is compatible with the last token of the
prefix before it, that is, the pair is not merged across its seam, is the last token
there. Ids are then read off from the end backwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.words import PieceCache, in_slices

SPACE = "▁"
#: Pairs of tokens whose test is remembered.
PAIRS = 1 << 20

ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PrefixEncoder:
    """Encodes pieces of text with the vocabulary of a SentencePiece model of merge type.

    ``scores`` holds the tokens that merges can make, with the order of merges: higher
    scores first. ``ids`` gives the ids of a token, or of a character outside them.
    """

    def __init__(self, scores: dict[str, float], ids):
        self.scores, self.ids = scores, ids
        self.automaton = ahocorasick.Automaton()
        for token in scores:
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        self.characters = {token for token in scores if len(token) == 1}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge characters by definition: the best pair first, the leftmost of equal ones."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two stay as they are side by side; ``left`` may be empty."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            expected = [left, right] if left else [right]
            known = self.pairs[left, right] = self.merged(left + right) == expected
        return known

    def last_tokens(self, text: str) -> list[str]:
        """The last token of the encoding of each prefix; the first entry stands for none."""
        table: list[str | None] = [None] * (len(text) + 1)
        table[0] = ""
        pairs = self.pairs
        for end, token in self._matches(text):
            if table[end + 1] is None:
                left = table[end + 1 - len(token)]
                known = pairs.get((left, token))
                if known or (known is None and self.compatible(left, token)):
                    table[end + 1] = token
        return table

    def _matches(self, text: str):
        """End and token of all matches, by end, the longest first.

        A character that no token is stands for itself.
        """
        if self.characters.issuperset(text):
            return self.automaton.iter(text)
        own = [(i, c) for i, c in enumerate(text) if c not in self.characters]
        return sorted([*self.automaton.iter(text), *own], key=lambda m: (m[0], -len(m[1])))

    def encode(self, text: str) -> list[int]:
        table, at, out = self.last_tokens(text), len(text), []
        while at:
            token = table[at]
            out.append(self.ids(token))
            at -= len(token)
        return list(chain.from_iterable(reversed(out)))


def cut_words(text: str) -> list[str]:
    """The text with its leading space, cut before each run of spaces.

    No token has a space after another character, so none reaches across.
    """
    marked = SPACE + text.replace(" ", SPACE)
    cuts = marked.replace(SPACE, "\0" + SPACE).split("\0")[1:]
    if "\0" not in text and SPACE not in cuts:
        return cuts
    words: list[str] = []
    for word in marked.replace(SPACE, "\0" + SPACE).split("\0" + SPACE)[1:]:
        if words and words[-1].strip(SPACE) == "":
            words[-1] += SPACE + word
        else:
            words.append(SPACE + word)
    return words


@lru_cache(maxsize=4)
def _model(path: str):
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            scores[model.id_to_piece(i)] = model.get_score(i)
    assert not any(SPACE in token.lstrip(SPACE) for token in scores), "tokens across words"

    @lru_cache(maxsize=None)
    def byte(value: int) -> int:
        return model.piece_to_id(f"<0x{value:02X}>")

    @lru_cache(maxsize=1 << 16)
    def ids(token: str) -> tuple[int, ...]:
        if token in scores:
            return (model.piece_to_id(token),)
        return tuple(byte(b) for b in token.encode("utf-8", "surrogatepass"))

    encoder = PrefixEncoder(scores, ids)

    def compute(words: list[str]) -> list[tuple[list[int], str]]:
        found = (encoder.encode(word) for word in words)
        return [(ids, ",".join(map(str, ids))) for ids in found]

    return model, PieceCache(compute)


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[list[int], str]]:
    """Ids of each text, and the same in decimals joined by commas."""
    _, cache = _model(path)
    for part in in_slices(texts):
        cuts = [cut_words(text) if text else [] for text in part]
        get = cache.values(chain.from_iterable(cuts)).__getitem__
        for words in cuts:
            found = list(map(get, words))
            ids = list(chain.from_iterable(f[0] for f in found))
            yield ids, ",".join(f[1] for f in found)


def decode_ids(ids: list[int], path: str) -> str:
    """The library's own decoding."""
    return _model(path)[0].decode(ids) if ids else ""


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) of every row; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [found for found, _ in encode_texts(texts, path)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in the columns ``ENCODED``.

    A null text counts as empty and has no ids. A null ``doc_id`` and repeated rows are
    carried along; an empty table gives no rows. Needs ``doc_id`` and ``text``; other
    columns are not looked at. Only digests leave the tasks.
    """

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes, joined, decoded = [], [], []
            for ids, line in encode_texts(texts, path):
                sizes.append(len(ids))
                joined.append(digest(line))
                decoded.append(digest(decode_ids(ids, path)))
            columns = [pa.array(sizes, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _rows(docs).mapInArrow(run, ENCODED)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
