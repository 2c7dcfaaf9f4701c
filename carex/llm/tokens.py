"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Contiguous rank array: a word is a list of part boundaries and a list of the ranks of joining adjacent parts. The
smallest rank is looked for, its boundary deleted, and the two neighbouring ranks refreshed, until no adjacent parts
join. Lists of short words are scanned whole; words beyond `SHORT` bytes go through a heap over linked parts, so
that no text takes quadratic time. Each distinct word is encoded once per process; a document is then a gather from
the arrays of its words.

Null and edge cases: the ids of an empty text are an empty list, and so are those of a null text, so that every row
has a list. Texts that look like special tokens are ordinary text. Whole texts are encoded, however long. Rows that
repeat give rows that repeat; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("CAREX_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text into words before the merges. White space is that of Unicode.
_SPACE = r"\t-\r \x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# The same words of an ASCII text, for the faster engine.
ASCII_PATTERN = (
    r" ?(?:[A-Za-z]+|[0-9]+)|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
# Line ends that are a word of their own wherever they stand, so that a text may be cut there.
CUT = r"(?<=\S)\n(?=\s?\S)"
SHORT = 192
MOST_WORDS = 400_000
_NONE = 1 << 40


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes of each token -> its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def join_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by a scan of its contiguous ranks."""
    find = ranks.get
    cut = list(range(len(word) + 1))
    near = [find(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        i = near.index(least)
        del cut[i + 1], near[i]
        if i < len(near):
            near[i] = find(word[cut[i] : cut[i + 2]], _NONE)
        if i:
            near[i - 1] = find(word[cut[i - 1] : cut[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def join_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: a heap of joins over linked parts, the leftmost first among equal ranks."""
    n = len(word)
    end, after, before, gone = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j] = 1
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            k = end[after[j]]
            if (r := ranks.get(word[i:k])) is not None:
                heapq.heappush(heap, (r, i, k))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


class Encoder(dict):
    """Maps each word to its place in arrays of ids; a word that is new is encoded and appended."""

    def __init__(self, path: str):
        super().__init__()
        self.ranks = ranks_of(path)
        self.words_of = regex.compile(PATTERN).findall
        self.ascii_words_of = re.compile(ASCII_PATTERN).findall
        self.lines_of = re.compile(CUT).split
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.flat, self.ends, self.lengths = array("i"), array("i", [0]), array("i", [0])

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "replace")
        if (one := self.ranks.get(raw)) is not None:
            ids = (one,)
        else:
            ids = (join_short if len(raw) <= SHORT else join_long)(raw, self.ranks)
        place = self[word] = len(self.ends)
        self.ends.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        return place

    def split(self, text: str) -> list[str]:
        """The words of a text; only its lines beyond ASCII need the engine that knows classes of Unicode."""
        if text.isascii():
            return self.ascii_words_of(text)
        words: list[str] = []
        for line in self.lines_of(text):
            words.extend(self.ascii_words_of(line) if line.isascii() else self.words_of(line))
            words.append("\n")
        words.pop()
        return words

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the place of each word of all texts in a row, how many words each text has)."""
        if len(self) > MOST_WORDS:
            self._reset()
        words, counts = [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                found = self.split(text)
                counts[k] = len(found)
                words.extend(found)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words)), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text)."""
        at, counts = self._places(texts)
        ends = np.frombuffer(self.ends, dtype=np.int32)
        starts, lengths = ends[at], np.frombuffer(self.lengths, dtype=np.int32)[at]
        total = np.concatenate(([0], np.cumsum(lengths)))
        gather = np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)
        flat = np.frombuffer(self.flat, dtype=np.int32) if len(self.flat) else np.zeros(0, np.int32)
        return flat[gather], total[np.concatenate(([0], np.cumsum(counts)))]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """How many tokens each text has."""
        at, counts = self._places(texts)
        total = np.concatenate(([0], np.cumsum(np.frombuffer(self.lengths, dtype=np.int32)[at] if len(at) else at)))
        return np.diff(total[np.concatenate(([0], np.cumsum(counts)))])


def _encoder(path: str, _kept: dict[str, Encoder] = {}) -> Encoder:  # noqa: B006
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def _slices(texts: pa.Array, most_chars: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts with a bounded total length, so that the words of a batch fit in memory."""
    held: list[str | None] = []
    start = size = 0
    for k, text in enumerate(texts):
        text = text.as_py()
        held.append(text)
        size += len(text or "")
        if size >= most_chars:
            yield start, held
            held, start, size = [], k + 1, 0
    if held:
        yield start, held


def token_ids(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens."""
    path = os.path.join(tokenizers, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            for start, texts in _slices(b.column("text")):
                flat, offsets = encoder.encode(texts)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, len(texts)), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens of every document; empty and null texts have 0 tokens."""
    path = os.path.join(tokenizers, vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            n = np.concatenate([np.zeros(0, np.int64), *[encoder.count(texts) for _, texts in _slices(b.column("text"))]])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return documents.select(*keep, "text").mapInArrow(count, f"{schema}, n_tokens bigint")
