"""Byte-pair encoding by last-token states over a trie of words.

A text is split into words by the tokenizer's pattern. The encoding of any prefix
of a word is known by its last token and the encoding of what is before that token;
the last token of a prefix is the one vocabulary entry that ends there and is
*compatible* with the last token of the rest: the two, joined and merged afresh,
come out as the same two. New distinct words are laid out as a trie (sorted, each
word keeping the states of the prefix it shares with the word before it), so a
shared prefix is encoded once.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from hearthdex.session import spread

#: The splitting pattern of the public byte-level vocabularies; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern over ASCII texts, for the faster engine of the standard library.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Distinct words that a worker keeps encoded; beyond that the table starts afresh.
KEPT_WORDS = 1_000_000


def default_vocabulary() -> str:
    """Place of byte_bpe_50k.tiktoken: ``HEARTHDEX_TOKENIZERS`` or the installed package."""
    at = os.environ.get("HEARTHDEX_TOKENIZERS")
    if at is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    return os.path.join(at, "byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class TrieEncoder:
    """Encodes words of bytes; keeps what it has encoded."""

    def __init__(self, ranks: dict[bytes, int], kept_words: int = KEPT_WORDS):
        self.ranks = ranks
        self.spelled = {rank: token for token, rank in ranks.items()}
        # lengths of entries by their last byte, longest first: which lengths are worth a look
        by_end: list[set[int]] = [set() for _ in range(256)]
        for token in ranks:
            by_end[token[-1]].add(len(token))
        self.lengths = [sorted(x, reverse=True) for x in by_end]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.kept_words = kept_words
        self._any = regex.compile(PATTERN).findall
        self._ascii = re.compile(ASCII_PATTERN).findall

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self._ascii(text) if text.isascii() else self._any(text)

    def merged(self, word: bytes) -> list[int]:
        """The encoding of a short word by merging the pair of least rank, again and again."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """Whether ``before`` and ``token`` stay as they are when joined."""
        known = self.compatible.get((before, token))
        if known is None:
            joined = self.spelled[before] + self.spelled[token]
            # every entry of a merge vocabulary is the encoding of its own bytes
            known = joined not in self.ranks and self.merged(joined) == [before, token]
            self.compatible[before, token] = known
        return known

    def add(self, words: Iterable[str]) -> None:
        """Walk the trie of ``words`` depth first and keep each word's encoding."""
        ranks, spelled = self.ranks, self.spelled
        previous, last = b"", []  # last[i]: the last token of the prefix of i + 1 bytes
        for key, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = len(os.path.commonprefix((previous, key)))
            del last[shared:]
            for end in range(shared + 1, len(key) + 1):
                for length in self.lengths[key[end - 1]]:
                    if length > end:
                        continue
                    token = ranks.get(key[end - length : end])
                    if token is not None and (length == end or self.fits(last[end - length - 1], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no entry for byte {key[end - 1]}")
            previous, out, end = key, [], len(key)
            while end:
                out.append(last[end - 1])
                end -= len(spelled[out[-1]])
            self.words[word] = tuple(reversed(out))

    def _known(self, texts: list[list[str]]) -> dict[str, tuple[int, ...]]:
        if len(self.words) > self.kept_words:
            self.words.clear()
        new = set().union(*texts).difference(self.words)
        if new:
            self.add(new)
        return self.words

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split(t) for t in texts]
        known = self._known(words)
        out = []
        for each in words:
            ids: list[int] = []
            for w in each:
                ids += known[w]
            out.append(ids)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        words = [self.split(t) for t in texts]
        known = self._known(words)
        return [sum([len(known[w]) for w in each]) for each in words]


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """This worker's encoder of the vocabulary at ``path``."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(read_ranks(path))
    return _encoders[path]


def _pieces(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, so that a run's words fit in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def with_token_ids(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``key, ids``: the token ids of each row's text, without special tokens.

    Null and empty texts have the empty list. Strings that look like special tokens
    are ordinary text. Repeated rows each come out; ``key`` may be null or repeated.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _pieces(texts):
                ids = enc.encode(texts[start:end])
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["key", "ids"],
                )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def with_token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``key, n_tokens`` of each row's text; 0 for null and empty texts."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            for start, end in _pieces(texts):
                part = pdf[["key"]].iloc[start:end]
                yield part.assign(n_tokens=np.array(enc.count(texts[start:end]), dtype=np.int64))

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return spread(rows).mapInPandas(run, f"key {kind}, n_tokens long").withColumnRenamed("key", key)
