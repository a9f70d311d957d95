"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: dynamic programming over prefixes.  For every prefix of a word an automaton gives
the vocabulary entries that end there; the one of them that is compatible with the last
token of the prefix before it is unique and is stored; following these back from the end
gives the very ids that merging pair by pair would give, in time linear in the word.

The vocabulary is a parameter: its file is read on the driver and sent to the executors
(some 0.8 MB, whatever the corpus).  The corpus passes through once, without an exchange,
in Arrow batches; each worker remembers the ids of words it has met, in bounded memory.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public tokenizer splits a text into words (a fixed value of its format).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a worker, and the longest that is.
MEMORY_WORDS, MEMORY_LENGTH = 300_000, 64


class Encoder(dict):
    """Ids of a word; a dictionary that computes what it doesn't hold."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        import ahocorasick

        ranks = {}
        for line in vocabulary.splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.size = {r: len(t) for t, r in ranks.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        # In the order of rank, a token is the join of the two tokens it falls into before it
        # exists; only one pair of earlier tokens can stay side by side till then.
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k], rank), ranks.get(token[k:], rank)
                if a < rank and b < rank and self.compatible(a, b):
                    self.left[rank], self.right[rank], self.joined[a, b] = a, b, rank
                    break
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of a and b, side by side, is encoded as just these two.

        Merges are undone at the boundary, the latest first; the two stay apart unless a
        merge across the boundary would have come before the one undone last.  Equal merges
        run from left to right, so one across the boundary beats an equal one on its right.
        """
        before = None
        while True:
            across = self.joined.get((a, b))
            if across is not None and (before is None or across < before):
                return False
            if a > b and a in self.right:
                before, a = a, self.right[a]
            elif b in self.left:
                before, b = b + 1, self.left[b]
            elif a in self.right:
                before, a = a, self.right[a]
            else:
                return True

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode_word(word)
        if len(word) <= MEMORY_LENGTH:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "surrogatepass").decode("latin-1")
        last = [-1] * (len(data) + 1)
        for end, token in self.automaton.iter(data):
            at = end + 1 - self.size[token]
            if last[end + 1] < 0 and (at == 0 or last[at] >= 0 and self.compatible(last[at], token)):
                last[end + 1] = token
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        return tuple(reversed(ids))


@lru_cache(maxsize=2)
def _worker(vocabulary: bytes) -> tuple[Encoder, object]:
    import regex

    return Encoder(vocabulary), regex.compile(WORDS).findall


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, ids)`` for every row, repeated ones included, without special tokens.

    Null and empty texts give an empty list, blank ones their ids.  Text of special tokens
    is ordinary text.  Whole texts are encoded, however long.  A null key stays null;
    other columns aren't read; no rows give no rows.
    """
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = _worker(shared.value)
        of = encoder.__getitem__
        for batch in batches:
            parts, ends, total = [], [0], 0
            for t in batch.column(1).to_pylist():
                if t:
                    ids = np.fromiter(chain.from_iterable(map(of, words(t))), dtype=np.int32)
                    parts.append(ids)
                    total += len(ids)
                ends.append(total)
            flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "ids"])

    own = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = own.schema["k"].dataType.simpleString()
    return own.mapInArrow(encode, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")
