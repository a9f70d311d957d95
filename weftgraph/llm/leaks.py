"""Evaluation passages inside a training corpus.

Method: greedy string tiling.  Texts become word numbers; shared runs of three words are
the seeds that pair a document with an item.  For each pair the longest matches not yet
covered are marked again and again, found by running Karp-Rabin over ever shorter runs;
the tiles are then chained, and a chain counts if it covers enough of the passage.

The items are a stated set that does not grow with the corpus; they are taken in blocks
of checked size, and the corpus passes by each block once, without an exchange: a document
is normalised, seeded, tiled and judged in one Arrow batch, so whole texts never move.
A document's work is bounded by its own length, whatever the number of its copies.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of a seed, and of the shortest tile.
SEED, TILE = 3, 2
#: Items of one block, some 60 words each: a few MB on every worker.
BLOCK_ITEMS = 20_000

_TAGS = re.compile(r"<[a-zA-Z/!][^<>]{0,300}>")
_HYPHENS = re.compile(r"(?<=\w)[-‐‑]\s*[\r\n]+[ \t>*|#/]*(?=\w)|[­​-‍⁠﻿]")
_ESCAPES = re.compile(r"\\[nrt]|\\u00a0")
_WORDS = re.compile(r"[^\W_]+")
_PLAIN = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}
_BROKEN = ("-\n", "-\r", "- \n", "- \r")


def words(text: str) -> list[str]:
    """Words without regard to letter case, punctuation, line breaks, hyphenation and markup."""
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAGS.sub("", text)
    if "\\" in text:
        text = _ESCAPES.sub(" ", text)
    if not plain or any(x in text for x in _BROKEN):
        text = _HYPHENS.sub("", text)
    return text.translate(_PLAIN).split() if plain else _WORDS.findall(text.casefold())


class Items:
    """The passages as word numbers, and where each of their seeds stands."""

    def __init__(self, passages: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.texts: list[tuple[int, np.ndarray]] = []
        seeds, at = [], []
        for key, text in passages:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int64)
            seeds.append(seed_hashes(ids))
            at.append(np.full(len(seeds[-1]), len(self.texts)))
            self.texts.append((key, ids))
        flat, item = (np.concatenate(seeds), np.concatenate(at)) if seeds else (np.empty(0, np.uint64), np.empty(0, np.int64))
        order = np.lexsort((item, flat))
        flat, item = flat[order], item[order]
        fresh = np.ones(len(flat), dtype=bool)
        fresh[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1])
        self.seeds, self.of = flat[fresh], item[fresh]


def _mixed(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def running_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all runs of ``length`` words."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        base, out, x = np.uint64(0x100000001B3), np.zeros(n, dtype=np.uint64), _mixed(ids)
        for k in range(length):
            out = out * base + x[k : k + n]
    return out


def seeds_at(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes of the runs of three words that start at these places only."""
    with np.errstate(over="ignore"):
        base, out = np.uint64(0x100000001B3), np.zeros(len(at), dtype=np.uint64)
        for k in range(SEED):
            out = out * base + _mixed(ids[at + k])
    return out


def seed_hashes(ids: np.ndarray) -> np.ndarray:
    return running_hashes(ids, SEED)


def tiles(a: np.ndarray, b: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two runs of word numbers: ``(start in a, start in b, length)``.

    In each round the runs of one length that are in both and not yet covered are found by
    their hashes and grown as far as they go; the longest are marked first, those that
    overlap a mark are left for a later round.  The length is then halved.  Numbers of 0 or
    less match nothing.
    """
    free_a, free_b = a > 0, b > 0
    out: list[tuple[int, int, int]] = []
    length = 16
    while True:
        found: dict[tuple[int, int], int] = {}
        open_a = _open(free_a, length)
        open_b = _open(free_b, length)
        if open_a.any() and open_b.any():
            where: dict[int, list[int]] = {}
            ha, hb = running_hashes(a, length), running_hashes(b, length)
            for i in np.flatnonzero(open_a).tolist():
                where.setdefault(int(ha[i]), []).append(i)
            for j in np.flatnonzero(open_b).tolist():
                for i in where.get(int(hb[j]), ()):
                    if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                        continue  # part of a longer match
                    n = 0
                    while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                        n += 1
                    if n >= length:
                        found[i, j] = n
        for (i, j), n in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = False
                free_b[j : j + n] = False
                out.append((i, j, n))
        if length == least:
            return sorted(out)
        length = max(least, length // 2)


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Where a run of ``length`` free words starts."""
    if len(free) < length:
        return np.zeros(0, dtype=bool)
    total = np.concatenate([[0], np.cumsum(free)])
    return total[length:] - total[:-length] == length


def _common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence of two short gaps."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            here = row[k]
            row[k] = before + 1 if x == y and x > 0 else max(row[k], row[k - 1])
            before = here
    return row[-1]


def longest_quote(a: np.ndarray, b: np.ndarray, altered: float) -> int:
    """Words of the longest run of ``a`` that ``b`` holds with at most that share altered.

    The run begins and ends with a tile; words within that are changed, missing or added
    count as altered.
    """
    found = tiles(a, b)
    best = max((n for _, _, n in found), default=0)
    for x, (i, j, n) in enumerate(found):
        same, end_a, end_b = n, i + n, j + n
        for i2, j2, n2 in found[x + 1 :]:
            gap_a, gap_b = i2 - end_a, j2 - end_b
            if not (0 <= gap_b and gap_a <= 12 and gap_b <= 12):
                continue
            same += n2 + (_common(a[end_a:i2].tolist(), b[end_b:j2].tolist()) if gap_a and gap_b else 0)
            end_a, end_b = i2 + n2, j2 + n2
            whole = max(end_a - i, end_b - j)
            if whole - same <= altered * (end_a - i) + 1e-9:
                best = max(best, end_a - i)
    return best


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    passage: str = "passage",
    least_words: int = 12,
    altered: float = 1 / 7,
    least_seeds: int = 6,
) -> DataFrame:
    """``(key, item_key, words, coverage)`` of every document that leaks an item.

    With these numbers a leak has six seeds at least (one altered word in twelve leaves two
    runs with nine, two in fourteen leave three with six), so no leak is lost to them.
    words is the longest run of the passage that the document holds with at most ``altered``
    of its words changed, coverage the share of the passage under tiles of three words or
    more, wherever they stand.  Documents and items with null key or text, and passages of
    fewer than ``least_words`` words, give nothing; repeated rows give repeated results;
    every copy of a text is reported.  Other columns aren't read.
    """
    spark = documents.sparkSession
    own = documents.select(key, text).where(f"`{key}` is not null and length(`{text}`) > 0")
    stated = items.select(item_key, passage).where(f"`{item_key}` is not null and `{passage}` is not null").distinct()
    schema = f"`{key}` {own.schema[key].dataType.simpleString()}, `{item_key}` {stated.schema[item_key].dataType.simpleString()}, words int, coverage double"

    result = None
    block: list[tuple[int, str]] = []
    for row in stated.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK_ITEMS:
            part = _against(own, spark.sparkContext.broadcast(block), schema, least_words, altered, least_seeds)
            result, block = part if result is None else result.unionByName(part), []
    if block or result is None:
        part = _against(own, spark.sparkContext.broadcast(block), schema, least_words, altered, least_seeds)
        result = part if result is None else result.unionByName(part)
    return result


def _against(own: DataFrame, shared, schema: str, least_words: int, altered: float, least_seeds: int) -> DataFrame:
    names = [x.split("`")[1] for x in schema.split(", ")[:2]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([x for x in shared.value if len(words(x[1])) >= least_words])
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in leaks_of(t, items, least_words, altered, least_seeds)]
            if rows:
                d, i, w, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, batch.column(0).type), pa.array(i), pa.array(w, pa.int32()), pa.array(c, pa.float64())], names=[*names, "words", "coverage"])

    return own.mapInArrow(scan, schema)


def _windows(ids: np.ndarray, start: int, end: int, step: int) -> Iterator[np.ndarray]:
    """A stretch as it is, or in overlapping windows if it is long; every quote lies in one of them."""
    if end - start <= 3 * step:
        yield ids[start:end]
        return
    for at in range(start, max(start + 1, end - step), step):
        yield ids[at : min(end, at + 2 * step)]


def leaks_of(text: str, items: Items, least_words: int, altered: float, least_seeds: int) -> list[tuple[int, int, float]]:
    found = words(text)
    if len(found) < SEED or not len(items.seeds):
        return []
    ids = np.fromiter(map(items.vocabulary.get, found, repeat(0)), dtype=np.int64, count=len(found))
    known = ids > 0
    at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    if len(at) < least_seeds:
        return []
    hashes = seeds_at(ids, at)
    low, high = np.searchsorted(items.seeds, hashes), np.searchsorted(items.seeds, hashes, side="right")
    hit = high > low
    if hit.sum() < least_seeds:
        return []
    at, low, high = at[hit], low[hit], high[hit]
    counts = high - low
    of = items.of[np.concatenate([np.arange(x, y) for x, y in zip(low, high, strict=True)])]
    places = np.repeat(at, counts)
    out = []
    for item in np.flatnonzero(np.bincount(of) >= least_seeds).tolist():
        key, passage = items.texts[item]
        spots = np.sort(places[of == item])
        # stretches of the text whose seeds are no further apart than the passage is long
        cuts = np.flatnonzero(np.diff(spots) > len(passage)) + 1
        best, cover = 0, 0.0
        for part in np.split(spots, cuts):
            if len(part) < least_seeds:
                continue
            for stretch in _windows(ids, max(0, part[0] - 12), min(len(ids), part[-1] + SEED + 12), 2 * len(passage)):
                best = max(best, longest_quote(passage, stretch, altered))
                if best >= least_words:
                    cover = max(cover, sum(n for _, _, n in tiles(passage, stretch) if n >= SEED) / len(passage))
                if best >= len(passage):
                    break
        if best >= least_words:
            out.append((key, best, cover))
    return out
