"""Splitting oversized items at natural boundaries.

Method: one regular expression with bounded quantifiers cuts the text.  Its alternatives
are ordered by the strength of the boundary (paragraph, line, sentence, word, any
character); each consumes as much as the limit allows.  The overlap is looked back from
the cut pieces with SQL array functions, in time linear in the text.  All of it runs in the
JVM, row by row; only ``cut_items`` exchanges the oversized texts, once, to drop repeated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of a piece, the strongest first; each is a look-around that consumes nothing.
PARAGRAPH = r"(?<=(?:\n|\r\n|\r)[ \t]{0,20}(?:\n|\r\n|\r(?!\n)))"
LINE = r"(?<=\n|\r(?!\n))"
SENTENCE = r"(?:(?<=[.!?…][\"'”’»)\]]{0,3}[\s ])|(?<=[。！？]))"
WORD = r"(?<=[\s 　])"


def piece_pattern(limit: int, overlap: int) -> str:
    """The first match may take ``limit`` characters, a later one leaves room for the overlap."""

    def one(most: int) -> str:
        least = max(1, most // 2)
        strong = [f".{{{least},{most}}}{end}" for end in (PARAGRAPH, LINE, SENTENCE, WORD)]
        return "|".join([f".{{1,{most}}}\\z", *strong, f".{{1,{least}}}(?:{WORD}|{SENTENCE})", f".{{1,{most}}}"])

    return f"(?s)\\A(?:{one(limit)})|(?:{one(limit - overlap)})"


def pieces(text: Column, limit: int = 2000, overlap: int = 200) -> Column:
    """Array of pieces, empty for null or empty text.

    Each has at most ``limit`` Unicode code points, and each after the first starts with
    the last ``overlap`` characters (or all, if it has fewer) of the piece before it.
    Without those, the pieces joined are the text.  A boundary in the second half of the
    room is preferred by strength; else a word or sentence end in the first half counts; else the
    piece is full.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    cut = F.regexp_extract_all(text, F.lit(piece_pattern(limit, overlap)), F.lit(0))
    cut = F.coalesce(cut, F.array().cast("array<string>"))

    def join(parts: Column) -> Column:
        # what stands before a part; as a rule one part is enough for the overlap, else as many as it has characters
        several = lambda i: F.array_join(F.slice(parts, F.greatest(F.lit(1), i - overlap + 1), F.least(i, F.lit(overlap))), "")
        before = lambda i: F.when(F.length(F.get(parts, i - 1)) >= overlap, F.get(parts, i - 1)).otherwise(several(i))
        return F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.right(before(i), F.lit(overlap)), part)))

    # in an array of its own the cut is a variable, made once and not for each part
    joined = F.get(F.transform(F.array(cut), join), F.lit(0)) if overlap else cut
    return F.when(F.length(text) <= limit, F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))).otherwise(joined)


def cut_items(items: DataFrame, keys: Sequence[str], text: str = "text", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``(*keys, ordinal, n_pieces, text)`` of every item over ``limit``, ordinal from 0.

    Items of at most ``limit`` characters, null and empty texts have no rows.  Equal rows
    (same keys and text) count once; different texts under one key are cut each.  Columns
    beside keys and text aren't read; an empty table gives no rows.
    """
    own = items.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    own = own.where(F.length("t") > limit).distinct()
    cut = own.select(*[c for c in own.columns if c != "t"], pieces(F.col("t"), limit, overlap).alias("p"))
    rows = cut.select(*[c for c in cut.columns if c != "p"], F.size("p").alias("n_pieces"), F.posexplode("p").alias("ordinal", "text"))
    return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "ordinal", "n_pieces", "text")
