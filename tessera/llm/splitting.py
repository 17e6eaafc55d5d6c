"""Splitting oversized items at natural boundaries.

Method: content-defined chunking. A rolling hash over the last characters marks landmarks that depend on nothing but
the text around them; after a least size, the first landmark is taken and snapped to the nearest natural boundary of
the best kind in reach (a session marker, a blank line or fence, a line end, a sentence end, a space). So an edit moves
the cuts next to it only: the cuts fall in step again at the next landmarks. Where there is no landmark or boundary
within the largest size, the cut is made at that size.

A token is 3.5 characters (code points), rounded up over the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 1024, 64, 3.5
#: Characters that the rolling hash sees, and the share of positions that are landmarks.
HASH_CHARS, LANDMARK_EVERY = 32, 256
#: A boundary is looked for within so many characters of a landmark, the better kinds further off.
REACH = (900, 600, 300, 200, 80)
_KINDS = (
    re.compile(r"(?<=\n)(?=\[(?:User|Assistant|Thinking|Tool:[^\]\n]*|Result:[^\]\n]*)\])"),
    re.compile(r"(?<=\n)(?=[ \t]*\r?\n)|(?:(?<=\n\n)|(?<=\n\r\n))(?=\S)|(?<=\n)(?=```)|(?<=```\n)"),
    re.compile(r"(?<=\n)(?=[^\n])"),
    re.compile(r"(?<=[.!?] )(?=\S)"),
    re.compile(r"(?<=\s)(?=\S)"),
)
NAMES = ("marker", "paragraph", "line", "sentence", "word", "hard", "end")


def max_chars(tokens: int) -> int:
    """The most characters that count as `tokens` tokens."""
    return int(tokens * CHARS_PER_TOKEN)


def landmarks(text: str) -> np.ndarray:
    """Positions after which a cut may be made: the hash of the characters before them hits the mask."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < HASH_CHARS:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        c = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        c ^= c >> np.uint64(31)
        h = np.zeros(len(c) - HASH_CHARS + 1, np.uint64)
        for j in range(HASH_CHARS):
            h = h * np.uint64(0x100000001B3) + c[j : j + len(h)]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return np.flatnonzero((h >> np.uint64(40)) % np.uint64(LANDMARK_EVERY) == 0) + HASH_CHARS


def cut_points(text: str, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, str]]:
    """The ends of the pieces with the kind of boundary at each; the last is the end of the text."""
    whole, again = max_chars(limit), max_chars(overlap)
    if len(text) <= whole:
        return [(len(text), "end")]
    marks = landmarks(text)
    kinds = [np.array([m.start() for m in k.finditer(text)], np.int64) for k in _KINDS]
    out, start = [], 0
    while True:
        largest = whole - (again if out else 0)
        least = max(1, largest // 3)
        if len(text) - start <= largest:
            out.append((len(text), "end"))
            return out
        lo, hi = start + least, start + largest
        i = np.searchsorted(marks, lo)
        mark = int(marks[i]) if i < len(marks) and marks[i] <= hi else hi
        cut, kind = mark, "hard"
        for name, at, reach in zip(NAMES, kinds, REACH):
            a, b = np.searchsorted(at, max(lo, mark - reach)), np.searchsorted(at, min(hi, mark + reach), "right")
            if a < b:
                near = at[a:b]
                cut, kind = int(near[np.argmin(np.abs(near - mark))]), name
                break
        if kind == "hard" and text[cut - 1 : cut + 1] == "\r\n" and cut - 1 > start:
            cut -= 1
        out.append((cut, kind))
        start = cut


_PIECES = "chunk_id string, piece int, start_char int, end_char int, overlap_chars int, n_tokens int, boundary string, content string, turn_indices array<int>"


def _split(limit: int, overlap: int):
    again = max_chars(overlap)

    def run(frames):
        for f in frames:
            rows = []
            for key, text, turns in zip(f["chunk_id"], f["content"], f["turn_indices"]):
                start = 0
                for n, (end, kind) in enumerate(cut_points(text, limit, overlap)):
                    back = min(again, start)
                    part = text[start - back : end]
                    rows.append((key, n, start - back, end, back, -int(-len(part) // CHARS_PER_TOKEN), kind, part, turns))
                    start = end
            yield pd.DataFrame(rows, columns=["chunk_id", "piece", "start_char", "end_char", "overlap_chars", "n_tokens", "boundary", "content", "turn_indices"])

    return run


def split_oversized(items: DataFrame, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """All items as pieces of at most `limit` tokens, each after the first starting with the last `overlap` tokens of
    the one before.

    items: `chunk_id, content, turn_indices`. Result: chunk_id, piece (from 0), start_char and end_char in the content
    (the overlap included), overlap_chars, n_tokens, boundary (the kind of cut at its end), content, turn_indices as
    stored. Items within the limit are one piece and never leave the JVM; null content gives one piece of 0 tokens.
    `overlap` must be smaller than half of `limit`. Repeated items are split row by row.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be less than half of the limit")
    size = F.length("content")
    src = items.select(F.col("chunk_id").cast("string").alias("chunk_id"), "content", F.col("turn_indices").cast("array<int>").alias("turn_indices"))
    small = src.filter(size.isNull() | (size <= max_chars(limit))).select(
        "chunk_id", F.lit(0).alias("piece"), F.lit(0).alias("start_char"), F.coalesce(size, F.lit(0)).alias("end_char"), F.lit(0).alias("overlap_chars"),
        F.ceil(F.coalesce(size, F.lit(0)) / CHARS_PER_TOKEN).cast("int").alias("n_tokens"), F.lit("end").alias("boundary"), "content", "turn_indices",
    )
    large = src.filter(size > max_chars(limit)).mapInPandas(_split(limit, overlap), _PIECES)
    return small.unionByName(large)
