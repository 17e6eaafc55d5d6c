"""Evaluation passages that leak into a corpus.

Method: greedy string tiling. Documents are joined with the passages on shared seeds (runs of `seed` equal words, by a
rolling code over the passages' own vocabulary); of each candidate pair the longest non-overlapping equal runs are
marked again and again (running Karp-Rabin hashes of falling lengths), so reordered passages are covered too. Pairs whose
tiles cover a set share of the passage leaked; so did those whose tiles cover what a window of nearly equal words
must, if a check of aligned windows confirms it. The coverage decides: pairs below both bounds are dropped.

With `window` words of which `same` must be equal in place, a window has at most `window - same` differing words, so
one of the runs between them has at least (same) / (window - same + 1) words: the seed length that misses nothing. Runs
shorter than the shortest tile are lost to the coverage, at most `window - same` of them beside the seed.

The passages are sent to the executors in blocks of bounded size; every block meets every document. With more than one
block the documents are cut into words once and written.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import words
from tessera.runtime import materialise

WINDOW, SAME = 20, 18
#: Words of the shortest tile, and the share of a passage that tiles must cover where no window is nearly equal.
TILE, COVERAGE = 3, 0.75
#: Words of passages that one broadcast block holds at most (about 40 bytes each); a longer passage is a block alone.
BLOCK_WORDS = 400_000
#: Words of documents that are looked up at a time within a task.
SLICE_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def seed_length(window: int = WINDOW, same: int = SAME) -> int:
    return max(1, same // (window - same + 1))


def _codes(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A code for the k word numbers from each position on."""
    c = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            c = (c ^ ids[at + j].astype(np.uint64)) * _MIX
            c ^= c >> np.uint64(29)
    return c


class Passages:
    """A block of passages, numbered over its own vocabulary, with the sorted codes of all its seeds."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int) -> None:
        self.seed = seed
        self.items = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64) for _, ws in items]
        code, item, at = [], [], []
        for n, ids in enumerate(self.ids):
            if len(ids) >= seed:
                a = np.arange(len(ids) - seed + 1)
                code.append(_codes(ids, a, seed))
                item.append(np.full(len(a), n))
                at.append(a)
        self.code = np.concatenate(code) if code else np.zeros(0, np.uint64)
        order = np.argsort(self.code, kind="stable")
        self.code = self.code[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int64)

    def seeds_in(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared seeds as (position in `ids`, passage, position in the passage); -1 stands for foreign words."""
        k = self.seed
        if len(ids) < k or not len(self.code):
            z = np.zeros(0, np.int64)
            return z, z, z
        run = np.concatenate([[0], np.cumsum(ids < 0)])
        here = np.flatnonzero(run[k:] == run[:-k])
        c = _codes(ids, here, k)
        lo, hi = np.searchsorted(self.code, c, "left"), np.searchsorted(self.code, c, "right")
        n = hi - lo
        where = np.repeat(np.arange(len(here)), n)
        entry = np.repeat(lo, n) + np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
        pos, item, at = here[where], self.item[entry], self.at[entry]
        ok = np.array([np.array_equal(self.ids[i][a : a + k], ids[p : p + k]) for p, i, a in zip(pos, item, at)], bool) if len(pos) else np.zeros(0, bool)
        return pos[ok], item[ok], at[ok]


def running_hashes(words: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Karp-Rabin hashes of all runs of each length: a polynomial of the words whose start is divided out as it moves on.

    Arithmetic is modulo 2^64 with an odd base, which has an inverse; equal hashes are compared word by word later.
    """
    n = len(words)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE, np.uint64)])
        mixed = (words.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        sums = np.r_[np.uint64(0), np.cumsum(mixed * up[:n])]
        return {s: (sums[s:] - sums[:-s]) * down[: n - s + 1] for s in lengths if s <= n}


def _free_runs(free: np.ndarray, s: int) -> np.ndarray:
    """Starts of the runs of s that hold no marked word."""
    taken = np.r_[0, np.cumsum(~free)]
    return np.flatnonzero(taken[s:] == taken[:-s])


def tiles(passage: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (position in passage, in text, length) of the longest non-overlapping equal runs.

    Lengths fall from that of the passage by halves down to `shortest`, each searched by running Karp-Rabin hashes over
    the words not marked yet; longer runs found on the way are marked first. Ties go to the earlier position in the
    passage, then in the text. Negative words of the text stand for words that no passage has.
    """
    p_free, t_free = np.ones(len(passage), bool), text >= 0
    out: list[tuple[int, int, int]] = []
    s = min(len(passage), len(text))
    lengths = []
    while s > shortest:
        lengths.append(s)
        s = max(shortest, s // 2)
    lengths.append(shortest)
    p_hash, t_hash = running_hashes(passage, lengths), running_hashes(text, lengths)
    p, t = passage.tolist(), text.tolist()
    for s in lengths:
        if s > min(len(p), len(t)):
            continue
        while True:
            i_free, j_free = _free_runs(p_free, s), _free_runs(t_free, s)
            where = defaultdict(list)
            for i, h in zip(i_free.tolist(), p_hash[s][i_free].tolist()):
                where[h].append(i)
            shared = j_free[np.isin(t_hash[s][j_free], p_hash[s][i_free])]
            found = []
            for j in shared.tolist():
                for i in where.get(int(t_hash[s][j]), ()):
                    if p[i : i + s] != t[j : j + s]:
                        continue
                    if i and j and p_free[i - 1] and t_free[j - 1] and p[i - 1] == t[j - 1]:
                        continue  # part of a run that starts earlier
                    n = s
                    while i + n < len(p) and j + n < len(t) and p_free[i + n] and t_free[j + n] and p[i + n] == t[j + n]:
                        n += 1
                    found.append((-n, i, j))
            again = False
            for n, i, j in sorted(found):
                n = -n
                if p_free[i : i + n].all() and t_free[j : j + n].all():
                    p_free[i : i + n] = False
                    t_free[j : j + n] = False
                    out.append((i, j, n))
                else:
                    again = True  # what is left of it may still be a run
            if not again:
                break
    return out


def aligned(passage: np.ndarray, text: np.ndarray, shift: int, window: int, same: int) -> int:
    """The most equal words in place of any window of the passage laid over the text with this shift."""
    lo, hi = max(0, -shift), min(len(passage), len(text) - shift)
    if hi - lo < window:
        return 0
    eq = np.concatenate([[0], np.cumsum(passage[lo:hi] == text[lo + shift : hi + shift])])
    return int((eq[window:] - eq[:-window]).max())


def least_cover(window: int, same: int, shortest: int) -> int:
    """Words that tiles of at least `shortest` cover in any window with `same` of `window` words equal in place."""
    return max(seed_length(window, same), same - (window - same) * (shortest - 1))


def _leaks(block: Passages, ids: np.ndarray, window: int, same: int, coverage: float, shortest: int) -> Iterator[tuple[int, float, int, int]]:
    """(passage, share covered, tiles, best window) of each passage that leaked into one document."""
    pos, item, at = block.seeds_in(ids)
    for n in np.unique(item):
        mine = item == n
        passage = block.ids[n]
        # stretches of the text that hold seeds, with room for the passage on both sides
        here = np.unique(pos[mine])
        cut = np.flatnonzero(np.diff(here) > 2 * len(passage)) + 1
        covered, n_tiles, best = 0, 0, 0
        for part in np.split(here, cut):
            lo, hi = max(0, part[0] - len(passage)), part[-1] + len(passage) + block.seed
            text = ids[lo:hi]
            marked = tiles(passage, text, shortest)
            total = sum(x for _, _, x in marked)
            if total < min(least_cover(window, same, shortest), coverage * len(passage)):
                continue
            inside = mine & (pos >= part[0]) & (pos <= part[-1])
            equal = max(aligned(passage, text, s, window, same) for s in np.unique(pos[inside] - lo - at[inside]))
            best = max(best, equal)
            if total > covered:
                covered, n_tiles = total, len(marked)
        if best >= same or covered >= max(block.seed, coverage * len(passage)):
            yield n, covered / len(passage), n_tiles, best


_OUT = "doc_id long, item_id long, covered double, n_tiles int, best_window int"


def _matcher(shared, window: int, same: int, coverage: float, shortest: int, cut):
    def run(frames):
        block: Passages = shared.value
        get = block.vocabulary.get

        def flush(docs, flat, ends):
            ids, start = np.array(flat, np.int64), 0
            rows = []
            for d, end in zip(docs, ends):
                part = ids[start:end]
                start = end
                rows += [(d, block.items[n], c, t, b) for n, c, t, b in _leaks(block, part, window, same, coverage, shortest)]
            return pd.DataFrame(rows, columns=["doc_id", "item_id", "covered", "n_tiles", "best_window"])

        for f in frames:
            docs, flat, ends = [], [], []
            for d, t in zip(f["doc_id"], f["text"]):
                ids = [get(w, -1) for w in cut(t)]
                if len(ids) < block.seed:
                    continue
                docs.append(d)
                flat += ids
                ends.append(len(flat))
                if len(flat) >= SLICE_WORDS:
                    yield flush(docs, flat, ends)
                    docs, flat, ends = [], [], []
            if docs:
                yield flush(docs, flat, ends)

    return run


def _cut_words(frames):
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"], "text": [" ".join(words(t)) for t in f["text"]]})


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = WINDOW, same: int = SAME, coverage: float = COVERAGE, shortest: int = TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every (document, item) where a passage leaked.

    documents: `doc_id, text`; items: `item_id, passage`. Result: doc_id, item_id, covered (share of the passage's
    words in tiles), n_tiles and best_window (most equal words of `window` in place). A pair is given if its tiles cover
    `coverage` of the passage, in any order, or if a window has `same` equal words. Null texts and passages, and those
    of fewer words than a seed, give no rows; a passage shorter than the window can leak by its coverage only.
    Repeated items with one id give one row for each passage, which callers may reduce.
    """
    seed = seed_length(window, same)
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    blocks, block, n = [], [], 0
    for r in items.select("item_id", "passage").filter("passage is not null").distinct().orderBy("item_id", "passage").toLocalIterator():
        ws = words(r.passage)
        if len(ws) < seed:
            continue
        if block and n + len(ws) > block_words:
            blocks.append(spark.sparkContext.broadcast(Passages(block, seed)))
            block, n = [], 0
        block.append((r.item_id, ws))
        n += len(ws)
    if block or not blocks:
        blocks.append(spark.sparkContext.broadcast(Passages(block, seed)))
    cut = words
    if len(blocks) > 1:
        docs, cut = materialise(docs.mapInPandas(_cut_words, "doc_id long, text string"), "words"), str.split
    out = None
    for shared in blocks:
        got = docs.mapInPandas(_matcher(shared, window, same, coverage, shortest, cut), _OUT)
        out = got if out is None else out.unionByName(got)
    return out
