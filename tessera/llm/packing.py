"""Filling fixed-capacity containers with items.

Method: planning over the histogram of lengths. The number of items of each length (at most `capacity` numbers) is all
that the driver sees; best fit over these counts gives container patterns with how often each is used. Items then take
the planned slots by their rank within their length. Ranks come from partition-wise counts and offsets, so no length,
however common, is gathered in one task.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import rank_within
from tessera.runtime import materialise

TOKENIZER_DIR = "/opt/tokenizers"
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: The published pattern that goes with these ranks (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a ranks file, loaded once per worker process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_lengths(documents: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and n_tokens of each document; null and empty texts have 0 tokens."""

    def run(frames):
        enc = encoder(ranks_path)
        for f in frames:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_tokens": np.array(n, np.int64)})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Container patterns for a histogram of lengths (1 to capacity): (containers, [(length, pieces of it), ...]).

    Best fit decreasing over counts: lengths are taken from the largest down, and the pieces of a length go to the
    fullest containers that still take one; where none does, new ones are opened. Containers with the same content are
    one pattern with a number, and all its containers are filled at once, each with as many pieces as fit (the container
    that has just taken one is then the fullest). A length ends some patterns and divides at most one, so the number of
    patterns depends on the number of lengths, not on the counts.
    """
    # patterns still open, by free room; rooms in rising order
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def keep(room: int, times: int, pattern: list[tuple[int, int]]) -> None:
        if not room:
            done.append((times, pattern))
            return
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = []
        by_room[room].append((times, pattern))

    for n in sorted((n for n, c in counts.items() if c > 0 and n > 0), reverse=True):
        left = counts[n]
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                room, times, pattern = capacity, -(-left // (capacity // n)), []
            else:
                room = rooms[i]
                times, pattern = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
            k = min(room // n, left)
            full = min(times, left // k)
            keep(room - k * n, full, [*pattern, (n, k)])
            left -= full * k
            if full < times:
                if left:  # fewer than k are left: one more container takes them
                    keep(room - left * n, 1, [*pattern, (n, left)])
                    full, left = full + 1, 0
                if pattern and full < times:
                    keep(room, times - full, pattern)
    for room in rooms:
        done += by_room[room]
    return done


class Slots:
    """The planned slots of every length as runs of ranks: a run is one pattern's pieces of that length."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        container = 0
        for times, pieces in patterns:
            at = 0
            for n, k in pieces:
                runs.setdefault(n, []).append((times * k, container, k, at))
                at += k
            container += times
        self.containers = container
        self.runs = {n: (np.cumsum([0] + [r[0] for r in rs])[:-1], *(np.array([r[i] for r in rs], np.int64) for i in (1, 2, 3))) for n, rs in runs.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and position in it for the items of these lengths and zero-based ranks within their length."""
        container, position = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            start, first, per, at = self.runs[int(n)]
            run = np.searchsorted(start, ranks[mine], "right") - 1
            k = ranks[mine] - start[run]
            container[mine] = first[run] + k // per[run]
            position[mine] = at[run] + k % per[run]
        return container, position


def measured(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id and n_tokens of each document, written once."""
    return materialise(token_lengths(documents, os.path.join(tokenizer_dir, RANKS_FILE)), "tokens")


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer_dir: str = TOKENIZER_DIR, sized: DataFrame | None = None) -> DataFrame:
    """Container and position of each document or piece.

    Result: container, position, doc_id, piece, first_token, n_tokens. A text of more than `capacity` tokens is cut
    into pieces of `capacity` and a rest; no other text is cut. Null and empty texts have no tokens and take no room:
    container and position are null. Repeated doc_ids are packed row by row. `sized`: what `measured` gave for these
    documents, where it is there already.
    """
    sized = sized if sized is not None else measured(documents, tokenizer_dir)
    full = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int")))
    pieces = sized.filter("n_tokens > 0").select("doc_id", F.explode(full).alias("piece"), "n_tokens")
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece").cast("long") * capacity).alias("n"))
    histogram = {r.n: r["count"] for r in pieces.groupBy("n").count().collect()}  # at most `capacity` rows
    slots = documents.sparkSession.sparkContext.broadcast(Slots(plan(histogram, capacity)))

    def place(frames):
        for f in frames:
            c, p = slots.value.place(f["n"].to_numpy(), f["rank"].to_numpy())
            yield pd.DataFrame({"container": c, "position": p, "doc_id": f["doc_id"], "piece": f["piece"], "first_token": f["first_token"], "n_tokens": f["n"]})

    ranked = rank_within(pieces, ["n"], ["doc_id", "piece"])
    placed = ranked.select("doc_id", "piece", "first_token", "n", "rank").mapInPandas(place, "container long, position long, doc_id long, piece int, first_token long, n_tokens long")
    none = F.lit(None).cast("long")
    empty = sized.filter("n_tokens = 0").select(none.alias("container"), none.alias("position"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "n_tokens")
    return placed.unionByName(empty)
