"""An inverted multi-index over vectors: the most similar vectors of every vector, and links above a similarity.

Method: vectors are scaled to unit length and cut into two halves, each quantised by a codebook of its own; a cell is a
pair of codewords. A query takes the cells in the order of summed distance, from a priority queue over the rows of cells
(the next cell of each first codeword), and compares itself with their entries by exact cosine.

How far a query goes depends on what it finds, not on a cap. It first visits cells that hold `first` entries, then goes
on to twice as many. If the second half gave nothing that belongs to its result, it is settled; otherwise it is compared
with every entry of its model. So the work of most queries does not grow with the collection, while queries in a large
group of similar vectors, or without any near neighbour, are answered exactly. What may be lost is a neighbour beyond
the cells of both visits of a query that looked settled; `first=None` compares everything with everything.

Cells are put into blocks of bounded size, and so are the queries that come to a block, by their real number; a cell
that alone exceeds a block is cut by the hash of the id. An entry is copied once for each part of the queries of its
block, of which there are few whatever the size of the collection, and a query once for each block that it visits. Equal
vectors are searched once, as a class with its smallest ids. Codebooks are fitted on a bounded sample per model; every
vector is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.operators.deliveries import first_deliveries, with_row_identity
from tessera.runtime import broadcast_if_small, key_of, materialise

#: Vectors per model that the codebooks are fitted on at most, entries per cell aimed at, and codewords at most (with more
#: than about ten million vectors of a model cells grow instead).
SAMPLE, PER_CELL, MOST_WORDS = 40_000, 12, 1024
#: Entries that the first visit of a query covers at least.
FIRST = 2048
#: Entries, and queries, of one task at most (on average of a random split).
BLOCK, PART = 32_000, 24_000
DIGITS = 6
#: Added to bounds, above the errors of floating point and of rounding to DIGITS.
SLACK = 2e-6
#: Bits for the place of an id within a block, which must hold fewer than LAST rows.
PLACE_BITS = 20
LAST = (1 << PLACE_BITS) - 1
#: Hits that a kernel holds (8 bytes each) before it keeps the best of them only.
MOST_HELD = 4_000_000
#: Queries whose cells are taken from the queue at a time.
AT_ONCE = 2048


def usable_vectors(scan: DataFrame) -> DataFrame:
    """The usable rows of a vectors table, once per model and id: model, id, v (the float32 numbers as bytes).

    Usable: a model key and id, the model's length (its most common one, ties to the larger), only finite numbers and
    not all zero.
    """
    rows = with_row_identity(scan).withColumn("model", key_of("model_id")).withColumn("vid", key_of("id")).filter("model is not null and vid is not null and embedding is not null")
    sizes = rows.groupBy("model", F.size("embedding").alias("n")).count()
    length = sizes.groupBy("model").agg(F.max_by("n", F.struct("count", "n")).alias("length"))
    fit = rows.join(broadcast_if_small(materialise(length, "lengths"), 1 << 20), "model").filter(F.size("embedding") == F.col("length"))

    def pack(frames):
        for f in frames:
            v = [np.array(e, np.float32) for e in f["embedding"]]  # null numbers become NaN
            ok = np.array([bool(np.isfinite(x).all() and x.any()) for x in v], bool)
            yield pd.DataFrame({"model": f["model"][ok], "id": f["vid"][ok], "_file": f["_file"][ok], "_number": f["_number"][ok], "v": [x.tobytes() for x, o in zip(v, ok) if o]})

    packed = fit.select("model", "vid", "embedding", "_file", "_number").mapInPandas(pack, "model string, id string, _file string, _number long, v binary")
    return first_deliveries(materialise(packed, "packed"), F.concat("model", F.lit("\x1f"), "id"), "_number").select("model", "id", "v")


def classes(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Collapse equal vectors: entries (model, rep, ids, v) with the `keep` smallest ids, and members (model, rep, id)
    of the classes of more than one."""
    digest = F.struct(F.xxhash64("v"), F.crc32("v"), F.length("v"))
    rows = vectors.withColumn("d", digest)
    many = rows.groupBy("model", "d").agg(F.count("*").alias("n"), F.min("id").alias("rep")).filter("n > 1").drop("n")
    many = broadcast_if_small(materialise(many, "copies"), 8 << 20)
    copies = materialise(rows.join(many, ["model", "d"]).select("model", "rep", "id"), "members")
    salted = copies.groupBy("model", "rep", F.pmod(F.xxhash64("id"), F.lit(256)).alias("s")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    lowest = salted.groupBy("model", "rep").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    lowest = broadcast_if_small(materialise(lowest, "lowest"), 8 << 20)
    others = broadcast_if_small(materialise(copies.filter("id <> rep").select("model", "id"), "others"), 8 << 20)
    entries = vectors.join(others, ["model", "id"], "left_anti").withColumnRenamed("id", "rep")
    entries = entries.join(lowest, ["model", "rep"], "left").select("model", "rep", F.coalesce("ids", F.array("rep")).alias("ids"), "v")
    return entries, copies


def _unit(v: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(v), np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (words * words).sum(1) - 2 * (x @ words.T)


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means by Lloyd's rounds from a seeded start; words that lose all their points are drawn anew."""
    r = np.random.default_rng(seed)
    words = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, words).argmin(1)
        sums, n = np.zeros_like(words), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
        words[n == 0] = x[r.choice(len(x), int((n == 0).sum()))]
    return words


@dataclass
class Codebooks:
    """The two codebooks of one model and, once counted, the entries of each cell and the blocks of cells."""

    dim: int
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None
    #: The block of each cell (numbered first word * words + second word), and per block into how many parts it is cut.
    block: np.ndarray | None = None
    parts: list[int] = field(default_factory=list)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.dim // 2
        return _distances(x[:, :h], self.first), _distances(x[:, h:], self.second)

    def make_blocks(self, size: int) -> None:
        """Put successive cells into blocks of at most `size` entries; a larger cell is a block of its own, cut into parts."""
        counts = self.counts.ravel()
        self.block, self.parts, held = np.zeros(len(counts), np.int32), [], size + 1
        for c in np.flatnonzero(counts):
            n = int(counts[c])
            if held + n > size:
                self.parts.append(max(1, -(-n // size)))
                held = 0
            held += n
            self.block[c] = len(self.parts) - 1

    def traverse(self, d1: np.ndarray, d2: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, entries taken before it) of the filled cells that each query takes, in the order of summed
        distance, until they hold `enough`.

        The priority queue of a query holds the next cell of every row (first codeword), rows being sorted lists by second
        codeword; the queues of all queries are advanced together.
        """
        n, counts, words = len(d1), self.counts.ravel(), d2.shape[1]
        order = np.argsort(d2, axis=1, kind="stable")
        rising = np.concatenate([np.take_along_axis(d2, order, 1), np.full((n, 1), np.inf)], axis=1)
        queue, at = d1 + rising[:, :1], np.zeros(d1.shape, np.int64)
        who, have = np.arange(n), np.zeros(n, np.int64)
        out: list[tuple] = []
        while len(who):
            k = np.arange(len(who))
            row = queue.argmin(1)
            going = np.isfinite(queue[k, row]) & (have < enough)
            if going.sum() < 0.7 * len(who):  # those that have enough leave
                d1, order, rising, queue, at, who, have = (x[going] for x in (d1, order, rising, queue, at, who, have))
                continue
            j = at[k, row]
            cell = row * words + order[k, np.minimum(j, words - 1)]
            size = np.where(going, counts[cell], 0)
            full = size > 0
            out.append((who[full], cell[full], have[full]))
            have += size
            at[k, row] = j + going
            queue[k, row] = np.where(going, d1[k, row] + rising[k, np.minimum(j + 1, words)], np.inf)
            if not going.any():
                break
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def fit(entries: DataFrame, sample: int = SAMPLE, per_cell: int = PER_CELL) -> dict[str, Codebooks]:
    """Codebooks per model (models are few), from the `sample` vectors with the smallest hash of their id."""
    sizes = {r.model: r["count"] for r in entries.groupBy("model").count().collect()}
    out = {}
    for model, n in sorted(sizes.items()):
        rows = entries.filter(F.col("model") == model)
        if n > 2 * sample:  # a hash range that holds the sample, instead of a sort of everything
            rows = rows.filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(2e6 * sample / n))
        got = [bytes(r.v) for r in rows.orderBy(F.xxhash64("rep")).limit(sample).select("v").collect()]
        dim = len(got[0]) // 4
        x = _unit(got, dim)
        k = int(min(MOST_WORDS, len(x), max(1, round((n / per_cell) ** 0.5))))
        h = dim // 2
        out[model] = Codebooks(dim, fit_codebook(x[:, :h], k), fit_codebook(x[:, h:], k, seed=8))
    return out


def index(entries: DataFrame, books: dict[str, Codebooks], block: int = BLOCK) -> tuple[DataFrame, dict[str, Codebooks]]:
    """Entries with their cell (c1, c2), written once; the books with the counts and blocks of their cells (at most words
    squared)."""
    shared = entries.sparkSession.sparkContext.broadcast(books)

    def assign(frames):
        for f in frames:
            c1, c2 = np.zeros(len(f), np.int32), np.zeros(len(f), np.int32)
            for model, at in f.groupby("model", sort=False).indices.items():
                book = shared.value[model]
                d1, d2 = book.halves(_unit([f["v"].iat[i] for i in at], book.dim))
                c1[at], c2[at] = d1.argmin(1), d2.argmin(1)
            yield pd.DataFrame({"model": f["model"], "rep": f["rep"], "ids": f["ids"], "v": f["v"], "c1": c1, "c2": c2})

    placed = materialise(entries.mapInPandas(assign, "model string, rep string, ids array<string>, v binary, c1 int, c2 int"), "index")
    for b in books.values():
        b.counts = np.zeros((len(b.first), len(b.second)), np.int64)
    for r in placed.groupBy("model", "c1", "c2").agg(F.count("*").alias("n")).collect():
        books[r.model].counts[r.c1, r.c2] = r.n
    for b in books.values():
        b.make_blocks(block)
    return placed, books


_VISITS = "array<struct<block: int, cells: array<int>>>"


def visits(placed: DataFrame, books: dict[str, Codebooks], first: int) -> DataFrame:
    """Per query (model, rep, v) what it visits `first` and `then`: blocks, each with the cells to look at there."""
    shared = placed.sparkSession.sparkContext.broadcast(books)
    item = pa.struct([("block", pa.int32()), ("cells", pa.list_(pa.int32()))])

    def nested(q, cell, block, n):
        o = np.lexsort((cell, block, q))
        q, cell, block = q[o], cell[o], block[o]
        new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (block[1:] != block[:-1])]) if len(q) else np.zeros(0, np.int64)
        inner = pa.ListArray.from_arrays(pa.array(np.r_[new, len(q)].astype(np.int32)), pa.array(cell.astype(np.int32)))
        pairs = pa.StructArray.from_arrays([pa.array(block[new].astype(np.int32)), inner], fields=list(item))
        ends = np.r_[0, np.cumsum(np.bincount(q[new], minlength=n))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pairs)

    def run(batches):
        for b in batches:
            models = np.array(b.column("model").to_pylist(), object)
            for m in dict.fromkeys(models.tolist()):
                at = np.flatnonzero(models == m)
                book = shared.value[m]
                for lo in range(0, len(at), AT_ONCE):
                    rows = b.take(pa.array(at[lo : lo + AT_ONCE]))
                    d1, d2 = book.halves(_unit(rows.column("v").to_pylist(), book.dim))
                    q, cell, before = book.traverse(d1, d2, 2 * first)
                    early = before < first
                    n = rows.num_rows
                    cols = {c: rows.column(c) for c in ("model", "rep", "v")}
                    yield pa.RecordBatch.from_pydict(cols | {"first": nested(q[early], cell[early], book.block[cell[early]], n), "then": nested(q[~early], cell[~early], book.block[cell[~early]], n)})

    return materialise(placed.select("model", "rep", "v").mapInArrow(run, f"model string, rep string, v binary, first {_VISITS}, then {_VISITS}"), "visits")


def meet(placed: DataFrame, books: dict[str, Codebooks], asked: DataFrame, kernel, schema: str, part: int = PART) -> DataFrame:
    """Bring queries (model, rep, v, block, cells; null cells are all of the block) together with the entries of their
    blocks and run `kernel(queries, entries, dim)`.

    The queries of a block are cut into parts of at most `part` by their real number, the entries of a cut block into its
    parts, both by the hash of the id; kernels then see parts of a block.
    """
    spark = placed.sparkSession
    number = asked.groupBy("model", "block").agg(F.count("*").alias("n"))
    cuts = spark.createDataFrame([(m, i, n) for m, b in books.items() for i, n in enumerate(b.parts)], "model string, block int, eb int")
    plan = number.join(F.broadcast(cuts), ["model", "block"]).select("model", "block", "eb", F.ceil(F.col("n") / part).cast("int").alias("qb"))
    plan = F.broadcast(materialise(plan, "plan"))  # a row a block
    cells = [(m, int(c // b.counts.shape[1]), int(c % b.counts.shape[1]), int(b.block[c])) for m, b in books.items() for c in np.flatnonzero(b.counts.ravel())]
    cells = spark.createDataFrame(pd.DataFrame(cells, columns=["model", "c1", "c2", "block"]), "model string, c1 int, c2 int, block int")
    home = F.broadcast(cells)  # a row a cell: at most words squared
    words = F.create_map(*[F.lit(x) for m, b in books.items() for x in (m, len(b.second))])[F.col("model")]
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(plan, ["model", "block"]).select("model", "block", spot("qb").alias("q"), every("eb").alias("e"), F.col("rep").alias("rep"), F.col("v").alias("v"), "cells")
    q = q.toDF(*q.columns)
    e = placed.join(home, ["model", "c1", "c2"]).join(plan, ["model", "block"]).select("model", "block", spot("eb").alias("e"), every("qb").alias("q"), "rep", "ids", "v", (F.col("c1") * words + F.col("c2")).alias("cell"))
    dims = {m: b.dim for m, b in books.items()}
    kinds = to_arrow_schema(StructType.fromDDL(f"model string, {schema}"))

    def run(key, queries, entries):
        if not len(queries) or not len(entries):
            return kinds.empty_table()
        model = key[0].as_py()
        out = kernel(queries.to_pandas(), entries.to_pandas(), dims[model])
        if not len(out):  # pandas takes columns without rows for floats
            return kinds.empty_table()
        out.insert(0, "model", model)
        # column by column, whatever pandas keeps them in: it may hold strings in several Arrow chunks
        return pa.table([pa.array(out[k.name].to_numpy(), k.type) for k in kinds], schema=kinds)

    keys = ["model", "block", "q", "e"]
    return q.groupBy(*keys).cogroup(e.groupBy(*keys)).applyInArrow(run, "model string, " + schema)


def search(placed: DataFrame, books: dict[str, Codebooks], kernel, schema: str, unsettled, first: int | None = FIRST, part: int = PART) -> DataFrame:
    """The kernel's rows over all visits: those of the first and second visit of every query, and of all blocks for the
    queries (model, rep) that `unsettled(rows of the first visit, rows of the second)` names."""
    blocks = F.create_map(*[F.lit(x) for m, b in books.items() for x in (m, len(b.parts))])[F.col("model")]
    all_blocks = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    whole = lambda queries: meet(placed, books, queries.select("model", "rep", "v", all_blocks, F.lit(None).cast("array<int>").alias("cells")), kernel, schema, part)
    if first is None or all(b.counts.sum() <= 2 * first for b in books.values()):
        return materialise(whole(placed), "whole")
    asked = visits(placed, books, first)
    stage = lambda c: asked.select("model", "rep", "v", F.explode(c).alias("x")).select("model", "rep", "v", "x.block", "x.cells")
    one = materialise(meet(placed, books, stage("first"), kernel, schema, part), "first")
    two = materialise(meet(placed, books, stage("then"), kernel, schema, part), "then")
    rest = materialise(unsettled(one, two).select("model", "rep").distinct(), "unsettled")
    out = one.unionByName(two)
    if rest.isEmpty():
        return out
    left = placed.join(broadcast_if_small(rest), ["model", "rep"], "left_semi")
    return out.unionByName(materialise(whole(left), "rest"))


def cell_products(queries: pd.DataFrame, entries: pd.DataFrame, dim: int, rows: int = 1024):
    """(query positions, entry positions, cosines) for each cell that the queries visit, a bounded number at a time."""
    x, y = _unit(queries["v"].tolist(), dim), _unit(entries["v"].tolist(), dim)
    if queries["cells"].isna().all():
        for lo in range(0, len(x), rows):
            for el in range(0, len(y), 4096):
                yield np.arange(lo, min(len(x), lo + rows)), np.arange(el, min(len(y), el + 4096)), x[lo : lo + rows] @ y[el : el + 4096].T
        return
    n = np.array([len(c) for c in queries["cells"]])
    who, cell = np.repeat(np.arange(len(queries)), n), np.concatenate([np.asarray(c) for c in queries["cells"]])
    by = entries.groupby("cell").indices
    order = np.argsort(cell, kind="stable")
    who, cell = who[order], cell[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(cell)]):
        at = by.get(cell[a])
        if at is None:
            continue
        for lo in range(a, b, rows):
            mine = who[lo : min(b, lo + rows)]
            for el in range(0, len(at), 4096):
                some = at[el : el + 4096]
                yield mine, some, x[mine] @ y[some].T


def _packed(row: np.ndarray, cosine: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One number a hit that sorts by row, then falling cosine (in millionths), then place; no two are equal."""
    return (row << (PLACE_BITS + 22)) | ((10**DIGITS - cosine) << PLACE_BITS) | place


def _foremost(keys: np.ndarray, keep: int, least: np.ndarray) -> np.ndarray:
    """The `keep` first hits of each row; `least` of rows that have so many rises to the last one's cosine."""
    keys = np.sort(keys)
    row = keys >> (PLACE_BITS + 22)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rank = np.arange(len(keys)) - np.repeat(start, np.diff(np.r_[start, len(keys)]))
    last = rank == keep - 1
    least[row[last]] = 10**DIGITS - (keys[last] >> PLACE_BITS & ((1 << 22) - 1))
    return keys[rank < keep]


def nearest_kernel(keep: int, least: float):
    """Top `keep` ids per query, and per entry among the queries that came, with a cosine of at least `least`."""

    def run(queries, entries, dim):
        qr, er, ids = queries["rep"].to_numpy(object), entries["rep"].to_numpy(object), entries["ids"].to_numpy(object)
        if max(len(qr), len(er)) > LAST:
            raise ValueError("a block holds more rows than its places can number")
        q_order, e_order = np.argsort(qr), np.argsort(er)
        q_place, e_place = np.argsort(q_order), np.argsort(e_order)
        # cosines below these cannot be among the best
        low = int(np.ceil(least * 10**DIGITS - 1e-6))
        q_least, e_least = np.full(len(qr), low), np.full(len(er), low)
        sides = {True: [], False: []}
        held = 0

        def prune():
            for forward, bound in ((True, q_least), (False, e_least)):
                if sides[forward]:
                    sides[forward] = [_foremost(np.concatenate(sides[forward]), keep, bound)]

        for mine, some, c in cell_products(queries, entries, dim):
            floor = min(q_least[mine].min(), e_least[some].min()) / 10**DIGITS - SLACK
            x, y = np.nonzero(c >= floor)
            if not len(x):
                continue
            cosine = np.rint(c[x, y] * 10**DIGITS).astype(np.int64)
            q, e = mine[x], some[y]
            ok = cosine >= q_least[q]
            sides[True].append(_packed(q[ok], cosine[ok], e_place[e[ok]]))
            back = cosine >= e_least[e]
            sides[False].append(_packed(e[back], cosine[back], q_place[q[back]]))
            held += int(ok.sum() + back.sum())
            if held > MOST_HELD:
                prune()
                held = 0
        prune()
        parts = []
        for forward, found in sides.items():
            if not found:
                continue
            keys = found[0]
            row, cosine, place = keys >> (PLACE_BITS + 22), (10**DIGITS - (keys >> PLACE_BITS & ((1 << 22) - 1))) / 10**DIGITS, keys & LAST
            if not forward:
                parts.append(pd.DataFrame({"rep": er[row], "id": qr[q_order[place]], "cosine": cosine}))
                continue
            other = e_order[place]
            n = np.array([len(i) for i in ids])[other]
            one = n == 1
            parts.append(pd.DataFrame({"rep": qr[row[one]], "id": er[other[one]], "cosine": cosine[one]}))
            if not one.all():
                parts.append(pd.DataFrame({"rep": np.repeat(qr[row[~one]], n[~one]), "id": np.concatenate([ids[i] for i in other[~one]]), "cosine": np.repeat(cosine[~one], n[~one])}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"rep": [], "id": [], "cosine": []})

    return run


def _leading(found: DataFrame, keep: int) -> DataFrame:
    """The `keep` best rows of each (model, rep), with their rank `r`."""
    w = Window.partitionBy("model", "rep").orderBy(F.desc("cosine"), "id")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep)


def nearest(scan: DataFrame, k: int = 5, least: float = -1.0, first: int | None = FIRST, per_cell: int = PER_CELL, block: int = BLOCK, part: int = PART) -> DataFrame:
    """The k most similar vectors of every usable vector of the same model: model, id, rank, neighbour, cosine.

    Cosines are rounded to 6 decimals, ties go to the smaller id, a vector is not its own neighbour. Only neighbours of
    at least `least` are given. Vectors that are null, of another length, zero or not finite have no rows; repeated rows
    count once; equal vectors under different ids are neighbours of each other. A query whose second visit changes its
    list is compared with all vectors of its model; `first=None` does so for every query (exact).
    """
    keep = k + 1
    entries, copies = classes(materialise(usable_vectors(scan), "usable"), keep)
    entries = materialise(entries, "entries")
    if entries.isEmpty():
        return scan.sparkSession.createDataFrame([], "model string, id string, rank int, neighbour string, cosine double")
    placed, books = index(entries, fit(entries, per_cell=per_cell), block)

    def unsettled(one: DataFrame, two: DataFrame) -> DataFrame:
        rows = one.withColumn("late", F.lit(0)).unionByName(two.withColumn("late", F.lit(1)))
        rows = rows.groupBy("model", "rep", "id").agg(F.max("cosine").alias("cosine"), F.min("late").alias("late"))
        return _leading(rows, keep).filter("late = 1")

    found = search(placed, books, nearest_kernel(keep, least), "rep string, id string, cosine double", unsettled, first, part)
    # an entry that was visited knows its visitor's smallest id only; the class's other ids follow here
    low = placed.filter(F.size("ids") > 1).select("model", F.col("rep").alias("id"), "ids")
    wide = found.join(broadcast_if_small(materialise(low, "low"), 8 << 20), ["model", "id"]).select("model", "rep", F.explode("ids").alias("id"), "cosine")
    best = _leading(found.unionByName(wide).dropDuplicates(["model", "rep", "id"]), keep)
    lists = materialise(best.groupBy("model", "rep").agg(F.sort_array(F.collect_list(F.struct("r", "id", "cosine"))).alias("list")), "lists")
    single = lists.join(copies.select("model", "rep").distinct(), ["model", "rep"], "left_anti").select("model", F.col("rep").alias("me"), "list")
    every = single.unionByName(lists.join(copies, ["model", "rep"]).select("model", F.col("id").alias("me"), "list"))
    mine = every.select("model", "me", F.slice(F.filter("list", lambda x: x["id"] != F.col("me")), 1, k).alias("list"))
    return mine.select("model", "me", F.posexplode("list").alias("rank", "x")).select("model", F.col("me").alias("id"), F.col("rank").cast("int").alias("rank"), F.col("x.id").alias("neighbour"), F.col("x.cosine").alias("cosine"))
