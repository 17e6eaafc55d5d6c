"""Parent-child links to full hierarchies.

Method: each partition contracts its own parent chains to fragment exits with one vectorised pass; the fragments
whose root has its parent in another partition form a much smaller quotient forest, which is solved by the same
procedure (its nodes meet in new partitions: by the toss of a coin a node goes where its parent goes, so that every
round contracts a quarter of the links or more), until one task holds what is left; each solution is joined back to the
fragments of the level above. Cycles within a partition show in the local pass, cycles across partitions in a quotient.
Partitions are sized by the number of rows.

The result is the same for every partitioning; a good `locality` column (session, file, tenant) only makes the
quotient small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import broadcast_if_small, materialise, shuffle_width

#: Nodes that one task contracts on average (about 200 bytes each); a quotient of so many is solved within one task.
NODES_PER_TASK = 200_000
#: Below that, nodes that make a task of their own worth while.
LEAST_NODES = 20_000
#: A locality group with more rows than this is split by the hash of the key.
HOT_GROUP_ROWS = 200_000

#: Tables of at most so many bytes (on disk, compressed) are broadcast.
BROADCAST_BYTES = 8 << 20

ROOT, OPEN, CYCLE, BELOW = 0, 1, 2, 3

_LOCAL = "key string, parent string, weight long, fragment string, hops long, kind int, exit string, least string, trail array<string>"


def contract_chains(key: pa.Array, parent: pa.Array, weight: np.ndarray, low: pa.Array, with_trail: bool = False) -> dict:
    """Contract the parent chains of one set of distinct keys.

    For each key: `fragment` (the last key reached within the set, or for cycles the smallest `low` on it), `hops` (the
    summed weights up to it), `kind`, `exit` (the parent outside the set that an OPEN fragment ends at), `least` (the
    smallest `low` from the key to the fragment's root) and, if asked for, `trail` (the keys from the fragment's
    root down to the key). `low` is what names a cycle: the key itself, or the smallest of the keys that a contracted
    link stands for. An empty set gives empty columns.
    """
    n = len(key)
    inside = pc.fill_null(pc.index_in(parent, value_set=key), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    inside[np.asarray(parent.is_null())] = -1
    rank_order = np.asarray(pc.array_sort_indices(low)).astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[rank_order] = np.arange(n)
    self_ = np.arange(n)
    top = inside < 0
    ptr = np.where(top, self_, inside)
    hops = np.where(top, 0, weight).astype(np.int64)
    least = np.where(top, rank, np.minimum(rank, rank[ptr]))
    for _ in range(max(1, int(n).bit_length()) + 1):
        nxt = ptr[ptr]
        if np.array_equal(nxt, ptr):
            break
        hops = hops + hops[ptr]
        least = np.minimum(least, least[ptr])
        ptr = nxt
    kind = np.where(np.asarray(parent.is_null())[ptr], ROOT, OPEN)
    caught = ~top[ptr]
    named = self_.copy()
    if caught.any():
        on_cycle = np.zeros(n, bool)
        on_cycle[ptr[caught]] = True
        # each cycle's smallest key: minima over doubling strides of the cycle's own links
        lows, step = rank.copy(), np.where(top, self_, inside)
        for _ in range(int(n).bit_length() + 1):
            lows = np.minimum(lows, lows[step])
            step = step[step]
        named[caught] = rank_order[lows[ptr[caught]]]
        kind[caught] = np.where(on_cycle[caught], CYCLE, BELOW)
        hops[caught] = np.where(on_cycle[caught], -1, -2)
    out = {
        "fragment": pc.if_else(pa.array(caught), low.take(pa.array(named)), key.take(pa.array(ptr))),
        "hops": pa.array(hops),
        "kind": pa.array(kind.astype(np.int32)),
        "exit": pc.if_else(pa.array(kind == OPEN), parent.take(pa.array(ptr)), pa.scalar(None, pa.string())),
        "least": low.take(pa.array(rank_order[least])) if n else low,
    }
    if with_trail:
        names, trails = key.to_pylist(), [None] * n
        depth = np.zeros(n, np.int64)
        up, at = np.where(top, self_, inside), np.where(top, 0, 1)
        for _ in range(int(n).bit_length() + 1):
            depth, at, up = depth, at + at[up], up[up]
        for i in np.argsort(np.where(caught, -1, at), kind="stable"):
            trails[i] = [names[i]] if caught[i] or top[i] else [*trails[inside[i]], names[i]]
        out["trail"] = pa.array(trails, pa.list_(pa.string()))
    else:
        out["trail"] = pa.nulls(n, pa.list_(pa.string()))
    return out


def _kernel(with_trail: bool):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        col = lambda c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        key, parent = col("key"), col("parent")
        got = contract_chains(key, parent, t.column("weight").to_numpy(), col("low"), with_trail)
        out = pa.table({"key": key, "parent": parent, "weight": col("weight"), **got})
        yield from out.to_batches(max_chunksize=20_000)

    return run


def _parts(spark, n: int) -> int:
    """Partitions for n nodes: none above NODES_PER_TASK on average, no more than the session's width without need."""
    return max(1, -(-n // NODES_PER_TASK), min(shuffle_width(spark), n // LEAST_NODES))


def _contract(nodes: DataFrame, n: int, with_trail: bool, level: int) -> DataFrame:
    parts = 1 if level and n <= NODES_PER_TASK else _parts(nodes.sparkSession, n)
    placed = nodes.coalesce(1) if parts == 1 else nodes.repartition(parts, "bucket")
    return placed.select("key", "parent", "weight", "low").mapInArrow(_kernel(with_trail), _LOCAL)


def _mark_cycle(batches):
    """Of open fragments on a cycle across partitions: which keys lie on it (from the entry up to the root)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    key, parent = t.column("key").to_pylist(), t.column("parent").to_pylist()
    entry = t.column("entry").to_pylist()
    up = dict(zip(key, parent))
    marked = set()
    for k, e in zip(key, entry):
        if e:
            while k in up and k not in marked:
                marked.add(k)
                k = up[k]
    yield from pa.table({"key": t.column("key"), "root": t.column("root"), "on_cycle": pa.array([k in marked for k in key], pa.bool_())}).to_batches(max_chunksize=20_000)


def resolve_forest(nodes: DataFrame, with_path: bool = False, _level: int = 0) -> DataFrame:
    """Root and depth of every node of a parent-child table.

    nodes: `key` (distinct, not null), `parent` (null for none), `bucket` (locality), optional `weight` (hops to the
    parent, 1 if absent) and `low` (what names a cycle, the key if absent). It is read twice, so it had better be a
    written table. Result: `key`, `root`, `depth`, `dangling` (the chain ends at a parent that is no key), and `path`
    (keys from the root down to the node; null unless asked for).

    Defined cases: a parent that is no key makes its child a root, with `dangling` true all the way down; a node on a
    cycle (also its own parent) has depth -1, one below a cycle -2, both with the cycle's smallest key as root and a
    path of only itself; an empty table gives an empty result. `key` duplicates must be removed before.
    """
    n = nodes.count()
    if "weight" not in nodes.columns:
        nodes = nodes.withColumn("weight", F.lit(1).cast("long"))
    if "low" not in nodes.columns:
        nodes = nodes.withColumn("low", F.col("key"))
    local = materialise(_contract(nodes, n, with_path, _level), f"forest{_level}")
    is_open = F.col("kind") == OPEN
    closed = local.filter(~is_open).select(
        "key",
        F.col("fragment").alias("root"),
        F.col("hops").alias("depth"),
        F.lit(False).alias("dangling"),
        F.when(F.col("kind") == ROOT, F.col("trail")).otherwise(F.array("key")).alias("path") if with_path else F.lit(None).cast("array<string>").alias("path"),
    )
    opened = local.filter(is_open)
    exits = materialise(opened.filter(F.col("key") == F.col("fragment")).select("fragment", "exit", "weight"), f"exits{_level}")
    # where each exit leads: its own fragment, the distance to that fragment's root, and what kind it is
    # (the few exits are sent to the nodes where their size allows, so the nodes are not shuffled)
    targets = local.select(F.col("key").alias("exit"), F.col("fragment").alias("to"), F.col("hops").alias("to_hops"), F.col("kind").alias("to_kind"), F.col("trail").alias("to_trail"), F.col("least").alias("to_least"))
    wanted = materialise(targets.join(broadcast_if_small(exits.select("exit").distinct(), BROADCAST_BYTES), "exit", "left_semi"), f"targets{_level}")
    quotient = materialise(exits.join(wanted, "exit", "left"), f"quotient{_level}")
    n_open = quotient.count()
    if n_open == 0:
        return closed
    solved = _solve_quotient(quotient, n_open, with_path, _level)
    no_path = F.lit(None).cast("array<string>")
    through = opened.join(broadcast_if_small(solved.filter("depth <> -1"), BROADCAST_BYTES), "fragment").select(
        "key",
        "root",
        F.when(F.col("depth") >= 0, F.col("depth") + F.col("hops")).otherwise(F.lit(-2)).cast("long").alias("depth"),
        "dangling",
        (F.when(F.col("depth") >= 0, F.concat("path", "trail")).otherwise(F.array("key")) if with_path else no_path).alias("path"),
    )
    on_cycle = solved.filter("depth = -1").select("fragment", "root")
    caught = None
    if not on_cycle.isEmpty():
        # on these fragments, the keys on the cycle are those between an entry point and the fragment's root
        entries = quotient.join(on_cycle, "fragment", "left_semi").select(F.col("exit").alias("key"), F.lit(True).alias("entry")).distinct()
        rows = opened.join(on_cycle, "fragment").join(entries, "key", "left").select("fragment", "key", "parent", F.coalesce("entry", F.lit(False)).alias("entry"), "root")
        rows = materialise(rows, f"caught{_level}")
        marked = rows.repartition(_parts(rows.sparkSession, rows.count()), "fragment").select("key", "parent", "entry", "root").mapInArrow(_mark_cycle, "key string, root string, on_cycle boolean")
        caught = marked.select("key", "root", F.when(F.col("on_cycle"), -1).otherwise(-2).cast("long").alias("depth"), F.lit(False).alias("dangling"), (F.array("key") if with_path else no_path).alias("path"))
    out = closed.unionByName(through)
    return out.unionByName(caught) if caught is not None else out


def _solve_quotient(quotient: DataFrame, n: int, with_path: bool, level: int) -> DataFrame:
    """Solve the forest of open fragments by the same procedure.

    Result per fragment: root, depth of the fragment's root (-1: on a cycle of fragments, -2: below a cycle), dangling,
    path above the fragment's root.
    """
    # fragments whose exit is missing or leads into a closed fragment are roots of the quotient
    parent = F.when(F.col("to_kind") == OPEN, F.col("to"))
    coin = F.pmod(F.xxhash64("fragment", F.lit(level)), F.lit(2)) == 1
    meet = F.xxhash64(F.when(coin, F.coalesce(parent, F.col("fragment"))).otherwise(F.col("fragment")), F.lit(level))
    nodes = quotient.select(
        F.col("fragment").alias("key"),
        parent.alias("parent"),
        (F.coalesce("to_hops", F.lit(0)) + F.col("weight")).alias("weight"),
        F.coalesce("to_least", "fragment").alias("low"),
        meet.alias("bucket"),
    )
    got = resolve_forest(nodes, with_path, level + 1).select(F.col("key").alias("fragment"), F.col("root").alias("top"), F.col("depth").alias("q_depth"), F.col("path").alias("q_path"))
    tops = quotient.select(
        F.col("fragment").alias("top"),
        F.col("to_kind").isNull().alias("top_dangling"),
        F.when(F.col("to_kind").isNull(), F.col("fragment")).otherwise(F.col("to")).alias("top_root"),
        F.when(F.col("to_kind").isNull(), F.lit(0)).when(F.col("to_kind") == ROOT, F.col("to_hops") + F.col("weight")).otherwise(F.lit(-2)).alias("top_depth"),
    )
    caught = F.col("q_depth") < 0
    out = got.join(tops, "top", "left").select(
        "fragment",
        F.when(caught, F.col("q_depth")).when(F.col("top_depth") < 0, F.lit(-2)).otherwise(F.col("top_depth") + F.col("q_depth")).cast("long").alias("depth"),
        F.when(caught, F.col("top")).otherwise(F.col("top_root")).alias("root"),
        (~caught & F.coalesce("top_dangling", F.lit(False))).alias("dangling"),
        "q_path",
    )
    if not with_path:
        return materialise(out.withColumn("path", F.lit(None).cast("array<string>")).drop("q_path"), f"answer{level}")
    out = materialise(out, f"answer{level}")
    # each fragment on the way adds the keys from its target's fragment root down to its exit
    steps = out.filter("depth >= 0").select("fragment", F.posexplode("q_path").alias("at", "step"))
    trails = quotient.select(F.col("fragment").alias("step"), F.coalesce("to_trail", F.array().cast("array<string>")).alias("trail"))
    paths = steps.join(trails, "step").groupBy("fragment").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "trail"))), lambda x: x["trail"])).alias("path"))
    return materialise(out.drop("q_path").join(paths, "fragment", "left"), f"answer{level}p")


def locality_buckets(rows: DataFrame, key: str, group: str, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Add `bucket`: the hash of `group`; groups of more than `hot_rows` rows, and rows without one, are spread by key."""
    sizes = rows.groupBy(group).count().filter(F.col("count") > hot_rows).select(F.col(group).alias("_g"), (F.col("count") / hot_rows).cast("long").alias("_n"))
    joined = rows.join(sizes, rows[group] == sizes["_g"], "left")
    salt = F.when(F.col(group).isNull(), F.xxhash64(key)).when(F.col("_n").isNotNull(), F.pmod(F.xxhash64(key), F.col("_n") + 1)).otherwise(F.lit(0))
    return joined.withColumn("bucket", F.xxhash64(F.coalesce(F.col(group), F.lit("")), salt)).drop("_g", "_n")


def link_rows(rows: DataFrame, key: str, parent: str, group: str, order: str) -> DataFrame:
    """One row per distinct non-null key (the row of the smallest `order`, then parent, then group)."""
    first = F.min(F.struct(F.col(order), F.col(parent), F.col(group)))
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(first.alias("_f")).select("key", F.col(f"_f.{parent}").alias("parent"), F.col(f"_f.{group}").alias("grp"))
