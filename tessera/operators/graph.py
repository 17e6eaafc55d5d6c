"""The chunk graph: edge detection, neighbourhoods, walks, transitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.runtime import broadcast_if_small, materialise

GAP_MINUTES = 30
#: Edge weights by type (fixed values).
WEIGHTS = {"within-chain": 1.0, "cross-session": 1.0, "brief": 1.0, "debrief": 1.0, "team-spawn": 0.9, "team-report": 0.9, "peer-message": 0.85}


def causal_edges(chunks: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """src, dst between chunks of a session: from each chunk of a turn to the next of that turn, and from the last chunk
    of a turn to the first of the next turn, unless more than the gap lies between them or the next one's user text
    opens another topic. A chunk that spans turns is linked once; null turns and ends are no evidence against a link.
    """
    c = chunks.select("id", "session_id", "start_time", "end_time", X.has_topic_shift(X.user_text(F.col("content"))).alias("shift"), F.explode(F.array_distinct("turn_indices")).alias("turn")).filter("turn is not null and session_id is not null")
    inside = Window.partitionBy("session_id", "turn").orderBy("start_time", "id")
    within = c.select(F.col("id").alias("src"), F.lead("id").over(inside).alias("dst"))
    ends = c.groupBy("session_id", "turn").agg(F.min(F.struct("start_time", "id", "shift")).alias("first"), F.max(F.struct("start_time", "id", "end_time")).alias("last"))
    turns = Window.partitionBy("session_id").orderBy("turn")
    pairs = ends.select(F.col("last.id").alias("src"), F.col("last.end_time").alias("ended"), F.lead("first").over(turns).alias("next"))
    gap = F.unix_micros("next.start_time") - F.unix_micros("ended")
    across = pairs.filter(F.coalesce(gap <= int(gap_minutes * 6e7), F.lit(True)) & ~F.coalesce("next.shift", F.lit(False))).select("src", F.col("next.id").alias("dst"))
    return within.unionByName(across).filter("dst is not null and src <> dst").distinct()


def session_ends(chunks: DataFrame) -> DataFrame:
    """Per session its first and last chunk."""
    s = chunks.groupBy("session_slug", "session_id").agg(F.min(F.struct("start_time", "id", X.is_resumed(F.col("content")).alias("resumed"))).alias("first"), F.max(F.struct("start_time", "id")).alias("last"))
    return s.select("session_slug", "session_id", F.col("first.start_time").alias("started"), F.col("first.id").alias("first_id"), F.col("first.resumed").alias("resumed"), F.col("last.id").alias("last_id"))


def session_links(chunks: DataFrame, only_resumed: bool = False) -> DataFrame:
    """src, dst from the last chunk of each session to the first of the project's next one (or only of resumed ones)."""
    w = Window.partitionBy("session_slug").orderBy("started", "session_id")
    e = session_ends(chunks).withColumn("src", F.lag("last_id").over(w)).filter("src is not null")
    return (e.filter("resumed") if only_resumed else e).select("src", F.col("first_id").alias("dst"))


def materialise_edges(links: DataFrame, reference_type: str) -> DataFrame:
    """Store rows for detected links: a deterministic id, type, weight and count."""
    return links.select(F.concat(F.lit("edge-"), X.short_hash(F.concat_ws(":", "src", "dst", F.lit(reference_type)), 16)).alias("id"), "src", "dst", F.lit("forward").alias("edge_type"), F.lit(reference_type).alias("reference_type"), F.lit(WEIGHTS.get(reference_type, 1.0)).alias("weight"), F.lit(1).alias("link_count"))


def degrees(edges: DataFrame) -> DataFrame:
    """Undirected degree of every node."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id and the number of hops (undirected) from the nearest seed (`id`), up to `hops`."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = materialise(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "hops")
    front = seen
    for h in range(1, hops + 1):
        step = both.join(broadcast_if_small(front.select(F.col("id").alias("src"))), "src").select(F.col("dst").alias("id")).distinct()
        front = materialise(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def walk_paths(edges: DataFrame, seeds: DataFrame, depth: int, nodes: DataFrame | None = None, budget: int | None = None, per_seed: int | None = None) -> DataFrame:
    """All maximal paths from each seed (`id`): seed, path.

    A path grows over edges src -> dst to nodes that it does not hold yet, at most `depth` links long, and with `nodes`
    (`id, tokens`) only while its tokens stay within `budget`. Paths are grown level by level, as joins; `per_seed` keeps
    the first so many open paths of a seed per level in the order of their nodes (the search's own candidate limit).
    """
    e = edges.select("src", "dst")
    cost = nodes.select(F.col("id").alias("dst"), "tokens") if nodes is not None else None
    first = seeds.select(F.col("id").alias("seed"), F.array("id").alias("path"), F.col("id").alias("src"))
    if nodes is not None:
        first = first.join(nodes.select(F.col("id").alias("src"), F.col("tokens").cast("long").alias("used")), "src")
    open_ = materialise(first, "walk")
    done = None
    for _ in range(depth):
        grown = open_.join(e, "src").filter(~F.array_contains("path", F.col("dst")))
        if cost is not None:
            grown = grown.join(cost, "dst").withColumn("used", F.col("used") + F.col("tokens")).drop("tokens")
            if budget is not None:
                grown = grown.filter(F.col("used") <= budget)
        new = grown.withColumn("old", F.col("path")).withColumn("path", F.concat("path", F.array("dst")))
        if per_seed is not None:
            new = new.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("path"))).filter(F.col("_n") <= per_seed).drop("_n")
        new = materialise(new, "walk")
        ended = open_.join(new.select("seed", F.col("old").alias("path")).distinct(), ["seed", "path"], "left_anti").select("seed", "path")
        done = ended if done is None else done.unionByName(ended)
        open_ = new.drop("old", "src").withColumnRenamed("dst", "src")
        if open_.isEmpty():
            return done
    return open_.select("seed", "path") if done is None else done.unionByName(open_.select("seed", "path"))


def _chains(budget: int, depth: int, agent: str | None, skips: int, candidates: int, expansions: int):
    """The depth-first walk of one seed over what is known of its neighbourhood (see `walk_chains`)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        seed = g["seed"].iloc[0]
        known = {r.id: r for r in g.itertuples()}
        out, path, visited, spent = [], [], {seed}, 0

        def emit():
            if path:
                scores = sorted(known[i].score for i in path)
                m = len(scores) // 2
                median = scores[m] if len(scores) % 2 else (scores[m - 1] + scores[m]) / 2
                out.append((seed, len(out), list(path), float(sum(scores)), int(sum(known[i].tokens for i in path)), float(median)))

        def walk(at, deep, skipped):
            nonlocal spent
            spent += 1
            if spent > expansions or len(out) >= candidates:
                return
            ahead = [n for n in known[at].dsts if n not in visited]
            if not ahead or deep >= depth:
                emit()
                return
            ended = False
            for n in ahead:
                if spent > expansions or len(out) >= candidates:
                    return
                node = known.get(n)
                if node is None:  # no such chunk
                    continue
                visited.add(n)
                other = agent is not None and node.agent != agent
                if other or node.tokens > budget:  # passed through, but no part of the chain
                    if not other or skipped + 1 <= skips:
                        before = len(out)
                        walk(n, deep + 1, skipped + 1 if other else 0)
                        ended |= len(out) > before
                elif path and sum(known[i].tokens for i in path) + node.tokens > budget:
                    emit()
                    ended = True
                else:
                    path.append(n)
                    walk(n, deep + 1, 0)
                    ended = True
                    path.pop()
                visited.discard(n)
            if not ended:
                emit()

        if known[seed].tokens <= budget:
            path.append(seed)
        walk(seed, 1, 0)
        if not out:
            emit()
        return pd.DataFrame(out, columns=["seed", "place", "path", "score", "tokens", "median"])

    return run


def walk_chains(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, budget: int, depth: int = 50, agent: str | None = None, skips: int = 5, candidates: int = 10, expansions: int = 200) -> DataFrame:
    """Candidate chains of each seed (`id`) by a depth-first walk: seed, place, path, score, tokens, median.

    edges: `src, dst`, taken in the order of dst; nodes: `id, tokens, agent, score` (0 tokens or null count as 100, a null
    score as 0). A path holds no node twice. It ends at a dead end, after `depth` nodes, or where the next node would
    exceed the budget; nodes of another agent (at most `skips` in a row) and nodes larger than the whole budget are
    passed through without being part of it. A seed ends after `candidates` chains or `expansions` steps. Seeds that are no
    node have no chains. Neighbourhoods are gathered level by level as joins; the walk of a seed is one small group.
    """
    n = nodes.select("id", F.when(F.coalesce("tokens", F.lit(0)) == 0, 100).otherwise(F.col("tokens")).cast("long").alias("tokens"), "agent", F.coalesce("score", F.lit(0.0)).alias("score"))
    ahead = edges.filter("src <> dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("dsts"))
    adjacency = materialise(n.join(ahead, "id", "left").withColumn("dsts", F.coalesce("dsts", F.array().cast("array<string>"))), "adjacency")
    front = materialise(seeds.select(F.col("id").alias("seed"), "id").distinct(), "front")
    seen = None
    # a node further away than steps allow is never reached
    for _ in range(min(depth, expansions) + 1):
        here = materialise(adjacency.join(broadcast_if_small(front), "id").select("seed", "id", "tokens", "agent", "score", "dsts"), "here")
        seen = here if seen is None else seen.unionByName(here)
        step = here.select("seed", F.explode("dsts").alias("id")).distinct()
        front = materialise(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"), "front")
        if front.isEmpty():
            break
    whole = seen.join(seen.filter("seed = id").select("seed"), "seed", "left_semi")
    return whole.groupBy("seed").applyInPandas(_chains(budget, depth, agent, skips, candidates, expansions), "seed string, place int, path array<string>, score double, tokens long, median double")


def best_paths(paths: DataFrame, scores: DataFrame) -> DataFrame:
    """Per seed the path of at least two nodes with the highest median node score (nodes without one score 0).

    Ties go to the longer, then the lexically first path.
    """
    n = paths.filter(F.size("path") >= 2).select("seed", "path", F.explode("path").alias("id")).join(scores.select("id", "score"), "id", "left")
    m = n.groupBy("seed", "path").agg(F.median(F.coalesce("score", F.lit(0.0))).alias("median"))
    w = Window.partitionBy("seed").orderBy(F.desc("median"), F.desc(F.size("path")), "path")
    return m.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("seed", "path", "median")


def first_walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The walk that always takes the smallest unvisited neighbour: seed, path."""
    walk = materialise(seeds.select(F.col("id").alias("seed"), F.array("id").alias("path"), F.col("id").alias("src"), F.lit(False).alias("ended")), "walk")
    for _ in range(depth):
        step = walk.filter("not ended").join(edges.select("src", "dst"), "src").filter(~F.array_contains("path", F.col("dst"))).groupBy("seed").agg(F.min("dst").alias("next"))
        if step.isEmpty():
            break
        walk = materialise(walk.join(step, "seed", "left").select("seed", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"), F.coalesce("next", "src").alias("src"), F.col("next").isNull().alias("ended")), "walk")
    return walk.select("seed", "path")


def transitions(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src_label, dst_label, n and the share of src_label's transitions, over edges and `id, label`."""
    j = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    n = j.groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("src_label")))


def top_per(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
