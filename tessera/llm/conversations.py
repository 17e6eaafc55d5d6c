"""Rebuilding conversations from message rows.

Method: each session's reply graph is sorted topologically by Kahn's algorithm with ties broken by time; lines left over
lie on or below cycles. In the order found, each line learns where its chain leaves the session and which prompt it
answers, so one pass over a session gives its broken chains, its unanswered prompts and whether roles alternate. Only
the few exits of sessions are followed further, by the forest operator over exits.

Sessions are sorted in units of bounded size, many small sessions to a unit; a session with more lines is cut into
several (by time, so that few links cross), and what crosses is followed like an exit. For the order of such a session
the cuts are by effective time (the latest time on a line's chain), which is the order that Kahn's algorithm takes lines
in, so its slices follow one another.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.forest import resolve_forest
from tessera.operators.shred import blocks_of
from tessera.runtime import broadcast_if_small, key_of, materialise

#: Lines of a session from which on it is sorted in slices of about half as many.
HOT_SESSION_LINES = 200_000
#: Lines of a unit of small sessions, on average.
UNIT_LINES = 25_000
_SEP = "\x1f"
# The spellings of speaker roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant"}


def _flags(batches):
    for b in batches:
        content = b.column("content").to_pylist()
        text, result, use = [], [], []
        for c in content:
            blocks = blocks_of(c)
            if blocks is None:
                text.append(bool(c and c.strip()))
                result.append(False)
                use.append(False)
                continue
            blocks = [x for x in blocks if isinstance(x, dict)]
            text.append(any(x.get("type") == "text" and isinstance(x.get("text"), str) and x["text"].strip() for x in blocks))
            result.append(any(x.get("type") == "tool_result" for x in blocks))
            use.append(any(x.get("type") == "tool_use" for x in blocks))
        keep = [n for n in b.schema.names if n != "content"]
        out = {n: b.column(n) for n in keep} | {"has_text": pa.array([bool(x) for x in text]), "has_result": pa.array(result, pa.bool_()), "has_use": pa.array(use, pa.bool_())}
        yield pa.RecordBatch.from_pydict(out)


def _texts(batches):
    for b in batches:
        out = []
        for c in b.column("content").to_pylist():
            blocks = blocks_of(c)
            if blocks is None:
                out.append(c)
            else:
                out.append("\n\n".join(x["text"] for x in blocks if isinstance(x, dict) and x.get("type") == "text" and isinstance(x.get("text"), str)))
        yield pa.RecordBatch.from_pydict({"uuid": b.column("uuid"), "text": pa.array(out, pa.string())})


def message_texts(messages: DataFrame) -> DataFrame:
    """uuid and the plain or top-level text of each of `uuid, content`."""
    return messages.select("uuid", "content").mapInArrow(_texts, "uuid string, text string")


def time_of(column: str):
    """A timestamp in any of its spellings as microseconds: ISO 8601 with zone, offset or neither (UTC), or epoch seconds
    or milliseconds. Null where it is none of them."""
    c = F.btrim(F.col(column))
    number = F.when(c.rlike("^[0-9]{9,10}$"), c.cast("long") * 1_000_000).when(c.rlike("^[0-9]{12,13}$"), c.cast("long") * 1000)
    return F.coalesce(number, F.unix_micros(F.try_to_timestamp(c)))


def conversation_lines(rows: DataFrame) -> DataFrame:
    """The lines of a session log, once per uuid, with what the checks need.

    rows: `key, parent, session, type, isSidechain, timestamp, role, content` (keys normalised). Result: key, parent,
    session, side, main, speaker, micros, is_prompt, is_reply. The speaker of a main line is its role in a clean
    spelling, or its type where the role is missing or unknown.
    """
    src = rows.select(
        "key", "parent", "session",
        F.coalesce("isSidechain", F.lit(False)).alias("side"),
        key_of("type").alias("kind"),
        time_of("timestamp").alias("micros"),
        key_of("role").alias("role"),
        F.when(key_of("type").isin("user", "assistant"), F.col("content")).alias("content"),
    )
    flagged = src.mapInArrow(_flags, "key string, parent string, session string, side boolean, kind string, micros long, role string, has_text boolean, has_result boolean, has_use boolean")
    main = F.col("kind").isin("user", "assistant") & ~F.col("side")
    clean = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("role")]
    return flagged.select(
        "key", "parent", "session", "side", "micros",
        F.coalesce(main, F.lit(False)).alias("main"),
        F.when(main, F.coalesce(clean, F.col("kind"))).alias("speaker"),
        F.coalesce(main & (F.col("kind") == "user") & F.col("has_text") & ~F.col("has_result"), F.lit(False)).alias("is_prompt"),
        F.coalesce(main & (F.col("kind") == "assistant") & (F.col("has_text") | F.col("has_use")), F.lit(False)).alias("is_reply"),
    )


def kahn(keys: list, parents: list, times: list) -> tuple[list[int], list[int]]:
    """Topological order of a reply graph by Kahn's algorithm, the earliest (time, key) of the ready lines first.

    Parents that are not among the keys count as done; a line without a time follows as soon as it is ready. Returns
    the order and the indices left over, which lie on or below cycles, by (time, key).
    """
    at = {k: i for i, k in enumerate(keys)}
    children: list[list[int]] = [[] for _ in keys]
    ready = []
    for i, p in enumerate(parents):
        j = at.get(p) if p is not None else None
        if j is None:
            ready.append((times[i], keys[i], i))
        else:
            children[j].append(i)
    heapq.heapify(ready)
    order = []
    while ready:
        i = heapq.heappop(ready)[2]
        order.append(i)
        for c in children[i]:
            heapq.heappush(ready, (times[c], keys[c], c))
    done = set(order)
    return order, sorted((i for i in range(len(keys)) if i not in done), key=lambda i: (times[i], keys[i]))


_UNIT = "session string, key string, parent string, main boolean, speaker string, side boolean, is_prompt boolean, is_reply boolean, micros long"
_PLACED = (
    "session string, unit long, place long, key string, main boolean, side boolean, is_prompt boolean, is_reply boolean, speaker string, micros long, same_speaker boolean, "
    "left_over boolean, top string, exit string, stop string, beyond string, answered boolean"
)


def _sort_unit(g: pd.DataFrame) -> pd.DataFrame:
    """Kahn's order of one unit and what follows from it; see `placed_lines`."""
    session = g["session"].to_numpy(object)
    keys = g["key"].to_numpy(object)
    own = list(zip(session, keys))
    at = {k: i for i, k in enumerate(own)}
    up = [None if p is None or p != p else (s, p) for s, p in zip(session, g["parent"].to_numpy(object))]
    times = g["micros"].fillna(-1).astype("int64").tolist()
    order, left = kahn(own, up, times)
    side, prompt, reply = (g[c].to_numpy(bool) for c in ("side", "is_prompt", "is_reply"))
    n = len(g)
    top, exits, stop, beyond = [None] * n, [None] * n, [None] * n, [None] * n
    answered = np.zeros(n, bool)
    for i in [*order, *left]:
        p = up[i]
        j = at.get(p) if p is not None else None
        inside = j is not None
        if inside:
            top[i], exits[i] = top[j], exits[j]
        else:
            top[i], exits[i] = keys[i], None if p is None else p[1]
        # the way of an answer: up to the first prompt, over lines that are not sidechain
        if prompt[i]:
            stop[i] = keys[i]
        elif not side[i] and p is not None:
            if not inside:
                beyond[i] = p[1]
            else:
                stop[i], beyond[i] = stop[j], beyond[j]
    # an answer may also come up from below a cycle: lines there have a prompt above them or none at all
    for i in left:
        k, seen = i, set()
        while not prompt[k] and not side[k] and k not in seen:
            seen.add(k)
            p = up[k]
            if p is None or p not in at:
                break
            k = at[p]
        stop[i], beyond[i] = (keys[k] if prompt[k] else None), None
    for i in np.flatnonzero(reply):
        if stop[i] is not None:
            answered[at[session[i], stop[i]]] = True
    rank = np.empty(n, np.int64)
    rank[[*order, *left]] = np.arange(n)
    left_over = np.zeros(n, bool)
    left_over[left] = True
    out = g.assign(place=rank, left_over=left_over, top=top, exit=exits, stop=stop, beyond=beyond, answered=answered).sort_values(["session", "place"], kind="stable")
    main = out["main"].to_numpy(bool)
    out["place"] = np.where(main, out["main"].groupby(out["session"]).cumsum() - 1, -1)
    before = out["speaker"].where(out["main"]).groupby(out["session"]).ffill().groupby(out["session"]).shift()
    out["same_speaker"] = (main & (out["speaker"] == before)).astype(bool)
    return out[[c.split()[0] for c in _PLACED.split(", ")]]


def placed_lines(lines: DataFrame, hot_lines: int = HOT_SESSION_LINES, unit_lines: int = UNIT_LINES) -> DataFrame:
    """Kahn's algorithm over all sessions: the lines that belong to one, with what it tells about each.

    `place` (of a main line among the main lines of its session within the unit, -1 for others), `same_speaker` (as the
    main line before), `left_over` (on or below a cycle), `top` and `exit` (the uppermost line of its chain within the
    unit and that line's parent, null if it has none), `stop` (the prompt that an answer from here goes back to), `beyond`
    (the key outside the unit where the way to it goes on) and, for a prompt, `answered` (from within the unit).
    """
    rows = materialise(lines.filter("session is not null"), "lines")
    n = rows.count()
    sizes = materialise(rows.groupBy("session").count().filter(F.col("count") > hot_lines).select("session", "count"), "hot")
    units = F.pmod(F.xxhash64("session"), F.lit(max(1, -(-n // unit_lines))))
    if sizes.isEmpty():
        rows = rows.withColumn("unit", units)
    else:
        most = sizes.agg(F.max("count")).first()[0]
        k = max(2, 2 * most // hot_lines)
        large = rows.join(broadcast_if_small(sizes.select("session")), "session")
        bounds = large.groupBy("session").agg(F.percentile_approx(F.coalesce("micros", F.lit(-1)), [i / k for i in range(1, k)], 10_000).alias("bounds"))
        # lines of one time may be many: the hash spreads what a cut by time cannot
        spread = F.pmod(F.xxhash64("key"), F.lit(k))
        large = large.join(broadcast_if_small(bounds), "session").withColumn("cut", F.size(F.filter("bounds", lambda b: b < F.coalesce("micros", F.lit(-1)))))
        full = large.groupBy("session", "cut").count().filter(F.col("count") > hot_lines).select("session", "cut", F.lit(True).alias("full"))
        large = large.join(broadcast_if_small(full), ["session", "cut"], "left")
        unit = F.xxhash64("session", "cut", F.when(F.col("full"), spread).otherwise(F.lit(-1)))
        rows = rows.join(broadcast_if_small(sizes.select("session")), "session", "left_anti").withColumn("unit", units).unionByName(large.withColumn("unit", unit).drop("bounds", "cut", "full"))
    rows = rows.select("unit", "session", "key", "parent", "main", "speaker", "side", "is_prompt", "is_reply", "micros")
    return materialise(rows.groupBy("unit").applyInPandas(_sort_unit, _PLACED), "placed")


def _split_sessions(placed: DataFrame) -> DataFrame:
    """The sessions in several units and their number of lines: session, n."""
    sizes = placed.groupBy("session").agg(F.min("unit").alias("a"), F.max("unit").alias("b"), F.count("*").alias("n"))
    return materialise(sizes.filter("a <> b").select("session", "n"), "split")


def _answers_across_units(placed: DataFrame, split: DataFrame) -> DataFrame:
    """The prompts answered from another unit of their session (`split`): session, key."""
    none = placed.filter("false").select("session", "key")
    if split.isEmpty():
        return none
    large = placed.join(broadcast_if_small(split.select("session")), "session", "left_semi")
    asked = large.filter("is_reply and beyond is not null").select("session", F.col("beyond").alias("key")).distinct()
    found, seen = none, none
    while True:
        asked = materialise(asked, "asked")
        if asked.isEmpty():
            return found.distinct()
        seen = seen.unionByName(asked)
        reached = materialise(large.join(asked, ["session", "key"]).filter("is_prompt or not side").select("session", "stop", "beyond"), "reached")
        found = found.unionByName(reached.filter("stop is not null").select("session", F.col("stop").alias("key")))
        asked = reached.filter("beyond is not null").select("session", F.col("beyond").alias("key")).distinct().join(seen, ["session", "key"], "left_anti")


def _loose_tops(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """The (unit, top) whose chain never ends, or ends at a key that no line has, as `unit, top`."""
    # lines without a session are links of a chain too, each for itself
    single = lines.filter("session is null").select("key", "parent")
    apart = single.select(F.lit(None).cast("long").alias("unit"), F.col("key").alias("top"), F.col("parent").alias("exit")).filter("exit is not null")
    heads = materialise(placed.filter("exit is not null and not left_over").select("unit", "top", "exit").distinct().unionByName(apart), "heads")
    wanted = broadcast_if_small(heads.select(F.col("exit").alias("key")).distinct())
    there = placed.join(wanted, "key", "left_semi").select(F.col("key").alias("exit"), F.col("unit").alias("to_unit"), F.col("top").alias("to_top"), F.col("exit").alias("to_exit"), "left_over")
    there = there.unionByName(single.select(F.col("key").alias("exit"), F.lit(None).cast("long").alias("to_unit"), F.col("key").alias("to_top"), F.col("parent").alias("to_exit"), F.lit(False).alias("left_over")))
    name = lambda u, t: F.concat(F.coalesce(F.col(u).cast("string"), F.lit("")), F.lit(_SEP), F.col(t))
    to = F.when(F.col("left_over"), name("unit", "top")).when(F.col("to_top").isNull(), F.col("exit")).when(F.col("to_exit").isNotNull(), name("to_unit", "to_top"))
    nodes = heads.join(there, "exit", "left").select(name("unit", "top").alias("key"), to.alias("parent"), "unit", "top")
    nodes = materialise(nodes.withColumn("bucket", F.xxhash64("key")), "exits")
    bad = resolve_forest(nodes.select("key", "parent", "bucket")).filter("dangling or depth < 0").select("key")
    return nodes.join(bad, "key", "left_semi").filter("unit is not null").select("unit", "top")


def judge_sessions(lines: DataFrame, hot_lines: int = HOT_SESSION_LINES, placed: DataFrame | None = None, repeated: bool = True) -> DataFrame:
    """session, n_lines, n_prompts, n_replies, n_repeated and `reason`: empty, broken, no_reply, or null if it is sound.

    `n_repeated` counts the main lines with the speaker of the main line before, by which roles fail to alternate; without
    `repeated` it is left out. Lines without a session take part in chains but in no session. The first reason that
    holds is given.
    """
    if placed is None:
        lines = materialise(lines, "lines")
        placed = placed_lines(lines, hot_lines)
    loose = broadcast_if_small(materialise(_loose_tops(placed, lines).withColumn("loose", F.lit(True)), "loose"))
    split = _split_sessions(placed)
    late = broadcast_if_small(materialise(_answers_across_units(placed, split).withColumn("late", F.lit(True)), "late"))
    whole = placed.join(loose, ["unit", "top"], "left").join(late, ["session", "key"], "left")
    sums = lambda c: F.sum(F.col(c).cast("long"))
    by = whole.groupBy("session").agg(
        sums("main").alias("n_lines"),
        sums("is_prompt").alias("n_prompts"),
        sums("is_reply").alias("n_replies"),
        sums("same_speaker").alias("n_repeated"),
        F.max(F.col("main") & (F.col("left_over") | F.coalesce("loose", F.lit(False)))).alias("broken"),
        F.max(F.col("is_prompt") & ~F.col("answered") & F.col("late").isNull()).alias("silent"),
    )
    reason = F.when((F.col("n_prompts") == 0) & (F.col("n_replies") == 0), "empty").when(F.col("broken"), "broken").when(F.col("silent"), "no_reply")
    n_repeated = F.col("n_repeated")
    if repeated and not split.isEmpty():  # units see the line before within the unit only
        exact = _sliced_order(lines, split, hot_lines).groupBy("session").agg(sums("same_speaker").alias("exact"))
        by, n_repeated = by.join(broadcast_if_small(exact), "session", "left"), F.coalesce("exact", "n_repeated").alias("n_repeated")
    return by.select("session", "n_lines", "n_prompts", "n_replies", *([n_repeated] if repeated else []), reason.alias("reason"))


def _sort_slice(g: pd.DataFrame) -> pd.DataFrame:
    """Kahn's order of one slice of a session, or of one of its left-over lines: its main lines."""
    times = g["micros"].fillna(-1).astype("int64").tolist()
    keys = g["key"].tolist()
    if g["left_over"].iat[0]:
        order = sorted(range(len(keys)), key=lambda i: (times[i], keys[i]))
    else:
        order, _ = kahn(keys, [None if p is None or p != p else p for p in g["parent"]], times)
    g = g.iloc[order]
    g = g[g["main"]]
    speaker = g["speaker"]
    return pd.DataFrame({"session": g["session"], "left_over": g["left_over"], "cut": g["cut"], "key": g["key"], "speaker": speaker, "micros": g["micros"].astype("Int64"), "place": range(len(g)), "same_speaker": speaker == speaker.shift()})


def _effective_times(lines: DataFrame) -> DataFrame:
    """Add `effective`, the latest time on each line's chain within its session, by pointer doubling, and `left_over`.

    Lines on or below cycles (`left_over`) keep a link for good; their own time counts.
    """
    own = F.coalesce("micros", F.lit(-1)).cast("long")
    links = materialise(lines.select("session", "key", "parent", own.alias("effective")), "times")
    open_links = None
    while True:
        up = links.select("session", F.col("key").alias("parent"), F.col("parent").alias("next"), F.col("effective").alias("above"))
        links = materialise(
            links.join(up, ["session", "parent"], "left").select("session", "key", F.col("next").alias("parent"), F.greatest("effective", F.coalesce("above", "effective")).alias("effective")),
            "times",
        )
        before, open_links = open_links, links.filter("parent is not null").count()
        # a chain of any length has one of each shorter length above it: where none ends, none is left that will
        if open_links in (0, before):
            break
    left = F.col("parent").isNotNull()
    ends = links.select("session", "key", left.alias("left_over"), "effective")
    return lines.join(ends, ["session", "key"]).withColumn("effective", F.when(F.col("left_over"), own).otherwise(F.col("effective")))


def _sliced_order(lines: DataFrame, split: DataFrame, hot_lines: int) -> DataFrame:
    """session, position, key, speaker, micros, same_speaker: the main lines of the sessions `split` (session, n), in Kahn's
    order by slices of effective time, then those left over, by slices of time."""
    rows = lines.join(broadcast_if_small(split.select("session")), "session", "left_semi").select("session", "key", "parent", "main", "speaker", "micros")
    large = materialise(_effective_times(materialise(rows, "large")), "effective")
    n = split.agg(F.max("n")).first()[0]
    shares = [i / k for k in [max(2, 2 * n // hot_lines)] for i in range(1, k)]
    bounds = large.groupBy("session", "left_over").agg(F.percentile_approx("effective", shares, 10_000).alias("bounds"))
    large = large.join(bounds, ["session", "left_over"]).withColumn("cut", F.size(F.filter("bounds", lambda b: b < F.col("effective"))))
    large = large.select("session", "left_over", "cut", "key", "parent", "main", "speaker", "micros")
    by = ["session", "left_over", "cut"]
    sliced = materialise(large.groupBy(*by).applyInPandas(_sort_slice, "session string, left_over boolean, cut int, key string, speaker string, micros long, place long, same_speaker boolean"), "slices")
    w = Window.partitionBy("session").orderBy("left_over", "cut")
    sizes = sliced.groupBy(*by).agg(F.count("*").alias("n"), F.max_by("speaker", "place").alias("last"))
    offsets = sizes.select(*by, (F.sum("n").over(w) - F.col("n")).alias("before"), F.lag("last").over(w).alias("last"))
    return sliced.join(offsets, by).select(
        "session", (F.col("place") + F.col("before")).alias("position"), "key", "speaker", "micros",
        F.when(F.col("place") == 0, F.coalesce(F.col("speaker") == F.col("last"), F.lit(False))).otherwise(F.col("same_speaker")).alias("same_speaker"),
    )


def ordered_conversations(lines: DataFrame, sound: DataFrame, hot_lines: int = HOT_SESSION_LINES, placed: DataFrame | None = None) -> DataFrame:
    """The main lines of the sound sessions (`session`) in order.

    Result: session, position (from 0), key, speaker, micros, same_speaker (the line before has the same speaker). The
    order of a session within one unit is that of `placed_lines`; one in several is sorted in slices by effective time.
    """
    if placed is None:
        placed = placed_lines(lines, hot_lines)
    mine = placed.join(broadcast_if_small(sound.select("session")), "session", "left_semi")
    split = _split_sessions(mine)
    easy = mine if split.isEmpty() else mine.join(broadcast_if_small(split), "session", "left_anti")
    out = easy.filter("main").select("session", F.col("place").alias("position"), "key", "speaker", "micros", "same_speaker")
    return out if split.isEmpty() else out.unionByName(_sliced_order(lines, split, hot_lines))
