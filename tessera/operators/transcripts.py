"""Messages to turns to chunks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import rank_within
from tessera.operators.shred import shred_blocks
from tessera.runtime import materialise

MAX_TOKENS, MIN_TOKENS, RESULT_CHARS = 4096, 64, 500
FILE_TOOLS = ("Read", "Write", "Edit", "Glob", "NotebookEdit")
# Outcomes by pattern of a shell command.
OUTCOMES = {"git commit": r"git\s+commit\b", "git push": r"git\s+push\b", "gh pr create": r"gh\s+pr\s+create\b", "gh pr merge": r"gh\s+pr\s+merge\b", "npm publish": r"npm\s+publish\b"}
_SECTION = re.compile(r"\n\n(?=\[(?:User|Assistant|Thinking)\])")


def opens_turn(kind: Column, plain: Column, block_text: Column) -> Column:
    """Whether a message opens a turn: a user message with plain text, or with a text block that is not blank and does not
    start with an interruption notice."""
    real = (F.trim(block_text) != "") & ~block_text.startswith("[Request interrupted")
    return (kind == "user") & (plain.isNotNull() | F.coalesce(real, F.lit(False)))


def turns(messages: DataFrame) -> DataFrame:
    """Number the turns of each session (from 0): messages `session, uuid, type, content, at` gain `turn`.

    Messages before the first opening one are a turn of their own. Order is by time, then uuid.
    """
    top = shred_blocks(messages, "uuid", "content").filter("parent_path is null")
    first = top.filter("type = 'text'").groupBy(F.col("message_id").alias("uuid")).agg(F.min_by("text", F.col("block_path").cast("int")).alias("_text"))
    has = top.select(F.col("message_id").alias("uuid")).distinct().withColumn("_blocks", F.lit(True))
    m = messages.join(first, "uuid", "left").join(has, "uuid", "left")
    plain = F.when(F.col("_blocks").isNull() & F.col("content").isNotNull(), F.col("content"))
    w = Window.partitionBy("session").orderBy(F.asc_nulls_first("at"), "uuid")
    n = m.withColumn("_opens", opens_turn(F.col("type"), plain, F.col("_text")).cast("int")).withColumn("_n", F.sum(F.coalesce("_opens", F.lit(0))).over(w))
    lead = F.min("_n").over(Window.partitionBy("session"))
    return n.withColumn("turn", (F.col("_n") - F.least(lead, F.lit(1))).cast("int")).drop("_text", "_blocks", "_opens", "_n")


def tool_exchanges(messages: DataFrame) -> DataFrame:
    """Tool uses with their results: session, tool_use_id, name, input, use_uuid, result_uuid, result, is_error.

    Pairs share the id; of several results the first counts, of several uses the first; unanswered uses have no result.
    """
    b = shred_blocks(messages, "uuid", "content")
    m = messages.select("uuid", "session", "at")
    b = b.join(m.withColumnRenamed("uuid", "message_id"), "message_id")
    order = F.struct("at", "message_id", "block_path")
    use = b.filter("type = 'tool_use' and id is not null").groupBy("session", F.col("id").alias("tool_use_id")).agg(F.min_by(F.struct(F.col("message_id").alias("use_uuid"), "name", "input"), order).alias("u"))
    got = b.filter("type = 'tool_result' and tool_use_id is not null").groupBy("session", "tool_use_id").agg(F.min_by(F.struct(F.col("message_id").alias("result_uuid"), F.col("content").alias("result"), (F.col("is_error") == "true").alias("is_error")), order).alias("r"))
    return use.join(got, ["session", "tool_use_id"], "left").select("session", "tool_use_id", "u.*", "r.*")


def rendered_turns(numbered: DataFrame, thinking: bool = True, mode: str = "full") -> DataFrame:
    """session, turn, started, ended, text: the blocks of each turn in order under role and tool markers.

    Results are cut at 500 characters. Blank blocks are left out. Modes: `full`; `summary` names the tools used without
    their input and leaves thinking and results out; `code-focused` keeps of each text its fenced code alone (texts
    without any in full) and leaves thinking out.
    """
    if mode not in ("full", "summary", "code-focused"):
        raise ValueError(f"no such mode: {mode}")
    b = shred_blocks(numbered, "uuid", "content").filter("parent_path is null")
    if mode != "full":
        b = b.filter("type <> 'thinking'" + (" and type <> 'tool_result'" if mode == "summary" else ""))
    if mode == "summary":
        b = b.withColumn("input", F.lit(""))
    if mode == "code-focused":
        code = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)```.*?```"), 0), "\n\n")
        b = b.withColumn("text", F.when(code != "", code).otherwise(F.col("text")))
    tool = b.filter("type = 'tool_use'").groupBy("id").agg(F.min("name").alias("tool"))
    b = b.join(tool.withColumnRenamed("id", "_use"), F.col("tool_use_id") == F.col("_use"), "left")
    body = (
        F.when(F.col("type") == "thinking", F.when(F.lit(thinking), F.concat(F.lit("[Thinking]\n"), "thinking")))
        .when(F.col("type") == "tool_use", F.concat(F.lit("[Tool:"), F.coalesce("name", F.lit("?")), F.lit("]\n"), F.coalesce("input", F.lit(""))))
        .when(F.col("type") == "tool_result", F.concat(F.lit("[Result:"), F.coalesce("tool", F.lit("?")), F.lit("]\n"), F.substring(F.coalesce("content", F.lit("")), 1, RESULT_CHARS)))
    )
    parts = b.select(F.col("message_id").alias("uuid"), F.col("block_path").cast("int").alias("pos"), "type", body.alias("body"), "text")
    m = numbered.select("session", "turn", "uuid", "at", F.col("type").alias("role"), "content")
    mark = F.when(F.col("role") == "user", "[User]\n").otherwise("[Assistant]\n")
    blocks = m.join(parts.withColumnRenamed("type", "kind"), "uuid").select("session", "turn", "at", "uuid", "pos", F.when(F.col("kind") == "text", F.concat(mark, "text")).otherwise(F.col("body")).alias("part"))
    plain = m.join(parts.select("uuid").distinct(), "uuid", "left_anti").filter(F.col("role").isin("user", "assistant")).select("session", "turn", "at", "uuid", F.lit(0).alias("pos"), F.concat(mark, "content").alias("part"))
    every = blocks.unionByName(plain).filter(F.length(F.regexp_replace("part", r"^\[[^\]]*\]\n\s*", "")) > 0)
    g = every.groupBy("session", "turn").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(0)).alias("at"), "uuid", "pos", "part"))).alias("p"))
    return g.select("session", "turn", "started", "ended", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"))


def tokens(text: str) -> int:
    return -int(-len(text) // 3.5)


def split_text(text: str, most: int) -> list[str]:
    """Cut a text at section markers, then at blank lines, and refill the pieces greedily up to `most` tokens.

    A single paragraph above the limit stays whole.
    """

    def refill(parts: list[str]) -> list[str]:
        out: list[str] = []
        for p in parts:
            if out and tokens(out[-1] + "\n\n" + p) <= most:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return out

    pieces = []
    for s in _SECTION.split(text):
        pieces += [s] if tokens(s) <= most else [p for p in s.split("\n\n") if p.strip()]
    return refill([p for p in pieces if p.strip()])


def _pack_lengths(most: int):
    """Greedy packing on lengths alone, over rows sorted by session and turn: only the open chunk is held."""

    def run(frames):
        session, chunk, held = None, 0, None
        for f in frames:
            number, whole = np.zeros(len(f), np.int64), np.zeros(len(f), bool)
            for i, (s, n) in enumerate(zip(f["session"], f["n"].tolist())):
                if s != session:
                    session, chunk, held = s, 0, None
                fits = -int(-n // 3.5) <= most
                together = held is not None and fits and -int(-(held + 2 + n) // 3.5) <= most
                if held is not None and not together:
                    chunk += 1
                number[i], whole[i] = chunk, fits
                held = (held + 2 + n if together else n) if fits else None
                if not fits:
                    chunk += 1
            yield pd.DataFrame({"session": f["session"], "turn": f["turn"], "_chunk": number, "_whole": whole})

    return run


def chunk_turns(rendered: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Chunks of each session: session, piece (from 0), turn_indices, text, approx_tokens.

    Turns are packed greedily in order into chunks of at most `most` tokens, measured on the joined text; a turn above
    the limit is split, and all its pieces carry the turn. What goes where depends on lengths only, so the sequential step
    runs over (session, turn, length) in a stream, however long a session; texts are gathered chunk by chunk. Turns
    without text are left out; a session without any has no chunks.
    """
    r = materialise(rendered.filter("text is not null").select("session", "turn", "text"), "rendered")
    sizes = r.select("session", "turn", F.length("text").alias("n")).repartition("session").sortWithinPartitions("session", "turn")
    kind = dict(r.dtypes)
    placed = materialise(sizes.mapInPandas(_pack_lengths(most), f"session {kind['session']}, turn {kind['turn']}, _chunk long, _whole boolean"), "packed")
    j = r.join(placed, ["session", "turn"])
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    whole = j.filter("_whole").groupBy("session", "_chunk").agg(parts.alias("p"))
    whole = whole.select("session", "_chunk", F.lit(0).alias("_n"), F.transform("p", lambda x: x["turn"].cast("int")).alias("turn_indices"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))

    def cut(frames):
        for f in frames:
            rows = [(s, c, i, [t], p) for s, c, t, x in zip(f["session"], f["_chunk"], f["turn"], f["text"]) for i, p in enumerate(split_text(x, most))]
            yield pd.DataFrame(rows, columns=["session", "_chunk", "_n", "turn_indices", "text"])

    split = j.filter("not _whole").select("session", "_chunk", "turn", "text").mapInPandas(cut, f"session {kind['session']}, _chunk long, _n int, turn_indices array<int>, text string")
    pieces = materialise(whole.unionByName(split), "pieces")  # ranking reads its input twice
    ranked = rank_within(pieces, ["session"], ["_chunk", "_n"], "piece")
    return ranked.select("session", F.col("piece").cast("int").alias("piece"), "turn_indices", "text", F.ceil(F.length("text") / 3.5).cast("int").alias("approx_tokens"))


def session_state(exchanges: DataFrame) -> DataFrame:
    """Per session the files that its tools touched, its errors (200 characters each) and its outcomes."""
    path = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.path"))
    command = F.get_json_object("input", "$.command")
    outcome = F.array_compact(F.array(*[F.when(command.rlike(p), label) for label, p in OUTCOMES.items()]))
    e = exchanges.select("session", F.when(F.col("name").isin(*FILE_TOOLS), path).alias("file"), F.when(F.col("is_error"), F.struct(F.col("name").alias("tool"), F.substring("result", 1, 200).alias("message"))).alias("error"), outcome.alias("outcome"))
    return e.groupBy("session").agg(F.array_sort(F.collect_set("file")).alias("files_touched"), F.array_sort(F.collect_list("error")).alias("errors"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("outcome")))).alias("outcomes"))
