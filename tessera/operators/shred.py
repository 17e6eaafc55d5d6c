"""Deeply nested message content to flat related tables, by columnar shredding.

Each message is a record with one repeated group, its blocks, that can hold further blocks in its `content`. Records
are striped into one column per leaf path (`type`, `content.type`, `content.content.text`, ...; the paths are those that
the data hold). A column is a sequence of values, each with a repetition level (at which repeated group of the path a
new entry starts) and a definition level (how much of the path is there, down to the leaf itself). The flat tables, and
the records themselves, are rebuilt from these level sequences alone, one table per repeated ancestor.

Defined cases: content that is null gives no blocks; JSON of an array of blocks, of one block, or a JSON string that
holds such JSON gives its blocks, an empty array none; anything else, damaged JSON and arrays without any object too,
is plain text. In an array, entries that are no objects keep their position and their value (the leaf `*`), but are no
blocks. Only an array in a block's `content` is descended into. The nesting depth is unbounded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import deep_json

#: The leaves with a column of their own in the table of blocks; every other leaf is kept in the map `extra`.
LEAVES = ("type", "text", "thinking", "id", "name", "input", "tool_use_id", "content", "is_error")
#: The leaf that holds an entry which is no object.
ENTRY = "*"
BLOCK_SCHEMA = "block_path string, parent_path string, nesting int, " + ", ".join(f"`{x}` string" for x in LEAVES) + ", extra map<string, string>"
LEAF_SCHEMA = "message_id string, block_path string, leaf_path string, repetition int, definition int, value string"
#: What JSON content can start with.
OPENS = r'^\s*[\[{"]'


def blocks_of(content: str | None) -> list | None:
    """The array of blocks that `content` is JSON of; None if it is plain text."""
    if not content:
        return None
    if content.lstrip()[:1] not in ("[", "{", '"'):
        return None
    try:
        v = deep_json.loads(content)
        if isinstance(v, str):
            if v.lstrip()[:1] not in ("[", "{"):
                return None
            v = deep_json.loads(v)
    except ValueError:
        return None
    if isinstance(v, dict):
        v = [v]
    if not isinstance(v, list) or v and not any(isinstance(b, dict) for b in v):
        return None
    return v


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else deep_json.dumps(v)


@dataclass
class Column:
    """One leaf path's values with their levels; `record` numbers the record that each belongs to.

    At depth d (from 0), repetition r means that the entry starts anew at depth r - 1 (0: a new record). Definition
    counts what is there: for each ancestor its array and its entry being a block, and last the leaf, so it is 2 d + 3
    for a leaf that is there, 2 d + 2 for a block without it, 2 d + 1 for an empty array or an entry that is no block, and
    less where the array is absent. (The leaf `*` has 2 d + 3 in the place of an entry that is no block.)
    """

    depth: int
    leaf: str
    record: list[int] = field(default_factory=list)
    repetition: list[int] = field(default_factory=list)
    definition: list[int] = field(default_factory=list)
    values: list = field(default_factory=list)

    @property
    def path(self) -> str:
        return "content." * self.depth + self.leaf


def stripe(records: list) -> list[Column]:
    """Stripe the records' block arrays into a column per leaf path, depth by depth (`type` first at each depth)."""
    out: list[Column] = []
    level = [(i, 0, b) for i, b in enumerate(records)]
    depth = 0
    while any(isinstance(a, list) and a for _, _, a in level):
        record: list[int] = []
        repetition: list[int] = []
        base: list[int] = []
        entries: list = []
        below = []
        for i, rep, array in level:
            if not isinstance(array, list) or not array:
                record.append(i)
                repetition.append(rep)
                base.append(2 * depth + isinstance(array, list))
                entries.append(None)
                below.append((i, rep, None))
                continue
            for j, b in enumerate(array):
                r = rep if j == 0 else depth + 1
                record.append(i)
                repetition.append(r)
                block = isinstance(b, dict)
                base.append(2 * depth + 1 + block)
                entries.append(b if block else {ENTRY: b})
                below.append((i, r, b.get("content") if block else None))
        leaves = dict.fromkeys(["type"])
        for b in entries:
            if b:
                leaves.update(dict.fromkeys(b))
        for leaf in leaves:
            c = Column(depth, leaf, record, repetition)
            for b, d in zip(entries, base):
                there = b is not None and leaf in b and (ENTRY not in b or leaf == ENTRY or d == 2 * depth + 2)
                v = b[leaf] if there else None
                if leaf == "content" and isinstance(v, list):  # the repeated group below, no leaf
                    there, v = False, None
                c.definition.append(2 * depth + 3 if there else d)
                c.values.append(v)
            out.append(c)
        level = below
        depth += 1
    return out


def positions(repetition: np.ndarray, depth: int) -> np.ndarray:
    """Rebuild each entry's zero-based positions (one column per repeated ancestor) from the repetition levels."""
    n = len(repetition)
    at = np.zeros((n, depth + 1), np.int64)
    for k in range(depth + 1):
        # the position at level k + 1 grows where an entry repeats there and restarts where an ancestor does
        grows = np.cumsum(repetition == k + 1)
        starts = repetition <= k
        base = np.maximum.accumulate(np.where(starts, grows, -1))
        at[:, k] = grows - base
    return at


def _paths(c: Column) -> list[str]:
    return [".".join(map(str, p)) for p in positions(np.asarray(c.repetition, np.int64), c.depth).tolist()]


def assemble(columns: list[Column], n: int) -> list:
    """The records' block arrays again, from the columns alone."""
    entries: dict[tuple, dict[int, object]] = {}  # per array (record and positions above it) its entries by position
    for c in columns:
        for i, d, v, p in zip(c.record, c.definition, c.values, positions(np.asarray(c.repetition, np.int64), c.depth).tolist()):
            if d <= 2 * c.depth:
                continue
            array = entries.setdefault((i, *p[:-1]), {})
            if d == 2 * c.depth + 3 and c.leaf == ENTRY and not isinstance(array.get(p[-1]), dict):
                array[p[-1]] = v
            elif d >= 2 * c.depth + 2:
                block = array.setdefault(p[-1], {})
                if d == 2 * c.depth + 3:
                    block[c.leaf] = v
    lists = {at: [by[k] for k in sorted(by)] for at, by in entries.items()}
    for at, found in lists.items():
        if len(at) > 1:
            entries[at[:-1]][at[-1]]["content"] = found
    return [lists.get((i,)) for i in range(n)]


def flatten(records: list) -> dict[str, list]:
    """All blocks of all records as flat columns, rebuilt from the levels."""
    out: dict[str, list] = {"record": [], "block_path": [], "parent_path": [], "nesting": [], **{x: [] for x in LEAVES}, "extra": []}
    by_depth: dict[int, list[Column]] = {}
    for c in stripe(records):
        by_depth.setdefault(c.depth, []).append(c)
    for depth, columns in by_depth.items():
        paths = _paths(columns[0])
        blocks = [i for i, d in enumerate(columns[0].definition) if d >= 2 * depth + 2]
        row = {i: k for k, i in enumerate(blocks)}
        extra: list[dict] = [{} for _ in blocks]
        known = {}
        for c in columns:
            if c.leaf in LEAVES:
                known[c.leaf] = c
            elif c.leaf != ENTRY:
                for i, d in enumerate(c.definition):
                    if d == 2 * depth + 3:
                        extra[row[i]][c.leaf] = _text(c.values[i])
        for i in blocks:
            out["record"].append(columns[0].record[i])
            out["block_path"].append(paths[i])
            out["parent_path"].append(paths[i].rpartition(".")[0] if depth else None)
            out["nesting"].append(depth)
        for x in LEAVES:
            c = known.get(x)
            out[x] += [_text(c.values[i]) for i in blocks] if c else [None] * len(blocks)
        out["extra"] += [list(e.items()) for e in extra]
    return out


_TEXT_MAP = pa.map_(pa.string(), pa.string())
_KINDS = {"nesting": pa.int32(), "extra": _TEXT_MAP, "repetition": pa.int32(), "definition": pa.int32()}


def _blocks(batches):
    for b in batches:
        ids, content = b.column(0), b.column(1).to_pylist()
        got = flatten([blocks_of(c) for c in content])
        which = got.pop("record")
        yield pa.RecordBatch.from_pydict({"message_id": ids.take(pa.array(which, pa.int64())), **{k: pa.array(v, _KINDS.get(k, pa.string())) for k, v in got.items()}})


def _leaves(batches):
    for b in batches:
        ids, content = b.column(0), b.column(1).to_pylist()
        out: dict[str, list] = {"record": [], "block_path": [], "leaf_path": [], "repetition": [], "definition": [], "value": []}
        for c in stripe([blocks_of(x) for x in content]):
            paths = _paths(c)
            for i, d in enumerate(c.definition):
                if d == 2 * c.depth + 3:
                    for k, v in zip(out, (c.record[i], paths[i], c.path, c.repetition[i], d, _text(c.values[i]))):
                        out[k].append(v)
        which = out.pop("record")
        yield pa.RecordBatch.from_pydict({"message_id": ids.take(pa.array(which, pa.int64())), **{k: pa.array(v, _KINDS.get(k, pa.string())) for k, v in out.items()}})


def _plain(batches):
    for b in batches:
        parsed = [blocks_of(c) for c in b.column("content").to_pylist()]
        keep = [n for n in b.schema.names if n != "content"]
        kept = b.column("content").to_pylist()
        yield pa.RecordBatch.from_pydict({n: b.column(n) for n in keep} | {"plain_text": pa.array([c if p is None else None for c, p in zip(kept, parsed)], pa.string()), "n_blocks": pa.array([sum(isinstance(x, dict) for x in p or ()) for p in parsed], pa.int32())})


def _source(messages: DataFrame, message_id: str, content: str) -> DataFrame:
    return messages.select(F.col(message_id).cast("string").alias("message_id"), F.col(content).alias("content")).filter(F.col("content").rlike(OPENS))


def shred_blocks(messages: DataFrame, message_id: str, content: str) -> DataFrame:
    """The flat table of all blocks: message_id, block_path, parent_path (null at the top), nesting, the leaves of LEAVES
    and `extra` (every other leaf that is there, by name). Values that are no strings are given as JSON."""
    return _source(messages, message_id, content).mapInArrow(_blocks, "message_id string, " + BLOCK_SCHEMA)


def shred_leaves(messages: DataFrame, message_id: str, content: str) -> DataFrame:
    """Every leaf that is there, in long form: message_id, block_path, leaf_path, its levels and value."""
    return _source(messages, message_id, content).mapInArrow(_leaves, LEAF_SCHEMA)


def split_plain(messages: DataFrame, content: str = "content") -> DataFrame:
    """`messages` with `content` replaced by `plain_text` (null where the content gives blocks) and `n_blocks` at the top."""
    src = messages.withColumnRenamed(content, "content") if content != "content" else messages
    kept = ", ".join(f"`{n}` {t}" for n, t in src.dtypes if n != "content")
    return src.mapInArrow(_plain, f"{kept}, plain_text string, n_blocks int")
