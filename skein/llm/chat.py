"""Chat formatting over prefix trees.

A conversation is formatted turn by turn as ``### role: text</turn>`` and a newline;
control strings in roles and texts are escaped by a backslash. Conversations that
share initial turns are merged into a tree; a pack emits every node once, depth first,
with the position of its first token along its own path, and the intervals of the pack
that its ancestors take: what it may attend to besides itself. Tokens are code points.

Equal conversations are one path before packing. A pack holds a bounded number of
paths: a first turn that very many conversations share is dealt over several packs, by
second turn where that is enough, each of which emits the shared turns once: shared turns
are emitted once a pack, not once in all. Reading back checks a leaf's position ids.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.runtime import prepare, stage

#: The template: fixed strings, and what a backslash escapes in texts and in roles.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
_TEXT, _ROLE = re.compile(r"\\|</turn>|###"), re.compile(r"\\|</turn>|###|:")
_ESCAPED = re.compile(r"\\(\\|</turn>|###|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|</turn>|###|:))*+): ((?:[^\\<]|<(?!/turn>)|\\(?:\\|</turn>|###|:))*+)</turn>\n", re.S)
LEARN = "assistant"
PACK_PATHS = 64

_NODE = "start: int, end: int, position: int, parent: int, learn_start: int, learn_end: int, ancestors: array<struct<start: int, end: int>>"
PACK_SCHEMA = f"pack string, text string, nodes array<struct<{_NODE}>>, leaves array<struct<path: string, node: int>>"


def escape(text: str) -> str:
    return _TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its text begins."""
    head = OPEN + _ROLE.sub(lambda m: "\\" + m[0], role) + SEP
    return head + escape(text) + CLOSE, len(head)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def pack(paths: list[tuple[str, list[tuple[str, str]]]]) -> tuple[str, list[dict], list[dict]]:
    """Text, nodes and leaves of a pack of (name, turns) with names of their own: nodes depth first, shared turns once.

    A node's ancestors are merged intervals of the text in order; with its own interval they are its conversation so far.
    """
    text: list[str] = []
    nodes: list[dict] = []
    leaves: list[dict] = []
    size = 0
    path: list[int] = []
    before: list[tuple[str, str]] = []
    for name, turns in sorted(paths, key=lambda p: p[1]):
        shared = 0
        while shared < min(len(before), len(turns)) and before[shared] == turns[shared]:
            shared += 1
        del path[shared:]
        for role, said in turns[shared:]:
            formatted, head = format_turn(role, said)
            parent = path[-1] if path else -1
            up = nodes[parent] if path else None
            spans = [dict(s) for s in up["ancestors"]] if up else []
            if up:
                if spans and spans[-1]["end"] == up["start"]:
                    spans[-1]["end"] = up["end"]
                else:
                    spans.append({"start": up["start"], "end": up["end"]})
            learn = (size + head, size + len(formatted) - len(CLOSE)) if role == LEARN else (-1, -1)
            path.append(len(nodes))
            nodes.append({"start": size, "end": size + len(formatted), "position": up["position"] + up["end"] - up["start"] if up else 0, "parent": parent, "learn_start": learn[0], "learn_end": learn[1], "ancestors": spans})
            text.append(formatted)
            size += len(formatted)
        before = turns
        leaves.append({"path": name, "node": path[-1]})
    return "".join(text), nodes, leaves


def unpack(text: str, nodes: list[dict], leaf: int) -> tuple[str, list[str]]:
    """A leaf's formatted conversation by its attention intervals, and the texts under its loss mask, still escaped."""
    node = nodes[leaf]
    if node["position"] != sum(s["end"] - s["start"] for s in node["ancestors"]):
        raise ValueError(f"position ids of node {leaf} don't follow its ancestors")
    formatted = "".join([text[s["start"] : s["end"]] for s in [*node["ancestors"], node]])
    learnt, at = [], leaf
    while at >= 0:
        if nodes[at]["learn_start"] >= 0:
            learnt.append(text[nodes[at]["learn_start"] : nodes[at]["learn_end"]])
        at = nodes[at]["parent"]
    return formatted, learnt[::-1]


def position_ids(nodes: list[dict]) -> list[int]:
    """The position of every token of a pack along its own path."""
    return [n["position"] + k for n in nodes for k in range(n["end"] - n["start"])]


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    paths = [(p, [(t["role"], t["text"]) for t in turns]) for p, turns in zip(pdf["path"], pdf["turns"], strict=True)]
    text, nodes, leaves = pack(paths)
    return pd.DataFrame({"pack": [f"{pdf['first'].iloc[0]}-{pdf['shard'].iloc[0]}"], "text": [text], "nodes": [nodes], "leaves": [leaves]})


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (a hash of all turns) and turns (array of role, text in order) of every conversation.

    Rows of a conversation go by turn (null first), then role, then text; null roles and texts are empty.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return convs.withColumn("path", F.sha2(F.to_json("turns"), 256))


def packs(distinct: DataFrame, pack_paths: int = PACK_PATHS) -> DataFrame:
    """pack, text, nodes, leaves of the prefix trees over distinct paths (path, turns)."""
    prepare(distinct.sparkSession)
    rows = distinct.withColumn("first", F.sha1(F.to_json(F.slice("turns", 1, 1)))).withColumn("second", F.sha1(F.to_json(F.slice("turns", 1, 2))))
    by_second = rows.groupBy("first", "second").agg(F.count("*").alias("c2"))
    many = by_second.groupBy("first").agg(F.sum("c2").alias("c1")).where(F.col("c1") > pack_paths)
    crowd = stage(by_second.join(many, "first"), "chat-crowd")  # of shared first turns only
    rows = rows.join(crowd, ["first", "second"], "left")
    spread = lambda c, key: F.pmod(F.xxhash64(key), F.ceil(F.col(c) / pack_paths))
    shard = F.when(F.col("c1").isNull(), F.lit("0")).when(F.col("c2") > pack_paths, F.concat_ws("-", "second", spread("c2", "path"))).otherwise(spread("c1", "second").cast("string"))
    rows = rows.select("first", shard.alias("shard"), "path", "turns")
    return rows.groupBy("first", "shard").applyInPandas(_pack_group, PACK_SCHEMA)


def _read(batches):
    names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
    for b in batches:
        for text, nodes, leaves in zip(*(b.column(c).to_pylist() for c in ("text", "nodes", "leaves")), strict=True):
            rows = []
            for leaf in leaves:
                formatted, learnt = unpack(text, nodes, leaf["node"])
                turns, loss = parse_turns(formatted), "".join(map(unescape, learnt))
                rows.append((leaf["path"], len(turns), sha("".join([f"{r}\n{t}\n" for r, t in turns])), len(loss), sha(loss), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def digests(packed: DataFrame) -> DataFrame:
    """path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every path, read back from packs."""
    return packed.mapInArrow(_read, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(turns: DataFrame) -> DataFrame:
    """conv_id and the digests of every conversation, formatted into packs and read back from them.

    Repeated rows are turns of their own; a null conv_id is a conversation of its own; texts of any length are one node each;
    further columns are not read. No rows give no rows.
    """
    convs = stage(paths(turns), "chat-paths")
    distinct = convs.groupBy("path").agg(F.first("turns").alias("turns"))
    read = digests(stage(packs(distinct), "chat-packs"))
    return convs.select("conv_id", "path").join(stage(read, "chat-read"), "path").drop("path")
