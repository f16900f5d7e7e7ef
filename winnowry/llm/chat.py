"""Chat formatting: conversations that share their first turns are merged into prefix trees.

Sorted by their turns, conversations come in the depth-first order of their tree: the turns a
conversation shares with the one before are already written.  A pack is one written text with
its nodes (one for each turn), the position id each node starts at (those inside it follow by one), the
intervals of the text that it may attend to, which are its ancestors' and its own, its loss span, and the
conversations that end in it.  All are counted in characters of the text.  A pack is closed
before it would pass ``PACK_CHARS`` characters or ``PACK_LEAVES`` conversations, as it is one training
sequence; the next one writes the turns that its first conversation shares with the one before again, once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_CHARS = 1 << 18
PACK_LEAVES = 1 << 12

#: The template's marks. Texts may hold these and other templates' control strings.
START, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"(<)(\\*){}(\||/?s>|</?SYS>>)|(\[)(\\*){}(/?INST\])"
_PLAIN = re.compile(_CONTROL.format("", ""))
_MARKED = re.compile(_CONTROL.format(r"\\", r"\\"))


def escape(text: str) -> str:
    """Puts a backslash after the first sign of every control string, so that none is left."""
    return _PLAIN.sub(lambda m: f"{m[1] or m[4]}{m[2] or m[5] or ''}\\{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    """The exact inverse of ``escape``."""
    return _MARKED.sub(lambda m: f"{m[1] or m[4]}{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn as written, and where its text begins and ends."""
    head = f"{START}{escape(role)}{SEP}"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


_TURNS = "conv_id long, keys array<binary>, roles array<string>, texts array<string>"
_PACK = (
    "text string, nodes array<struct<start:int,end:int,position:int,parent:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, "
    "leaves array<struct<conv_id:bigint,node:int>>"
)
_span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_node = pa.struct([*((n, pa.int32()) for n in ("start", "end", "position", "parent", "loss_start", "loss_end")), ("attends", pa.list_(_span))])
_leaf = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from rows sorted by conversation and turn."""
    conv: object = batches  # no conversation is equal to this
    keys, roles, texts, out = [], [], [], []

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "keys", "roles", "texts"])

    for batch in batches:
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if keys and c != conv:
                out.append((conv, keys, roles, texts))
                keys, roles, texts = [], [], []
                if len(out) >= 500:
                    yield rows()
                    out = []
            conv = c
            role, text = role or "", text or ""
            keys.append(hashlib.md5(f"{len(role)}|{role}{text}".encode("utf-8", "surrogatepass")).digest())
            roles.append(role)
            texts.append(text)
    if keys:
        out.append((conv, keys, roles, texts))
    if out:
        yield rows()


def attending(before: list[dict[str, int]], start: int, end: int) -> list[dict[str, int]]:
    """Intervals that a node may attend to: its parent's and its own, joined where they touch."""
    if before and before[-1]["end"] == start:
        return [*before[:-1], {"start": before[-1]["start"], "end": end}]
    return [*before, {"start": start, "end": end}]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs from conversations sorted by their turns: a depth-first walk with a stack of nodes."""
    path: list[tuple[bytes, int]] = []  # key and node of each turn of the conversation before
    parts: list[str] = []
    nodes: list[dict] = []
    leaves: list[dict[str, int]] = []
    size = 0

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(["".join(parts)]), pa.array([nodes], pa.list_(_node)), pa.array([leaves], pa.list_(_leaf))], names=["text", "nodes", "leaves"]
        )

    for batch in batches:
        for conv, keys, roles, texts in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "keys", "roles", "texts")), strict=True):
            shared = 0
            while shared < min(len(path), len(keys)) and path[shared][0] == keys[shared]:
                shared += 1
            new = [render(r, t) for r, t in zip(roles[shared:], texts[shared:], strict=True)]
            if leaves and (size + sum(len(x[0]) for x in new) > PACK_CHARS or len(leaves) >= PACK_LEAVES):
                yield pack()
                path, parts, nodes, leaves, size, shared = [], [], [], [], 0, 0
                new = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            del path[shared:]
            for key, role, (written, a, b) in zip(keys[shared:], roles[shared:], new, strict=True):
                parent = path[-1][1] if path else -1
                position = nodes[parent]["position"] + nodes[parent]["end"] - nodes[parent]["start"] if path else 0
                loss = (size + a, size + b) if role == "assistant" else (size, size)
                attends = attending(nodes[parent]["attends"] if path else [], size, size + len(written))
                nodes.append({
                    "start": size, "end": size + len(written), "position": position, "parent": parent,
                    "loss_start": loss[0], "loss_end": loss[1], "attends": attends,
                })
                path.append((key, len(nodes) - 1))
                parts.append(written)
                size += len(written)
            leaves.append({"conv_id": conv, "node": path[-1][1]})
    if leaves:
        yield pack()


def format_conversations(rows: DataFrame) -> DataFrame:
    """Packs (text, nodes, leaves) of all conversations (conv_id, turn, role, text).

    Defined cases: null text or role counts as empty; turns go by number, null first, ties by
    role and text; rows of a null conv_id are one conversation; equal conversations share one
    leaf node; very long turns are written whole, in a pack of their own if need be; other
    columns are not read; no rows give no rows.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    convs = (
        turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text").mapInArrow(_gather, _TURNS)
    )
    # an offset by conversation lets one very common conversation be dealt to several ranges
    ranged = convs.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    return ranged.mapInArrow(_pack, _PACK)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _READ.split(", ")]
    for batch in batches:
        for text, nodes, leaves in zip(*(batch.column(n).to_pylist() for n in ("text", "nodes", "leaves")), strict=True):
            known: dict[int, tuple] = {}
            out = []
            for leaf in leaves:
                node = leaf["node"]
                if node not in known:
                    whole = "".join(text[x["start"] : x["end"]] for x in nodes[node]["attends"])
                    turns = [t.split(SEP, 1) for t in whole.removeprefix(START).removesuffix(END).split(END + START)]
                    said = "".join(f"{unescape(r)}\n{unescape(t)}\n" for r, t in turns)
                    masked, at = [], node
                    while at >= 0:
                        masked.append(unescape(text[nodes[at]["loss_start"] : nodes[at]["loss_end"]]))
                        at = nodes[at]["parent"]
                    loss = "".join(reversed(masked))
                    known = {node: (len(turns), sha(said), len(loss), sha(loss), len(whole))}
                out.append((leaf["conv_id"], *known[node]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_back(packs: DataFrame) -> DataFrame:
    """Each conversation as read from the packs: its turns, the text under its loss mask, its length."""
    return packs.select("text", "nodes", "leaves").mapInArrow(_read, _READ)
