"""Chat formatting over prefix trees (operator 7).

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts every ``<``, any backslashes, ``|`` gets one more backslash, so no control
string can stand there and taking one backslash away restores the text.

Conversations that begin with the same turns share them: a node of the tree is a
turn after all turns before it, named by a hash chain.  Distinct conversations
are sorted by the names along their path, which is depth-first order, and dealt
to tasks by ranges of it, so a first turn common to a third of all conversations
is spread like any other.  A task writes *packs* of at most ``limit`` tokens (code
points; a longer conversation has a pack for itself): each node's tokens once,
depth-first, with

* ``position``: the position id of its first token, as in the conversation alone,
* ``attend``: the intervals of its ancestors' tokens, which with its own earlier
  tokens are all that its tokens attend to,
* ``loss``: the interval of the text, if the role is the assistant's.

Ancestors are written again where a pack ends between their descendants.

Null roles and texts are empty.  Turns are ordered by number, role and text; a
turn without a number comes first; a null id is a conversation like another.
Rows that repeat are turns that repeat; extra columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>"
LIMIT = 1 << 20
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    head, body = f"{START}{_role(role)}\n", escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    return [(_role_back(r), unescaped(t)) for r, t in _TURN.findall(text)]


def _named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        paths = []
        for turns in frame["turns"]:
            name, path = b"", []
            for t in turns:
                role = t["role"].encode()
                name = hashlib.blake2b(name + len(role).to_bytes(8, "big") + role + t["text"].encode(), digest_size=16).digest()
                path.append(name.hex())
            paths.append(path)
        yield pd.DataFrame({"conv": frame["conv"], "path": ["/".join(p) for p in paths], "leaf": [p[-1] for p in paths], "turns": frame["turns"]})


_PACKS = ("pack string, text string, nodes array<struct<start:int,end:int,parent:int,position:int,loss_start:int,loss_end:int,"
          "attend:array<struct<start:int,end:int>>>>, leaves array<struct<leaf:string,node:int>>")


class _Pack:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.nodes, self.leaves = 0, [], []
        self.stack: list[tuple[str, int]] = []  # (name, node) of the path written last

    def add(self, path: list[str], turns: list) -> None:
        shared = 0
        while shared < min(len(path), len(self.stack)) and self.stack[shared][0] == path[shared]:
            shared += 1
        del self.stack[shared:]
        for name, turn in zip(path[shared:], turns[shared:], strict=True):
            text, a, b = formatted(turn["role"], turn["text"])
            parent = self.stack[-1][1] if self.stack else -1
            up = self.nodes[parent] if self.stack else None
            attend = [dict(x) for x in up["attend"]] if up else []
            if up and attend and attend[-1]["end"] == up["start"]:
                attend[-1]["end"] = up["end"]
            elif up:
                attend.append({"start": up["start"], "end": up["end"]})
            loss = turn["role"] == "assistant"
            self.nodes.append({"start": self.size, "end": self.size + len(text), "parent": parent,
                               "position": up["position"] + up["end"] - up["start"] if up else 0,
                               "loss_start": self.size + a if loss else None, "loss_end": self.size + b if loss else None, "attend": attend})
            self.stack.append((name, len(self.nodes) - 1))
            self.parts.append(text)
            self.size += len(text)
        self.leaves.append({"leaf": path[-1], "node": self.stack[-1][1]})

    def row(self) -> dict:
        return {"pack": self.leaves[0]["leaf"], "text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


def packs(conversations: DataFrame, limit: int = LIMIT, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """The packs, and (conv, leaf): where each conversation ends in them."""
    rows = conversations.select(F.col(key).alias("conv"), F.col("turn").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select(
        "conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    named = written(whole.mapInPandas(_named, f"conv {kind}, path string, leaf string, turns array<struct<role:string,text:string>>"))
    distinct = named.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _Pack()
        for frame in frames:
            for path, turns in zip(frame["path"], frame["turns"], strict=True):
                if pack.leaves and pack.size + sum(len(t["text"]) + 40 for t in turns) > limit:
                    yield pd.DataFrame([pack.row()])
                    pack = _Pack()
                pack.add(path.split("/"), list(turns))
        if pack.leaves:
            yield pd.DataFrame([pack.row()])

    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.repartitionByRange(tasks, "path").sortWithinPartitions("path").select("path", "turns")
    return written(ordered.mapInPandas(build, _PACKS)), named.select("conv", "leaf")


_BACK = "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for text, nodes, leaves in zip(frame["text"], frame["nodes"], frame["leaves"], strict=True):
            out = []
            for end in leaves:
                path, node = [], int(end["node"])
                while node >= 0:
                    path.append(nodes[node])
                    node = int(nodes[node]["parent"])
                path.reverse()
                whole = "".join(text[n["start"] : n["end"]] for n in path)
                turns = parsed(whole)
                loss = "".join(unescaped(text[int(n["loss_start"]) : int(n["loss_end"])]) for n in path if not pd.isna(n["loss_start"]))
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((end["leaf"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _BACK.split(", ")])


def read_back(packed: DataFrame, ends: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from the packs."""
    read = packed.select("text", "nodes", "leaves").mapInPandas(_read_back, _BACK)
    return ends.join(read, "leaf").drop("leaf")
