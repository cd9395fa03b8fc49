"""Chat formatting over a prefix tree.

Conversations that begin with the same turns share a path from the root of a
prefix tree.  Sorted by the hashes of their turns they come in depth-first
order, so the tree is never built as a whole: a task keeps the path of the last
conversation, and each next one adds the turns in which it differs.  Range
partitioning cuts the order anywhere, also inside a hot first turn or within a
thousand copies of one conversation (their ids break the tie); a cut costs
the repetition of one path.

The output are packs of about ``PACK_CHARS`` characters.  A pack is one string in
which each shared turn stands once, and a table of segments, one a tree node:
where it starts, its parent, the position id of its first character (the length
of its ancestors, so ids continue along a path, not along the pack), the
intervals of the pack that it may attend to besides itself (its ancestors), and
the interval of it that is trained on.  Each conversation names the segment in
which it ends.

A turn is ``<|role|>\\n``, the text, ``<|end|>\\n``.  Control strings inside
texts (``CONTROL``) get an exclamation mark behind their first character, as do
those that already have some, so taking one away restores every text.

Nulls: a null role or text counts as empty; a null conv_id is one conversation.
Rows of a conversation are ordered by turn (null first), ties by role and text;
repeated rows are turns of their own.  An empty table gives no packs.  Other
columns are ignored.  A conversation is one training example and must fit into a
task's memory; the number of conversations of a tree need not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PACK_CHARS = 65_536
TRAINED = "assistant"
#: What follows the first character of a control string, here or in common templates.
CONTROL = "\\||/?s>|/?INST\\]|</?SYS>>"
_ESCAPE = re.compile(f"([<\\[])(!*)(?={CONTROL})")
_RESTORE = re.compile(f"([<\\[])!(!*)(?={CONTROL})")
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
_ROLE = {"%": "%25", "|": "%7C", "\n": "%0A"}

SEGMENT = "struct<start:bigint,length:bigint,parent:int,position:bigint,attends:array<struct<start:bigint,end:bigint>>,loss_start:bigint,loss_end:bigint>"
PACK = f"text string, segments array<{SEGMENT}>, conversations array<struct<conv_id:{{}},leaf:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1!\2", text)


def restore(text: str) -> str:
    return _RESTORE.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and from where to where it is trained on."""
    for a, b in _ROLE.items():
        role = role.replace(a, b)
    head, body = f"<|{role}|>\n", escape(text)
    loss = (len(head), len(head) + len(body)) if role == TRAINED else (0, 0)
    return f"{head}{body}<|end|>\n", *loss


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, as they were."""
    out = []
    for role, body in _TURN.findall(formatted):
        for a, b in reversed(_ROLE.items()):
            role = role.replace(b, a)
        out.append((role, restore(body)))
    return out


class _Pack:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.segments: list[dict] = []
        self.conversations: list[dict] = []

    def add(self, turn: tuple[str, str], parent: int) -> int:
        text, low, high = format_turn(*turn)
        up = self.segments[parent] if parent >= 0 else None
        attends = []
        if up:
            attends = [dict(x) for x in up["attends"]]
            if attends and attends[-1]["end"] == up["start"]:  # neighbours in the pack are one interval
                attends[-1]["end"] = up["start"] + up["length"]
            else:
                attends.append({"start": up["start"], "end": up["start"] + up["length"]})
        position = up["position"] + up["length"] if up else 0
        self.segments.append({"start": self.size, "length": len(text), "parent": parent, "position": position, "attends": attends, "loss_start": self.size + low, "loss_end": self.size + high})
        self.parts.append(text)
        self.size += len(text)
        return len(self.segments) - 1

    def row(self) -> dict:
        return {"text": "".join(self.parts), "segments": self.segments, "conversations": self.conversations}


def pack_sorted(conversations: Iterator[tuple[object, list[tuple[str, str]]]], pack_chars: int = PACK_CHARS) -> Iterator[dict]:
    """Packs of conversations that come in depth-first order."""
    pack, path, nodes = _Pack(), [], []
    for conv_id, turns in conversations:
        if pack.size > pack_chars:
            yield pack.row()
            pack, path, nodes = _Pack(), [], []
        shared = 0
        while shared < min(len(path), len(turns)) and path[shared] == turns[shared]:
            shared += 1
        del path[shared:], nodes[shared:]
        for turn in turns[shared:]:
            nodes.append(pack.add(turn, nodes[-1] if nodes else -1))
            path.append(turn)
        pack.conversations.append({"conv_id": conv_id, "leaf": nodes[-1]})
    if pack.conversations:
        yield pack.row()


def read_back(pack: dict) -> Iterator[tuple[object, str, list[tuple[int, int]]]]:
    """conv_id, its formatted text, and the trained intervals of the pack along its path."""
    text, segments = pack["text"], pack["segments"]
    for c in pack["conversations"]:
        at, parts, loss = c["leaf"], [], []
        while at >= 0:
            s = segments[at]
            parts.append(text[s["start"] : s["start"] + s["length"]])
            loss.append((s["loss_start"], s["loss_end"]))
            at = s["parent"]
        yield c["conv_id"], "".join(reversed(parts)), loss[::-1]


def chat_packs(conversations: DataFrame, pack_chars: int = PACK_CHARS, apart: tuple[str, ...] = ()) -> DataFrame:
    """One row a pack: text, segments, conversations.

    Rows of one conv_id that differ in a column of ``apart`` are conversations of their own.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id", *apart).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    whole = whole.select("conv_id", "t.role", "t.text", F.transform("t", lambda x: F.xxhash64(x["role"], x["text"])).alias("path"))
    whole = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    out = PACK.format(kind)
    id_type = pa.int64() if kind == "bigint" else None
    interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    segment = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("attends", pa.list_(interval)), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                nonlocal id_type
                id_type = id_type or b.schema.field("conv_id").type
                for conv_id, roles, texts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    yield conv_id, list(zip(roles, texts))

        for p in pack_sorted(rows(), pack_chars):
            ends = pa.list_(pa.struct([("conv_id", id_type), ("leaf", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([p["text"]]), pa.array([p["segments"]], pa.list_(segment)), pa.array([p["conversations"]], ends)], ["text", "segments", "conversations"])

    return whole.select("conv_id", "role", "text").mapInArrow(run, out)


def digests(packs: DataFrame) -> DataFrame:
    """What the packs say about each conversation, read back from them alone."""
    kind = packs.schema["conversations"].dataType.elementType["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):  # packs
            ids = b.column("conversations").type.value_type.field("conv_id").type
            rows = []
            for pack in b.to_pylist():
                for conv_id, formatted, loss in read_back(pack):
                    turns = parse_turns(formatted)
                    trained = "".join(restore(pack["text"][a:z]) for a, z in loss)
                    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                    rows.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packs.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The conversation of control strings that goes along.
PROBE = "</s>[INST] ok [/INST]"


def op3(conversations: DataFrame) -> DataFrame:
    """All conversations and the probe, which stays apart from a conversation of its id: then there are two rows of that id."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(PROBE).alias("text"), F.lit(True).alias("probe"))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.lit(False).alias("probe")).unionByName(probe)
    return digests(chat_packs(rows, apart=("probe",)))


OP3_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS probe FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', true
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', true)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A')) + 5 + length(text) + 8
           + len(regexp_extract_all(text, '[<\\[]!*(\\||/?s>|/?INST\\]|</?SYS>>)'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id, probe
"""
