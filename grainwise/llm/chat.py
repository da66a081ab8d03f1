"""Chat formatting: fingerprints of nested field paths choose the mapping that turns a record's layout into turns.

A record's fingerprint is a hash of the sorted paths of the fields it fills, lists included. A mapping names the fields of a layout and
what turn each becomes; its fingerprints are computed from its own paths by the same hash, so a mapping is chosen by one lookup
and never by trying. Turns are then written in one template with a loss mask, and can be read back from what was written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from grainwise.llm.common import F

TURNS = "array<struct<role:string,text:string>>"
#: The template. A turn is OPEN, its role, HEAD, its text, CLOSE.
OPEN, HEAD, CLOSE = "<turn ", ">\n", "</turn>\n"
#: Characters formatted before a batch of rows is handed on.
HELD = 4 << 20


@dataclass(frozen=True)
class Turn:
    """One field that becomes one turn."""

    path: str
    role: str
    optional: bool = False


@dataclass(frozen=True)
class Turns:
    """A list of structs, one turn each; `roles` renames the layout's role names."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Mapping:
    """A layout. Optional fields may be missing from a record; without them the fingerprint is another of the same mapping."""

    name: str
    parts: tuple[Turn | Turns, ...]

    def paths(self) -> list[frozenset[str]]:
        """The sets of paths a record of this layout can fill. A list may fill any of its fields (texts may all be null)."""
        need, may = set(), []
        for p in self.parts:
            if isinstance(p, Turns):
                need.add(f"{p.path}[]")
                may += [{f"{p.path}[].{p.role}"}, {f"{p.path}[].{p.text}"}]
            elif p.optional:
                may.append({p.path})
            else:
                need.add(p.path)
        picks = (c for n in range(len(may) + 1) for c in combinations(may, n))
        return [frozenset(need.union(*pick)) for pick in picks]


_SHARE = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("chatgpt", "assistant"))
MAPPINGS = (
    Mapping("messages", (Turns("messages", "role", "content"),)),
    Mapping("conversations", (Turns("conversations", "from", "value", _SHARE),)),
    Mapping("dialog", (Turns("chat.turns", "speaker", "text", _SHARE),)),
    Mapping("system_messages", (Turn("system", "system"), Turns("messages", "role", "content"))),
    Mapping("prompt", (Turn("prompt", "user"), Turn("completion", "assistant"))),
    Mapping("prompt_response", (Turn("system_prompt", "system", True), Turn("prompt", "user"), Turn("response", "assistant"))),
    Mapping("question", (Turn("system_prompt", "system", True), Turn("question", "user"), Turn("response", "assistant"))),
    Mapping("instruction", (Turn("instruction", "user"), Turn("input", "user", True), Turn("output", "assistant"))),
)


def fingerprint_of(paths: Sequence[str] | frozenset[str]) -> str:
    """SHA-256 of the sorted paths, a line each."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def registry(mappings: Sequence[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Fingerprint to mapping. Two mappings of one fingerprint are an error, so the choice never depends on their order."""
    held: dict[str, Mapping] = {}
    for m in mappings:
        for paths in m.paths():
            mark = fingerprint_of(paths)
            if held.setdefault(mark, m) is not m:
                raise ValueError(f"{m.name} and {held[mark].name} have records of one fingerprint")
    return held


def _filled(at: Column, kind: T.DataType, path: str) -> list[tuple[str, Column]]:
    """(path, whether a record fills it) for the fields below `at`; a list fills a field when one of its elements does."""
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in _filled(at.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        inner, below = kind.elementType, f"{path}[]"
        found = [(below, at.isNotNull())]
        if isinstance(inner, (T.StructType, T.ArrayType)):
            def nth(i: int):
                return lambda e: _filled(e, inner, below)[i][1]

            names = [name for name, _ in _filled(F.lit(None).cast(inner), inner, below)]
            found += [(name, F.coalesce(F.exists(at, nth(i)), F.lit(False))) for i, name in enumerate(names)]
        return found
    return [(path, at.isNotNull())]


def schema_fingerprint(df: DataFrame, ignore: Sequence[str] = ()) -> Column:
    """The fingerprint of each row over all columns but `ignore`."""
    paths = [x for f in df.schema if f.name not in ignore for x in _filled(F.col(f"`{f.name}`"), f.dataType, f.name)]
    paths.sort(key=lambda x: x[0])
    marks = [F.when(filled, F.lit(path)) for path, filled in paths]
    return F.sha2(F.array_join(F.array_compact(F.array(*marks)), "\n") if marks else F.lit(""), 256)


def _has(schema: T.DataType, path: str) -> bool:
    for name in path.split("."):
        if isinstance(schema, T.ArrayType):
            schema = schema.elementType
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
    return True


def _said(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _turn_of(p: Turns, role_there: bool, text_there: bool):
    """How an element of a list becomes a turn; a field that no element has is empty."""
    def turn(e: Column) -> Column:
        role = _said(e.getField(p.role)) if role_there else F.lit("")
        for old, new in p.roles:
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), (_said(e.getField(p.text)) if text_there else F.lit("")).alias("text"))
    return turn


def _turns(schema: T.StructType, mapping: Mapping) -> Column | None:
    """The turns a mapping reads, or None where the table lacks its fields (no row can have its fingerprint then)."""
    out = []
    at = lambda path: F.col(".".join(f"`{n}`" for n in path.split(".")))
    for p in mapping.parts:
        if isinstance(p, Turns):
            if not _has(schema, p.path):
                return None
            out.append(F.transform(at(p.path), _turn_of(p, *[_has(schema, f"{p.path}.{n}") for n in (p.role, p.text)])))
        elif _has(schema, p.path):
            one = F.array(F.struct(F.lit(p.role).alias("role"), _said(at(p.path)).alias("text")))
            out.append(F.when(at(p.path).isNotNull(), one).otherwise(F.slice(one, 1, 0)))
        elif not p.optional:
            return None
    return F.concat(*out).cast(TURNS)


def canonical_turns(df: DataFrame, ignore: Sequence[str], mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """The `ignore` columns with `layout` (the mapping's name) and `turns` (role, text) for every record of `df`.

    Records are nested columns; a field a record lacks is null, as when files of several layouts are read as one table. Null roles
    and texts become empty. A record of an unknown fingerprint keeps its row with layout and turns null. A list of no turns fills no field
    of its elements and gives no turns. Columns that are no part of a record must stand in `ignore`.
    """
    by = registry(mappings)
    df = df.withColumn("__mark", schema_fingerprint(df, ignore))
    marks: dict[str, list[str]] = {}
    for mark, m in by.items():
        marks.setdefault(m.name, []).append(mark)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        read = _turns(df.schema, m)
        if read is not None:
            mine = F.col("__mark").isin(marks[m.name])
            layout, turns = F.when(mine, F.lit(m.name)).otherwise(layout), F.when(mine, read).otherwise(turns)
    return df.select(*[F.col(f"`{c}`") for c in ignore], layout.alias("layout"), turns.alias("turns"))


def escape(text: str) -> str:
    """The text with a backslash before each backslash and inside each start of a control string, so none can be met in it."""
    return re.sub(r"<(?=/?turn)", r"<\\", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """As `escape`, and a line feed never follows a closing bracket."""
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: Sequence[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (start, end in code points) of the escaped texts that carry loss: those of role `learn`."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}{HEAD}", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text. Escaped texts hold no control string, so each CLOSE ends a turn."""
    out = []
    for piece in formatted.split(CLOSE)[:-1]:
        role, _, text = piece.removeprefix(OPEN).partition(HEAD)
        out.append((unescape(role), unescape(text)))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_chats(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """(key, formatted, loss) for `df` (key long, turns): the template's text, and the spans of its code points that carry loss.

    No turns give an empty text and no span; null turns (an unknown layout) give null for both. One record is written by one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack():
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, _SPANS)], ["key", "formatted", "loss"])

        for b in batches:
            keys, texts, masks, held = [], [], [], 0
            for i in range(b.num_rows):
                turns = b.column(1)[i].as_py()
                text, spans = format_turns([(t["role"], t["text"]) for t in turns], learn) if turns is not None else (None, None)
                keys.append(b.column(0)[i].as_py())
                texts.append(text)
                masks.append(None if spans is None else [{"start": s, "end": e} for s, e in spans])
                held += len(text or "")
                if held >= HELD:
                    yield pack()
                    keys, texts, masks, held = [], [], [], 0
            if keys:
                yield pack()

    return df.select(F.col("key").cast("long"), "turns").mapInArrow(run, "key long, formatted string, loss array<struct<start:long,end:long>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a formatted text and its loss mask say, read from them alone."""
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            key, text, loss = (b.column(c)[i].as_py() for c in range(3))
            turns, sha, learnt, size = read_turns(text), hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                sha.update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"]:span["end"]])
                learnt.update(said.encode())
                size += len(said)
            rows.append((key, len(turns), sha.hexdigest(), size, learnt.hexdigest(), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def records(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as records in the layouts their turns fit, for `canonical_turns`.

    A user and an assistant turn are a prompt record, a system turn before them makes it a question record, all others are lists of
    messages. Turns go by `turn`, null first, then by role and text where turns tie; null roles and texts count as empty; rows of a null
    conv_id are one conversation. One conversation's texts are held by one task.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("content"))
    rows = (df.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list("t")).alias("t")))
    roles, said = F.col("t.role"), F.col("t.content")
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    led = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    pick = lambda case, i: F.when(case, F.get(said, F.lit(i)))
    message = lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    return rows.select(
        "conv_id", pick(pair, 0).alias("prompt"), pick(pair, 1).alias("completion"), pick(led, 0).alias("system_prompt"),
        pick(led, 1).alias("question"), pick(led, 2).alias("response"),
        F.when(~pair & ~led, F.transform("t", message)).alias("messages"))


#: Said by both turns of the added conversation: control strings, which must come back as they are.
ADDED, SAYS = -7, r"\### Assistant: </turn> ok"


def op11_chat(df: DataFrame) -> DataFrame:
    """Every conversation of `df` (conv_id, turn, role, text; other columns are ignored) and the added one, formatted and read back.

    Nulls, ties and repeated rows as in `records`; an empty table gives the added conversation alone.
    """
    own = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    more = df.sparkSession.createDataFrame([(ADDED, 0, "user", SAYS), (ADDED, 1, "assistant", SAYS)], own.schema)
    turns = canonical_turns(records(own.union(more)), ("conv_id",))
    formatted = format_chats(turns.select(F.col("conv_id").alias("key"), "turns"))
    return formatted.mapInArrow(
        _read_back, "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ).withColumnRenamed("key", "conv_id")


OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(i, r)),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
                + (length(text) - length(replace(text, '<turn', ''))) // 5 + (length(text) - length(replace(text, '</turn', ''))) // 6 AS body,
             length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, chr(10), ''))
                + (length(role) - length(replace(role, '<turn', ''))) // 5 + (length(role) - length(replace(role, '</turn', ''))) // 6 AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(head + body + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
