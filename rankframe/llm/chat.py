"""Chat formatting by schema fingerprints.

The nested field paths of a record (``messages[].role``) are hashed into a
fingerprint; the fingerprint selects a declarative ``Mapping`` that says which
paths hold the turns. Only paths that some mapping names count, so other
additional fields never change a fingerprint. Three families are covered:

* *turn rows*: typed columns, one row per turn (conversation, order, role, text);
* *message lists*: JSON records with an array of role / content objects;
* *flat records*: prompt / completion and instruction / input / output fields.

``canonical_turns`` turns records of any of them into rows (conv_id, turn,
role, text); ``format_turns`` gives every turn its segment of the training
string together with the loss mask. Concatenating the segments of a
conversation in order gives its whole training string; no operator gathers a
conversation, so its length is not bounded by a task's memory.

Defined cases: null text or role is empty; a record whose fingerprint no
mapping knows yields no turn and is returned by ``unmapped``; a record with
an empty message list has no turns; repeated rows are repeated turns;
turns tie-break by role, then text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ------------------------------------------------------------------ template
@dataclass(frozen=True)
class Template:
    """Markers around a turn. Each starts with ``<|``; in texts and roles every
    ``<``, ``[`` and backslash is followed by one more backslash, so neither a
    marker nor any other control string that starts with ``<`` or ``[``
    survives inside a text, and taking the backslash away restores it."""
    turn: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>\n"
    loss_role: str = "assistant"


DEFAULT = Template()
_ESCAPE = r"([<\[\\])"
_UNESCAPE = r"([<\[\\])\\"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1")


# ------------------------------------------------------- schema fingerprints
@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``required`` and ``optional`` are field paths (``a.b``, ``list[].x``).
    ``turns`` lists (role, path) for flat records; for message lists
    ``items`` is the list's path and ``role`` / ``text`` are paths inside it;
    for turn rows ``role`` / ``text`` / ``order`` are columns.
    """
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


# --- fixed values: public layouts of instruction and chat data --------------------
_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"),
             ("model", "assistant"), ("prompter", "user"))
MAPPINGS = (
    Mapping("turn_rows", ("turn", "role", "text"),
            role="role", text="text", order="turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), items="messages",
            role="role", text="content", roles=_SPEAKERS),
    Mapping("conversations", ("conversations[].from", "conversations[].value"),
            items="conversations", role="from", text="value", roles=_SPEAKERS),
    Mapping("dialog", ("dialog[].speaker", "dialog[].text"), items="dialog",
            role="speaker", text="text", roles=_SPEAKERS),
    Mapping("instruction", ("instruction", "output"), ("input", "system"),
            turns=(("system", ("system",)), ("user", ("instruction", "input")),
                   ("assistant", ("output",)))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",),
            turns=(("system", ("system",)), ("user", ("prompt",)),
                   ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), ("system",),
            turns=(("system", ("system",)), ("user", ("prompt",)),
                   ("assistant", ("response",)))),
    Mapping("nested_prompt", ("data.prompt.text", "data.reply.text"),
            turns=(("user", ("data.prompt.text",)), ("assistant", ("data.reply.text",)))),
    Mapping("question_answer", ("question", "answer"), ("context",),
            turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)
# --- end of fixed values ------------------------------------------------------------


def fingerprint_of(paths: Iterable[str]) -> str:
    """Hash of the set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def vocabulary(mappings: Iterable[Mapping]) -> frozenset[str]:
    return frozenset(p for m in mappings for p in m.required + m.optional)


def fingerprint_table(mappings: Iterable[Mapping]) -> dict[str, Mapping]:
    """fingerprint → mapping, one entry for each choice of optional paths."""
    out: dict[str, Mapping] = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for extra in itertools.combinations(m.optional, n):
                key = fingerprint_of(m.required + extra)
                if out.setdefault(key, m) is not m:
                    raise ValueError(f"{m.name} and {out[key].name} share a layout")
    return out


class Mappings:
    """Selects the mapping of a layout by its fingerprint. Where fields of
    several layouts stand together the fingerprint is new: then the mapping
    with the most required paths present is taken, the first listed of equals,
    and remembered for that fingerprint."""

    def __init__(self, mappings: Iterable[Mapping]):
        self.listed = tuple(mappings)
        self.words = vocabulary(self.listed)
        self.known: dict[str, Mapping | None] = dict(fingerprint_table(self.listed))

    def select(self, paths: Iterable[str]) -> tuple[str, Mapping | None]:
        own = {p for p in paths if p in self.words}
        fp = fingerprint_of(own)
        if fp not in self.known:
            fitting = [m for m in self.listed if own.issuperset(m.required)]
            self.known[fp] = max(fitting, key=lambda m: len(m.required), default=None)
        return fp, self.known[fp]


def json_paths(value, prefix: str = "") -> Iterator[str]:
    """Leaf paths of a JSON value; array positions are written as []."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from json_paths(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list):
        for v in value:
            yield from json_paths(v, prefix + "[]")
    elif prefix:
        yield prefix


def schema_paths(kind: T.DataType, prefix: str = "") -> Iterator[str]:
    """Leaf paths of a Spark type, written like those of JSON."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, prefix + "[]")
    else:
        yield prefix


def _at(value, path: str):
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _as_text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _turns(record, m: Mapping) -> list[tuple[str, str]]:
    roles = dict(m.roles)
    if m.items:
        return [(roles.get(r := _as_text(_at(x, m.role)), r), _as_text(_at(x, m.text)))
                for x in _at(record, m.items) or []]
    out = []
    for role, paths in m.turns:
        found = [_as_text(v) for p in paths if (v := _at(record, p)) is not None]
        if found and (role != "system" or any(found)):
            out.append((role, "\n".join(x for x in found if x)))
    return out


_JSON_SCHEMA = "conv_id long, fingerprint string, layout string, turn long, role string, text string"


def _json_rows(mappings: tuple[Mapping, ...]):
    layouts = Mappings(m for m in mappings if not m.order)  # turn rows come as typed columns

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, raw in zip(batch["conv_id"], batch["record"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                try:
                    record = json.loads(raw)
                except (TypeError, ValueError):
                    record = None
                fp, m = layouts.select(json_paths(record))
                if m is None:
                    out.append((conv, fp, None, None, None, None))
                else:
                    out += [(conv, fp, m.name, i, r, t) for i, (r, t) in enumerate(_turns(record, m))]
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "fingerprint", "layout", "turn",
                                                 "role", "text"]).astype(
                    {"conv_id": "Int64", "turn": "Int64"})
    return rows


def canonical_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of JSON ``record`` strings with their ``conv_id``; a record
    without a known layout gives one row with a null layout."""
    return records.select(F.col("conv_id").cast("long"), F.col("record").cast("string")) \
        .mapInPandas(_json_rows(mappings), _JSON_SCHEMA)


def canonical_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) from any known layout.

    With a ``record`` column each row is a JSON document and is fingerprinted
    by itself; otherwise the fingerprint is that of the table's columns.
    """
    if "record" in df.columns:
        return (canonical_records(df, mappings).filter(F.col("layout").isNotNull())
                .select("conv_id", "turn", "role", "text"))
    _, m = Mappings(mappings).select(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(df.schema))}")
    if m.order:
        return df.select(F.col("conv_id").cast("long").alias("conv_id"),
                         F.col(m.order).cast("long").alias("turn"),
                         F.coalesce(F.col(m.role), F.lit("")).alias("role"),
                         F.coalesce(F.col(m.text), F.lit("")).alias("text"))
    packed = df.select(F.col("conv_id").cast("long"),
                       F.to_json(F.struct(*[c for c in df.columns if c != "conv_id"])).alias("record"))
    return canonical_turns(packed, mappings)


def unmapped(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Number of records for each fingerprint that no mapping knows."""
    return (canonical_records(records, mappings).filter(F.col("layout").isNull())
            .groupBy("fingerprint").agg(F.count("*").alias("records")))


# ---------------------------------------------------------------- formatting
def format_turns(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One segment of the training string per turn.

    Adds ``formatted`` and the loss mask as ``loss_start`` / ``loss_end``
    (code points inside the segment; equal when the turn is not learned).
    """
    role = escape(F.coalesce(F.col("role"), F.lit("")))
    text = escape(F.coalesce(F.col("text"), F.lit("")))
    head = F.concat(F.lit(template.turn), role, F.lit(template.sep))
    learned = F.coalesce(F.col("role") == template.loss_role, F.lit(False))
    return (turns.select("conv_id", "turn", head.alias("_head"), text.alias("_text"),
                         learned.alias("_learned"))
            .select("conv_id", "turn",
                    F.concat("_head", "_text", F.lit(template.end)).alias("formatted"),
                    F.when(F.col("_learned"), F.length("_head")).otherwise(0)
                    .cast("long").alias("loss_start"),
                    F.when(F.col("_learned"), F.length("_head") + F.length("_text")).otherwise(0)
                    .cast("long").alias("loss_end")))


_DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                  "loss_sha256 string, formatted_chars long")


def parse_segment(segment: str, template: Template = DEFAULT) -> list[tuple[str, str]]:
    """The turns that a piece of training string holds."""
    undo = lambda s: re.sub(_UNESCAPE, r"\1", s)
    out = []
    for part in segment.split(template.turn)[1:]:
        role, _, text = part.partition(template.sep)
        out.append((undo(role), undo(text.removesuffix(template.end))))
    return out


def _digests(template: Template):
    undo = re.compile(_UNESCAPE)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, begun, state = None, False, None
        for batch in batches:
            out = []
            ids = batch["conv_id"].astype("Int64")
            for conv, seg, a, b in zip(ids, batch["formatted"], batch["loss_start"],
                                       batch["loss_end"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if not begun or conv != current:
                    if begun:
                        out.append(_closed(current, state))
                    current, begun = conv, True
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_segment(seg, template):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if b > a:
                    learned = undo.sub(r"\1", seg[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(seg)
            if out:
                yield _frame(out)
        if begun:
            yield _frame([_closed(current, state)])

    def _closed(conv, s):
        return (conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])

    def _frame(out):
        return pd.DataFrame(out, columns=[c.split()[0] for c in _DIGEST_SCHEMA.split(", ")]) \
            .astype({"conv_id": "Int64"})
    return rows


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests of each conversation, parsed from its formatted segments.

    A digest runs over a conversation's turns in order, so its rows pass
    through one task as a stream: they are dealt by conversation, sorted
    (spilling) and read once; only a digest state is kept.
    """
    return (segments.repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "formatted")
            .select("conv_id", "formatted", "loss_start", "loss_end")
            .mapInPandas(_digests(template), _DIGEST_SCHEMA))
