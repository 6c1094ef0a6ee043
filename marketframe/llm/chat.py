"""Chat formatting: schema fingerprints choose declarative mappings; a reversible template marks turns.

A layout is known by its fingerprint, the hash of its sorted nested field paths (``[]`` marks a list).
``MAPPINGS`` lists the layouts: which paths they have and where role and text lie. A table's schema
(``canonical_turns``) or each JSON record (``canonical_from_json``) is fingerprinted, and the mapping
found turns it into rows (conv_id, turn, role, text).

The template writes a turn as ``<s>role\\n text </s>\\n`` (without the blanks). Control strings inside
roles and texts are escaped reversibly, so the formatted text parses back to the same turns whatever
the texts hold. The loss mask covers the texts of assistant turns.

Defined results: null texts and roles count as empty; rows of a conversation are ordered by turn (null
first), then role, then text; repeated rows are repeated turns; a null conv_id is a conversation; an
unknown layout raises ValueError for a table and yields no turn (layout null) for a JSON record; other columns
and fields beside a layout are ignored, also those that another mapping names (of several layouts the one with
most paths holds); a record whose list of
turns is empty or null has the turns of its other fields, which may be none. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType

ESCAPE = "␛"
# The control strings and the code of each (code 0 is the escape character itself).
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>"]
CODES = "0123456789"
ROLE_BREAK = ESCAPE + CODES[9]


@dataclass(frozen=True)
class Mapping:
    """A layout. turns: the list that holds the turns, or None where the fields of fixed turns lie in
    the record itself; fixed: (role, paths of the text, joined by a line feed)."""
    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)


MAPPINGS = [
    Mapping("rows", ("conv_id", "role", "text", "turn"), role="role", text="text"),
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content", optional=("conv_id",)),
    Mapping("share", ("conversations[].from", "conversations[].value"), "conversations", "from", "value",
            optional=("conv_id", "system"), fixed=(("system", ("system",)),), roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", ("instruction", "output"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
            optional=("conv_id", "input", "system")),
    Mapping("prompt", ("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",))), optional=("conv_id",)),
    Mapping("question", ("answer", "question"), fixed=(("user", ("question",)), ("assistant", ("answer",))), optional=("conv_id",)),
]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def schema_paths(kind: DataType, at: str = "") -> list[str]:
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return schema_paths(kind.elementType, at + "[]") if isinstance(kind, ArrayType) else [at]


def value_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*[value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()]) if value else {at}
    if isinstance(value, list):
        return set().union(*[value_paths(v, at + "[]") for v in value]) if value else {at + "[]"}
    return {at}


class Layouts:
    """The known layouts: fingerprint to mapping, for every choice of a mapping's optional fields."""

    def __init__(self, mappings: list[Mapping] = MAPPINGS):
        self.mappings = mappings
        self.by_print = {fingerprint([*m.paths, *extra]): m for m in mappings for k in range(len(m.optional) + 1)
                         for extra in itertools.combinations(m.optional, k)}

    def of(self, have) -> Mapping | None:
        """The mapping whose fingerprint the paths have. Other fields may stand beside a layout: then the paths that
        one mapping names are fingerprinted, and of the mappings found so the one with most paths is taken (ties: the
        first listed)."""
        if found := self.by_print.get(fingerprint(have)):
            return found
        have = set(have)
        named = [(own, m) for m in self.mappings if self.by_print.get(fingerprint(own := have & {*m.paths, *m.optional})) is m]
        return max(named, key=lambda x: (len(x[1].paths), len(x[0])))[1] if named else None


def canonical_turns(table: DataFrame, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table whose schema has a known layout."""
    have = schema_paths(table.schema)
    found = Layouts(mappings).of(have)
    if found is None:
        raise ValueError(f"no mapping has the field paths {sorted(have)}")
    conv = F.col("conv_id") if "conv_id" in have else F.monotonically_increasing_id()
    if found.name == "rows":
        return table.select("conv_id", "turn", F.col(found.role).alias("role"), F.col(found.text).alias("text"))
    parts: list[Column] = []
    kind = "array<struct<role:string,text:string>>"
    for role, paths in found.fixed:
        if own := [p for p in paths if p in have]:
            text = F.concat_ws("\n", *[F.when(F.col(p) != "", F.col(p)) for p in own])
            whole = F.array(F.struct(F.lit(role).alias("role"), text.alias("text"))).cast(kind)
            parts.append(F.when(F.col(own[0]).isNotNull(), whole).otherwise(F.array().cast(kind)) if role == "system" else whole)
    if found.turns:
        names = F.create_map(*[F.lit(x) for kv in found.roles.items() for x in kv]) if found.roles else None
        name = (lambda r: F.coalesce(names[r], r)) if found.roles else (lambda r: r)
        parts.append(F.transform(F.coalesce(F.col(found.turns), F.array().cast(table.schema[found.turns].dataType)), lambda x: F.struct(
            name(x[found.role]).alias("role"), x[found.text].alias("text"))).cast(kind))
    return table.select(conv.alias("conv_id"), F.posexplode(F.concat(*parts)).alias("turn", "x")) \
        .select("conv_id", F.col("turn").cast("long").alias("turn"), "x.role", "x.text")


def record_turns(record, layouts: Layouts) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and turns of one parsed JSON record (null and no turns when unknown)."""
    have = value_paths(record)
    if isinstance(record, dict):
        # an empty or null list of turns stands for the paths that its turns would have
        have |= {p for m in layouts.mappings if m.turns and m.turns in record and not record[m.turns] for p in m.paths}
    found = layouts.of(have)
    if found is None or found.name == "rows":
        return None, []
    turns = []
    for role, paths in found.fixed:
        texts = [record[p] for p in paths if record.get(p)]
        if texts or role != "system":
            turns.append((role, "\n".join(map(str, texts))))
    for x in record.get(found.turns) or [] if found.turns else []:
        x = x if isinstance(x, dict) else {found.text: x}  # a turn without a role
        role = x.get(found.role) or ""
        turns.append((found.roles.get(role, role) if isinstance(role, str) else str(role), str(x.get(found.text) or "")))
    return found.name, turns


def canonical_from_json(table: DataFrame, ident: str, column: str, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Rows (conv_id, layout, turn, role, text) of JSON records in mixed layouts; a record of no known
    layout (or not JSON) is one row with null layout, turn, role and text."""
    layouts = Layouts(mappings)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for key, raw in zip(x["conv_id"], x["raw"]):
                try:
                    layout, turns = record_turns(json.loads(raw), layouts)
                except (TypeError, ValueError, KeyError, AttributeError):
                    layout, turns = None, []
                out += [(key, layout, i, r, t) for i, (r, t) in enumerate(turns)] if layout else [(key, None, None, None, None)]
            yield pd.DataFrame(out, columns=["conv_id", "layout", "turn", "role", "text"]).astype({"turn": "Int64"})

    kind = dict(table.dtypes)[ident]
    return table.select(F.col(ident).alias("conv_id"), F.col(column).alias("raw")).mapInPandas(
        read, f"conv_id {kind}, layout string, turn long, role string, text string")


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE + CODES[0]))
    for code, control in zip(CODES[1:], CONTROL):
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + code))
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_start, loss_length (code points inside
    formatted; null where the turn bears no loss). A conversation's text is its turns' formatted
    strings in order, so no conversation need fit one row."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(ROLE_BREAK))
    text = escaped(F.col("text"))
    bears = F.col("role").eqNullSafe("assistant")
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("__mf_role"), F.coalesce("text", F.lit("")).alias("__mf_text"),
        F.concat(F.lit("<s>"), role, F.lit("\n"), text, F.lit("</s>\n")).alias("formatted"),
        F.when(bears, F.length(role) + 4).alias("loss_start"), F.when(bears, F.length(text)).alias("loss_length"))


_ESCAPED = re.compile(ESCAPE + "([0-9])")
_BACK = {CODES[0]: ESCAPE, CODES[9]: "\n"} | dict(zip(CODES[1:9], CONTROL))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def parse_formatted(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a formatted string."""
    out = []
    for turn in formatted.split("</s>\n")[:-1]:
        role, _, text = turn.removeprefix("<s>").partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted strings alone: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Turns stream through in order, so memory stays at one batch however
    long a conversation is."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "__mf_role", "__mf_text")

    out_schema = StructType([formatted.schema["conv_id"], *StructType.fromDDL(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    columns = [f.name for f in out_schema.fields]
    arrow = to_arrow_schema(out_schema)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in out], schema=arrow)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for x in batches:
            out = []
            for k, whole, start, length in zip(*[c.to_pylist() for c in x.columns]):
                if state is None or k != key:
                    if state is not None:
                        out.append(done())
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_formatted(whole):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    text = unescape(whole[start:start + length])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(whole)
            yield table(out)
        if state is not None:
            yield table([done()])

    return ordered.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(digest, out_schema)
