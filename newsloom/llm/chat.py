"""Chat formatting: layouts are told apart by a schema fingerprint and mapped to canonical turns by declaration.

The fingerprint of a record is a digest of its sorted nested field paths (``messages[].role``), of those that any mapping
knows; other fields don't change it. ``MAPPINGS`` gives, for each known fingerprint, where the turns are: a list field with
its role and text fields, a fixed sequence of fields, or one turn with its place. Records of layouts that aren't known, or
that are no JSON objects, are rejects with a reason that names their paths; add a mapping to take them.

The template writes ``### Role: text</turn>`` and a line end for each turn. A backslash, ``###`` and ``</turn>`` inside a
text are escaped by a backslash, so that nothing in a text reads as a mark and every text comes back as it was. The
loss mask of a turn is the span of an assistant's text.

Turns of one conversation are formatted and read back in a stream sorted by conversation and turn: state is one
hasher a conversation, so memory stays bounded however many turns one has. A digest of a conversation's turns needs them one
after the other, so one conversation is one task's work, sorted on disk if need be.

Cases: a null text is empty; a null role is the empty role; rows with a null conversation id are one conversation, with a null
id; rows that repeat a turn number are ordered by role and text; an empty table gives no rows. Extra columns are ignored. A field that
is null counts as there, and is empty; so is a list that is null or empty, which has no turns; a null record has none either.
Values that aren't strings are shown as JSON. Very long texts are taken whole, one turn in memory at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHOWN = {"user": "User", "assistant": "Assistant", "system": "System"}
_ROLES = {v: k for k, v in _SHOWN.items()} | {"human": "user", "gpt": "assistant", "bot": "assistant"}
_ESCAPE = re.compile(r"(\\|###|</turn>)")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
_MARK = re.compile(r"\\(?:\\|###|</turn>)|</turn>")
_ROLE_ESCAPE = re.compile(r"(\\|###|</turn>|:)")
_ROLE_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_ROLE_MARK = re.compile(r"\\(?:\\|###|</turn>|:)|: ")


# layouts


def json_paths(value, at: str = "") -> set[str]:
    """Paths of the fields of a parsed record; those of a list's elements are united. A null is a field like others."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in json_paths(v, f"{at}.{k}" if at else k)} or ({at} if at else set())
    if isinstance(value, list):
        return {p for v in value for p in json_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_paths(schema: T.DataType, at: str = "") -> set[str]:
    """The same of a table's schema."""
    if isinstance(schema, T.StructType):
        return {p for f in schema.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _fields(*pairs: tuple[str, str]) -> dict:
    return {"fields": pairs}


def _list(field: str, role: str, text: str) -> dict:
    return {"list": field, "role": role, "text": text}


_TURN = ("conv_id", "turn", "role", "text")
_LAYOUTS = (
    (("prompt", "completion"), _fields(("user", "prompt"), ("assistant", "completion"))),
    (("prompt", "response"), _fields(("user", "prompt"), ("assistant", "response"))),
    (("system", "prompt", "response"), _fields(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    (("question", "answer"), _fields(("user", "question"), ("assistant", "answer"))),
    (("instruction", "output"), _fields(("user", "instruction"), ("assistant", "output"))),
    (("instruction", "input", "output"), _fields(("user", "instruction"), ("user+", "input"), ("assistant", "output"))),
    *(
        (paths, _list(field, role, text))
        for field, role, text in (("messages", "role", "content"), ("conversations", "from", "value"), ("turns", "speaker", "text"))
        # A list that is null, empty, of nulls only, or whose elements have one field only, is the same layout.
        for paths in ((f"{field}[].{role}", f"{field}[].{text}"), (field,), (f"{field}[]",), (f"{field}[].{role}",), (f"{field}[].{text}",))
    ),
    (_TURN, {"turn": _TURN}),
)
#: Fingerprint of the paths to the mapping.
MAPPINGS: dict[str, dict] = {fingerprint(paths): mapping for paths, mapping in _LAYOUTS}
#: Lists may hold nulls among their elements; the path of one says nothing beside those of others.
_KNOWN = frozenset(p for paths, _ in _LAYOUTS for p in paths)


def known(paths: set[str]) -> set[str]:
    """The paths that some mapping has, without that of a bare list element where the list's elements have fields."""
    ours = paths & _KNOWN
    return {p for p in ours if not (p.endswith("[]") and any(q.startswith(p + ".") for q in ours))}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def to_turns(record: dict) -> list[tuple[int, str, str]]:
    """Canonical (turn, role, text) of one parsed record, turns counted from 0 unless the layout gives them. ``user+`` joins the turn before, after an empty line, unless empty."""
    paths = json_paths(record)
    mapping = MAPPINGS.get(fingerprint(known(paths)))
    if mapping is None:
        raise ValueError(f"no mapping for the layout with the fields {', '.join(sorted(paths))}")
    if "turn" in mapping:
        _, turn, role, text = mapping["turn"]
        return [(int(record[turn] or 0), _text(record[role]), _text(record[text]))]
    if "list" in mapping:
        got = [(_text(m.get(mapping["role"])).lower(), _text(m.get(mapping["text"]))) for m in record[mapping["list"]] or () if m is not None]
        return [(i, _ROLES.get(r, r), t) for i, (r, t) in enumerate(got)]
    turns: list[tuple[str, str]] = []
    for role, field in mapping["fields"]:
        text = _text(record.get(field))
        if role.endswith("+"):
            if text:
                turns[-1] = (turns[-1][0], f"{turns[-1][1]}\n\n{text}")
        else:
            turns.append((role, text))
    return [(i, r, t) for i, (r, t) in enumerate(turns)]


def read_records(df: DataFrame, key: str, record: str, first: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, problem of a column of JSON records of any known layouts: a row for each turn, and a row with a problem for each reject. first: a column with the place of a record's first turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, raw, at in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    value = json.loads(raw) if raw else None
                    if value is not None and not isinstance(value, dict):
                        raise ValueError("no JSON object")
                    rows += [(k, (at or 0) + i, role, text, None) for i, role, text in (to_turns(value) if value is not None else ())]
                except (ValueError, RecursionError) as problem:
                    rows.append((k, at, None, None, str(problem) or "nested too deeply"))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv_id", "turn", "role", "text", "problem"])

    kind = dict(df.dtypes)[key]
    start = F.lit(0).cast("long") if first is None else F.col(first).cast("long")
    return df.select(F.col(key), F.col(record).cast("string"), start).mapInArrow(run, f"conv_id {kind}, turn bigint, role string, text string, problem string")


def records_to_turns(df: DataFrame, key: str, record: str) -> DataFrame:
    """The turns of read_records(), without its rejects."""
    return read_records(df, key, record).filter("problem IS NULL").drop("problem")


def rejects(df: DataFrame, key: str, record: str) -> DataFrame:
    """conv_id, problem of the records that have no mapping."""
    return read_records(df, key, record).filter("problem IS NOT NULL").select("conv_id", "problem")


def as_records(turns: DataFrame) -> DataFrame:
    """conv_id, first, record: each row of a table of turns as a record of one of four layouts, by a hash of its place. Roles that a layout has no name for stay in the plain one."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.create_map(*(F.lit(x) for pair in (("user", "human"), ("assistant", "gpt"), ("system", "system")) for x in pair))[role]
    pick = F.when(named.isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)))
    one = lambda field, *parts: F.to_json(F.struct(F.array(F.struct(*parts)).alias(field)))
    record = (
        F.when(pick == 1, one("messages", role.alias("role"), text.alias("content")))
        .when(pick == 2, one("conversations", named.alias("from"), text.alias("value")))
        .when(pick == 3, one("turns", role.alias("speaker"), text.alias("text")))
        .otherwise(F.to_json(F.struct("conv_id", F.lit(0).alias("turn"), role.alias("role"), text.alias("text")), {"ignoreNullFields": "false"}))
    )
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("first"), record.alias("record"))


def rows_to_turns(df: DataFrame) -> DataFrame:
    """The same of a table with one row a turn, told by the fingerprint of its schema; extra columns are left out first."""
    named = [c for c in ("conv_id", "turn", "role", "text") if c in df.columns]
    thin = df.select(*named)
    mapping = MAPPINGS.get(fingerprint(schema_paths(thin.schema)))
    if mapping is None or "turn" not in mapping:
        raise ValueError(f"no mapping for the layout with the fields {', '.join(sorted(schema_paths(df.schema)))}")
    conv, turn, role, text = mapping["turn"]
    return thin.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


# template


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and its loss span (code points, end exclusive; empty unless the role is assistant)."""
    shown = _SHOWN.get(role) or "=" + _ROLE_ESCAPE.sub(r"\\\1", role)
    head, body = f"### {shown}: ", escape(text)
    start, end = len(head), len(head) + len(body)
    return f"{head}{body}</turn>\n", start, end if role == "assistant" else start


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of formatted text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith("### ", at):
            raise ValueError(f"no turn begins at {at}")
        colon = next(m for m in _ROLE_MARK.finditer(formatted, at + 4) if m[0] == ": ")
        shown = formatted[at + 4 : colon.start()]
        end = next(m for m in _MARK.finditer(formatted, colon.end()) if m[0] == "</turn>")
        role = _ROLE_UNESCAPE.sub(r"\1", shown[1:]) if shown.startswith("=") else {v: k for k, v in _SHOWN.items()}[shown]
        yield role, unescape(formatted[colon.end() : end.start()])
        at = end.end() + 1


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_start, loss_end: one row a turn, those of a conversation in order in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turn(r, t) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
                ["conv_id", "formatted", "loss_start", "loss_end"],
            )

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id bigint, formatted string, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted turns alone, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, state, out = None, None, []

        def close():
            n, turns, chars, loss, size = state
            out.append(dict(zip(names, (now, n, turns.hexdigest(), chars, loss.hexdigest(), size))))

        for batch in batches:
            for conv, text, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learned = unescape(text[start:end])
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        if state is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, types)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
