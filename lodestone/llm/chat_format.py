"""Chat formatting with schema fingerprints.

A record comes as JSON.  The set of its nested field paths (arrays as ``[]``) is
hashed; the hash selects a declarative mapping that says where turns, roles and texts
are.  Mappings for message lists, share-style lists, prompt/response pairs,
instruction/input/output and single message rows are built in, others can be added.
An unknown fingerprint takes the mapping whose paths the record has, if one of them holds
the paths of all others it has; otherwise (none, or messages beside a prompt) the record
becomes no turn but a row with the error and its fingerprint.  Contents that are no
strings become JSON, lists of text parts their texts.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings
inside texts get a backslash behind their first character and backslashes are doubled,
so no text can open or close a turn, and reading back restores every text exactly.

Turns are formatted row by row.  Where conversations are read back, rows are dealt by
conversation and sorted, and each conversation is folded in a stream: a task holds one
turn at a time, so a conversation of any length fits.

Defined results: null texts and roles are empty; rows that tie in their turn go by
role and text as they were before escaping; a text of any length is one turn; repeated rows are turns each; a null conversation id is a conversation
of its own; an empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches

# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_UNESCAPE = re.compile(r"\\(.)", re.S)
#: In roles the line break that ends the role is escaped too, and ``\\x`` marks it.
_ROLE = re.compile(r"[\\\n<\[]")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return _ROLE.sub(lambda m: f"\\x{ord(m[0]):02x}", role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\x(..)", lambda m: chr(int(m[1], 16)), role)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``each``: path of the list of turns ("" for a record that holds its turns in fields);
    ``turns``: (role, role path, text paths) for every turn of an item; a role path wins
    over the fixed role, several texts are joined by a blank line, absent ones are left out.
    ``whole``: only for records without any other path.
    """

    name: str
    paths: frozenset[str]
    each: str
    turns: tuple[tuple[str, str, tuple[str, ...]], ...]
    whole: bool = False


def mapping(name: str, paths: str, each: str, *turns: tuple[str, str, tuple[str, ...]], whole: bool = False) -> Mapping:
    return Mapping(name, frozenset(paths.split()), each, turns, whole)


# The known layouts.
MAPPINGS = [
    mapping("message_row", "role text", "", ("user", "role", ("text",))),
    mapping("messages", "messages[].role messages[].content", "messages", ("user", "role", ("content",))),
    mapping("message_parts", "messages[].role messages[].content[].type messages[].content[].text", "messages", ("user", "role", ("content",))),
    mapping("prompt", "prompt", "", ("user", "", ("prompt",)), whole=True),
    mapping("response", "response", "", ("assistant", "", ("response",)), whole=True),
    mapping("conversations", "conversations[].from conversations[].value", "conversations", ("user", "from", ("value",))),
    mapping("prompt_response", "prompt response", "", ("user", "", ("prompt",)), ("assistant", "", ("response",))),
    mapping("prompt_completion", "prompt completion", "", ("user", "", ("prompt",)), ("assistant", "", ("completion",))),
    mapping("system_prompt_response", "system prompt response", "", ("system", "", ("system",)), ("user", "", ("prompt",)), ("assistant", "", ("response",))),
    mapping("instruction", "instruction output", "", ("user", "", ("instruction",)), ("assistant", "", ("output",))),
    mapping("instruction_input", "instruction input output", "", ("user", "", ("instruction", "input")), ("assistant", "", ("output",))),
    mapping("question_answer", "question answer", "", ("user", "", ("question",)), ("assistant", "", ("answer",))),
]
# Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves; nulls count as leaves, list items share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else str(k))}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Layouts:
    """Mappings by fingerprint; a bounded number of fingerprints seen is remembered."""

    LIMIT = 10_000

    def __init__(self, mappings: list[Mapping]) -> None:
        self.mappings, self.known = mappings, {}
        self.fixed = {fingerprint(m.paths): (m, None) for m in mappings}

    def chosen(self, paths: set[str]) -> tuple[Mapping | None, str | None, str]:
        """(mapping, error, fingerprint): by fingerprint; else the one mapping whose paths the record has and that holds all others of that kind."""
        key = fingerprint(paths)
        if key in self.fixed:
            return *self.fixed[key], key
        if key not in self.known:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            fits = [m for m in self.mappings if m.paths <= paths and not m.whole]
            widest = [m for m in fits if not any(m.paths < o.paths for o in fits)]
            self.known[key] = (widest[0], None) if len(widest) == 1 else (None, "ambiguous layout" if widest else "unknown layout")
        return *self.known[key], key


def text_of(value: object) -> str:
    """Strings as they are, lists of parts as their texts in a row, null as nothing, all else as JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list) and all(isinstance(p, dict) and isinstance(p.get("text"), str) for p in value):
        return "".join(p["text"] for p in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: object, m: Mapping, names: bool) -> list[tuple[str, str]]:
    items = record
    for step in filter(None, m.each.split(".")):
        items = (items or {}).get(step)  # type: ignore[union-attr]
    out = []
    for item in (items or []) if m.each else [record]:
        for fixed, role_path, texts in m.turns:
            role = item.get(role_path) if role_path else fixed
            role = text_of(role)
            present = [x for x in (text_of(item.get(t)) for t in texts) if x]
            out.append((ROLES.get(role.lower(), role) if names else role, "\n\n".join(present)))
    return out


def canonical_turns(records: DataFrame, json_column: str, keys: list[str], extra: list[Mapping] = (), canonical_roles: bool = True) -> DataFrame:
    """``keys`` and part (order within the record), role, text, layout, fingerprint and error of each turn of each record."""
    schema = ", ".join([f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys] + ["part int, role string, text string, layout string, fingerprint string, error string"])
    mappings = [*MAPPINGS, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for batch in batches:
            take, rows = [], []
            for i, raw in enumerate(batch.column("__json").to_pylist()):
                try:
                    record = json.loads(raw or "{}")
                    paths = field_paths(record)
                    m, error, print_ = layouts.chosen(paths) if isinstance(record, dict) else (None, "unknown layout", fingerprint(paths))
                    found = [(p, r, t, m.name, print_, None) for p, (r, t) in enumerate(turns_of(record, m, canonical_roles))] if m else [(0, None, None, None, print_, error)]
                except (ValueError, AttributeError, TypeError) as e:
                    found = [(0, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                rows += found
                take += [i] * len(found)
            same = batch.select(keys).take(pa.array(take, pa.int64()))
            types = [pa.int32(), *[pa.string()] * 5]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*same.columns, *made], [*keys, "part", "role", "text", "layout", "fingerprint", "error"])

    return records.select(*keys, F.col(json_column).alias("__json")).mapInArrow(run, schema)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text (the loss mask of an assistant's) starts and ends in it."""
    head = START + escape_role(role) + MIDDLE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def format_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, formatted, loss_start and loss_end (null where the turn bears no loss) for each turn."""
    schema = ", ".join([f"`{k}` {turns.schema[k].dataType.simpleString()}" for k in keys] + ["formatted string, loss_start int, loss_end int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                formatted, start, end = format_turn(role or "", text or "")
                out.append((formatted, start, end) if role == "assistant" else (formatted, None, None))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, [pa.string(), pa.int32(), pa.int32()], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *made], [*keys, "formatted", "loss_start", "loss_end"])

    return turns.select(*keys, "role", "text").mapInArrow(run, schema)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def read_back(segments: DataFrame, order: list[str]) -> DataFrame:
    """Per conv_id: n_turns, digests and lengths, parsed from the formatted segments alone, in ``order``, then by role and text."""
    plain = F.regexp_extract("formatted", r"(?s)^<\|im_start\|>([^\n]*)\n", 1)
    for mark, char in (("\\x0a", "\n"), ("\\x3c", "<"), ("\\x5b", "["), ("\\x5c", "\\")):
        plain = F.replace(plain, F.lit(mark), F.lit(char))
    body = F.regexp_replace(F.regexp_replace("formatted", r"(?s)^<\|im_start\|>[^\n]*\n|<\|im_end\|>\n\z", ""), r"(?s)\\(.)", "$1")
    # computed behind the exchange
    dealt = segments.repartition("conv_id").withColumn("__role", plain).withColumn("__text", body).sortWithinPartitions("conv_id", *order, "__role", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None

        class Fold:
            def __init__(self, conv: int | None) -> None:
                self.conv, self.n, self.chars, self.loss = conv, 0, 0, 0
                self.all, self.masked = hashlib.sha256(), hashlib.sha256()

            def row(self) -> tuple:
                return self.conv, self.n, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = Fold(conv)
                now.chars += len(formatted)
                for m in _TURN.finditer(formatted):
                    now.n += 1
                    now.all.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "replace"))
                if start is not None:
                    text = unescape(formatted[start:end])
                    now.loss += len(text)
                    now.masked.update(text.encode("utf-8", "replace"))
            if len(rows) >= 1024:
                yield batch_of(rows)
                rows = []
        if now is not None:
            rows.append(now.row())
        if rows:
            yield batch_of(rows)

    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


#: Layouts that ``as_records`` writes rows in.
LAYOUTS = 5


def as_records(rows: DataFrame) -> DataFrame:
    """Message rows as JSON records of several layouts, one of each kind in turn by conversation: heterogeneous input with one turn a record."""
    pair = lambda role, text: F.struct(F.col("role").alias(role), F.col("text").alias(text))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(LAYOUTS))
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    record = (
        F.when(kind == 0, F.to_json(F.struct(F.array(pair("role", "content")).alias("messages"))))
        .when(kind == 1, F.to_json(F.struct(F.array(pair("from", "value")).alias("conversations"))))
        .when(kind == 2, F.to_json(F.struct(F.array(F.struct("role", parts.alias("content"))).alias("messages"))))
        .when((kind == 3) & (F.col("role") == "user"), F.to_json(F.struct(F.col("text").alias("prompt"))))
        .when((kind == 3) & (F.col("role") == "assistant"), F.to_json(F.struct(F.col("text").alias("response"))))
        .otherwise(F.to_json(F.struct("role", "text")))
    )
    return rows.withColumn("record", record)


def format_message_rows(rows: DataFrame, mixed: bool = False) -> DataFrame:
    """Message rows (conv_id, turn, role, text) -> formatted segments with conv_id, turn, part and the loss mask.

    With ``mixed`` the rows go through records of several layouts.
    """
    small_batches(rows.sparkSession, 2048)
    picked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    records = as_records(picked) if mixed else picked.withColumn("record", F.to_json(F.struct("role", "text")))
    turns = canonical_turns(records.select("conv_id", "turn", "record"), "record", ["conv_id", "turn"], canonical_roles=False)
    return format_turns(turns, ["conv_id", "turn", "part"])
