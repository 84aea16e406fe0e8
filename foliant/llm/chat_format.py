"""Chat formatting: records of any known layout to canonical turns and one training string.

A record is a JSON object.  ``fingerprint`` hashes the sorted set of its nested field paths, those that
some layout names; the registry maps fingerprints to declarative mappings (which path holds the turns, or
which paths hold which role), so a layout is known by its shape alone and a new one is one more entry.
Fields that no layout names (ids, weights, dates) change nothing.  The mapping is checked while it is
applied: a record whose items differ in shape, or whose field is no scalar, fits no layout.  Records that
fit none, and texts that are no JSON, come back with ``layout`` null and no turns, whatever their keys
hold (dots and brackets are escaped in paths), and however deep they are.  Halves of surrogate pairs that
stand alone, which UTF-8 can't hold, become U+FFFD.

The template marks turns and escapes control strings inside texts with a backslash after their first
character, backslashes being doubled first; ``read_back`` undoes both exactly.  The loss mask covers
the escaped text of each assistant turn as (start, end) code points of the formatted string.

Defined results: null roles and texts are empty; turns are ordered by turn, then role and text, nulls
first; repeated rows are turns of their own; an empty table gives an empty result; other columns are
not read.  Texts are never cut.  A conversation is one training record and is held whole by one task.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import ship

START, END = "<|im_start|>", "<|im_end|>\n"

#: Strings that templates in use give a meaning; fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)

#: Names that some layouts use for a role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: name: (a sample of the shape, mapping).  A mapping lists turns either by a path to a list of
#: (role field, text field) or by one path per role, in order.
LAYOUTS: dict[str, tuple[dict, dict]] = {
    "messages": ({"messages": [{"role": "", "content": ""}]}, {"list": "messages", "role": "role", "text": "content"}),
    "sharegpt": ({"conversations": [{"from": "", "value": ""}]}, {"list": "conversations", "role": "from", "text": "value", "aliases": ROLES}),
    "prompt": ({"prompt": "", "completion": ""}, {"paths": [("user", "prompt"), ("assistant", "completion")]}),
    "instruction": ({"instruction": "", "output": ""}, {"paths": [("user", "instruction"), ("assistant", "output")]}),
    "system_instruction": ({"system": "", "instruction": "", "output": ""}, {"paths": [("system", "system"), ("user", "instruction"), ("assistant", "output")]}),
    "instruction_input": ({"instruction": "", "input": "", "output": ""}, {"paths": [("user", ("instruction", "input")), ("assistant", "output")]}),
    "nested": ({"data": {"question": "", "answer": ""}}, {"paths": [("user", "data.question"), ("assistant", "data.answer")]}),
}


#: What an empty list and an empty object leave as a path.
_EMPTY = {list: "[]", dict: "{}"}


def _name(key: str) -> str:
    """A key as part of a path: those that look like more than one part don't."""
    return re.sub(r"([\\.\[\]{}])", r"\\\1", key)


def paths(value) -> set[str]:
    """Nested field paths; list items share the path ``[]``.  Depth is bounded by memory alone."""
    out, left = set(), [("", value)]
    while left:
        prefix, value = left.pop()
        if isinstance(value, (dict, list)) and not value:
            out.add(prefix + _EMPTY[type(value)])
        elif isinstance(value, dict):
            left += [(f"{prefix}.{_name(k)}" if prefix else _name(k), v) for k, v in value.items()]
        elif isinstance(value, list):
            left += [(prefix + "[]", v) for v in value]
        else:
            out.add(prefix)
    return out


def fingerprint(record, named: frozenset[str] | None = None) -> str:
    """The hash of a record's field paths, or of those among them that layouts name."""
    found = paths(record) if named is None else paths(record) & named
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "backslashreplace")).hexdigest()


def named_paths(layouts=None) -> frozenset[str]:
    return frozenset().union(*(paths(sample) for sample, _ in (layouts or LAYOUTS).values()))


def registry(layouts=None) -> dict[str, tuple[str, dict]]:
    return {fingerprint(sample): (name, mapping) for name, (sample, mapping) in (layouts or LAYOUTS).items()}


class Misfit(ValueError):
    """A record whose paths are those of a layout and whose values are not."""


def _plain(value) -> str:
    """A scalar as text that UTF-8 can hold: halves of surrogate pairs that stand alone are replaced."""
    if isinstance(value, (dict, list)):
        raise Misfit("a field is no scalar")
    text = "" if value is None else str(value)
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _at(record, path: str) -> str:
    for part in path.split("."):
        if not isinstance(record, dict) or part not in record:
            raise Misfit(f"no field {path}")
        record = record[part]
    return _plain(record)


def canonical(record, mapping: dict) -> list[tuple[str, str]]:
    """(role, text) pairs of a record under a mapping; ``Misfit`` where a value is not what the mapping says."""
    if "list" in mapping:
        items = record.get(mapping["list"]) if isinstance(record, dict) else None
        if not isinstance(items, list):
            raise Misfit(f"{mapping['list']} is no list")
        names = mapping.get("aliases", {})
        turns = [(_at(t, mapping["role"]), _at(t, mapping["text"])) for t in items]
        return [(names.get(role, role), text) for role, text in turns]
    out = []
    for role, path in mapping["paths"]:
        parts = [_at(record, p) for p in (path if isinstance(path, tuple) else (path,))]
        out.append((role, "\n".join(p for p in parts if p) if len(parts) > 1 else parts[0]))
    return out


def read_record(text: str | None, known: dict, named: frozenset[str]) -> tuple[str, str | None, list[tuple[str, str]]]:
    """fingerprint, layout and turns of one JSON record; no layout and no turns where none fits."""
    try:
        value = json.loads(text or "null")
    except (ValueError, RecursionError):
        value = None
    mark = fingerprint(value, named)
    name, mapping = known.get(mark, (None, None))
    try:
        return mark, name, canonical(value, mapping) if mapping else []
    except Misfit:
        return mark, None, []


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and its loss mask."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        if not piece.startswith(START):
            raise ValueError("a turn without its mark")
        role, _, body = piece[len(START) :].partition("\n")
        turns.append((_unescape_role(role), unescape(body)))
    return turns


FORMATTED = "fingerprint string, layout string, n_turns bigint, formatted string, loss_mask array<struct<start:bigint,end:bigint>>"


def format_records(record: Column, layouts=None) -> Column:
    """A struct of ``FORMATTED`` for a column of JSON records."""
    ship(SparkSession.active())
    known, named = registry(layouts), named_paths(layouts)

    @F.arrow_udf(FORMATTED)
    def run(records: pa.Array) -> pa.Array:
        rows = []
        for text in records.to_pylist():
            mark, name, turns = read_record(text, known, named)
            formatted, mask = render(turns)
            rows.append((mark, name, len(turns), None if name is None else formatted, [{"start": a, "end": b} for a, b in mask]))
        kinds = {"fingerprint": pa.string(), "layout": pa.string(), "n_turns": pa.int64(), "formatted": pa.string(), "loss_mask": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return run(record)


def records_of_turns(turns: DataFrame) -> DataFrame:
    """conv_id, record: rows by turn gathered to JSON records, in the layout that suits their roles.

    A user and an assistant turn make a prompt record, a system turn before them an instruction
    record; all else is a message list, in one of the two usual spellings.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.array_join(F.transform("t", lambda t: t["role"]), ",")
    at = lambda i: F.col("t")[i]["text"]
    record = (
        F.when((F.size("t") == 2) & (roles == "user,assistant"), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("completion"))))
        .when((F.size("t") == 3) & (roles == "system,user,assistant"), F.to_json(F.struct(at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))))
        .when(~F.arrays_overlap(F.transform("t", lambda t: t["role"]), F.array(*[F.lit(r) for r in ROLES])) & (F.size("t") % 2 == 1), F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
    )
    return whole.select("conv_id", record.alias("record"))


def digests(formatted: Column, mask: Column) -> Column:
    """Turn count and digests, read back from formatted strings and their masks."""
    ship(SparkSession.active())

    @F.arrow_udf("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    def run(texts: pa.Array, masks: pa.Array) -> pa.Array:
        rows = []
        for text, spans in zip(texts.to_pylist(), masks.to_pylist(), strict=True):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            whole = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode())
            rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return run(formatted, mask)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, fingerprint, layout, n_turns, formatted, loss_mask of tables of turns."""
    return records_of_turns(turns).select("conv_id", format_records(F.col("record")).alias("f")).select("conv_id", "f.*")
