"""Repair of conversations by weighted finite-state composition.

Three machines describe a repair: an acceptor of the rows (one symbol a row: its role's initial and its
fault), a transducer of edits (keep, rerole, delete, insert) and an acceptor of the roles that may follow
each other.  They are composed lazily, arc by arc as the search asks for them, and the search runs from
the end: the weight of a state is the least (cost, edits' initials) of all that may follow.  Weights are
extended on the left, which keeps the order of strings, and two arcs of a state with one label lead to
one state, so the first label that differs settles a tie.  More than two insertions before a row only come
back to a state of the grammar at a higher cost; the edit transducer counts them, so the composition has
no cycle and the rows' order is a topological one.

On Spark, rows are sorted by ranges of (conversation, turn, role, hash of role and text) and cut into pieces of
at most ``PIECE_ROWS`` rows, so that a conversation of any length spreads over tasks.  A piece's cost from each state
of the grammar to each is a 4 x 4 matrix; a conversation's matrices, not its rows, are multiplied from its end, then
each piece is searched alone, and the states at which pieces meet are followed from the start.

Rows (conv_id, turn, role, text; more columns are ignored) may hold nulls: a null role or text is one space, null
turns come first, null conv_ids are one conversation.  Rows of one turn are ordered by role, then by hash; equal
rows are neighbours, and all but the first are duplicates.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import keep

#: Rows of a piece, and code points of its texts (a longer text is a piece of its own).
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 18
FAR = 1 << 40

ROLES = {"u": "user", "a": "assistant"}
#: The grammar (s?(ua)+)? as arcs by state and initial; repairs end in one of ``ENDS``.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = range(4), (0, 3)
SOUND, TRUNCATED, UNFIT = range(3)
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 3, 4, 3, 3
INSERTS = 2
LEGAL = {"su", "ua", "au"}

Symbol = tuple[str, int]


def edits(inserted: int, symbol: Symbol | None) -> Iterator[tuple[str, int, str, int]]:
    """Arcs of the edit transducer: label, cost, initial put out (or none), insertions since the last row.

    Arcs that read ``symbol`` begin anew with 0 insertions; without a symbol there are only insertions."""
    if inserted < INSERTS:
        for role in ROLES:
            yield "I", INSERT, role, inserted + 1
    if symbol is None:
        return
    initial, fault = symbol
    yield "D", DELETE, "", 0
    if fault != UNFIT:
        extra = LEFT_TRUNCATED * (fault == TRUNCATED)
        yield "K", KEEP + extra, initial, 0
        for role in ROLES:
            yield "R", REROLE + extra, role, 0


@lru_cache(maxsize=1 << 12)
def arcs(inserted: int, state: int, symbol: Symbol | None) -> tuple[tuple[str, int, int, int], ...]:
    """Arcs of the composition that leave (inserted, state): label, cost, inserted, state."""
    out = []
    for label, cost, initial, then in edits(inserted, symbol):
        to = state if label == "D" else GRAMMAR.get((state, initial))
        if to is not None:
            out.append((label, cost, then, to))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def step(symbol: Symbol | None, after: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """For each state before a row (or, without a symbol, before the end): least cost, labels up to the row's own, state after it.

    ``after`` holds the costs of the states behind the row."""
    known: dict[tuple[int, int], tuple[int, str, int]] = {}
    for inserted in range(INSERTS, -1, -1):
        for state in STATES:
            found = [(after[state], "", state)] if symbol is None else []
            for label, cost, then, to in arcs(inserted, state, symbol):
                if label == "I":
                    c, labels, last = known[then, to]
                    found.append((cost + c, label + labels, last))
                else:
                    found.append((cost + after[to], label, to))
            known[inserted, state] = min(found, default=(FAR, "", state))
    return tuple(min(known[0, state], (FAR, "", state)) for state in STATES)


def _levelled(costs: list[int]) -> tuple[int, tuple[int, ...]]:
    least = min(costs)
    return least, tuple(min(c - least, FAR) for c in costs)


def search(symbols: list[Symbol | None], after: tuple[int, ...]) -> tuple[list[int], list[tuple]]:
    """Costs of the states before the first symbol, and every symbol's choices, from the costs behind the last one."""
    base, level = _levelled(list(after))
    choices = []
    for symbol in reversed(symbols):
        found = step(symbol, level)
        choices.append(found)
        more, level = _levelled([c for c, _, _ in found])
        base += more
    return [min(base + c, FAR) for c in level], choices[::-1]


def matrix(symbols: list[Symbol | None]) -> list[int]:
    """Least costs from each state to each, row after row."""
    columns = [search(symbols, tuple(0 if s == end else FAR for s in STATES))[0] for end in STATES]
    return [columns[end][start] for start in STATES for end in STATES]


def follow(choices: list[tuple], state: int) -> tuple[list[str], int]:
    """The labels chosen at every symbol from a state on, and the state behind the last one."""
    labels = []
    for found in choices:
        _, chosen, state = found[state]
        labels.append(chosen)
    return labels, state


CLOSED = tuple(0 if s in ENDS else FAR for s in STATES)

# --- rows to pieces ---------------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"
_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.binary()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("opens", pa.string()), ("closes", pa.string()), ("costs", pa.list_(pa.int64())),
])
_PIECE_SQL = (
    "conv_id bigint, piece bigint, roles array<string>, texts array<string>, faults binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
    "first_turn bigint, last_turn bigint, opens string, closes string, costs array<bigint>"
)


def _symbols(roles: list[str], faults: bytes) -> list[Symbol]:
    return [(role[:1], fault) for role, fault in zip(roles, faults, strict=True)]


def _closed_piece(conv_id, piece: int, rows: list[dict]) -> dict:
    roles, texts, faults = [r["role"] for r in rows], [r["text"] for r in rows], []
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for r in rows:
        body = r["text"].strip(SPACE)
        fault = "blank" if not body else "duplicate" if r["again"] else "truncated" if body[-1] not in ".!?" else None
        if fault:
            count[fault] += 1
        faults.append(SOUND if fault is None else TRUNCATED if fault == "truncated" else UNFIT)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r[:1] for r in roles]
    return {
        "conv_id": conv_id, "piece": piece, "roles": roles, "texts": texts, "faults": bytes(faults), **count,
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "opens": initials[0], "closes": initials[-1], "costs": matrix(_symbols(roles, bytes(faults))),
    }


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1024):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(limit: int):
    """Sorted rows of a range to pieces of at most ``limit`` rows; a piece's number orders it among all pieces."""

    def run(batches):
        task, made, chars = TaskContext.get().partitionId(), 0, 0
        held: list[dict] = []

        def found():
            nonlocal made, chars, held
            for batch in batches:
                for row in batch.to_pylist():
                    for k in range(row["n"]):
                        if held and (row["conv_id"] != held[0]["conv_id"] or len(held) >= limit or chars + len(row["text"]) > PIECE_CHARS):
                            yield _closed_piece(held[0]["conv_id"], (task << 40) + made, held)
                            held, chars, made = [], 0, made + 1
                        held.append(row | {"again": row["again"] or k > 0})
                        chars += len(row["text"])
            if held:
                yield _closed_piece(held[0]["conv_id"], (task << 40) + made, held)

        yield from _batched(found(), _PIECE, 256)

    return run


def pieces(rows: DataFrame, limit: int = PIECE_ROWS) -> DataFrame:
    """The rows in order, in pieces of at most ``limit`` rows that are kept in the shared folder."""
    own = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = own.groupBy("conv_id", "h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1").select(F.col("conv_id").alias("c"), F.col("h").alias("g"), "first")
    marked = own.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g")), "left").withColumn("again", F.coalesce(place != F.col("first"), F.lit(False)))
    ranged = marked.select("conv_id", "turn", "role", "text", "n", "h", "again").repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h")
    return keep(ranged.drop("h").mapInArrow(_pieces(limit), _PIECE_SQL), "pieces")


# --- pieces to a plan -------------------------------------------------------------------------------------------


def _by_conversation(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    return groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["conv_id"])


def _sorted(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")


_MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COSTED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("last", pa.bool_()), ("after", pa.list_(pa.int64())), *((m, pa.int64()) for m in _MEASURES)])
_COSTED_SQL = "conv_id bigint, piece bigint, last boolean, after array<bigint>, " + ", ".join(f"{m} bigint" for m in _MEASURES)


def _costed(batches):
    """Each piece with the costs behind it; a conversation's last piece tells its measures."""

    def rows():
        for conv_id, found in _by_conversation(batches):
            own = list(found)
            turned = [p for p in own if p["first_turn"] is not None]
            distinct = sum(p["turns"] for p in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
            total = {m: sum(p[m] for p in own) for m in ("blank", "duplicate", "truncated", "illegal")}
            total["illegal"] += sum(a["closes"] + b["opens"] not in LEGAL for a, b in zip(own, own[1:], strict=False))
            total["gaps"] = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct if turned else 0
            after, out = search([None], CLOSED)[0], []
            for p in reversed(own):
                out.append((p["piece"], after))
                after = [min(min(p["costs"][4 * s + e] + after[e] for e in STATES), FAR) for s in STATES]
            total["cost"] = after[0]
            for piece, behind in reversed(out):
                last = piece == own[-1]["piece"]
                yield {"conv_id": conv_id, "piece": piece, "last": last, "after": behind, **(total if last else {})}

    yield from _batched(rows(), _COSTED)


_TRACED = pa.schema([*_COSTED, ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])
_TRACED_SQL = f"{_COSTED_SQL}, audits array<string>, exits array<bigint>"


def _traced(batches):
    """Each piece searched with the costs behind it: the labels of its rows, joined by commas, and the state behind it, for each state before it."""

    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                symbols = _symbols(list(r.pop("initials")), r.pop("faults"))
                ends = [None] if r["last"] else []
                _, choices = search(symbols + ends, CLOSED if r["last"] else tuple(r["after"]))
                told = [follow(choices, s) for s in STATES]
                yield r | {"audits": [",".join(labels) for labels, _ in told], "exits": [end for _, end in told]}

    yield from _batched(rows(), _TRACED)


_PLANNED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("last", pa.bool_()), ("state", pa.int64()), ("labels", pa.string()), *((m, pa.int64()) for m in _MEASURES)])
_PLANNED_SQL = "conv_id bigint, piece bigint, last boolean, state bigint, labels string, " + ", ".join(f"{m} bigint" for m in _MEASURES)


def _planned(batches):
    def rows():
        for _, found in _by_conversation(batches):
            state = 0
            for r in found:
                yield {k: r[k] for k in ("conv_id", "piece", "last", *_MEASURES)} | {"state": state, "labels": r["audits"][state]}
                state = r["exits"][state]

    yield from _batched(rows(), _PLANNED)


def plan(cut: DataFrame) -> DataFrame:
    """conv_id, piece, last, state before the piece, labels (its rows' edits, joined by commas), and, at a conversation's last piece, its measures."""
    costed = _sorted(cut.select("conv_id", "piece", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "opens", "closes", "costs")).mapInArrow(_costed, _COSTED_SQL)
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials")
    traced = costed.join(cut.select("piece", initials, "faults"), "piece").select(*costed.columns, "initials", "faults").mapInArrow(_traced, _TRACED_SQL)
    return _sorted(traced).mapInArrow(_planned, _PLANNED_SQL)


# --- plan to repaired rows --------------------------------------------------------------------------------------


def apply(roles: list[str], texts: list[str], labels: list[str], state: int) -> Iterator[tuple[str, str, str]]:
    """The repaired rows of a piece: edit, role, text.  Labels behind the last row are insertions at the end."""
    for k, own in enumerate(labels):
        for label in own:
            if label == "D":
                continue
            initial = roles[k][:1] if label == "K" else "a" if state == 2 else "u"
            state = GRAMMAR[state, initial]
            yield label, roles[k] if label == "K" else ROLES[initial], "" if label == "I" else texts[k]


_REPAIRED = pa.schema([*_PLANNED, ("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _applied(batches):
    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                done = list(apply(r["roles"], r["texts"], r["labels"].split(","), r["state"]))
                yield r | {"edits": [x[0] for x in done], "roles": [x[1] for x in done], "texts": [x[2] for x in done]}

    yield from _batched(rows(), _REPAIRED, 64)


def repaired_pieces(rows: DataFrame, limit: int = PIECE_ROWS) -> DataFrame:
    """A row a piece: its edits, and roles and texts after them; see ``plan`` for the other columns."""
    cut = pieces(rows, limit)
    planned = plan(cut)
    joined = planned.join(cut.select("piece", "roles", "texts"), "piece").select(*planned.columns, "roles", "texts")
    return joined.mapInArrow(_applied, f"{_PLANNED_SQL}, edits array<string>, roles array<string>, texts array<string>")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, piece, place in it, edit (K, R or I), role, text; ordered by piece, then place."""
    lines = F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "line")
    found = repaired_pieces(rows).select("conv_id", "piece", lines)
    return found.select("conv_id", "piece", "place", F.col("line.edits").alias("edit"), F.col("line.roles").alias("role"), F.col("line.texts").alias("text"))


_REPORT = pa.schema([("conv_id", pa.int64()), *((m, pa.int64()) for m in _MEASURES), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_REPORT_SQL = "conv_id bigint, " + ", ".join(f"{m} bigint" for m in _MEASURES) + ", audit string, repaired_sha256 string"


def _reported(batches):
    """A digest runs over a conversation's pieces as they come; of its rows, only the edits' initials are held."""

    def rows():
        for conv_id, found in _by_conversation(batches):
            digest, audit, between = hashlib.sha256(), [], ""
            for r in found:
                audit.append(r["labels"].replace(",", ""))
                for role, text in zip(r["roles"], r["texts"], strict=True):
                    digest.update(f"{between}{role}:{text}".encode())
                    between = "\n"
            yield {"conv_id": conv_id, **{m: r[m] for m in _MEASURES}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from _batched(rows(), _REPORT)


def report(rows: DataFrame, conversations: DataFrame, limit: int = PIECE_ROWS) -> DataFrame:
    """conv_id, faults before the repair (gaps, blank, duplicate, truncated, illegal), cost, audit and repaired_sha256
    for every conv_id of ``conversations``; those without rows have zeros, an empty audit and the hash of an empty text."""
    done = _sorted(repaired_pieces(rows, limit).drop("edits")).mapInArrow(_reported, _REPORT_SQL)
    every = conversations.select(F.col("conv_id").cast("bigint").alias("every")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    text = lambda c, none: F.coalesce(c, F.lit(none)).alias(c)
    joined = every.join(done, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("every").alias("conv_id"), *map(zero, _MEASURES), text("audit", ""), text("repaired_sha256", hashlib.sha256().hexdigest()))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` deals out (nulls: one space): 0 drops a row, 1 empties its text, 2 removes
    its full stops and exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    whole: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    dealt = conversations.select("conv_id", "turn", whole["role"].alias("role"), whole["text"].alias("text"), (F.crc32(key) % 20).alias("dealt")).filter("dealt <> 0")
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("dealt") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("dealt") == 3, 2).otherwise(1)))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")
