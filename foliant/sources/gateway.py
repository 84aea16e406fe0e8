"""A guarded way to a language model: cached, retried, behind a circuit breaker, its payloads checked.

The transport is a callable; without one every call gives None and says why in ``events``.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time
from collections.abc import Callable, MutableMapping
from dataclasses import dataclass, field
from pathlib import Path

# Intents a model may name, and how calls are retried.
INTENTS = ("attribute_lookup", "relation_hop", "inverse_hop", "conflict_resolution", "calculation", "multi_fact", "analysis", "temporal_check", "open_question")
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, JITTER = 4, 1.0, 8.0, 0.25
FAILURES, REST = 3, 30.0
ITEMS = 12


class RateLimited(RuntimeError):
    """The service asked to come back later."""


@dataclass
class Breaker:
    """Open after ``FAILURES`` failures in a row, for ``REST`` seconds; then one call may try."""

    clock: Callable[[], float] = time.monotonic
    failed: int = 0
    until: float = 0.0

    def allows(self) -> bool:
        return self.clock() >= self.until

    def note(self, ok: bool) -> None:
        self.failed = 0 if ok else self.failed + 1
        if self.failed >= FAILURES:
            self.until = self.clock() + REST


def retried(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str:
    rng = rng or random.Random()
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except (RateLimited, TimeoutError, ConnectionError):
            if attempt == ATTEMPTS - 1:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt) * (1 + JITTER * rng.random()))
    raise AssertionError("unreachable")


def json_of(text: str):
    """The JSON of an answer that may be fenced or wrapped in prose; None if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in filter(None, (fenced and fenced[1], text, *(m[0] for m in re.finditer(r"(?s)\{.*\}|\[.*\]", text)))):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


def understanding(payload) -> dict | None:
    """Known keys of an understanding; an unknown intent is dropped, lists are cut to ``ITEMS`` strings."""
    if not isinstance(payload, dict):
        return None
    strings = lambda x: [str(v) for v in x if isinstance(v, (str, int, float))][:ITEMS] if isinstance(x, list) else []
    intent = payload.get("intent")
    return {"intent": intent if intent in INTENTS else None, "entities": strings(payload.get("entities")), "attributes": strings(payload.get("attributes")), "queries": strings(payload.get("queries"))}


def extracted_claims(payload) -> list[dict]:
    rows = payload.get("claims") if isinstance(payload, dict) else payload
    keep = [r for r in rows if isinstance(r, dict) and all(isinstance(r.get(k), str) and r[k] for k in ("subject", "attribute", "value", "evidence_id"))] if isinstance(rows, list) else []
    return [{k: r[k] for k in ("subject", "attribute", "value", "evidence_id")} for r in keep[:ITEMS]]


def merged(own: dict, said: dict | None) -> dict:
    """What rules found, gaps filled by a model, nothing overruled."""
    out = dict(own)
    for key, value in (said or {}).items():
        if value and not out.get(key):
            out[key] = value
    return out


class FileCache(MutableMapping):
    """Answers by the hash of what was asked, a file each; a file that is no text counts as missing."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, key: str) -> Path:
        if not re.fullmatch(r"[0-9a-f]{64}", key):
            raise KeyError(key)
        return self.folder / f"{key}.json"

    def __getitem__(self, key: str) -> str:
        try:
            return self._path(key).read_text()
        except (FileNotFoundError, UnicodeDecodeError) as e:
            raise KeyError(key) from e

    def __setitem__(self, key: str, value: str) -> None:
        path = self._path(key)
        draft = path.with_suffix(f".{os.getpid()}.tmp")
        draft.write_text(value)
        draft.replace(path)

    def __delitem__(self, key: str) -> None:
        self._path(key).unlink()

    def __iter__(self):
        return (p.stem for p in self.folder.glob("*.json"))

    def __len__(self) -> int:
        return sum(1 for _ in self)


@dataclass
class Gateway:
    transport: Callable[[str], str] | None = None
    model: str = "none"
    cache: MutableMapping[str, str] = field(default_factory=dict)
    breaker: Breaker = field(default_factory=Breaker)
    events: list[str] = field(default_factory=list)
    sleep: Callable[[float], None] = time.sleep

    @property
    def available(self) -> bool:
        return self.transport is not None

    def json(self, version: str, prompt: str):
        key = hashlib.sha256("\n".join((self.model, version, prompt)).encode()).hexdigest()
        if (held := json_of(self.cache.get(key, ""))) is not None:
            return held
        if not self.available:
            self.events.append("unavailable")
        elif not self.breaker.allows():
            self.events.append("breaker open")
        else:
            try:
                text = retried(lambda: self.transport(prompt), self.sleep)
            except Exception as e:  # any failure of a service is an event, never an answer
                self.breaker.note(False)
                self.events.append("rate limited" if isinstance(e, RateLimited) else f"failed: {type(e).__name__}")
                return None
            self.breaker.note(True)
            if (found := json_of(text)) is None:
                self.events.append("no json")
                return None
            self.cache[key] = text
            return found
        return None

    def understand(self, question: str) -> dict | None:
        return understanding(self.json("understand-1", question))

    def queries(self, question: str, gaps: list[str]) -> list[str]:
        return (understanding(self.json("queries-1", json.dumps([question, gaps]))) or {}).get("queries", [])

    def claims(self, question: str, passages: list[dict]) -> list[dict]:
        found = self.json("claims-1", json.dumps([question, passages], default=str))
        known = {p["evidence_id"]: p["content"] for p in passages}
        fold = lambda x: re.sub(r"[^a-z0-9]+", " ", x.lower()).strip()
        return [c for c in extracted_claims(found) if c["evidence_id"] in known and all(fold(c[k]) in fold(known[c["evidence_id"]]) for k in ("subject", "value"))]

    def answer(self, question: str, passages: list[dict]) -> str | None:
        found = self.json("answer-1", json.dumps([question, passages], default=str))
        return found.get("answer") if isinstance(found, dict) and isinstance(found.get("answer"), str) else None
