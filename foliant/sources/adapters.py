"""Adapters for what needs a library or service of its own; each says that it is unavailable and never guesses."""

from __future__ import annotations

from dataclasses import dataclass
from importlib.util import find_spec
from typing import Protocol


class Unavailable(RuntimeError):
    """An adapter was asked for what it can't do here."""


class OcrAdapter(Protocol):
    available: bool

    def read(self, content: bytes) -> tuple[str, float | None]: ...


class ModelAdapter(Protocol):
    available: bool

    def understand(self, question: str) -> dict | None: ...

    def queries(self, question: str, gaps: list[str]) -> list[str]: ...

    def claims(self, question: str, passages: list[dict]) -> list[dict]: ...

    def answer(self, question: str, passages: list[dict]) -> str | None: ...


class VisionAdapter(Protocol):
    available: bool

    def describe(self, content: bytes, question: str) -> tuple[str, str]: ...


@dataclass(frozen=True)
class NullOcr:
    available: bool = False

    def read(self, content: bytes) -> tuple[str, float | None]:
        return "", None


@dataclass(frozen=True)
class NullModel:
    available: bool = False

    def understand(self, question: str) -> dict | None:
        return None

    def queries(self, question: str, gaps: list[str]) -> list[str]:
        return []

    def claims(self, question: str, passages: list[dict]) -> list[dict]:
        return []

    def answer(self, question: str, passages: list[dict]) -> str | None:
        return None


@dataclass(frozen=True)
class NullVision:
    available: bool = False

    def describe(self, content: bytes, question: str) -> tuple[str, str]:
        return "", "unavailable"


def has(*modules: str) -> bool:
    return all(find_spec(m) for m in modules)
