"""What a search reports besides its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalCut:
    """A catalog over the prefix budget was cut to its best candidates."""

    considered: int
    kept: int


@dataclass(frozen=True)
class UnknownSelectedId:
    """A model chose an id that it was not offered."""

    id: str


@dataclass(frozen=True)
class EmbeddingUnavailable:
    """A search that wanted the cosine signal went on without it."""


Diagnostic = RetrievalCut | UnknownSelectedId | EmbeddingUnavailable
Sink = Callable[[Diagnostic], None]


def ignore(_: Diagnostic) -> None:
    """The default sink."""
