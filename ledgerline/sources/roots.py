"""Where sources lie: which provider a folder belongs to, duplicate roots, unique names. Plain configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    root: str


def infer_kind(folders: list[str]) -> str | None:
    """``a`` for a root with project folders, ``b`` for one with rollout folders, from its folders' names."""
    names = set(folders)
    return "a" if "projects" in names else "b" if "sessions" in names else None


def add_source(known: list[Source], name: str, kind: str, root: str) -> list[Source]:
    """Adds a source; the same root twice is refused, a taken name gets a number."""
    root = os.path.normpath(root)
    if any(s.root == root for s in known):
        raise ValueError(f"already a source: {root}")
    taken, unique, k = {s.name for s in known}, name, 2
    while unique in taken:
        unique, k = f"{name} {k}", k + 1
    return [*known, Source(unique, kind, root)]


def scoped(kind: str, raw_id: str) -> str:
    """A provider's id, once."""
    return raw_id if raw_id.startswith(f"{kind}:") else f"{kind}:{raw_id}"
