"""What a handler gives: symbols and references of one file, and the file from its symbols."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field


class Unparseable(ValueError):
    """The file isn't what the handler reads; it degrades to a blob."""


@dataclass
class Symbol:
    id: str
    parent: str | None
    kind: str
    name: str
    body: str | None = None
    metadata: dict = field(default_factory=dict)


@dataclass
class Call:
    """A use of a name, resolved when all files are known. how: local (same parent), bare, or member (any method of that name)."""

    source: str
    name: str
    how: str


def stable_id(namespace: str, seed: str, root: str = "https://symbols.local/") -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, root + (f"{namespace}/" if namespace else "") + seed))


def numbered(name: str, seen: dict[str, int], style: str = " ({})") -> str:
    """The name, from its second use on with its number."""
    seen[name] = seen.get(name, 0) + 1
    return name if seen[name] == 1 else name + style.format(seen[name])


class Handler:
    name = ""
    suffixes: tuple[str, ...] = ()

    def claims(self, path: str) -> bool:
        return path.lower().endswith(self.suffixes) if self.suffixes else True

    def shred(self, path: str, content: str) -> tuple[list[Symbol], list[Call]]:
        raise NotImplementedError

    def render(self, symbols: list[Symbol]) -> str:
        """The file of these symbols: the file symbol first, the others in order."""
        raise NotImplementedError

    def check(self, path: str, content: str) -> str | None:
        """What is wrong with a file, or None."""
        try:
            self.shred(path, content)
        except Unparseable as e:
            return str(e)
        return None

    def file(self, path: str, body: str | None = None, **metadata) -> Symbol:
        return Symbol(stable_id(self.name, f"file:{path}"), None, "file", path, body, {"handler": self.name, "path": path} | metadata)
