"""Blob, JSON, TOML and YAML files."""

from __future__ import annotations

import json
import re
import tomllib

from arborlog.handlers.base import Handler, Symbol, Unparseable, numbered, stable_id

MAX_JSON = 512 * 1024
ENVELOPE = "\x00base64\x00"


class Blob(Handler):
    """One symbol with the whole content; claims every file."""

    name = "blob"

    def shred(self, path, content):
        mark = {"encoding": "base64"} if content.startswith(ENVELOPE) else {}
        return [self.file(path, content, **mark)], []

    def render(self, symbols):
        return symbols[0].body or ""


def _pretty(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


class Json(Handler):
    """A symbol for each top-level key; rendered canonically. Other values and large files are kept whole."""

    name, suffixes = "json", (".json",)

    def shred(self, path, content):
        if len(content.encode()) > MAX_JSON:
            return [self.file(path, content, top="oversized")], []
        try:
            value = json.loads(content)
        except (ValueError, RecursionError) as e:
            raise Unparseable(str(e)) from e
        if not isinstance(value, dict):
            return [self.file(path, _pretty(value), top="other")], []
        file = self.file(path, None, top="object")
        return [file, *(Symbol(stable_id(self.name, f"key:{path}:{k}"), file.id, "json-key", k, _pretty(v)) for k, v in sorted(value.items()))], []

    def render(self, symbols):
        file, *keys = symbols
        top = file.metadata.get("top")
        if top == "oversized":
            return file.body or ""
        if top == "other":
            return (file.body or "null") + "\n"
        return _pretty({s.name: json.loads(s.body) for s in keys}) + "\n"


class _Sections(Handler):
    """Text in sections that start at certain lines; the rest before is the preamble. Rendered byte by byte."""

    def heads(self, content: str) -> list[tuple[int, str, str]]:
        """(offset, kind, name) of each section."""
        raise NotImplementedError

    def shred(self, path, content):
        heads, seen = self.heads(content), {}
        ends = [h[0] for h in heads[1:]] + [len(content)]
        file = self.file(path, content[: heads[0][0]] if heads else content)
        out = [file]
        for (start, kind, name), end in zip(heads, ends):
            label = numbered(name, seen)
            out.append(Symbol(stable_id(self.name, f"{kind}:{path}:{label}"), file.id, kind, label, content[start:end]))
        return out, []

    def render(self, symbols):
        return "".join(s.body or "" for s in symbols)


class Toml(_Sections):
    """Tables and arrays of tables as exact spans."""

    name, suffixes = "toml", (".toml",)
    _HEAD = re.compile(r"^[ \t]*(\[\[|\[)[ \t]*([^\[\]\n]+?)[ \t]*(\]\]|\])[ \t]*(?:#.*)?$")
    _QUOTES = re.compile(r'"""|\'\'\'|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|#[^\n]*')

    def heads(self, content):
        try:
            tomllib.loads(content)
        except tomllib.TOMLDecodeError as e:
            raise Unparseable(str(e)) from e
        out, at, quote, depth = [], 0, None, 0
        for line in content.splitlines(keepends=True):
            if quote is None and depth == 0 and (m := self._HEAD.match(line.rstrip("\r\n"))):
                out.append((at, "table-array" if m[1] == "[[" else "table", m[2]))
            else:
                quote, depth = self._after(line, quote, depth)
            at += len(line)
        return out

    def _after(self, line, quote, depth):
        """Which multi-line string, and how many brackets, are open after a line."""
        i = 0
        while i < len(line):
            if quote:
                j = line.find(quote, i)
                if j < 0:
                    return quote, depth
                i, quote = j + 3, None
            elif m := self._QUOTES.match(line, i):
                if m[0] in ('"""', "'''"):
                    quote = m[0]
                i = m.end()
            else:
                depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(line[i], 0)
                i += 1
        return quote, max(0, depth)


class Yaml(_Sections):
    """A node for each key in column zero, with all that is indented below it."""

    name, suffixes = "yaml", (".yaml", ".yml")
    _KEY = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\-\[\]{},&*!|>'"%@`][^:#\n]*?|-[^\s:][^:\n]*?)[ \t]*:(?:[ \t].*)?$""")

    def heads(self, content):
        out, at = [], 0
        for line in content.splitlines(keepends=True):
            if m := self._KEY.match(line.rstrip("\r\n")):
                out.append((at, "node", m[1].strip("\"'")))
            at += len(line)
        return out

    def check(self, path, content):
        try:
            import yaml
        except ImportError:
            return None
        try:
            list(yaml.safe_load_all(content))
        except yaml.YAMLError as e:
            return str(e)
        return None
