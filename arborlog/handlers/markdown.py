"""Markdown: front matter, nested sections, code blocks, links and images; rendered byte by byte."""

from __future__ import annotations

import posixpath
import re

from arborlog.handlers.base import Call, Handler, Symbol, numbered, stable_id

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`\n]*)$")
_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)*)\]\(\s*<?([^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_CODE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)")
_SCHEME = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")


def slug(text: str) -> str:
    kept = "".join(c for c in text.lower() if c.isalnum() or c.isspace() or c == "-")
    return re.sub(r"[\s-]+", "-", kept).strip("-") or "section"


def percent_decode(text: str) -> str:
    raw = text.encode()
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("utf-8", "replace")


class Markdown(Handler):
    name, suffixes = "markdown", (".md", ".markdown", ".mdown")

    def shred(self, path, content):
        lines = content.splitlines(keepends=True)
        starts = [0]
        for x in lines:
            starts.append(starts[-1] + len(x))
        first, front = self._front(lines)
        heads, blocks = self._scan(lines, first)
        file = self.file(path, content[starts[first] : starts[heads[0][0]] if heads else len(content)])
        out = [file]
        if front:
            out.append(Symbol(stable_id(self.name, f"frontmatter:{path}"), file.id, "frontmatter", front, content[: starts[first]]))
        seen: dict[str, dict[str, int]] = {}
        sections, stack = [], []
        for k, (line, level, title) in enumerate(heads):
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent, way = (stack[-1][1], stack[-1][2]) if stack else (file, "")
            label = numbered(title or "section", seen.setdefault(parent.id, {}))
            way = f"{way}/{slug(label)}"
            end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
            s = Symbol(stable_id(self.name, f"section:{path}:{way}"), parent.id, "section", label, content[starts[line] : starts[end]], {"level": level, "anchor": slug(title or "")})
            stack.append((level, s, way))
            sections.append((line, s))
            out.append(s)
        owner = lambda line: next((s for at, s in reversed(sections) if at <= line), file)
        count: dict[str, int] = {}
        for start, end, info in blocks:
            own = owner(start)
            count[own.id] = count.get(own.id, 0) + 1
            out.append(Symbol(stable_id(self.name, f"code-block:{path}:{own.id}:{count[own.id]}"), own.id, "code-block", f"{(info.split() or ['code'])[0]} {count[own.id]}", content[starts[start] : starts[end]], {"info": info, "part": True}))
        calls, inside = [], {i for a, b, _ in blocks for i in range(a, b)}
        names: dict[tuple, int] = {}
        for i in range(first, len(lines)):
            if i in inside:
                continue
            for m in _LINK.finditer(_CODE.sub(lambda c: " " * len(c[0]), lines[i])):
                own, kind = owner(i), "image" if m[1] else "link"
                key = (own.id, kind)
                names[key] = names.get(key, 0) + 1
                s = Symbol(stable_id(self.name, f"{kind}:{path}:{own.id}:{names[key]}"), own.id, kind, f"{m[2] or m[3]} {names[key]}", m[0], {"target": m[3], "part": True})
                out.append(s)
                if m[3] and not _SCHEME.match(m[3]):
                    calls.append(Call(s.id, self._target(path, m[3]), "embeds" if m[1] else "links-to"))
        return out, calls

    @staticmethod
    def _front(lines):
        for mark, kind in (("---", "yaml"), ("+++", "toml")):
            if lines and lines[0].rstrip() == mark:
                for i in range(1, len(lines)):
                    if lines[i].rstrip() == mark:
                        return i + 1, kind
        return 0, None

    @staticmethod
    def _scan(lines, first):
        """Headings (line, level, title) and fenced blocks (line, end, info), fences hiding headings."""
        heads, blocks, fence = [], [], None
        for i in range(first, len(lines)):
            line = lines[i].rstrip("\r\n")
            m = _FENCE.match(line)
            if fence:
                if m and m[1][0] == fence[1][0] and len(m[1]) >= len(fence[1]) and not m[2].strip():
                    blocks.append((fence[0], i + 1, fence[2]))
                    fence = None
            elif m:
                fence = (i, m[1], m[2].strip())
            elif h := _ATX.match(line):
                heads.append((i, len(h[1]), (h[2] or "").strip()))
            elif (u := _SETEXT.match(line)) and i > first and (t := lines[i - 1].strip()) and not re.match(r"[#>\-*+|]|\d+[.)]\s", t) and not (heads and heads[-1][0] == i - 1) and (i - 2 < first or not lines[i - 2].strip() or (heads and heads[-1][0] == i - 2) or (blocks and blocks[-1][1] == i - 1)):
                heads.append((i - 1, 1 if u[1][0] == "=" else 2, t))
        if fence:
            blocks.append((fence[0], len(lines), fence[2]))
        return heads, blocks

    @staticmethod
    def _target(path, url):
        """path#anchor of a relative link."""
        file, _, anchor = url.partition("#")
        file = percent_decode(file.partition("?")[0])
        where = posixpath.normpath(posixpath.join(posixpath.dirname(path), file)) if file else path
        return where.lstrip("/") + ("#" + slug(percent_decode(anchor)) if anchor else "")

    def render(self, symbols):
        file, rest = symbols[0], symbols[1:]
        front = "".join(s.body or "" for s in rest if s.kind == "frontmatter")
        return front + (file.body or "") + "".join(s.body or "" for s in rest if s.kind == "section")
