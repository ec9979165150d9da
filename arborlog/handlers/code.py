"""TypeScript, Go, Rust, C# and Elixir files by conservative scanners: declarations as exact spans, members, and uses of names.

No compiler is here, so only what a line and its brackets show is recognised; all else stays as raw text between the
declarations. Rendering joins the spans of the file's level, so files come back byte by byte.
"""

from __future__ import annotations

import re

from arborlog.handlers.base import Call, Handler, Symbol, Unparseable, numbered, stable_id

_WORD_CALL = re.compile(r"(?:\b(this|self|base|super)\s*(?:\.|::)\s*|(\.|::)\s*)?\b([A-Za-z_]\w*[!?]?)\s*\(")
_NOT_CALLS = frozenset("if for while switch match return catch function func fn def defp defmacro do with case cond unless when and or not in new typeof sizeof nameof using lock foreach".split())


def blanked(text: str, pattern: re.Pattern) -> str:
    """The text with comments and strings as blanks, line breaks kept."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; -1 if none does."""
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        if m[0] in "([{":
            stack.append(m[0])
        elif not stack or stack.pop() != pairs[m[0]]:
            return -1
        if not stack:
            return m.end()
    return -1


_HEAD_STOP = re.compile(r"[{;(\[]|\n(?=\S)")
_MEMBER_STOP = re.compile(r"[{;(\[]|\n(?!\s*(?:\{|where\b|=>|->))")


class Code(Handler):
    """A language of declarations with bodies in braces."""

    skip = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
    #: Declarations of the file's level and members of a body: kind and pattern, whose last group is the name.
    heads: tuple[tuple[str, re.Pattern], ...] = ()
    members: tuple[tuple[str, re.Pattern], ...] = ()
    containers: frozenset[str] = frozenset()
    lead = re.compile(r"(?:[ \t]*(?://[^\n]*|@[^\n]*|#\[[^\n]*|\[[A-Z][^\n]*\]|/\*\*?(?:[^*]|\*(?!/))*\*/)[ \t]*\n)*\Z")

    def claims(self, path):
        return super().claims(path) and not path.lower().endswith((".d.ts", "_test.go"))

    def _end(self, bare: str, head: re.Match, member: bool) -> int:
        """Where a declaration that begins here ends: after its braces, or after its statement, which for a member is its line."""
        stop = _MEMBER_STOP if member else _HEAD_STOP
        at = stop.search(bare, head.end())
        while at and at[0] in "([":
            k = closing(bare, at.start())
            if k < 0:
                return -1
            at = stop.search(bare, k)
        if at and at[0] == "{":
            end = closing(bare, at.start())
            if end < 0:
                return -1
        else:
            end = at.end() if at and at[0] == ";" else at.start() if at else len(bare)
        tail = re.compile(r"[ \t;]*(?:\n|\Z)").match(bare, end)
        return tail.end() if tail else end

    def _found(self, text: str, bare: str, lo: int, hi: int, rules, member: bool = False) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, name) of declarations in a range, with the comments and marks right above them."""
        hits = []
        for kind, rule in rules:
            hits += [(m.start(), kind, m) for m in rule.finditer(bare, lo, hi)]
        out, at = [], lo
        for start, kind, m in sorted(hits, key=lambda x: x[0]):
            if start < at or self._depth(bare, lo, start):
                continue
            end = self._end(bare, m, member)
            if end < 0:
                raise Unparseable("brackets don't close")
            above = self.lead.search(text, at, start)
            out.append((above.start() if above else start, min(end, hi), kind, m[m.lastindex]))
            at = min(end, hi)
        return out

    @staticmethod
    def _depth(bare: str, lo: int, at: int) -> int:
        part = bare[lo:at]
        return part.count("{") + part.count("(") - part.count("}") - part.count(")")

    def shred(self, path, content):
        bare = blanked(content, self.skip)
        if closing("{" + bare + "}", 0) != len(bare) + 2:
            raise Unparseable("brackets don't close")
        file, seen, raw = self.file(path, None), {}, 0
        out, calls, at = [file], [], 0
        for start, end, kind, name in self._found(content, bare, 0, len(content), self.heads):
            if start > at:
                raw += 1
                if raw == 1 and len(out) == 1:
                    file.body = content[:start]
                else:
                    out.append(Symbol(stable_id(self.name, f"raw:{path}:{raw}"), file.id, "raw", f"item-{raw:04d}", content[at:start]))
            label = numbered(name, seen.setdefault(kind, {}), "#{}")
            s = Symbol(stable_id(self.name, f"{kind}:{path}:{label}"), file.id, kind, label, content[start:end])
            out.append(s)
            inner = bare.find("{", start, end)
            if kind in self.containers and inner >= 0:
                own: dict[tuple, int] = {}
                for a, b, k, n in self._found(content, bare, inner + 1, max(inner + 1, bare.rfind("}", start, end)), self.members, True):
                    if n in _NOT_CALLS:
                        continue
                    tag = numbered(n, own.setdefault(k, {}), "#{}")
                    c = Symbol(stable_id(self.name, f"{k}:{s.id}:{tag}"), s.id, k, tag, content[a:b], {"part": True})
                    out.append(c)
                    calls += self._calls(bare[a:b], c.id, n)
            else:
                calls += self._calls(bare[start:end], s.id, name)
            at = end
        if at < len(content):
            if len(out) == 1:
                file.body = content
            else:
                out.append(Symbol(stable_id(self.name, f"raw:{path}:end"), file.id, "raw", "item-last", content[at:]))
        return out, calls

    @staticmethod
    def _calls(bare: str, source: str, own: str):
        found = {("local" if m[1] else "member" if m[2] else "bare", m[3]) for m in _WORD_CALL.finditer(bare) if m[3] not in _NOT_CALLS}
        return [Call(source, n, how) for how, n in sorted(found) if n != own]

    def render(self, symbols):
        return "".join(s.body or "" for s in symbols if not s.metadata.get("part"))


def _line(pattern: str) -> re.Pattern:
    return re.compile(r"^[ \t]*" + pattern, re.M)


_TS_MODS = r"(?:(?:public|private|protected|readonly|async|override|abstract|declare)\s+)*"
_TS_NAME = r"\*?([A-Za-z_$#][\w$]*)\s*(?:<[^>\n]*>)?\("


class TypeScript(Code):
    name, suffixes = "typescript", (".ts", ".tsx", ".js", ".jsx")
    heads = (("class", _line(r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)")), ("function", _line(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)")))
    members = (
        ("static-getter", _line(_TS_MODS + r"static\s+get\s+" + _TS_NAME)), ("static-setter", _line(_TS_MODS + r"static\s+set\s+" + _TS_NAME)), ("getter", _line(_TS_MODS + r"get\s+" + _TS_NAME)), ("setter", _line(_TS_MODS + r"set\s+" + _TS_NAME)),
        ("static-method", _line(_TS_MODS + r"static\s+" + _TS_MODS + _TS_NAME)), ("method", _line(_TS_MODS + _TS_NAME)), ("property", _line(r"(?:(?:public|private|protected|readonly|static|declare|override)\s+)*([A-Za-z_$#][\w$]*)[?!]?\s*[:=;]")),
    )
    containers = frozenset({"class"})


class Go(Code):
    name, suffixes = "go", (".go",)
    heads = (("method", re.compile(r"^func\s+\([^)]*\)\s*(\w+)", re.M)), ("function", re.compile(r"^func\s+(\w+)", re.M)), ("struct", re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", re.M)), ("interface", re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", re.M)), ("type", re.compile(r"^type\s+(\w+)", re.M)), ("const", re.compile(r"^const\s+(\w+)", re.M)), ("var", re.compile(r"^var\s+(\w+)", re.M)))
    members = (("interface-method", _line(r"(\w+)(?=\()")), ("field", _line(r"(\w+)(?=[ \t]+[\w*\[\].]+)")))
    containers = frozenset({"struct", "interface"})


_RS = r"(?:pub(?:\([^)]*\))?\s+)?"


class Rust(Code):
    name, suffixes = "rust", (".rs",)
    # a lone quote is a lifetime, so characters are told by their closing quote
    skip = re.compile(r"//[^\n]*|/\*.*?\*/|r#\".*?\"#|b?\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{1,8}?)'", re.S)
    heads = (("function", re.compile("^" + _RS + r"(?:(?:async|unsafe|const|extern)\s+)*fn\s+(\w+)", re.M)), *((k, re.compile("^" + _RS + rf"(?:unsafe\s+)?{k}\s+(?:mut\s+)?(\w+)", re.M)) for k in ("struct", "enum", "trait", "const", "static", "type", "mod")), ("impl", re.compile(r"^(?:unsafe\s+)?impl\b\s*((?:<[^>\n]*>\s*)?[^{\n]*?)(?=\s*(?:\{|\n))", re.M)))
    members = (("method", _line(_RS + r"(?:(?:async|unsafe|const|extern)\s+)*fn\s+(\w+)")),)
    containers = frozenset({"impl", "trait"})


_CS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|async|override|virtual|unsafe|new|extern|ref|required)\s+)*"


class CSharp(Code):
    name, suffixes = "csharp", (".cs",)
    heads = (*((k, _line(_CS + rf"{k}\s+(\w+)")) for k in ("class", "interface", "struct", "enum", "record")), ("namespace", re.compile(r"^namespace\s+([\w.]+)(?=\s*\{)", re.M)))
    members = (*((k, _line(_CS + rf"{k}\s+(\w+)")) for k in ("class", "interface", "struct", "enum", "record")), ("method", _line(_CS + r"[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^>\n]*>)?(?=\()")), ("constructor", _line(r"(?:public|private|protected|internal)\s+(\w+)(?=\()")), ("property", _line(_CS + r"[\w<>\[\],.?]+\s+(\w+)(?=\s*(?:\{|=>))")), ("field", _line(_CS + r"[\w<>\[\],.?]+\s+(\w+)(?=\s*[=;])")))
    containers = frozenset({"class", "interface", "struct", "record", "namespace"})


class Elixir(Handler):
    """Modules by indentation, with functions and macros as name/arity; clauses of one function are one symbol."""

    name, suffixes = "elixir", (".ex", ".exs")
    _SKIP = re.compile(r'""".*?"""|#[^\n]*|"(?:[^"\\\n]|\\.)*"', re.S)
    _MODULE = re.compile(r"^([ \t]*)defmodule\s+([\w.]+)\s+do[ \t]*$", re.M)
    _DEF = re.compile(r"^[ \t]*(defp?|defmacrop?)\s+([a-z_]\w*[!?]?)(\(([^\n]*?)\))?", re.M)

    def shred(self, path, content):
        bare = blanked(content, self._SKIP)
        file = self.file(path, None)
        out, calls, at = [file], [], 0
        for m in self._MODULE.finditer(bare):
            if m.start() < at:
                continue
            end = re.compile(rf"^{m[1]}end\b[ \t]*\n?", re.M).search(bare, m.end())
            if end is None:
                raise Unparseable(f"module {m[2]} doesn't end")
            if m.start() > at:
                if len(out) == 1:
                    file.body = content[: m.start()]
                else:
                    out.append(Symbol(stable_id(self.name, f"raw:{path}:{at}"), file.id, "raw", f"item-{at}", content[at : m.start()]))
            s = Symbol(stable_id(self.name, f"module:{file.id}:{m[2]}"), file.id, "module", m[2], content[m.start() : end.end()])
            out.append(s)
            seen = {}
            defs = list(self._DEF.finditer(bare, m.end(), end.start()))
            for d, after in zip(defs, [*(x.start() for x in defs[1:]), end.start()]):
                arity = len([a for a in re.split(r",(?![^(\[{]*[)\]}])", d[4] or "") if a.strip()])
                kind = "macro" if "macro" in d[1] else "function"
                key = (f"{d[2]}/{arity}", d[1])
                if key not in seen:
                    seen[key] = Symbol(stable_id(self.name, f"function:{s.id}:{d[1]}:{key[0]}"), s.id, kind, key[0], "", {"part": True, "private": d[1].endswith("p")})
                    out.append(seen[key])
                seen[key].body += content[d.start() : after]
                calls += [c for c in Code._calls(bare[d.end() : after], seen[key].id, d[2])]
            at = end.end()
        if at < len(content):
            if len(out) == 1:
                file.body = content
            else:
                out.append(Symbol(stable_id(self.name, f"raw:{path}:end"), file.id, "raw", "item-last", content[at:]))
        return out, calls

    def render(self, symbols):
        return "".join(s.body or "" for s in symbols if not s.metadata.get("part"))
