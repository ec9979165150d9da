"""Python files: classes with attributes and methods, functions, values, and calls between them. Rendered canonically."""

from __future__ import annotations

import ast

from arborlog.handlers.base import Call, Handler, Symbol, Unparseable, stable_id


class Python(Handler):
    name, suffixes = "python", (".py", ".pyi")

    def shred(self, path, content):
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError, RecursionError) as e:
            raise Unparseable(str(e)) from e
        lines = content.splitlines(keepends=True)

        def text(node):
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            return "".join(lines[first - 1 : node.end_lineno]).rstrip("\n") + "\n"

        taken, out, calls = [], [], []
        values: dict[str, tuple[int, Symbol]] = {}
        file = self.file(path)
        functions = (ast.FunctionDef, ast.AsyncFunctionDef)
        for node in tree.body:
            if isinstance(node, ast.ClassDef):
                c = Symbol(stable_id(self.name, f"class:{path}:{node.name}"), file.id, "class", node.name, None, {"head": self._head(node, lines)})
                if any(s.id == c.id for s in out):
                    raise Unparseable(f"class {node.name} is defined twice")
                out.append(c)
                members: dict[str, Symbol] = {}
                for m in node.body:
                    if isinstance(m, functions):
                        s = Symbol(stable_id(self.name, f"method:{c.id}:{m.name}"), c.id, "method", m.name, text(m))
                        members[s.id] = s
                        calls += self._calls(m, s.id)
                    elif n := self._assigned(m):
                        s = Symbol(stable_id(self.name, f"attribute:{c.id}:{n}"), c.id, "attribute", n, text(m))
                        members[s.id] = s
                    else:
                        c.metadata["head"] += text(m)
                out += members.values()  # the last definition of a name counts
            elif isinstance(node, functions):
                s = Symbol(stable_id(self.name, f"function:{path}:{node.name}"), file.id, "function", node.name, text(node))
                out = [x for x in out if x.id != s.id] + [s]
                calls += self._calls(node, s.id)
            elif n := self._assigned(node):
                values[n] = (len(out), Symbol(stable_id(self.name, f"value:{path}:{n}"), file.id, "value", n, text(node)))
            else:
                continue
            taken.append((min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), node.end_lineno))
        covered = {i for a, b in taken for i in range(a, b + 1)}
        file.body = "".join(x for i, x in enumerate(lines, 1) if i not in covered).strip("\n")
        return [file, *out, *(s for _, s in values.values())], calls

    @staticmethod
    def _head(node, lines):
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        return "".join(lines[first - 1 : node.body[0].lineno - 1 - len(getattr(node.body[0], "decorator_list", []))]) or lines[first - 1]

    @staticmethod
    def _assigned(node):
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            return node.targets[0].id
        if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            return node.target.id
        return None

    @staticmethod
    def _calls(node, source):
        out = []
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                f = x.func
                if isinstance(f, ast.Name):
                    out.append(Call(source, f.id, "bare"))
                elif isinstance(f, ast.Attribute):
                    own = isinstance(f.value, ast.Name) and f.value.id in ("self", "cls")
                    out.append(Call(source, f.attr, "local" if own else "member"))
        return out

    def render(self, symbols):
        file, rest = symbols[0], symbols[1:]
        parts = [file.body + "\n"] if file.body else []
        for c in (s for s in rest if s.kind == "class"):
            own = [s for s in rest if s.parent == c.id]
            inner = "".join(s.body or "" for s in own if s.kind == "attribute") + "\n".join(s.body or "" for s in own if s.kind == "method")
            parts.append(c.metadata["head"] + (inner or ("" if c.metadata["head"].count("\n") > 1 else "    pass\n")))
        parts += [s.body or "" for s in rest if s.kind == "function"]
        values = "".join(s.body or "" for s in rest if s.kind == "value")
        return "\n\n".join(p.strip("\n") + "\n" for p in [*parts, *([values] if values else [])])
