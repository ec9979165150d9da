import pytest

from arborlog.handlers import import_files, render_files, router, validate_files
from arborlog.handlers.data import Blob, Json, Toml, Yaml
from arborlog.handlers.markdown import Markdown, slug
from arborlog.handlers.python import Python
from arborlog.operators.replay import Replay

TOML = '# top comment\nname = "x"\n\n[package]\na = 1 # [no]\nb = """\n[not]\n"""\n\n[[bin]]\nc = [\n  1,\n]\n[[bin]]\nd = 2\n'
YAML = "# c\na: 1\nb:\n  x: 1\n  y: 2\n\"q r\": z\nlist:\n- a: 1\n- b\na2: |\n  text: no\n"
MD = "---\ntitle: x\n---\nintro [a](other.md#Sub-Part)\n\n# One\ntext ![p](img/p.png) <b>\n```py\n# not a heading\n```\n## Sub\nSetext\n===\n## Sub\n# One\nend [w](https://x.y) `[c](d)`\n"
PY = '"""doc"""\nimport os\n\nLIMIT = 1\n\n@deco\nclass A(B):\n    """d"""\n    x: int = 2\n\n    def run(self):\n        return self.go() + helper(1)\n\n    def go(self):\n        return LIMIT\n\ndef helper(n):\n    return n\n\nLIMIT = 2\n'


@pytest.mark.parametrize("handler, path, text", [(Toml(), "a.toml", TOML), (Yaml(), "a.yml", YAML), (Markdown(), "a.md", MD), (Blob(), "a.x", "any\0thing"), (Toml(), "e.toml", ""), (Yaml(), "e.yml", "\n"), (Markdown(), "e.md", ""), (Markdown(), "c.md", "a\r\n# b\r\nc")])
def test_exact_round_trip(handler, path, text):
    assert handler.render(handler.shred(path, text)[0]) == text


def test_sections():
    assert [(s.kind, s.name) for s in Toml().shred("a.toml", TOML)[0][1:]] == [("table", "package"), ("table-array", "bin"), ("table-array", "bin (2)")]
    assert [s.name for s in Yaml().shred("a.yml", YAML)[0][1:]] == ["a", "b", "q r", "list", "a2"]
    symbols, calls = Markdown().shred("d/a.md", MD)
    assert [(s.name, s.metadata["level"]) for s in symbols if s.kind == "section"] == [("One", 1), ("Sub", 2), ("Setext", 1), ("Sub", 2), ("One (2)", 1)]
    assert {(c.name, c.how) for c in calls} == {("d/other.md#sub-part", "links-to"), ("d/img/p.png", "embeds")}
    assert slug("Ünï  code -- x!") == "ünï-code-x" and slug("!") == "section"


def test_editing_one_section_changes_one_symbol():
    a, b = Yaml().shred("a.yml", YAML)[0], Yaml().shred("a.yml", YAML.replace("z\n", "zz\n"))[0]
    assert [s.name for s, t in zip(a, b) if s != t] == ["q r"]


def test_json():
    j = Json()
    assert j.render(j.shred("a.json", '{"b": 1.0, "a": [1, "é"]}')[0]) == '{\n  "a": [\n    1,\n    "é"\n  ],\n  "b": 1.0\n}\n'
    assert j.render(j.shred("a.json", "[1]")[0]) == "[\n  1\n]\n" and j.render(j.shred("a.json", "{}")[0]) == "{}\n"
    big = '{"k": "' + "x" * 600_000 + '"}'
    assert j.render(j.shred("a.json", big)[0]) == big


def test_python():
    p = Python()
    symbols, calls = p.shred("m.py", PY)
    assert [(s.kind, s.name) for s in symbols] == [("file", "m.py"), ("class", "A"), ("attribute", "x"), ("method", "run"), ("method", "go"), ("function", "helper"), ("value", "LIMIT")]
    assert {(c.name, c.how) for c in calls} == {("go", "local"), ("helper", "bare")}
    again = p.shred("m.py", p.render(symbols))[0]
    assert [(s.kind, s.name, s.body) for s in again if s.kind != "file"] == [(s.kind, s.name, s.body) for s in symbols if s.kind != "file"]
    compile(p.render(symbols), "m.py", "exec")


def test_import_and_render(spark):
    files = [("a.toml", TOML), ("b.yml", YAML), ("d/a.md", MD), ("d/other.md", "# Sub part\n"), ("m.py", PY), ("bad.py", "def ("), ("x.bin", "raw"), ("c.json", "{}\n")]
    table = spark.createDataFrame(files, "path string, content string")
    symbols, references = import_files(table)
    symbols = symbols.cache()
    assert {r["path"]: r["handler"] for r in symbols.where("seq = 0").collect()} == {"a.toml": "toml", "b.yml": "yaml", "d/a.md": "markdown", "d/other.md": "markdown", "m.py": "python", "bad.py": "blob", "x.bin": "blob", "c.json": "json"}
    assert symbols.where("error is not null").select("path").collect()[0][0] == "bad.py"
    back = {r["path"]: r["content"] for r in render_files(symbols).collect()}
    assert {p: back[p] for p, _ in files if p != "m.py"} == {p: c for p, c in files if p != "m.py"}
    names = {r["symbol_id"]: r["name"] for r in symbols.collect()}
    found = {(names[r["from_symbol_id"]], names[r["to_symbol_id"]], r["kind"]) for r in references.collect()}
    assert found == {("run", "go", "calls"), ("run", "helper", "calls"), ("a 1", "Sub part", "links-to")}
    ops = router.as_operations(symbols, references)
    replay = Replay(ops.cache())
    assert replay.failures.count() == 0 and replay.symbols().count() == symbols.count()
    ok = {r["path"]: r["ok"] for r in validate_files(table).collect()}
    assert ok == {p: p != "bad.py" for p, _ in files}
    with pytest.raises(Exception, match="(?i)syntax|invalid"):
        import_files(table, strict=True)[0].collect()


TS = 'import x from "y";\n\n/** doc */\nexport class A extends B {\n  private n = 1;\n  static make(): A { return new A(); }\n  get size() { return this.n; }\n  run(a: string) {\n    this.go(`}{`);\n    helper(a);\n  }\n  go() {} // {\n}\n\nconst k = { a: 1 };\nexport async function helper(x) { return x; }\n'
GO = 'package p\n\nimport "fmt"\n\n// S is.\ntype S struct {\n\tA int\n\tb *T\n}\n\ntype I interface {\n\tDo(x int) error\n}\n\nconst K = 1\n\nfunc (s *S) Run() { fmt.Println("{"); help() }\n\nfunc help() int {\n\treturn 1\n}\n'
RS = "use a::b;\n\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\n\nimpl<'a> S<'a> {\n    pub fn run(&self) -> char { helper(); '{' }\n    fn go(&self) { self.run(); }\n}\n\npub const N: usize = 3;\nfn helper() {}\n"
CS = "using System;\n\nnamespace N {\n  public class A {\n    private int n = 0;\n    public int Size { get; set; }\n    public A(int n) { this.n = n; }\n    public void Run() { Go(); }\n    void Go() {}\n  }\n}\n"
EX = 'defmodule A.B do\n  @doc "x end"\n  def run(a, b), do: go(a)\n  def run(a, {b, c}) do\n    go(a)\n  end\n\n  defp go(a) do\n    a\n  end\nend\n\n# tail\n'


@pytest.mark.parametrize(
    "path, text, found",
    [
        ("a.ts", TS, [("class", "A"), ("property", "n"), ("static-method", "make"), ("getter", "size"), ("method", "run"), ("method", "go"), ("raw", "item-0002"), ("function", "helper")]),
        ("a.go", GO, [("struct", "S"), ("field", "A"), ("field", "b"), ("raw", "item-0002"), ("interface", "I"), ("interface-method", "Do"), ("raw", "item-0003"), ("const", "K"), ("method", "Run"), ("raw", "item-0004"), ("function", "help")]),
        ("a.rs", RS, [("struct", "S"), ("raw", "item-0002"), ("impl", "<'a> S<'a>"), ("method", "run"), ("method", "go"), ("raw", "item-0003"), ("const", "N"), ("function", "helper")]),
        ("a.cs", CS, [("namespace", "N"), ("class", "A")]),
        ("a.ex", EX, [("module", "A.B"), ("function", "run/2"), ("function", "go/1"), ("raw", "item-last")]),
    ],
)
def test_code(path, text, found):
    handler = next(h for h in router.HANDLERS if h.claims(path))
    symbols, calls = handler.shred(path, text)
    assert handler.render(symbols) == text
    assert [(s.kind, s.name) for s in symbols[1:]] == found
    if path == "a.ts":
        assert {(c.name, c.how) for c in calls} >= {("go", "local"), ("helper", "bare")}
    assert len({s.id for s in symbols}) == len(symbols)


def test_broken_code_degrades():
    for path in ("a.ts", "a.go", "a.rs", "a.cs"):
        handler = next(h for h in router.HANDLERS if h.claims(path))
        assert handler.check(path, "func f( {") is not None
    assert next(h for h in router.HANDLERS if h.claims("x.d.ts")).name == "blob"
