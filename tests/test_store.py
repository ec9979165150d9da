import pytest
from pyspark.sql import functions as F

from arborlog.operators import visible
from arborlog.simulate import simulate
from arborlog.sources.store import Conflict, Store
from arborlog.sources.tree import ignored, read_source_files
from arborlog.streaming.running import counts_by_window


def create(i, parent=None):
    return {"type": "CreateSymbol", "symbolId": i, "parentId": parent, "kind": "file", "name": i, "metadata": "{}"}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    repo = s.repository("r")
    assert s.repository("r")["id"] == repo["id"]
    main = s.main(repo["id"])["id"]
    cs = s.changeset(repo["id"], s.task(repo["id"], "t"), main, "c")
    assert [s.append(main, cs, [create("a")]), s.append(main, cs, [create("b"), create("c")]), s.append(main, cs, [])] == [[1], [2, 3], []]
    with pytest.raises(Conflict, match="advanced from position 2 to 3"):
        s.append(main, cs, [create("d")], expected=2)
    fork = s.branch(repo["id"], "fork", main)
    assert fork["base_position"] == 3
    s.append(main, cs, [create("d")], expected=3)
    assert s.branch(repo["id"], "fork", main)["base_position"] == 3
    s.append(fork["id"], cs, [create("e")])
    seen = visible.visible_ops(s.operations(), s.table("branches"))
    assert [r["symbol_id"] for r in seen.where(F.col("log_id") == fork["id"]).orderBy("ordinal").collect()] == ["a", "b", "c", "e"]
    with pytest.raises(LookupError, match="does not exist"):
        s.one("branches", id="none")
    with pytest.raises(ValueError):
        s.slice("other", main, ["a"])
    assert s.one("slices", id=s.slice(repo["id"], main, ["a"]))["base_position"] == 4
    from arborlog.operators.merge import merge_branch

    with pytest.raises(ValueError, match="direct merges"):
        merge_branch(s, main)
    done = merge_branch(s, fork["id"])
    assert (done.outcome, done.appended) == ("SAFE_MERGE", [5])
    assert {r["symbol_id"] for r in s.operations().where(F.col("branch_id") == main).collect()} == {"a", "b", "c", "d", "e"}
    again = merge_branch(s, fork["id"])  # what it brings is there now
    assert again.outcome == "CONFLICT" and again.appended == [] and {r["reason"] for r in again.conflicts.collect()} == {"DUPLICATE_SYMBOL_ID", "DUPLICATE_SYMBOL_NAME"}
    snap = lambda p: spark.createDataFrame([(p, repo["id"], "h", 1, "blob", None, 1, "v")], "path string, repository_id string, content_hash string, byte_len long, handler string, file_symbol_id string, last_import_position long, importer_version string").withColumn("updated_at", F.current_timestamp())
    s.replace_snapshots(main, snap("a"))
    s.replace_snapshots(fork["id"], snap("z"))
    s.replace_snapshots(main, snap("b"))
    assert sorted(r["path"] for r in s.table("source_file_snapshots").collect()) == ["b", "z"]
    s.replace_snapshots(main, snap("b").limit(0))
    assert [r["path"] for r in s.table("source_file_snapshots").collect()] == ["z"]
    other = s.repository("keep")
    s.delete_repository(repo["id"])
    assert [r["id"] for r in s.table("repositories").collect()] == [other["id"]] and s.table("operations").count() == 0


def test_source_tree(spark, tmp_path):
    root = tmp_path / "src"
    for path, text in {"a.py": b"x", "b/c.md": b"# y", "node_modules/z.js": b"1", "b/.gitignore": b"*.log\n!keep.log\n/only\n", "b/x.log": b"1", "b/keep.log": b"2", "b/only/t.py": b"3", "only/t.py": b"4", "g.py": b"# @generated", "r.bin": b"\xff\x00\xfe", "x.min.js": b"1"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text)
    got = {r["path"]: r["content"] for r in read_source_files(spark, str(root)).collect()}
    assert set(got) == {"a.py", "b/c.md", "b/.gitignore", "b/keep.log", "only/t.py", "r.bin"}
    assert got["r.bin"] == "\x00base64\x00/wD+" and got["a.py"] == "x"
    assert ignored("a/b/c.txt", [("", "a/**/c.txt")]) and not ignored("a/b", [("", "b/")])


def test_simulation(spark):
    assert simulate(spark, 512) == {"agents": 512, "safe": 512, "conflicts": 0, "operations": 1027, "symbols": 515, "references": 512, "failures": 0}
    clashing = simulate(spark, 44, True)
    assert clashing["conflicts"] == 4 and clashing["failures"] == 0 and clashing == simulate(spark, 44, True)


def test_stream_counts_equal_batch(spark, tmp_path):
    from arborlog.sources import derive

    ops = derive.agent_ops(spark, "/root/testdata/sf0.001").select("op_type", "created_at")
    ops.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in"))
    q = counts_by_window(stream, width="30 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((r["window"]["start"], r["op_type"], r["operations"]) for r in df.collect())
    assert rows(spark.table("counts")) == rows(counts_by_window(spark.read.parquet(str(tmp_path / "in")), width="30 days"))
