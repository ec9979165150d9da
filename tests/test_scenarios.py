import random
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborlog import functions as fn
from arborlog.operators import diff, graph, merge, moves
from arborlog.plans import queries
from arborlog.schema import OPERATION, OPERATION_COLUMNS


def op(log, n, t, **k):
    return tuple((dict.fromkeys(OPERATION_COLUMNS) | {"log_id": log, "ordinal": n, "op_id": f"{log}{n}", "op_type": t} | k)[c] for c in OPERATION_COLUMNS)


def create(log, n, i, name, parent="p"):
    return op(log, n, "CreateSymbol", symbol_id=i, parent_id=parent, kind="method", name=name, metadata="{}")


def link(log, n, i, a, b):
    return op(log, n, "CreateReference", reference_id=i, from_symbol_id=a, to_symbol_id=b, kind="calls")


CASES = {
    "independent_adds": ([create("s", 1, "a", "one")], [create("t", 1, "b", "two")], []),
    "duplicate_name": ([create("s", 1, "a", "audit")], [create("t", 1, "b", "audit")], [("DUPLICATE_SYMBOL_NAME", "a")]),
    "root_name": ([create("s", 1, "a", "f", None)], [create("t", 1, "b", "f", None)], [("DUPLICATE_SYMBOL_NAME", "a")]),
    "same_target_refs": ([link("s", 1, "r1", "a", "x")], [link("t", 1, "r2", "b", "x")], []),
    "duplicate_reference": ([link("s", 1, "r", "a", "x")], [link("t", 1, "r", "b", "y")], [("DUPLICATE_REFERENCE_ID", None)]),
    "duplicate_id": ([create("s", 1, "a", "x")], [create("t", 1, "a", "y")], [("DUPLICATE_SYMBOL_ID", "a")]),
    "ref_to_deleted": ([link("s", 1, "r", "a", "x")], [op("t", 1, "DeleteSymbol", symbol_id="x")], [("REFERENCE_TO_DELETED_SYMBOL", "x")]),
    "deleted_under_ref": ([op("s", 1, "DeleteSymbol", symbol_id="x")], [link("t", 1, "r", "x", "x")], [("REFERENCE_TO_DELETED_SYMBOL", "x")]),
    "double_ref_delete": ([op("s", 1, "DeleteReference", reference_id="r")], [op("t", 1, "DeleteReference", reference_id="r")], [("OVERLAPPING_REFERENCE_WRITE", None)]),
    "overlapping_write": ([op("s", 1, "UpdateSymbol", symbol_id="x", name="n")], [op("t", 1, "MoveSymbol", symbol_id="x", parent_id="q")], [("OVERLAPPING_SYMBOL_WRITE", "x")]),
}


def test_conflicts(spark):
    """All cases as one job: logs of a case are told apart by their names, which keep ids of cases apart too."""
    rename = lambda rows, case: [tuple(f"{case}/{v}" if c in ("log_id", "symbol_id", "parent_id", "reference_id", "from_symbol_id", "to_symbol_id") and v is not None else (f"{case}.{v}" if c == "name" and v is not None else v) for c, v in zip(OPERATION_COLUMNS, r)) for r in rows]
    s = spark.createDataFrame([r for k, c in CASES.items() for r in rename(c[0], k)], OPERATION)
    t = spark.createDataFrame([r for k, c in CASES.items() for r in rename(c[1], k)], OPERATION)
    found = {}
    for r in merge.conflicts(s, t).collect():
        found.setdefault(r["source_log"].split("/")[0], []).append((r["reason"], r["symbol_id"] and r["symbol_id"].split("/")[1]))
    assert found == {k: c[2] for k, c in CASES.items() if c[2]}


def test_validation_rejects_a_rename_onto_a_sibling(spark):
    base = [create("main", 1, "p", "p", None), create("main", 2, "a", "x"), create("main", 3, "b", "y")]
    since = [op("main", 4, "UpdateSymbol", symbol_id="b", name="z")]
    source = [op("s", 1, "UpdateSymbol", symbol_id="a", name="z")]
    frame = lambda rows: spark.createDataFrame(rows, OPERATION)
    got = merge.analyze(frame(base + since), frame(since), frame(source)).collect()
    assert [(r["reason"], r["source_op"], r["detail"]) for r in got] == [("VALIDATION_REJECTED", "s1", "duplicate sibling name")]
    assert merge.analyze(frame(base), frame(base[:0]), frame(source)).count() == 0


def test_callers_and_callees(spark):
    symbols = spark.createDataFrame([("f", None, "file", "f", 1), ("c", "f", "class", "C", 2), ("a", "c", "method", "caller", 3), ("b", "c", "method", "callee", 4)], "symbol_id string, parent_id string, kind string, name string, ordinal long")
    refs = spark.createDataFrame([("r", "a", "b", "calls", 5), ("r2", "a", "b", "calls", 6), ("r3", "a", "c", "uses", 7)], "reference_id string, from_symbol_id string, to_symbol_id string, kind string, ordinal long")
    ask = lambda i: spark.createDataFrame([(i,)], "asked string")
    ids = lambda df: [r["symbol_id"] for r in df.orderBy("rank").collect()]
    assert ids(graph.find_callers(symbols, refs, ask("b"))) == ["a"] and ids(graph.find_callees(symbols, refs, ask("a"))) == ["b"]
    assert ids(graph.find_dependencies(symbols, refs, ask("a"))) == ["c", "b"] and ids(graph.find_dependents(symbols, refs, ask("c"))) == ["a"]
    assert graph.resolve(symbols, "callee") == "b"
    with pytest.raises(LookupError, match="symbol none not found"):
        graph.resolve(symbols, "none")


BASE = {"f": {"parent_id": None, "kind": "file", "name": "f"}, "A": {"parent_id": "f", "kind": "class", "name": "A"}, "B": {"parent_id": "f", "kind": "class", "name": "B"}, "m": {"parent_id": "A", "kind": "method", "name": "m"}}
BASE = {i: {"body": None, "metadata": "{}"} | s for i, s in BASE.items()}


def made(i, parent, kind, name, body=None):
    return {"op_type": "CreateSymbol", "symbol_id": i, "parent_id": parent, "kind": kind, "name": name, "body": body, "metadata": "{}"}


def test_moves():
    gone = lambda i: {"op_type": "DeleteSymbol", "symbol_id": i, "parent_id": None}
    assert moves.collapse_moves([gone("m"), made("m2", "B", "method", "m")], BASE) == [{"op_type": "MoveSymbol", "symbol_id": "m", "parent_id": "B"}]
    stays = [gone("m"), made("m2", "A", "method", "m")]
    assert moves.collapse_moves(stays, BASE) == stays
    edited = moves.collapse_moves([gone("m"), made("m2", "B", "method", "m", "new"), {"op_type": "CreateReference", "symbol_id": None, "from_symbol_id": "m2", "to_symbol_id": "B"}], BASE)
    assert [o["op_type"] for o in edited] == ["MoveSymbol", "CreateReference", "UpdateSymbol"] and edited[1]["from_symbol_id"] == "m" and edited[2]["body"] == "new"
    nested = moves.collapse_moves([gone("m"), gone("A"), made("A2", "B", "class", "A"), made("m2", "A2", "method", "m")], BASE)
    assert nested == [{"op_type": "MoveSymbol", "symbol_id": "A", "parent_id": "B"}]


def test_renames():
    s = lambda name, body: {"kind": "method", "name": name, "body": body}
    a, b = s("a", "one two three four"), s("b", "five six seven eight")
    assert moves.match_symbols([a], [s("z", "one two three four five")]) == [(0, 0)]
    assert moves.match_symbols([a], [s("z", "other words")]) == []
    assert moves.match_symbols([a, b], [s("y", b["body"] + " nine ten"), s("x", a["body"])]) == [(0, 1), (1, 0)]
    with pytest.raises(moves.AmbiguousIdentity):
        moves.match_symbols([a, s("b", a["body"])], [s("x", a["body"]), s("y", a["body"])])


def plain_match(base, edited):
    """The greedy choice by scanning all pairs each time; None: refused."""
    pairs, left, new = [], dict(enumerate(base)), dict(enumerate(edited))

    def take(i, j):
        pairs.append((i, j))
        del left[i], new[j]

    for keys in (("symbol_id", "kind"), ("kind", "name")):
        for j in list(new):
            i = next((i for i, s in left.items() if all(s[k] == new[j][k] for k in keys)), None)
            if i is not None and not (keys[0] == "symbol_id" and new[j]["symbol_id"] is None):
                take(i, j)
    score = lambda i, j: moves.body_similarity(left[i]["body"], new[j]["body"])
    if len(left) == len(new) == 1:
        i, j = *left, *new
        return sorted(pairs + [(i, j)] * (left[i]["kind"] == new[j]["kind"] and score(i, j) >= moves.NEAR))
    while left and new:
        scores = sorted(((score(i, j), -i, -j) for i in left for j in new if left[i]["kind"] == new[j]["kind"]), reverse=True)
        if not scores or scores[0][0] < moves.NEAR or scores[0][0] - (scores[1][0] if len(scores) > 1 else 0.0) < moves.MARGIN:
            return None
        take(-scores[0][1], -scores[0][2])
    return sorted(pairs)


def test_renames_equal_a_scan_of_all_pairs():
    rng, outcomes = random.Random(9), Counter()
    for _ in range(6000):
        side = lambda n, words: [{"symbol_id": rng.choice([None, None, "i", "k"]), "kind": rng.choice("mmmf"), "name": rng.choice("abcdefgh"), "body": rng.choice([None, "", *[" ".join(rng.sample(words, rng.randrange(1, 9)))] * 12])} for _ in range(rng.randrange(n))]
        words = [f"w{i}" for i in range(rng.choice([9, 14, 60]))]
        base, edited = side(6, words), side(6, words)
        edited += [{"symbol_id": None, "kind": s["kind"], "name": "new" + s["name"], "body": (s["body"] or "") + rng.choice(["", " x", " x y"])} for s in base if rng.random() < 0.4]
        want = plain_match(base, edited)
        try:
            got = moves.match_symbols(base, edited)
        except moves.AmbiguousIdentity:
            got = None
        assert got == want, (base, edited)
        outcomes["refused" if want is None else min(len(want), 3)] += 1
    assert min(outcomes[k] for k in ("refused", 0, 1, 2, 3)) > 50


def test_renames_of_a_large_container_take_little_time():
    s = lambda i, name, body: {"symbol_id": None, "kind": "m", "name": f"{name}{i}", "body": body}
    kept = [s(i, "k", "x") for i in range(20_000)]
    gone = [s(i, "gone", f"part p{i} q{i} r{i} s{i}") for i in range(2_000)]
    start = time.monotonic()
    assert len(moves.match_symbols(kept + gone + [s(0, "old", "one two three")], kept[::-1] + [s(0, "new", "one two three")])) == 20_001
    with pytest.raises(moves.AmbiguousIdentity):
        moves.match_symbols(kept + gone, kept + [s(i, "new", g["body"]) for i, g in enumerate(gone)])
    assert time.monotonic() - start < 20


def test_renames_are_asked_of_whole_brands(spark):
    sf = "/root/testdata/sf0.001"
    brands = Counter(r["p_brand"] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_brand").collect())
    found = queries.QUERIES["rename_detection"](spark, sf).where("base_name is not null").groupBy("container").count().collect()
    assert {r["container"]: r["count"] for r in found} == brands


def test_functions(spark):
    # nothing, here, from the top, upwards at once and later on, a backslash, a drive; then fine ones and a leading dot
    paths = ["", ".", "/etc", "../k", "lib/k/../../..", "lib\\k.go", "Z:/k", "lib/k.go", "lib//k", "lib/./k", "./lib"]
    names = ["agent-0", "", "é∑", "x" * 70]
    rows = spark.createDataFrame([(p, n) for p, n in zip(paths, names * 3)], "p string, n string")
    got = rows.select("p", fn.safe_path(F.col("p")).alias("ok"), "n", fn.fnv1a64(F.col("n")).alias("h"), fn.stable_id("x", F.col("n")).alias("u"), fn.slug(F.col("n")).alias("s")).collect()
    assert {r["p"]: r["ok"] for r in got} == {p: p in ("lib/k.go", "lib//k", "lib/./k") for p in paths}
    for r in got:
        h = 0xCBF29CE484222325
        for c in r["n"].encode():
            h = (h ^ c) * 0x100000001B3 % 2**64
        assert r["h"] == f"{h:016x}" and r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"https://symbols.local/x/{r['n']}"))
    docs = spark.createDataFrame([('{"a":"x","b":1,"c":true}',), ("no",), (None,)], "d string")
    assert [tuple(r) for r in docs.select(fn.metadata_string(F.col("d"), "a"), fn.metadata_string(F.col("d"), "b"), fn.metadata_bool(F.col("d"), "c"), fn.metadata_bool(F.col("d"), "a")).collect()] == [("x", None, True, False), (None, None, False, False), (None, None, False, False)]
    raw = spark.createDataFrame([(bytearray(b"\xff\x00\xfe\x42\x00\x99"),), (bytearray(b"text"),)], "b binary").select("b", fn.text_or_envelope(F.col("b")).alias("t"))
    assert all(bytes(r["b"]) == bytes(r["x"]) for r in raw.select("b", fn.bytes_of(F.col("t")).alias("x")).collect())


def test_ingest_plan_and_modes(spark):
    files = spark.createDataFrame([("keep", "1"), ("change", "2"), ("fresh", "3"), ("version", "4")], "path string, content string")
    snapshots = files.where("path <> 'fresh'").select("path", F.sha2(F.when(F.col("path") == "change", "old").otherwise(F.col("content")), 256).alias("content_hash"), F.when(F.col("path") == "version", "v0").otherwise(diff.IMPORTER_VERSION).alias("importer_version")).unionAll(spark.createDataFrame([("gone", "h", diff.IMPORTER_VERSION)], "path string, content_hash string, importer_version string"))
    assert {r["path"]: r["state"] for r in diff.ingest_plan(files, snapshots).collect()} == {"keep": "unchanged", "change": "changed", "fresh": "added", "version": "changed", "gone": "deleted"}
    assert diff.import_mode(0, 0, False) == "full" and diff.import_mode(5, 2, False) == "incremental" and diff.import_mode(5, 0, True) == "full"
    with pytest.raises(ValueError):
        diff.import_mode(5, 0, False)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_conflict_report_ranks_all_reasons(spark):
    """Against its SQL: every pair of conflicting operations, by whichever rule, has a place in the report."""
    duckdb = pytest.importorskip("duckdb")
    sf, name = "/root/testdata/sf0.001", "conflict_report_whole"
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "part", "lineitem", "events"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    want = Counter(db.sql(f"select {', '.join(found.columns)} from ({queries.ORACLE_SQL[name]})").fetchall())
    assert Counter(map(tuple, found.collect())) == want
    assert {r[2] for r in want} == {"DUPLICATE_SYMBOL_ID", "DUPLICATE_SYMBOL_NAME", "OVERLAPPING_SYMBOL_WRITE", "REFERENCE_TO_DELETED_SYMBOL"}


def test_report_ranks_reference_conflicts(spark):
    s = spark.createDataFrame([link("s", 1, "r", "a", "x"), op("s", 2, "DeleteReference", reference_id="q"), op("s", 3, "UpdateSymbol", symbol_id="x", name="n")], OPERATION)
    t = spark.createDataFrame([link("t", 1, "r", "b", "y"), op("t", 2, "DeleteReference", reference_id="q"), op("t", 3, "UpdateSymbol", symbol_id="x", name="m")], OPERATION)
    got = merge.ranked(merge.conflicts(s, t)).orderBy("rank").collect()
    assert [(r["rank"], r["reason"], r["source_op"], r["target_op"]) for r in got] == [(1, "DUPLICATE_REFERENCE_ID", "s1", "t1"), (2, "OVERLAPPING_REFERENCE_WRITE", "s2", "t2"), (3, "OVERLAPPING_SYMBOL_WRITE", "s3", "t3")]


def test_move_detection_is_given_all_customers(spark, monkeypatch):
    sf, bases = "/root/testdata/sf0.001", []
    detect = moves.detect_moves
    monkeypatch.setattr(moves, "detect_moves", lambda plans, base: bases.append(base) or detect(plans, base))
    found = queries.QUERIES["move_detection"](spark, sf)
    want = spark.read.parquet(f"{sf}/customer.parquet").count() + spark.read.parquet(f"{sf}/orders.parquet").count()
    assert bases[0].count() == want
    moved = {r["symbol_id"] for r in found.where("op_type = 'MoveSymbol'").collect()}
    assert moved == {f"customer:{r['c_custkey']}" for r in spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 3 = 0").collect()}


def recovered(base, refs, want, want_refs, files, create_files, all_references):
    """The plan as sets, by plain loops."""
    by = {s["symbol_id"]: s for s in base}
    new = {s["symbol_id"]: s for s in want}

    def above(i, of):
        out = []
        while i in of:
            out.append(i)
            i = of[i]["parent_id"]
        return out

    target = {i for i in by if any(a in files for a in above(i, by))}
    gone = {i for i in by if any(a in target and a not in new for a in above(i, by))}
    edits = {i for i in target & set(new) if by[i]["name"] != new[i]["name"] or (new[i]["body"] is not None and by[i]["body"] != new[i]["body"])}
    file_of = lambda i: next((a for a in above(i, new) if new[a]["kind"] == "file"), None)
    made = {i for i in new if i not in by and (create_files is None or file_of(i) in create_files)}
    changed, ref_ids, want_ids = gone | edits | made, {r["reference_id"] for r in refs}, {r["reference_id"] for r in want_refs}
    out = {("DeleteReference", r["reference_id"]) for r in refs if r["reference_id"] not in want_ids and (r["from_symbol_id"] in changed or r["to_symbol_id"] in gone)}
    out |= {("DeleteSymbol", i) for i in gone} | {("UpdateSymbol", i) for i in edits} | {("CreateSymbol", i) for i in made}
    return out | {("CreateReference", r["reference_id"]) for r in want_refs if r["reference_id"] not in ref_ids and (all_references or r["from_symbol_id"] in changed)}


def test_recovery_against_a_fold(spark):
    import random

    schema = "symbol_id string, parent_id string, kind string, name string, body string, metadata string, ordinal long"
    ref_schema = "reference_id string, from_symbol_id string, to_symbol_id string, kind string, ordinal long"
    for seed, scoped, create, every in ((1, False, False, True), (2, True, True, False)):
        rng = random.Random(seed)
        base = [{"symbol_id": f"f{k}", "parent_id": None, "kind": "file", "name": f"f{k}", "body": None, "metadata": "{}", "ordinal": k} for k in range(4)]
        for k in range(4, 40):
            base.append({"symbol_id": f"s{k}", "parent_id": rng.choice(base)["symbol_id"], "kind": "method", "name": f"n{k}", "body": rng.choice(["a", None]), "metadata": "{}", "ordinal": k})
        want = [dict(s, name=s["name"] + "!" * (rng.random() < 0.2), body=rng.choice([s["body"], "b"])) for s in base if rng.random() < 0.85]
        want += [{"symbol_id": f"x{k}", "parent_id": rng.choice(want)["symbol_id"], "kind": "method", "name": f"x{k}", "body": "n", "metadata": "{}", "ordinal": 100 + k} for k in range(6)]
        ids, new_ids = [s["symbol_id"] for s in base], [s["symbol_id"] for s in want]
        refs = [{"reference_id": f"r{k}", "from_symbol_id": rng.choice(ids), "to_symbol_id": rng.choice(ids), "kind": "calls", "ordinal": 200 + k} for k in range(20)]
        want_refs = [r for r in refs if rng.random() < 0.6] + [{"reference_id": f"q{k}", "from_symbol_id": rng.choice(new_ids), "to_symbol_id": rng.choice(new_ids), "kind": "calls", "ordinal": 300 + k} for k in range(8)]
        files, made_in = ({"f0", "f2"} if scoped else {f"f{k}" for k in range(4)}), ({"f0"} if create else None)
        frame = lambda rows, ddl: spark.createDataFrame([tuple(r.values()) for r in rows], ddl)
        named = lambda x: spark.createDataFrame([(i,) for i in sorted(x)], "file_id string")
        plan = diff.recover(frame(base, schema), frame(refs, ref_schema), frame(want, schema), frame(want_refs, ref_schema), named(files) if scoped else None, named(made_in) if create else None, every).collect()
        assert {(r["op_type"], r["symbol_id"] or r["reference_id"]) for r in plan} == recovered(base, refs, want, want_refs, files, made_in, every)
        assert len(plan) == len({(r["op_type"], r["symbol_id"], r["reference_id"]) for r in plan})
        parent = {s["symbol_id"]: s["parent_id"] for s in base}
        deletes = [r["symbol_id"] for r in sorted(plan, key=lambda r: (r["phase"], r["seq"])) if r["op_type"] == "DeleteSymbol"]
        assert deletes and all(parent[i] not in deletes[:k] for k, i in enumerate(deletes))


def test_cycles_of_parents_are_an_error(spark):
    from arborlog.operators import hierarchy

    rows = [(f"s{k}", f"s{(k + 1) % 5}", "method", f"n{k}", 0) for k in range(5)]
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.root_ancestor(spark.createDataFrame(rows, "symbol_id string, parent_id string, kind string, name string, ordinal long"))


def test_texts(spark):
    rows = [("a<b>&\"'c", "é" * 5 + "x", "    a\n\n      b\n", "2024-01-02T03:04:05Z"), ("", "日本", "\tq", "no"), (None, None, None, None)]
    got = spark.createDataFrame(rows, "h string, e string, d string, t string").select(fn.html_escape(F.col("h")), fn.excerpt(F.col("e"), 4), fn.dedent(F.col("d")), fn.parse_timestamp(F.col("t")).cast("string"), fn.percent_encode(F.col("e"))).collect()
    assert [r[0] for r in got] == ["a&lt;b&gt;&amp;&quot;&#39;c", "", None]
    assert [tuple(r[1]) for r in got[:2]] == [("éé", 7), ("日", 3)]
    assert [r[2] for r in got] == ["a\n\n  b\n", "q", None] and [r[3] for r in got] == ["2024-01-02 03:04:05", None, None]
    assert got[0][4] == "%C3%A9" * 5 + "x"
