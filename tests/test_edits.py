"""Edits of files back to operations, and the queries of moves, links and merges against their SQL."""

from collections import Counter

import pytest

from arborlog.handlers import import_files
from arborlog.handlers.recover import recover_files
from arborlog.operators.lineage import settled
from arborlog.plans.edits import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "orders", "part", "lineitem", "events", "pages")


@pytest.mark.parametrize("name", ["rename_detection", "rename_detection_by_size", "move_detection", "markdown_structure", "markdown_links", "recover_edited_files", "sliced_files", "validate_problems", "conflicts_of_references", "edited_symbols", "edited_references", "edit_failures"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    want = Counter(db.sql(f"select {', '.join(found.columns)} from ({ORACLE_SQL[name]})").fetchall())
    assert want and Counter(map(tuple, found.collect())) == want


def test_renames_have_all_outcomes(spark):
    """The two queries aren't refusals alone."""
    found = {r["outcome"] for n in ("rename_detection", "rename_detection_by_size") for r in QUERIES[n](spark, SF).select("outcome").distinct().collect()}
    assert found == {"kept", "renamed", "deleted", "ambiguous"}


def plan_of(symbols, references, spark, files, relink):
    edited = spark.createDataFrame(files, "path string, content string")
    return [(r["op_type"], r["name"]) for r in recover_files(symbols, references, edited, relink).orderBy("phase", "seq").collect()]


def test_recovery_of_edited_files(spark):
    files = [("a.md", "# one\n\nsee [b](b.md#two)\n"), ("b.md", "# two\n\ntext\n"), ("c.json", '{"k": 1, "m": 2}'), ("d.txt", "x")]
    symbols, references = (settled(x) for x in import_files(spark.createDataFrame(files, "path string, content string")))
    none = lambda relink: plan_of(symbols, references, spark, files[:2], relink)
    assert none(True) == [] and none(False) == []
    # a link that is gone, a key that is new and one that is gone, a file that is new; files that aren't named stay
    assert plan_of(symbols, references, spark, [("a.md", "# one\n\nno link\n")], True) == [("DeleteReference", None), ("DeleteSymbol", None), ("UpdateSymbol", None)]
    assert plan_of(symbols, references, spark, [("c.json", '{"k": 1, "n": 3}')], False) == [("DeleteSymbol", None), ("CreateSymbol", "n")]
    assert plan_of(symbols, references, spark, [("e.md", "# new\n\n[a](a.md#one)\n")], True) == [("CreateSymbol", "e.md"), ("CreateSymbol", "new"), ("CreateSymbol", "a 1"), ("CreateReference", None)]
    # no edits at all
    assert plan_of(symbols, references, spark, [], False) == []
