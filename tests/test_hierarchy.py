import random

from arborlog.operators import hierarchy, lineage
from arborlog.plans.queries import QUERIES, main_symbols

SF = "/root/testdata/sf0.001"
COLUMNS = "symbol_id string, parent_id string, kind string, name string, ordinal long"


def walk(rows, root):
    """(pre-order, post-order, depths) of the subtree of a root, by a plain walk."""
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    key = lambda r: (r[4], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "", r[0])
    pre, post, depths = [], [], {}

    def go(i, d):
        pre.append(i)
        depths[i] = d
        for r in sorted(kids.get(i, []), key=key):
            go(r[0], d + 1)
        post.append(i)

    go(root, 0)
    return pre, post, depths


def test_orders_equal_a_walk(spark):
    """Random forests, with nested roots, roots without children, lost parents, equal ordinals and null names; and a deep chain."""
    rng = random.Random(3)
    for n in (1, 30, 60):
        rows = [(f"s{k}", rng.choice([None, "lost", *[f"s{j}" for j in range(max(0, k - 9), k)] * 3]), rng.choice(["a", "b", None]), rng.choice(["x", None, "y"]), rng.randrange(4)) for k in range(n)]
        rows += [(f"d{k}", f"d{k - 1}" if k else None, "a", "x", 0) for k in range(n)]
        roots = [r[0] for r in rows if rng.random() < 0.4] + ["absent"]
        symbols, tops = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(r,) for r in roots], "symbol_id string")
        pre, post = hierarchy.pre_order(symbols, tops), hierarchy.delete_order(symbols, tops)
        assert [t for _, t in pre.dtypes] == ["string", "string", "bigint", "int"] and [t for _, t in post.dtypes] == ["string", "string", "int"]
        ways = {r: walk(rows, r) for r in roots if r != "absent"}
        assert sorted(map(tuple, pre.collect())) == sorted((r, i, d[i], k + 1) for r, (p, _, d) in ways.items() for k, i in enumerate(p))
        assert sorted(map(tuple, post.collect())) == sorted((r, i, k + 1) for r, (_, p, _) in ways.items() for k, i in enumerate(p))


def test_tree_pre_order_keeps_little(spark, monkeypatch):
    """No rows of the log and no leaves are checkpointed, which are kept uncompressed: only roots and symbols with children are."""
    kept = []

    def counted(df):
        done = lineage.settled(df)
        kept.append(done.count())
        return done

    for module in (hierarchy, __import__("arborlog.operators.replay", fromlist=["x"]), __import__("arborlog.plans.queries", fromlist=["x"])):
        monkeypatch.setattr(module, "settled", counted)
    monkeypatch.setattr("arborlog.plans.queries.StateCache", lambda spark: __import__("arborlog.sources.snapshot", fromlist=["x"]).StateCache(spark, f"{lineage.shared_folder(spark)}/apart"))
    rows = QUERIES["tree_pre_order"](spark, SF).count()
    inner = main_symbols(spark, SF).where("kind in ('class', 'module', 'file')").count()
    assert rows > 2 * inner and kept and max(kept) <= inner
