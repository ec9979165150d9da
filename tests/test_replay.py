import random

from arborlog.operators.lineage import settled
from arborlog.operators.replay import OWN, Creates, Replay, in_scope, validate
from arborlog.schema import OPERATION, OPERATION_COLUMNS
from tests.fold import fold


def random_log(rng, n, log, ids=6):
    out = []
    for k in range(n):
        t = rng.choices(["CreateSymbol", "DeleteSymbol", "UpdateSymbol", "MoveSymbol", "CreateReference", "DeleteReference"], [6, 1, 2, 2, 2, 1])[0]
        o = dict.fromkeys(OPERATION_COLUMNS) | {"log_id": log, "ordinal": k + 1, "op_id": f"{log}-{k}", "op_type": t}
        s = lambda: f"s{rng.randrange(ids)}"
        if t == "CreateSymbol":
            o |= {"symbol_id": s(), "parent_id": rng.choice([None, s()]), "kind": rng.choice("ab"), "name": rng.choice(["x", "y", "z"]), "body": rng.choice([None, "b"]), "metadata": "{}"}
        elif t == "UpdateSymbol":
            o |= {"symbol_id": s(), "name": rng.choice([None, "x", "y"]), "body": rng.choice([None, "b2"]), "metadata": rng.choice([None, '{"k":1}'])}
        elif t == "DeleteSymbol":
            o |= {"symbol_id": s()}
        elif t == "MoveSymbol":
            o |= {"symbol_id": s(), "parent_id": rng.choice([None, s()])}
        else:
            o |= {"reference_id": f"r{rng.randrange(3)}"}
            if t == "CreateReference":
                o |= {"from_symbol_id": s(), "to_symbol_id": s(), "kind": "calls"}
        out.append(o)
    return out


def legal_prefix(rng, log):
    """A log that mostly obeys the rules: operations that break one are dropped."""
    ops = []
    for o in random_log(rng, 40, log):
        if fold([*ops, o])[0] is None or rng.random() < 0.02:
            ops.append(o)
    for k, o in enumerate(ops):
        o["ordinal"] = k + 1
    return ops


def frame(spark, logs):
    return spark.createDataFrame([[o[c] for c in OPERATION_COLUMNS] for log in logs for o in log], OPERATION)


def test_replay_equals_fold(spark):
    rng = random.Random(5)
    logs = [random_log(rng, rng.randrange(2, 18), f"a{i}") for i in range(60)] + [legal_prefix(rng, f"b{i}") for i in range(60)]
    r = Replay(settled(frame(spark, logs)))
    failed = {x["log_id"]: x["ordinal"] for x in r.failures.collect()}
    symbols, references = {}, {}
    for x in r.symbols().collect():
        symbols.setdefault(x["log_id"], {})[x["symbol_id"]] = {k: x[k] for k in ("parent_id", "kind", "name", "body", "metadata", "ordinal")}
    for x in r.references().collect():
        references.setdefault(x["log_id"], {})[x["reference_id"]] = {k: x[k] for k in ("from_symbol_id", "to_symbol_id", "kind", "ordinal")}
    for log in logs:
        name = log[0]["log_id"]
        stop, sym, ref = fold(log)
        assert failed.get(name) == stop, name
        assert symbols.get(name, {}) == sym, name
        assert references.get(name, {}) == ref, name
    assert sum(f is not None for f in failed.values()) > 40 and len(failed) < 120
    assert validate(r.symbols(), r.references()).count() == 0


def test_as_of_equals_fold_of_prefix(spark):
    rng = random.Random(9)
    log = [o for o in legal_prefix(rng, "l") if True]
    stop = fold(log)[0]
    log = log[: stop - 1] if stop else log
    r = Replay(settled(frame(spark, [log])))
    for at in (0, 3, len(log) // 2, len(log)):
        got = {x["symbol_id"]: x["name"] for x in r.symbols(at).collect()}
        assert got == {i: s["name"] for i, s in fold(log[:at])[1].items()}


def test_scope_finds_the_same_failures(spark):
    rng = random.Random(11)
    base = []
    while len(base) < 12:
        base = legal_prefix(rng, "base")
        stop = fold(base)[0]
        base = base[: stop - 1] if stop else base
    _, sym, ref = fold(base)
    symbols = spark.createDataFrame([(i, s["parent_id"], s["kind"], s["name"], s["body"], s["metadata"], s["ordinal"]) for i, s in sym.items()], "symbol_id string, parent_id string, kind string, name string, body string, metadata string, ordinal long")
    refs = spark.createDataFrame([(i, r["from_symbol_id"], r["to_symbol_id"], r["kind"], r["ordinal"]) for i, r in ref.items()], "reference_id string, from_symbol_id string, to_symbol_id string, kind string, ordinal long")
    logs = []
    for i in range(60):
        log = random_log(rng, 5, f"w{i}")
        for o in log:
            o["ordinal"] += len(base)
        logs.append(log)
    got = {x["log_id"]: x["ordinal"] for x in Replay(settled(in_scope(frame(spark, logs), symbols, refs)), OWN).failures.collect()}
    for log in logs:
        assert got.get(log[0]["log_id"]) == fold([*base, *log])[0]


def test_replay_of_creates_equals_fold(spark):
    """Imports, which only create, take the shorter way: same first failure, reason and state, whatever goes wrong."""
    rng = random.Random(11)
    logs = []
    for i in range(80):
        ops = []
        for o in random_log(rng, 40, f"c{i}", 12):
            if o["op_type"].startswith("Create") and (fold([*ops, o])[0] is None or rng.random() < (0.3 if o["reference_id"] else 0.02)):
                ops.append(o | {"name": f"{o['name']}{rng.randrange(9)}" if o["name"] else None, "ordinal": len(ops) + 1})
        logs.append(ops)
    ops = settled(frame(spark, logs))
    full, quick = Replay(ops), Creates(ops)
    failures = {tuple(x) for x in quick.failures.collect()}
    assert failures == {tuple(x) for x in full.failures.collect()} and len({x[3] for x in failures}) == 6
    for rows in ("symbols", "references"):
        one, other = getattr(quick, rows)(), getattr(full, rows)()
        assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    stops = {x[0]: x[1] for x in failures}
    assert all(stops.get(log[0]["log_id"]) == fold(log)[0] for log in logs if log) and any(fold(log)[0] is None for log in logs if log)
