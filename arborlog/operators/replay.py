"""Replay of operation logs as sets: versions of symbols and references, rules checked by joins, state at any point.

Each operation of a log (log_id) has an ordinal. An operation that writes a symbol closes the version
before it and opens one that later operations see: a version [lo, hi) is seen by operations with
lo < ordinal <= hi. A rule then asks whether some version is, or isn't, seen by an operation. The first
operation that breaks a rule ends the log's replay; what the versions say before it is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlog.operators import hierarchy
from arborlog.operators.lineage import settled, stored

#: hi of a version that nothing closes.
END = (1 << 63) - 1
#: Deepest nesting that a move may climb; more is an error.
MAX_DEPTH = 10_000
SYMBOL = ["log_id", "symbol_id", "parent_id", "kind", "name", "body", "metadata", "born", "lo", "hi"]


def symbol_versions(ops: DataFrame) -> DataFrame:
    """Versions of symbols: (log_id, symbol_id, parent_id, kind, name, body, metadata, born, lo, hi)."""
    events = ops.where("op_type in ('CreateSymbol', 'UpdateSymbol', 'MoveSymbol', 'DeleteSymbol')")
    w = Window.partitionBy("log_id", "symbol_id").orderBy("ordinal")
    born, op = F.col("op_type") == "CreateSymbol", F.col("op_type")

    def kept(value, when):
        """The latest value that was written; a struct, so that a null that was written counts."""
        return F.last(F.when(when, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"]

    return (
        events.select(
            "log_id", "symbol_id", "op_type",
            kept(F.col("parent_id"), born | (op == "MoveSymbol")).alias("parent_id"),
            kept(F.col("kind"), born).alias("kind"),
            kept(F.col("name"), born | F.col("name").isNotNull() & (op == "UpdateSymbol")).alias("name"),
            kept(F.col("body"), born | F.col("body").isNotNull() & (op == "UpdateSymbol")).alias("body"),
            kept(F.col("metadata"), born | F.col("metadata").isNotNull() & (op == "UpdateSymbol")).alias("metadata"),
            kept(F.col("ordinal"), born).alias("born"),
            F.col("ordinal").alias("lo"),
            F.lead("ordinal", 1, END).over(w).alias("hi"),
        )
        .where(op != "DeleteSymbol")
        .select(*SYMBOL)
    )


def reference_versions(ops: DataFrame) -> DataFrame:
    """Versions of references: (log_id, reference_id, from_symbol_id, to_symbol_id, kind, born, lo, hi)."""
    w = Window.partitionBy("log_id", "reference_id").orderBy("ordinal")
    return (
        ops.where("op_type in ('CreateReference', 'DeleteReference')")
        .select("log_id", "reference_id", "from_symbol_id", "to_symbol_id", "kind", "op_type", F.col("ordinal").alias("born"), F.col("ordinal").alias("lo"), F.lead("ordinal", 1, END).over(w).alias("hi"))
        .where("op_type = 'CreateReference'")
        .drop("op_type")
    )


def _facts(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """What rules ask for, by topic and key: live symbols, children, takers of a sibling name, live references, reference ends."""
    one = lambda df, topic, key, own: df.where(F.col(key).isNotNull() if isinstance(key, str) else F.lit(True)).select("log_id", F.lit(topic).alias("topic"), (F.col(key) if isinstance(key, str) else key).alias("key"), F.col(own).alias("own"), "lo", "hi")
    found = [
        one(symbols, "symbol", "symbol_id", "symbol_id"),
        one(symbols, "child", "parent_id", "symbol_id"),
        one(symbols, "name", _name_key(), "symbol_id"),
        one(references, "reference", "reference_id", "reference_id"),
        one(references, "end", "from_symbol_id", "reference_id"),
        one(references, "end", "to_symbol_id", "reference_id"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out.select(*[F.col(c).alias(f"f_{c}") for c in out.columns])


def _name_key() -> Column:
    """Parent, kind and name as one string; lengths keep different triples apart, and a null parent is a value."""
    part = lambda c: F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.concat(part("parent_id"), part("kind"), part("name"))


@dataclass
class Replay:
    """Replay of ops(log_id, ordinal, op_id, op_type, ...), for all logs at once.

    Joins are equi joins on log and id with the version's range as a residual; windows are by log and id.
    A move's ancestors are climbed by a recursive query that starts from the moves only.
    asked: which operations are held against the rules; the others are taken as they are.
    """

    ops: DataFrame
    asked: str = "true"

    @cached_property
    def symbols_all(self) -> DataFrame:
        return symbol_versions(self.ops)

    @cached_property
    def references_all(self) -> DataFrame:
        return reference_versions(self.ops)

    def settle(self) -> Replay:
        """Versions computed once, for the many questions that rules ask of them."""
        self.symbols_all, self.references_all = settled(self.symbols_all), settled(self.references_all)
        return self

    @cached_property
    def violations(self) -> DataFrame:
        """(log_id, ordinal, op_id, rule, reason): each rule that an operation breaks, given the versions. Only a log's first ordinal is meaningful.

        Each rule is a question of an operation: a topic and a key that must, or must not, be there. All
        questions meet all facts in two equi joins on log, topic and key, one for each kind of answer.
        """
        c, none = F.col, F.lit(None).cast("string")
        asked = self.ops.where(self.asked)
        of = lambda t: c("op_type") == t
        q = lambda rule, reason, must, topic, key: F.struct(F.lit(rule).alias("rule"), F.lit(reason).alias("reason"), F.lit(must).alias("must"), F.lit(topic).alias("topic"), key.alias("key"))
        # three at most for each type; a plain array of cases, as a filtered one would leave generated code
        questions = [
            F.when(of("CreateSymbol"), q(1, "duplicate symbol id", False, "symbol", c("symbol_id")))
            .when(of("DeleteSymbol"), q(1, "cannot delete missing symbol", True, "symbol", c("symbol_id")))
            .when(of("UpdateSymbol"), q(1, "cannot update missing symbol", True, "symbol", c("symbol_id")))
            .when(of("MoveSymbol"), q(1, "cannot move missing symbol", True, "symbol", c("symbol_id")))
            .when(of("CreateReference"), q(1, "duplicate reference id", False, "reference", c("reference_id")))
            .when(of("DeleteReference"), q(1, "cannot delete missing reference", True, "reference", c("reference_id"))),
            F.when(of("CreateSymbol") & c("parent_id").isNotNull(), q(2, "parent symbol does not exist", True, "symbol", c("parent_id")))
            .when(of("DeleteSymbol"), q(2, "symbol still contains children", False, "child", c("symbol_id")))
            .when(of("MoveSymbol") & c("parent_id").isNotNull(), q(3, "parent symbol does not exist", True, "symbol", c("parent_id")))
            .when(of("CreateReference"), q(2, "reference source does not exist", True, "symbol", c("from_symbol_id"))),
            F.when(of("CreateSymbol"), q(3, "duplicate sibling name", False, "name", _name_key()))
            .when(of("DeleteSymbol"), q(3, "references still point at it", False, "end", c("symbol_id")))
            .when(of("CreateReference"), q(3, "reference target does not exist", True, "symbol", c("to_symbol_id"))),
        ]
        key = ["log_id", "ordinal", "op_id"]
        plain = asked.select(*key, none.alias("but"), F.explode(F.array(*questions)).alias("q")).where("q is not null")
        # a rename or move asks for the name that it leads to, with the kind and the rest as they stand
        now = self.symbols_all.select(*[c(x).alias(f"v_{x}") for x in ("log_id", "symbol_id", "parent_id", "kind", "name", "lo", "hi")])
        placed = asked.where("op_type = 'MoveSymbol' or op_type = 'UpdateSymbol' and name is not null").join(
            now, (c("v_log_id") == c("log_id")) & (c("v_symbol_id") == c("symbol_id")) & (c("v_lo") < c("ordinal")) & (c("ordinal") <= c("v_hi"))
        ).select(*key, "op_type", c("symbol_id").alias("but"), F.when(of("MoveSymbol"), c("parent_id")).otherwise(c("v_parent_id")).alias("parent_id"), c("v_kind").alias("kind"), F.coalesce("name", "v_name").alias("name"))
        named = placed.select(*key, "but", F.when(of("MoveSymbol"), q(5, "duplicate sibling name", False, "name", _name_key())).otherwise(q(2, "duplicate sibling name", False, "name", _name_key())).alias("q"))
        # settled, as the optimizer would else push what the joins below ask into the join above, where it is reckoned for each pair
        asks = settled(plain.unionAll(named).select(*key, "but", "q.*"))
        facts = _facts(self.symbols_all, self.references_all)
        met = (c("f_log_id") == c("log_id")) & (c("f_topic") == c("topic")) & (c("f_key") == c("key")) & (c("f_lo") < c("ordinal")) & (c("ordinal") <= c("f_hi"))
        lacking = asks.where("must").join(facts, met, "left_anti")
        taken = asks.where("not must").join(facts, met & (c("but").isNull() | (c("f_own") != c("but"))), "left_semi")
        moves = asked.where("op_type = 'MoveSymbol' and parent_id is not null")
        own = moves.where("parent_id = symbol_id").select(*key, F.lit(2).alias("rule"), F.lit("cannot move symbol beneath itself").alias("reason"))
        below = self._descendants(moves).select(*key, F.lit(4).alias("rule"), F.lit("cannot move symbol beneath its descendant").alias("reason"))
        cols = [*key, "rule", "reason"]
        return lacking.select(*cols).unionAll(taken.select(*cols)).unionAll(own).unionAll(below)

    def _descendants(self, moves: DataFrame) -> DataFrame:
        """Moves whose new parent is below the symbol, by climbing the parents that each move sees."""
        asked = settled(moves.select("log_id", "ordinal", "op_id", "symbol_id", "parent_id"))
        if asked.isEmpty():
            return asked.select("log_id", "ordinal", "op_id")
        found = self.ops.sparkSession.sql(
            f"""
            with recursive up(log_id, ordinal, op_id, symbol_id, at, path) max recursion level {MAX_DEPTH} as (
              select log_id, ordinal, op_id, symbol_id, parent_id, array(parent_id) from {{moves}} where parent_id <> symbol_id
              union all
              select u.log_id, u.ordinal, u.op_id, u.symbol_id, v.parent_id, array_append(u.path, v.parent_id)
              from up u join {{versions}} v
                on v.log_id = u.log_id and v.symbol_id = u.at and v.lo < u.ordinal and u.ordinal <= v.hi
              where v.parent_id is not null and u.at <> u.symbol_id and not array_contains(u.path, v.parent_id)
            )
            select distinct log_id, ordinal, op_id from up where at = symbol_id
            """,
            moves=asked,
            versions=settled(self.symbols_all.select("log_id", "symbol_id", "parent_id", "lo", "hi")),
        )
        # settled, as recursive queries that are laid over each other give wrong rows
        return settled(found)

    @cached_property
    def failures(self) -> DataFrame:
        """(log_id, ordinal, op_id, reason): the first operation of each log that breaks a rule, and the first rule that it breaks."""
        first = F.min(F.struct("ordinal", "rule", "op_id", "reason")).alias("f")
        return self.violations.groupBy("log_id").agg(first).select("log_id", "f.ordinal", "f.op_id", "f.reason")

    def _at(self, versions: DataFrame, as_of: int | None, failures: DataFrame | None) -> DataFrame:
        """Versions that stand after the operation ``as_of`` (null: the last), or before a log's first failure."""
        at = F.lit(END if as_of is None else as_of + 1)
        if failures is not None:
            stop = failures.select(F.col("log_id").alias("f_log"), F.col("ordinal").alias("f_ordinal"))
            versions = versions.join(stop, F.col("log_id") == F.col("f_log"), "left")
            at = F.least(at, F.coalesce("f_ordinal", F.lit(END)))
        return versions.where((F.col("lo") < at) & (at <= F.col("hi")))

    def symbols(self, as_of: int | None = None, checked: bool = True) -> DataFrame:
        """Live symbols with their ordinal of creation. checked: stop at each log's first failure."""
        return self._at(self.symbols_all, as_of, self.failures if checked else None).select("log_id", "symbol_id", "parent_id", "kind", "name", "body", "metadata", F.col("born").alias("ordinal"))

    def references(self, as_of: int | None = None, checked: bool = True) -> DataFrame:
        return self._at(self.references_all, as_of, self.failures if checked else None).select("log_id", "reference_id", "from_symbol_id", "to_symbol_id", "kind", F.col("born").alias("ordinal"))


class Creates(Replay):
    """Replay of logs that only create symbols and references, as imports do: as nothing is changed or goes, what an id is first created and
    first asked for says all, which takes one aggregation of the ids instead of joins of all questions with all facts.
    """

    @cached_property
    def symbols_all(self) -> DataFrame:
        """Each create as a version; after a failure, the state isn't that of a log that goes on."""
        return self._made("CreateSymbol").select("log_id", "symbol_id", "parent_id", "kind", "name", "body", "metadata", F.col("ordinal").alias("born"), F.col("ordinal").alias("lo"), F.lit(END).alias("hi"))

    @cached_property
    def references_all(self) -> DataFrame:
        return self._made("CreateReference").select("log_id", "reference_id", "from_symbol_id", "to_symbol_id", "kind", F.col("ordinal").alias("born"), F.col("ordinal").alias("lo"), F.lit(END).alias("hi"))

    def settle(self) -> Replay:
        """Versions are the operations themselves."""
        return self

    def _made(self, op_type: str) -> DataFrame:
        return self.ops.where(F.col("op_type") == op_type)

    def _again(self, rows: DataFrame, rule: int, keys: list[str]) -> DataFrame:
        """(log_id, ordinal, rule): rows whose keys, or nulls in their places, an earlier one has. Hashes find what may be equal, keys decide."""
        hashed = rows.select("log_id", "ordinal", *keys, F.xxhash64("log_id", *[x for k in keys for x in (k, F.col(k).isNull())]).alias("h"))
        twice = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        first = Window.partitionBy("log_id", *keys).orderBy("ordinal")
        return stored(hashed.join(stored(twice), "h", "left_semi")).withColumn("nth", F.row_number().over(first)).where("nth > 1").select("log_id", "ordinal", F.lit(rule).alias("rule"))

    @cached_property
    def violations(self) -> DataFrame:
        """(log_id, ordinal, op_id, rule, reason), of which only a log's first ordinal is meaningful."""
        symbols, references, none = self._made("CreateSymbol"), self._made("CreateReference"), F.lit(None).cast("long")

        def ids(rows: DataFrame, key: str, at: str) -> DataFrame:
            """at: born, or the number of the rule that asks for the id."""
            return rows.where(F.col(key).isNotNull()).select("log_id", F.col(key).alias("id"), *[(F.col("ordinal") if x == at else none).alias(x) for x in ("born", "a2", "a3")])

        met = ids(symbols, "symbol_id", "born").unionAll(ids(symbols, "parent_id", "a2")).unionAll(ids(references, "from_symbol_id", "a2")).unionAll(ids(references, "to_symbol_id", "a3"))
        first = met.groupBy("log_id", "id").agg(F.min("born").alias("born"), F.min("a2").alias("a2"), F.min("a3").alias("a3"))
        early = lambda a: F.col(a).isNotNull() & (F.col("born").isNull() | (F.col(a) <= F.col("born")))
        lacking = stored(first.where(early("a2") | early("a3")))
        found = lacking.where(early("a2")).select("log_id", F.col("a2").alias("ordinal"), F.lit(2).alias("rule"))
        found = found.unionAll(lacking.where(early("a3")).select("log_id", F.col("a3").alias("ordinal"), F.lit(3).alias("rule")))
        # an id without a parent asks for none, and a null id is never found
        lost = references.where("from_symbol_id is null").select("log_id", "ordinal", F.lit(2).alias("rule")).unionAll(references.where("to_symbol_id is null").select("log_id", "ordinal", F.lit(3).alias("rule")))
        found = found.unionAll(lost).unionAll(self._again(symbols.where("symbol_id is not null"), 1, ["symbol_id"])).unionAll(self._again(references.where("reference_id is not null"), 1, ["reference_id"])).unionAll(self._again(symbols, 3, ["parent_id", "kind", "name"]))
        # the earliest of each log alone, before its operation is looked up
        stop = stored(found.groupBy("log_id").agg(F.min(F.struct("ordinal", "rule")).alias("f")).select(F.col("log_id").alias("f_log"), F.col("f.ordinal").alias("f_ordinal"), F.col("f.rule").alias("rule")))
        says = {("CreateSymbol", 1): "duplicate symbol id", ("CreateSymbol", 2): "parent symbol does not exist", ("CreateSymbol", 3): "duplicate sibling name", ("CreateReference", 1): "duplicate reference id", ("CreateReference", 2): "reference source does not exist", ("CreateReference", 3): "reference target does not exist"}
        reason = F.coalesce(*[F.when((F.col("op_type") == t) & (F.col("rule") == n), text) for (t, n), text in says.items()])
        return self.ops.join(stop, (F.col("log_id") == F.col("f_log")) & (F.col("ordinal") == F.col("f_ordinal"))).select("log_id", "ordinal", "op_id", "rule", reason.alias("reason"))


def validate(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(log_id, problem, id): dangling parents, duplicate sibling keys, dangling ends of references, of a state."""
    ids = symbols.select(F.col("log_id").alias("i_log"), F.col("symbol_id").alias("i_id"))

    def dangling(rows: DataFrame, end: str, problem: str, own: str) -> DataFrame:
        lost = rows.where(F.col(end).isNotNull()).join(ids, (F.col("log_id") == F.col("i_log")) & (F.col(end) == F.col("i_id")), "left_anti")
        return lost.select("log_id", F.lit(problem).alias("problem"), F.col(own).alias("id"))

    key = ["log_id", "parent_id", "kind", "name"]
    twins = symbols.groupBy(*key).agg(F.count("*").alias("n"), F.max("symbol_id").alias("id")).where("n > 1")
    return (
        dangling(symbols, "parent_id", "dangling parent", "symbol_id")
        .unionAll(twins.select("log_id", F.lit("duplicate sibling name").alias("problem"), "id"))
        .unionAll(dangling(references, "from_symbol_id", "dangling source", "reference_id"))
        .unionAll(dangling(references, "to_symbol_id", "dangling target", "reference_id"))
    )


#: Operations of ``in_scope`` that are the branch's own.
OWN = "op_id not like 'base:%'"


def in_scope(own: DataFrame, base_symbols: DataFrame, base_references: DataFrame) -> DataFrame:
    """A branch's log over a snapshot of its base: only base rows that a rule on own operations can ask for, then the own ones.

    own: operations with log_id and ordinal, of many branches on one base. base_symbols(symbol_id, parent_id, kind,
    name, body, metadata, ordinal), base_references(reference_id, ...): the state at the fork. Replaying the
    result finds the failures, and the state of what the branch touches, that replaying all of the
    base would. Each own operation brings in the rows of the ids that it names, of siblings with its name, of
    children and of incident references; so it stays in proportion to the own operations.
    """
    symbols, refs = base_symbols, base_references
    named = own.select("log_id", F.explode(F.array("symbol_id", "parent_id", "from_symbol_id", "to_symbol_id")).alias("id")).where("id is not null").distinct()
    moved = own.where("op_type in ('MoveSymbol', 'DeleteSymbol')").select("log_id", F.col("symbol_id").alias("id")).distinct()
    # a move may meet any ancestor of its new parent
    climbs = settled(own.where("op_type = 'MoveSymbol'").select("log_id", F.col("parent_id").alias("id")).where("id is not null").distinct())
    if not climbs.isEmpty():
        climbs = _ancestors(climbs, symbols)
    first = symbols.join(named.unionAll(climbs).distinct(), F.col("symbol_id") == F.col("id")).select("log_id", symbols["symbol_id"])
    below = symbols.join(moved, F.col("parent_id") == F.col("id")).select("log_id", symbols["symbol_id"])
    # keys that a create, rename or move takes: the present kind and name of a symbol, or the given ones
    now = symbols.select(F.col("symbol_id").alias("s_id"), F.col("parent_id").alias("s_parent"), F.col("kind").alias("s_kind"), F.col("name").alias("s_name"))
    changed = own.where("op_type in ('UpdateSymbol', 'MoveSymbol')").join(now, F.col("symbol_id") == F.col("s_id")).select("log_id", F.col("s_kind").alias("w_kind"), "s_parent", "s_name", F.when(F.col("op_type") == "MoveSymbol", F.struct(F.col("parent_id").alias("p"))).alias("to"), F.col("name").alias("to_name"))
    made = own.where("op_type = 'CreateSymbol'").select("log_id", F.col("kind").alias("w_kind"), F.col("parent_id").alias("w_parent"), F.col("name").alias("w_name"))
    # a symbol may be renamed and moved in turn: all names with all places that the branch gives it
    places = changed.select("log_id", "w_kind", F.explode(F.array_distinct(F.array(F.struct(F.col("s_parent").alias("p")), F.coalesce(F.col("to"), F.struct(F.col("s_parent").alias("p")))))).alias("x"), F.coalesce("to_name", "s_name").alias("w_name")).select("log_id", "w_kind", F.col("x.p").alias("w_parent"), "w_name")
    wanted = made.unionByName(places).distinct()
    twins = symbols.join(wanted, F.col("parent_id").eqNullSafe(F.col("w_parent")) & (F.col("kind") == F.col("w_kind")) & (F.col("name") == F.col("w_name"))).select("log_id", symbols["symbol_id"])
    keep = first.unionAll(below).unionAll(twins).distinct()
    rows = keep.join(symbols, "symbol_id")
    gone = own.where("op_type = 'DeleteSymbol'").select("log_id", F.col("symbol_id").alias("id")).distinct()
    touched = own.where("reference_id is not null").select("log_id", F.col("reference_id").alias("id")).distinct()
    hits = refs.join(gone, F.col("from_symbol_id") == F.col("id")).select("log_id", refs["reference_id"])
    hits = hits.unionAll(refs.join(gone, F.col("to_symbol_id") == F.col("id")).select("log_id", refs["reference_id"])).unionAll(refs.join(touched, F.col("reference_id") == F.col("id")).select("log_id", refs["reference_id"])).distinct()
    links = hits.join(refs, "reference_id")
    none = lambda t="string": F.lit(None).cast(t)
    born_symbols = rows.select("log_id", "ordinal", F.concat(F.lit("base:"), "ordinal").alias("op_id"), F.lit("CreateSymbol").alias("op_type"), "symbol_id", "parent_id", "kind", "name", "body", "metadata", none().alias("reference_id"), none().alias("from_symbol_id"), none().alias("to_symbol_id"))
    born_links = links.select("log_id", "ordinal", F.concat(F.lit("base:"), "ordinal").alias("op_id"), F.lit("CreateReference").alias("op_type"), none().alias("symbol_id"), none().alias("parent_id"), "kind", none().alias("name"), none().alias("body"), none().alias("metadata"), "reference_id", "from_symbol_id", "to_symbol_id")
    return born_symbols.unionAll(born_links).unionAll(own.select(*born_symbols.columns))


def _ancestors(start: DataFrame, symbols: DataFrame) -> DataFrame:
    """(log_id, id) of the ids themselves and all their ancestors."""
    ids = start.select(F.col("id").alias("symbol_id")).distinct().join(symbols.select("symbol_id", "parent_id"), "symbol_id")
    above = hierarchy.ancestors(symbols, ids)
    return start.join(above, F.col("id") == F.col("symbol_id")).select("log_id", F.col("ancestor_id").alias("id")).distinct()
