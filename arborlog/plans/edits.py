"""More registered queries: edits that move and unlink, all problems of a state, merges into main, edited files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.handlers import import_files
from arborlog.handlers.recover import recover_files
from arborlog.handlers.router import slice_files
from arborlog.operators import merge, moves, replay
from arborlog.operators.lineage import settled
from arborlog.plans.oracles import AGENT, MAIN, sql
from arborlog.plans.queries import _UUID, ORACLE_SQL, QUERIES, RENAMES, main_state, query, renamed_parts
from arborlog.sources import derive

__all__ = ["ORACLE_SQL", "QUERIES"]

_FIELDS = ["op_type", "symbol_id", "parent_id", "kind", "name", "body", "metadata", "reference_id", "from_symbol_id", "to_symbol_id"]


def _ops(rows: DataFrame, log_id, op_id, turn, op_type: str, **columns) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(log_id.alias("log_id"), op_id.alias("op_id"), turn.cast("long").alias("ordinal"), F.lit(op_type).alias("op_type"), *[columns.get(c, none).alias(c) for c in _FIELDS[1:]])


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


# --- moves and deleted references


def edited_log(spark, sf) -> DataFrame:
    """Main's log, then every third customer under the next nation, then the calls of every fifth order taken back."""
    main = derive.main_log(spark, sf).select(F.lit("edited").alias("log_id"), "op_id", F.col("position").alias("ordinal"), *_FIELDS)
    customers = derive.table(spark, sf, "customer").where("c_custkey % 3 = 0")
    moved = _ops(customers, F.lit("edited"), _key("move", "c_custkey"), F.col("c_custkey"), "MoveSymbol", symbol_id=_key("customer", "c_custkey"), parent_id=F.concat(F.lit("nation:"), (F.col("c_nationkey") + 1) % 25))
    calls = derive.table(spark, sf, "lineitem").where("l_orderkey % 5 = 0").select("l_orderkey", "l_partkey").distinct()
    name = F.concat(_key("order", "l_orderkey"), F.lit(":"), _key("part", "l_partkey"))
    cut = _ops(calls, F.lit("edited"), F.concat(F.lit("cut:"), name), F.lit(1 << 40) + F.col("l_orderkey"), "DeleteReference", reference_id=F.concat(F.lit("reference:"), name, F.lit(":calls")))
    return settled(main.unionByName(merge.numbered(moved.unionByName(cut), main.count())))


@query(sql(MAIN, select="""
  select s.symbol_id, case when c_custkey % 3 = 0 then 'nation:' || (c_nationkey + 1) % 25 else s.parent_id end as parent_id, s.kind, s.name, s.ordinal
  from sym s left join customer on s.symbol_id = 'customer:' || c_custkey"""))
def edited_symbols(spark, sf):
    """Symbols after moves, all rules asked."""
    return replay.Replay(edited_log(spark, sf)).settle().symbols().select("symbol_id", "parent_id", "kind", "name", "ordinal")


@query(sql(MAIN, select="select reference_id, from_symbol_id, to_symbol_id, ordinal from ref where split_part(from_symbol_id, ':', 2)::bigint % 5 <> 0"))
def edited_references(spark, sf):
    """References after deletions, all rules asked."""
    return replay.Replay(edited_log(spark, sf)).settle().references().select("reference_id", "from_symbol_id", "to_symbol_id", "ordinal")


@query("""
  with c as (select c_nationkey as n, min(c_custkey) as k from customer group by 1)
  select 'below:' || n as log_id, 'cannot move symbol beneath its descendant' as reason, 1 as turn from c
  union all select 'self:' || n, 'cannot move symbol beneath itself', 1 from c
  union all select 'nowhere:' || k, 'parent symbol does not exist', 2 from c
  union all select 'missing:' || n, 'cannot move missing symbol', 1 from c
  union all select 'twice:' || o_orderkey, 'cannot delete missing reference', 2 from orders where o_orderkey % 10 = 0 and exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def edit_failures(spark, sf):
    """The first illegal operation of logs over main that move symbols below themselves or away from the tree, or unlink twice."""
    symbols, references = main_state(spark, sf)
    head = derive.main_log(spark, sf).count()
    n = derive.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.min("c_custkey").alias("k"))
    link = derive.table(spark, sf, "lineitem").where("l_orderkey % 10 = 0").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"))
    link = link.join(derive.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    ref = F.concat(F.lit("reference:"), _key("order", "l_orderkey"), F.lit(":"), _key("part", "l_partkey"), F.lit(":calls"))
    nation, customer = _key("nation", "n"), _key("customer", "k")

    def move(name: str, key: str, turn: int, symbol, parent) -> DataFrame:
        return _ops(n, _key(name, key), F.lit(f"{turn}"), F.lit(head + turn), "MoveSymbol", symbol_id=symbol, parent_id=parent)

    own = move("below", "n", 1, nation, customer).unionAll(move("self", "n", 1, nation, nation)).unionAll(move("missing", "n", 1, F.concat(F.lit("none:"), "n"), nation))
    # a legal move first, to the top of the forest
    own = own.unionAll(move("nowhere", "k", 1, customer, F.lit(None).cast("string"))).unionAll(move("nowhere", "k", 2, customer, F.lit("nation:none")))
    for turn in (1, 2):
        own = own.unionAll(_ops(link, _key("twice", "l_orderkey"), F.lit(f"{turn}"), F.lit(head + turn), "DeleteReference", reference_id=ref))
    scoped = replay.in_scope(settled(own), symbols, references)
    return replay.Replay(settled(scoped), "op_id not like 'base:%'").settle().failures.select("log_id", "reason", (F.col("ordinal") - head).cast("int").alias("turn"))


@query(sql(MAIN, """
left_over as (
  select symbol_id, parent_id, kind, case when kind = 'function' then 'part ' || (length(name) % 5) else name end as name from sym
  where not (kind = 'module' and ordinal % 5 = 0) and not (kind = 'method' and ordinal % 17 = 0) and not (kind = 'function' and ordinal % 23 = 0))""", select="""
  select 'dangling parent' as problem, symbol_id as id from left_over s where parent_id is not null and not exists (select 1 from left_over p where p.symbol_id = s.parent_id)
  union all select 'duplicate sibling name', max(symbol_id) from left_over group by parent_id, kind, name having count(*) > 1
  union all select 'dangling source', reference_id from ref r where not exists (select 1 from left_over p where p.symbol_id = r.from_symbol_id)
  union all select 'dangling target', reference_id from ref r where not exists (select 1 from left_over p where p.symbol_id = r.to_symbol_id)"""))
def validate_problems(spark, sf):
    """All four problems of a state that lacks some nations, orders and parts, and whose parts share names."""
    symbols, references = main_state(spark, sf)
    n, kind = F.col("ordinal"), F.col("kind")
    lost = (kind == "module") & (n % 5 == 0) | (kind == "method") & (n % 17 == 0) | (kind == "function") & (n % 23 == 0)
    name = F.when(kind == "function", F.concat(F.lit("part "), (F.length("name") % 5).cast("string"))).otherwise(F.col("name"))
    rest = symbols.where(~lost).withColumn("name", name).withColumn("log_id", F.lit("main"))
    return replay.validate(rest, references.withColumn("log_id", F.lit("main"))).select("problem", "id")


# --- merges


@query("""
  with l as (select distinct 'order:' || l_orderkey || ':part:' || l_partkey as id, l_orderkey as o from lineitem)
  select 'DUPLICATE_REFERENCE_ID' as reason, 'a+' || id as source_op, 'b+' || id as target_op, 'both branches create reference ' || id as detail from l where o % 6 = 0
  union all select 'OVERLAPPING_REFERENCE_WRITE', 'a+' || id, 'b-' || id, 'both branches write reference ' || id from l where o % 10 = 0
  union all select 'OVERLAPPING_REFERENCE_WRITE', 'a-' || id, 'b+' || id, 'both branches write reference ' || id from l where o % 21 = 0
  union all select 'OVERLAPPING_REFERENCE_WRITE', 'a-' || id, 'b-' || id, 'both branches write reference ' || id from l where o % 35 = 0""")
def conflicts_of_references(spark, sf):
    """Two logs that create and delete the same references between orders and parts."""
    calls = derive.table(spark, sf, "lineitem").select("l_orderkey", F.concat(_key("order", "l_orderkey"), F.lit(":"), _key("part", "l_partkey")).alias("id")).distinct()

    def side(log: str, sign: str, each: int, op_type: str) -> DataFrame:
        return _ops(calls.where(F.col("l_orderkey") % each == 0), F.lit(log), F.concat(F.lit(log + sign), "id"), F.lit(0), op_type, reference_id=F.col("id"))

    source = side("a", "+", 2, "CreateReference").unionAll(side("a", "-", 7, "DeleteReference"))
    target = side("b", "+", 3, "CreateReference").unionAll(side("b", "-", 5, "DeleteReference"))
    return merge.conflicts(source, target, F.lit(True)).select("reason", "source_op", "target_op", "detail")


@query(sql(MAIN, AGENT, select=f"""
  select {_UUID} as op_id, 'main' as branch_id, position, op_type, symbol_id, reference_id from (
    select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('merge:merge-1:' || position)) as h from (
      select h + position as position, op_type, symbol_id, reference_id from agent, head where user_id = (select min(user_id) from users)))"""))
def merged_operations(spark, sf):
    """What main gets when the first user's branch is merged into it."""
    first = derive.table(spark, sf, "events").agg(F.min("user_id")).first()[0]
    own = derive.agent_ops(spark, sf).where(F.col("branch_id") == f"agent-{first}")
    return merge.appended(own, "main", derive.main_log(spark, sf).count(), "merge-1").select("op_id", "branch_id", "position", "op_type", "symbol_id", "reference_id")


# --- renames in small containers


@query(RENAMES.replace("{container}", "p_brand || '/' || p_size"))
def rename_detection_by_size(spark, sf):
    """The same within the parts of one brand and size, where few are left to choose from."""
    return moves.detect_renames(*renamed_parts(spark, sf, F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))))


# --- files


def _guides(spark, sf) -> DataFrame:
    """A guide for each page: front matter, a title, two sections of one name, a block of code and a link to the next guide."""
    k = F.col("page_id")
    content = F.concat(
        F.lit("---\ntitle: guide\n---\n# guide "), k, F.lit("\n\nintro\n\n## first steps\n\n```sql\nselect "), k,
        F.lit("\n# no heading\n```\n\nsee [next]("), k + 1, F.lit(".md#first-steps)\n\n## first steps\n\nend\n"),
    )
    return derive.table(spark, sf, "pages").select(F.concat(F.lit("guides/"), k, F.lit(".md")).alias("path"), content.alias("content"))


@query("""
  with g as (select page_id as k, 'guides/' || page_id || '.md' as path, chr(10) as nl, '```sql' || chr(10) || 'select ' || page_id || chr(10) || '# no heading' || chr(10) || '```' || chr(10) as block, '[next](' || (page_id + 1) || '.md#first-steps)' as link from pages)
  select path, 1::bigint as seq, 'frontmatter' as kind, 'yaml' as name, '---' || nl || 'title: guide' || nl || '---' || nl as body from g
  union all select path, 2, 'section', 'guide ' || k, '# guide ' || k || nl || nl || 'intro' || nl || nl from g
  union all select path, 3, 'section', 'first steps', '## first steps' || nl || nl || block || nl || 'see ' || link || nl || nl from g
  union all select path, 4, 'section', 'first steps (2)', '## first steps' || nl || nl || 'end' || nl from g
  union all select path, 5, 'code-block', 'sql 1', block from g
  union all select path, 6, 'link', 'next 1', link from g""")
def markdown_structure(spark, sf):
    """Symbols of the guides, in order."""
    return import_files(_guides(spark, sf))[0].where("seq > 0").select("path", "seq", "kind", "name", "body")


@query("select 'guides/' || a.page_id || '.md' as path, 'guides/' || b.page_id || '.md' as target, 'links-to' as kind, 3::bigint as seq from pages a join pages b on b.page_id = a.page_id + 1")
def markdown_links(spark, sf):
    """Links between guides, resolved to the first section with that anchor."""
    symbols, references = import_files(_guides(spark, sf))
    a = symbols.select(F.col("symbol_id").alias("from_symbol_id"), "path")
    b = symbols.select(F.col("symbol_id").alias("to_symbol_id"), F.col("path").alias("target"), "seq")
    return references.join(a, "from_symbol_id").join(b, "to_symbol_id").select("path", "target", "kind", "seq")


def _sheets(spark, sf, edited: bool) -> DataFrame:
    """A TOML file for each part; edited: every second one, of which some have other sizes, lack the size or have a section more."""
    k = F.col("p_partkey")
    size, more = F.concat(F.lit("[size]\nvalue = "), "p_size", F.lit("\n")), F.lit("")
    rows = derive.table(spark, sf, "part")
    if edited:
        rows = rows.where("p_partkey % 2 = 0")
        size = F.when(k % 3 == 0, F.lit("[size]\nvalue = 1000\n")).when(k % 7 == 0, F.lit("")).otherwise(size)
        more = F.when(k % 5 == 0, F.lit("[extra]\nnote = 1\n")).otherwise(more)
    content = F.concat(F.lit("[part]\nname = \""), "p_name", F.lit("\"\n"), size, more)
    return rows.select(F.concat(F.lit("sheets/"), k, F.lit(".toml")).alias("path"), content.alias("content"))


@query("""
  select 'sheets/' || p_partkey || '.toml' as path, 'UpdateSymbol' as op_type, 'size' as section from part where p_partkey % 6 = 0
  union all select 'sheets/' || p_partkey || '.toml', 'DeleteSymbol', 'size' from part where p_partkey % 14 = 0 and p_partkey % 3 <> 0
  union all select 'sheets/' || p_partkey || '.toml', 'CreateSymbol', 'extra' from part where p_partkey % 10 = 0""")
def recover_edited_files(spark, sf):
    """The plan that edits of every second file stand for; the other files stay."""
    was, links = import_files(_sheets(spark, sf, False))
    was = settled(was)
    edits = _sheets(spark, sf, True)
    plan = settled(recover_files(was, settled(links), edits, relink=False))
    known = was.select("symbol_id", "path", F.col("name").alias("section")).unionAll(import_files(edits)[0].select("symbol_id", "path", "name")).distinct()
    return plan.join(known, "symbol_id").select("path", "op_type", "section")


@query("select 'sheets/' || p_partkey || '.toml' as path, sha256('[part]' || chr(10) || 'name = \"' || p_name || '\"' || chr(10) || '[size]' || chr(10) || 'value = ' || p_size || chr(10)) as content_sha256 from part where p_size % 4 = 0")
def sliced_files(spark, sf):
    """The files of some sections, rendered; each once, though all its sections are asked for."""
    was = settled(import_files(_sheets(spark, sf, False))[0])
    wanted = derive.table(spark, sf, "part").where("p_size % 4 = 0").select(F.concat(F.lit("sheets/"), "p_partkey", F.lit(".toml")).alias("path"))
    return slice_files(was, was.join(wanted, "path", "left_semi")).select("path", F.sha2("content", 256).alias("content_sha256"))
