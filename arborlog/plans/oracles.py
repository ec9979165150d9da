"""DuckDB SQL for the registered queries, over the driver's tables."""

from __future__ import annotations

MAIN = """
main_rows as (
  select 1 as stage, r_regionkey::bigint as k1, 0::bigint as k2, 'CreateSymbol' as op_type, 'region:' || r_regionkey as symbol_id, null::varchar as parent_id, 'file' as kind, 'region/' || r_name as name,
         null::varchar as body, '{"handler":"region","path":"region/' || r_name || '"}' as metadata, null::varchar as reference_id, null::varchar as from_symbol_id, null::varchar as to_symbol_id from region
  union all select 2, n_nationkey, 0, 'CreateSymbol', 'nation:' || n_nationkey, 'region:' || n_regionkey, 'module', n_name, null, '{}', null, null, null from nation
  union all select 3, c_custkey, 0, 'CreateSymbol', 'customer:' || c_custkey, 'nation:' || c_nationkey, 'class', c_name, null, '{"segment":"' || c_mktsegment || '"}', null, null, null from customer
  union all select 4, o_orderkey, 0, 'CreateSymbol', 'order:' || o_orderkey, 'customer:' || o_custkey, 'method', 'o' || o_orderkey, o_orderpriority, '{}', null, null, null from orders
  union all select 5, ('0x' || substr(md5(p_brand), 1, 12))::bigint, 0, 'CreateSymbol', 'brand:' || p_brand, null, 'file', p_brand, null, '{}', null, null, null from (select distinct p_brand from part)
  union all select 6, p_partkey, 0, 'CreateSymbol', 'part:' || p_partkey, 'brand:' || p_brand, 'function', p_name || '#' || p_partkey, p_type, '{}', null, null, null from part
  union all select 7, l_orderkey, l_partkey, 'CreateReference', null, null, 'calls', null, null, null, 'reference:order:' || l_orderkey || ':part:' || l_partkey || ':calls', 'order:' || l_orderkey, 'part:' || l_partkey from (select distinct l_orderkey, l_partkey from lineitem)
),
main_log as (select 'main' as branch_id, row_number() over (order by stage, k1, k2) as position, * from main_rows),
sym as (select symbol_id, parent_id, kind, name, body, metadata, position as ordinal from main_log where op_type = 'CreateSymbol'),
ref as (select reference_id, from_symbol_id, to_symbol_id, kind, position as ordinal from main_log where op_type = 'CreateReference')
"""

AGENT = """
agent0 as (
  select event_id, ts, user_id, event_type, props, user_id % (select cast(floor(0.8 * (max(user_id) + 1)) as bigint) from events) as cu,
         row_number() over (partition by user_id order by ts, event_id) as position, row_number() over (partition by user_id, event_type order by ts, event_id) as nth from events),
agent1 as (select *, 'slot:' || cu || ':' || (event_id % 20) || ':' || (event_id % 3) as slot, 'customer:' || cu as cust from agent0),
agent2 as (select a.*, b.slot as undone from agent1 a left join agent1 b on a.event_type = 'error' and b.event_type = 'purchase' and a.user_id = b.user_id and a.nth = b.nth and b.ts < a.ts),
agent as (
  select 'agent-' || user_id as branch_id, position, 'op:' || event_id as op_id,
    case when event_type = 'purchase' then 'CreateSymbol' when event_type = 'error' and undone is null then 'CreateReference' when event_type = 'error' then 'DeleteSymbol' else 'UpdateSymbol' end as op_type,
    case when event_type = 'purchase' then slot when event_type = 'error' then undone else cust end as symbol_id,
    case when event_type = 'purchase' then cust end as parent_id,
    case when event_type = 'purchase' then 'method' when event_type = 'error' and undone is null then 'calls' end as kind,
    case when event_type = 'purchase' then 'slot' || (event_id % 20) when event_type = 'signup' then 'c' || cu || '-u' || user_id end as name,
    case when event_type = 'click' then props end as body,
    case when event_type = 'purchase' then '{}' when event_type = 'view' then props end as metadata,
    case when event_type = 'error' and undone is null then 'ref:' || event_id end as reference_id,
    case when event_type = 'error' and undone is null then cust end as from_symbol_id,
    case when event_type = 'error' and undone is null then slot end as to_symbol_id,
    'cs-' || user_id as changeset_id, ts as created_at, user_id
  from agent2),
head as (select count(*) as h from main_log),
users as (select user_id, count(*) as n from events group by 1),
fork as (
  select 'fork-' || user_id as branch_id, 1::bigint as position, 'fork-op:' || user_id as op_id, 'CreateSymbol' as op_type, 'note:' || user_id as symbol_id,
    'customer:' || (user_id % (select cast(floor(0.8 * (max(user_id) + 1)) as bigint) from events)) as parent_id, 'method' as kind, 'note' || user_id as name, null::varchar as body, '{}' as metadata,
    null::varchar as reference_id, null::varchar as from_symbol_id, null::varchar as to_symbol_id, 'cs-f' || user_id as changeset_id, timestamp '2030-01-01 00:00:00' as created_at, user_id
  from users where user_id % 10 = 0),
own as (select * from agent union all select * from fork),
seen as (
  select 'agent-' || user_id as log_id, h + position as ordinal, a.* from agent a, head
  union all select 'fork-' || a.user_id, h + position, a.* from agent a join users u using (user_id), head where u.user_id % 10 = 0 and position <= floor(n / 2)
  union all select f.branch_id, h + floor(n / 2)::bigint + position, f.* from fork f join users u using (user_id), head)
"""

# versions of what agents' logs write, over all of main; then each rule
REPLAY = """
logs as (select distinct log_id from seen),
touched as (select distinct log_id, unnest([symbol_id, parent_id, from_symbol_id, to_symbol_id]) as id from seen),
born as (select t.log_id, s.ordinal, 'base:' || s.ordinal as op_id, 'CreateSymbol' as op_type, s.symbol_id, s.parent_id, s.kind, s.name, s.body, s.metadata from touched t join sym s on s.symbol_id = t.id),
ev as (
  select * from born union all
  select log_id, ordinal, op_id, op_type, symbol_id, parent_id, kind, name, body, metadata from seen where op_type in ('CreateSymbol', 'UpdateSymbol', 'DeleteSymbol')),
ver0 as (
  select log_id, symbol_id, op_type, ordinal as lo, lead(ordinal, 1, 9223372036854775807) over w as hi,
    last_value(case when op_type = 'CreateSymbol' then {'v': parent_id} end ignore nulls) over w as p,
    last_value(case when op_type = 'CreateSymbol' then kind end ignore nulls) over w as kind,
    last_value(case when op_type <> 'DeleteSymbol' then name end ignore nulls) over w as name,
    last_value(case when op_type = 'CreateSymbol' then {'v': body} when op_type = 'UpdateSymbol' and body is not null then {'v': body} end ignore nulls) over w as b,
    last_value(case when op_type <> 'DeleteSymbol' then metadata end ignore nulls) over w as metadata,
    last_value(case when op_type = 'CreateSymbol' then ordinal end ignore nulls) over w as born
  from ev window w as (partition by log_id, symbol_id order by ordinal)),
ver as (select log_id, symbol_id, lo, hi, p.v as parent_id, kind, name, b.v as body, metadata, born from ver0 where op_type <> 'DeleteSymbol'),
rver as (select log_id, reference_id, from_symbol_id, to_symbol_id, kind, ordinal as lo, 9223372036854775807 as hi from seen where op_type = 'CreateReference'),
ren as (select o.log_id, o.ordinal, o.op_id, o.symbol_id, v.parent_id, v.kind, o.name from seen o join ver v on v.log_id = o.log_id and v.symbol_id = o.symbol_id and v.lo < o.ordinal and o.ordinal <= v.hi where o.op_type = 'UpdateSymbol' and o.name is not null),
viol as (
  select log_id, ordinal, op_id, 1 as rule, 'duplicate symbol id' as reason from seen o where op_type = 'CreateSymbol' and exists (select 1 from ver v where v.log_id = o.log_id and v.symbol_id = o.symbol_id and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 2, 'parent symbol does not exist' from seen o where op_type = 'CreateSymbol' and parent_id is not null and not exists (select 1 from ver v where v.log_id = o.log_id and v.symbol_id = o.parent_id and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 3, 'duplicate sibling name' from seen o where op_type = 'CreateSymbol' and exists (select 1 from ver v where v.log_id = o.log_id and v.parent_id is not distinct from o.parent_id and v.kind = o.kind and v.name = o.name and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 1, 'cannot delete missing symbol' from seen o where op_type = 'DeleteSymbol' and not exists (select 1 from ver v where v.log_id = o.log_id and v.symbol_id = o.symbol_id and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 2, 'symbol still contains children' from seen o where op_type = 'DeleteSymbol' and exists (select 1 from ver v where v.log_id = o.log_id and v.parent_id = o.symbol_id and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 3, 'references still point at it' from seen o where op_type = 'DeleteSymbol' and exists (select 1 from rver v where v.log_id = o.log_id and o.symbol_id in (v.from_symbol_id, v.to_symbol_id) and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 1, 'cannot update missing symbol' from seen o where op_type = 'UpdateSymbol' and not exists (select 1 from ver v where v.log_id = o.log_id and v.symbol_id = o.symbol_id and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 2, 'duplicate sibling name' from ren o where exists (select 1 from ver v where v.log_id = o.log_id and v.symbol_id <> o.symbol_id and v.parent_id is not distinct from o.parent_id and v.kind = o.kind and v.name = o.name and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 2, 'reference source does not exist' from seen o where op_type = 'CreateReference' and not exists (select 1 from ver v where v.log_id = o.log_id and v.symbol_id = o.from_symbol_id and v.lo < o.ordinal and o.ordinal <= v.hi)
  union all select log_id, ordinal, op_id, 3, 'reference target does not exist' from seen o where op_type = 'CreateReference' and not exists (select 1 from ver v where v.log_id = o.log_id and v.symbol_id = o.to_symbol_id and v.lo < o.ordinal and o.ordinal <= v.hi)),
fail as (select log_id, ordinal, op_id, reason from (select *, row_number() over (partition by log_id order by ordinal, rule) as rn from viol) where rn = 1),
stop as (select l.log_id, coalesce(f.ordinal, 9223372036854775807) as ends from logs l left join fail f using (log_id))
"""

BRANCHES = """
branches as (
  select 'main' as id, 'main' as name, null::varchar as base_branch_id, 0::bigint as base_position from head
  union all select 'agent-' || user_id, 'agent-' || user_id, 'main', h from users, head
  union all select 'fork-' || user_id, 'fork-' || user_id, 'agent-' || user_id, h + floor(n / 2)::bigint from users, head where user_id % 10 = 0)
"""

# conflicts of each branch's own operations with those of every other branch
CONFLICTS = """
w as (select * from own),
m1 as (select s.branch_id as source_log, t.branch_id as target_log, 'DUPLICATE_SYMBOL_ID' as reason, s.op_id as source_op, t.op_id as target_op, s.symbol_id as symbol_id, 'both branches create symbol ' || s.symbol_id as detail
  from w s join w t on s.symbol_id = t.symbol_id and s.branch_id <> t.branch_id and s.op_type = 'CreateSymbol' and t.op_type = 'CreateSymbol'),
m2 as (select s.branch_id as source_log, t.branch_id as target_log, 'DUPLICATE_REFERENCE_ID' as reason, s.op_id as source_op, t.op_id as target_op, null::varchar as symbol_id, 'both branches create reference ' || s.reference_id as detail
  from w s join w t on s.reference_id = t.reference_id and s.branch_id <> t.branch_id and s.op_type = 'CreateReference' and t.op_type = 'CreateReference'),
m3 as (select s.branch_id as source_log, t.branch_id as target_log, 'DUPLICATE_SYMBOL_NAME' as reason, s.op_id as source_op, t.op_id as target_op, s.symbol_id, 'both branches create ' || s.kind || ' named ' || s.name || ' under ' || coalesce('Some(' || s.parent_id || ')', 'None') as detail
  from w s join w t on s.parent_id is not distinct from t.parent_id and s.kind = t.kind and s.name = t.name and s.branch_id <> t.branch_id and s.op_type = 'CreateSymbol' and t.op_type = 'CreateSymbol'),
m4 as (select s.branch_id as source_log, t.branch_id as target_log, 'OVERLAPPING_SYMBOL_WRITE' as reason, s.op_id as source_op, t.op_id as target_op, s.symbol_id, 'both branches write symbol ' || s.symbol_id as detail
  from w s join w t on s.symbol_id = t.symbol_id and s.branch_id <> t.branch_id and s.op_type <> 'CreateReference' and t.op_type <> 'CreateReference' and not (s.op_type = 'CreateSymbol' and t.op_type = 'CreateSymbol')),
m5 as (select s.branch_id as source_log, t.branch_id as target_log, 'OVERLAPPING_REFERENCE_WRITE' as reason, s.op_id as source_op, t.op_id as target_op, null::varchar as symbol_id, 'both branches write reference ' || s.reference_id as detail
  from w s join w t on s.reference_id = t.reference_id and s.branch_id <> t.branch_id and not (s.op_type = 'CreateReference' and t.op_type = 'CreateReference')),
m6 as (
  select s.branch_id as source_log, t.branch_id as target_log, 'REFERENCE_TO_DELETED_SYMBOL' as reason, s.op_id as source_op, t.op_id as target_op, t.symbol_id, 'one branch references symbol ' || t.symbol_id || ' that the other branch deletes' as detail
    from w s join w t on t.symbol_id in (s.from_symbol_id, s.to_symbol_id) and s.branch_id <> t.branch_id and s.op_type = 'CreateReference' and t.op_type = 'DeleteSymbol'
  union
  select s.branch_id, t.branch_id, 'REFERENCE_TO_DELETED_SYMBOL', s.op_id, t.op_id, s.symbol_id, 'one branch references symbol ' || s.symbol_id || ' that the other branch deletes'
    from w s join w t on s.symbol_id in (t.from_symbol_id, t.to_symbol_id) and s.branch_id <> t.branch_id and t.op_type = 'CreateReference' and s.op_type = 'DeleteSymbol')
"""

#: A desired state for the customers' forest, and its plan.
DESIRED = """
desired as (
  select symbol_id, parent_id, kind, case when kind = 'class' and ordinal % 7 = 0 then name || ' (renamed)' else name end as name,
    case when kind = 'method' and ordinal % 11 = 0 then 'edited' when kind = 'method' and ordinal % 13 = 0 then null else body end as body, metadata, ordinal
  from sym where not (kind = 'method' and ordinal % 17 = 0)
  union all select 'new:' || symbol_id, symbol_id, 'method', 'added', 'new', '{}', (1::bigint << 40) + ordinal from sym where kind = 'class' and ordinal % 5 = 0),
desired_ref as (
  select reference_id, r.from_symbol_id, to_symbol_id, kind, ordinal from ref r where ordinal % 19 <> 0 and exists (select 1 from desired d where d.symbol_id = r.from_symbol_id)
  union all select 'newref:' || symbol_id, 'new:' || symbol_id, symbol_id, 'calls', (1::bigint << 40) + ordinal from sym where kind = 'class' and ordinal % 5 = 0)
"""


def sql(*parts: str, select: str, recursive: str = "") -> str:
    return "with " + ("recursive " if recursive else "") + ",\n".join([p.strip() for p in [*parts, *([recursive] if recursive else [])]]) + "\n" + select
