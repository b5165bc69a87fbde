"""SQL of the whole name ladder, sequence ratio included, for the checking side."""

from tallypact import fixed_values as fv
from tallypact.workload import oracle_views as ov
from tallypact.workload.scalars import sql_norm, sql_slug

#: Pairs below cannot be placed and cannot block another pair.
LEAST = fv.FUZZY_FLOOR - fv.FUZZY_MARGIN


def ladder(names: str, spellings: str) -> str:
    """(scope, raw, entry_id, kind) of distinct ``names`` (scope, raw).

    ``spellings`` has scope, text, entry_id, place and rung (0 name, 1 alias). The ratio adds up the longest common blocks: of
    every pair of texts the longest, then those left and right of it, and so on.
    """
    return f"""
with recursive spelled as (select *, {sql_norm('text')} as key from {spellings}),
 named as (select distinct scope, raw, trim(raw) as t, {sql_norm('trim(raw)')} as key from {names}),
 by_name as (select scope, text, arg_min(entry_id, place) as hit from spelled where rung = 0 group by all),
 by_alias as (select scope, text, arg_min(entry_id, place) as hit from spelled where rung = 1 group by all),
 by_key as (select scope, key, arg_min(entry_id, place) as hit from spelled where key <> '' group by all),
 placed as (select n.scope, n.raw, n.key, coalesce(e.hit, a.hit, k.hit) as hit,
  case when e.hit is not null then 'exact' when a.hit is not null then 'alias'
   when k.hit is not null then 'normalised' end as kind
  from named n left join by_name e on e.scope = n.scope and e.text = n.t
  left join by_alias a on a.scope = n.scope and a.text = n.t
  left join by_key k on k.scope = n.scope and k.key = n.key),
 pairs as (select p.scope, p.key as a, k.key as b, length(p.key) + length(k.key) as size
  from (select distinct scope, key from placed where hit is null and key <> '') p
  join by_key k on k.scope = p.scope
  where 2.0 * list_sum(list_transform(list_distinct(regexp_extract_all(p.key, '.')), lambda c: least(
    length(p.key) - length(replace(p.key, c, '')), length(k.key) - length(replace(k.key, c, '')))))
   >= {LEAST} * (length(p.key) + length(k.key))),
 segments as (select scope, a, b, 1::bigint as a0, length(a) + 1 as a1, 1::bigint as b0, length(b) + 1 as b1,
   0::bigint as common from pairs
  union all
  select scope, a, b, case side when 0 then a0 else best.i + best.k end, case side when 0 then best.i else a1 end,
   case side when 0 then b0 else best.j + best.k end, case side when 0 then best.j else b1 end,
   case side when 0 then best.k else 0 end
  from (select scope, a, b, a0, a1, b0, b1, arg_min({{'k': k, 'i': i, 'j': j}}, {{'k': -k, 'i': i, 'j': j}}) as best
   from (select s.*, ri.i, rj.j, rk.k from segments s, unnest(range(a0, a1)) ri(i), unnest(range(b0, b1)) rj(j),
     unnest(range(1, least(a1 - ri.i, b1 - rj.j) + 1)) rk(k)
    where substr(a, ri.i, rk.k) = substr(b, rj.j, rk.k)) x group by scope, a, b, a0, a1, b0, b1) y,
   (values (0), (1)) sides(side)),
 scores as (select scope, a, b, 2.0 * sum(common) / (length(a) + length(b)) as score from segments group by scope, a, b),
 top as (select scope, a, list(score order by score desc) as s, arg_max(b, score) as best from scores group by scope, a)
select p.scope, p.raw, coalesce(p.hit, k.hit) as entry_id, coalesce(p.kind,
  case when k.hit is not null then 'fuzzy' else 'unmatched' end) as kind
from placed p left join top t on p.hit is null and t.scope = p.scope and t.a = p.key
  and t.s[1] >= {fv.FUZZY_FLOOR} and t.s[1] - coalesce(t.s[2], 0.0) >= {fv.FUZZY_MARGIN}
 left join by_key k on k.scope = t.scope and k.key = t.best"""


ov.VIEWS["program_spellings"] = f"""select '' as scope, name as text, {sql_slug('name')} as entry_id,
  {{'p': name, 'n': n}} as place, n as rung from (select name, 0 as n from programs)
 union all select '', name || ' Plan', {sql_slug('name')}, {{'p': name, 'n': 1}}, 1 from programs"""
ov.VIEWS["item_spellings"] = f"""select distinct {sql_slug('p_name')} as scope, p_brand as text,
  {sql_slug('p_brand')} as entry_id, {{'p': p_brand, 'n': 0}} as place, 0 as rung from part"""
ov.VIEWS["program_names"] = "select '' as scope, raw from raw_names"
ov.VIEWS["program_ladder"] = ladder("program_names", "program_spellings")
#: Names that no rung of the ladder places.
ov.VIEWS["unplaced"] = "select raw from program_ladder where kind = 'unmatched'"
UNPLACED = "raw_names programs program_names program_spellings program_ladder unplaced"
ov.VIEWS["item_names"] = """select entry_id as scope, item_raw as raw from raw_names join program_ladder using (raw)
  where entry_id is not null and coalesce(trim(item_raw), '') <> ''"""
ov.VIEWS["item_ladder"] = ladder("item_names", "item_spellings")
