"""The assessment in plain SQL, step by step, to hold the DataFrame operators against."""

from __future__ import annotations

from ..sources import catalog
from . import fleet

B = "chr(92)"


def norm(x: str) -> str:
    p = f"""replace(trim(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '"'), '/', {B})"""
    p = f"case when starts_with({p}, concat({B},{B},'?',{B},'UNC',{B})) then concat({B},{B},substr({p},9)) when starts_with({p}, concat({B},{B},'?',{B})) then substr({p},5) else {p} end"
    bare = f"rtrim({p}, {B})"
    # concat() ignores null, so that null would become an empty path
    return f"case when {x} is not null then lower(concat({bare}, repeat({B}, greatest(least(strlen({p}) - strlen({bare}), 3 - strlen({bare})), 0)))) end"


def name(x: str) -> str:
    return f"split_part({x}, {B}, -1)"


def network(x: str) -> str:
    return f"starts_with({x}, concat({B},{B}))"


def absolute(x: str) -> str:
    return f"((regexp_matches({x}, '^[A-Za-z]:[\\\\]') or {network(x)}) and not contains({x}, '%'))"


def script(x: str) -> str:
    return f"regexp_matches({name(x)}, '\\.(vbs|vbe|wsf|wsc|hta)$')"


def rank(x: str) -> str:
    return "case " + x + "".join(f" when '{k}' then {v}" for k, v in catalog.ACTIVATION_RANK.items()) + f" else {catalog.UNKNOWN_ACTIVATION_RANK} end"


_RULES = ", ".join(f"('{r[0]}', {r[3]!r}::double, {r[4]!r}::double, '{r[5]}', '{r[6]}')" for r in catalog.RULES)

BASE = f"""
with recursive scans as materialized ({fleet.plain(fleet.SCANS)}),
all_findings as materialized ({fleet.plain(fleet.FINDINGS)}),
rules(rule, min_hours, max_hours, basis, hint) as (values {_RULES}),
ranked as (
  select *, row_number() over (partition by lower(hostname), lower(coalesce(domain, '')), lower(coalesce(machine_id, '')) order by started_at desc, load_idx) as rn from scans
),
chosen as materialized (select * from ranked where rn = 1),
f as materialized (
  select x.*, {norm('loc_path')} as path, {norm('target')} as n_target, {rank('activation')} as r from all_findings x join chosen using (load_idx)
),
store as (select distinct sha256 as h from f where loc_kind = 'file' and sha256 is not null and contains(path, concat({B}, 'windows', {B}, 'winsxs', {B}))),
o as materialized (
  select *, case when windows then concat_ws('|', 'w', rule, status, coalesce(reason, ''), {name('path')})
      when loc_kind = 'file' and {network('path')} then concat_ws('|', 'n', rule, status, coalesce(reason, ''), path, lower(coalesce(loc_item, '')))
      else concat_ws('|', 'l', rule, status, coalesce(reason, ''), loc_kind, path, lower(coalesce(loc_item, '')), coalesce(n_target, ''), coalesce(sha256, '')) end as item_key
  from (select f.*, loc_kind = 'file' and (contains(path, concat({B}, 'windows', {B}, 'winsxs', {B})) or coalesce(sha256 in (select h from store), false)) as windows from f)
),
seen as (select item_key, kind, loc_kind, status, row_number() over (partition by item_key order by load_idx, pos) as n, load_idx, pos from o),
shown as (select *, row_number() over (partition by item_key order by load_idx, loc_path, loc_item nulls first, pos) as n from o),
draft as materialized (
  select s.item_key, s.kind as seen_kind, s.loc_kind as seen_loc, s.status as seen_status, s.load_idx as first_machine, s.pos as first_pos,
    g.machines, g.occurrences, g.r, case when d.windows then 'windows' else 'own' end as origin,
    d.rule, d.kind, case when d.classification = 'breaks' then 'breaks' else 'review' end as classification, d.status, d.reason, d.load_idx as machine, d.loc_path, d.loc_item, d.target, d.file_size, d.sha256
  from (select * from seen where n = 1) s join (select * from shown where n = 1) d using (item_key)
  join (select item_key, count(distinct load_idx) as machines, count(*) as occurrences, max(r) as r from o group by 1) g using (item_key)
),
scripts as materialized (
  select distinct d.item_key as dst, o.load_idx, o.path from o join draft d using (item_key)
  where seen_kind in ('scriptFile', 'scriptInvocation') and seen_loc = 'file' and seen_status = 'detected'
),
starters as materialized (
  select distinct d.item_key as src, o.load_idx, o.n_target from o join draft d using (item_key)
  where seen_kind not in ('scriptFile', 'hardcodedCredential') and n_target is not null
),
names as (select load_idx, {name('path')} as name, min(dst) as dst from scripts group by all having count(distinct dst) = 1),
links as materialized (
  select distinct src, dst from (
    select src, dst from starters join scripts on n_target = path where {network('n_target')}
    union all select src, dst from starters s join scripts c on s.n_target = c.path and s.load_idx = c.load_idx where {absolute('n_target')} and not {network('n_target')}
    union all select src, dst from starters s join names n on s.load_idx = n.load_idx and {name('n_target')} = n.name where not {absolute('n_target')} and not {network('n_target')}
  ) where src <> dst
),
reach(src, dst) as (select src, dst from links union select r.src, l.dst from reach r join links l on r.dst = l.src),
active as (
  select d.*, greatest(d.r, coalesce((select max(s.r) from reach join draft s on s.item_key = reach.src where reach.dst = d.item_key), 0)) as rr from draft d
),
risky as (
  select *, case when origin = 'windows' then 'info' when classification = 'breaks' and rr >= 5 then 'high' when (classification = 'breaks' and rr >= 2) or rr >= 5 then 'medium' else 'low' end as risk from active
),
numbers as materialized (
  select *, row_number() over (order by case origin when 'own' then 0 else 1 end, case risk when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end, rr desc,
    classification <> 'breaks', status <> 'detected', machines desc, rule, lower(loc_path), lower(coalesce(loc_item, '')), first_machine, first_pos) as number from risky
),
same as materialized (
  select *, case when eligible and first < number then first end as same_as from (
    select *, origin = 'own' and status = 'detected' and sha256 is not null as eligible,
      min(case when origin = 'own' and status = 'detected' and sha256 is not null then number end) over (partition by rule, lower(coalesce(loc_item, '')), sha256) as first from numbers
  )
),
missing as (
  select distinct s.number, case when {absolute('n_target')} then n_target else {name('n_target')} end as script
  from (select item_key, number, rule, origin, same_as, status from same) s join rules using (rule) join (select item_key, n_target from o) t using (item_key)
  where s.origin = 'own' and same_as is null and basis = 'entry' and s.status = 'detected' and item_key not in (select src from links) and {script('n_target')}
),
carrier as (select distinct number from (select script, min(number) as number from missing group by 1)),
items as materialized (
  select s.*, coalesce(r.hint, null) as hint, c.number is not null as typical_script,
    case when s.origin <> 'own' then 'windows' when same_as is not null then 'sameAs' else 'hours' end as effort_kind,
    case when s.origin = 'own' and same_as is null then coalesce(r.min_hours, 0.25) * factor + case when c.number is not null then 1.0 else 0.0 end end as min_hours,
    case when s.origin = 'own' and same_as is null then coalesce(r.max_hours, 1.0) * factor + case when c.number is not null then 4.0 else 0.0 end end as max_hours
  from (select same.*, case when rule in (select rule from rules where basis = 'scriptSize') then case when file_size is null or file_size <= 8192 then 1 when file_size <= 32768 then 2 when file_size <= 131072 then 4 else 8 end else 1 end as factor from same) s
  left join rules r using (rule) left join carrier c on s.number = c.number
)
"""


def over(sql: str) -> str:
    """A query over the tables of BASE."""
    return f"{BASE}\n{sql}"
