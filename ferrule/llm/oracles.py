"""Plain SQL for the operators' queries, where SQL can express them.  Meant for small tables."""

from __future__ import annotations

from . import divergence, line_dedup, prefix_trie

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_SPACE = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[0-9a-z\x{80}-\x{10FFFF}]+"

NGRAM_JOIN = rf"""
with recursive d as (select doc_id, regexp_extract_all({_lower('text')}, '{_SPACE}') as w from documents),
grams as materialized (
  select distinct doc_id, g from (
    select doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
  )
),
size as materialized (select d.doc_id, count(g.g) as n from d left join grams g using (doc_id) group by 1),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as materialized (select a, b from pair p join size x on p.a = x.doc_id join size y on p.b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select s.doc_id, s.n as n_shingles, least(s.doc_id, coalesce((select min(b) from reach where a = s.doc_id), s.doc_id)) as component_id,
  (select count(*) from link where a = s.doc_id) as n_links from size s
"""

DECONTAMINATE = rf"""
with d as materialized (select doc_id, regexp_extract_all({_lower('text')}, '{_PLAIN}') as w from documents),
item as (select cast(item_id as varchar) as item_id, regexp_extract_all({_lower('text')}, '{_PLAIN}') as w from benchmark),
win as materialized (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)
),
part as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from win) lengths where len(w) >= n)
),
hit as materialized (select doc_id, i, part.n, item_id from part join win on part.k = win.k and part.n = win.n),
covered as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from hit) group by 1),
found as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id)), ',') as ids from hit group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""

EXACT_DEDUP = f"""
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from (
  select doc_id, text_sha256, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size
  from (select doc_id, sha256({_lower('text')}) as text_sha256 from documents)
)
"""

SUBSTRING_DEDUP = rf"""
with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
win as (
  select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) as n
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)
),
gone as materialized (select distinct doc_id, unnest(range(i, i + 20)) as place from win where n > 1),
kept as (
  select u.doc_id, string_agg(u.x, ' ' order by u.place) as kept
  from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as place from d) u left join gone g on u.doc_id = g.doc_id and u.place = g.place
  where g.place is null group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join (select doc_id, count(*) as n from gone group by 1) n using (doc_id) left join kept using (doc_id)
"""

SQL = {
    "op1_ngram_join": NGRAM_JOIN,
    "op3_decontaminate": DECONTAMINATE,
    "op5_exact_dedup": EXACT_DEDUP,
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op9_line_dedup": line_dedup.SQL,
    "op12_divergence": divergence.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
