"""DuckDB SQL for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

_STAMP = r"^\s*\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*([Zz]|[+-]\d{2}:?\d{2})?\s*$"

_MESSAGES = rf"""
m as (
  select distinct id, session_id, content,
    case when lower(regexp_replace(sender, '^\s+|\s+$', '', 'g')) in ('user', 'human') then 'user'
         when lower(regexp_replace(sender, '^\s+|\s+$', '', 'g')) in ('assistant', 'ai', 'bot') then 'assistant' end as role,
    case when regexp_matches(timestamp, '{_STAMP}') then try_cast(
      case when regexp_matches(timestamp, '([Zz]|[+-]\d{{2}}:?\d{{2}})\s*$') then trim(timestamp) else trim(timestamp) || '+00:00' end as timestamptz) end as ts,
    not coalesce(regexp_matches(regexp_replace(content, '(?is)<think>.*?</think>', '', 'g'), '[\p{{L}}\p{{N}}]'), false) as blank
  from messages where session_id is not null)"""

_REASONS = f"""
with {_MESSAGES},
o as (
  select session_id, role,
    lag(role) over w as before, row_number() over w as n,
    row_number() over (partition by session_id order by ts desc, role, id desc) as back
  from m where not blank and role is not null and ts is not null
  window w as (partition by session_id order by ts, role desc, id)),
flow as (
  select session_id, bool_or(role = 'user' and before = 'user') as uu, bool_or(role = 'assistant' and before = 'assistant') as aa,
    max(case when n = 1 then role end) as first, max(case when back = 1 then role end) as last
  from o group by session_id),
named as (select distinct id as session_id from sessions where id is not null union select distinct session_id from m),
odd as (select session_id, bool_or(role is null or ts is null) as odd from m where not blank group by session_id),
r as (
  select named.session_id,
    case when odd.odd is null then 'empty'
         when named.session_id not in (select id from sessions where id is not null) or odd.odd or first = 'assistant' or coalesce(aa, false) then 'broken'
         when coalesce(uu, false) or last = 'user' then 'missing_reply' end as reason
  from named left join odd using (session_id) left join flow using (session_id))"""

SQL: dict[str, str] = {
    "p1_found": f"{_REASONS} select session_id, reason from r where reason is not null",
    "p1_conversations": f"""{_REASONS}
select m.session_id, row_number() over (partition by m.session_id order by ts, role desc, id) as turn, id as message_id, role, content
from m join r on r.session_id = m.session_id where reason is null and not blank""",
    "p3_found": """
with v as (select chunk_id, any_value(vector) as vector from text_pages
  where chunk_id is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by chunk_id),
u as (select chunk_id, cast(vector as double[64]) as x from v),
c as (select a.chunk_id as a, b.chunk_id as b, array_cosine_similarity(a.x, b.x) as s from u a join u b on a.chunk_id <> b.chunk_id),
n as (select a, b, row_number() over (partition by a order by s desc, b) as n from c where s >= 0.94)
select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from n where n <= 10""",
    "p2_found": r"""
with t as (select distinct chunk_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) as body from text_pages where length(text) > 1200),
fits as (
  select chunk_id, body,
    list_max(list_transform(regexp_split_to_array(body, '(?:[ \t]*(?:\r\n|\r|\n)){2,}[ \t]*'), lambda s: length(trim(s, chr(32) || chr(9) || chr(10) || chr(13))))) as p,
    list_max(list_transform(regexp_split_to_array(regexp_replace(body, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda s: length(trim(s, chr(32) || chr(9) || chr(10) || chr(13))))) as s,
    list_max(list_transform(regexp_split_to_array(body, '[ \t\r\n]+'), lambda s: length(s))) as w
  from t)
select distinct chunk_id, case when p <= 1200 then 'paragraph' when s <= 1200 then 'sentence' when w <= 1200 then 'word' else 'none' end as cut from fits""",
    "p6_found": """
with rows as (
  select distinct 'i:' || id as case_key, majority_pass, requires_crossref, voters, votes from panel_arm_i
  union all select distinct 'g2:' || id, majority_pass, requires_crossref, voters, votes from panel_arm_g2),
m as (
  select *, len(list_filter(votes, lambda v: v)) as y, len(list_filter(votes, lambda v: not v)) as n from rows),
j as (select *, case when y > n then true when y < n then false end as majority from m),
v as (select unnest(voters) as voter, unnest(votes) as vote, majority from j)
select distinct 'item' as kind, case_key from j where majority_pass is distinct from majority
union all
select 'voter', voter from v where vote is not null and majority is not null
group by voter having avg(case when vote = majority then 1.0 else 0.0 end) < 0.75""",
}
