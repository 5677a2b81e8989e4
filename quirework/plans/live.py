"""Registered queries of live sessions, over the events as a table; tests run the same functions as streams."""

from __future__ import annotations

from quirework.plans.registry import query
from quirework.streaming import live

events = lambda s, d: live.read_events(s, f"{d.rstrip('/')}/events.parquet")
requests = lambda df: df.where("event_type = 'click'").selectExpr("event_id as request_id", "user_id as doc_id", "ts as asked_at")
replies = lambda df: df.where("event_type = 'purchase'").selectExpr("event_id as reply_id", "user_id as reply_doc", "ts as replied_at")
COMMAND = "case event_type when 'purchase' then 'append' when 'error' then 'undo' else 'redo' end as command"
commands = lambda df: df.where("event_type in ('purchase', 'error', 'view')").selectExpr("user_id as doc_id", "struct(ts, event_id) as seq", COMMAND)
statuses = lambda df: df.selectExpr("user_id div 10 as batch_id", "user_id as item", "struct(ts, event_id) as at", "case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'running' end as status")

query("x1_edit_bursts", """with g as (select *, case when ts - lag(ts) over w >= interval 6 hours or lag(ts) over w is null then 1 else 0 end as opens
    from events window w as (partition by user_id order by ts)),
 n as (select *, sum(opens) over (partition by user_id order by ts, event_id) as k from g) select user_id as doc_id, min(ts) as started,
    max(ts) + interval 6 hours as settles, count(*) as edits from n group by user_id, k""")(
    lambda s, d: live.edit_bursts(events(s, d)))
query("x2_latest_generation", "select user_id as doc_id, max(event_id) as generation, arg_max(event_type, event_id) as result from events group by 1")(
    lambda s, d: live.latest_generation(events(s, d).selectExpr("user_id as doc_id", "event_id as generation", "event_type as result")))
query("x3_reply_deadlines", """select c.event_id as request_id, min(p.event_id) as reply_id, min(p.event_id) is not null as answered from events c
    left join events p on p.event_type = 'purchase' and p.user_id = c.user_id and p.ts >= c.ts and p.ts <= c.ts + interval 6 hours
 where c.event_type = 'click' group by 1""")(lambda s, d: live.first_replies(live.reply_deadlines(requests(events(s, d)), replies(events(s, d)))))
query("x4_live_cursor", """with recursive c as (select user_id as doc_id, event_type, row_number() over (partition by user_id order by ts,
    event_id) as i from events where event_type in ('purchase', 'error', 'view')),
 f as (select distinct doc_id, 0::bigint as i, 0::bigint as cursor, 0::bigint as length from c union all select f.doc_id, c.i, case event_type
    when 'purchase' then cursor + 1 when 'error' then greatest(cursor - 1, 0) else least(cursor + 1, length) end,
  case event_type when 'purchase' then cursor + 1 else length end from f join c on c.doc_id = f.doc_id and c.i = f.i + 1)
 select doc_id, arg_max(cursor, i) as cursor, arg_max(length, i) as length from f group by 1""")(lambda s, d: live.live_cursor(commands(events(s, d))))
query("x5_batch_progress", """with l as (select user_id // 10 as batch_id, user_id, arg_max(case event_type when 'purchase' then 'done'
    when 'error' then 'failed' else 'running' end, (ts, event_id)) as status from events group by all)
 select batch_id, count(*) as items, count(*) filter (status = 'done') as done, count(*) filter (status = 'failed') as failed,
    floor(100 * count(*) filter (status = 'done') / count(*))::bigint as percent from l group by 1""")(
    lambda s, d: live.batch_progress(statuses(events(s, d))))
