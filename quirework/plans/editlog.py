"""Registered queries of the edit log."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from quirework.operators import editlog as e
from quirework.plans.fixtures import derive as t
from quirework.plans.registry import query

log = lambda s, d: t(s, d, "edit_log")
manifest = lambda s, d: log(s, d).select("doc_id", "pc").distinct()
fold = lambda s, d: e.page_order_fold(manifest(s, d), log(s, d))
state = lambda s, d: e.whole_state(manifest(s, d), log(s, d))


def fold_sql(log: str = "edit_log", docs: str = "select distinct doc_id, pc from edit_log", before: str = "") -> str:
    """The fold in DuckDB over a log and its documents: one recursion step for each structural edit of each document."""
    return f"""with recursive {before} docs as ({docs}),
 st as (select doc_id, seq, kind, page_id, before_id, case kind when 'insert' then list_transform(indices,
    lambda i: 'i' || seq || ':' || asset || ':' || i)
    when 'insertImages' then list_transform(range(len(assets)), lambda j: 'g' || (seq * 1000 + j) || ':' || assets[j + 1]) else [] end as added,
   row_number() over (partition by doc_id order by seq) as i from {log} where kind in ('delete', 'move', 'insert', 'insertImages')),
 run as (select doc_id, 0::bigint as i, list_transform(range(pc), lambda x: 'o' || x) as pages, []::struct(page varchar, seq bigint)[] as deletes
    from docs
  union all select doc_id, i, case when kind = 'delete' and gone then others
     when kind = 'move' and f > 0 and before_id is null then rest || [page_id]
     when kind = 'move' and f > 0 and coalesce(list_position(rest, before_id), 0) > 0 then rest[:list_position(rest,
    before_id) - 1] || [page_id] || rest[list_position(rest, before_id):]
     when kind in ('insert', 'insertImages') and coalesce(list_position(pages, before_id), 0) > 0 then pages[:list_position(pages,
    before_id) - 1] || added || pages[list_position(pages, before_id):]
     when kind in ('insert', 'insertImages') then pages || added else pages end as pages,
    case when kind = 'delete' and gone then list_append(deletes, {{'page': page_id, 'seq': seq}}) else deletes end as deletes
   from (select *, case when f > 0 then pages[:f - 1] || pages[f + 1:] end as rest, len(others) between 1 and len(pages) - 1 as gone
    from (select run.doc_id, st.i, run.pages, run.deletes, st.seq, st.kind, st.page_id, st.before_id, st.added, coalesce(list_position(run.pages,
    st.page_id), 0) as f, list_filter(run.pages, lambda x: x <> st.page_id) as others
      from run join st on st.doc_id = run.doc_id and st.i = run.i + 1))),
 fold as (select doc_id, arg_max(pages, i) as pages, arg_max(deletes, i) as deletes from run group by doc_id),
 pg as (select doc_id, unnest(pages) as page_id, unnest(range(1, len(pages) + 1)) as ordinal from fold),
 born as (select distinct pg.doc_id, pg.page_id, coalesce(ins.seq, -1) as seq from pg left join (select doc_id, seq, unnest(added) as page_id
    from st) ins on ins.doc_id = pg.doc_id and ins.page_id = pg.page_id),
 lst as (select l.doc_id, l.page_id, l.kind, l.payload from {log} l join born b on b.doc_id = l.doc_id and b.page_id = l.page_id and l.seq > b.seq
    where kind in ('crop', 'raster')
  qualify row_number() over (partition by l.doc_id, l.page_id, kind order by l.seq desc) = 1),
 trn as (select l.doc_id, l.page_id, sum(turns) as tt from {log} l join born b on b.doc_id = l.doc_id and b.page_id = l.page_id and l.seq > b.seq
    where kind = 'rotate' group by all),
 att as (select pg.doc_id, pg.page_id, coalesce(tt, 0) % 4 as turns, c.payload as crop, x.payload as raster from pg left join trn using (doc_id,
    page_id)
  left join (select * from lst where kind = 'crop') c using (doc_id, page_id) left join (select * from lst where kind = 'raster') x using (doc_id,
    page_id)),
 marks as (select l.doc_id, l.mark_id, l.page_id, l.seq from {log} l join born b on b.doc_id = l.doc_id and b.page_id = l.page_id and l.seq > b.seq
  where kind = 'draw' and not exists (from {log} x where x.doc_id = l.doc_id and x.kind = 'erase' and x.mark_id = l.mark_id and x.seq > l.seq)),
 flds as (select doc_id, field, new_value as value from (select *, row_number() over (partition by doc_id, field order by seq desc) as r from {log}
    where kind = 'setField') where r = 1),
 meta as (select doc_id, field as key, new_value as value from (select *, row_number() over (partition by doc_id, field order by seq desc) as r
    from {log} where kind = 'metadata') where r = 1 and new_value is not null),
 sett as (select doc_id, kind, payload from (select *, row_number() over (partition by doc_id, kind order by seq desc) as r from {log}
    where kind in ('watermark', 'numbering', 'flattenForms')) where r = 1)"""


FOLD = fold_sql()

query("e1_effective_edits", """select doc_id, t, cursor from (select *, min(cursor) over (partition by doc_id order by t rows between 1 following
    and unbounded following) as least from append_log) where least is null or least > cursor""")(
    lambda s, d: e.effective_edits(t(s, d, "append_log")))
query("e2_page_order_fold", f"{FOLD} select doc_id, pages, deletes from fold")(fold)
query("e3_page_attributes", f"{FOLD} select * from att")(lambda s, d: e.page_attributes(e.final_pages(fold(s, d)), log(s, d)))
query("e4_live_marks", f"{FOLD} select * from marks")(lambda s, d: e.live_marks(log(s, d), e.final_pages(fold(s, d))))
query("e5_field_values_at", f"{FOLD} select * from flds")(lambda s, d: e.field_values_at(log(s, d)))
query("e6_metadata_at", f"{FOLD} select * from meta")(lambda s, d: e.metadata_at(log(s, d)))
query("e7_document_settings_at", """select ids.doc_id, w.payload as watermark, n.payload as numbering, f.payload as "flattenForms" from (select distinct doc_id from edit_log) ids
 left join (select doc_id, payload from edit_log where kind = 'watermark' qualify row_number() over (partition by doc_id order by seq desc) = 1) w using (doc_id)
 left join (select doc_id, payload from edit_log where kind = 'numbering' qualify row_number() over (partition by doc_id order by seq desc) = 1) n using (doc_id)
 left join (select doc_id, payload from edit_log where kind = 'flattenForms' qualify row_number() over (partition by doc_id order by seq desc) = 1) f using (doc_id)""")(
    lambda s, d: e.document_settings_at(log(s, d), e.SETTINGS))


def _time_travel(s, d):
    """All parts of the states in one table: (doc_id, cursor, part, item, value)."""
    cursors = manifest(s, d).select("doc_id", F.explode(F.array(*(F.lit(x) for x in (-3, 0, 7, 20, 10_000)))).alias("cursor"))
    st = e.state_at(manifest(s, d), log(s, d), cursors)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    parts = (
        ("pages", st["pages"], text("ordinal"), F.col("page_id")),
        ("attributes", st["attributes"], F.col("page_id"), F.concat_ws("|", text("turns"), text("crop"), text("raster"))),
        ("marks", st["marks"], F.col("mark_id"), F.concat_ws("@", "page_id", text("seq"))),
        ("fields", st["fields"], F.col("field"), F.col("value")),
        ("metadata", st["metadata"], F.col("key"), F.col("value")),
        ("settings", st["settings"].unpivot(["doc_id", "cursor"], list(e.SETTINGS), "setting", "value").where("value is not null"), F.col("setting"), text("value")),
    )
    rows = [df.select("doc_id", "cursor", F.lit(name).alias("part"), item.alias("item"), value.alias("value")) for name, df, item, value in parts]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


# each cursor's log is a log of its own in the recursion: documents are numbered doc_id * 8 + cursor number
_CURSORS = """cur as (select distinct doc_id, c, least(greatest(cursor, 0), n) as upto from (select doc_id, count(*) as n from edit_log group by 1),
    (values (0, -3), (1, 0), (2, 7), (3, 20), (4, 10000)) as v(c, cursor)), tlog as (select e.* replace (e.doc_id * 8 + cur.c as doc_id)
    from edit_log e join cur using (doc_id) where seq < upto),"""
_TRAVEL = fold_sql("tlog", "select distinct e.doc_id * 8 + c as doc_id, pc from edit_log e join cur using (doc_id)", _CURSORS)
query("e8_state_at", f"""{_TRAVEL}, every_part as (select doc_id, 'pages' as part, ordinal::varchar as item, page_id as value from pg
  union all select doc_id, 'attributes', page_id, turns || '|' || coalesce(crop::varchar, '-') || '|' || coalesce(raster::varchar, '-') from att
    union all select doc_id, 'marks', mark_id, page_id || '@' || seq from marks
  union all select doc_id, 'fields', field, value from flds union all select doc_id, 'metadata', key, value from meta union all select doc_id,
    'settings', kind, payload::varchar from sett where payload is not null)
 select doc_id // 8 as doc_id, case doc_id % 8 when 0 then -3 when 1 then 0 when 2 then 7 when 3 then 20 else 10000 end as cursor, part, item, value
    from every_part""")(_time_travel)

# states after few edits, so that some documents are untouched
_early = lambda s, d: e.whole_state(manifest(s, d), log(s, d).where("seq < doc_id % 4"))
_EARLY = fold_sql("elog", before="elog as (select * from edit_log where seq < doc_id % 4),")
query("e9_untouched_documents", f"""{_EARLY} select docs.doc_id from docs join fold using (doc_id) where pages = list_transform(range(pc),
    lambda x: 'o' || x) and docs.doc_id not in (select doc_id from att where turns <> 0 or crop is not null or raster is not null)
  and docs.doc_id not in (select doc_id from marks) and docs.doc_id not in (select doc_id from flds) and docs.doc_id not in (select doc_id from meta)
    and docs.doc_id not in (select doc_id from sett where payload is not null)""")(lambda s, d: e.untouched_documents(manifest(s, d), _early(s, d)))
query("e10_referenced_assets", "select asset, asset in (select 'a' || k from edit_log) as kept from image_assets")(
    lambda s, d: (lambda kept, orphans: kept.select("asset", F.lit(True).alias("kept")).unionByName(orphans.select("asset", F.lit(False).alias("kept"))))(*e.referenced_assets(t(s, d, "image_assets"), log(s, d).selectExpr("'a' || k as asset"))))
query("e11_live_import_notes", f"""{FOLD} select doc_id, asset, note from (select doc_id, 'a' || page_id as asset, 'n' || event_id as note from edit_log
    where kind = 'draw') where (doc_id, asset) in (select (doc_id, 'a' || page_id) from pg)""")(
    lambda s, d: e.live_import_notes(log(s, d).where("kind = 'draw'").selectExpr("doc_id", "'a' || page_id as asset", "'n' || event_id as note"), e.final_pages(fold(s, d)).selectExpr("doc_id", "'a' || page_id as asset")))
_SIG = """sig as (select pg.doc_id, pg.ordinal, pg.page_id, sha256(pg.page_id || '|' || turns || '|' || coalesce(crop::varchar,
    '') || '|' || coalesce(raster::varchar, '') || '|' || coalesce(m, '')) as s
 from pg join (select distinct * from att) using (doc_id, page_id) left join (select doc_id, page_id, string_agg(mark_id, ',' order by mark_id) as m
    from marks group by all) using (doc_id, page_id))"""
query("e12_page_signatures", f"{FOLD}, {_SIG} select doc_id, ordinal, page_id, s as signature from sig")(lambda s, d: e.page_signatures(state(s, d)))
# both states in one recursion: documents are numbered doc_id * 2, and one more for the later state
_BOTH = fold_sql("blog", "select distinct doc_id * 2 + side as doc_id, pc from edit_log, (values (0), (1)) as v(side)", """blog as (select * replace (doc_id * 2 as doc_id)
    from edit_log where seq < doc_id % 4 union all select * replace (doc_id * 2 + 1 as doc_id) from edit_log),""")
query("e12_changed_pages", f"""{_BOTH}, {_SIG}, one as (select distinct doc_id, page_id, s from sig), ch as (select coalesce(b.doc_id,
    a.doc_id) // 2 as doc_id, page_id, case when b.s is null then 'added' when a.s is null then 'removed' when b.s <> a.s then 'changed' end as change
 from (select doc_id + 1 as doc_id, page_id, s from one where doc_id % 2 = 0) b full join (select * from one where doc_id % 2 = 1) a using (doc_id,
    page_id)) select * from ch where change is not null""")(
    lambda s, d: e.changed_pages(e.page_signatures(_early(s, d)), e.page_signatures(state(s, d))))
query("e13_resumable_sessions", """select session_key, shape, saved_at, event_id, complete from (select *, row_number() over (partition by session_key
    order by saved_at desc, event_id desc) as r from sessions where shape = 2 and complete) where r = 1""")(
    lambda s, d: e.resumable_sessions(t(s, d, "sessions"), 2))
query("e14_effective_values", """select doc_id, field, coalesce(wanted, value) as effective, nullif(wanted, value) as patch from fields left
    join (select doc_id, field, wanted from wanted where id % 5 <> 0) using (doc_id, field)""")(
    lambda s, d: e.effective_values(t(s, d, "fields"), t(s, d, "wanted").where("id % 5 <> 0").withColumnRenamed("wanted", "value")))
