"""Registered queries of geometry, stamps and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.operators import assembly, reports, stamps as g
from quirework.plans.fixtures import derive as t
from quirework.plans.registry import query
from quirework.sources.formats import MAX_BATCH_OUTPUT_BYTES

_BOX = """box as (select *, rotation % 360 as angle, case when rotation % 180 <> 0 then height else width end as sw, case
    when rotation % 180 <> 0 then width else height end as sh from doc_pages)"""


def _pt(vx: str, vy: str) -> tuple[str, str]:
    return (f"case angle when 90 then x + {vy} when 180 then x + width - {vx} when 270 then x + width - {vy} else x + {vx} end",
            f"case angle when 90 then y + {vx} when 180 then y + {vy} when 270 then y + height - {vx} else y + height - {vy} end")


_cx, _cy = _pt("0", "0")
query("g1_page_display_boxes", f"with {_BOX} select doc_id, ordinal, angle, sw as shown_width, sh as shown_height, {_cx} as corner_x, {_cy} as corner_y from box")(
    lambda s, d: g.page_display_boxes(t(s, d, "doc_pages")).select("doc_id", "ordinal", "angle", "shown_width", "shown_height", "corner_x", "corner_y"))

_px, _py = _pt("ox", "(sh - oy)")


def _place(source: str) -> str:
    """From rows with a box and anchor, margin, tilt, cw, ch to px, py, rotate."""
    return f"""blk as (select *, case when anchor like '%-left' then margin when anchor like '%-right' then sw - cw - margin
    else (sw - cw) / 2 end as bx0, case when anchor like 'bottom-%' then margin when anchor like 'top-%' then sh - ch - margin
    else (sh - ch) / 2 end as by0 from {source}),
 clp as (select *, least(greatest(bx0, 0), greatest(sw - cw, 0)) as bx, least(greatest(by0, 0), greatest(sh - ch, 0)) as bys from blk),
 org as (select *, bx + cw / 2 - (cw / 2 * cos(radians(tilt)) - ch / 2 * sin(radians(tilt))) as ox,
    bys + ch / 2 - (cw / 2 * sin(radians(tilt)) + ch / 2 * cos(radians(tilt))) as oy from clp),
 plc as (select *, round({_px}, 6) as px, round({_py}, 6) as py, angle + tilt as rotate from org)"""


def _stamps(s):
    return s.createDataFrame([(a, tilt, 24.0, 100.0, 20.0) for a in g.ANCHORS for tilt in (0, 45)], "anchor string, tilt int, margin double, cw double, ch double")


_vals = ", ".join(f"('{a}', {tilt}, 24.0::double, 100.0::double, 20.0::double)" for a in g.ANCHORS for tilt in (0, 45))
query("g2_place_stamps", f"""with {_BOX}, src as (select * from box, (values {_vals}) as st(anchor, tilt, margin, cw, ch)), {_place('src')}
    select doc_id, ordinal, anchor, tilt, px, py, rotate from plc""")(
    lambda s, d: g.place_stamps(t(s, d, "doc_pages"), _stamps(s)))
query("g3_number_pages", """select doc_id, ordinal, (row_number() over (partition by doc_id
    order by ordinal) + 4) || ' of ' || (count(*) over (partition by doc_id) + 4) as label from doc_pages where ordinal % 3 <> 0""")(
    lambda s, d: g.number_pages(t(s, d, "doc_pages").where("ordinal % 3 <> 0"), 5, "of"))
query("g4_watermark_plan", """select doc_id, ordinal, 'DRAFT COPY' as text from doc_pages where (doc_id, ordinal) in (select (doc_id, ordinal)
    from doc_pages where (doc_id + ordinal) % 2 = 0)""")(
    lambda s, d: g.watermark_plan(t(s, d, "doc_pages"), "  DRAFT \t COPY ", t(s, d, "doc_pages").where("(doc_id + ordinal) % 2 = 0").selectExpr("doc_id", "ordinal as page")))
_img = """src as (select b.*, i.asset, s.anchor, s.margin, s.tilt, sw * fraction as cw, sw * fraction * img_h / img_w as ch from box b
    join (select doc_id, 'a' || (1 + doc_id % 500) as asset, 0.25::double as fraction, 'bottom-right' as anchor, 18.0::double as margin, 30 as tilt
    from doc_manifest) s using (doc_id) join image_assets i on i.asset = s.asset)"""
query("g5_image_stamp_plan", f"with {_BOX}, {_img}, {_place('src')} select doc_id, ordinal, asset, round(cw, 6) as cw, round(ch, 6) as ch, px, py, rotate from plc")(
    lambda s, d: g.image_stamp_plan(t(s, d, "doc_pages"), t(s, d, "doc_manifest").selectExpr("doc_id", "'a' || (1 + doc_id % 500) as asset", "0.25D as fraction", "'bottom-right' as anchor", "18D as margin", "30 as tilt"), t(s, d, "image_assets"))[0])
_FIT = """select asset, round(pw, 6) as page_w, round(ph, 6) as page_h, round(img_w * sc, 6) as w, round(img_h * sc, 6) as h,
    round((pw - img_w * sc) / 2, 6) as x, round((ph - img_h * sc) / 2, 6) as y from f"""
query("g6_image_page_plan", f"""with p as (select *, case when img_w > img_h then 841.89 else 595.28 end::double as pw, case
    when img_w > img_h then 595.28 else 841.89 end::double as ph from image_assets),
 f as (select *, least((pw - 72) / img_w, (ph - 72) / img_h) as sc from p) {_FIT}""")(lambda s, d: g.image_page_plan(t(s, d, "image_assets"), "a4", 36.0))
query("g6_image_page_plan_own_shape", f"""with f as (select *, 842.0::double / greatest(img_w, img_h) as sc, img_w * (842.0::double / greatest(img_w,
    img_h)) as pw, img_h * (842.0::double / greatest(img_w, img_h)) as ph from image_assets) {_FIT}""")(
    lambda s, d: g.image_page_plan(t(s, d, "image_assets"), "own"))
query("g7_normalize_gestures", """select * from (select id, least(x1, x2) as x, least(y1, y2) as y, abs(x2 - x1) as width, abs(y2 - y1) as height
    from strokes) where width >= 3 and height >= 3""")(lambda s, d: g.normalize_gestures(t(s, d, "strokes")))

query("q1_classify_errors", """select day, case when known is not null then known when message ilike '%password%'
    or message ilike '%is encrypted%' then 'encrypted' when regexp_matches(message, '(?i)invalid pdf|failed to parse|no pdf header') then 'invalid'
 when regexp_matches(message, '(?i)fetch|network|load failed|importScripts|worker') then 'assets' when regexp_matches(message,
    '(?i)detached|out of memory|allocation|maximum call stack') then 'too-large' else 'unknown' end as kind, count(*) as n from error_log group by all""")(
    lambda s, d: reports.classify_errors(t(s, d, "error_log")))
query("q2_size_report", """select source, count(*) as files, sum(in_bytes)::bigint as in_bytes, sum(out_bytes)::bigint as out_bytes,
    round((1 - sum(out_bytes)::double / sum(in_bytes)) * 100)::bigint as saved_percent, count(*) filter (out_bytes > in_bytes) as grew from outputs
    group by 1""")(
    lambda s, d: reports.size_report(t(s, d, "outputs"), "source"))
query("q3_batch_outcome", f"""with p as (select *, coalesce(sum(out_bytes) over (partition by batch_id order by pos rows between unbounded preceding
    and 1 preceding), 0) <= {MAX_BATCH_OUTPUT_BYTES // 16} as processed from batch_items)
 select batch_id, count(*) filter (processed and status = 'ok') as converted, count(*) filter (processed and status <> 'ok') as failed,
    count(*) filter (processed and timed_out) as timed_out, count(*) filter (not processed) as skipped,
 coalesce(sum(page_count) filter (processed and status = 'ok'), 0)::bigint as pages from p group by 1""")(lambda s, d: reports.batch_outcome(assembly.batch_budget_cut(t(s, d, "batch_items"), MAX_BATCH_OUTPUT_BYTES // 16)))
