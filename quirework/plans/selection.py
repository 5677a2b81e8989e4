"""Registered queries of sources, selection and assembly."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quirework.durable import own_dir
from quirework.operators import assembly, naming, search, selection
from quirework.plans.fixtures import derive as t
from quirework.plans.registry import query
from quirework.sources import corpus
from quirework.sources.formats import FORMATS, LIMITS, MAX_BATCH_OUTPUT_BYTES, MIB

_formats = "(values " + ", ".join(f"('{e}', '{f}', '{n}', {str(x).lower()})" for e, f, n, x in FORMATS) + ") as f(extension, filter, family, legacy)"
_limits = "(values " + ", ".join(f"('{a}', {b}, {c if c else 'null'})" for a, b, c in LIMITS) + ") as l(tool, max_bytes, max_pages)"

query("s1_load_corpus", "select source, lang, count(*) as n, count(*) filter (text is not null and text <> '') as readable from documents group by all")(
    lambda s, d: corpus.load_corpus(s, d)["documents"].groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if("readable").alias("readable")))
query("s2_route_files", f"""select doc_id, extension, filter, family, legacy from (select doc_id, lower(regexp_extract(file_name, '(\\.[^.]+)$',
    1)) as extension from doc_manifest) left join {_formats} using (extension)""")(
    lambda s, d: (lambda routed, rejected: routed.select("doc_id", "extension", "filter", "family", "legacy").unionByName(rejected.select("doc_id", "extension"), allowMissingColumns=True))(*corpus.route_files(t(s, d, "doc_manifest"))))
query("s3_audit_asset_types", """select declared_kind, case when head_hex like '89504E%' then 'png' when head_hex like 'FFD8FF%' then 'jpg'
    else 'unknown' end as sniffed, count(*) as n from image_assets group by all""")(
    lambda s, d: corpus.audit_asset_types(t(s, d, "image_assets")))
query("s4_admit_files", f"""select doc_id, tool, reason is null as admitted, reason from (select doc_id, tool, case
    when size_bytes > max_bytes then 'too-large' when page_count > max_pages then 'too-many-pages' end as reason from doc_manifest, {_limits})""")(
    lambda s, d: corpus.admit_files(t(s, d, "doc_manifest")))

_parts = """parts as (select doc_id, part, (part - 1) * s + least(part - 1, x) + 1 as from_page, (part - 1) * s + least(part - 1, x) + s + (case
    when part <= x then 1 else 0 end) as to_page
  from (select doc_id, page_count // k as s, page_count % k as x, unnest(generate_series(1, k)) as part from (select doc_id, page_count,
    least(2 + doc_id % 5, page_count) as k from doc_manifest)))"""
_split = lambda s, d: selection.split_into_parts(t(s, d, "doc_manifest"), 2 + F.col("doc_id") % 5)
query("s5_part_names", f"""with {_parts} select doc_id, part, regexp_replace(file_name, '\\.[^.]+$', '') || '-' || lpad(part::varchar,
    length(max(part) over (partition by doc_id)::varchar)::int, '0') || '.pdf' as name from parts join doc_manifest using (doc_id)""")(
    lambda s, d: corpus.part_names(_split(s, d), t(s, d, "doc_manifest")))


def _written(s, d):
    """Parts of every document, written and read again: one folder a batch, with the part's name beside each page."""
    manifest = t(s, d, "doc_manifest")
    named = _split(s, d).join(corpus.part_names(_split(s, d), manifest), ["doc_id", "part"]).join(manifest.select("doc_id", "batch_id"), "doc_id")
    path = f"{own_dir(s)}/parts-{uuid.uuid4().hex}"
    corpus.write_parts(named, t(s, d, "doc_pages").select("doc_id", "ordinal", "page_id"), path, ("batch_id",))
    return s.read.parquet(path).select("doc_id", "part", "name", "ordinal", "page_id", F.col("batch_id").cast("long").alias("batch_id"))


query("s5_write_parts", f"""with {_parts}, nm as (select doc_id, part, regexp_replace(file_name, '\\.[^.]+$', '') || '-' || lpad(part::varchar,
    length(max(part) over (partition by doc_id)::varchar)::int, '0') || '.pdf' as name, batch_id from parts join doc_manifest using (doc_id))
 select doc_id, part, name, ordinal, page_id, batch_id from parts join nm using (doc_id, part) join doc_pages using (doc_id)
    where ordinal between from_page and to_page""")(_written)
query("p5_split_into_parts", f"with {_parts} select * from parts")(_split)

_tok = r"""tok as (select sel_id, doc_id, pos, trim(raw) as token, page_count as n from (select sel_id, doc_id, page_count,
    unnest(string_split(range_text, ',')) as raw, unnest(range(len(string_split(range_text, ',')))) as pos
   from selections join doc_manifest using (doc_id) where page_count >= 1) where trim(raw) <> ''),
 cut as (select *, regexp_extract(token, '^(\d*)\s*-\s*(\d*)$', 1) as a, regexp_extract(token, '^(\d*)\s*-\s*(\d*)$', 2) as b, regexp_matches(token,
    '^(\d*)\s*-\s*(\d*)$') as r from tok),
 ends as (select *, case when r and (a <> '' or b <> '') then case when a = '' then 1 else least(greatest(coalesce(try_cast(a as bigint), n), 1),
    n) end end as lo,
   case when r and (a <> '' or b <> '') then case when b = '' then n else least(greatest(coalesce(try_cast(b as bigint), n), 1), n) end end as hi,
   case when regexp_matches(token, '^\d+$') and try_cast(token as bigint) between 1 and n then try_cast(token as bigint) end as single from cut),
 exp as (select sel_id, doc_id, pos, unnest(l) as page, unnest(range(len(l))) as k from (select *, case when lo is not null
    and lo <= hi then generate_series(lo, hi) when lo is not null then generate_series(lo, hi, -1) when single is not null then [single]
    else [] end as l from ends)),
 rows_ as (select sel_id, doc_id, row_number() over (partition by sel_id order by pos, k) as ordinal, page from exp)"""
_exp = lambda s, d: selection.expand_page_ranges(t(s, d, "selections"), t(s, d, "doc_manifest"))
query("p1_expand_page_ranges", f"with {_tok} select * from rows_")(_exp)
query("p2_invalid_selection_tokens", f"with {_tok} select sel_id, pos, token from ends where lo is null and single is null")(
    lambda s, d: selection.invalid_selection_tokens(t(s, d, "selections"), t(s, d, "doc_manifest")))
query("p3_page_set", f"with {_tok} select distinct sel_id, page from rows_")(lambda s, d: selection.page_set(t(s, d, "selections"), t(s, d, "doc_manifest")))
query("p4_summarize_page_runs", f"""with {_tok}, g as (select *, sum(case when page = prev + 1 then 0 else 1 end) over (partition by sel_id
    order by ordinal) as run from (select *, lag(page) over (partition by sel_id order by ordinal) as prev from rows_)),
 r as (select sel_id, run, min(page) as a, max(page) as b from g group by all) select sel_id, string_agg(case when a = b then a::varchar
    else a || '-' || b end, ', ' order by run) as text from r group by sel_id""")(
    lambda s, d: selection.summarize_page_runs(_exp(s, d)))
query("p3_page_set_all", "select sel_id, unnest(range(1, page_count + 1)) as page from selections join doc_manifest using (doc_id)")(
    lambda s, d: selection.page_set(t(s, d, "selections"), t(s, d, "doc_manifest"), "all"))


def _extract(s, d):
    """Selections as they are, but of every ninth document one that can't be read."""
    asked = t(s, d, "selections").withColumn("range_text", F.expr("case when doc_id % 9 = 0 then 'none, -' else range_text end"))
    chosen = selection.expand_page_ranges(asked, t(s, d, "doc_manifest"))
    pages, empty = selection.extract_pages(t(s, d, "doc_pages"), chosen, asked)
    rows = pages.select(F.lit("page").alias("what"), "sel_id", "doc_id", "ordinal", "source_ordinal", "page_id", "rotation")
    return rows.unionByName(empty.select(F.lit("empty").alias("what"), "sel_id", "doc_id"), allowMissingColumns=True)


_ninth = _tok.replace("from selections join", "from (select sel_id, doc_id, case when doc_id % 9 = 0 then 'none, -' else range_text end as range_text from selections) join")
query("p6_extract_pages", f"""with {_ninth} select 'page' as what, sel_id, r.doc_id, r.ordinal, r.page as source_ordinal, p.page_id, p.rotation
    from rows_ r join doc_pages p on p.doc_id = r.doc_id and p.ordinal = r.page
 union all select 'empty', sel_id, doc_id, null, null, null, null from selections where sel_id not in (select sel_id from rows_)""")(_extract)
query("p7_search_corpus", "select doc_id, source, lang from documents where contains(lower(concat_ws(' ', source, lang, text)), 'tion of')")(
    lambda s, d: selection.search_corpus(t(s, d, "documents"), ["source", "lang", "text"], " Tion of ").select("doc_id", "source", "lang"))

_ASK = "case when item_id % 40 = 1 then substr(text, 1, 2) when item_id % 97 = 2 then '' else substr(text, cast(1 + item_id % 30 as int), cast(8 + item_id % 12 as int)) end"
query("p7_search_many", rf"""with q as (select item_id as query_id, regexp_replace(lower({_ASK}), '^\s+|\s+$', '', 'g') as asked from benchmark)
 select query_id, doc_id from documents join q on contains(lower(concat_ws(' ', source, lang, text)), asked)""")(
    lambda s, d: search.search_many(t(s, d, "documents"), ["source", "lang", "text"], t(s, d, "benchmark").selectExpr("item_id as query_id", f"{_ASK} as query")))



def _combine(s, d):
    """Documents of every seventh batch can't be read at all."""
    manifest = t(s, d, "doc_manifest").withColumn("readable", F.expr("readable and batch_id % 7 <> 0"))
    pages, skipped, failed = assembly.combine_documents(manifest, t(s, d, "doc_pages"))
    rows = pages.select(F.lit("page").alias("what"), "*").unionByName(skipped.select(F.lit("skipped").alias("what"), "batch_id", "doc_id"), allowMissingColumns=True)
    return rows.unionByName(failed.select(F.lit("failed").alias("what"), "batch_id"), allowMissingColumns=True)


query("a1_combine_documents", """with m as (select * replace (readable and batch_id % 7 <> 0 as readable) from doc_manifest)
 select 'page' as what, batch_id, row_number() over (partition by batch_id order by pos, ordinal) as page_no, doc_id, ordinal from m
    join doc_pages using (doc_id) where readable
 union all select 'skipped', batch_id, null, doc_id, null from m where not readable union all select 'failed', batch_id, null, null, null from m
    group by batch_id having count(*) filter (readable) = 0""")(_combine)
query("a2_merge_documents", f"""with b as (select batch_id, case when count(*) < 2 then 'too-few' when not bool_and(readable) then 'unreadable'
    when max(size_bytes) > {100 * MIB} then 'too-large' end as reason from doc_manifest group by 1)
  select batch_id, row_number() over (partition by batch_id order by pos, ordinal) as page_no, doc_id, ordinal, null as reason from doc_manifest
    join doc_pages using (doc_id) join b using (batch_id) where reason is null
  union all select batch_id, null, null, null, reason from b where reason is not null""")(
    lambda s, d: (lambda pages, failed: pages.unionByName(failed, allowMissingColumns=True))(*assembly.merge_documents(t(s, d, "doc_manifest"), t(s, d, "doc_pages"), 100 * MIB)))
query("a3_validate_page_edits", """with e as (select b.*, page_count, count(*) over (partition by b.doc_id, source_index) as times
    from bad_page_edits b join doc_manifest m on b.doc_id = m.doc_id)
  select distinct doc_id, source_index, 'out-of-range' as violation from e where source_index < 0 or source_index >= page_count union select doc_id,
    source_index, 'duplicate' from e where times > 1
  union select doc_id, source_index, 'rotation' from e where rotation % 90 <> 0 union select doc_id, null, 'empty' from doc_manifest
    where doc_id not in (select doc_id from bad_page_edits)""")(
    lambda s, d: assembly.validate_page_edits(t(s, d, "bad_page_edits"), t(s, d, "doc_manifest")))
query("a4_apply_page_edits", """select 'kept' as what, p.doc_id, e.position, p.page_id, (p.rotation + e.rotation) % 360 as rotation from doc_pages p
    join page_edits e on p.doc_id = e.doc_id and p.ordinal = e.source_index + 1
  union all select 'deleted', p.doc_id, p.ordinal, p.page_id, null from doc_pages p anti join page_edits e on p.doc_id = e.doc_id
    and p.ordinal = e.source_index + 1""")(
    lambda s, d: (lambda kept, gone: kept.select(F.lit("kept").alias("what"), "*").unionByName(gone.select(F.lit("deleted").alias("what"), "doc_id", F.col("ordinal").alias("position"), "page_id"), allowMissingColumns=True))(*assembly.apply_page_edits(t(s, d, "doc_pages"), t(s, d, "page_edits"))))
query("a5_sequence_changed", """select doc_id, bool_or(b.page_id is distinct from a.page_id) as changed from doc_pages b full join (select doc_id,
    position as ordinal, 'o' || source_index as page_id from page_edits) a using (doc_id, ordinal) group by doc_id""")(
    lambda s, d: assembly.sequence_changed(t(s, d, "doc_pages"), t(s, d, "page_edits").selectExpr("doc_id", "position as ordinal", "'o' || source_index as page_id")))
query("a6_place_imported_pages", """with st as (select doc_id, ordinal, page_id, case
    when ordinal % 3 = 0 then 'a' || (doc_id * 7 % 3000) end as asset, ordinal % 5 as asset_index from doc_pages),
  s as (select asset, 1 + p_size % 4 as n from (select 'a' || p_partkey as asset, p_size from part))
  select doc_id, row_number() over (partition by doc_id order by ordinal) as placed, page_id from st left join s using (asset) where asset is null
    or asset_index < coalesce(n, 0)""")(
    lambda s, d: assembly.place_imported_pages(t(s, d, "doc_pages").selectExpr("doc_id", "ordinal", "page_id", "case when ordinal % 3 = 0 then 'a' || (doc_id * 7 % 3000) end as asset", "ordinal % 5 as asset_index"), t(s, d, "part").selectExpr("'a' || p_partkey as asset", "1 + p_size % 4 as pages_in_asset")))
query("a7_unique_output_names", r"""with recursive names as (select batch_id, pos, coalesce(nullif(regexp_replace(file_name, '\.[^.]+$', ''), ''),
    file_name) as stem from doc_manifest),
 m as (select *, regexp_replace(lower(stem), '( \(\d+\))+$', '') as root, row_number() over (partition by batch_id, regexp_replace(lower(stem),
    '( \(\d+\))+$', '') order by pos) as i from names),
 run as (select distinct batch_id, root, 0::bigint as i, null::bigint as pos, null::varchar as out_name, []::varchar[] as taken from m
  union all select batch_id, root, i, pos, named, list_append(taken, lower(named)) from (select run.batch_id, run.root, m.i, m.pos, run.taken,
   case when not list_contains(run.taken, lower(stem || '.pdf')) then stem || '.pdf'
    else stem || ' (' || list_min(list_filter(range(2, len(run.taken) + 3), lambda n: not list_contains(run.taken,
    lower(stem || ' (' || n || ').pdf')))) || ').pdf' end as named
   from run join m on m.batch_id = run.batch_id and m.root = run.root and m.i = run.i + 1))
 select batch_id, pos, out_name from run where pos is not null""")(lambda s, d: naming.unique_output_names(t(s, d, "doc_manifest")))
query("a8_batch_budget_cut", f"""select batch_id, pos, processed, not bool_and(processed) over (partition by batch_id) as stopped_early
    from (select batch_id, pos, coalesce(sum(out_bytes) over (partition by batch_id order by pos rows between unbounded preceding and 1 preceding),
    0) <= {MAX_BATCH_OUTPUT_BYTES // 16} as processed from batch_items)""")(
    lambda s, d: assembly.batch_budget_cut(t(s, d, "batch_items"), MAX_BATCH_OUTPUT_BYTES // 16).select("batch_id", "pos", "processed", "stopped_early"))
