"""Registered queries of structure audit and forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.operators import forms, structure as st
from quirework.plans.fixtures import derive as t
from quirework.plans.registry import query

reach = lambda s, d: st.reachable_objects(t(s, d, "object_edges"), t(s, d, "roots"), t(s, d, "barriers"))
_REACH = """with recursive seen as (select node from roots where node not in (select node from barriers)
 union select dst from seen join object_edges on src = node where dst not in (select node from barriers))"""
query("d1_reachable_objects", f"{_REACH} select node from seen")(reach)
query("d2_unreachable_objects", f"{_REACH} select substr(node, 1, 1) as kind, count(*) as n from objects where node not in (select node from seen) group by 1")(
    lambda s, d: st.unreachable_objects(t(s, d, "objects"), reach(s, d)).groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n")))

# A forest from the documents: node n is a kid of (n - 1) div 3 unless n is divisible by 40, which makes it a top.
docs = lambda s, d: t(s, d, "documents").select(F.col("doc_id").alias("n"))
tops = lambda s, d: docs(s, d).where("n % 40 = 0").selectExpr("n as node")
kids = lambda s, d: docs(s, d).where("n % 40 <> 0").selectExpr("(n - 1) div 3 as node", "(n - 1) % 3 as pos", "n as kid")
_TREE = """tops as (select doc_id as node from documents where doc_id % 40 = 0), kids as (select (doc_id - 1) // 3 as node, (doc_id - 1) % 3 as pos,
    doc_id as kid from documents where doc_id % 40 <> 0)"""
_WALK = f"""with recursive {_TREE}, walk as (select node as top, node, []::bigint[] as path, 0 as depth from tops union all select top, kid,
    list_append(path, pos), depth + 1 from walk join kids using (node) where depth < 16)"""
query("d3_live_fields", f"{_WALK} select distinct top from walk where node % 2 = 0 and node % 7 <> 0 and node % 3 = 1")(
    lambda s, d: st.live_fields(tops(s, d), kids(s, d), docs(s, d).where("n % 2 = 0 and n % 7 <> 0 and n % 3 = 1").selectExpr("n as node")))
_names = lambda s, d: docs(s, d).where("n % 3 = 2 or n % 50 = 0").select(F.col("n").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pos")).selectExpr("node", "pos", "'k' || ((node * (1 + 6 * pos)) % 97) as key", "'v' || node || '.' || pos as value")
query("d4_name_tree_entries", f"""{_WALK}, names as (select doc_id as node, pos, 'k' || ((doc_id * (1 + 6 * pos)) % 97) as key,
    'v' || doc_id || '.' || pos as value from documents, (values (0::bigint), (1)) as p(pos) where doc_id % 3 = 2 or doc_id % 50 = 0),
 e as (select top, key, value, row_number() over (partition by top, key order by path desc, pos desc) as r from walk join names using (node)),
    leg as (select node as top, 'k' || (node % 97) as key, 'old' as value from tops where node % 80 = 0)
 select top, key, coalesce(leg.value, t.value) as value from (select top, key, value from e where r = 1) t full join leg using (top, key)""")(
    lambda s, d: st.name_tree_entries(tops(s, d), kids(s, d), _names(s, d), tops(s, d).where("node % 80 = 0").selectExpr("node as top", "'k' || (node % 97) as key", "'old' as value")))
query("d7_attachment_counts", f"""with recursive {_TREE}, sizes as (select doc_id as node, 3 + doc_id % 4 as n from documents where doc_id % 3 = 2
    or doc_id % 50 = 0),
 walk as (select node as top, node, 0 as depth from tops union all select top, kid, depth + 1 from walk join kids using (node) where depth < 8
    and node not in (select node from sizes))
 select top, sum(coalesce(n, 0) // 2)::bigint as attachments from walk left join sizes using (node) group by top""")(
    lambda s, d: st.attachment_counts(tops(s, d), kids(s, d), docs(s, d).where("n % 3 = 2 or n % 50 = 0").selectExpr("n as node", "3 + n % 4 as n")))

# Destinations: arrays; names over a chain of 0 to 10 further names; wrapped arrays; none, with an action; names of themselves.
_OBJ = """select 'd' || n as obj, case n % 5 when 0 then 'array' when 2 then 'dict' else 'name' end as kind, case n % 5 when 0 then 'p' || n
    when 1 then 'c' || n || '.' || (n % 11) when 2 then 'c' || n || '.0' else 'd' || n end as ref from {docs} where n % 5 <> 3
 union all select 'a' || n, 'array', 'p' || n from {docs} where n % 5 = 3 union all select 'c' || n || '.0', 'array', 'p' || n from {docs}
    where n % 5 in (1, 2)
 union all select 'c' || n || '.' || k, 'name', 'c' || n || '.' || (k - 1) from {docs} cross join {ks} where n % 5 = 1 and k <= n % 11"""
objects = lambda s, d: s.sql(_OBJ.replace("{ks}", "(select explode(sequence(1, 10)) as k)"), docs=docs(s, d))
dests = lambda s, d: docs(s, d).selectExpr("explode(array('d' || n, 'a' || n)) as obj").selectExpr("obj as dest", "obj")
_DEST = "ns as (select doc_id as n from documents), objs as (" + _OBJ.replace("{docs}", "ns").replace("{ks}", "(select unnest(range(1, 11)) as k)") + """),
 hop as (select obj as dest, obj as spot, 0 as h, null::varchar as page from (select 'd' || n as obj from ns union all select 'a' || n from ns)
  union all select dest, case when kind <> 'array' then ref end, h + 1, case when kind = 'array' then ref end from hop join objs on spot = obj where h <= 8),
 res as (select dest, max(page) as page from hop group by dest)"""
resolved = lambda s, d: st.resolve_destinations(dests(s, d), objects(s, d))
query("d5_resolve_destinations", f"with recursive {_DEST} select * from res")(resolved)
query("d6_live_bookmarks", f"""with recursive {_DEST}, lk as (select node as src, first_child as dst from outline where first_child is not null
    union all select node, next_node from outline where next_node is not null),
 seen as (select 0::bigint as node union select dst from seen join lk on src = node)
 select node, coalesce(a.page, b.page) as page from seen left join res a on a.dest = 'd' || node left join res b on b.dest = 'a' || node
    where cast(substr(coalesce(a.page, b.page), 2) as bigint) % 4 <> 0""")(
    lambda s, d: st.live_bookmarks(
        t(s, d, "outline").selectExpr("node", "'d' || node as dest", "'a' || node as action_dest"),
        t(s, d, "outline").select("node", "first_child", "next_node"),
        docs(s, d).where("n = 0").selectExpr("n as node"), resolved(s, d), docs(s, d).where("n % 4 <> 0").selectExpr("'p' || n as page")))

before = lambda s, d: st.structure_summary(t(s, d, "structure_facts").selectExpr("doc_id", "case when doc_id % 11 <> 0 then page_count end as page_count"), t(s, d, "structure_facts").unpivot(["doc_id"], list(st.CATEGORIES), "category", "n"))
_AFTER = """case when doc_id % 2 = 0 then greatest(bookmarks - 1, 0) else bookmarks end as bookmarks, case when doc_id % 5 = 0 then 0
    else form end as form, case when doc_id % 7 = 0 then 0 else page_labels end as page_labels, attachments, layers, accessibility, metadata_title,
    language"""
after = lambda s, d: before(s, d).selectExpr("doc_id", "case when doc_id % 2 = 0 then greatest(bookmarks - 1, 0) else bookmarks end as bookmarks", "case when doc_id % 5 = 0 then 0 else form end as form", "case when doc_id % 7 = 0 then 0 else page_labels end as page_labels", "attachments", "layers", "accessibility", "metadata_title", "language")
_cols = ", ".join(st.CATEGORIES)
_LONG = f"""bf as (select doc_id, {_cols} from structure_facts), af as (select doc_id, {_AFTER} from structure_facts),
 bl as (unpivot bf on {_cols} into name category value n), al as (unpivot af on {_cols} into name category value n),
 df as (select bl.doc_id, bl.category, bl.n as before, al.n as after from bl join al using (doc_id, category) where bl.n > 0 and al.n < bl.n)"""
query("d8_structure_summary", f"select doc_id, case when doc_id % 11 > 0 then page_count else 0 end as page_count, {_cols} from structure_facts")(before)
query("d9_structure_diff", f"with {_LONG} select * from df")(lambda s, d: st.structure_diff(before(s, d), after(s, d)))
_ver = ", ".join(f"'{c}'" for c in st.VERIFIABLE)
query("d10_structure_report", f"""with {_LONG}, p as (select doc_id, string_agg(category, ',' order by category) as present from bl where n > 0
    and category in ({_ver}) group by 1),
 l as (select doc_id, string_agg(category || ':' || before || '>' || after, ',' order by category) as losses from df group by 1) select doc_id,
    coalesce(present, '') as present, coalesce(losses, '') as losses from bf left join p using (doc_id) left join l using (doc_id)""")(
    lambda s, d: st.structure_report(before(s, d), after(s, d)))
_sum = lambda df, s: df.groupBy(F.floor(F.col("doc_id") / 5).alias("batch_id")).agg(*(F.sum(c).alias(c) for c in st.CATEGORIES))
query("d11_merge_structure_losses", f"""with {_LONG} select doc_id // 5 as batch_id, category, sum(bl.n)::bigint as before, sum(al.n)::bigint as after
    from bl join al using (doc_id, category) group by all having sum(bl.n) > 0 and sum(al.n) < sum(bl.n)""")(
    lambda s, d: st.merge_structure_losses(before(s, d).withColumn("batch_id", F.floor(F.col("doc_id") / 5)), _sum(after(s, d), s)))
_imp = ", ".join(f"'{c}'" for c in st.VERIFIABLE if c not in st.DOCUMENT_LEVEL)
query("d12_import_losses", f"with {_LONG} select doc_id, category, n from bl where n > 0 and category in ({_imp})")(lambda s, d: st.import_losses(before(s, d)))

annots = lambda s, d: t(s, d, "fields").selectExpr("doc_id", "page_id", "id", "case when id % 3 = 0 then 'Link' else 'Widget' end as subtype")
query("d13_orphan_widgets", "select id, not (page_id in ('o1', 'o3') and doc_id % 2 = 0 and id % 3 <> 0) as kept from fields")(
    lambda s, d: (lambda kept, gone: kept.select("id", F.lit(True).alias("kept")).unionByName(gone.select("id", F.lit(False).alias("kept"))))(
        *st.orphan_widgets(annots(s, d), t(s, d, "fields").where("page_id in ('o1', 'o3') and doc_id % 2 = 0").select("doc_id", "page_id"))))
_wid = lambda s, d: t(s, d, "fields").selectExpr("field", "explode(array(2 * id, 2 * id + 1)) as widget")
query("d14_strip_redacted_fields", """select field, case when bool_and(w % 3 = 0 or w % 5 = 0) then 'remove' when bool_or(w % 3 = 0
    or w % 5 = 0) then 'lose-widgets' else 'keep' end as action from (select field, unnest([2 * id, 2 * id + 1]) as w from fields) group by 1""")(
    lambda s, d: st.strip_redacted_fields(_wid(s, d), _wid(s, d).where("widget % 3 = 0 or widget % 5 = 0").select("widget")))

_OPTIONS = "array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"
query("f1_field_inventory", """select doc_id, type, count(*) as fields, count(*) filter (coalesce(value, '') <> '') as filled from fields group by all""")(lambda s, d: forms.field_inventory(t(s, d, "fields")))
query("f2_fill_fields", """with j as (select w.doc_id, w.field, w.wanted, f.type from wanted w left join (select * from fields
    where id % 14 <> 0) f using (doc_id, field)),
 k as (select *, type is not null and (type not in ('dropdown', 'radio') or wanted = '' or wanted in ('AUTOMOBILE', 'BUILDING', 'FURNITURE',
    'HOUSEHOLD', 'MACHINERY')) as filled from j)
 select doc_id, field, filled, case when not filled then trim(regexp_replace(regexp_replace(field, '[<>]', '', 'g'), '[_.]', ' ',
    'g')) end as skipped_label from k""")(
    lambda s, d: forms.fill_fields(t(s, d, "fields").where("id % 14 <> 0").withColumn("options", F.expr(_OPTIONS)), t(s, d, "wanted")))
query("f3_verify_fields", """select * from (select w.doc_id, w.field, case when p.field is null then 'missing' when p.found is distinct
    from w.wanted then 'mismatch' when not p.drawn then 'not-drawn' end as problem from wanted w left join produced p on w.doc_id = p.doc_id
    and w.field = p.field) where problem is not null""")(
    lambda s, d: forms.verify_fields(t(s, d, "wanted").select("doc_id", "field", "wanted"), t(s, d, "produced")))
