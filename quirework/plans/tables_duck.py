"""Input tables of the document queries for DuckDB, written apart from those for Spark (fixtures.py), after FIXTURES.md.

An error in one of the two derivations shows as a difference between a query's rows and its SQL's.
"""

from __future__ import annotations

from quirework.sources.formats import EXTENSIONS

_SUFFIXES = ", ".join(f"'{e}'" for e in (*EXTENSIONS, ".pdf", ".txt", ".PPTX"))

TABLES: dict[str, str] = {
    "doc_manifest": f"""select doc_id, concat('Doc ', doc_id % 40, if(doc_id % 11 = 0, ' (2)', ''), list_extract([{_SUFFIXES}], (doc_id % 26 + 1)::int)) as file_name,
      8192 * n_chars as size_bytes, (n_chars - n_chars % 500) // 500 + 1 as page_count, doc_id // 20 as batch_id, doc_id - 20 * (doc_id // 20) as pos, (doc_id % 17 > 0) as readable from documents""",
    "doc_pages": """select doc_id, o as ordinal, format('o{}', o - 1) as page_id, 10.0::double * (doc_id % 3) as x, if(o % 2 = 1, 20.0, 0.0)::double as y,
      (400 + (o % 20) * 10)::double as width, 500.0::double as height, ((doc_id + o) % 4) * 90 as rotation from (select doc_id, unnest(generate_series(1, page_count)) as o from doc_manifest)""",
    "selections": """select doc_id as sel_id, doc_id, case doc_id % 8 when 0 then '1-3, 5' when 1 then '3, 1' when 2 then '5-2' when 3 then '8-' when 4 then '-3' when 5 then '1, 1, 2'
      when 6 then '1, banana, 99, -' else '  1 , , 2 - 3  ' end as range_text from doc_manifest""",
    "page_edits": """select doc_id, row_number() over (partition by doc_id order by mixed, ordinal) as position, ordinal - 1 as source_index, (ordinal % 4) * 90 as rotation
      from (select p.doc_id, p.ordinal, (7 * p.ordinal) % (select max(q.ordinal) from doc_pages q where q.doc_id = p.doc_id) as mixed from doc_pages p) where (doc_id + ordinal) % 4 in (1, 2, 3)""",
    "bad_page_edits": """select doc_id, source_index, rotation from page_edits union all (with worst as (select doc_id, min(source_index) as low from page_edits group by doc_id having doc_id % 10 = 0)
      select doc_id, low, 0 from worst union all select doc_id, -1, 45 from worst)""",
    "append_log": "select doc_id, seq as t, seq - ((seq + 1) // 4) * 2 as cursor, event_id from edit_log",
    "image_assets": """select concat('a', p_partkey) as asset, if(p_partkey % 2 = 1, 'jpg', 'png') as declared_kind, (['89504E470D0A', 'FFD8FFE00010', '47494638'])[p_partkey % 3 + 1] as head_hex,
      (37 * p_size + 100)::double as img_w, (41 * (p_partkey % 50) + 100)::double as img_h from part""",
    "sessions": "select user_id as session_key, if((props ->> 'k')::bigint % 5 = 0, 1, 2) as shape, ts as saved_at, event_id, not event_type = 'error' as complete from events",
    "objects": """select unnest(list_concat((select list(concat('r', r_regionkey)) from region), (select list(concat('n', n_nationkey)) from nation), (select list(concat('c', c_custkey)) from customer),
      (select list(concat('o', o_orderkey)) from orders), (select list(concat('l', l_orderkey, '-', l_linenumber)) from lineitem))) as node""",
    "object_edges": """select concat('r', n_regionkey) as src, concat('n', n_nationkey) as dst from nation union all
      select if(back, c, n), if(back, n, c) from (select concat('n', c_nationkey) as n, concat('c', c_custkey) as c, unnest([true, false]) as back from customer) union all
      select concat('c', o_custkey), concat('o', o_orderkey) from orders union all select concat('o', l_orderkey), concat('l', l_orderkey, '-', l_linenumber) from lineitem""",
    "roots": "select concat('r', r_regionkey) as node from region where r_regionkey in (0, 1, 2, 3)",
    "barriers": "select concat('n', n_nationkey) as node from nation where n_nationkey in (0, 7, 14, 21)",
    "outline": """select d.doc_id as node, nullif(least(3 * d.doc_id + 1, n), n) as first_child, if(d.doc_id % 3 > 0, nullif(least(d.doc_id + 1, n), n), null) as next_node,
      (['page', 'name', 'dict', null, 'self'])[d.doc_id % 5 + 1] as dest_kind, if(d.doc_id % 5 = 3, d.doc_id, null) as action_dest from documents d, (select count(doc_id) as n from documents)""",
    "fields": """select c_nationkey::bigint as doc_id, concat('f.', c_custkey) as field, (['text', 'checkbox', 'dropdown', 'radio'])[c_custkey % 4 + 1] as type, c_mktsegment as value,
      concat('o', c_custkey % 5) as page_id, (c_custkey % 9 > 0) as drawn, c_custkey as id from customer""",
    "wanted": "select c_nationkey::bigint as doc_id, concat('f.', c_custkey) as field, if(c_custkey % 6 > 0, c_mktsegment, 'NOPE') as wanted, c_custkey as id from customer",
    "produced": "select doc_id, field, if(id % 10 > 0, value, 'other') as found, drawn from fields where not id % 14 = 0",
    "ocr_flat": """select doc_id, page_no, line_no, word_no, if((doc_id + line_no + word_no) % 17 = 0, '  ', words[word_no + 1]) as raw_text, 60.0::double * word_no + 20 as x0, 20.0::double * line_no + 30 as y0,
      60.0::double * word_no + if((doc_id + word_no) % 13 = 0, 10, 70) as x1, 20.0::double * line_no + 45 as y1, 50.0::double + word_no % 50 as confidence
      from (select *, unnest(range(len(words))) as word_no from (select doc_id, page_no, line_no, string_split(lines[line_no + 1], ' ') as words
        from (select conv_id as doc_id, turn + 1 as page_no, string_split(text, chr(10)) as lines, unnest(range(len(string_split(text, chr(10))))) as line_no from conversations)))""",
    "text_items": """select doc_id, line_no // 40 + 1 as page_no, row_number() over (partition by doc_id, line_no // 40 order by line_no, word_no) - 1 as frag_no, words[word_no + 1] as str,
      ((sum(length(words[word_no + 1]) * 50 + if((line_no + word_no) % 7 > 0, 28, 5)) over (partition by doc_id, line_no order by word_no) - (length(words[word_no + 1]) * 50 + if((line_no + word_no) % 7 > 0, 28, 5)))
        * if(word_no > 0, 1, null))::double / 10.0::double as x0,
      (800 - 12 * (line_no % 40) - 20 * ((line_no % 40) // 4))::double as y, 5.0::double * length(words[word_no + 1]) as width, 10.0::double as height, (word_no + 1 = len(words) and line_no % 3 in (1, 2)) as has_eol
      from (select *, unnest(range(len(words))) as word_no from (select doc_id, line_no, string_split(lines[line_no + 1], ' ') as words
        from (select doc_id, string_split(text, chr(10)) as lines, unnest(range(len(string_split(text, chr(10))))) as line_no from documents)))""",
    "glyph_widths": "select chr(code::int) as ch, (300 + 20 * (code % 20))::double as w from range(32, 127) as r(code)",
    "structure_facts": """select page_id as doc_id, len(string_split(html, '<h1')) - 1 as bookmarks, len(string_split(html, '<li>')) - 1 as attachments, contains(html, '<nav')::int as page_labels,
      contains(html, 'class="ad"')::int as layers, contains(html, '<article')::int as accessibility, contains(html, '<title>')::int as metadata_title, contains(html, 'lang=')::int as language,
      page_id % 3 as form, page_id % 7 + 1 as page_count from pages""",
    "batch_items": """select batch_id, pos, file_name, page_count, if(doc_id % 13 > 0, 'ok', 'failed') as status, (doc_id % 26 = 0) as timed_out, if(doc_id % 13 > 0, size_bytes // 4, 0) as out_bytes from doc_manifest""",
    "error_log": """select event_id, ts::date as day, (['PasswordException', 'file is encrypted', 'No PDF header', 'failed to parse', 'network error', 'out of memory', 'boom', ''])[(props ->> 'k')::bigint % 8 + 1] as message,
      if(event_id % 11 = 0, 'cancelled', if(event_id % 13 = 0, 'unsupported-image', if(event_id % 17 = 0, 'encrypted', null))) as known from events where event_type = 'error'""",
    "outputs": "select doc_id, source, 100 * n_chars as in_bytes, (doc_id % 100 + 50) * n_chars as out_bytes from documents",
    "redactions": """select doc_id, page_no, if(x0 is null, 0.0, x0) - 2.0 as x, y - 2.0 as y, width + 4.0 as width, height + 4.0 as height from text_items
      where doc_id % 2 = 0 and (contains(str, '@') or frag_no % 97 = 0)""",
    "strokes": "select event_id as id, (props ->> 'k')::double as x1, ((props ->> 'k')::bigint % 10)::double as y1, value as x2, 0.5::double * value as y2 from events",
    # the edit log: events with their place, kind and what they bring in, then the ids that they name
    "numbered": """select r.*, case when kind <> 'insert' then null when k % 7 = 0 then []::bigint[] else [k % 3, k % 4] end as indices,
    if(kind = 'insertImages', [concat('a', k), concat('a', k + 1)], null) as assets
      from (select q.*, case event_type when 'purchase' then 'draw' when 'view' then case k % 11 when 3 then 'insert' when 7 then 'insertImages'
    else 'move' end
          when 'click' then case k % 8 when 0 then 'crop' when 4 then 'raster' else 'rotate' end when 'error' then if(k % 9 = 0, 'delete', 'erase')
          else case k % 5 when 0 then 'metadata' when 1 then (['watermark', 'numbering', 'flattenForms'])[k % 3 + 1] else 'setField' end end as kind
        from (select user_id as doc_id, event_id, event_type, value, 5 + user_id % 8 as pc, cast(props ->> 'k' as bigint) as k,
    count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as seq from events) q) r""",
    "edit_log": """select e.doc_id, e.seq, e.event_id, e.k, e.value, e.pc, e.kind,
      case when list_contains(['move', 'rotate', 'crop', 'raster', 'draw', 'delete'], e.kind) then if(e.k % 4 = 1 and e.last_own is not null,
    e.last_own, concat('o', e.k % e.pc)) end as page_id,
      if(e.kind in ('move', 'insert', 'insertImages') and e.k % 5 > 0, if(e.k % 6 = 1 and e.last_own is not null, e.last_own, concat('o',
    (e.k // 7) % e.pc)), null) as before_id,
      if(e.kind = 'rotate', e.k % 3 + 1, null) as turns, if(e.kind = 'draw', concat('m', e.event_id), if(e.kind = 'erase', concat('m',
    e.event_id - e.k), null)) as mark_id,
      if(e.kind = 'setField', concat('f', e.k % 4), if(e.kind = 'metadata', (['title', 'author', 'language'])[e.k % 3 + 1], null)) as field,
      if(e.kind = 'setField' or (e.kind = 'metadata' and e.k % 10 > 0), concat('v', e.event_id), null) as new_value,
      if(e.kind = 'insert', concat('a', e.k), null) as asset, e.indices, e.assets, if(e.kind in ('crop', 'raster', 'watermark', 'numbering',
    'flattenForms') and e.k % 3 > 0, e.k, null) as payload
      from (select n.*, (select max_by(coalesce(format('i{}:a{}:{}', o.seq, o.k, o.indices[1]), format('g{}:{}', 1000 * o.seq + 1, o.assets[2])),
    o.seq) from numbered o
         where o.doc_id = n.doc_id and o.seq < n.seq and (len(o.indices) > 0 or len(o.assets) > 0)) as last_own from numbered n) e""",
}
