"""Input tables of the document operators, derived from the given tables by integer arithmetic on ids.

Each is one SELECT in Spark SQL; its counterpart for DuckDB is written apart (tables_duck.py). A name that another derivation uses is
resolved first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.plans.dialect import SPARK, Spark
from quirework.plans.tables_duck import TABLES
from quirework.sources.formats import EXTENSIONS

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations")


def doc_manifest(d: Spark) -> str:
    ext = d.pick([*EXTENSIONS, ".pdf", ".txt", ".PPTX"], "doc_id % 26")
    return f"""select doc_id, 'Doc ' || cast(doc_id % 40 as string) || case when doc_id % 11 = 0 then ' (2)' else '' end || {ext} as file_name,
      n_chars * 8192 as size_bytes, 1 + {d.div('n_chars', 500)} as page_count, {d.div('doc_id', 20)} as batch_id, doc_id % 20 as pos, doc_id % 17 <> 0 as readable from documents"""


def doc_pages(d: Spark) -> str:
    return f"""select doc_id, ordinal, 'o' || cast(ordinal - 1 as string) as page_id, cast((doc_id % 3) * 10 as double) as x, cast((ordinal % 2) * 20 as double) as y,
      cast(400 + 10 * (ordinal % 20) as double) as width, cast(500 as double) as height, cast(90 * ((doc_id + ordinal) % 4) as bigint) as rotation
      from doc_manifest {d.each('cast(1 as bigint)', 'page_count', 'ordinal')}"""


def selections(d: Spark) -> str:
    texts = d.pick(["1-3, 5", "3, 1", "5-2", "8-", "-3", "1, 1, 2", "1, banana, 99, -", "  1 , , 2 - 3  "], "doc_id % 8")
    return f"select doc_id as sel_id, doc_id, {texts} as range_text from doc_manifest"


def page_edits(d: Spark) -> str:
    return """select p.doc_id, row_number() over (partition by p.doc_id order by (p.ordinal * 7) % m.page_count, p.ordinal) as position,
      p.ordinal - 1 as source_index, 90 * (p.ordinal % 4) as rotation from doc_pages p join doc_manifest m on p.doc_id = m.doc_id where (p.doc_id + p.ordinal) % 4 <> 0"""


def bad_page_edits(d: Spark) -> str:
    return """select doc_id, source_index, rotation from page_edits union all
      select doc_id, min(source_index) as source_index, 0 as rotation from page_edits where doc_id % 10 = 0 group by doc_id union all
      select doc_id, -1 as source_index, 45 as rotation from page_edits where doc_id % 10 = 0 group by doc_id"""


def edit_log(d: Spark) -> str:
    return """select doc_id, seq, event_id, k, value, pc, kind,
      case when kind in ('move', 'rotate', 'crop', 'raster', 'draw', 'delete') then coalesce(case when k % 4 = 1 then known end,
    'o' || cast(k % pc as string)) end as page_id,
      case when kind in ('move', 'insert', 'insertImages') and k % 5 <> 0 then coalesce(case when k % 6 = 1 then known end,
    'o' || cast((k div 7) % pc as string)) end as before_id,
      case when kind = 'rotate' then 1 + k % 3 end as turns, case when kind = 'draw' then 'm' || cast(event_id as string)
    when kind = 'erase' then 'm' || cast(event_id - k as string) end as mark_id,
      case kind when 'setField' then 'f' || cast(k % 4 as string) when 'metadata' then element_at(array('title', 'author', 'language'),
    cast(k % 3 as int) + 1) end as field,
      case when kind = 'setField' or (kind = 'metadata' and k % 10 <> 0) then 'v' || cast(event_id as string) end as new_value,
      case when kind = 'insert' then 'a' || cast(k as string) end as asset, indices, assets, case when kind in ('crop', 'raster', 'watermark',
    'numbering', 'flattenForms') and k % 3 <> 0 then k end as payload
      from (select *, last_value(own, true) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding) as known
       from (select *, case when kind = 'insert'
    and size(indices) > 0 then 'i' || cast(seq as string) || ':a' || cast(k as string) || ':' || cast(indices[0] as string)
          when kind = 'insertImages' then 'g' || cast(seq * 1000 + 1 as string) || ':' || assets[1] end as own
        from (select *, case when kind = 'insert' then filter(array(k % 3, k % 4), i -> k % 7 <> 0) end as indices, case
    when kind = 'insertImages' then array('a' || cast(k as string), 'a' || cast(k + 1 as string)) end as assets
         from (select user_id as doc_id, seq, event_id, k, value, 5 + user_id % 8 as pc,
           case when event_type = 'view' and k % 11 = 3 then 'insert' when event_type = 'view' and k % 11 = 7 then 'insertImages'
    when event_type = 'view' then 'move'
             when event_type = 'click' and k % 8 = 0 then 'crop' when event_type = 'click' and k % 8 = 4 then 'raster'
    when event_type = 'click' then 'rotate' when event_type = 'purchase' then 'draw'
             when event_type = 'error' and k % 9 = 0 then 'delete' when event_type = 'error' then 'erase'
             when k % 5 = 0 then 'metadata' when k % 5 = 1 then element_at(array('watermark', 'numbering', 'flattenForms'), cast(k % 3 as int) + 1)
    else 'setField' end as kind
           from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, cast(get_json_object(props,
    '$.k') as bigint) as k from events)))))"""


def append_log(d: Spark) -> str:
    return f"select doc_id, seq as t, seq - 2 * {d.div('seq + 1', 4)} as cursor, event_id from edit_log"


def image_assets(d: Spark) -> str:
    return """select 'a' || cast(p_partkey as string) as asset, case when p_partkey % 2 = 0 then 'png' else 'jpg' end as declared_kind,
      case p_partkey % 3 when 0 then '89504E470D0A' when 1 then 'FFD8FFE00010' else '47494638' end as head_hex,
      cast(100 + p_size * 37 as double) as img_w, cast(100 + (p_partkey % 50) * 41 as double) as img_h from part"""


def sessions(d: Spark) -> str:
    return f"""select user_id as session_key, case when {d.prop('k')} % 5 = 0 then 1 else 2 end as shape, {d.ts('ts')} as saved_at, event_id,
    event_type <> 'error' as complete from events"""


def objects(d: Spark) -> str:
    return """select 'r' || cast(r_regionkey as string) as node from region union all select 'n' || cast(n_nationkey as string) from nation
      union all select 'c' || cast(c_custkey as string) from customer union all select 'o' || cast(o_orderkey as string) from orders
      union all select 'l' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) from lineitem"""


def object_edges(d: Spark) -> str:
    return """select 'r' || cast(n_regionkey as string) as src, 'n' || cast(n_nationkey as string) as dst from nation
      union all select 'n' || cast(c_nationkey as string), 'c' || cast(c_custkey as string) from customer
      union all select 'c' || cast(c_custkey as string), 'n' || cast(c_nationkey as string) from customer
      union all select 'c' || cast(o_custkey as string), 'o' || cast(o_orderkey as string) from orders
      union all select 'o' || cast(l_orderkey as string), 'l' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) from lineitem"""


def roots(d: Spark) -> str:
    return "select 'r' || cast(r_regionkey as string) as node from region where r_regionkey < 4"


def barriers(d: Spark) -> str:
    return "select 'n' || cast(n_nationkey as string) as node from nation where n_nationkey % 7 = 0"


def outline(d: Spark) -> str:
    return """select doc_id as node, case when 3 * doc_id + 1 < n then 3 * doc_id + 1 end as first_child, case when doc_id % 3 <> 0
    and doc_id + 1 < n then doc_id + 1 end as next_node,
      case doc_id % 5 when 0 then 'page' when 1 then 'name' when 2 then 'dict' when 3 then null else 'self' end as dest_kind,
      case when doc_id % 5 = 3 then doc_id end as action_dest from documents, (select count(*) as n from documents)"""


def fields(d: Spark) -> str:
    return f"""select cast(c_nationkey as bigint) as doc_id, 'f.' || cast(c_custkey as string) as field,
    {d.pick(['text', 'checkbox', 'dropdown', 'radio'], 'c_custkey % 4')} as type,
      c_mktsegment as value, 'o' || cast(c_custkey % 5 as string) as page_id, c_custkey % 9 <> 0 as drawn, c_custkey as id from customer"""


def wanted(d: Spark) -> str:
    return """select cast(c_nationkey as bigint) as doc_id, 'f.' || cast(c_custkey as string) as field, case when c_custkey % 6 = 0 then 'NOPE'
    else c_mktsegment end as wanted, c_custkey as id from customer"""


def produced(d: Spark) -> str:
    return "select doc_id, field, case when id % 10 = 0 then 'other' else value end as found, drawn from fields where id % 14 <> 0"


def ocr_flat(d: Spark) -> str:
    return f"""select conv_id as doc_id, turn + 1 as page_no, i as line_no, j as word_no,
      case when (conv_id + i + j) % 17 = 0 then '  ' else w end as raw_text, cast(20 + 60 * j as double) as x0, cast(30 + 20 * i as double) as y0,
      cast(case when (conv_id + j) % 13 = 0 then 10 + 60 * j else 70 + 60 * j end as double) as x1, cast(45 + 20 * i as double) as y1, cast(50 + j % 50 as double) as confidence
      from (select conv_id, turn, i, line from conversations {d.items(d.split('text', chr(92) + 'n'), 'line', 'i')}) {d.items(d.split('line', ' '), 'w', 'j')}"""


def text_pages(d: Spark) -> str:
    """Pages of 40 lines of a text, as lists of lines: the grain at which texts are dealt out, before they are words."""
    cut = f"transform(sequence(0, {d.div('size(whole) - 1', 40)}), p -> slice(whole, cast(40 * p + 1 as int), 40))"
    return f"""select doc_id, cast(p + 1 as bigint) as page_no, part_lines
      from (select doc_id, {d.split('text', chr(92) + 'n')} as whole from documents) {d.items(cut, 'part_lines', 'p')}"""


def text_items(d: Spark) -> str:
    """Words of a page's lines with their places, without a window: a word's offset in its line (at), less the blanks before it, is the length of all words before it."""
    line_words = lambda x: f"length({x}) - length(replace({x}, ' ', '')) + 1"
    starts = f"aggregate(part_lines, array(0), (a, x) -> array_append(a, element_at(a, -1) + {line_words('x')}))"
    blanks = "filter(transform(split(line, ''), (c, p) -> case when c = ' ' then p + 1 end), p -> p is not null)"
    sevenths = f"({d.div('i + j + 6', 7)} - {d.div('i + 6', 7)})"
    return f"""select doc_id, page_no, cast(started + j as int) as frag_no, word.str as str,
      case when j > 0 then cast(50 * (word.at - j) + 28 * j - 23 * {sevenths} as double) / 10D end as x0,
      cast(800 - 12 * k - 20 * {d.div('k', 4)} as double) as y, cast(5 * length(word.str) as double) as width, cast(10 as double) as height,
    (j = n - 1 and i % 3 <> 0) as has_eol
      from (select doc_id, page_no, k, 40 * (page_no - 1) + k as i, placed.started as started, placed.line as line, {line_words('placed.line')} as n
    from (select doc_id, page_no, zip_with(part_lines, slice({starts}, 1, size(part_lines)), (x, a) -> struct(x as line, a as started)) as placed_lines from text_pages)
      {d.items('placed_lines', 'placed', 'k')}) {d.items(f"zip_with({d.split('line', ' ')}, concat(array(0), {blanks}), (x, a) -> struct(x as str, a as at))", 'word', 'j')}"""


def glyph_widths(d: Spark) -> str:
    return f"select chr(cast(code as int)) as ch, cast(300 + (code % 20) * 20 as double) as w from (select 1 as one) {d.each('32', '126', 'code')}"


def structure_facts(d: Spark) -> str:
    n = lambda s: f"{d.div(f'length(html) - length(replace(html, {s!r}, {chr(39) * 2}))', len(s))}"
    return f"""select page_id as doc_id, {n('<h1')} as bookmarks, {n('<li>')} as attachments, case when html like '%<nav%' then 1
    else 0 end as page_labels,
      case when html like '%class="ad"%' then 1 else 0 end as layers, case when html like '%<article%' then 1 else 0 end as accessibility,
      case when html like '%<title>%' then 1 else 0 end as metadata_title, case when html like '%lang=%' then 1 else 0 end as language,
    page_id % 3 as form, 1 + page_id % 7 as page_count from pages"""


def batch_items(d: Spark) -> str:
    return f"""select batch_id, pos, file_name, page_count, case when doc_id % 13 = 0 then 'failed' else 'ok' end as status, doc_id % 26 = 0 as timed_out,
      case when doc_id % 13 = 0 then 0 else {d.div('size_bytes', 4)} end as out_bytes from doc_manifest"""


def error_log(d: Spark) -> str:
    names = d.pick(["PasswordException", "file is encrypted", "No PDF header", "failed to parse", "network error", "out of memory", "boom", ""], f"{d.prop('k')} % 8")
    return f"""select event_id, cast(ts as date) as day, {names} as message, case when event_id % 11 = 0 then 'cancelled'
    when event_id % 13 = 0 then 'unsupported-image' when event_id % 17 = 0 then 'encrypted' end as known from events where event_type = 'error'"""


def outputs(d: Spark) -> str:
    return "select doc_id, source, n_chars * 100 as in_bytes, n_chars * (50 + doc_id % 100) as out_bytes from documents"


def redactions(d: Spark) -> str:
    return """select doc_id, page_no, coalesce(x0, 0.0) - 2 as x, y - 2 as y, width + 4 as width, height + 4 as height from text_items
    where doc_id % 2 = 0 and (str like '%@%' or frag_no % 97 = 0)"""


def strokes(d: Spark) -> str:
    return f"select event_id as id, cast({d.prop('k')} as double) as x1, cast({d.prop('k')} % 10 as double) as y1, value as x2, value / 2 as y2 from events"


DERIVED: dict[str, Callable[[Spark], str]] = {f.__name__: f for f in (doc_manifest, doc_pages, selections, page_edits, bad_page_edits, edit_log, append_log, image_assets, sessions, objects, object_edges, roots, barriers, outline, fields, wanted, produced, ocr_flat, text_pages, text_items, glyph_widths, structure_facts, batch_items, error_log, outputs, redactions, strokes)}


def _names(sql: str, among) -> list[str]:
    return [n for n in among if re.search(rf"\b(?:from|join|,)\s+{n}\b", sql)]


def derive(spark: SparkSession, sf_dir: str, name: str, **known: DataFrame) -> DataFrame:
    """A given or derived table as a DataFrame; tables that are known already are not derived again."""
    if name in known:
        return known[name]
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    sql = DERIVED[name](SPARK)
    frames = {n: derive(spark, sf_dir, n, **known) for n in _names(sql, [*DERIVED, *GIVEN]) if n != name}
    for n in frames:
        sql = re.sub(rf"\b(from|join|,)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **frames)


def with_tables(sql: str) -> str:
    """DuckDB SQL with the derived tables that it names put in front as common table expressions; sql may start with its own."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _names(text, TABLES):
            if n not in order:
                need(TABLES[n])
                order.append(n)

    need(sql)
    ctes = ",\n".join(f"{n} as ({TABLES[n]})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    recursive = " recursive" if body.lower().startswith("with recursive") else ""
    if body.lower().startswith("with"):
        return f"with{recursive} {ctes},\n{re.sub(r'(?i)^with( recursive)?', '', body, count=1)}"
    return f"with {ctes}\n{body}"
