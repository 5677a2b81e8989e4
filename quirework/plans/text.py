"""Registered queries of text reconstruction and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.durable import durable
from quirework.operators import redaction, text
from quirework.plans.fixtures import derive as t
from quirework.plans.registry import query
from quirework.sources.formats import WIN_ANSI


def raw_items(s, d, **known):
    """Items as an extractor writes them: a matrix, a height that may be missing, markers without text."""
    return t(s, d, "text_items", **known).selectExpr("doc_id", "page_no", "frag_no", "str", """array(10D, 0D, 0D, case when frag_no % 7 = 0 then 10D
    else height end, coalesce(x0, 0D), y) as transform""", "width", "case when frag_no % 7 = 0 then 0D else height end as height", "has_eol")


#: Bytes of text in a part: the words of a part, with their places, are sorted without going to disk.
PART_BYTES = 4 << 20


def by_page(s, d, df):
    """Rows dealt out by document and page, to as many parts whatever the table: what is dealt so meets without being moved."""
    parts = max(int(s.conf.get("spark.sql.shuffle.partitions")), -(-(t(s, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    return df.repartition(parts, "doc_id", "page_no")


def dealt_pages(s, d, among=None):
    """Pages dealt out by document and page, before they are words. What the operators then do within a page moves no word.

    among: only pages in this table of doc_id and page_no, however often they are there; their numbers go to the pages, and no text goes twice.
    """
    dealt = by_page(s, d, t(s, d, "text_pages"))
    return dealt if among is None else dealt.join(by_page(s, d, among.select("doc_id", "page_no")).distinct().hint("shuffle_hash"), ["doc_id", "page_no"])


fragments = lambda s, d: text.text_fragments(raw_items(s, d))
lines = lambda s, d: text.group_lines(text.text_fragments(raw_items(s, d, text_pages=dealt_pages(s, d))))
texts = lambda s, d: text.line_texts(lines(s, d))
paras = lambda s, d: text.paragraphs(texts(s, d))

_frag = "frag as (select doc_id, page_no, frag_no, str, coalesce(x0, 0.0) as x, y, width, height, has_eol from text_items)"
_lines = f"""{_frag}, brk as (select *, coalesce(lag(has_eol) over w or abs(y - lag(y) over w) > greatest(height, lag(height) over w) * 0.5,
    false) as b from frag window w as (partition by doc_id, page_no order by frag_no)),
 lines as (select *, sum(b::int) over (partition by doc_id, page_no order by frag_no) as line_no from brk)"""
_texts = f"""{_lines}, pre as (select *, case when lag(str) over w is not null and not (regexp_matches(lag(str) over w, '\\s$') or regexp_matches(str,
    '^\\s')) and x - (lag(x) over w + lag(width) over w) > greatest(height, lag(height) over w) * 0.24 then ' ' || str else str end as piece
  from lines window w as (partition by doc_id, page_no, line_no order by frag_no)),
 texts as (select doc_id, page_no, line_no, string_agg(piece, '' order by frag_no) as text, arg_min(y, frag_no) as y from pre group by all)"""
_typ = f"""{_texts}, gaps as (select *, lag(y) over w - y as gap, lag(text) over w as prev from texts
    where trim(text) <> '' window w as (partition by doc_id, page_no order by line_no)),
 typ as (select doc_id, page_no, coalesce(quantile_disc(gap, 0.5) filter (gap > 0), 0) as typical from gaps group by all)"""
_paras = f"""{_typ}, opn as (select gaps.*, coalesce(gap < 0 or (typical > 0 and gap > typical * 1.5), true) as o from gaps join typ using (doc_id,
    page_no)),
 num as (select *, sum(o::int) over w - 1 as para_no, not o and regexp_matches(coalesce(prev, ''), '[-‐‑]$') and regexp_matches(text,
    '^[a-zß-ÿ]') as rj from opn window w as (partition by doc_id, page_no order by line_no)),
 ld as (select *, coalesce(lead(rj) over (partition by doc_id, page_no order by line_no), false) as cut from num),
 pc as (select *, case when cut then text[:-2] else text end as body from ld),
 paras as (select doc_id, page_no, para_no, trim(string_agg(case when o or rj then body else ' ' || body end, '' order by line_no)) as text from pc
    group by all having trim(string_agg(body, '')) <> '')"""

query("t5_text_fragments", f"with {_frag} select * from frag")(fragments)
query("t6_group_lines", f"with {_lines} select doc_id, page_no, line_no, count(*) as n, min(frag_no) as first_frag from lines group by all")(
    lambda s, d: lines(s, d).groupBy("doc_id", "page_no", "line_no").agg(F.count("*").alias("n"), F.min("frag_no").alias("first_frag")))
query("t7_line_texts", f"with {_texts} select * from texts")(texts)
query("t8_typical_line_gap", f"with {_typ} select * from typ")(lambda s, d: text.typical_line_gap(texts(s, d)))
query("t9_paragraphs", f"with {_paras} select * from paras")(paras)
query("t10_document_text", f"""with {_paras}, pg as (select doc_id, page_no, string_agg(text, chr(10) order by para_no) as page from paras
    group by all),
 dt as (select doc_id, string_agg(page, chr(10) || chr(10) order by page_no) as text from pg group by all) select doc_id, coalesce(text, '') as text,
    text is not null as has_text from doc_manifest left join dt using (doc_id)""".replace("left join dt", "left join dt"))(
    lambda s, d: text.document_text(paras(s, d), t(s, d, "doc_manifest")))
query("t11_has_real_text", f"""with {_frag}, c as (select doc_id, sum(length(trim(str))) as chars from frag join doc_manifest using (doc_id)
    where page_no <= least(3, page_count) group by 1)
 select doc_id, coalesce(chars, 0) / greatest(least(3, page_count), 1) > 200 as has_real_text from doc_manifest left join c using (doc_id)""")(
    lambda s, d: text.has_real_text(fragments(s, d), t(s, d, "doc_manifest")))
query("t4_encodability_audit", f"""with f as (select source, regexp_replace(text, '[\\r\\n\\t]', '', 'g') as flat from documents),
    k as (select source, flat, regexp_replace(flat, '[^{WIN_ANSI}]', '', 'g') as kept from f)
 select source, count(*) as texts, count(*) filter (length(flat) > length(kept)) as changed, sum(length(flat) - length(kept))::bigint as dropped,
    min(nullif(regexp_extract(flat, '([^{WIN_ANSI}])', 1), '')) as first_unsupported from k group by 1""")(
    lambda s, d: text.encodability_audit(t(s, d, "documents")))


def ocr_json(s, d):
    """Result trees of pages, one line a paragraph and one paragraph a block."""
    words = "sort_array(collect_list(struct(word_no, struct(raw_text as text, struct(x0, y0, x1, y1) as bbox, confidence) as w)))"
    rows = t(s, d, "ocr_flat").groupBy("doc_id", "page_no", "line_no").agg(F.expr(f"struct(transform({words}, x -> x.w) as words)").alias("line"))
    tree = "to_json(struct(transform(sort_array(collect_list(struct(line_no, line))), x -> struct(array(struct(array(x.line) as lines)) as paragraphs)) as blocks))"
    return rows.groupBy("doc_id", "page_no").agg(F.expr(tree).alias("result"))


_words = """words as (select doc_id, page_no, row_number() over (partition by doc_id, page_no order by line_no, word_no) - 1 as word_no,
    trim(raw_text) as text, x0, y0, x1, y1, confidence from ocr_flat),
 good as (select * from words where text <> '' and x1 > x0 and y1 > y0)"""
ocr = lambda s, d: text.ocr_words(ocr_json(s, d))
query("t1_ocr_words", f"with {_words} select * from good")(ocr)
query("t2_ocr_document_text", f"""with {_words}, tx as (select conv_id as doc_id, string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || text,
    chr(10) || chr(10) order by turn) as text from conversations group by 1),
 n as (select doc_id, count(*) as words from good group by 1) select doc_id, text, coalesce(words, 0) as words, words is not null as has_words from tx
    left join n using (doc_id)""")(
    lambda s, d: text.ocr_document_text(t(s, d, "conversations").selectExpr("conv_id as doc_id", "turn + 1 as page_no", "text"), ocr(s, d)))
query("t3_text_layer_fit", f"""with {_words}, ch as (select doc_id, page_no, word_no, unnest(string_split(text, '')) as ch from good),
    wd as (select doc_id, page_no, word_no, sum(coalesce(w, 0)) as units from ch left join glyph_widths using (ch) group by all),
 st as (select good.*, units, (y1 - y0) / 2 as h, (x1 - x0) / 2 as target, greatest(0.8 * ((y1 - y0) / 2), 1.0) as start from good
    join wd using (doc_id, page_no, word_no))
 select doc_id, page_no, word_no, round(case when units / 1000 * start <= 0 then start else least(greatest(start * target / (units / 1000 * start),
    0.3 * h), 1.6 * h) end, 6) as font_size, x0 / 2 as x, 842.0 - y1 / 2 as y from st""")(
    lambda s, d: text.text_layer_fit(ocr(s, d), t(s, d, "glyph_widths"), 2.0, 842.0))



def painted_over(s, d):
    """(fragments of the pages with boxes, boxes); the boxes, few rows that are read more than once, are written."""
    boxes = durable(t(s, d, "redactions"))
    return text.text_fragments(raw_items(s, d, text_pages=dealt_pages(s, d, boxes))), by_page(s, d, boxes)


under = lambda s, d: redaction.words_under_boxes(*painted_over(s, d))


def survivors(s, d):
    """Needles against the produced documents: all fragments less those painted in every fourth document, and forms that repeat some of the words.

    Only pages of documents with needles are cut into words; those of every fourth document are compared with the painted ones.
    """
    painted = durable(redaction.words_under_boxes(*painted_over(s, d)))  # read three times
    needles = durable(redaction.redaction_needles(painted))
    sought = t(s, d, "text_pages").select("doc_id", "page_no").join(needles.select("doc_id").distinct(), "doc_id", "left_semi")
    produced = text.text_fragments(raw_items(s, d, text_pages=dealt_pages(s, d, sought)))
    cleaned = redaction.without_painted(produced.where("doc_id % 4 = 0"), painted.where("doc_id % 4 = 0"))
    runs = redaction.page_runs(produced.where("doc_id % 4 <> 0")).unionByName(redaction.page_runs(cleaned))
    forms = fragments(s, d).where("doc_id % 4 = 0 and frag_no % 89 = 0").selectExpr("doc_id", "concat('Value:  ', str) as value")
    return redaction.redaction_survivors(needles, runs, forms)


_under = f"""{_frag}, under as (select distinct f.doc_id, f.page_no, f.frag_no, f.str from frag f join redactions r on f.doc_id = r.doc_id
    and f.page_no = r.page_no
 where f.x + f.width > r.x - 1 and f.x < r.x + r.width + 1 and f.y + f.height > r.y - 1 and f.y < r.y + r.height + 1),
 needles as (select distinct doc_id, trim(str) as word, regexp_replace(lower(trim(str)), '\\s+', ' ', 'g') as needle from under
    where length(trim(str)) >= 3 and regexp_matches(trim(str), '[\\p{{L}}\\p{{N}}]')),
 said as (select doc_id, regexp_replace(lower(string_agg(str, ' ' order by page_no, frag_no)), '\\s+', ' ', 'g') as said from frag
    where not (doc_id % 4 = 0 and (doc_id, page_no, frag_no) in (select (doc_id, page_no, frag_no) from under)) group by 1
  union all select doc_id, regexp_replace(lower('Value:  ' || str), '\\s+', ' ', 'g') from frag where doc_id % 4 = 0 and frag_no % 89 = 0),
 surv as (select distinct doc_id, word from needles join said using (doc_id) where contains(said, needle))"""
query("r1_words_under_boxes", f"with {_under} select * from under")(under)
query("r2_redaction_needles", f"with {_under} select * from needles")(lambda s, d: redaction.redaction_needles(under(s, d)))
query("r3_redaction_survivors", f"with {_under} select * from surv")(survivors)
query("r4_release_gate", f"""with {_under}, h as (select doc_id, string_agg(word, '|' order by word) as survivors from surv group by 1) select doc_id,
    survivors is null as released, survivors from doc_manifest left join h using (doc_id)""")(
    lambda s, d: redaction.release_gate(t(s, d, "doc_manifest"), survivors(s, d)))
