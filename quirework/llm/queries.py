"""The registered queries of the training-data operators, and their SQL where DuckDB can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontaminate as decon
from quirework.llm import divergence, hard_negatives, html_extract, jaccard_join, mixing, pii, simhash, substring_dedup, suffix_dedup, toxicity, url_filter, vector_search
from quirework.llm.common import table
from quirework.llm.simhash_sql import OP6_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.toxicity_scores(docs, model)
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes_digest(table(spark, sf_dir, "documents"))


def op3_html_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(table(spark, sf_dir, "documents"))


def op7_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(table(spark, sf_dir, "documents"))


def op8_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity_grammar,
        op2_suffix_array_dedup,
        op3_html_differencing,
        op4_pii_anchors,
        op5_mix_sources,
        op6_simhash_near_dedup,
        op7_difference_cover_dedup,
        op8_vector_top_k,
        op9_url_filter,
        op10_decontaminate,
        op11_source_divergence,
        op12_hard_negatives,
        op13_jaccard_join,
    )
}
# SQL of the operators that DuckDB can express. The others: op1 is a trained model; op3 reads markup; op4 needs positions of
# matches. tests/llm holds these against brute-force versions.

# bytes as pairs of hex digits; windows are cut from pieces of 799 bytes, because substr() walks a string from its start
OP2_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, h, length(h) // 2 as n from d),
pieces as (select doc_id, n, p, substr(h, 2 * p + 1, 1598) as h from (select doc_id, h, n, unnest(range(0, n - 399, 400)) as p from b where n >= 400)),
win as (select doc_id, p + o as s, md5(substr(h, 2 * o + 1, 800)) as k from (select doc_id, p, h, unnest(range(0, least(400, n - 399 - p))) as o from pieces)),
starts as (select doc_id, s from win where k in (select k from win group by k having count(*) > 1)),
steps as (select doc_id, s, coalesce(s - lag(s) over (partition by doc_id order by s) > 400, true)::int as opens from starts),
runs as (select doc_id, min(s) as a, max(s) + 400 as z from (select *, sum(opens) over (partition by doc_id order by s) as run from steps) group by doc_id, run),
kept as (
  select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as f, a as t from runs
  union all select b.doc_id, coalesce(z, 0), n from b left join (select doc_id, max(z) as z from runs group by doc_id) using (doc_id)),
texts as (select doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' order by f) as x from kept join b using (doc_id) group by doc_id)
select b.doc_id, n as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(x)) as kept_sha256
from b join texts using (doc_id)
left join (select doc_id, sum(z - a) as removed, count(*) as n_spans from runs group by doc_id) r using (doc_id)
"""

OP5_SQL = r"""
with base as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
per as (select source, sum(size)::bigint as source_size, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from base group by source),
fills as (select *, 2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as budget from per),
levels as (select *, (budget - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from fills),
targets as (select source, source_size, least(cap, weight * min_by(level, cap / weight) filter (where cap > level * weight) over ()) as target,
  ('0x' || substr(md5('42:' || coalesce('v' || source, 'n')), 1, 13))::bigint / 4503599627370496::double as start from levels),
placed as (select doc_id, source, size, floor(ln(size + 1.0::double) / ln(2.0::double) * 8) as class, md5('42:' || coalesce('v' || doc_id, 'n')) as h from base),
ranked as (select *, row_number() over (partition by source order by class, h, doc_id) as k from placed),
met as (select doc_id, size, source_size, target, k, start, case when source_size > 0 then target / source_size else 0 end as ratio from ranked join targets on ranked.source is not distinct from targets.source)
select doc_id, size, source_size, target, (floor(start + k * ratio) - floor(start + (k - 1) * ratio))::bigint * size as taken from met
"""

OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50)),
first as (select k, min(doc_id) as m from win group by k),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as i from win join first using (k) where doc_id > m),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d)
select d.doc_id, len(d.w) as n_words, coalesce(g.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d
left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)
left join (select doc_id, string_agg(word, ' ' order by i) as kept from words anti join gone using (doc_id, i) group by doc_id) k using (doc_id)
"""

OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""

OP9_SQL = r"""
with p as (select page_id, coalesce(url, '') as url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') as query from p),
c as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)$', '') || case when query <> '' then '?' || query else '' end as canonical from h),
j as (select *, case
  when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from c)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when canonical <> '' and count(*) over (partition by canonical) > 1 then 'block' else 'allow' end as verdict from j
"""

OP10_SQL = r"""
with lower as (select translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t, item_id from benchmark),
items as (select item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lower where t is not null),
win as (select distinct item_id, n, md5(array_to_string(w[s:s + n - 1], ' ')) as k from
  (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from items where len(w) > 0)),
d as (select doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dw as (select doc_id, n, s, md5(array_to_string(w[s:s + n - 1], ' ')) as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from win) where len(w) >= n)),
hit as (select doc_id, item_id, n, s from dw join win using (n, k)),
pos as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(s, s + n)) as i from hit) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join ids using (doc_id)
"""

OP11_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
w as (select id, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by all having count(distinct id) >= 30),
c as (select lang, source, term, count(*) as n from w group by all),
l as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
g as (select lang, source, coalesce(any_value(v), 0) as v, coalesce(any_value(lang_total), 0) as lang_total, coalesce(sum(t.n), 0) as total
  from (select distinct lang, source from d) left join l using (lang) left join (select * from c semi join kept using (lang, term)) t using (lang, source) group by lang, source),
p as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v)::hugeint as p, 1 + (1000000000::hugeint * (lang_n + 5)) // (lang_total + 5 * v)::hugeint as q
  from g join kept using (lang) left join c using (lang, source, term)),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
tm as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pr union all select * from tm))
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= 50
"""

OP12_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.x, c.x)::bigint as score from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

OP13_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, md5(array_to_string(w[s:s + 2], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as s from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as n from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * met.n >= 90 * (x.n + y.n - met.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, a as other from both_ways union select reach.doc_id, both_ways.b from reach join both_ways on reach.other = both_ways.a)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(m, w.doc_id) as component_id from w left join n using (doc_id) left join (select doc_id, min(other) as m from reach group by doc_id) using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": OP2_SQL,
    "op5_mix_sources": OP5_SQL,
    "op6_simhash_near_dedup": OP6_SQL,
    "op7_difference_cover_dedup": OP7_SQL,
    "op8_vector_top_k": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_jaccard_join": OP13_SQL,
}
