"""URL filters: a blocked Bloom filter in front of an exact hash join.

The filter is a small table of 64-bit blocks. A listed canonical URL sets four bits of one block; the
blocks are formed by a grouped bit_or, so no list passes through the driver. Its number of blocks is fixed and bounds
its size, so it can be broadcast whatever the list's length. Only pages whose four bits are set go on to the exact
join with the list, which removes false positives. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import durable, lower_ascii

#: Blocks of the filter at most: 2**20 rows of two longs, 16 MB of data. This bounds what is broadcast, however long the list.
MAX_BLOCKS = 1 << 20
#: Keys for which a block of 64 bits is laid out, and bits set by each.
KEYS_A_BLOCK = 4
BITS = 4
#: Keys beyond which most blocks are full and nearly every row passes.
USEFUL_KEYS = 2 * MAX_BLOCKS * KEYS_A_BLOCK

# Verdict, host and path of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ://, A-Z lower-cased; the path from there to ?, # or the end. Else both empty."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without www, path without a closing slash or .html, and the query without tracking parameters, which are dropped like the fragment."""
    host, path = url_parts(url)
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    kept = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: ~x.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)") & (x != ""))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or one of its parents and the start of the path; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """(block, mask) of a key: one hash chooses the block, four times six bits of another the bits."""
    h, g = F.xxhash64(key), F.xxhash64(F.lit(7), key)
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.shiftrightunsigned(g, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(h, F.lit(blocks)), mask


def bloom_filter(listed: DataFrame, col: str, n_keys: int) -> tuple[DataFrame, int]:
    """((block, bits), blocks): a blocked Bloom filter over a column with about n_keys values; one row a block in use."""
    blocks = min(MAX_BLOCKS, 1 << max(4, (n_keys // KEYS_A_BLOCK).bit_length()))
    block, mask = _bits(F.col(col), blocks)
    return listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits")), blocks


def possible_members(rows: DataFrame, col: str, bloom: tuple[DataFrame, int]) -> DataFrame:
    """rows with a boolean _possible: false only if the value of col is surely not in the filter."""
    block, mask = _bits(rows[col], bloom[1])
    table = F.broadcast(bloom[0]).withColumnsRenamed({"block": "_block", "bits": "_bits"})
    probed = rows.withColumns({"_at": block, "_mask": mask}).join(table, F.col("_at") == F.col("_block"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return probed.withColumn("_possible", hit).drop("_at", "_mask", "_block", "_bits")


def flag_listed(urls: DataFrame, listed: DataFrame, col: str = "canonical") -> DataFrame:
    """The rows of urls with a boolean column listed: whether the value of col is in the table listed (distinct values).

    Rows that the filter turns away get a join key that is in no list, spread over all partitions.
    """
    probed = possible_members(urls, col, bloom_filter(listed, col, listed.count()))
    probed = probed.withColumn("_key", F.when(F.col("_possible"), F.col(col)).otherwise(F.concat(F.lit("\u0000"), F.col(col))))
    exact = listed.select(F.col(col).alias("_listed"))
    return probed.join(exact, F.col("_key") == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull()).drop("_possible", "_key", "_listed")


def repeated_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list that the registered query uses, from the table itself: canonical URLs that more than one page carries."""
    return pages.select(canonical_url(pages[url_col]).alias("canonical")).where("canonical <> ''").groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical")


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed. A rule decides first; else block if the canonical URL is listed.

    listed has a column canonical of distinct values (default: repeated_urls of the pages). A null URL or one without ://
    has empty host and path, fits no rule and is never listed. Rows with equal ids or URLs are judged one by one; null ids
    stay. Other columns are ignored; an empty table gives an empty result.
    """
    host, path = url_parts(pages[url_col])
    listed = durable(repeated_urls(pages, url_col) if listed is None else listed)  # counted, filtered and joined
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(canonical_url(pages[url_col]), F.lit("")).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = flag_listed(rows, listed).withColumns({"rule": rule, "verdict": verdict})
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_list).alias("verdict"), "listed")
