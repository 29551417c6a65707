"""URL filters: host and path rules, then a list of URLs behind a blocked Bloom filter (DataFrame operations only).

A URL that no rule fits is blocked if its canonical form is listed. The list may be as
long as the table of pages, so it isn't joined with every page:

1. the listed canonical URLs fill a blocked Bloom filter: a block is a row of eight
   64-bit words, a URL sets one bit of each word of one block (bit_or by block);
2. every page looks up its one block. No bit missing makes it a possible hit; all others
   are decided there, in the scan, without a shuffle;
3. possible hits alone, a few pages beside the true ones, meet the list in a hash join
   on the canonical URL itself, which removes the false positives.

The filter is broadcast up to MAX_BROADCAST_BLOCKS, 8 million listed URLs; beyond that
pages meet their blocks by a shuffle of the block number.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

WORDS = 8
BITS_PER_URL = 16
#: A block is a row of 8 words: the broadcast stays under about 32 MB.
MAX_BROADCAST_BLOCKS = 1 << 18


class Rule(NamedTuple):
    """Fits its host and all subdomains if the URL's path starts with the rule's."""

    verdict: str
    host: str
    path: str


def after_scheme(url: Column) -> Column:
    """What follows the first ://; NULL if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form that URLs are compared in; NULL for a URL without ://.

    Scheme, user, www., default ports and a closing dot of the host go, slashes are
    single and none closes the path, nor does index.html; tracking parameters go, the
    others are sorted; the fragment goes.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r"^www\.|\.?(:80|:443)?$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+", "/"), r"(/index\.html?)?/?$", "")
    params = F.split(F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    return F.when(F.locate("://", url) > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_that_fits(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits, of the longest host if two are as long; else NULLs."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host))):  # the last to be asked is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def block_of(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def bit_of(word: int) -> Column:
    """The word's bit of column bits, six bits of a hash for each word."""
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(bits, {6 * word}) & 63 as int))")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the blocks that have a bit set. listed: canonical."""
    keyed = listed.select(block_of(F.col("canonical"), blocks).alias("block"), F.xxhash64(F.lit(7), F.col("canonical")).alias("bits"))
    return keyed.groupBy("block").agg(*[F.bit_or(bit_of(w)).alias(f"w{w}") for w in range(WORDS)])


def with_possible(rows: DataFrame, filled: DataFrame, blocks: int, broadcast: bool) -> DataFrame:
    """rows with possible: whether all bits of canonical are set. Rows without canonical are not possible."""
    keyed = rows.withColumn("block", block_of(F.col("canonical"), blocks)).withColumn("bits", F.xxhash64(F.lit(7), F.col("canonical")))
    found = keyed.join(F.broadcast(filled) if broadcast else filled, "block", "left")
    every = F.col("canonical").isNotNull()
    for w in range(WORDS):
        every = every & (F.coalesce(F.col(f"w{w}"), F.lit(0)).bitwiseAND(bit_of(w)) != 0)
    return found.select(*rows.columns, every.alias("possible"))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
          max_broadcast_blocks: int = MAX_BROADCAST_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each page: the longest rule's verdict, else block if its canonical URL is listed.

    listed: a table whose first column is a URL. Pages that a rule decides aren't looked
    up, their column listed is NULL. A null URL, an empty one and one without :// have empty host
    and path, no rule and are allowed; so is a page of an empty list. Rows that are
    repeated are each judged, a null id is kept. Other columns aren't looked at. A
    listed URL without :// lists nothing.
    """
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    rule, ruled = rule_that_fits(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), F.when(rule.isNull(), canonical(url)).alias("canonical"))
    # the list as canonical URLs, each once
    unique = listed.select(canonical(listed[listed.columns[0]]).alias("canonical")).filter("canonical is not null").distinct()
    unique = written(unique, "listed-urls")
    blocks = max(1, math.ceil(unique.count() * BITS_PER_URL / (64 * WORDS)))
    probed = with_possible(rows, bloom_filter(unique, blocks), blocks, blocks <= max_broadcast_blocks)
    sure, possible = probed.filter(~F.col("possible")), probed.filter("possible")
    joined = possible.join(unique.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    found = sure.select("page_id", "host", "path", "rule", "ruled", F.when(F.col("rule").isNull(), False).alias("listed")).unionByName(
        joined.select("page_id", "host", "path", "rule", "ruled", F.coalesce("listed", F.lit(False)).alias("listed")))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: Fixed values of the query: its rules, and the words in host names whose pages make the list.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]
LISTED_HOSTS = r"(^|[.-])(casino|pills|spam)([.-]|$)"


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: URLs of all pages whose host has a listed word."""
    return pages.filter(host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def _rules_sql() -> tuple[str, str]:
    longest = sorted(RULES, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    cases = [(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN", r) for r in longest]
    return (f"CASE {' '.join(f"{when} '{r.host}{r.path}'" for when, r in cases)} END", f"CASE {' '.join(f"{when} '{r.verdict}'" for when, r in cases)} END")


OP11_SQL = rf"""
WITH p AS (SELECT page_id, url, substr(url, nullif(strpos(url, '://'), 0) + 3) AS rest FROM pages),
hp AS (SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
cn AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept,
    regexp_replace(regexp_replace(host, '^[^@]*@', ''), '^www\.|\.?(:80|:443)?$', '', 'g') || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(/index\.html?)?/?$', '') AS place FROM hp),
key AS (SELECT *, CASE WHEN rest IS NOT NULL THEN place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM cn),
ruled AS (SELECT *, {_rules_sql()[0]} AS rule, {_rules_sql()[1]} AS ruled FROM key),
listed AS (SELECT DISTINCT canonical FROM key WHERE canonical IS NOT NULL AND regexp_matches(host, '{LISTED_HOSTS}'))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN listed l ON ruled.canonical = l.canonical
"""
