"""URL filters: rules by host and path, then a list of canonical URLs, which a blocked Bloom filter tests before an
exact join removes its false positives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import spread_join, written

# The rules of the query, as verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Parameters that name no other page.
IGNORED = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|\z)"
#: A block has WORDS words of 64 bits; a listed URL sets a bit in each. The filter has BITS bits for a listed URL, in MOST blocks (8 MB)
#: at most, whatever the list: it is broadcast. A fuller filter passes more URLs to the exact join, which alone decides.
WORDS, BITS, MOST = 8, 16, 1 << 17


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (small A to Z), path and query of a URL; all empty where it is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), path, F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One form for the addresses of a page; null without a host.

    The scheme and the fragment are left out, of the host a user's name, the ports 80 and 443 and a first label of www, m or mobile, of the path
    an index.html, an ending .html and slashes at the end; parameters are sorted, without those of IGNORED.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)\z", ""), r"^(www|m|mobile)\.", "")
    short = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html\z", ""), r"/+\z", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(IGNORED)))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(bare != "", F.concat(bare, short, asked))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null where none does. The rules become one expression."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, on, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(under)
        found, verdict = F.when(fits, F.lit(on + under)).otherwise(found), F.when(fits, F.lit(say)).otherwise(verdict)
    return found, verdict


def _bit(hashed: Column, k: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftright", hashed, F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int"))


def _hashes(url: Column, blocks: int) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(url), F.lit(blocks)), F.xxhash64(url, F.lit("bits"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word_0 ...) of a table of URLs: its rows are ``blocks`` at most."""
    block, bits = _hashes(F.col("listed"), blocks)
    return listed.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(*(F.bit_or(_bit(F.col("bits"), k)).alias(f"word_{k}") for k in range(WORDS)))


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, most: int = MOST) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), canonical and listed (whether its canonical form is on the list).

    ``listed`` has a column url; its canonical forms are blocked, unless a rule decides. Rules come as verdict, host and path: one fits its host and all
    subdomains if the path starts with its own; the longest wins.

    Needs columns page_id and url; others are ignored. Url null, empty or without ``://``: host and path empty, no rule, allowed. Null entries of
    the list match nothing, repeated ones count once. Repeated rows and null page_ids: each is judged by its URL. Empty list: rules alone
    decide. Empty table: no rows. A URL that many pages have is joined with the list in parts.
    """
    parts = url_parts(F.col("url"))
    entries = written(listed.select(canonical(*parts).alias("listed")).where("listed is not null").distinct(), "listed")
    n = entries.count()
    blocks = min(most, max(1, -(-n * BITS // (64 * WORDS))))
    sieve = F.broadcast(bloom(entries, blocks))  # ``blocks`` rows at most
    host, path, query = parts
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), canonical(host, path, query).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    block, bits = _hashes(F.col("canonical"), blocks)
    tested = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), block.alias("block"), bits.alias("bits")).join(sieve, "block", "left")
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & (F.coalesce(F.col(f"word_{k}").bitwiseAND(_bit(F.col("bits"), k)), F.lit(0)) != 0)
    tested = tested.withColumn("hit", hit & F.col("canonical").isNotNull()).select("page_id", "host", "path", "canonical", "rule", "ruled", "hit")
    hits = written(tested.where("hit").drop("hit"), "hits")
    sure = spread_join(hits, entries.select(F.col("listed").alias("canonical"), F.lit(True).alias("listed")), "canonical", "left")
    out = sure.unionByName(tested.where("not hit").drop("hit").withColumn("listed", F.lit(False)))
    out = out.withColumn("listed", F.coalesce("listed", F.lit(False)))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")


def blocked_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url) of the pages that ``labels`` marks toxic by their id: the list that the query takes, so that it grows with the tables."""
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("page_id")).distinct()
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").join(toxic, "page_id", "left_semi").select("url")
