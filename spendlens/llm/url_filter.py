"""URL filters: a blocked Bloom filter in front of an exact hash join.

Every listed canonical URL hashes to one block of 256 bits and sets ``BITS`` of
them. The filter is a table of blocks whose number is bounded, so it is
broadcast; a URL needs one look-up. Only URLs whose bits are all set (listed
ones and a few false positives) go to the exact join with the list, which
removes the false positives. Host rules are judged first: among the rules that
fit, the longest wins.

DataFrame functions only. Defined results: a null url, or one without
``://``, has empty host and path and is never listed; rules are compared
literally; repeated rows keep a row each; empty tables give empty results; a
null or empty list blocks nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed

BLOCK_BITS = 256
BITS = 8
#: the filter never has more blocks than this (32 bytes of bits each: 2 MB)
MAX_BLOCKS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` / ``m.`` and default port, path without a closing slash or index page."""
    bare = F.regexp_replace(host, r"^(www|m)\.|:(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/(index\.html?)?$", "")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; ``rules`` are (verdict, host, path), a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(blocks)).cast("int")


def _bit(url: Column, i: int) -> Column:
    """The i-th bit of a URL, 0 to 255, from its own byte of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(url, F.lit(2)), 8 * i).bitwiseAND(F.lit(255)).cast("int")


def _word(url: Column, w: int) -> Column:
    """The bits a URL sets in 64-bit word ``w`` of its block."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        b = _bit(url, i)
        mine = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)))
        out = out.bitwiseOR(F.when(F.shiftright(b, 6) == w, mine).otherwise(F.lit(0).cast("long")))
    return out


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the distinct URLs in column ``url``."""
    words = [_word(F.col("url"), w).alias(f"w{w}") for w in range(BLOCK_BITS // 64)]
    one = listed.select(_block(F.col("url"), blocks).alias("block"), *words)
    return one.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(BLOCK_BITS // 64)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], bits_per_url: int = 16, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) of every page.

    ``listed`` has a column ``url`` of canonical URLs to block.
    """
    wanted = listed.select(F.col("url").cast("string")).where("url is not null").distinct()
    blocks = 1
    bits = bits_per_url * wanted.count()
    while blocks < MAX_BLOCKS and blocks * BLOCK_BITS < bits:
        blocks *= 2
    rows = keyed(pages, page_id=id_col, url=url_col).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"))
    # at most MAX_BLOCKS rows of 36 bytes whatever the list holds
    probe = rows.withColumn("block", _block(F.col("canonical"), blocks)).join(F.broadcast(bloom_blocks(wanted, blocks)), "block", "left")
    missing = F.lit(False)
    for w in range(BLOCK_BITS // 64):
        own = _word(F.col("canonical"), w)
        missing = missing | (own.bitwiseAND(F.col(f"w{w}")) != own)
    probe = probe.withColumn("possible", F.col("canonical").isNotNull() & F.col("w0").isNotNull() & ~missing)
    columns = ["page_id", "host", "path", "canonical"]
    hits = probe.where("possible").select(*columns).join(wanted.select(F.col("url").alias("canonical"), F.lit(True).alias("listed")), "canonical", "left")
    rest = probe.where("NOT possible").select(*columns, F.lit(None).cast("boolean").alias("listed"))
    both = hits.select(*columns, "listed").unionByName(rest)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return both.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.coalesce("listed", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "canonical",
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )
