"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible
hits to an exact hash join, which removes the false positives.

A listed entry (host, path) covers its host, all subdomains, and every path that
starts with its own.  A URL is looked up under each of its host suffixes and
path prefixes that have as many labels, or as many characters, as some entry
has; longer lists of keys could not hit.  The filter has a fixed number of
512-bit blocks (one bit in each of eight words per entry), so its size is
bounded whatever the list; a longer list only passes more candidates on.

Defined results: a null URL, or one without "://", has empty host and path and
fits no entry.  Listed hosts are compared without user, port and trailing dots, so
that none of these hides a host.  Distinct (host, path) pairs are judged once; repeated rows get
equal results.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ascii_lower

BLOCKS = 1 << 13  # of 64 bytes: half a megabyte

# The rules of the contract (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

# The method's own list, for URLs that no rule fits: a sample, of the spam hosts that
# the generated pages have.  A user passes their own list as a table.
SPAM_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = [(f"{name}.example.{top}", "/", "block") for name in SPAM_NAMES for top in ("com", "net", "org")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def canonical_host(host: Column) -> Column:
    """A host as lists name it: without user, port and the dot of the root."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def _bits(key: Column, blocks: int) -> list[Column]:
    """The block of a key, and its bit in each of the block's eight words."""
    second = F.xxhash64(key, F.lit(7))
    places = [F.shiftrightunsigned(second, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(8)]
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"),
            *[F.call_function("shiftleft", F.lit(1).cast("bigint"), p).alias(f"bit{j}") for j, p in enumerate(places)]]


def bloom_filter(entries: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Blocks of the filter that have bits set: at most ``blocks`` rows."""
    key = F.concat("host", "path")
    return entries.select(*_bits(key, blocks)).groupBy("block").agg(
        *[F.bit_or(f"bit{j}").alias(f"word{j}") for j in range(8)])


def judge(urls: DataFrame, entries: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(host, path, entry_host, entry_path, verdict): for every distinct (host,
    path) of ``urls`` that fits an entry, the longest one."""
    entries = entries.select("host", "path", "verdict")
    shape = entries.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.char_length("path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    if not labels:
        return urls.select("host", "path").limit(0).withColumns(
            {c: F.lit(None).cast("string") for c in ("entry_host", "entry_path", "verdict")})
    part = F.split("host", r"\.")
    suffixes = F.filter(F.array(*[
        F.when(F.size(part) >= n, F.array_join(F.slice(part, -n, n), ".")) for n in labels]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[
        F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    keys = (urls.select("host", "path").distinct()
            .select("host", "path", F.explode(suffixes).alias("entry_host"), prefixes.alias("p"))
            .select("host", "path", "entry_host", F.explode("p").alias("entry_path")))
    probe = keys.select("*", *_bits(F.concat("entry_host", "entry_path"), blocks))
    passed = probe.join(F.broadcast(bloom_filter(entries, blocks)), "block")
    for j in range(8):
        passed = passed.where(F.col(f"word{j}").bitwiseAND(F.col(f"bit{j}")) != 0)
    exact = passed.select("host", "path", "entry_host", "entry_path").join(
        entries.select(F.col("host").alias("entry_host"), F.col("path").alias("entry_path"), "verdict"),
        ["entry_host", "entry_path"])
    length = F.char_length("entry_host") + F.char_length("entry_path")
    return exact.groupBy("host", "path").agg(
        F.max(F.struct(length.alias("n"), "entry_host", "entry_path", "verdict")).alias("x")
    ).select("host", "path", "x.entry_host", "x.entry_path", "x.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
                blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: (page_id, url, host, path, rule, verdict).  The
    longest fitting rule decides; else the longest listed entry; else allow.  Rules
    see the host as it stands in the URL, the list its canonical form."""
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    ruled = judge(rows, rules, blocks).select(
        "host", "path", F.concat("entry_host", "entry_path").alias("rule"), F.col("verdict").alias("ruled"))
    rows = rows.withColumn("plain", canonical_host(F.col("host")))
    known = judge(rows.select(F.col("plain").alias("host"), "path"), listed, blocks).select(
        F.col("host").alias("plain"), "path", F.col("verdict").alias("known"))
    return (rows.join(ruled, ["host", "path"], "left").join(known, ["plain", "path"], "left")
            .select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", "known", F.lit("allow")).alias("verdict")))
