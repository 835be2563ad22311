"""URL filter: rules first, then listed canonical URLs through a blocked Bloom filter and an exact join.

A canonical URL is host and path without scheme, query, fragment and trailing slashes. A listed entry covers that URL,
and an entry that is a host covers the host and its subdomains. Each distinct undecided URL is looked up under its own
canonical form and under each suffix of its host. The Bloom filter (256-bit blocks of four longs, `hashes` bits per
key inside one block) discards almost all look-ups without a shuffle; what passes goes to an exact hash join on the
listed strings, which removes false positives: the distinct look-ups meet the list, and the hits return to the URLs salted
by path, so that one listed host with a third of all URLs is spread. The filter's size follows from the list: it is
broadcast only up to `broadcast_bytes` and joined by block beyond that. Pages that a rule decides, or that have no host,
take no part in any join.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is allowed; repeated rows
each get a verdict; of rules of one length that fit, the later one in the list wins; urls of any length are read whole; an
empty table or list gives an empty result or no hit; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import lower_ascii

#: (verdict, rule) of the registered query: fixed values.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Listed hosts of the registered query: fixed values.
LISTED = [
    f"{name}.example.{top}"
    for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]
BLOCK_BITS = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z lower-cased. Path: then up to ?, # or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def _bits(key: Column, hashes: int) -> list[Column]:
    """Four longs with the key's bits inside its block."""
    h = F.xxhash64(key, F.lit(1))
    at = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(hashes)]
    words = []
    for w in range(BLOCK_BITS // 64):
        word = F.lit(0).cast("long")
        for a in at:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)))
            word = word.bitwiseOR(F.when(F.shiftright(a, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(listed: DataFrame, blocks: int, hashes: int) -> DataFrame:
    """(block, m0..m3): the bits of all listed keys `c`, merged by bit_or within each block."""
    masks = _bits(F.col("c"), hashes)
    keyed = listed.select(_block(F.col("c"), blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(masks)))
    return keyed.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"m{i}") for i in range(len(masks))))


def url_filter(
    df: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    bits_per_key: int = 16,
    hashes: int = 6,
    salts: int = 32,
    broadcast_bytes: int = 16_000_000,
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row. listed: one column of canonical URLs, of any size."""
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((F.col("host") == text[:at]) | F.col("host").endswith("." + text[:at])) & F.col("path").startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    pages = pages.withColumn("rule", rule).withColumn("by_rule", verdict)

    keys = listed.select(F.col(listed.columns[0]).alias("c")).where(F.col("c").isNotNull()).distinct()
    blocks = max(1, -(-keys.count() * bits_per_key // BLOCK_BITS))
    bloom = bloom_filter(keys, blocks, hashes)
    if blocks * 48 <= broadcast_bytes:
        bloom = F.broadcast(bloom)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    open_urls = pages.where(F.col("by_rule").isNull() & (F.col("host") != "")).select("host", "path").distinct()
    looks = open_urls.select("host", "path", F.explode(F.array_distinct(F.concat(suffixes, F.array(canonical(F.col("host"), F.col("path")))))).alias("c"))
    looks = looks.withColumn("block", _block(F.col("c"), blocks))
    for i, m in enumerate(_bits(F.col("c"), hashes)):
        looks = looks.withColumn(f"q{i}", m)
    passed = looks.join(bloom, "block")
    for i in range(BLOCK_BITS // 64):
        passed = passed.where(F.col(f"m{i}").bitwiseAND(F.col(f"q{i}")) == F.col(f"q{i}"))
    passed = passed.select("host", "path", "c", F.pmod(F.xxhash64("path"), F.lit(salts)).alias("salt"))
    found = passed.select("c").distinct().join(keys, "c", "left_semi")
    spread = found.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    hits = passed.join(spread, ["c", "salt"]).select("host", "path").distinct().withColumn("hit", F.lit("block"))
    is_open = F.col("by_rule").isNull() & (F.col("host") != "")
    judged = pages.where(is_open).join(hits, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("hit", F.lit("allow")).alias("verdict"))
    return judged.unionByName(pages.where(~is_open).select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict")))
