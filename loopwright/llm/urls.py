"""URL filters: host and path rules first, then a list of canonical URLs.

The list is met in two steps. A blocked Bloom filter (one 64-bit block a key, the block chosen by one hash, the
bits inside by another) passes possible hits; an exact hash join on the canonical URL removes its false
positives. The filter is built by a grouped bit_or, so that each task only sends a word for each block. It is
broadcast only if the number of its blocks, which is known before, is under a bound; beyond it the pages
meet it by a shuffled join on the block number.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule and is never listed;
repeated rows are judged each; an empty table gives no rows, an empty list blocks nothing; extra columns are
ignored. Rules are configuration, at most MAX_RULES of them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import chosen

MAX_RULES = 500
BITS_PER_KEY = 16
PROBES = 6
SALTS = 8
#: Filters of at most so many blocks (8 bytes and a key each) are broadcast.
MAX_BROADCAST_BLOCKS = 250_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without trailing slashes, sorted query without tracking; null if there is no host.

    Scheme and fragment go. Tracking parameters are utm_*, ref, fbclid and gclid.
    """
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host(url) != "", F.concat(name, F.regexp_replace(path(url), r"/+$", ""), tail))


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits. A rule 'host/path' fits the host and its subdomains where the path starts with its own."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into the plan")
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is the outermost
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host_col == rule_host) | host_col.endswith("." + rule_host)) & path_col.startswith("/" + rule_path)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def _block(c: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks))


def _mask(c: Column) -> Column:
    bits = F.xxhash64(F.lit(1), c)
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: block, mask."""
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("mask"))


def possible_hits(rows: DataFrame, key: str, listed: DataFrame, listed_key: str = "key") -> DataFrame:
    """The rows whose key may be listed: no false negatives, false positives at about half a percent."""
    n = listed.count()
    blocks = max(1, -(-n * BITS_PER_KEY // 64))
    table = bloom_filter(listed.select(F.col(listed_key).alias("k")).where("k is not null"), "k", blocks)
    table = F.broadcast(table) if blocks <= MAX_BROADCAST_BLOCKS else table
    probed = rows.withColumn("block", _block(F.col(key), blocks))
    joined = probed.join(table, "block", "inner")
    return joined.where(_mask(F.col(key)).bitwiseAND(F.col("mask")) == _mask(F.col(key))).drop("block", "mask")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page. `listed` has one column of URLs.

    A page under a rule gets the rule's verdict; any other is blocked if its canonical URL is that of a listed one.
    """
    url = F.col("url")
    rows = chosen(pages, page_id=id_col, url=url_col)
    parted = rows.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parted.select("page_id", "host", "path", "canonical", name.alias("rule"), action.alias("action"))
    keys = listed.select(canonical(F.col(listed.columns[0])).alias("key")).where("key is not null").distinct()
    # only URLs that no rule judges ask the filter; each possible hit meets the list once, however many rows carry it
    asked = ruled.where("rule is null and canonical is not null").select("canonical").distinct()
    hits = possible_hits(asked, "canonical", keys).join(keys.hint("shuffle_hash"), F.col("canonical") == F.col("key"), "inner").select(F.col("canonical").alias("hit"))
    # rows that ask nothing stay out of the join; those of one frequent URL meet its hit in SALTS tasks
    asking = F.col("rule").isNull() & F.col("canonical").isNotNull()
    salted = ruled.where(asking).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    spread = hits.select("hit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("s"))
    met = salted.join(spread, (F.col("canonical") == F.col("hit")) & (F.col("salt") == F.col("s")), "left").withColumn("listed", F.col("hit").isNotNull())
    columns = ["page_id", "host", "path", "rule", "action", "listed"]
    judged = met.select(columns).unionByName(ruled.where(~asking).withColumn("listed", F.lit(False)).select(columns))
    verdict = F.coalesce(F.col("action"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
