"""URL filters by Bloom filter cascades.

Rules name a host and the beginning of a path, and allow or block; beside them stands a
list of blocked hosts. A rule or host fits all subdomains too. Every url names a few keys:
its host's last labels, as many as any listed host has, alone and with those beginnings of
its path that are as long as some rule's. Whether a key is listed is looked up in a
cascade (`bloom_cascade`) that was built over all keys of the corpus, so the answer is
exact without a join of urls and lists; of a url's listed keys the longest decides.

Lists whose cascade would be too large to send to every executor are joined instead, on
the distinct key sets of the urls.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom_cascade import MOST_BYTES, build_cascade, hashes
from .common import scratch

ALLOW, BLOCK = "allow", "block"
#: The production rules (host, beginning of the path, verdict).
RULES = (
    ("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK),
)
#: The production list of blocked hosts.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{tld}" for name in BLOCKED_NAMES for tld in ("com", "net", "org"))
#: Host and path of a url, its first two groups.
PARTS = "://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without a ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def last_labels(host: Column, depth: int) -> Column:
    """The host's last labels, 1 to `depth` of them, the most first."""
    labels = F.split(host, r"\.", -1)
    most = F.least(F.size(labels), F.lit(depth))
    return F.transform(F.sequence(most, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def rule_keys(host: Column, path: Column, depth: int, lengths: Sequence[int]) -> Column:
    """Host and path beginnings that a rule may name, the longest first, then by the longer host."""
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(last_labels(host, depth), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    # a stable order: by falling length, hosts with more labels before others
    ranked = F.transform(keys, lambda k, i: F.struct((-F.length(k)).alias("n"), i.alias("i"), k.alias("k")))
    return F.transform(F.array_sort(ranked), lambda x: x["k"])


def first_listed(rows: DataFrame, keys: str, listed: DataFrame, found: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds `found`, the first of the keys in the array column `keys` that `listed` (one string column) has; null if none.

    Rows keep their order and number. The look-up is a cascade over all keys of `rows`; a
    list whose cascade would take over `most_bytes` is joined with the distinct arrays.
    """
    name = listed.columns[0]
    universe = rows.select(F.explode(keys).alias(name))
    try:
        with scratch(rows.sparkSession):
            cascade = build_cascade(listed, universe, name, most_bytes)
    except ValueError:
        each = rows.select(F.col(keys).alias("_keys")).distinct()
        hit = each.select("_keys", F.posexplode("_keys").alias("_at", name)).join(listed.distinct(), name)
        best = hit.groupBy("_keys").agg(F.min_by(name, "_at").alias(found))
        return rows.join(best.withColumnRenamed("_keys", keys), keys, "left")
    sent = rows.sparkSession.sparkContext.broadcast(cascade)

    @F.arrow_udf("int")
    def place(h1: pa.Array, h2: pa.Array) -> pa.Array:
        if not len(h1):
            return pa.array([], pa.int32())
        ends = h1.offsets.to_numpy() - h1.offsets[0].as_py()
        ok = sent.value.contains(h1.flatten().to_numpy(), h2.flatten().to_numpy())
        at = np.flatnonzero(ok)
        # the first hit at or after each row's start, if it is before the row's end
        first = np.append(at, ends[-1])[np.searchsorted(at, ends[:-1])]
        return pa.array(np.where(first < ends[1:], first - ends[:-1], -1).astype(np.int32))

    hashed = [F.transform(keys, one) for one in (lambda k: hashes(k)[0], lambda k: hashes(k)[1])]
    # without a -1 there is no such place, and get() gives null
    return rows.withColumn(found, F.get(F.col(keys), place(*hashed)))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, blocked: DataFrame | None = None, url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds host, path, rule and verdict of each url; columns of these names are replaced.

    `rules` has host, path and verdict, `blocked` has host; without them the production
    lists hold. The longest rule that fits decides, of equally long ones that with more
    host labels; urls that no rule fits are blocked if their host or a parent domain of it is
    listed, else allowed. A null url, or one without ://, has an empty host and path, no
    rule, and is allowed. Repeated rows are judged alike; an empty table gives an empty
    one, empty lists fit nothing. Two verdicts for one rule are an error.
    """
    spark = pages.sparkSession
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if rules is None else rules
    blocked = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string") if blocked is None else blocked.select("host")
    named = rules.select(F.concat("host", "path").alias("key"), "host", "path", "verdict")
    if twice := named.groupBy("key").agg(F.count_distinct("verdict").alias("n")).where("n > 1").first():
        raise ValueError(f"two verdicts for the rule {twice['key']}")
    labels = F.max(F.size(F.split("host", r"\.", -1)))
    depth, lengths = named.agg(labels, F.collect_set(F.length("path"))).first()
    host_depth = blocked.agg(labels).first()[0]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    rows = rows.withColumn("_keys", rule_keys(F.col("_host"), F.col("_path"), depth or 1, lengths or [1]))
    rows = rows.withColumn("_hosts", last_labels(F.col("_host"), host_depth or 1))
    for verdict in (ALLOW, BLOCK):
        rows = first_listed(rows, "_keys", named.where(F.col("verdict") == verdict).select("key"), f"_{verdict}", most_bytes)
    rows = first_listed(rows, "_hosts", blocked, "_listed", most_bytes)
    place = lambda c: F.coalesce(F.nullif(F.array_position("_keys", F.col(c)), F.lit(0)), F.lit(1 << 30))
    allows = place("_allow") < place("_block")
    rule = F.when(allows, F.col("_allow")).otherwise(F.col("_block"))
    verdict = F.when(rule.isNull(), F.when(F.col("_listed").isNotNull(), BLOCK).otherwise(ALLOW)).otherwise(F.when(allows, ALLOW).otherwise(BLOCK))
    own = {"host": F.col("_host"), "path": F.col("_path"), "rule": rule, "verdict": verdict}
    kept = [F.col(f"_row.`{c}`") for c in pages.columns if c not in own]
    return rows.select(*kept, *[c.alias(n) for n, c in own.items()])


def url_digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every url by the production lists; nulls, repeats and empties as in `judge_urls`."""
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
