"""Cache tables: eviction, lookups, statistics and learnt routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def lru_evict(cache: DataFrame, scope: list[str], size: str, accessed: str, rowid: str, capacity: int) -> DataFrame:
    """Adds `evicted`: within each scope the least recently used rows go until the rest fits the capacity.

    Scopes (shards of a cache) are evicted independently, so a running sum never spans the table.
    """
    newest = Window.partitionBy(*scope).orderBy(F.desc(accessed), F.desc(rowid)).rowsBetween(Window.unboundedPreceding, 0)
    return cache.withColumn("evicted", F.sum(size).over(newest) > capacity)


def lookup(items: DataFrame, cache: DataFrame, key: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Adds `state` (hit, stale, miss) of each item against cache(key, created_at); rows outlive their time for validators."""
    c = cache.select(F.col(key).alias("__key"), F.col("created_at").alias("__created"))
    joined = items.join(c, items[key] == F.col("__key"), "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("__created")
    state = F.when(F.col("__key").isNull(), "miss").when(age <= ttl_seconds, "hit").otherwise("stale")
    return joined.withColumn("state", state).drop("__key", "__created")


def cache_key(namespace: str, *parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the namespace and parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", F.lit(namespace), *parts), 256), 1, 32)


def learn_routes(hits: DataFrame, domain: str, at: str, idle_days: int, now: Column, capacity: int) -> DataFrame:
    """domain, learned_at, last_hit, hits: learnt domains that are not idle, most hits first, at most `capacity` (a feature)."""
    seen = hits.groupBy(F.col(domain).alias("domain")).agg(F.min(at).alias("learned_at"), F.max(at).alias("last_hit"), F.count("*").alias("hits"))
    return seen.filter(F.datediff(now, "last_hit") <= idle_days).orderBy(F.desc("hits"), "domain").limit(capacity)
