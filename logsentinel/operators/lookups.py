"""Lookups as joins: threat lists, address blocks, geography, host suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsentinel.functions import scalars as S

#: Lists up to so many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def bounded(dim: DataFrame) -> DataFrame:
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def in_blocks(df: DataFrame, cidrs: DataFrame) -> DataFrame:
    """Adds ``listed``: whether the address is in any block.

    For each prefix length that the list has (33 at most) an equi-join on the address's network of that length: the log is not
    shuffled while the list can be broadcast, and never joined by a nested loop. Rows with equal ``line_no`` or none are
    judged each by itself; an address that isn't one is in no block.
    """
    lengths = cidrs.groupBy("prefix").agg(F.count("*").alias("n")).orderBy("prefix").collect()
    names = df.columns
    df = S.once(df, *names, S.ip_number(F.col("ip")).alias("__ip"))
    found = F.lit(False)
    for m, n in lengths:
        nets = cidrs.where(F.col("prefix") == m).select(F.col("network").alias(f"__net{m}")).distinct()
        df = df.join(F.broadcast(nets) if n <= BROADCAST_ROWS else nets, S.masked(F.col("__ip"), F.lit(m)) == F.col(f"__net{m}"), "left")
        found = found | F.col(f"__net{m}").isNotNull()
    return df.select(*names, (found & (F.col("__ip") > 0)).alias("listed"))


def cidr_semi(df: DataFrame, cidrs: DataFrame) -> DataFrame:
    return in_blocks(df, cidrs).where("listed").drop("listed")


def cidr_anti(df: DataFrame, cidrs: DataFrame) -> DataFrame:
    return in_blocks(df, cidrs).where("NOT listed").drop("listed")


def threat_join(df: DataFrame, feed: DataFrame) -> DataFrame:
    """Rows whose address is on the list (column ip)."""
    return df.join(bounded(feed.select("ip").distinct()), "ip", "left_semi")


def domain_suffix_join(df: DataFrame, domains: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host or any parent of it is listed (column domain): one equi-join for each number of labels in the list."""
    names, label_count = df.columns, F.size(F.split("domain", r"\."))
    found = F.lit(False)
    for n, size in domains.groupBy(label_count.alias("labels")).agg(F.count("*")).orderBy("labels").collect():
        own = domains.where(label_count == n).select(F.col("domain").alias(f"__d{n}")).distinct()
        df = df.join(F.broadcast(own) if size <= BROADCAST_ROWS else own, F.substring_index(host, ".", -n) == F.col(f"__d{n}"), "left")
        found = found | F.col(f"__d{n}").isNotNull()
    return df.where(found).select(*names)


def geo_enrich(df: DataFrame, geo: DataFrame) -> DataFrame:
    return df.join(bounded(geo), "ip", "left")


def threat_types(df: DataFrame, feed: DataFrame, mask: int) -> DataFrame:
    """Rows whose address is listed (ip, types) with any type bit of ``mask``, and those types."""
    wanted = feed.groupBy("ip").agg(F.bit_or("types").alias("types")).where(F.col("types").bitwiseAND(F.lit(mask)) != 0)
    return df.join(bounded(wanted), "ip")


def valid_mapping(df: DataFrame, names: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Adds ``name``: of the mappings (ip, name, cached_ms) that were valid at the row's time the newest, else null.

    A mapping holds for ``ttl_ms`` from when it was cached. Both sides are cut into spans of that length, so that a row meets
    the mappings of two spans of its address and no others.
    """
    span = lambda c: F.floor(c / ttl_ms)
    m = names.select("ip", "name", "cached_ms", F.explode(F.array(span(F.col("cached_ms")), span(F.col("cached_ms")) + 1)).alias("__span"))
    rows = df.withColumns({"__span": span(F.col("ts_ms")), "__row": F.monotonically_increasing_id()})
    valid = (F.col("cached_ms") <= F.col("ts_ms")) & (F.col("ts_ms") <= F.col("cached_ms") + ttl_ms)
    both = rows.select("__row", "ip", "__span", "ts_ms").join(m, ["ip", "__span"]).where(valid)
    best = both.groupBy("__row", "ip", "__span").agg(F.max(F.struct("cached_ms", "name"))["name"].alias("name"))
    return rows.join(best, ["ip", "__span", "__row"], "left").select(*df.columns, "name")


#: Lengths of spans: a minute, doubled so often.
SHORTEST, LEVELS = 60_000, 20


def valid_interval(df: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``name``: of the mappings (ip, name, cached_ms, expires_ms) that were valid at the row's time the newest (ties: the last name), else null.

    Each mapping holds for a time of its own. It is put under spans of the shortest length (of SHORTEST, doubled LEVELS times at most) that is not shorter than its life, of which
    it meets two at most, and a row is looked up once for each length in use, of which there are LEVELS at most. So no row meets mappings that ended
    long before it, however long others live.
    """
    life = F.col("expires_ms") - F.col("cached_ms")
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(life, F.lit(1)) / SHORTEST)), F.lit(0)), F.lit(LEVELS)).cast("int")
    span = lambda c: F.floor(c / (SHORTEST * F.pow(F.lit(2.0), F.col("__level")))).cast("long")
    m = names.where(life >= 0).select("ip", "name", "cached_ms", "expires_ms", level.alias("__level"))
    used = sorted(r[0] for r in m.select("__level").distinct().collect())  # LEVELS + 1 numbers at most
    m = m.select("ip", "name", "cached_ms", "expires_ms", "__level", F.explode(F.sequence(span(F.col("cached_ms")), span(F.col("expires_ms")))).alias("__span"))
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    looked = rows.select("__row", "ip", "ts_ms", F.explode(F.array(*[F.lit(x) for x in used]) if used else F.array().cast("array<int>")).alias("__level")).withColumn("__span", span(F.col("ts_ms")))
    both = looked.join(m, ["ip", "__level", "__span"]).where("cached_ms <= ts_ms AND ts_ms <= expires_ms")
    best = both.groupBy("__row").agg(F.max(F.struct("cached_ms", "name"))["name"].alias("name"))
    return rows.join(best, "__row", "left").select(*df.columns, "name")
