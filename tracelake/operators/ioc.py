"""Indicator matching: what artifacts mention, joined with feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import address_indicator, domain_indicator, labelled_hashes
from tracelake.operators.store import first_writer

#: Types that can carry an indicator, and what a hit of each kind is worth.
SCOPE = ["event_log", "memory_network", "memory_process", "memory_cmdline", "memory_yara_hit", "browser_visit", "browser_download", "srum_network", "amcache_file", "network_connection", "yara_file_hit", "auditd", "journal", "process"]
KINDS = {"sha256": ("critical", 90, "T1204.002"), "sha1": ("critical", 85, "T1204.002"), "md5": ("high", 65, "T1204.002"), "ip": ("high", 60, "T1071.001"), "domain": ("high", 60, "T1071.004")}
PER_FEED, HIGHEST = 5, 95
#: A merged feed of at most this many indicators may be broadcast.
SMALL_FEED = 200_000


def _key(*parts: str) -> Column:
    return F.try_variant_get("v__", "$" + "".join(f"['{p}']" for p in parts), "string")


def mentioned(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, case_id, artifact_type, timestamp_utc, kind, value): every indicator that an artifact in scope mentions."""
    rows = artifacts.where(F.col("artifact_type").isin(SCOPE)).withColumn("v__", F.try_parse_json("raw_data"))
    pay = lambda k: _key("_enrich", "payload", k)
    blob = F.coalesce(F.nullif(pay("Hashes"), F.lit("")), pay("Hash"))
    single = F.array_compact(F.array(*[F.when(_key(k).isNotNull(), F.concat(F.lit(f"{k}="), _key(k))) for k in ("SHA1", "SHA256", "MD5", "sha1", "sha256", "md5")]))
    hashes = F.concat(labelled_hashes(blob), labelled_hashes(F.array_join(single, ",")))
    addresses = [address_indicator(c) for c in (pay("DestinationIp"), pay("SourceIp"), _key("ForeignAddr"), _key("remote"), _key("Destination Addr"), _key("DestinationIp"))]
    domains = [domain_indicator(c) for c in (pay("QueryName"), pay("DestinationHostname"), pay("QueryResults"), _key("url"), _key("host"), _key("QueryName"), _key("original_path"))]
    every = F.array_distinct(F.concat(hashes, F.array_compact(F.array(*addresses, *domains))))
    return rows.select("artifact_id", "case_id", "artifact_type", "timestamp_utc", F.inline(every))


def merge_feeds(entries: DataFrame) -> DataFrame:
    """(kind, value, feeds): each indicator once, with every feed that lists it; ``entries`` has kind, value, feed, date."""
    return entries.groupBy("kind", "value").agg(F.array_sort(F.collect_set(F.struct("feed", "date"))).alias("feeds"))


def match(artifacts: DataFrame, feeds: DataFrame) -> DataFrame:
    """Detections of artifacts that mention a listed indicator: one for each (artifact, kind), the smallest value."""
    found = mentioned(artifacts)
    small = feeds.limit(SMALL_FEED + 1).count() <= SMALL_FEED
    hits = found.join(F.broadcast(feeds) if small else feeds, ["kind", "value"])
    hits = first_writer(hits, ["artifact_id", "kind"], "value")
    n = F.size("feeds")
    pick = lambda i: F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("kind"))
    title = F.when(n == 1, F.concat(F.lit("Known-bad "), F.col("kind"), F.lit(" listed by "), F.col("feeds")[0]["feed"])).otherwise(F.concat(F.lit("Known-bad "), F.col("kind"), F.lit(" listed by "), n.cast("string"), F.lit(" independent feeds")))
    names = F.array_join(F.transform("feeds", lambda f: F.concat(f["feed"], F.lit(" ("), F.coalesce(f["date"], F.lit("undated")), F.lit(")"))), ", ")
    said = F.concat(F.col("kind"), F.lit("="), F.col("value"), F.lit(" | feeds: "), names, F.lit(" | "), F.col("artifact_type"))
    return hits.select("artifact_id", "case_id", F.lit("ioc").alias("engine"), F.concat(F.lit("IOC-"), F.upper("kind")).alias("rule_id"), title.alias("rule_title"), pick(0).alias("severity"), F.least(pick(1) + PER_FEED * (n - 1), F.lit(HIGHEST)).cast("int").alias("score"), F.array(pick(2)).alias("attack"), said.alias("matched_on"))


def summary(detections: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Indicator hits by score, then time."""
    mine = detections.where(F.col("engine") == "ioc").join(artifacts.select("artifact_id", "host", "timestamp_utc", "description"), "artifact_id")
    return mine.orderBy(F.desc("score"), F.col("timestamp_utc").asc_nulls_last(), "artifact_id")
