"""Temporal list join: every capture is judged by the list entries in force when it was fetched.

Dated entries (domain, action, since) become validity intervals: an entry holds until the
next one of its domain. A capture is judged by the most specific suffix of its host that
has an entry in force; without one it is allowed.

The list is joined to the distinct hosts, and the hosts' intervals, one row for each host,
are written and joined to the captures; of a host with a third of all captures Spark splits
the partition. The list is broadcast only if it has at most BROADCAST_ENTRIES rows, which is
counted; else that join shuffles too.

Edge cases: a null or host-less url, or a null fetch time, is undecided (action null,
blocked false). Entries with a null domain, action or date are ignored. Of entries of one
domain and date, "block" wins; repeated entries count once. Repeated captures are judged
alike. Extra columns of captures are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BROADCAST_ENTRIES = 20_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    found = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """domain, action, since, until (null: still in force)."""
    known = entries.where("domain IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL")
    # block sorts after allow
    once = known.groupBy(F.lower("domain").alias("domain"), "since").agg(F.max("action").alias("action"))
    return once.withColumn("until", F.lead("since").over(Window.partitionBy("domain").orderBy("since")))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, matched domain, action, the entry's date and blocked."""
    held = intervals(entries)
    small = entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    own = [c for c in captures.columns if c not in ("host", "domain", "action", "since", "blocked")]
    seen = captures.select(*own).withColumn("host", host(F.col(url)))
    hosts = seen.where("host IS NOT NULL").select("host").distinct()
    parts = F.split("host", r"\.")
    levels = hosts.select("host", F.explode(F.expr(r"transform(sequence(1, size(split(host, '\\.'))), i -> array_join(slice(split(host, '\\.'), i, size(split(host, '\\.'))), '.'))")).alias("domain"), F.size(parts).alias("n"))
    matched = levels.join(F.broadcast(held) if small else held, "domain")
    entry = F.struct((-F.size(F.split("domain", r"\."))).alias("level"), "since", "until", "domain", "action")
    # bounded by the entries of one host's suffixes
    # written, so that the join's two sides are plain shuffles and Spark can split a host with a third of all captures
    lists = stored(matched.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("_entries")), "lists")
    at = F.col(fetched)
    out = seen.join(lists, "host", "left").withColumn("_hit", F.try_element_at(F.filter("_entries", lambda e: (e["since"] <= at) & (e["until"].isNull() | (at < e["until"]))), F.lit(1)))
    action = F.when(F.col("host").isNotNull() & at.isNotNull(), F.coalesce("_hit.action", F.lit("allow")))
    return out.select(*own, "host", F.col("_hit.domain").alias("domain"), action.alias("action"), F.col("_hit.since").alias("since"), F.coalesce(action == "block", F.lit(False)).alias("blocked"))
