"""URL filters: a temporal join of captures with dated list entries.

A list is a table of dated entries (key, action, effective): from its date on, an entry
blocks or allows a domain (with its subdomains), a host, or a host's first path segment, or
removes what stood for that key. Entries become validity intervals, each up to the next
entry of its key. Every capture is then joined with the intervals of its own keys that are
active when it was fetched, and the most specific (longest) key decides.

All of it is DataFrame functions. The captures' side may have hot hosts: the join is an
equality on the key with a range check, which Spark broadcasts if the list is small by its
statistics, and else sorts and splits where skewed. No capture is collected by host.

Defined cases: a URL that is null, empty or without a host has no keys and is kept; a null
fetch time matches nothing; entries without key or date are ignored; of entries with equal
key and date, block stands before allow before remove; repeated captures are judged each;
empty tables are allowed; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: An optional user part is skipped; group 1 is the host, group 2 the first path segment.
URL = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?(?:/([^/?#]*))?"


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (key, action, since, until) of dated entries; until is exclusive, null if open."""
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    dated = entries.where(F.col("key").isNotNull() & F.col("effective").isNotNull()).groupBy(F.lower("key").alias("key"), "effective").agg(F.min_by("action", rank).alias("action"))
    ends = dated.withColumn("until", F.lead("effective").over(Window.partitionBy("key").orderBy("effective")))
    return ends.where(F.col("action").isin("block", "allow")).select("key", "action", F.col("effective").alias("since"), "until")


def host_of(url: Column) -> Column:
    """The lower-case host without a final dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), URL, 1), r"\.$", ""), F.lit(""))


def url_keys(host: Column, segment: Column) -> Column:
    """The host's suffixes of two labels and more (or its only label), and host/segment."""
    labels = F.split(host, r"\.")
    suffixes = F.when(F.size(labels) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.when(segment != "", F.concat(suffixes, F.array(F.concat(host, F.lit("/"), segment)))).otherwise(suffixes)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Judge captures (page_id, url, fetched_at).

    Returns a row for each capture: page_id, host, fetched_at, n_active (entries active for
    it), matched_key and action of the most specific one, kept.
    """
    valid = intervals(entries)
    rows = captures.select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        "fetched_at",
        host_of(F.col("url")).alias("host"),
        F.regexp_extract(F.lower("url"), URL, 2).alias("segment"),
    )
    keyed = rows.select("row", "page_id", "fetched_at", "host", F.explode_outer(url_keys(F.col("host"), F.col("segment"))).alias("k"))
    active = (F.col("k") == F.col("key")) & (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    found = keyed.join(valid, active, "left")
    best = F.max(F.when(F.col("key").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("action").alias("action")))).alias("best")
    judged = found.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("fetched_at").alias("fetched_at"), F.count("key").alias("n_active"), best)
    kept = F.coalesce(F.col("best.action") != "block", F.lit(True))
    return judged.select("page_id", "host", "fetched_at", "n_active", F.col("best.key").alias("matched_key"), F.col("best.action").alias("action"), kept.alias("kept"))
