"""URL filters by a temporal join with dated list entries.

A list's history is a table of dated entries: on ``day`` the ``pattern`` was
added to or removed from ``list``. The last entry of a day is the pattern's state
from that day on, so the history of one pattern is at most one row per day
however often it was changed, and a window over it is bounded by the calendar.
Neighbouring states give validity intervals, half open in days.

A capture is judged by the intervals that hold its day: its URL gives the keys
that a pattern could have, keys and intervals meet on pattern and month, and the
day decides. Only distinct pairs of URL and day are looked up; the verdicts then
go back to all captures, so a URL that a third of them share is judged once.

A pattern without a slash is a domain and covers its subdomains; one with a
slash is a host and the first segments of a path. ``allow`` lists beat ``block``
lists. Everything is an expression of Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and last dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def segments_of(url: Column) -> Column:
    """The segments of a URL's path, without empty ones."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*/([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def keys_of(url: Column, depth: int, tops: bool = True) -> Column:
    """The patterns that cover ``url``: its host, all domains above it, the host with 1 to ``depth`` path segments.

    Without ``tops`` domains of one label are left out unless they are a host.
    """
    host, parts = host_of(url), segments_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = domains if tops else F.filter(domains, lambda d: d.contains(".") | (d == host))
    n = F.least(F.size(parts), F.lit(depth))
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    paths = F.when(n > 0, prefixes).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def folded(pattern: Column) -> Column:
    """The pattern with its host in lower case; a path keeps its case."""
    host = F.regexp_extract(pattern, "^[^/]*", 0)
    return F.concat(F.lower(host), F.substring(pattern, F.length(host) + 1, F.length(pattern)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, begin, end) of the days from which and before which each pattern was listed.

    ``entries`` has list, kind (allow or block), pattern, day, seq and action
    (add or remove). Of one day's entries the one with the largest seq counts,
    then a removal. Entries without pattern or day, or with another action, say
    nothing. ``end`` is null where the pattern is still listed.
    """
    daily = (
        entries.where("pattern is not null and day is not null and action in ('add', 'remove')")
        .groupBy("list", "kind", folded(F.col("pattern")).alias("pattern"), F.to_date("day").alias("day"))
        .agg(F.max(F.struct("seq", "action"))["action"].alias("action"))
    )
    own = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    changes = daily.withColumn("before", F.lag("action").over(own)).where("before is null or before <> action")
    return changes.withColumn("end", F.lead("day").over(own)).where("action = 'add'").select("list", "kind", "pattern", F.col("day").alias("begin"), "end")


def month_no(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds n_active, lists (sorted names), pattern and blocked to every capture (url, day and any other columns).

    ``n_active`` is the number of intervals that hold the capture's day and cover
    its URL; ``pattern`` is the longest of the winning kind, then the first in
    order. A null URL or day, and a URL without a host, meets no entry. Repeated
    captures give repeated rows; columns of ``captures`` that have a result's
    name are replaced; empty tables give no rows or no hits.
    """
    listed = cut(intervals(entries), "intervals")
    # a domain that all captures have in common is a key only if some entry lists such a one
    depth, tops = listed.agg(F.max(F.size(F.split("pattern", "/"))) - 1, F.max(~F.col("pattern").rlike("[./]"))).first()
    kept = [c for c in captures.columns if c not in ("n_active", "lists", "pattern", "blocked")]
    distinct = cut(captures.where("url is not null and day is not null").select("url", F.to_date("day").alias("day")).distinct(), "url-days")
    first, last = distinct.agg(F.min("day"), F.max("day")).first()
    keyed = distinct.select("url", "day", F.explode(keys_of(F.col("url"), int(depth or 0), bool(tops))).alias("key")).withColumn("month", month_no(F.col("day")))
    # an interval is cut at the captures' first and last day, so an open one has no more months than they span
    first_day, last_day = F.lit(first).cast("date"), F.lit(last).cast("date")
    begin, end = F.greatest("begin", first_day), F.least(F.coalesce(F.date_sub("end", 1), last_day), last_day)
    monthly = listed.where(begin <= end).withColumn("month", F.explode(F.sequence(month_no(begin), month_no(end))))
    hits = keyed.join(monthly, (keyed["key"] == monthly["pattern"]) & (keyed["month"] == monthly["month"]) & (keyed["day"] >= monthly["begin"]) & (monthly["end"].isNull() | (keyed["day"] < monthly["end"])))
    verdicts = hits.groupBy("url", "day").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.array_sort(F.collect_set("list")).alias("lists"),
        # allow comes before block; of a kind the longest pattern, then the first in order
        F.min(F.struct("kind", (-F.length("pattern")).alias("shortness"), "pattern")).alias("best"),
    )
    left = captures.select(*kept).withColumn("_day", F.to_date("day"))
    v = verdicts.select(F.col("url").alias("_url"), F.col("day").alias("_on"), "n_active", "lists", "best")
    joined = left.join(v, (left["url"] == v["_url"]) & (left["_day"] == v["_on"]), "left")
    return joined.select(
        *[F.col(c) for c in kept],
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
        F.col("best.pattern").alias("pattern"),
        F.coalesce(F.col("best.kind") == "block", F.lit(False)).alias("blocked"),
    )
