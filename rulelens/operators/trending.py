"""What changed lately: trailing-window counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows modified within ``days`` (7 to 365) before ``as_of``."""
    if not 7 <= days <= 365:
        raise ValueError("days must be from 7 to 365")
    return rows.where(F.col(ts).isNotNull() & (F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))))


def top(rows: DataFrame, key: str, source: str, ts: str, k: int = 20) -> DataFrame:
    """key, n, sources (sorted, joined), last: the k most frequent keys, ties by key."""
    if not 5 <= k <= 50:
        raise ValueError("k must be from 5 to 50")
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.max(ts).alias("last"))
    return counted.orderBy(F.desc("n"), key).limit(k)


def techniques(rules: DataFrame, as_of: Column, days: int = 30, k: int = 20) -> DataFrame:
    each = recent(rules, "rule_modified_date", as_of, days).select("source", "rule_modified_date", F.explode("mitre_techniques").alias("technique"))
    return top(each, "technique", "source", "rule_modified_date", k)


def platforms(rules: DataFrame, as_of: Column, days: int = 30, k: int = 20) -> DataFrame:
    return top(recent(rules, "rule_modified_date", as_of, days).where("platform <> ''"), "platform", "source", "rule_modified_date", k)


def summary(rules: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """source, n of recent rules, and their total as source 'total'."""
    per = recent(rules, "rule_modified_date", as_of, days).groupBy("source").agg(F.count("*").alias("n"))
    return per.union(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("source"), "n"))


def windowed(events: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """window_start, event_type, n, last, users (exact) per sliding window; works on a stream that has a watermark too.

    A stream knows no distinct count, so there the users of a window are kept as a set in its state: right in every output
    mode, but a window's users must fit one task. ``windowed_append`` has no such bound.
    """
    users = F.size(F.collect_set("user_id")).cast("long") if events.isStreaming else F.count_distinct("user_id")
    out = events.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"), users.alias("users"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "last", "users")


def windowed_append(events: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """As ``windowed``, in two steps: per window, type and user, then per window and type.

    On a stream with a watermark, in append mode: each user of a window is a small state of its own, spread over all tasks
    and dropped when the watermark passes the window; a window comes out once, whole and exact. Late rows do not count.
    """
    per_user = events.groupBy(F.window("ts", width, slide), "event_type", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    out = per_user.groupBy("window", "event_type").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.count("user_id").alias("users"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "last", "users")
