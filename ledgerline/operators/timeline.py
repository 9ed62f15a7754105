"""Usage over time: gap-filled buckets, roll-ups, averages and changes between periods.

Buckets are keyed by the timestamp they begin at; the scaffold of empty buckets is a sequence made by Spark, so nothing
but bucket rows is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.periods import week_start
from ledgerline.functions.pricing import TOKENS
from ledgerline.operators.reports import billed, in_range

#: Most buckets that a chart shows, by unit, for those who ask for it (``most``).
CHART_CAPS = {"hour": 24 * 93, "day": 3650, "week": 520, "month": 120}
COUNTS = ["sessions", "turns", "requests", "tokens"]


def bucket_start(at: Column, unit: str, first_weekday: int = 0) -> Column:
    if unit == "week":
        return week_start(at, first_weekday).cast("timestamp_ntz")
    return F.date_trunc(unit, at).cast("timestamp_ntz")


def _counted(priced: DataFrame, sessions: DataFrame, turns: DataFrame, unit: str, start, end, reasoning: bool) -> DataFrame:
    """One row per bucket with activity. The three sources are aggregated apart and then added up, so no join fans out."""
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    used = [c for c in TOKENS if reasoning or c != "reasoning_tokens"]
    tokens = sum((F.col(c) for c in used), zero)
    paid = in_range(billed(priced), start, end).select(bucket_start(F.col("timestamp"), unit).alias("bucket"), F.coalesce("cost_usd", none).alias("cost_usd"), zero.alias("sessions"), zero.alias("turns"), F.lit(1).cast("long").alias("requests"), tokens.alias("tokens"))
    begun = lambda df, column, s, t: in_range(df.where(F.col(column).isNotNull()), start, end, column).select(bucket_start(F.col(column), unit).alias("bucket"), none.alias("cost_usd"), F.lit(s).cast("long").alias("sessions"), F.lit(t).cast("long").alias("turns"), zero.alias("requests"), zero.alias("tokens"))
    rows = paid.unionByName(begun(sessions, "started", 1, 0)).unionByName(begun(turns, "start_time", 0, 1))
    return rows.groupBy("bucket").agg(F.sum("cost_usd").alias("cost_usd"), *(F.sum(c).alias(c) for c in COUNTS))


def gap_filled(buckets: DataFrame, unit: str, start=None, end=None, most: int | None = None) -> DataFrame:
    """All buckets from the first to the last, or from ``start`` to ``end``, with zeros where nothing happened; the first
    ``most`` of them, or all."""
    spark = buckets.sparkSession
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    ends = buckets.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    if start is not None and end is not None:
        both = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("lo"), F.lit(end).cast("timestamp_ntz").alias("hi"))
        ends = both.select(bucket_start(F.col("lo"), unit).alias("lo"), bucket_start(F.col("hi"), unit).alias("hi"))
    every_one = F.sequence("lo", "hi", step)
    every = ends.where("lo <= hi").select(F.explode(every_one if most is None else F.slice(every_one, 1, most)).alias("bucket"))
    filled = every.join(buckets, "bucket", "left")
    return filled.select("bucket", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))


def timeline(priced: DataFrame, sessions: DataFrame, turns: DataFrame, unit: str = "day", start=None, end=None, reasoning: bool = False, most: int | None = None) -> DataFrame:
    """bucket, cost_usd, sessions, turns, requests and tokens. Weeks and months are roll-ups of days. ``most`` bounds the
    hours or days of a series, for charts (CHART_CAPS)."""
    base = unit if unit in ("day", "hour") else "day"
    daily = gap_filled(_counted(priced, sessions, turns, base, start, end, reasoning), base, start, end, most)
    return daily if base == unit else roll_up(daily, unit)


def roll_up(daily: DataFrame, unit: str, first_weekday: int = 0) -> DataFrame:
    key = bucket_start(F.col("bucket"), unit, first_weekday).alias("bucket")
    return daily.groupBy(key).agg(F.sum("cost_usd").alias("cost_usd"), *(F.sum(c).alias(c) for c in COUNTS))


def with_averages(buckets: DataFrame) -> DataFrame:
    """Cost by session, turn and token; null where there are none."""
    return buckets.select("*", *(F.try_divide("cost_usd", c).alias(f"cost_per_{c[:-1]}") for c in ("sessions", "turns", "tokens")))


def period_totals(buckets: DataFrame) -> DataFrame:
    """Sums over all buckets, and ratios of those sums (not means of ratios)."""
    return with_averages(buckets.agg(F.sum("cost_usd").alias("cost_usd"), *(F.sum(c).alias(c) for c in COUNTS)))


def changes(buckets: DataFrame) -> DataFrame:
    """Each bucket's change in cost against the one before, in percent; null where that was 0 or is missing. Buckets are
    one row per period, so a single ordered window holds no more than there are periods."""
    before = F.lag("cost_usd").over(Window.orderBy("bucket"))
    return buckets.withColumn("delta_percent", F.when(before != 0, (F.col("cost_usd") - before) / before * 100))


def latest_change(buckets: DataFrame) -> DataFrame:
    return changes(buckets).orderBy(F.desc("bucket")).limit(1)


def today_total(priced: DataFrame, pending: DataFrame, midnight) -> DataFrame:
    """Cost since midnight, and whether no source is pending."""
    cost = in_range(billed(priced), midnight).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    return cost.withColumn("complete", pending.agg(F.count("*")).scalar() == 0)


def latched(snapshots: DataFrame) -> DataFrame:
    """Snapshots (source, at, day, cost_usd, complete) as they are shown: once a day's total was complete, later ones of that
    day count as complete, while lines that just came are read."""
    so_far = Window.partitionBy("source", "day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return snapshots.withColumn("complete", F.bool_or("complete").over(so_far))
