"""Rate-limit efficiency: how much of a limit a dollar used, by hour, with shrinkage and anomaly callouts.

Samples and request costs of one account meet in time order. The cost between two samples is a difference of running
sums, so there is no range join. Both series are keyed by account; the windows run inside an account and its part of
time, and running sums are made in two steps (inside a day, then over the days' totals), so that one busy account is
spread over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP_HOURS = 4
MIN_COST = 0.001
MIN_DELTA = 1e-6
SHRINKAGE = 10.0
MIN_SAMPLES, MIN_BUCKETS = 5, 3
HIGH, LOW = 1.5, 0.6


def canonical(samples: DataFrame) -> DataFrame:
    """``samples`` has account, ts, used and resets_at. Used becomes the greatest so far, starting anew whenever
    resets_at differs from the sample before; of equal levels in a row the first stays."""
    order = Window.partitionBy("account").orderBy("ts", "used")
    changed = F.coalesce(F.lag("resets_at").over(order) != F.col("resets_at"), F.lit(True)).cast("int")
    marked = samples.where("used is not null").withColumn("island", F.sum(changed).over(order))
    inside = Window.partitionBy("account", "island").orderBy("ts", "used")
    level = F.max("used").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    levels = marked.withColumn("level", level)
    last = F.lag("level").over(inside)
    kept = levels.withColumn("_last", last).where(F.col("_last").isNull() | (F.abs(F.col("level") - F.col("_last")) >= MIN_DELTA))
    return kept.select("account", "ts", "resets_at", F.col("level").alias("used"))


def cost_up_to(points: DataFrame, costs: DataFrame) -> DataFrame:
    """``points`` (account, ts, ...) with the account's cost up to and including ts. Days are summed apart; a day's
    offset is the total of the days before it, one row per account and day."""
    names = [c for c in points.columns if c not in ("account", "ts")]
    day = F.col("ts").cast("date").alias("_day")
    both = costs.select("account", "ts", day, F.col("cost_usd").alias("_c"), F.lit(0).alias("_point"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in names))
    both = both.unionByName(points.select("account", "ts", day, F.lit(0.0).alias("_c"), F.lit(1).alias("_point"), *names))
    inside = Window.partitionBy("account", "_day").orderBy("ts", "_point").rowsBetween(Window.unboundedPreceding, 0)
    running = both.withColumn("_inside", F.sum("_c").over(inside)).where("_point = 1")
    days = both.groupBy("account", "_day").agg(F.sum("_c").alias("_total"))
    before = Window.partitionBy("account").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select("account", "_day", F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_before"))
    return running.join(offsets, ["account", "_day"]).select("account", "ts", *names, (F.col("_before") + F.col("_inside")).alias("cost_so_far"))


def ratio_pairs(samples: DataFrame, costs: DataFrame, cutoff=None, strict: bool = False) -> DataFrame:
    """account, ts (of the later sample), d_limit, d_cost and ratio of each usable pair of samples. ``strict`` also
    leaves out rises under MIN_DELTA. Inputs from ``cutoff`` on count."""
    if cutoff is not None:
        samples, costs = samples.where(F.col("ts") >= F.lit(cutoff)), costs.where(F.col("ts") >= F.lit(cutoff))
    summed = cost_up_to(canonical(samples).select("account", "ts", "used"), costs.select("account", "ts", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")))
    order = Window.partitionBy("account").orderBy("ts", "used")
    lagged = summed.select("account", "ts", "used", "cost_so_far", *(F.lag(c).over(order).alias(f"p_{c}") for c in ("ts", "used", "cost_so_far")))
    rise, cost = F.col("used") - F.col("p_used"), F.col("cost_so_far") - F.col("p_cost_so_far")
    gap = F.col("ts").cast("timestamp").cast("double") - F.col("p_ts").cast("timestamp").cast("double")
    usable = (rise >= MIN_DELTA if strict else rise > 0) & (gap > 0) & (gap <= MAX_GAP_HOURS * 3600) & (cost >= MIN_COST)
    return lagged.where(usable).select("account", "ts", rise.alias("d_limit"), cost.alias("d_cost"), (rise / cost).alias("ratio"))


def _stats(pairs: DataFrame, key: str) -> DataFrame:
    """Statistics of each bucket, shrunk to the median over all pairs. The medians are two numbers per account."""
    inverse = 1 / F.col("ratio")
    mids = pairs.groupBy("account").agg(F.percentile("ratio", F.lit(0.5)).alias("mid"), F.percentile(inverse, F.lit(0.5)).alias("mid_inverse"))
    own = pairs.groupBy("account", key).agg(
        F.count("*").alias("samples"), F.sum("d_cost").alias("cost_usd"), F.sum("d_limit").alias("limit_used"),
        F.avg("ratio").alias("mean_ratio"), F.percentile("ratio", F.lit(0.5)).alias("p50_ratio"), F.percentile("ratio", F.lit(0.9)).alias("p90_ratio"), F.sum("ratio").alias("_sum"),
        F.avg(inverse).alias("dollars_mean"), F.percentile(inverse, F.lit(0.5)).alias("dollars_p50"), F.percentile(inverse, F.lit(0.1)).alias("dollars_p10"), F.sum(inverse).alias("_sum_inverse"),
    )
    shrunk = lambda total, mid: (F.col(total) + SHRINKAGE * F.col(mid)) / (F.col("samples") + SHRINKAGE)
    out = own.join(mids, "account")
    return out.select(*(c for c in own.columns if c[0] != "_"), shrunk("_sum", "mid").alias("shrunk_ratio"), shrunk("_sum_inverse", "mid_inverse").alias("dollars_shrunk"))


def _zero_filled(scaffold: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    both = scaffold.join(stats, ["account", key], "left")
    return both.select("account", key, *(F.coalesce(c, F.lit(0)).cast(stats.schema[c].dataType).alias(c) for c in stats.columns if c not in ("account", key)))


def by_hour_of_day(samples: DataFrame, costs: DataFrame, now=None, days: int = 14) -> DataFrame:
    """24 rows per account. An hour without a pair has zeros only."""
    from datetime import timedelta

    pairs = ratio_pairs(samples, costs, None if now is None else now - timedelta(days=days)).withColumn("hour", F.hour("ts"))
    hours = samples.select("account").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return _zero_filled(hours, _stats(pairs, "hour"), "hour")


def by_hour(samples: DataFrame, costs: DataFrame, now, hours: int = 168) -> DataFrame:
    """The last ``hours`` hours of each account, the last one that of ``now``."""
    from datetime import timedelta

    last = now.replace(minute=0, second=0, microsecond=0)
    pairs = ratio_pairs(samples, costs, last - timedelta(hours=hours), strict=True).withColumn("hour_start", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    first = F.lit(last - timedelta(hours=hours - 1)).cast("timestamp_ntz")
    every = samples.select("account").distinct().withColumn("hour_start", F.explode(F.sequence(first, F.lit(last).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR"))))
    return _zero_filled(every, _stats(pairs, "hour_start"), "hour_start")


def upper_median(values: Column) -> Column:
    """Element at n / 2 of the values in order, not interpolated."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def baselines(buckets: DataFrame, value: str = "shrunk_ratio", least: int = MIN_SAMPLES) -> DataFrame:
    """Per account the upper median of its buckets with enough samples, where there are enough of those. A bucket list
    is 24 or 168 rows, so collecting one is bounded."""
    enough = buckets.where((F.col("samples") >= least) & (F.col(value) > 0) if value != "shrunk_ratio" else F.col("samples") >= least)
    found = enough.groupBy("account").agg(F.collect_list(value).alias("_v"))
    return found.where(F.size("_v") >= MIN_BUCKETS).select("account", upper_median(F.col("_v")).alias("baseline")).where("baseline > 0")


def anomalies(buckets: DataFrame) -> DataFrame:
    """Runs of neighbouring hours that are all high or all low: account, direction, start_hour, end_hour, multiplier.
    Runs do not pass midnight."""
    against = buckets.where(F.col("samples") >= MIN_SAMPLES).join(baselines(buckets), "account").withColumn("times", F.col("shrunk_ratio") / F.col("baseline"))
    tagged = against.withColumn("direction", F.when(F.col("times") >= HIGH, "high").when(F.col("times") <= LOW, "low")).where("direction is not null")
    island = F.col("hour") - F.row_number().over(Window.partitionBy("account", "direction").orderBy("hour"))
    runs = tagged.withColumn("_island", island).groupBy("account", "direction", "_island")
    return runs.agg(F.min("hour").alias("start_hour"), F.max("hour").alias("end_hour"), F.avg("times").alias("multiplier")).drop("_island")


def bar_classes(buckets: DataFrame) -> DataFrame:
    """Dollars per percent of each bucket against the upper median of the positive ones: lenient, tight or normal."""
    held = baselines(buckets, "dollars_shrunk", 1)
    times = F.col("dollars_shrunk") / F.col("baseline")
    named = F.when((F.col("samples") == 0) | F.col("baseline").isNull(), "none").when(times >= HIGH, "lenient").when(times <= LOW, "tight").otherwise("normal")
    return buckets.join(held, "account", "left").withColumn("class", named)


def severity(used: Column) -> Column:
    return F.when(used >= 100, "exceeded").when(used >= 90, "critical").when(used >= 70, "warning").otherwise("normal")


def latest_severity(samples: DataFrame) -> DataFrame:
    latest = samples.groupBy("account").agg(F.max_by("used", F.struct("ts", "used")).alias("used"))
    return latest.withColumn("severity", severity(F.col("used")))


def snap(percent: Column) -> Column:
    """Rounds away the jitter of repeated reports."""
    return F.round(percent, 4)


def retained(samples: DataFrame, now, days: int = 30) -> DataFrame:
    """Samples that the log keeps when it is rewritten."""
    return samples.where(F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))
