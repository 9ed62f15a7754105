"""The reports by the names of their commands: each takes the tables and a period and returns a small DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import reports as R
from ledgerline.operators import search as Q
from ledgerline.operators import verify as V
from ledgerline.plans.tables import Tables, prompts


def _in(t: Tables, start, end) -> DataFrame:
    return R.in_range(t.requests, start, end)


def summary(t: Tables, start=None, end=None) -> DataFrame:
    paid = _in(t, start, end)
    totals = R.usage_totals(paid).drop("requests")
    return R.activity(paid, R.in_range(t.turns, start, end, "start_time")).crossJoin(F.broadcast(totals))  # one row each


def periods(t: Tables, unit: str, start=None, end=None, limit: int | None = None, by: str = "date") -> DataFrame:
    """Daily, weekly or monthly usage. A limit under date order keeps the latest periods, else the costliest."""
    rows = R.usage_buckets(_in(t, start, end), unit)
    if by == "date":
        return rows.orderBy("bucket") if limit is None else R.latest_periods(rows, limit)
    return R.sorted_limited(rows, "cost_usd", limit, "bucket")


def models(t: Tables, start=None, end=None, limit: int | None = None, by: str = "cost_usd") -> DataFrame:
    rows = R.model_usage(_in(t, start, end)).withColumn("avg_cost_usd", F.try_divide("cost_usd", "requests"))
    return R.sorted_limited(rows, by, limit, "model")


def projects(t: Tables, start=None, end=None, limit: int | None = None, by: str = "cost_usd") -> DataFrame:
    paid = _in(t, start, end)
    rows = R.project_aggregates(paid, t.sessions).join(R.primary_models(R.project_model_costs(paid, t.sessions), "project"), "project", "left")
    return R.sorted_limited(rows.withColumn("avg_cost_usd", F.try_divide("cost_usd", "sessions")), by, limit, "project")


def skills(t: Tables, start=None, end=None, limit: int | None = None, by: str = "cost_usd") -> DataFrame:
    ran = t.skills.join(R.in_range(t.turns, start, end, "start_time").select("session_id", "turn_id"), ["session_id", "turn_id"])
    rows = R.skill_aggregates(ran, t.steps, t.requests).join(R.primary_models(R.skill_model_costs(ran, t.steps, t.requests), "skill"), "skill", "left")
    return R.sorted_limited(rows.withColumn("cost_per_run", F.try_divide("cost_usd", "runs")), by, limit, "skill")


def top_sessions(t: Tables, start=None, end=None, limit: int = 10) -> DataFrame:
    return R.top_sessions(_in(t, start, end), t.sessions, limit)


def top_days(t: Tables, start=None, end=None, limit: int = 10) -> DataFrame:
    return R.sorted_limited(R.usage_buckets(_in(t, start, end), "day"), "cost_usd", limit, "bucket")


def search(t: Tables, query: str, limit: int = 20) -> DataFrame:
    """Sessions whose prompts match, by their best hit. As in the original report the best 500 hits are grouped."""
    return Q.session_hits(Q.index_ranked(t.postings, t.lengths, prompts(t.steps), query), limit)


def budget(t: Tables, usd: float, start=None, end=None) -> DataFrame:
    return R.total_cost(_in(t, start, end)).withColumns({"budget_usd": F.lit(float(usd)), "over_budget": F.col("cost_usd") > float(usd)})


def statusline(t: Tables, start=None, end=None) -> DataFrame:
    return R.total_cost(_in(t, start, end)).select(X.compact_cost(F.col("cost_usd")).alias("cost"))


def verify(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(report by session, divergences). The truth takes requests as their owning sessions hold them; that of provider B,
    whose lines are events of counters, is folded from them."""
    if "total_usage" in t.lines.columns:
        truth = V.counter_session_truth(t.lines)
    else:
        owned = t.requests.select(F.col("id").alias("request_id"), "session_id")
        truth = V.session_truth(t.lines.join(owned, ["request_id", "session_id"]))
    view = R.billed(t.requests).unionByName(t.requests.where("model is null or model = '<synthetic>'")).groupBy("session_id").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in V.COUNTED[1:]), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    found = V.divergences(view, truth)
    return V.report(found, view, truth), found


PERIODS = {"daily": "day", "weekly": "week", "monthly": "month"}
