"""Token pricing: rate lookup, long-context rates, cost legs, session-wide repricing, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICING_VERSION = 2
SYNTHETIC = "<synthetic>"
# Dollars per million tokens, (input, output).
CLAUDE = {
    "claude-fable-5": (10.0, 50.0),
    "claude-opus-4-8": (5.0, 25.0),
    "claude-opus-4-7": (5.0, 25.0),
    "claude-opus-4-6": (5.0, 25.0),
    "claude-opus-4-5": (5.0, 25.0),
    "claude-opus-4-5-20251101": (5.0, 25.0),
    "claude-opus-4-1": (15.0, 75.0),
    "claude-opus-4-20250514": (15.0, 75.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-sonnet-4-5": (3.0, 15.0),
    "claude-sonnet-4-5-20250929": (3.0, 15.0),
    "claude-sonnet-4-20250514": (3.0, 15.0),
    "claude-haiku-4-5": (1.0, 5.0),
    "claude-haiku-4-5-20251001": (1.0, 5.0),
    "claude-haiku-3-5": (0.8, 4.0),
    "claude-haiku-3": (0.25, 1.25),
    "claude-opus-3-20240229": (15.0, 75.0),
    "claude-sonnet-3-7": (3.0, 15.0),
    "claude-sonnet-3-5-20241022": (3.0, 15.0),
}
# Cache writes for 5 minutes and 1 hour and cache reads, where they aren't 1.25, 2 and 0.1 times the input rate.
CACHE_EXCEPTIONS = {"claude-haiku-3": (0.30, 0.50, 0.03)}
# Fast mode's (input, output).
FAST = {"claude-opus-4-6": (30.0, 150.0)}
# Fixed values: (input, cached input, output).
GPT = {
    "gpt-5": (1.25, 0.125, 10.0),
    "gpt-5.1": (1.25, 0.125, 10.0),
    "gpt-5.2": (1.75, 0.175, 14.0),
    "gpt-5.3-codex": (1.75, 0.175, 14.0),
    "gpt-5.2-codex": (1.75, 0.175, 14.0),
    "gpt-5.1-codex-max": (1.25, 0.125, 10.0),
    "gpt-5.1-codex": (1.25, 0.125, 10.0),
    "gpt-5-codex": (1.25, 0.125, 10.0),
    "gpt-5.1-codex-mini": (0.25, 0.025, 2.0),
    "codex-mini-latest": (1.5, 0.375, 6.0),
    "gpt-5.5": (5.0, 0.5, 30.0),
    "gpt-5.5-pro": (30.0, 0.0, 180.0),
    "gpt-5.4": (2.5, 0.25, 15.0),
    "gpt-5.4-mini": (0.75, 0.075, 4.5),
    "gpt-5.4-nano": (0.2, 0.02, 1.25),
    "gpt-5.4-pro": (30.0, 0.0, 180.0),
}
# Models with long-context rates, from more than so many prompt tokens on, times so much for input legs and for output.
LONG_CONTEXT = ["gpt-5.5", "gpt-5.5-pro", "gpt-5.4", "gpt-5.4-pro"]
LONG_THRESHOLD, LONG_INPUT, LONG_OUTPUT = 272_000, 2.0, 1.5
# What an unlisted model of a family is priced as.
NEWEST_BY_PREFIX = {"claude-fable-": "claude-fable-5", "claude-opus-": "claude-opus-4-8", "claude-sonnet-": "claude-sonnet-4-6", "claude-haiku-": "claude-haiku-4-5"}

RATE_COLUMNS = "rate_model string, r_in double, r_out double, r_5m double, r_1h double, r_read double, r_fast_in double, r_fast_out double, r_threshold long"
TOKENS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_1h", "cache_5m", "cache_read"]
LEGS = ["input_cost", "output_cost", "cache_1h_cost", "cache_5m_cost", "cache_read_cost"]


def rate_rows() -> list[tuple]:
    out = []
    for model, (i, o) in CLAUDE.items():
        m5, h1, read = CACHE_EXCEPTIONS.get(model, (round(i * 1.25, 6), i * 2, round(i * 0.1, 6)))
        out.append((model, i, o, m5, h1, read, *FAST.get(model, (None, None)), None))
    out += [(model, i, o, 0.0, 0.0, read, None, None, LONG_THRESHOLD if model in LONG_CONTEXT else None) for model, (i, read, o) in GPT.items()]
    return out


def rates(spark) -> DataFrame:
    return spark.createDataFrame(rate_rows(), RATE_COLUMNS)


def priced_as(model: Column) -> Column:
    """The listed model whose rates apply: the model itself, the newest of its family, or null."""
    out = F.when(model.isin([*CLAUDE, *GPT]), model)
    for prefix, newest in NEWEST_BY_PREFIX.items():
        out = out.when(model.startswith(prefix), F.lit(newest))
    return out


def billable(model: Column) -> Column:
    return model.isNotNull() & (model != SYNTHETIC)


def split_cache_writes(flat: Column, hour: Column, five: Column) -> tuple[Column, Column]:
    """One-hour and five-minute parts: the reported parts if either is above 0, else all of it counts as five-minute."""
    reported = (F.coalesce(hour, F.lit(0)) > 0) | (F.coalesce(five, F.lit(0)) > 0)
    zero = F.lit(0).cast("long")
    return F.when(reported, F.coalesce(hour, zero)).otherwise(zero), F.when(reported, F.coalesce(five, zero)).otherwise(F.coalesce(flat, zero))


def prompt_tokens() -> Column:
    return F.col("input_tokens") + F.col("cache_1h") + F.col("cache_5m") + F.col("cache_read")


def cache_efficiency() -> Column:
    return F.try_divide(F.col("cache_read"), prompt_tokens())


def price(requests: DataFrame, session_wide: bool = True) -> DataFrame:
    """Adds priced_as, five cost legs and cost_usd; all null where there is no price. With ``session_wide``, one
    request over the threshold puts all requests of that model in the session on long-context rates.

    The rates are a table of fixed size, so their join is a broadcast; repricing is one window over (session, model)."""
    named = requests.withColumn("priced_as", F.when(F.col("model") != SYNTHETIC, priced_as(F.col("model"))))
    joined = named.join(F.broadcast(rates(requests.sparkSession)), F.col("priced_as") == F.col("rate_model"), "left")
    long = F.coalesce(prompt_tokens() > F.col("r_threshold"), F.lit(False))
    if session_wide:
        long = F.bool_or(long).over(Window.partitionBy("session_id", "model"))
    flagged = joined.withColumn("_long", long)
    up, out = F.when(F.col("_long"), LONG_INPUT).otherwise(1.0), F.when(F.col("_long"), LONG_OUTPUT).otherwise(1.0)
    fast = F.coalesce(F.col("speed") == "fast", F.lit(False))
    unpriced = F.col("rate_model").isNull() | (fast & F.col("r_fast_in").isNull())
    million = F.lit(1_000_000.0)
    leg = lambda tokens, rate: F.when(~unpriced, tokens / million * rate)
    costs = [
        leg(F.col("input_tokens"), F.when(fast, F.col("r_fast_in")).otherwise(F.col("r_in")) * up),
        leg(F.col("output_tokens") + F.col("reasoning_tokens"), F.when(fast, F.col("r_fast_out")).otherwise(F.col("r_out")) * out),
        leg(F.col("cache_1h"), F.col("r_1h") * up),
        leg(F.col("cache_5m"), F.col("r_5m") * up),
        leg(F.col("cache_read"), F.col("r_read") * up),
    ]
    priced = flagged.select(*requests.columns, "priced_as", *(c.alias(n) for c, n in zip(costs, LEGS, strict=True)))
    return priced.withColumn("cost_usd", sum((F.col(c) for c in LEGS[1:]), F.col(LEGS[0])))


def confidence() -> Column:
    """Per request: unavailable without a model, a rate or a cost, notBillable if synthetic, else exact."""
    return F.when(F.col("model").isNull(), "unavailable").when(F.col("model") == SYNTHETIC, "notBillable").when(F.col("priced_as").isNull() | F.col("cost_usd").isNull(), "unavailable").otherwise("exact")


def confidence_of_many(billable: Column, unavailable: Column) -> Column:
    """Of a session, from how many requests are billable and how many of them have no price."""
    return F.when(billable <= 0, "notBillable").when(unavailable == 0, "exact").when(unavailable >= billable, "unavailable").otherwise("partial")
