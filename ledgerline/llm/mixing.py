"""Mixing sources to target weights.

Words are counted for every document; each source's target follows from its weight; every document is taken
floor(rate) times and once more if a hash of its id and text falls below the fraction of the rate, so reruns agree.

Null texts have size 0. Null is a source of its own, the last. Rows that share doc_id and text share their draw, nulls
being as empty ones; rows that share one of them do not, so a source of many texts under one id, or none, still comes near
its target. Sources without any word have target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import count_words, saved

MAX_REPEATS = 3


def source_rates(sized: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    ``sized`` has source and size. Without ``weights`` (source, weight) sources in code point order, null last, weigh
    1, 2, 3 and so on in turn. A target is weight * level, cut at MAX_REPEATS times the source's size; the level that
    shares out everything is found in one ordered pass over the sources, from the first that hits its cap. The
    windows are over one row per source, never over documents."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        totals = totals.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))
    else:
        named = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
        totals = totals.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cap = (MAX_REPEATS * F.col("source_size")).cast("double")
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = totals.withColumn("cap", cap)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = capped.withColumn("level", left / free)
    at = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "source", "level"))).over(everything)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(at["level"], F.lit(float("inf"))))
    out = levels.withColumn("target", target)
    return out.select("source", "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))


def copies(rate, doc_id, text):
    """floor(rate), and one more by a draw from the hash of id and text."""
    named = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text.cast("string"), F.lit(""))))
    draw = F.conv(F.substring(named, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def with_rates(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Each row of ``docs`` as a struct, row, with its size, source_size, target and copies. Only source and size are
    aggregated, and the rates of the sources are written out, so the join back broadcasts them if they prove small and
    shuffles else."""
    sized = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"))
    rates = saved(source_rates(sized.select("source", "size"), weights))
    rates = rates.select(F.coalesce("source", F.lit("")).alias("named"), F.col("source").isNull().alias("unnamed"), "source_size", "target", "rate")
    both = sized.join(rates, (F.coalesce("source", F.lit("")) == F.col("named")) & (F.col("source").isNull() == F.col("unnamed")))
    return both.select("row", "size", "source_size", "target", copies(F.col("rate"), F.col("row.doc_id"), F.col("row.text")).alias("copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Every document as often as its source's rate says; columns as in ``docs``, and copy (from 0), which takes the
    place of a column of that name."""
    taken = with_rates(docs, weights).where("copies > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "copy"), "copy")


def op7_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return with_rates(docs).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def rates_sql(docs: str) -> str:
    """The tables sized and rates of DuckDB over a relation with doc_id, text and source."""
    return rf"""sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM {docs}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST({MAX_REPEATS} * source_size AS DOUBLE) AS cap FROM totals),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level FROM weighted
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM lvl), CAST('infinity' AS DOUBLE))) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate FROM targets),
mixed AS (SELECT s.*, r.source_size, r.target, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)"""


OP7_SQL = f"WITH {rates_sql('documents')} SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"
