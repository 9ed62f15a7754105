"""Verification: recomputes usage from raw lines by a path of its own and lists where the tables differ.

It shares no code with de-duplication and pricing on purpose, except the table of rates, which is data. Its rules differ
where the method does: of equal lines the later one stays; fast mode without fast rates costs the standard rate; there is
no reasoning leg and no session-wide repricing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.pricing import LONG_INPUT, LONG_OUTPUT, NEWEST_BY_PREFIX, RATE_COLUMNS, rate_rows

TOLERANCE = 0.001
# Divergences that are notes about estimates; all others are errors.
WARNINGS = ["missing-usage", "unknown-pricing"]
COUNTED = ["requests", "input_tokens", "output_tokens", "reasoning_tokens", "cache_1h", "cache_5m", "cache_read"]


def truth_requests(lines: DataFrame) -> DataFrame:
    """The picked line of each (session, request or line id)."""
    keyed = lines.withColumn("_k", F.coalesce(F.col("request_id").cast("string"), F.col("uuid").cast("string")))
    order = "struct(CASE WHEN stop_reason IS NULL THEN 0 ELSE 1 END, coalesce(output_tokens, 0), coalesce(input_tokens, 0), place)"
    top = keyed.groupBy("session_id", "_k").agg(F.expr(f"max({order}).place").alias("_place"))
    return keyed.join(top.withColumnRenamed("session_id", "_s").withColumnRenamed("_k", "_key"), (F.col("session_id") == F.col("_s")) & (F.col("_k") == F.col("_key")) & (F.col("place") == F.col("_place"))).drop("_s", "_key", "_place")


def truth_cost(picked: DataFrame, plain: bool = False) -> DataFrame:
    """Adds truth_cost. Rates join by exact name first, then by family. ``plain``: without long-context rates, which
    long_cost has instead."""
    spark = picked.sparkSession
    table = spark.createDataFrame(rate_rows(), RATE_COLUMNS)
    families = spark.createDataFrame([*NEWEST_BY_PREFIX.items()], "prefix string, newest string")
    named = picked.join(F.broadcast(table.select(F.col("rate_model").alias("model"), F.lit(True).alias("_listed"))), "model", "left")  # rates are a table of fixed size
    named = named.join(F.broadcast(families), F.col("_listed").isNull() & F.col("model").startswith(F.col("prefix")), "left")
    rated = named.withColumn("_m", F.when(F.col("_listed"), F.col("model")).otherwise(F.col("newest"))).join(F.broadcast(table), F.col("_m") == F.col("rate_model"), "left")
    prompt = F.expr("input_tokens + cache_1h + cache_5m + cache_read")
    over = F.lit(False) if plain else F.coalesce(prompt > F.col("r_threshold"), F.lit(False))
    up, out = F.when(over, LONG_INPUT).otherwise(1.0), F.when(over, LONG_OUTPUT).otherwise(1.0)
    fast = (F.col("speed") == "fast") & F.col("r_fast_in").isNotNull()
    r_in, r_out = F.when(fast, F.col("r_fast_in")).otherwise(F.col("r_in") * up), F.when(fast, F.col("r_fast_out")).otherwise(F.col("r_out") * out)
    cost = F.col("input_tokens") * r_in + F.col("output_tokens") * r_out + (F.col("cache_1h") * F.col("r_1h") + F.col("cache_5m") * F.col("r_5m") + F.col("cache_read") * F.col("r_read")) * up
    long_cost = (F.col("input_tokens") * F.col("r_in") + F.col("cache_read") * F.col("r_read")) * LONG_INPUT + F.col("output_tokens") * F.col("r_out") * LONG_OUTPUT
    more = [F.coalesce(long_cost / 1e6, F.lit(0.0)).alias("long_cost")] if plain else []
    return rated.select(*picked.columns, F.coalesce(cost / 1e6, F.lit(0.0)).alias("truth_cost"), *more, (F.col("_m").isNull() & F.col("model").isNotNull() & (F.col("model") != "<synthetic>")).alias("unpriced"))


def session_truth(lines: DataFrame) -> DataFrame:
    """Per session: raw_lines, picked requests, token sums, cost and unpriced lines."""
    costed = truth_cost(truth_requests(lines))
    sums = costed.groupBy("session_id").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in COUNTED[1:]), F.sum("truth_cost").alias("cost_usd"), F.count_if("unpriced").alias("unpriced"))
    raw = lines.groupBy("session_id").agg(F.count("*").alias("raw_lines"))
    return sums.join(raw, "session_id")


_B_FIELDS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def _folded(batches):
    """Streams token events sorted by piece and line and keeps one running total: what stands in the log is read line
    after line, as its writer made it, where the tables come from windows."""
    import pyarrow as pa

    names = ["piece", "requests", "input_tokens", "cache_read", "output_tokens", "reasoning_tokens"]
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 6)], names)
    piece, running, sums = None, None, [0] * 5
    plain = lambda u: [int(u[f] or 0) for f in _B_FIELDS]
    for b in batches:
        out = []
        for p, last, total in zip(*(b.column(c).to_pylist() for c in ("piece", "last_usage", "total_usage")), strict=True):
            if p != piece:
                if piece is not None:
                    out.append((piece, *sums))
                piece, running, sums = p, None, [0] * 5
            last, total = last and plain(last), total and plain(total)
            if total is None or total != running:
                used = last or (total and [max(a - b, 0) for a, b in zip(total, running or [0] * 5, strict=True)])
                if used and any(used[:4]):
                    sums = [a + b for a, b in zip(sums, (1, max(used[0] - used[1], 0), used[1], used[2], used[3]), strict=True)]
            running = total or (last and [a + b for a, b in zip(running or [0] * 5, last, strict=True)]) or running
        yield rows(out)
    if piece is not None:
        yield rows([(piece, *sums)])


def counter_truth(events: DataFrame) -> DataFrame:
    """Usage of provider B's pieces (log files), recomputed by a fold over their token events: piece, requests and sums
    of tokens. ``events``: piece, line, last_usage and total_usage."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.select(F.col("piece").cast("long").alias("piece"), "line", "last_usage", "total_usage").repartition(parts, "piece").sortWithinPartitions("piece", "line")
    return ordered.mapInArrow(_folded, "piece long, requests long, input_tokens long, cache_read long, output_tokens long, reasoning_tokens long")


def counter_session_truth(events: DataFrame) -> DataFrame:
    """Usage and cost of provider B's sessions by rules of their own: session_id, COUNTED, cost_usd, unpriced and raw_lines.

    An event is a copy where an earlier piece of its chain, or its root for a child, reported the same time and counters;
    or in a child the same total as its root; or, in a fork that is no sub-agent's, within 5 seconds of its creation.
    Copies move a chain's running total and cost nothing. What is left is folded over each chain, and a session's requests
    of one model all pay long-context rates where any of them is beyond its threshold. ``events``: session_id, chain,
    is_child, forked, subagent, created, piece, piece_no, line, ts, model, last_usage, total_usage."""
    shown = F.to_json(F.struct("last_usage", "total_usage"))
    total = F.when(F.col("total_usage").isNotNull(), F.to_json("total_usage"))
    keyed = events.withColumns({"_key": F.concat_ws("|", F.col("ts").cast("string"), shown), "_total": total})
    first = keyed.groupBy("chain", "_key").agg(F.min("piece_no").alias("_since"))
    of_root = keyed.where("not is_child")
    root_keys = of_root.select("session_id", "_key").distinct().withColumn("_known", F.lit(True))
    root_totals = of_root.where("_total is not null").select("session_id", "_total").distinct().withColumn("_held", F.lit(True))
    both = keyed.join(first, ["chain", "_key"]).join(root_keys, ["session_id", "_key"], "left").join(root_totals, ["session_id", "_total"], "left")
    age = F.col("ts").cast("double") - F.col("created").cast("double")
    copy = (F.col("_since") < F.col("piece_no")) | (F.col("is_child") & (F.coalesce("_known", F.lit(False)) | F.coalesce("_held", F.lit(False)))) | F.coalesce(F.col("forked") & ~F.col("subagent") & age.between(0, 5), F.lit(False))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = both.select("session_id", "chain", "model", "piece_no", "line", "last_usage", "total_usage", copy.alias("copy")).repartition(parts, "chain").sortWithinPartitions("chain", "piece_no", "line")
    none = {"cache_1h": F.lit(0).cast("long"), "cache_5m": F.lit(0).cast("long"), "speed": F.lit(None).cast("string")}
    used = rows.mapInArrow(_folded_requests, "session_id string, model string, input_tokens long, cache_read long, output_tokens long, reasoning_tokens long").withColumns(none)
    thresholds = used.sparkSession.createDataFrame([(r[0], r[-1]) for r in rate_rows() if r[-1]], "model string, threshold long")
    over = used.join(F.broadcast(thresholds), "model").where("input_tokens + cache_read > threshold").select("session_id", "model").distinct().withColumn("_long", F.lit(True))  # rates are a table of fixed size
    costed = truth_cost(used.withColumn("output_tokens", F.col("output_tokens") + F.col("reasoning_tokens")), plain=True).join(over, ["session_id", "model"], "left")
    cost = F.when(F.coalesce("_long", F.lit(False)), F.col("long_cost")).otherwise(F.col("truth_cost"))
    sums = costed.withColumn("output_tokens", F.col("output_tokens") - F.col("reasoning_tokens")).groupBy("session_id").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in COUNTED[1:]), F.sum(cost).alias("cost_usd"), F.count_if("unpriced").alias("unpriced"))
    return sums.join(events.groupBy("session_id").agg(F.count("*").alias("raw_lines")), "session_id")


def _folded_requests(batches):
    """Streams the token events of chains in order and keeps one running total; a row for each that is billed."""
    import pyarrow as pa

    schema = pa.schema([("session_id", pa.string()), ("model", pa.string()), *((c, pa.int64()) for c in ("input_tokens", "cache_read", "output_tokens", "reasoning_tokens"))])
    chain, running = None, None
    plain = lambda u: [int(u[f] or 0) for f in _B_FIELDS]
    for b in batches:
        out = []
        for session, now, model, last, total, copy in zip(*(b.column(c).to_pylist() for c in ("session_id", "chain", "model", "last_usage", "total_usage", "copy")), strict=True):
            if now != chain:
                chain, running = now, None
            last, total = last and plain(last), total and plain(total)
            if not copy and (total is None or total != running):
                used = last or (total and [max(a - b, 0) for a, b in zip(total, running or [0] * 5, strict=True)])
                if used and any(used[:4]):
                    out.append((session, model, max(used[0] - used[1], 0), used[1], used[2], used[3]))
            running = total or (last and [a + b for a, b in zip(running or [0] * 5, last, strict=True)]) or running
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, schema.types, strict=True)], schema.names)


def divergences(view: DataFrame, truth: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """session_id, kind, view, truth and severity of every difference. ``view`` and ``truth`` have session_id, COUNTED and
    cost_usd. A session that one side alone has is missing from the view or unknown to the truth. Sessions in ``pending``
    are not compared."""
    v = view.select(F.col("session_id").alias("_vs"), *(F.col(c).alias(f"v_{c}") for c in [*COUNTED, "cost_usd"]))
    both = truth.select("session_id", *COUNTED, "cost_usd", *(["unpriced"] if "unpriced" in truth.columns else [])).join(v, F.col("session_id") == F.col("_vs"), "full_outer")
    both = both.withColumn("_ts", F.col("session_id")).withColumn("session_id", F.coalesce("session_id", "_vs"))
    if pending is not None:
        both = both.join(pending.select("session_id"), "session_id", "left_anti")
    item = lambda kind, when, a, b: F.when(when, F.struct(F.lit(kind).alias("kind"), a.cast("double").alias("view"), b.cast("double").alias("truth")))
    absent = F.col("_vs").isNull() | F.col("_ts").isNull()
    found = [item("session-missing", F.col("_vs").isNull(), F.lit(None), F.lit(None)), item("session-unknown", F.col("_ts").isNull(), F.lit(None), F.lit(None))]
    found += [item(f"{c}-mismatch", ~absent & ~F.coalesce(f"v_{c}", F.lit(0)).eqNullSafe(F.coalesce(c, F.lit(0))), F.coalesce(f"v_{c}", F.lit(0)), F.coalesce(c, F.lit(0))) for c in COUNTED]
    written = lambda p: F.coalesce(f"{p}cache_1h", F.lit(0)) + F.coalesce(f"{p}cache_5m", F.lit(0))
    found.append(item("cache_creation-mismatch", ~absent & (written("v_") != written("")), written("v_"), written("")))
    found.append(item("cost-mismatch", ~absent & (F.abs(F.coalesce("v_cost_usd", F.lit(0.0)) - F.col("cost_usd")) > TOLERANCE), F.coalesce("v_cost_usd", F.lit(0.0)), F.col("cost_usd")))
    if "unpriced" in both.columns:
        found.append(item("unknown-pricing", F.col("unpriced") > 0, F.lit(None), F.col("unpriced")))
    rows = both.select("session_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select("session_id", "d.*")
    return rows.withColumn("severity", F.when(F.col("kind").isin(WARNINGS), "warning").otherwise("error"))


def line_issues(lines: DataFrame) -> DataFrame:
    """Divergences that single lines show: session_id, kind, detail, line and severity. ``lines``: session_id, path, line,
    rejection (null for lines that were read) and skipped (of token events: why they counted for nothing). A file whose
    lines name no session (session_id null) is a rejected source, once, under the name of the file."""
    file = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    sources = lines.groupBy("path").agg(F.max("session_id").alias("s")).where("s is null").select(file.alias("session_id"), F.lit("source-rejected").alias("kind"), F.lit("no session").alias("detail"), F.lit(None).cast("long").alias("line"))
    known = lines.where("session_id is not null")
    rejected = known.where("rejection is not null").select("session_id", F.lit("line-rejected").alias("kind"), F.col("rejection").alias("detail"), F.col("line").cast("long").alias("line"))
    unused = known.where("skipped = 'missing'").select("session_id", F.lit("missing-usage").alias("kind"), F.col("skipped").alias("detail"), F.col("line").cast("long").alias("line"))
    return sources.unionByName(rejected).unionByName(unused).withColumn("severity", F.when(F.col("kind").isin(WARNINGS), "warning").otherwise("error"))


def missing_requests(view: DataFrame, picked: DataFrame) -> DataFrame:
    """Picked requests that the tables don't have, as divergences."""
    gone = picked.select("session_id", F.coalesce(F.col("request_id").cast("string"), F.col("uuid").cast("string")).alias("request_key")).join(view.select("session_id", "request_key"), ["session_id", "request_key"], "left_anti")
    return gone.withColumns({"kind": F.lit("missing-request"), "severity": F.lit("error")})


def report(found: DataFrame, view: DataFrame, truth: DataFrame) -> DataFrame:
    """Per session with a divergence: delta of cost, kinds (sorted, joined by commas), errors and warnings; the largest
    delta first."""
    rolled = found.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    costs = truth.select("session_id", F.col("cost_usd").alias("_t")).join(view.select("session_id", F.col("cost_usd").alias("_v")), "session_id", "full_outer")
    both = rolled.join(costs, "session_id", "left")
    delta = F.coalesce("_v", F.lit(0.0)) - F.coalesce("_t", F.lit(0.0))
    return both.select("session_id", "kinds", "errors", "warnings", delta.alias("delta_usd")).orderBy(F.desc(F.abs("delta_usd")), "session_id")


def drifted(found: DataFrame) -> bool:
    return not found.where("severity = 'error'").isEmpty()


def at_level(rows: DataFrame, level: str = "all") -> DataFrame:
    """Rows of a report: all, those with mismatches, or those with errors."""
    if level == "errors":
        return rows.where("errors > 0")
    return rows.where("errors > 0 or warnings > 0") if level == "mismatches" else rows


def rejection_counts(entries: DataFrame, severities: DataFrame | None = None) -> DataFrame:
    """Rejected lines by category (what stands before a colon) with severity, count, and the last place seen."""
    category = F.split("rejection", ":")[0]
    counted = entries.where("rejection is not null").groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.max_by("rejection", F.struct("path", "line")).alias("latest"))
    severity = F.when(F.col("category").isin("malformed", "missing", "bad-timestamp"), "error").when(F.col("category") == "unknown-type", "warning").otherwise("info")
    return counted.withColumn("severity", severity)
