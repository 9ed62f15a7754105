"""What went wrong while logs were read: issues by category, with severities, counts and the latest samples of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Categories of issues with their severities. Infos are counted only.
SEVERITIES = {
    "filtered": "info", "empty-user": "info", "system-meta": "info", "image-source": "info", "inline-image": "info", "launch-envelope": "info",
    "unknown-type": "warning", "unknown-block": "warning", "unknown-tool": "warning", "unknown-stop-reason": "warning", "counter-unknown-type": "warning", "counter-unpriced": "warning", "counter-duplicate": "warning", "counter-fork-replay": "warning",
    "agent-without-id": "warning", "agent-orphan": "warning", "agent-depth": "warning", "agent-session": "warning",
    "malformed": "error", "missing": "error", "bad-timestamp": "error", "cost-drift": "error", "truth-drift": "error",
}
# Stop reasons, and tools whose inputs attachments are taken from.
STOP_REASONS = ["end_turn", "tool_use", "stop_sequence", "max_tokens", "pause_turn", "refusal"]
FILE_TOOLS = ["Read", "Write", "Edit", "MultiEdit", "NotebookEdit", "Glob", "Grep", "Bash", "WebFetch", "WebSearch", "Agent", "Task", "Skill", "TodoWrite"]
MOST_SAMPLES = 20
PREVIEW_CHARS = 200


def _issue(category: str, detail, when):
    return F.when(when, F.struct(F.lit(category).alias("category"), detail.cast("string").alias("detail")))


def entry_issues(entries: DataFrame) -> DataFrame:
    """category, detail, path, line of what decoding rejected, and of blocks, tools, stop reasons and images that it kept without
    knowing them."""
    rejected = F.when(F.col("rejection").isNotNull(), F.struct(F.split("rejection", ":")[0].alias("category"), F.regexp_extract("rejection", ":(.*)", 1).alias("detail")))
    kept = F.col("rejection").isNull()
    odd_tools = F.filter(F.transform("tools", lambda t: t["name"]), lambda n: ~n.isin(FILE_TOOLS) & ~F.startswith(n, F.lit("mcp__")))
    found = [
        rejected, _issue("unknown-block", F.array_join("unknown_blocks", ","), F.size("unknown_blocks") > 0), _issue("unknown-tool", F.array_join(F.array_distinct(odd_tools), ","), kept & (F.size(odd_tools) > 0)),
        _issue("unknown-stop-reason", F.col("stop_reason"), kept & F.col("stop_reason").isNotNull() & ~F.col("stop_reason").isin(STOP_REASONS)), _issue("inline-image", F.size("images"), kept & (F.col("type") == "user") & (F.size("images") > 0)),
    ]
    return entries.select("path", "line", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("i.*", "path", "line")


def counter_issues(events: DataFrame, resolved: DataFrame, unpriced: DataFrame) -> DataFrame:
    """The same of provider B: lines of unknown types, token events that repeat a total or that a fork copied (``resolved``:
    piece, line, skipped), and models without a price (``unpriced``: piece, line, model)."""
    from ledgerline.operators.counters import KNOWN_TYPES

    known = F.coalesce(F.col("type").isin(KNOWN_TYPES), F.lit(False))
    lines = events.select(F.col("piece").cast("string").alias("path"), "line", F.when(F.col("malformed"), "malformed").when(~known, "counter-unknown-type").alias("category"), F.col("type").alias("detail")).where("category is not null")
    kind = F.when(F.col("skipped") == "duplicate", "counter-duplicate").when(F.col("skipped") == "fork", "counter-fork-replay")
    skipped = resolved.select(F.col("piece").cast("string").alias("path"), "line", kind.alias("category"), F.col("skipped").alias("detail")).where("category is not null")
    rates = unpriced.select(F.col("piece").cast("string").alias("path"), "line", F.lit("counter-unpriced").alias("category"), F.col("model").alias("detail"))
    return lines.unionByName(skipped).unionByName(rates).select("category", "detail", "path", "line")


def agent_issues(called: DataFrame, links: DataFrame, turns: DataFrame, files: DataFrame) -> DataFrame:
    """Calls of agents whose result names none, links to agents without a turn, links from a turn off the main chain, and agents'
    files that lie in another session's folder than their lines say. ``files``: path, session (by folder), said (by lines)."""
    asked = called.where("name in ('Agent', 'Task') and result is not null").join(links.select("session_id", "tool_use_id").distinct(), ["session_id", "tool_use_id"], "left_anti")
    row = lambda df, category, detail, path: df.select(F.lit(category).alias("category"), F.col(detail).cast("string").alias("detail"), F.col(path).cast("string").alias("path"), F.lit(None).cast("long").alias("line"))
    agents = turns.where("agent_id is not null").select("session_id", "agent_id").distinct()
    side = turns.where("is_sidechain").select("session_id", F.col("turn_id").alias("call_turn")).distinct()
    out = row(asked, "agent-without-id", "tool_use_id", "session_id").unionByName(row(links.join(agents, ["session_id", "agent_id"], "left_anti"), "agent-orphan", "agent_id", "session_id"))
    out = out.unionByName(row(links.join(side, ["session_id", "call_turn"]), "agent-depth", "agent_id", "session_id"))
    return out.unionByName(row(files.where("session <> said"), "agent-session", "said", "path"))


def drift_issues(found: DataFrame) -> DataFrame:
    """Errors of verification (as by divergences): of costs, and of all else."""
    kind = F.when(F.col("kind") == "cost-mismatch", "cost-drift").otherwise("truth-drift")
    return found.where("severity = 'error'").select(kind.alias("category"), F.col("kind").alias("detail"), F.col("session_id").cast("string").alias("path"), F.lit(None).cast("long").alias("line"))


def severity():
    out = F
    for category, level in SEVERITIES.items():
        out = out.when(F.col("category") == category, level)
    return out.otherwise("warning")


def counts(issues: DataFrame) -> DataFrame:
    """category, severity, n."""
    return issues.groupBy("category").agg(F.count("*").alias("n")).withColumn("severity", severity())


def recent(issues: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """The latest ``most`` issues of each category that is more than an info: nth (from 1, the latest first), category, severity,
    detail (its beginning), path and line. Ranks are cut on each task before the shuffle, so a category of any size
    sends ``most`` rows a task."""
    order = Window.partitionBy("category").orderBy(F.desc_nulls_last("path"), F.desc_nulls_last("line"), F.desc_nulls_last("detail"))
    shown = issues.withColumn("severity", severity()).where("severity <> 'info'")
    return shown.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("category", "severity", "nth", F.substring("detail", 1, PREVIEW_CHARS).alias("detail"), "path", "line")
