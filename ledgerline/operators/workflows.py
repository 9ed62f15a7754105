"""Workflow fan-out: one call that launches a run, whose many agents its metadata or its folder name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.scratch import cut


def launches(called: DataFrame) -> DataFrame:
    """What a launch's result says of its run, by the labels of its lines: session_id, tool_use_id, call_uuid, call_turn,
    task_id, run_id, summary, folder and script. ``called`` is as by call_results; results without a task, run or folder
    launched nothing."""
    text = F.coalesce("result", F.lit(""))
    after = lambda label: F.nullif(F.trim(F.regexp_extract(text, rf"{label}([^\n]*)", 1)), F.lit(""))
    out = called.select(
        "session_id", "tool_use_id", "call_uuid", "call_turn", after("Task ID:").alias("task_id"), after("Run ID:").alias("run_id"), after("Summary:").alias("summary"), after("Transcript dir:").alias("folder"),
        F.nullif(F.regexp_extract(text, r'scriptPath:[^"]*"([^"]*)"', 1), F.lit("")).alias("script"),
    )
    return out.where("coalesce(task_id, run_id, folder) is not null")


def metadata(lines: DataFrame) -> DataFrame:
    """Runs by their metadata files, one JSON object each (path and value): run_id, task_id, name, status, summary and
    agents, (position, agent_id) of those that its progress names, in order."""
    v = lines.withColumn("_v", F.try_parse_json("value"))
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    progress = get("$.workflowProgress", "array<struct<index: int, agentId: string>>")
    agents = F.filter(F.transform(progress, lambda p, i: F.struct(F.coalesce(p["index"], i).alias("position"), p["agentId"].alias("agent_id"))), lambda p: p["agent_id"].isNotNull() & (p["agent_id"] != ""))
    folder = F.regexp_extract("path", r"/subagents/workflows/([^/]+)/", 1)
    return v.select(F.coalesce(get("$.runId"), F.nullif(folder, F.lit(""))).alias("run_id"), get("$.taskId").alias("task_id"), get("$.workflowName").alias("name"), get("$.status").alias("status"), get("$.summary").alias("summary"), agents.alias("agents"))


def run_agents(meta: DataFrame, files: DataFrame) -> DataFrame:
    """run_id, agent_id, position of each run's agents: those that its metadata names, else those that have a file in its
    folder, by name. ``files`` is as by file_roles."""
    named = meta.where("run_id is not null").select("run_id", F.explode("agents").alias("a")).select("run_id", "a.agent_id", "a.position").groupBy("run_id", "agent_id").agg(F.min("position").alias("position"))
    found = files.where("role = 'workflow' and run is not null").select(F.regexp_extract("path", r"/workflows/([^/]+)/", 1).alias("run_id"), F.col("agent").alias("agent_id")).distinct()
    rest = found.join(named.select("run_id").distinct(), "run_id", "left_anti").withColumn("position", F.lit(None).cast("int"))
    return named.unionByName(rest)


def workflow_links(called: DataFrame, meta: DataFrame, files: DataFrame) -> DataFrame:
    """Links from a launching call to every agent of its run, in the form of agent_links, with name, status and summary: what
    the metadata says goes before what the launch's text says. A run that several calls name is the earliest call's."""
    started, meta = launches(called), cut(meta)  # read three times, and its files are parsed once
    by_task = meta.where("task_id is not null and run_id is not null").groupBy("task_id").agg(F.min("run_id").alias("_run"))
    folder_run = F.nullif(F.regexp_extract("folder", r"([^/]+)/*$", 1), F.lit(""))
    known = started.join(by_task, "task_id", "left").withColumn("run_id", F.coalesce("run_id", "_run", folder_run)).where("run_id is not null")
    own = known.groupBy("run_id").agg(F.min_by(F.struct("session_id", "tool_use_id", "call_uuid", "call_turn", "summary"), F.struct("session_id", "call_uuid", "tool_use_id")).alias("c"))
    told = meta.where("run_id is not null").groupBy("run_id").agg(F.max("name").alias("workflow"), F.max("status").alias("status"), F.max("summary").alias("_summary"))
    both = own.join(run_agents(meta, files), "run_id").join(told, "run_id", "left")
    return both.select("c.session_id", "c.tool_use_id", "c.call_uuid", "c.call_turn", "agent_id", "run_id", "position", "workflow", "status", F.coalesce("_summary", "c.summary").alias("summary"))
