"""Session logs: files and their roles, lines with places, and lines decoded into typed entries.

Lines come from Spark's own text reader, so any store that Spark reads will do and large files are split. A line's number
and byte offset are sums inside its block of the file plus the totals of the blocks before it, so no task holds a file.
JSON is parsed once, into a variant; every field is taken from it by path, so unknown keys are ignored and a field of an
unexpected type is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Line types that carry no conversation, recognised in a line's first characters before it is parsed.
PREFILTERED = ["progress", "file-history-snapshot", "queue-operation", "last-prompt", "attachment"]
HEAD_CHARS = 200
# Starts of texts that the assistant injects under the user's role.
SYSTEM_PREFIXES = ["<command-name>", "<local-command-stdout>", "<local-command-caveat>", "<system-reminder>", "<task-notification>"]
# What stands for an interruption by the user.
INTERRUPTIONS = ["[Request interrupted by user]", "[Request interrupted by user for tool use]", "[Request interrupted]"]
LAUNCH_START = "Async agent launched"
_BLOCKS = "array<struct<type string, text string, thinking string, id string, name string, input variant, tool_use_id string, content variant, is_error boolean, source struct<media_type string>>>"


def read_lines(spark: SparkSession, path: str, name_glob: str = "*.jsonl") -> DataFrame:
    """path, size, modified, line (from 0), offset (bytes) and value of each line of the files below ``path``."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob).option("lineSep", "\n").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"), "value")
    sized = rows.withColumn("_bytes", F.octet_length("value") + 1)
    inside = Window.partitionBy("path", "_block").orderBy("_n")
    totals = sized.groupBy("path", "_block").agg(F.count("*").alias("_lines"), F.sum("_bytes").alias("_total"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("path", "_block", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_l0"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_b0"))
    placed = sized.withColumn("_l", F.row_number().over(inside) - 1).withColumn("_b", F.coalesce(F.sum("_bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = placed.join(offsets, ["path", "_block"])
    return both.select("path", "size", "modified", (F.col("_l0") + F.col("_l")).alias("line"), (F.col("_b0") + F.col("_b")).cast("long").alias("offset"), "value")


def complete_lines(lines: DataFrame) -> DataFrame:
    """Without a file's last line where that isn't closed yet, which a JSON object that doesn't parse shows."""
    last = lines.groupBy(F.col("path").alias("_p")).agg(F.max("line").alias("_last"))
    both = lines.join(last, F.col("path") == F.col("_p"))
    return both.where((F.col("line") < F.col("_last")) | F.try_parse_json("value").isNotNull()).select(*lines.columns)


def line_at(lines: DataFrame, locators: DataFrame) -> DataFrame:
    """Raw lines of locators (path, line)."""
    return locators.join(lines, ["path", "line"])


def file_roles(paths: DataFrame) -> DataFrame:
    """Adds project, session, agent, run and role (main, agent, workflow or other) from a column ``path``."""
    part = lambda pattern, n=1: F.nullif(F.regexp_extract("path", pattern, n), F.lit(""))
    run = part(r"/subagents/workflows/([^/]+)/")
    agent = part(r"/(?:subagents/(?:workflows/.*/)?)?agent-([^/]+)\.jsonl$")
    nested, flat, main = r"/([^/]+)/([^/]+)/subagents/", r"/([^/]+)/subagents/[^/]+\.jsonl$", r"/([^/]+)/([^/]+)\.jsonl$"
    inside = F.col("path").contains("/subagents/")
    role = F.when(run.isNotNull() & agent.isNull(), "other").when(run.isNotNull(), "workflow").when(inside & agent.isNotNull(), "agent").when(inside, "other").otherwise("main")
    out = paths.withColumn("role", role).withColumn("run", run).withColumn("agent", F.when(inside, agent))
    return out.withColumn("project", F.when(inside, F.coalesce(part(nested, 1), part(flat, 1))).otherwise(part(main, 1))).withColumn("session", F.when(inside, part(nested, 2)).otherwise(part(main, 2)))


def fingerprint(size: Column, modified: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), F.unix_micros(modified).cast("string"))


def changed_files(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose fingerprint is not in the manifest (path, fingerprint), and manifest rows whose file is gone."""
    return files.join(manifest, ["path", "fingerprint"], "left_anti"), manifest.join(files.select("path"), "path", "left_anti")


def prefiltered(value: Column) -> Column:
    """Whether a line's start names a type that is dropped unread."""
    head = F.substring(value, 1, HEAD_CHARS)
    return F.array_contains(F.transform(F.array(*(F.lit(f'"type":"{t}"') for t in PREFILTERED)), lambda t: F.contains(head, t)), True)


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 with or without a fraction; null where it is none."""
    return F.try_to_timestamp(text)


def decode_entries(lines: DataFrame) -> DataFrame:
    """Typed entries of provider A's lines, one row per line: outcome (entry or drop), rejection, and the fields of an
    entry. Lines of prefiltered types are rejected before parsing."""
    keep = lines.withColumn("_pre", prefiltered(F.col("value")))
    v = keep.withColumn("_v", F.when(~F.col("_pre"), F.try_parse_json("value")))
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    content = F.try_variant_get("_v", "$.message.content", "variant")
    is_text = F.schema_of_variant(content) == "STRING"
    text_block = F.expr(f"CAST(array(named_struct('type', 'text', 'text', try_variant_get(_v, '$.message.content', 'string'), 'thinking', NULL, 'id', NULL, 'name', NULL, 'input', NULL, 'tool_use_id', NULL, 'content', NULL, 'is_error', NULL, 'source', NULL)) AS {_BLOCKS})")
    blocks = F.when(is_text & (get("$.message.content") != ""), text_block).when(~is_text, F.try_variant_get("_v", "$.message.content", _BLOCKS))
    usage = "$.message.usage"
    fields = v.select(
        *lines.columns, "_pre", F.col("_v").isNull().alias("_bad"),
        get("$.type").alias("type"), get("$.uuid").alias("uuid"), get("$.parentUuid").alias("parent_uuid"), get("$.sessionId").alias("session_id"), get("$.timestamp").alias("_ts"),
        get("$.requestId").alias("request_id"), F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"), F.coalesce(get("$.isMeta", "boolean"), F.lit(False)).alias("injected"),
        F.coalesce(get("$.isCompactSummary", "boolean"), F.lit(False)).alias("is_compact"), get("$.agentId").alias("agent_id"), get("$.gitBranch").alias("branch"), get("$.slug").alias("slug"), get("$.customTitle").alias("custom_title"),
        get("$.message.id").alias("message_id"), get("$.message.model").alias("model"), get("$.message.stop_reason").alias("stop_reason"), get(f"{usage}.speed").alias("speed"),
        *(F.coalesce(get(f"{usage}.{p}", "long"), F.lit(0).cast("long")).alias(a) for p, a in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_creation_input_tokens", "cache_flat"), ("cache_read_input_tokens", "cache_read"))),
        get(f"{usage}.cache_creation.ephemeral_1h_input_tokens", "long").alias("cache_1h_sub"), get(f"{usage}.cache_creation.ephemeral_5m_input_tokens", "long").alias("cache_5m_sub"),
        F.try_variant_get("_v", usage, "variant").isNotNull().alias("has_usage"), F.coalesce(blocks, F.expr(f"CAST(array() AS {_BLOCKS})")).alias("_blocks"),
    )
    known = F.filter("_blocks", lambda b: b["type"].isin("text", "thinking", "image") | ((b["type"] == "tool_use") & b["id"].isNotNull() & b["name"].isNotNull()) | ((b["type"] == "tool_result") & b["tool_use_id"].isNotNull()))
    of = lambda kind: F.filter("_known", lambda b: b["type"] == kind)
    joined = lambda arr, sep="": F.array_join(F.transform(arr, lambda b: F.coalesce(b["text"], F.lit(""))), sep)
    # strings are read as they are, lists of blocks joined by line feeds
    body = lambda c: F.coalesce(F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")), F.array_join(F.transform(F.try_variant_get(c, "$", "array<struct<text string>>"), lambda b: b["text"]), "\n"), F.lit(""))
    made = fields.withColumn("_known", known).withColumns({
        "ts": parse_timestamp(F.col("_ts")),
        "only_text": (F.size("_known") > 0) & (F.size("_known") == F.size(of("text"))),
        "all_text": joined(of("text")),
        "text": F.when(F.size(of("text")) > 0, joined(of("text"), "\n")),
        "thinking": F.when(F.size(of("thinking")) > 0, F.array_join(F.transform(of("thinking"), lambda b: F.coalesce(b["thinking"], b["text"], F.lit(""))), "\n")),
        "tools": F.transform(of("tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), F.coalesce(F.to_json(b["input"]), F.lit("{}")).alias("input"))),
        "results": F.transform(of("tool_result"), lambda b: F.struct(b["tool_use_id"].alias("tool_use_id"), body(b["content"]).alias("content"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error"))),
        "images": F.transform(of("image"), lambda b: b["source"]["media_type"]),
    })
    trimmed = F.trim("all_text")
    image_paths = F.regexp_extract_all("all_text", F.lit(r"\[Image source: ([^\]]+)\]"), F.lit(1))
    image_meta = F.col("only_text") & trimmed.rlike(r"^(\[Image source: [^\]]*\]\s*)+$")
    system = F.array(*(F.lit(p) for p in SYSTEM_PREFIXES))
    rejection = (
        F.when(F.col("_pre"), "filtered").when(F.col("_bad"), "malformed").when(F.col("type").isNull(), "missing:type").when(~F.col("type").isin("user", "assistant"), F.concat(F.lit("unknown-type:"), "type"))
        .when(F.col("uuid").isNull(), "missing:uuid").when(F.col("session_id").isNull(), "missing:sessionId").when(F.col("_ts").isNull(), "missing:timestamp").when(F.col("ts").isNull(), "bad-timestamp")
        .when((F.col("type") == "user") & (F.size("_known") == 0), "empty-user")
        .when((F.col("type") == "user") & image_meta & (F.size(image_paths) == 0), "image-source")
        .when((F.col("type") == "user") & F.col("only_text") & F.exists(system, lambda p: F.startswith(trimmed, p)), "system-meta")
        .when((F.col("type") == "user") & (F.size("_known") == 1) & F.coalesce(F.startswith(F.get("results", F.lit(0))["content"], F.lit(LAUNCH_START)), F.lit(False)), "launch-envelope")
    )
    slash = F.col("only_text") & F.startswith(trimmed, F.lit("<command-message>")) & F.contains(trimmed, F.lit("</command-message>"))
    command = F.concat(F.lit("/"), F.regexp_extract(trimmed, r"(?s)^<command-message>(.*?)</command-message>", 1))
    args = F.regexp_extract(trimmed, r"(?s)<command-args>(.*?)</command-args>", 1)
    spoken = F.when((F.col("type") == "user") & slash, F.when(args == "", command).otherwise(F.concat_ws(" ", command, args))).otherwise(F.col("text"))
    odd = F.array_distinct(F.transform(F.filter("_blocks", lambda b: ~b["type"].isin("text", "thinking", "image", "tool_use", "tool_result", "document")), lambda b: b["type"]))
    out = made.withColumns({"rejection": rejection, "image_meta": (F.col("type") == "user") & image_meta, "image_paths": F.when(image_meta, image_paths).otherwise(F.array().cast("array<string>")), "spoken": spoken, "unknown_blocks": odd})
    return out.select(
        *(c for c in lines.columns if c != "value"), F.when(F.col("rejection").isNull(), "entry").otherwise("drop").alias("outcome"), "rejection", "type", "uuid", "parent_uuid", "session_id", "ts", "request_id", "message_id", "model", "stop_reason", "speed",
        "is_sidechain", "injected", "is_compact", "agent_id", "branch", "slug", "custom_title", "has_usage", "input_tokens", "output_tokens", "cache_flat", "cache_1h_sub", "cache_5m_sub", "cache_read",
        F.col("spoken").alias("text"), "thinking", "tools", "results", "images", "image_meta", "image_paths", "unknown_blocks",
    )


_USAGE = "struct<input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint, total_tokens bigint>"


def decode_rollouts(lines: DataFrame) -> DataFrame:
    """Typed entries of provider B's lines: type, payload type, ids, texts, calls, and last and total usage."""
    v = lines.withColumn("_v", F.try_parse_json("value"))
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    content = F.array_join(F.transform(get("$.payload.content", "array<struct<text string>>"), lambda b: b["text"]), "\n")
    return v.select(
        *(c for c in lines.columns if c != "value"), F.col("_v").isNull().alias("malformed"), get("$.type").alias("type"), get("$.payload.type").alias("payload_type"),
        parse_timestamp(F.coalesce(get("$.timestamp"), get("$.payload.timestamp"))).alias("ts"), get("$.payload.turn_id").alias("turn_id"),
        F.coalesce(get("$.payload.model"), get("$.payload.info.model"), get("$.payload.info.model_name")).alias("model"), get("$.payload.cwd").alias("cwd"), get("$.payload.role").alias("role"),
        F.coalesce(get("$.payload.message"), get("$.payload.text"), F.nullif(content, F.lit(""))).alias("text"), get("$.payload.name").alias("name"), F.coalesce(get("$.payload.arguments"), get("$.payload.input")).alias("arguments"),
        get("$.payload.output").alias("output"), get("$.payload.call_id").alias("call_id"), get("$.payload.id").alias("id"), get("$.payload.forked_from_id").alias("fork_parent"), get("$.payload.git.branch").alias("branch"),
        get("$.payload.source.subagent.thread_spawn.parent_thread_id").alias("parent_thread"), get("$.payload.info.last_token_usage", _USAGE).alias("last_usage"), get("$.payload.info.total_token_usage", _USAGE).alias("total_usage"),
    )


def session_metadata(rollouts: DataFrame) -> DataFrame:
    """The first session_meta line of each file."""
    meta = rollouts.where("type = 'session_meta'")
    first = F.min_by(F.struct("id", "cwd", "fork_parent", "parent_thread", "branch", F.col("ts").alias("created")), "line").alias("m")
    return meta.groupBy("path").agg(first).select("path", "m.*")


def latest_titles(titles: DataFrame) -> DataFrame:
    """The title of each id with the latest updated_at; of equal ones the later line."""
    rank = F.struct(F.col("updated_at").isNotNull(), "updated_at", "line")
    return titles.groupBy("id").agg(F.max_by("title", rank).alias("title"))


def clipped(entries: DataFrame, most: int = 2000) -> DataFrame:
    """Texts other than prompts cut to ``most`` characters, for sources that are read for their usage."""
    return entries.withColumn("text", F.when((F.col("type") == "user"), F.col("text")).otherwise(F.substring("text", 1, most)))
