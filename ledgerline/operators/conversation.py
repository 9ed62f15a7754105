"""Conversation assembly: kinds of steps, merged messages, turns over parent chains, and what turns add up to.

Parent chains are followed by pointer doubling: each round doubles how far every step looks, so a chain of n hops takes
log2(n) joins on (session, uuid). Each round's table is checkpointed. No session is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import file_paths, markdown_targets
from ledgerline.plans.scratch import cut
from ledgerline.sources.logs import INTERRUPTIONS

# Stop reasons after which a turn goes on.
CONTINUES = ["tool_use", "pause_turn"]
#: Rounds of doubling; chains longer than 2 ** ROUNDS do not occur, so what is left then are cycles.
ROUNDS = 32
TERMINATORS = ["reply", "stop"]


def step_kind() -> Column:
    """Of an entry with type, text, thinking, tools, results and stop_reason."""
    has_tool = F.size("tools") > 0
    spoke = (F.coalesce(F.length("text"), F.lit(0)) > 0) | F.col("thinking").isNotNull()
    going_on = F.coalesce(F.col("stop_reason").isin(CONTINUES), F.lit(False)) | has_tool
    user = F.when(F.size("results") > 0, "toolResult").when(F.trim(F.coalesce("text", F.lit(""))).isin(INTERRUPTIONS), "interruption").otherwise("prompt")
    return F.when(F.col("type") == "user", user).when(going_on, F.when(spoke, "thought").otherwise("toolCall")).when(F.col("stop_reason") == "end_turn", "reply").otherwise("stop")


def merge_messages(entries: DataFrame) -> DataFrame:
    """One step per message: texts and thinking joined by line feeds, calls appended, the last stop reason that is not
    null, the first line's id, parent, time and tokens; its kind anew. Adds request_ids, all distinct ones in order.

    A message is a handful of streamed chunks, so collecting them is bounded; other lines are groups of their own."""
    own = entries.withColumn("_key", F.when((F.col("type") == "assistant") & F.col("message_id").isNotNull(), F.concat(F.lit("m:"), "message_id")).otherwise(F.concat(F.lit("u:"), "uuid")))
    merged = ["text", "thinking", "tools", "images", "stop_reason", "request_id"]
    first = [c for c in entries.columns if c not in ("session_id", *merged)]
    rank = F.struct("ts", "place")
    lists = F.array_sort(F.collect_list(F.struct(F.col("ts").alias("_ts"), F.col("place").alias("_place"), *merged)))
    grouped = own.groupBy("session_id", "_key").agg(F.min_by(F.struct(*first), rank).alias("_f"), lists.alias("_l"))
    joined = lambda c: F.nullif(F.array_join(F.filter(F.transform("_l", lambda r: r[c]), lambda x: x.isNotNull()), "\n"), F.lit(""))
    reasons = F.filter(F.transform("_l", lambda r: r["stop_reason"]), lambda x: x.isNotNull())
    requests = F.array_distinct(F.filter(F.transform("_l", lambda r: r["request_id"]), lambda x: x.isNotNull()))
    thought = F.exists("_l", lambda r: r["thinking"].isNotNull())
    out = grouped.select(
        "session_id", *(F.col(f"_f.{c}").alias(c) for c in first), joined("text").alias("text"), F.when(thought, F.coalesce(joined("thinking"), F.lit(""))).alias("thinking"), F.flatten(F.transform("_l", lambda r: r["tools"])).alias("tools"),
        F.flatten(F.transform("_l", lambda r: r["images"])).alias("images"), F.get(reasons, F.size(reasons) - 1).alias("stop_reason"), F.get(requests, F.lit(0)).alias("request_id"), requests.alias("request_ids"),
    )
    return out.withColumn("kind", step_kind())


def parent_links(entries: DataFrame) -> DataFrame:
    """(session_id, uuid, parent_uuid) of every line that has a uuid, dropped ones too."""
    return entries.where("uuid is not null and session_id is not null").groupBy("session_id", "uuid").agg(F.max("parent_uuid").alias("parent_uuid"))


def closest(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """For each node the value of its nearest ancestor, itself included, that has one; else the topmost ancestor that is
    marked, else null. ``nodes``: session_id, uuid, parent_uuid, value, marked. Gives session_id, uuid, found.

    Nodes on a cycle without a value find none and no mark beyond themselves."""
    seen = nodes.select("session_id", "uuid", F.when(F.col("value").isNull(), F.col("parent_uuid")).alias("ptr"), F.col("value").alias("found"), F.when(F.col("marked"), F.col("uuid")).alias("top"))
    own = F.col("top").alias("own")
    state = cut(seen.select("*", own))
    for _ in range(rounds):
        up = state.select(F.col("session_id").alias("_s"), F.col("uuid").alias("_u"), F.col("ptr").alias("_ptr"), F.col("found").alias("_found"), F.col("top").alias("_top"))
        both = state.join(up, (F.col("session_id") == F.col("_s")) & (F.col("ptr") == F.col("_u")), "left")
        state = cut(both.select("session_id", "uuid", F.when(F.col("found").isNull() & F.col("_found").isNull(), F.col("_ptr")).alias("ptr"), F.coalesce("found", "_found").alias("found"), F.coalesce("_top", "top").alias("top"), "own"))
        if state.where("ptr is not null").isEmpty():
            break
    return state.select("session_id", "uuid", F.coalesce("found", F.when(F.col("ptr").isNull(), F.col("top")).otherwise(F.col("own"))).alias("found"))


def turn_ids(steps: DataFrame, links: DataFrame) -> DataFrame:
    """Adds turn_id. A prompt that was not injected starts a turn, but one right below another prompt joins that one;
    all other steps belong to the nearest such ancestor, over dropped lines too, or to the topmost step they reach."""
    prompts = steps.where("kind = 'prompt'").select("session_id", F.col("uuid").alias("parent_uuid"), F.lit(True).alias("_below"))
    known = steps.join(prompts, ["session_id", "parent_uuid"], "left")
    value = F.when((F.col("kind") == "prompt") & ~F.col("injected"), F.when(F.col("_below"), F.col("parent_uuid")).otherwise(F.col("uuid")))
    marked = known.select("session_id", "uuid", "parent_uuid", value.alias("value"), F.lit(True).alias("marked"))
    others = links.join(steps.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti")
    found = closest(marked.unionByName(others.select("session_id", "uuid", "parent_uuid", F.lit(None).cast(steps.schema["uuid"].dataType).alias("value"), F.lit(False).alias("marked"))))
    return steps.join(found.withColumnRenamed("found", "_turn"), ["session_id", "uuid"]).withColumn("turn_id", F.coalesce("_turn", "uuid")).drop("_turn")


def nearest_prompts(steps: DataFrame, links: DataFrame) -> DataFrame:
    """Nearest ancestor prompt of every line: session_id, uuid, prompt (null where there is none)."""
    value = steps.select("session_id", "uuid", "parent_uuid", F.when(F.col("kind") == "prompt", F.col("uuid")).alias("value"), F.lit(False).alias("marked"))
    others = links.join(steps.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti")
    return closest(value.unionByName(others.select("session_id", "uuid", "parent_uuid", F.lit(None).cast(steps.schema["uuid"].dataType).alias("value"), F.lit(False).alias("marked")))).withColumnRenamed("found", "prompt")


def attach_images(entries: DataFrame, nearest: DataFrame) -> DataFrame:
    """Paths of image lines by the prompt they belong to: session_id, prompt, paths (distinct, in order of time)."""
    images = entries.where("image_meta").select("session_id", "uuid", "ts", "place", "image_paths").join(nearest, ["session_id", "uuid"]).where("prompt is not null")
    lists = F.array_sort(F.collect_list(F.struct("ts", "place", "image_paths")))
    return images.groupBy("session_id", "prompt").agg(F.array_distinct(F.flatten(F.transform(lists, lambda r: r["image_paths"]))).alias("paths"))


def turns(steps: DataFrame) -> DataFrame:
    """One row per turn: start_time, end_time, n_steps, interrupted, is_sidechain, agent_id, is_compact, prompt, tokens
    and models. A turn with compaction starts with a compact summary."""
    rank = F.struct("ts", "place")
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read") if c in steps.columns]
    return steps.groupBy("session_id", "turn_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n_steps"), F.bool_or(F.col("kind") == "interruption").alias("interrupted"), F.bool_and("is_sidechain").alias("is_sidechain"),
        F.min_by("agent_id", rank).alias("agent_id"), F.min_by("is_compact", rank).alias("is_compact"), F.min_by(F.when(F.col("kind") == "prompt", F.col("text")), rank).alias("prompt"), *sums,
    )


def model_summary(steps: DataFrame) -> DataFrame:
    """Per turn the model with most input and output tokens, of equal ones the one seen first, and how many others."""
    by_model = steps.where("model is not null").groupBy("session_id", "turn_id", "model").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("used"), F.min(F.struct("ts", "place")).alias("seen"))
    ranked = by_model.groupBy("session_id", "turn_id").agg(F.min_by("model", F.struct(-F.col("used"), "seen", "model")).alias("primary_model"), (F.count("*") - 1).alias("others"))
    return ranked


def skill_spans(steps: DataFrame, trigger: Column) -> DataFrame:
    """Numbers the spans of steps that a trigger opens, in each turn; a span ends before the next trigger, reply or
    stop. Adds span (null outside)."""
    order = Window.partitionBy("session_id", "turn_id").orderBy("ts", "place")
    marked = steps.withColumn("_t", trigger).withColumn("_group", F.sum(F.col("_t").cast("int")).over(order))
    inside = Window.partitionBy("session_id", "turn_id", "_group").orderBy("ts", "place")
    ended = F.max(F.col("kind").isin(TERMINATORS).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_end", ended).withColumn("span", F.when((F.col("_group") > 0) & (F.col("_end") == 0), F.col("_group"))).drop("_t", "_group", "_end")


def tool_runs(calls: DataFrame) -> DataFrame:
    """Neighbouring calls of the same tool as one block: session_id, turn_id, run, name, n_calls. ``calls`` has one
    row per step in order; a step of another kind (name null) ends a run."""
    order = Window.partitionBy("session_id", "turn_id").orderBy("ts", "place")
    changed = (~F.lag("name").over(order).eqNullSafe(F.col("name"))).cast("int")
    numbered = calls.withColumn("_c", changed).withColumn("run", F.sum("_c").over(order))
    return numbered.where("name is not null").groupBy("session_id", "turn_id", "run", "name").agg(F.count("*").alias("n_calls"))


def compacted_away(all_turns: DataFrame) -> DataFrame:
    """Adds compacted: a turn of one step which a compact summary follows."""
    order = Window.partitionBy("session_id").orderBy(F.col("start_time").asc_nulls_first(), "turn_id")
    return all_turns.withColumn("compacted", (F.col("n_steps") == 1) & F.coalesce(F.lead("is_compact").over(order), F.lit(False)))


def previous_turn(all_turns: DataFrame, column: str = "turn_id") -> DataFrame:
    """Adds the nearest earlier turn's ``column``."""
    order = Window.partitionBy("session_id").orderBy("start_time", "turn_id")
    return all_turns.withColumn(f"previous_{column}", F.lag(column).over(order))


def call_results(steps: DataFrame) -> DataFrame:
    """Tool calls with the earliest result of their id: session_id, tool_use_id, name, input, call_uuid, call_turn,
    result (null if none came) and is_error."""
    calls = steps.select("session_id", F.col("uuid").alias("call_uuid"), F.col("turn_id").alias("call_turn"), F.explode("tools").alias("c")).select("session_id", "call_uuid", "call_turn", F.col("c.id").alias("tool_use_id"), "c.name", "c.input")
    results = steps.select("session_id", "ts", "place", F.explode("results").alias("r")).select("session_id", F.col("r.tool_use_id").alias("tool_use_id"), "r.content", "r.is_error", "ts", "place")
    first = results.groupBy("session_id", "tool_use_id").agg(F.min_by(F.struct("content", "is_error"), F.struct("ts", "place")).alias("r"))
    return calls.join(first, ["session_id", "tool_use_id"], "left").select("session_id", "tool_use_id", "name", "input", "call_uuid", "call_turn", F.col("r.content").alias("result"), F.col("r.is_error").alias("is_error"))


def agent_links(called: DataFrame) -> DataFrame:
    """Links from a call to the sub-agent that its result names: the id after ``agentId:``."""
    agent = F.regexp_extract(F.coalesce("result", F.lit("")), r"agentId:\s*([A-Za-z0-9_-]+)", 1)
    return called.withColumn("agent_id", agent).where("agent_id <> ''").dropDuplicates(["session_id", "tool_use_id"]).select("session_id", "tool_use_id", "call_uuid", "call_turn", "agent_id")


def question_of_answer(entries: DataFrame) -> DataFrame:
    """Assistant lines with the user line they answer: parent_uuid is that line's uuid."""
    users = entries.where("type = 'user'").select("session_id", F.col("uuid").alias("parent_uuid"), F.col("text").alias("question"))
    return entries.where("type = 'assistant'").join(users, ["session_id", "parent_uuid"])


def graft(links: DataFrame, all_turns: DataFrame) -> DataFrame:
    """Sub-agent turns by the turn that called them: session_id, turn_id (of the call), agent_turn, complete."""
    agents = all_turns.where("is_sidechain and agent_id is not null").select("session_id", "agent_id", F.col("turn_id").alias("agent_turn"))
    distinct = links.select("session_id", F.col("call_turn").alias("turn_id"), "agent_id").distinct()
    return distinct.join(agents, ["session_id", "agent_id"], "left").withColumn("complete", F.col("agent_turn").isNotNull())


def rolled_up(all_turns: DataFrame, links: DataFrame, values: list[str]) -> DataFrame:
    """Adds total_<value> of each turn: its own and those of the sub-agent turns it called (one level), and complete:
    every linked agent has a turn. Sidechain turns count themselves only."""
    grafted = graft(links, all_turns)
    theirs = all_turns.select("session_id", F.col("turn_id").alias("agent_turn"), *(F.col(v).alias(f"_{v}") for v in values))
    sums = grafted.join(theirs, ["session_id", "agent_turn"], "left").groupBy("session_id", "turn_id").agg(*(F.sum(F.coalesce(f"_{v}", F.lit(0))).alias(f"_sum_{v}") for v in values), F.bool_and("complete").alias("_complete"))
    both = all_turns.join(sums, ["session_id", "turn_id"], "left")
    add = lambda v: F.col(v) + F.when(F.col("is_sidechain"), F.lit(0)).otherwise(F.coalesce(f"_sum_{v}", F.lit(0)))
    return both.select(*all_turns.columns, *(add(v).alias(f"total_{v}") for v in values), (F.col("is_sidechain") | F.coalesce("_complete", F.lit(True))).alias("complete"))


def orphan_lines(links: DataFrame, steps: DataFrame) -> DataFrame:
    """Lines that are no step but whose parent is one, with that step's turn."""
    parents = steps.select("session_id", F.col("uuid").alias("parent_uuid"), "turn_id")
    return links.join(steps.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti").join(parents, ["session_id", "parent_uuid"])


def turn_locators(steps: DataFrame, links: DataFrame) -> DataFrame:
    """Lines of each turn: its steps and the orphan lines below them."""
    own = steps.select("session_id", "turn_id", "uuid", F.lit("step").alias("owner"))
    return own.unionByName(orphan_lines(links, steps).select("session_id", "turn_id", "uuid", F.lit("orphan").alias("owner")))


def dedup_attachments(refs: DataFrame) -> DataFrame:
    """One row per turn and locator: that of the highest priority, at the first position of any."""
    best = refs.groupBy("session_id", "turn_id", "locator").agg(F.min_by(F.struct("kind", "origin"), F.struct(-F.col("priority"), "pos", "kind", "origin")).alias("b"), F.min("pos").alias("pos"))
    return best.select("session_id", "turn_id", "locator", "b.kind", "b.origin", "pos")


def session_shells(entries: DataFrame) -> DataFrame:
    """Per session: started and ended over assistant lines with usage, the last branch, the first slug, the first
    prompt off sidechains, and the user's last rename."""
    rank = F.struct("ts", "place")
    used = (F.col("type") == "assistant") & F.col("has_usage")
    prompt = (F.col("type") == "user") & ~F.col("is_sidechain") & ~F.col("injected") & (F.size("results") == 0)
    shells = entries.groupBy("session_id").agg(
        F.min(F.when(used, F.col("ts"))).alias("started"), F.max(F.when(used, F.col("ts"))).alias("ended"), F.max_by("branch", F.when(F.col("branch").isNotNull(), rank)).alias("branch"),
        F.min_by("slug", F.when(F.col("slug").isNotNull(), rank)).alias("slug"), F.min_by("text", F.when(prompt & F.col("text").isNotNull(), rank)).alias("first_prompt"),
    )
    return shells.join(custom_titles(entries), "session_id", "left")


def custom_titles(entries: DataFrame) -> DataFrame:
    """Titles before a session's first user line are its baseline; the last later title that differs from the baseline
    is the user's own."""
    first_user = entries.where("type = 'user'").groupBy("session_id").agg(F.min("place").alias("_u"))
    titled = entries.where("custom_title is not null").join(first_user, "session_id", "left")
    early = F.col("_u").isNull() | (F.col("place") < F.col("_u"))
    base = titled.groupBy("session_id").agg(F.max_by("custom_title", F.when(early, F.col("place"))).alias("_base"))
    later = titled.where(~early).join(base, "session_id").where(~F.col("custom_title").eqNullSafe(F.col("_base")))
    return later.groupBy("session_id").agg(F.max_by("custom_title", "place").alias("custom_title"))


def titles(shells: DataFrame, first_turns: DataFrame | None = None) -> DataFrame:
    """Custom title, else first turn's, cached title, slug, first prompt, first 8 characters of the id."""
    both = shells if first_turns is None else shells.join(first_turns.select("session_id", "first_turn"), "session_id", "left")
    order = [c for c in ("custom_title", "first_turn", "cached_title", "slug", "first_prompt") if c in both.columns]
    shown = [F.nullif(F.trim(c), F.lit("")) for c in order]
    return both.withColumn("shown_title", F.coalesce(*shown, F.substring(F.col("session_id").cast("string"), 1, 8)))


def merged_shells(shells: DataFrame) -> DataFrame:
    """Shells of one session from several files: the earliest prompt, widest times."""
    return shells.groupBy("session_id").agg(F.min_by("first_prompt", F.when(F.col("first_prompt").isNotNull(), F.col("started"))).alias("first_prompt"), F.min("started").alias("started"), F.max("ended").alias("ended"))


def first_agents(steps: DataFrame) -> DataFrame:
    """First agent id of each sidechain turn."""
    return steps.where("is_sidechain and agent_id is not null").groupBy("session_id", "turn_id").agg(F.min_by("agent_id", F.struct("ts", "place")).alias("agent_id"))


def story_folds(blocks: DataFrame, most: int = 200, head: int = 1, tail: int = 3) -> DataFrame:
    """Blocks of each turn with folded: in turns of more than ``most`` blocks all but the first and the last few."""
    turn = Window.partitionBy("session_id", "turn_id")
    placed = blocks.withColumn("_n", F.count("*").over(turn)).withColumn("_k", F.row_number().over(turn.orderBy("ts", "place")))
    return placed.withColumn("folded", (F.col("_n") > most) & (F.col("_k") > head) & (F.col("_k") <= F.col("_n") - tail)).drop("_n", "_k")


def depths(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """How many ancestors each line has, by pointer doubling: session_id, uuid, depth. A parent that is no line of the
    session counts for none; lines on a cycle have no depth."""
    known = links.select("session_id", F.col("uuid").alias("parent_uuid"), F.lit(True).alias("_known"))
    linked = links.join(known, ["session_id", "parent_uuid"], "left").select("session_id", "uuid", F.when(F.col("_known"), F.col("parent_uuid")).alias("ptr"))
    state = cut(linked.withColumn("depth", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long")))
    for _ in range(rounds):
        up = state.select(F.col("session_id").alias("_s"), F.col("uuid").alias("_u"), F.col("ptr").alias("_ptr"), F.col("depth").alias("_depth"))
        both = state.join(up, (F.col("session_id") == F.col("_s")) & (F.col("ptr") == F.col("_u")), "left")
        state = cut(both.select("session_id", "uuid", F.col("_ptr").alias("ptr"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
        if state.where("ptr is not null").isEmpty():
            break
    return state.select("session_id", "uuid", F.when(F.col("ptr").isNull(), F.col("depth")).alias("depth"))


# The origins of attachments, by which duplicates are decided; the first is the strongest.
ORIGINS = ["prompt-image", "prompt-image-meta", "prompt-mention", "tool-input", "tool-output", "reply-mention"]


def attachments(steps: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """Files, images and links that steps refer to: session_id, turn_id, locator, kind, origin, priority and pos. Images
    in prompts, paths mentioned in prompts, the file or address a tool is called with, paths in results that are no
    errors, and link targets in replies. ``nearest`` has the image lines' paths by prompt (see attach_images)."""
    base = ["session_id", "turn_id", "ts", "place"]
    named = lambda df, origin, kind, locator: df.select(*base, F.lit(origin).alias("origin"), kind.alias("kind"), locator.alias("locator"))
    file_or_link = lambda x: F.when(x.rlike("^https?://"), "url").otherwise("file")
    prompts, replies = steps.where("kind = 'prompt'"), steps.where(F.col("kind").isin("reply", "thought", "stop"))
    images = prompts.select(*base, "uuid", F.posexplode("images").alias("n", "media"))
    out = named(images, "prompt-image", F.lit("image"), F.concat_ws("#", F.col("uuid").cast("string"), F.col("n").cast("string")))
    if nearest is not None:
        paths = prompts.join(nearest.withColumnRenamed("prompt", "uuid"), ["session_id", "uuid"]).select(*base, F.explode("paths").alias("x"))
        out = out.unionByName(named(paths, "prompt-image-meta", F.lit("image"), F.col("x")))
    mentions = prompts.select(*base, F.explode(file_paths(F.col("text"))).alias("x"))
    called = steps.select(*base, F.explode("tools").alias("c"))
    target = F.coalesce(*(F.get_json_object("c.input", f"$.{k}") for k in ("file_path", "notebook_path", "path", "url")))
    called = called.withColumn("x", target).where("x is not null")
    results = steps.select(*base, F.explode("results").alias("r")).where("not r.is_error").select(*base, F.explode(file_paths(F.col("r.content"))).alias("x"))
    said = replies.select(*base, F.explode(F.array_union(markdown_targets(F.col("text")), file_paths(F.col("text")))).alias("x"))
    for origin, df in (("prompt-mention", mentions), ("tool-input", called), ("tool-output", results), ("reply-mention", said)):
        out = out.unionByName(named(df, origin, file_or_link(F.col("x")), F.col("x")))
    priority = F.lit(len(ORIGINS)) - F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    return out.select("session_id", "turn_id", "locator", "kind", "origin", priority.cast("int").alias("priority"), F.struct("ts", "place").alias("pos"))


def turn_aggregates(steps: DataFrame, requests: DataFrame, all_turns: DataFrame, links: DataFrame) -> DataFrame:
    """Per turn its requests' tokens and cost legs, its own and (total_...) with those of the sub-agents it called, the widest
    context of its requests, models (that of most input and output tokens first, of equal ones the one seen first) and
    complete. ``steps``: session_id, turn_id, request_id; ``requests``: priced, with id and timestamp, and context_window
    where the log tells it; ``all_turns``: session_id, turn_id, is_sidechain, agent_id. A request counts once a turn."""
    from ledgerline.functions.pricing import LEGS, TOKENS

    paid = requests.withColumn("context_window", F.col("context_window") if "context_window" in requests.columns else F.lit(None).cast("long"))
    own = steps.where("request_id is not null").select("session_id", "turn_id", F.col("request_id").alias("id")).distinct().join(paid.drop("session_id", "turn_id"), "id")
    values = [*TOKENS, *LEGS]
    by_model = own.groupBy("session_id", "turn_id", "model").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in values), F.max("context_window").alias("context_window"), F.min("timestamp").alias("_seen"))
    order = F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), F.struct(-(F.col("input_tokens") + F.col("output_tokens")), "_seen", "model"))))  # a turn's few models
    sums = by_model.groupBy("session_id", "turn_id").agg(*(F.sum(c).alias(c) for c in values), F.max("context_window").alias("context_window"), F.transform(order, lambda m: m["model"]).alias("models"))
    both = all_turns.select("session_id", "turn_id", "is_sidechain", "agent_id").join(sums, ["session_id", "turn_id"], "left")
    filled = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in values}).withColumn("models", F.coalesce("models", F.array().cast("array<string>")))
    return rolled_up(filled, links, values)
