"""Provider B: usage from cumulative counters, replay trims, identity groups and turns.

Folds over events are written as windows inside a piece (one log file): a running total is the last reported total plus
what was added since, a generated id is the count of places that need one. What a piece repeats of its session's earlier
ones is found by polynomial hashes of runs of lines and an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.conversation import closest, depths
from ledgerline.plans.scratch import cut

USAGE = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
#: A fork's copied events come within so many seconds of its creation.
REPLAY_SECONDS = 5


def _piece() -> Window:
    return Window.partitionBy("piece").orderBy("line")


def _field(struct: str, name: str) -> Column:
    return F.coalesce(F.col(f"{struct}.{name}"), F.lit(0))


def running_totals(events: DataFrame) -> DataFrame:
    """Adds total_after and total_before (structs, null while nothing is known) to token events with piece, line,
    last_usage and total_usage: the newest reported total plus the last-only usages since."""
    order = _piece()
    base = events.withColumn("_island", F.count("total_usage").over(order))
    inside = Window.partitionBy("piece", "_island").orderBy("line")
    added = F.when(F.col("total_usage").isNull() & F.col("last_usage").isNotNull(), 1).otherwise(0)
    summed = base.withColumn("_base", F.first("total_usage").over(inside)).withColumn("_some", F.max(added).over(inside))
    total = {f: _field("_base", f) + F.sum(F.when(added == 1, _field("last_usage", f)).otherwise(0)).over(inside) for f in USAGE}
    out = summed.withColumn("total_after", F.when(F.col("_base").isNotNull() | (F.col("_some") == 1), F.struct(*(c.cast("long").alias(f) for f, c in total.items()))))
    return out.withColumn("total_before", F.lag("total_after").over(order)).drop("_island", "_base", "_some")


def same_usage(a: str, b: str) -> Column:
    return F.col(a).isNotNull() & F.col(b).isNotNull() & _all(_field(a, f) == _field(b, f) for f in USAGE)


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def resolve_usage(events: DataFrame) -> DataFrame:
    """Adds usage (null if the event counts for nothing) and skipped (duplicate, missing or null). An event whose total
    equals the one before is a duplicate; ``last`` is preferred; else the rise of the total, never negative."""
    known = running_totals(events)
    rise = F.struct(*(F.greatest(_field("total_usage", f) - _field("total_before", f), F.lit(0)).cast("long").alias(f) for f in USAGE))
    plain = lambda c: F.struct(*(_field(c, f).cast("long").alias(f) for f in USAGE))
    duplicate = same_usage("total_usage", "total_before")
    usage = F.when(duplicate, None).when(F.col("last_usage").isNotNull(), plain("last_usage")).when(F.col("total_usage").isNotNull(), rise)
    made = known.withColumn("_u", usage).withColumn("_zero", _all(_field("_u", f) == 0 for f in USAGE[:4]))
    return made.withColumn("skipped", F.when(duplicate, "duplicate").when(F.col("_u").isNull() | F.col("_zero"), "missing")).withColumn("usage", F.when(~F.col("_zero"), F.col("_u"))).drop("_u", "_zero")


def normalized(usage: str = "usage") -> list[Column]:
    """Token columns of a request: cached input is read from the cache, the rest is fresh."""
    return [
        F.greatest(_field(usage, "input_tokens") - _field(usage, "cached_input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), _field(usage, "output_tokens").cast("long").alias("output_tokens"),
        _field(usage, "reasoning_output_tokens").cast("long").alias("reasoning_tokens"), F.lit(0).cast("long").alias("cache_1h"), F.lit(0).cast("long").alias("cache_5m"), _field(usage, "cached_input_tokens").cast("long").alias("cache_read"),
    ]


def is_user(kind: str = "event") -> Column:
    event = (F.col("type") == "event_msg") & (F.col("payload_type") == "user_message")
    item = (F.col("type") == "response_item") & (F.col("payload_type") == "message") & (F.col("role") == "user")
    return F.coalesce(event if kind == "event" else item, F.lit(False))


def is_prelude() -> Column:
    return F.col("type").isin("turn_context", "task_started") | ((F.col("type") == "event_msg") & (F.col("payload_type") == "task_started"))


def is_terminator() -> Column:
    ends = ["turn_aborted", "task_complete"]
    return F.coalesce(F.col("type").isin(ends) | ((F.col("type") == "event_msg") & F.col("payload_type").isin(ends)), F.lit(False))


def plain_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def is_context() -> Column:
    return F.coalesce(F.col("type") == "turn_context", F.lit(False)) | F.coalesce(F.col("payload_type") == "turn_context", F.lit(False))


def carried(events: DataFrame) -> DataFrame:
    """Adds current_turn and current_model of each line. A context or a user message with an id sets the turn, the end
    of a task resets it, and a user message while there is none opens ``generated-n``. User items that only repeat an
    earlier context's text, with no event of their own text in the piece, set nothing."""
    order = _piece()
    texts = events.where(is_user("event")).select("piece", plain_text(F.col("text")).alias("_t")).where("_t <> ''").distinct()
    have = texts.select("piece").distinct().withColumn("_any", F.lit(True))
    known = events.withColumn("_t", plain_text(F.col("text"))).join(texts.withColumn("_said", F.lit(True)), ["piece", "_t"], "left").join(have, "piece", "left")
    quiet = is_user("item") & F.col("turn_id").isNull() & F.coalesce("_any", F.lit(False)) & ~F.coalesce("_said", F.lit(False))
    named = F.when((is_context() | is_user("item")) & (F.trim(F.coalesce("turn_id", F.lit(""))) != ""), F.col("turn_id"))
    marked = known.withColumn("_set", named).withColumn("_reset", is_terminator()).withColumn("_fill", (is_user("event") | (is_user("item") & ~quiet)) & named.isNull())
    opened = marked.withColumn("_seg", F.count(F.when(F.col("_set").isNotNull() | F.col("_reset"), 1)).over(order))
    inside = Window.partitionBy("piece", "_seg").orderBy("line")
    numbered = opened.withColumn("_head", F.first("_set").over(inside)).withColumn("_nth", F.sum(F.col("_fill").cast("int")).over(inside))
    fresh = F.col("_fill") & (F.col("_nth") == 1) & F.col("_head").isNull()
    counted = numbered.withColumn("_new", F.when(fresh, 1).otherwise(0)).withColumn("_made", F.sum("_new").over(order))
    turn = F.coalesce("_head", F.when(F.col("_nth") > 0, F.concat(F.lit("generated-"), F.col("_made").cast("string"))))
    model = F.last(F.when(is_context(), F.col("model")), ignorenulls=True).over(order)
    return counted.withColumn("current_turn", turn).withColumn("current_model", model).select(*events.columns, "current_turn", "current_model")


def requests(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Billable requests of pieces: id, session_id, turn, model, timestamp and token columns. ``sessions`` has piece,
    session_id, model, created, forked and subagent. A fork's copied events are left out."""
    known = carried(events)
    user_seen = F.coalesce(F.max(is_user("event").cast("int")).over(_piece()), F.lit(0))
    tokens = known.withColumn("_live", user_seen).where("type = 'event_msg' and payload_type = 'token_count'")
    resolved = cut(resolve_usage(tokens).where("usage is not null"))  # written out, as what follows reads each field often
    used = resolved.join(sessions.select("piece", "session_id", F.col("model").alias("_model"), "created", "forked", "subagent"), "piece")
    lag = F.col("ts").cast("timestamp").cast("double") - F.col("created").cast("timestamp").cast("double")
    replay = (F.col("_live") == 0) & ~F.col("subagent") & F.col("forked") & lag.between(0, REPLAY_SECONDS)
    kept = used.where(~F.coalesce(replay, F.lit(False)))
    turn = F.coalesce("turn_id", "current_turn")
    ordinal = F.row_number().over(_piece()) - 1
    return kept.select(
        F.concat_ws(":", "session_id", F.lit("token_count"), F.coalesce(F.nullif(turn, F.lit("")), F.lit("session")), ordinal.cast("string")).alias("id"), "session_id", "piece", turn.alias("turn"),
        F.coalesce("model", "current_model", "_model").alias("model"), F.coalesce("ts", "created").alias("timestamp"), *normalized(),
    )


def identity_roots(sessions: DataFrame) -> DataFrame:
    """Root and depth-first place of each session by its chain of parent threads inside the known ids: id, root."""
    known = sessions.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    linked = sessions.select("id", "parent").join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("parent_uuid"))
    nodes = linked.select(F.lit(0).alias("session_id"), F.col("id").alias("uuid"), "parent_uuid", F.lit(None).cast(sessions.schema["id"].dataType).alias("value"), F.lit(True).alias("marked"))
    return closest(nodes).select(F.col("uuid").alias("id"), F.coalesce("found", "uuid").alias("root"))


def trim_subagent_replay(lines: DataFrame, parents: DataFrame) -> DataFrame:
    """Lines of sub-agent pieces without what they copied from their parent. ``lines``: piece, line, type, payload_type,
    role, text, last_usage, total_usage; ``parents``: piece (of the child), prompts' texts and totals as rows (kind,
    value). A piece starts at its first user text that no parent prompt has, with the context lines right above it;
    else after its last line that a parent prompt or total marks, at the next context line if there is one."""
    prompts = parents.where("kind = 'prompt'").select("piece", F.col("value").alias("_t")).distinct()
    totals = parents.where("kind = 'total'").select("piece", F.col("value").alias("_total")).distinct()
    total_key = lambda c: F.concat_ws(":", *(_field(c, f).cast("string") for f in USAGE))
    tokens = running_totals(lines.where("type = 'event_msg' and payload_type = 'token_count'")).select("piece", "line", F.when(F.col("total_after").isNotNull(), total_key("total_after")).alias("_total"))
    user = is_user("event") | is_user("item")
    known = lines.withColumn("_t", F.when(user, F.nullif(plain_text(F.col("text")), F.lit("")))).join(tokens, ["piece", "line"], "left")
    known = known.join(prompts.withColumn("_copied", F.lit(True)), ["piece", "_t"], "left").join(totals.withColumn("_marked", F.lit(True)), ["piece", "_total"], "left")
    has = prompts.groupBy("piece").agg(F.lit(True).alias("_has"))
    any_parent = parents.select("piece").distinct().withColumn("_child", F.lit(True))
    known = known.join(has, "piece", "left").join(any_parent, "piece", "left")
    order = _piece()
    breaks = known.withColumn("_run", F.sum((~is_prelude()).cast("int")).over(order))
    # the context lines right above a line are those of the run that the line before it closes
    runs = breaks.where(is_prelude()).groupBy("piece", "_run").agg(F.min("line").alias("_top"))
    novel = breaks.where(F.col("_t").isNotNull() & F.col("_copied").isNull() & F.coalesce("_has", F.lit(False))).groupBy("piece").agg(F.min_by(F.struct("line", "_run"), "line").alias("n"))
    novel = novel.join(runs, (novel["piece"] == runs["piece"]) & (F.col("n._run") - 1 == F.col("_run")), "left").select(novel["piece"], F.coalesce("_top", F.col("n.line")).alias("_novel"))
    marker = breaks.where(F.coalesce("_copied", F.lit(False)) | F.coalesce("_marked", F.lit(False))).groupBy("piece").agg(F.max("line").alias("_last"))
    after = breaks.where(is_prelude()).select("piece", "line").join(marker, "piece").where("line > _last").groupBy("piece").agg(F.min("line").alias("_next"))
    starts = any_parent.join(novel, "piece", "left").join(marker, "piece", "left").join(after, "piece", "left")
    starts = starts.select("piece", F.coalesce("_novel", "_next", F.col("_last") + 1, F.lit(-1)).alias("_start"))
    return known.join(starts, "piece", "left").where("_start is null or line >= _start").select(*lines.columns)


#: Sequences of keys are compared by polynomials in _BASE over the field of this prime.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_000_057


def _mod(x: Column) -> Column:
    return (x % F.lit(_PRIME).cast("decimal(19,0)")).cast("decimal(19,0)")


def _power(exponent: Column) -> Column:
    """_BASE to ``exponent``, by the squares that its bits name."""
    squares, x = [], _BASE
    for _ in range(40):
        squares.append(F.lit(x).cast("decimal(19,0)"))
        x = x * x % _PRIME
    bits = F.filter(F.sequence(F.lit(0), F.lit(39)), lambda b: F.call_function("getbit", exponent.cast("long"), b) == 1)
    return F.aggregate(bits, F.lit(1).cast("decimal(19,0)"), lambda acc, b: _mod(acc * F.get(F.array(*squares), b)))


def repeated_spans(keys: DataFrame, modes: list[str]) -> DataFrame:
    """session_id, piece_no, n of each piece whose first ``n`` lines, from its first that is no prelude, are the last ones of
    what its session has kept before. ``keys``: session_id, piece_no, line, turn_id, prelude, token and the columns
    ``modes``, tried in turn: the longest repetition in a mode counts if it holds a token line and leaves a line of the piece.

    Keys of kept lines have places in their session; sums of key * _BASE ** place up to each place, within pieces first
    and then over the few totals of pieces, tell any run of lines. A run of L lines from the start of a piece is looked up
    at the one place where a repetition of that length would begin, so candidates are joined by (session, place), a row
    each, and no task holds a session. What earlier pieces lose moves places, so rounds go on until nothing changes; only a
    repetition longer than the piece before it takes another round.
    """
    piece = Window.partitionBy("session_id", "piece_no").orderBy("line")
    whole = Window.partitionBy("session_id", "piece_no")
    own = keys.withColumn("idx", F.row_number().over(piece) - 1)
    own = own.withColumn("first", F.min(F.when(~F.col("prelude"), F.col("idx"))).over(whole)).withColumn("size", F.count("*").over(whole)).withColumn("r", F.col("idx") - F.col("first"))
    at_own = _power(F.greatest("r", F.lit(0)))
    field = {m: F.pmod(F.col(m), F.lit(_PRIME)).cast("decimal(19,0)") for m in modes}
    terms = own.withColumn("_b", at_own).withColumns({f"v_{m}": c for m, c in field.items()}).withColumns({f"o_{m}": F.when(F.col("r") >= 0, _mod(F.col(f"v_{m}") * F.col("_b"))) for m in modes})
    summed = terms.withColumns({f"o_{m}": _mod(F.sum(f"o_{m}").over(piece)) for m in modes})
    own = cut(summed.withColumn("token_at", F.min(F.when(F.col("token") & (F.col("r") >= 0), F.col("r"))).over(whole)).drop("_b", *modes))
    found = own.select("session_id", "piece_no", F.lit(0).alias("n")).where("false")
    while True:
        joined = own.join(found, ["session_id", "piece_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        kept = joined.where("r is null or r < 0 or r >= n").withColumn("rank", F.col("idx") - F.when(F.col("r") >= 0, F.col("n")).otherwise(0))
        before = Window.partitionBy("session_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
        sizes = joined.groupBy("session_id", "piece_no").agg(F.first(F.col("size") - F.col("n")).alias("left"))
        starts = sizes.withColumn("base", F.coalesce(F.sum("left").over(before), F.lit(0))).drop("left")
        placed = kept.join(starts, ["session_id", "piece_no"]).withColumn("pos", F.col("base") + F.col("rank"))
        powered = placed.withColumn("_b", _power(F.col("pos"))).withColumns({f"x_{m}": _mod(F.col(f"v_{m}") * F.col("_b")) for m in modes})
        held = cut(powered.select("session_id", "piece_no", "line", "pos", "prelude", "turn_id", *(f"x_{m}" for m in modes)))
        totals = held.groupBy("session_id", "piece_no").agg(*(_mod(F.sum(f"x_{m}")).alias(f"x_{m}") for m in modes))
        bases = starts.join(totals, ["session_id", "piece_no"], "left")
        bases = cut(bases.select("session_id", "piece_no", "base", *(_mod(F.coalesce(F.sum(f"x_{m}").over(before), F.lit(0).cast("decimal(19,0)"))).alias(f"t_{m}") for m in modes)))
        inside = piece.rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("decimal(19,0)")
        sums = held.select("session_id", "piece_no", "pos", *(_mod(F.coalesce(F.sum(f"x_{m}").over(inside), zero)).alias(f"y_{m}") for m in modes))
        sums = sums.join(bases, ["session_id", "piece_no"]).select("session_id", "pos", *(_mod(F.col(f"t_{m}") + F.col(f"y_{m}")).alias(f"s_{m}") for m in modes))
        # turns that a prelude of an earlier piece names
        seen = held.where("prelude and turn_id is not null").groupBy("session_id", "turn_id").agg(F.min("piece_no").alias("since"))
        strange = own.where("(r < 0 or r is null) and turn_id is not null").join(seen, ["session_id", "turn_id"], "left").where("since is null or since >= piece_no").select("session_id", "piece_no").distinct()
        asked = own.where("r >= 0").join(strange, ["session_id", "piece_no"], "left_anti").join(bases, ["session_id", "piece_no"]).where("r < base").withColumn("pos", F.col("base") - F.col("r") - 1)
        both = asked.join(sums, ["session_id", "pos"]).withColumn("_b", _power(F.col("pos")))
        same = {m: _mod(F.col(f"t_{m}") - F.col(f"s_{m}") + F.lit(_PRIME)) == _mod(F.col(f"o_{m}") * F.col("_b")) for m in modes}
        longest = both.groupBy("session_id", "piece_no").agg(F.first("size").alias("size"), F.first("token_at").alias("token_at"), *(F.max(F.when(c, F.col("r") + 1)).alias(f"l_{m}") for m, c in same.items()))
        n = F.coalesce(*(F.when(F.col("token_at") < F.col(f"l_{m}"), F.col(f"l_{m}")) for m in modes))
        now = cut(longest.withColumn("n", n).where("n < size").select("session_id", "piece_no", F.col("n").cast("int").alias("n")))
        if found.exceptAll(now).isEmpty() and now.exceptAll(found).isEmpty():
            return now
        found = now


def trim_repeated_pieces(lines: DataFrame, identity: list[str]) -> DataFrame:
    """Lines without what a later piece of the same session repeats of earlier ones. ``lines``: session_id (string),
    piece_no, piece, line and what running_totals needs; ``identity`` are the columns that make two lines the same.
    Usage enters identity in three ways, tried in turn: the running total, the last usage, the rise."""
    known = resolve_usage(lines)
    base = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]
    key = lambda usage: F.xxhash64(F.concat_ws("\x1f", *base), F.coalesce(F.to_json(usage), F.lit("")))
    token = (F.col("type") == "event_msg") & (F.col("payload_type") == "token_count")
    own = lambda c: F.when(token, F.col(c))
    keys = known.where("type <> 'session_meta'").select("session_id", "piece_no", "line", "turn_id", F.coalesce(is_prelude(), F.lit(False)).alias("prelude"), F.coalesce(token, F.lit(False)).alias("token"), key(own("total_after")).alias("k0"), key(F.coalesce(own("last_usage"), own("total_usage"))).alias("k1"), key(own("usage")).alias("k2"))
    keys = cut(keys)
    spans = repeated_spans(keys, ["k0", "k1", "k2"])
    order = Window.partitionBy("session_id", "piece_no").orderBy("line")
    body = F.sum((~F.col("prelude")).cast("int")).over(order) > 0  # from the first line that is no prelude
    dropped = keys.withColumn("_body", body).where("_body").withColumn("_r", F.row_number().over(order) - 1).join(spans, ["session_id", "piece_no"]).where("_r < n").select("session_id", "piece_no", "line")
    return lines.join(dropped, ["session_id", "piece_no", "line"], "left_anti").select(*lines.columns)


def steps(events: DataFrame) -> DataFrame:
    """Steps of a piece: prompts (a message item that a user event of the same text and turn mirrors is left out),
    reasoning, replies, calls, results and ends. Adds kind and turn; others are dropped."""
    known = carried(events).withColumn("turn", F.coalesce("turn_id", "current_turn"))
    kind = (
        F.when(is_user("event"), "prompt").when(is_user("item"), "prompt-item").when(is_terminator(), "end")
        .when((F.col("type") == "response_item") & (F.col("payload_type") == "message") & (F.col("role") == "assistant"), "reply")
        .when((F.col("type") == "response_item") & (F.col("payload_type") == "reasoning"), "thought").when(F.col("payload_type").isin("function_call", "custom_tool_call", "web_search_call", "local_shell_call"), "toolCall")
        .when(F.col("payload_type").isin("function_call_output", "custom_tool_call_output", "patch_apply_end", "mcp_tool_call_end"), "toolResult")
    )
    made = known.withColumn("kind", kind).where("kind is not null").withColumn("_t", plain_text(F.col("text")))
    mirrored = made.where("kind = 'prompt'").select("piece", "turn", "_t").distinct().withColumn("_mirror", F.lit(True))
    both = made.join(mirrored, ["piece", "turn", "_t"], "left").where("kind <> 'prompt-item' or _mirror is null")
    return both.withColumn("kind", F.when(F.col("kind") == "prompt-item", "prompt").otherwise(F.col("kind"))).drop("_t", "_mirror", "current_turn", "current_model")


def interrupted(turns: DataFrame) -> DataFrame:
    """A turn that neither ended nor is the last of its session was interrupted."""
    later = F.lead("turn").over(Window.partitionBy("session_id").orderBy("start_time", "turn"))
    return turns.withColumn("interrupted", ~F.col("ended") & later.isNotNull())


def usage_steps(all_steps: DataFrame, used: DataFrame) -> DataFrame:
    """Which step carries each turn's usage: the last assistant-like one."""
    last = all_steps.where(F.col("kind").isin("reply", "thought", "toolCall")).groupBy("piece", "turn").agg(F.max("line").alias("line"))
    sums = used.groupBy("piece", "turn").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read")))
    return last.join(sums, ["piece", "turn"])


def patched_files(patch: Column) -> Column:
    """Paths that a patch text names, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"), F.lit(1)))


def linked_agents(calls: DataFrame, results: DataFrame, children: DataFrame) -> DataFrame:
    """The first call in a turn whose result names a child session: child, call_id, turn. ``results`` has output, a JSON
    object with agent_id."""
    named = results.where("not is_error").withColumn("child", F.get_json_object("output", "$.agent_id"))
    both = calls.where("name = 'Agent'").join(named.select("turn", "call_id", "child"), ["turn", "call_id"]).join(children.select("child"), "child")
    return both.groupBy("child").agg(F.min_by(F.struct("call_id", "turn"), "line").alias("c")).select("child", "c.call_id", "c.turn")


def sidechains(sessions: DataFrame, links: DataFrame) -> DataFrame:
    """Adds is_sidechain to sessions (id, root, parent): a child of its root that a call in the root's turns names
    (``links``: root, child). Its requests and turns are off the main chain; other children stay turns of the root."""
    named = links.select(F.col("root").alias("_root"), F.col("child").alias("_child")).distinct().withColumn("_linked", F.lit(True))
    both = sessions.join(named, (F.col("root") == F.col("_root")) & (F.col("id") == F.col("_child")), "left")
    marked = (F.col("id") != F.col("root")) & F.col("parent").eqNullSafe(F.col("root")) & F.col("_linked").isNotNull()
    return both.select(*sessions.columns, marked.alias("is_sidechain"))


def shells(requests: DataFrame, prompts: DataFrame) -> DataFrame:
    """Per session the earliest prompt off sidechains and the first and last request's times."""
    times = requests.groupBy("session_id").agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"))
    own = prompts.where("not is_sidechain and trim(coalesce(text, '')) <> ''")
    first = own.groupBy("session_id").agg(F.min_by(F.trim("text"), F.struct("ts", "line")).alias("first_prompt"))
    return times.join(first, "session_id", "left")


def coalesced_agent_turns(agent_turns: DataFrame) -> DataFrame:
    """All turns of one linked agent as one: the earliest one's id, interrupted if any was."""
    return agent_turns.groupBy("agent_id").agg(F.min_by("turn", F.struct("start_time", "turn")).alias("turn"), F.min("start_time").alias("start_time"), F.bool_or("interrupted").alias("interrupted"), F.sum("n_steps").alias("n_steps"))


def child_totals(parents: DataFrame, children: DataFrame, values: list[str]) -> DataFrame:
    """Parents' turns plus those of their children; incomplete if a child has no turn. ``children``: parent_turn and
    the values, null where the child has none."""
    sums = children.groupBy("parent_turn").agg(*(F.sum(v).alias(f"_{v}") for v in values), F.bool_and(F.col(values[0]).isNotNull()).alias("_complete"))
    both = parents.join(sums, parents["turn"] == sums["parent_turn"], "left")
    return both.select(*(c for c in parents.columns if c not in values), *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values), F.coalesce("_complete", F.lit(True)).alias("complete"))


# Line types of provider B that are read.
KNOWN_TYPES = ["session_meta", "turn_context", "event_msg", "response_item", "task_started", "task_complete", "turn_aborted", "compacted"]


def line_diagnostics(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Counts by piece and category: malformed lines, unknown types, and token events that were skipped."""
    category = F.when(F.col("malformed"), "malformed").when(~F.coalesce(F.col("type").isin(KNOWN_TYPES), F.lit(False)), F.concat(F.lit("unknown-type:"), F.coalesce("type", F.lit(""))))
    odd = events.select("piece", category.alias("category")).where("category is not null")
    skipped = resolved.where("skipped is not null").select("piece", F.concat(F.lit("usage-"), "skipped").alias("category"))
    return odd.unionByName(skipped).groupBy("piece", "category").agg(F.count("*").alias("n"))


def chain_order(sessions: DataFrame) -> DataFrame:
    """Sessions with root and depth; a group's parents come before its children when ordered by (root, depth, created,
    id). ``sessions``: id, parent, created."""
    links = sessions.select(F.lit(0).alias("session_id"), F.col("id").alias("uuid"), F.col("parent").alias("parent_uuid"))
    depth = depths(links).select(F.col("uuid").alias("id"), "depth")
    return sessions.join(identity_roots(sessions.select("id", "parent")), "id").join(depth, "id")
