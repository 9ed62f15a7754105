"""The tables behind every report, built from the log files of provider B.

A log file is a piece; pieces that share an id are a chain, in order of creation; chains that sub-agents hang below are
one session with their root. What a sub-agent's piece copied from its root, and what a later piece of a chain repeats of
earlier ones, is left out before anything is counted. Totals run over a chain, turns over a piece. Ids are made unique by
the chain they come from, and by the file where a chain has several.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.functions.pricing import price
from ledgerline.operators import conversation as C
from ledgerline.operators import counters as K
from ledgerline.operators import search as Q
from ledgerline.plans.scratch import cut
from ledgerline.plans.tables import Tables, prompts
from ledgerline.sources import logs as L
from ledgerline.sources import tail

PREFIX = "b:"
#: What makes two lines of a chain the same, besides their usage.
IDENTITY = ["type", "payload_type", "role", "text", "name", "arguments", "call_id", "output"]
#: Places of a chain's lines: that many bytes of a piece come before the next piece.
_PIECE_BITS = 48


def pieces_of(events: DataFrame) -> DataFrame:
    """One row a piece with metadata: piece, id, root, session_id, piece_no (in its chain), n_pieces, is_child, cwd, branch,
    created, forked. A parent without a piece of its own leaves its children sessions of their own."""
    meta = L.session_metadata(events.withColumnRenamed("piece", "path")).withColumnRenamed("path", "piece").where("id is not null")
    parents = meta.groupBy("id").agg(F.min_by("parent_thread", F.struct(F.col("parent_thread").isNull(), "created", "piece")).alias("parent"))
    roots = K.identity_roots(parents.select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent")))
    chain = Window.partitionBy("id").orderBy(F.col("created").asc_nulls_first(), "piece")
    both = meta.join(roots, "id").join(parents, "id")
    return both.select(
        "piece", "id", "root", "parent", F.concat(F.lit(PREFIX), "root").alias("session_id"), (F.row_number().over(chain) - 1).cast("long").alias("piece_no"), F.count("*").over(Window.partitionBy("id")).alias("n_pieces"),
        (F.col("id") != F.col("root")).alias("is_child"), "cwd", "branch", "created", F.col("fork_parent").isNotNull().alias("forked"), F.col("parent_thread").isNotNull().alias("subagent"), F.regexp_extract("piece", "([^/]+)$", 1).alias("file"),
    )


def _total_key(c: str):
    return F.concat_ws(":", *(F.coalesce(F.col(f"{c}.{f}"), F.lit(0)).cast("string") for f in K.USAGE))


def _token(df: DataFrame) -> DataFrame:
    return df.where("type = 'event_msg' and payload_type = 'token_count'")


def parent_marks(children: DataFrame, roots: DataFrame) -> DataFrame:
    """piece, kind, value: the prompts and totals of its root that a child's lines hold too, and one row that no line holds for
    each kind that the root has, so that a child knows what its root has without a copy of all of it."""

    def texts(df, *cols):
        return df.where(K.is_user("event") | K.is_user("item")).select(*cols, K.plain_text(F.col("text")).alias("value")).where("value <> ''").distinct().withColumn("kind", F.lit("prompt"))

    def totals(df, *cols):
        known = K.running_totals(_token(df)).where("total_after is not null")
        return known.select(*cols, _total_key("total_after").alias("value")).distinct().withColumn("kind", F.lit("total"))

    has = texts(roots, "root").unionByName(totals(roots, "root"))
    own = texts(children, "piece", "root").unionByName(totals(children, "piece", "root"))
    held = own.join(has, ["root", "kind", "value"], "left_semi").select("piece", "kind", "value")
    known = children.select("piece", "root").distinct().join(has.where("kind = 'prompt'").select("root").distinct(), "root").select("piece", F.lit("prompt").alias("kind"), F.lit("\x00").alias("value"))
    each = children.select("piece").distinct().select("piece", F.lit("total").alias("kind"), F.lit("\x00").alias("value"))
    return held.unionByName(known).unionByName(each)


def kept_lines(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, repeated): the lines of ``events`` (with the columns of pieces_of) that are neither copied from a root nor
    repeated by a later piece of a chain, and keys (piece, line) of the repeated ones."""
    plain = events.where("not is_child")
    of_root = cut(_same_chain(plain))
    children = events.where("is_child")
    own = cut(K.trim_subagent_replay(children, parent_marks(children, of_root)))
    of_child = _same_chain(own)
    kept = cut(of_root.unionByName(of_child))
    late = plain.unionByName(own).select("piece", "line").join(kept.select("piece", "line"), ["piece", "line"], "left_anti")
    return kept, cut(late)


def _same_chain(lines: DataFrame) -> DataFrame:
    many = lines.where("n_pieces > 1")
    trimmed = K.trim_repeated_pieces(many.withColumn("_session", F.col("session_id")).withColumn("session_id", F.col("id")), IDENTITY)
    return lines.where("n_pieces = 1").unionByName(trimmed.withColumn("session_id", F.col("_session")).drop("_session"))


def _scoped(turn):
    """A turn's id in its session: a child's turns are told by its id, a generated one also by its file where there are several."""
    made = F.when((F.col("n_pieces") > 1) & turn.startswith("generated-"), F.concat_ws(":", "file", turn)).otherwise(turn)
    return F.when(F.col("is_child"), F.concat_ws(":", "id", made)).otherwise(made)


def requests_of(events: DataFrame, kept: DataFrame, repeated: DataFrame) -> DataFrame:
    """Billable requests, before prices. Totals run over all of a chain that is no repetition, so that what was copied from
    a root still says where a child's counters began; only kept lines are billed."""
    chain = _token(events).join(repeated, ["piece", "line"], "left_anti").withColumn("_piece", F.col("piece")).withColumn("_line", F.col("line"))
    placed = chain.withColumn("piece", F.col("id")).withColumn("line", F.shiftleft(F.col("piece_no"), _PIECE_BITS) + F.col("_line"))
    used = K.resolve_usage(placed).where("usage is not null").withColumn("piece", F.col("_piece")).withColumn("line", F.col("_line"))
    known = K.carried(kept).withColumn("_live", F.max(K.is_user("event").cast("int")).over(Window.partitionBy("piece"))).where("payload_type = 'token_count'")
    both = used.join(known.select("piece", "line", "current_turn", "current_model", "_live"), ["piece", "line"])
    lag = F.col("ts").cast("double") - F.col("created").cast("double")
    replay = (F.col("_live") == 0) & ~F.col("subagent") & F.col("forked") & lag.between(0, K.REPLAY_SECONDS)
    turn = F.coalesce(F.nullif(F.coalesce("turn_id", "current_turn"), F.lit("")), F.lit("session"))
    ordinal = F.row_number().over(Window.partitionBy("piece").orderBy("line")) - 1
    name = F.concat_ws(":", F.concat(F.lit(PREFIX), "id"), F.when(F.col("n_pieces") > 1, F.col("file")), F.lit("token_count"), turn, ordinal.cast("string"))
    return both.where(~F.coalesce(replay, F.lit(False))).select(
        name.alias("id"), "session_id", F.col("id").alias("chain"), "piece", "line", _scoped(turn).alias("turn_id"), F.coalesce("model", "current_model").alias("model"), F.lit(None).cast("string").alias("speed"),
        F.lit(None).cast("string").alias("stop_reason"), F.coalesce("ts", "created").cast("timestamp_ntz").alias("timestamp"), *K.normalized(),
    )


def steps_of(kept: DataFrame) -> DataFrame:
    """Steps with session_id, chain, turn_id, uuid, kind, text, ts, place; an aborted turn ends by an interruption."""
    named = K.steps(kept).withColumn("turn", F.nullif(F.col("turn"), F.lit("")))
    before = F.lag("turn").over(Window.partitionBy("piece").orderBy("line"))  # what ends a task belongs to the turn it ends
    made = named.withColumn("turn", F.coalesce("turn", F.when(F.col("kind") == "end", before), F.lit("session")))
    kind = F.when(F.col("payload_type") == "turn_aborted", "interruption").otherwise(F.col("kind"))
    place = F.shiftleft(F.col("piece_no"), _PIECE_BITS) + F.col("line")
    return made.select("session_id", F.col("id").alias("chain"), "piece", _scoped(F.col("turn")).alias("turn_id"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("uuid"), kind.alias("kind"), "text", F.col("ts").cast("timestamp_ntz").alias("ts"), place.alias("place"), "line", "name", "call_id", "output")


def side_chains(steps: DataFrame, pieces: DataFrame) -> DataFrame:
    """id, is_sidechain of each chain: a child that a call in its root's turns names is off the main chain."""
    chains = pieces.select("id", "root", "parent").distinct()
    calls = steps.where("kind = 'toolCall'").select(F.col("chain").alias("root"), F.col("turn_id").alias("turn"), "call_id", "name", F.col("place").alias("line"))
    results = steps.where("kind = 'toolResult'").select(F.col("turn_id").alias("turn"), "call_id", "output", F.lit(False).alias("is_error"))
    links = K.linked_agents(calls, results, chains.where("id <> root").select(F.col("id").alias("child")))
    at = chains.select(F.col("id").alias("child"), "root")
    return K.sidechains(chains, links.join(at, "child").select("root", "child")).select("id", "is_sidechain")


class Parts:
    """What the tables are made of, each made when it is first asked for, so that who wants one does not pay for all. ``lines``:
    piece, line and value, where they were read otherwise than from the JSONL files below ``path``."""

    def __init__(self, spark: SparkSession, path: str, lines: DataFrame | None = None):
        if lines is None:
            lines = tail.read_ranges(spark, path).select(F.col("path").alias("piece"), F.col("offset").alias("line"), "value")
        self._lines = lines

    @cached_property
    def read(self) -> DataFrame:
        return cut(L.decode_rollouts(self._lines))

    @cached_property
    def pieces(self) -> DataFrame:
        return cut(pieces_of(self.read))

    @cached_property
    def events(self) -> DataFrame:
        named = self.read.join(self.pieces.withColumnsRenamed({"branch": "_branch", "id": "_id"}), "piece")
        return cut(named.drop("id", "branch", "cwd", "_branch").withColumnRenamed("_id", "id").where("not malformed"))

    @cached_property
    def kept(self) -> tuple[DataFrame, DataFrame]:
        return kept_lines(self.events)

    @cached_property
    def steps(self) -> DataFrame:
        return cut(steps_of(self.kept[0]))

    @cached_property
    def sides(self) -> DataFrame:
        return cut(side_chains(self.steps, self.pieces))

    @cached_property
    def requests(self) -> DataFrame:
        paid = requests_of(self.events, *self.kept).join(self.sides.withColumnRenamed("id", "chain"), "chain")
        return cut(price(paid.drop("chain", "piece", "line")))

    @cached_property
    def lines(self) -> DataFrame:
        """Token events as the verifier reads them; they need nothing of what the other tables leave out."""
        raw = _token(self.events).select("session_id", F.col("id").alias("chain"), "is_child", "forked", "subagent", "created", "piece", "piece_no", "line", "ts", "model", "last_usage", "total_usage")
        return _with_models(raw, self.events.where(K.is_context() & F.col("model").isNotNull()).select("piece", F.col("line").alias("at"), F.col("model").alias("context_model")))


def build(spark: SparkSession, path: str, lines: DataFrame | None = None) -> Tables:
    """Reads the JSONL files below ``path`` by ranges of bytes; a line's place is its offset. ``lines``: piece, line and value,
    where they were read otherwise."""
    parts = Parts(spark, path, lines)
    read, pieces, steps, sides, requests = parts.read, parts.pieces, parts.steps, parts.sides, parts.requests
    carrying = requests.select("session_id", "turn_id", F.col("id").alias("uuid"), F.lit("usage").alias("kind"), F.col("id").alias("request_id"), F.lit(None).cast("string").alias("text"), F.col("timestamp").alias("ts"), F.lit(1 << 62).alias("place"))
    shown = steps.where("kind <> 'end'").select("session_id", "turn_id", "uuid", "kind", F.lit(None).cast("string").alias("request_id"), "text", "ts", "place").unionByName(carrying)
    own = steps.join(sides.withColumnRenamed("id", "chain"), "chain").withColumns({"agent_id": F.when(F.col("is_sidechain"), F.col("chain")), "is_compact": F.lit(False)})
    turns = C.turns(own.where("kind <> 'end'"))
    ended = own.groupBy("session_id", "turn_id").agg(F.bool_or(F.col("kind").isin("end", "interruption")).alias("ended"))
    turns = K.interrupted(turns.withColumnRenamed("interrupted", "_aborted").withColumnRenamed("turn_id", "turn").join(ended.withColumnRenamed("turn_id", "turn"), ["session_id", "turn"]))
    turns = turns.withColumn("interrupted", F.col("_aborted") | F.col("interrupted")).drop("_aborted", "ended").withColumnRenamed("turn", "turn_id")
    named = X.dollar_skill(F.col("text"))
    skills = shown.where((F.col("kind") == "prompt") & named.isNotNull()).select("session_id", "turn_id", named.alias("skill")).distinct()
    first = pieces.where("not is_child").groupBy("session_id").agg(F.min_by(F.struct("cwd", "branch"), "piece_no").alias("m"), F.min("created").alias("created"))
    shells = K.shells(requests, own.where("kind = 'prompt'"))
    sessions = first.join(shells, "session_id", "left").select(
        "session_id", F.col("m.cwd").alias("project"), F.coalesce(F.when(F.col("first_prompt").isNotNull(), X.preview(F.col("first_prompt"), F.lit(False), F.lit(False))), F.substring("session_id", len(PREFIX) + 1, 8)).alias("title"), F.lit(True).alias("visible"),
        F.coalesce("started", F.col("created").cast("timestamp_ntz")).alias("started"), F.coalesce("ended", F.col("created").cast("timestamp_ntz")).alias("ended"), F.col("m.branch").alias("branch"),
    )
    odd = read.select("piece", "line", "malformed", "type").where("malformed or type is null").select(F.col("piece").alias("path"), "line", F.when(F.col("malformed"), "malformed").otherwise("missing:type").alias("rejection"))
    postings, lengths = Q.build_index(prompts(shown))
    ordered = postings.repartitionByRange("token").sortWithinPartitions("token", "doc")
    return Tables(requests, sessions, shown, turns, skills, parts.lines, odd, ordered, lengths)


def _with_models(raw: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds the model of the context before each token event, for the verifier: by numbering contexts, not by carrying."""
    both = raw.select("piece", F.col("line").alias("at"), F.lit(0).alias("c")).unionByName(contexts.select("piece", "at", F.lit(1).alias("c")))
    order = Window.partitionBy("piece").orderBy("at", F.desc("c"))
    numbered = both.withColumn("n", F.sum("c").over(order))
    nth = contexts.withColumn("n", F.row_number().over(Window.partitionBy("piece").orderBy("at"))).select("piece", "n", "context_model")
    models = numbered.where("c = 0").join(nth, ["piece", "n"], "left").select("piece", F.col("at").alias("line"), "context_model")
    return raw.join(models, ["piece", "line"]).withColumn("model", F.coalesce("model", "context_model")).drop("context_model")
