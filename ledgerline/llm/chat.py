"""Chat formatting as prefix trees.

Conversations that share initial turns share the nodes of a tree: a node is a turn together with all turns before it.
Each tree is laid out depth first, so shared tokens are emitted once; every token has the position it has in its own
conversation, and every node the intervals of the layout that its ancestors take up, which is all it may attend to
besides itself. The child that most conversations go on with follows its parent in the layout, so a run of such children
is one interval. Every step to another child at least halves the number of conversations, so a node has at most one
interval more than the logarithm of that number, however deep it is, and its place in the order is as short.

Template: ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed. In roles and texts a backslash becomes two
and ``<|`` becomes ``<\\|``; in roles a line feed becomes ``\\n``. Afterwards no text holds a control string, and
``unescape`` gives the text back. The texts of assistant turns are under the loss mask.

Turns are ordered by turn, then role and text; null turns come first, a null role or text is empty. Rows repeated
within a conversation are turns of their own. Rows with a null conv_id form one conversation. Other columns are not
read. An empty table gives no rows. A conversation is read as a sorted stream, one turn at a time. Tokens are those that
the tokenizer gives for the whole text: long texts are cut only where one of its words surely begins.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import saved, scratch_dir, small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of a node's id.
_ID = 16
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text goes to the tokenizer in pieces of about so many characters; a piece of over LONGEST that has no place to cut
#: goes there word by word, since the tokenizer's own pattern fails on such runs of spaces.
PIECE, LONGEST = 20_000, 200_000
#: A space between letters or digits belongs to the word after it.
_BREAK = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, k = [], 0
    while (at := text.find("\\", k)) >= 0:
        out.append(text[k:at])
        c = text[at + 1]
        out.append("\n" if c == "n" else c)
        k = at + 2
    return "".join(out) + text[k:]


def tokenizer(path: str):
    """The tokenizer of a vocabulary file; a worker process keeps it in the library's own registry."""
    import tiktoken
    from tiktoken.registry import ENCODINGS

    name = f"chat:{path}"
    if name not in ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        n = max(ranks.values()) + 1
        ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={START: n, END: n + 1})
    return ENCODINGS[name]


def encode(enc, text: str) -> list[int]:
    """Tokens of ordinary text."""
    out, k = [], 0
    while k < len(text):
        cut = _BREAK.search(text, k + PIECE) if len(text) - k > PIECE else None
        piece = text[k : cut.start() if cut else len(text)]
        k += len(piece)
        if len(piece) <= LONGEST:
            out += enc.encode_ordinary(piece)
        else:
            out += [t for m in regex.finditer(PATTERN, piece) for t in enc._encode_single_piece(m[0])]
    return out


def _nodes(batches):
    """Streams conversations in order; gives each turn its depth, its node's id and its parent's, null at the root."""
    conv, last, depth = object(), None, 0
    for b in batches:
        rows = []
        for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if c != conv:
                conv, last, depth = c, None, 0
            role, text = role or "", text or ""
            parts = [role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")]
            own = hashlib.blake2b((last or b"") + len(parts[0]).to_bytes(8) + parts[0] + parts[1], digest_size=_ID).digest()
            rows.append((c, depth, own, last, role, text))
            last, depth = own, depth + 1
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "depth", "node", "parent", "role", "text"])


def _tokens(path: str):
    def run(batches):
        enc = tokenizer(path)
        start, end = enc.encode_single_token(START), enc.encode_single_token(END)
        for b in batches:
            rows = []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                head = [start, *encode(enc, escape(role).replace("\n", "\\n") + "\n")]
                body = encode(enc, escape(text))
                lossy = role == "assistant"
                rows.append(([*head, *body, end, *encode(enc, "\n")], len(head) if lossy else 0, len(head) + len(body) if lossy else 0))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            own = [pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([len(x) for x in cols[0]], pa.int64())]
            same = ["node", "parent", "depth", "uses"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in same), *own], [*same, "tokens", "loss_start", "loss_end", "n_tokens"])

    return run


def turn_nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, role and text of each turn."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_nodes, "conv_id long, depth long, node binary, parent binary, role string, text string")


def _bytes(number):
    """Eight bytes of a number that is not negative, in its order."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def turns_off(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and steps: where the way from the root to each node enters the root or a child that does not follow its
    parent: depth, node and parent there. ``nodes`` has node, parent and uses, the conversations that hold it."""
    first = nodes.where("parent is not null").groupBy("parent").agg(F.max(F.struct("uses", "node")).alias("m")).select(F.col("m.node").alias("first"))
    off = saved(nodes.join(first, F.col("node") == F.col("first"), "left").where("first is null").select(F.col("node").alias("off")))
    walked = turns.select("conv_id", "depth", "node", "parent").join(off, F.col("node") == F.col("off"), "left")
    step = F.when(F.col("off").isNotNull(), F.struct("depth", F.col("node").alias("head"), "parent"))
    way = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return walked.select("node", F.collect_list(step).over(way).alias("steps")).groupBy("node").agg(F.first("steps").alias("steps"))


def prefix_trees(turns: DataFrame, vocabulary: str) -> DataFrame:
    """One row per node: tree (its first turn's id), node, parent, depth, tokens, loss_start and loss_end (within the
    tokens), start (offset in the tree's layout), position (of its first token in its conversation) and attends
    (start and end of each interval of ancestors in the layout, from the root).

    The order of keys is a depth-first order of all trees at once: a run goes down to its end, then what turns off it
    follows, the deepest first. Rows are dealt by ranges of keys, so one large tree spans tasks; offsets are sums inside
    a range plus the totals of the ranges before it, one row per range."""
    spark = turns.sparkSession
    unique = turns.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.count("*").alias("uses"), F.first("role").alias("role"), F.first("text").alias("text"))
    made = saved(unique.mapInArrow(_tokens(vocabulary), "node binary, parent binary, depth long, uses long, tokens array<int>, loss_start long, loss_end long, n_tokens long"))
    steps = turns_off(turns, made.select("node", "parent", "uses")).withColumnRenamed("node", "_node")
    lean = made.select("node", "depth", "n_tokens").join(steps, F.col("node") == F.col("_node")).drop("_node")
    turn = lambda s: F.concat(F.unhex(F.lit("01")), _bytes(F.lit(2**62) - s["depth"]), s["head"])
    none = F.unhex(F.lit(""))
    off = F.aggregate(F.slice("steps", 2, F.greatest(F.size("steps"), F.lit(1))), none, lambda key, s: F.concat(key, turn(s)))
    keyed = lean.withColumn("key", F.concat(F.get("steps", F.lit(0))["head"], off, F.unhex(F.lit("00")), _bytes(F.col("depth"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch_dir(spark)
    ranged = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(F.broadcast(offsets), "part")  # a row for each of the ranges
    at = F.col("inside") + F.col("before")
    placed = saved(placed.select("node", "depth", "n_tokens", "steps", F.get("steps", F.lit(0))["head"].alias("tree"), F.element_at("steps", -1)["head"].alias("run"), at.alias("at")))

    roots = placed.where("depth = 0").select(F.col("tree").alias("_tree"), F.col("at").alias("root"))
    heads = placed.where("node = run").select(F.col("run").alias("_run"), F.col("at").alias("head_at"))
    laid = placed.join(roots, F.col("tree") == F.col("_tree")).join(heads, F.col("run") == F.col("_run"))
    laid = saved(laid.select("node", "depth", "n_tokens", "steps", "tree", "run", (F.col("at") - F.col("root")).alias("start"), (F.col("head_at") - F.col("root")).alias("run_start")))
    above = laid.where("node = run and size(steps) > 1").select("run", F.explode(F.expr("transform(slice(steps, 2, size(steps)), s -> s.parent)")).alias("up"))
    spans = laid.select(F.col("node").alias("up"), F.col("run_start").alias("a"), (F.col("start") + F.col("n_tokens")).alias("b"))
    found = above.join(spans, "up").groupBy(F.col("run").alias("_run")).agg(F.sort_array(F.collect_list(F.struct(F.col("a").alias("start"), F.col("b").alias("end")))).alias("ups"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    own = F.when(F.col("start") > F.col("run_start"), F.array(F.struct(F.col("run_start").alias("start"), F.col("start").alias("end")))).otherwise(empty)
    tokens = made.select(F.col("node").alias("_node"), "parent", "tokens", "loss_start", "loss_end")
    out = laid.join(found, F.col("run") == F.col("_run"), "left").withColumn("attends", F.concat(F.coalesce("ups", empty), own)).join(tokens, F.col("node") == F.col("_node"))
    position = F.aggregate("attends", F.lit(0).cast("long"), lambda s, u: s + u["end"] - u["start"])
    return out.select("tree", "node", "parent", "depth", "tokens", "loss_start", "loss_end", "start", position.alias("position"), "attends")


def _read_back(path: str):
    """Streams conversations' nodes in order and decodes them: what the formatted text and the loss mask hold."""

    def run(batches):
        enc = tokenizer(path)
        now: dict | None = None

        def done(s):
            assert s["rest"] == "", "the formatted text ends within a turn"
            return s["conv"], s["turns"], s["sha"].hexdigest(), s["loss"], s["loss_sha"].hexdigest(), s["chars"]

        for b in batches:
            out = []
            for c, tokens, lo, hi in zip(b.column("conv_id").to_pylist(), b.column("tokens"), b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist(), strict=True):
                if now is None or now["conv"] != c:
                    if now:
                        out.append(done(now))
                    now = {"conv": c, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "rest": ""}
                tokens = tokens.values.to_pylist()
                text = enc.decode_bytes(tokens).decode("utf-8", "surrogatepass")
                now["chars"] += len(text)
                text = now["rest"] + text
                while text.startswith(START) and (stop := text.find(END + "\n")) >= 0:
                    role, _, body = text[len(START) : stop].partition("\n")
                    now["turns"] += 1
                    now["sha"].update((unescape(role) + "\n" + unescape(body) + "\n").encode("utf-8", "surrogatepass"))
                    text = text[stop + len(END) + 1 :]
                now["rest"] = text
                masked = unescape(enc.decode_bytes(tokens[lo:hi]).decode("utf-8", "surrogatepass"))
                now["loss"] += len(masked)
                now["loss_sha"].update(masked.encode("utf-8", "surrogatepass"))
            yield _digests(out)
        if now:
            yield _digests([done(now)])

    return run


def _digests(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(turns: DataFrame, trees: DataFrame, vocabulary: str) -> DataFrame:
    """Walks each conversation from root to leaf through the emitted nodes, and digests what it finds there."""
    nodes = trees.select(F.col("node").alias("_node"), "tokens", "loss_start", "loss_end")
    walked = turns.select("conv_id", "depth", "node").join(nodes, F.col("node") == F.col("_node"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = walked.select("conv_id", "depth", "tokens", "loss_start", "loss_end").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(_read_back(vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The turns with their nodes, and the laid out trees."""
    turns = saved(turn_nodes(conversations))
    return turns, saved(prefix_trees(turns, vocabulary or os.path.join(TOKENIZERS, VOCABULARY)))


def op6_chat(spark, sf_dir):
    """All conversations and conversation -1; rows that have this id already are of the same conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}assistant ok"
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns, trees = format_chats(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(odd))
    return read_back(turns, trees, os.path.join(TOKENIZERS, VOCABULARY))
