"""Line dedup as an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Tokens are ordered by rarity over all lines; two lines with a Jaccard similarity of
the threshold or more share a token within their prefixes, so only lines that meet on a prefix token are compared, and
only if their sizes, the positions of that token and a 128-bit parity sketch of their tokens allow the similarity. What
is left is verified on the full token sets. A line goes if an earlier line (lower doc_id, then lower line number,
whether or not that line stays) is as similar.

Lines without words never go; null texts have no lines. A document is a doc_id, null or not, with a text: rows that
share a doc_id and differ in text are documents of their own, in the order of their texts' hashes, and rows that share
both are one, so they lose the same lines. A null doc_id orders first. Tokens are compared by 58 bits of their hash.
Columns other than doc_id and text are passed through by ``remove_lines`` and not read by ``line_duplicates``. An empty
table gives no rows.

How it scales. Equal lines are one class from a map-side aggregation on, so a line that a third of the documents repeat
is compared once. Candidates are found by semi joins, which stop at a line's first partner: no pair is emitted, however
many near copies a line has. Full token sets travel for the lines that have a candidate only, once for each token that
is the first the two have in common.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import saved, text_keys

#: Jaccard threshold as a fraction: 4 / 5.
NUM, DEN = 4, 5
#: Tokens are counted in so many buckets by hash, which bounds what the driver and each task hold: as many as Spark's
#: fast map for aggregates takes.
BUCKETS = 1 << 16
LEVELS = 32
BITMAP_WORDS = 1 << 16
#: Lines of up to so many tokens have a sketch of 64 bits only.
LONG = 64
#: A line's identity: 96 bits of its hashes.
_KEY = ["key", "key2"]
#: A document's identity: its doc_id and 96 bits of its text's hashes.
_DOC = ["doc_id", "text_key", "text_key2"]
_PLACE = f"struct({', '.join(_DOC)}, line_no)"


def tokens(line: str) -> str:
    """SQL for the words of a line, with empty ones at times. A split at one character needs no pattern, and a line has no
    line feed; most lines have none of the other white space either, which is asked first, as replacing looks far slower."""
    spaces = ("\\t", "\\u000B", "\\u000C", "\\r")
    plain = line
    for c in spaces:
        plain = f"replace({plain}, '{c}', ' ')"
    return f"CASE WHEN {' OR '.join(f"contains({line}, '{c}')" for c in spaces)} THEN split({plain}, ' ') ELSE split({line}, ' ') END"


def token_hashes(line: str) -> str:
    """SQL for the distinct hashes of a line's words, 58 bits each."""
    return f"array_remove(array_distinct(transform({tokens(line)}, w -> shiftrightunsigned(xxhash64(w), 6))), shiftrightunsigned(xxhash64(''), 6))"


def rarity_levels(docs: DataFrame) -> list[int]:
    """How common the tokens of each bucket are over all documents, in LEVELS steps of a logarithmic scale."""
    # by line, as an array of a line's words is short; outer as in ``places``, and a line has a word, be it an empty one
    lines = docs.where("text is not null").select(F.explode_outer(F.split("text", "\n")).alias("line"))
    words = lines.select(F.explode_outer(F.expr(tokens("line"))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).alias("bucket")).count().collect()  # BUCKETS rows at most
    levels = [0] * BUCKETS
    most = max((r["count"] for r in counts), default=1)
    least = min((r["count"] for r in counts), default=1)
    for r in counts:
        levels[r["bucket"]] = int((LEVELS - 1) * math.log(r["count"] / least) / math.log(most / least)) if most > least else 0
    return levels


def places(docs: DataFrame) -> DataFrame:
    """doc_id and keys of the text, line_no, line and its key, of each line. The text's keys are made before its lines
    are, once a text; what stands beside a generator would be made once a line."""
    keyed = docs.select("doc_id", *text_keys(F.col("text")), F.split("text", "\n").alias("_lines"))
    # outer, as else a filter on the number of lines is put before the hashing and splits every text itself
    lines = keyed.select(*_DOC, F.posexplode_outer("_lines").alias("line_no", "line")).where("line is not null")
    return lines.select(*_DOC, "line_no", "line", F.xxhash64("line").alias("key"), F.hash("line").alias("key2"))


def line_classes(docs: DataFrame, levels: list[int]) -> DataFrame:
    """One row per distinct line with a word: key, at (its first place), copies, n (distinct tokens), sig and sig2 (parity
    of the tokens by each of 128 bits; of up to LONG tokens by each of the 64 of sig) and prefix (codes of tokens, rarest
    first: level, then 26 bits of the hash)."""
    table = f"CAST(split('{','.join(map(str, levels))}', ',') AS ARRAY<BIGINT>)"  # folded into one constant
    # lambdas are interpreted, so they are few and short: a word is hashed once, and looked up if it is not a repeated one
    hashes = f"array_remove(array_distinct(transform({tokens('line')}, w -> xxhash64(w))), xxhash64(''))"
    # coalesce, as an array that may hold nulls is sorted by a slower way
    code = f"shiftleft(coalesce(get({table}, CAST(x & {BUCKETS - 1} AS INT)), 0L), 58) | shiftrightunsigned(x, 6)"
    # not by the size of _c, as a filter on that is moved ahead of the hashing and hashes all words itself
    hashed = places(docs).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    coded = hashed.select(*_DOC, "line_no", *_KEY, F.expr(f"sort_array(transform({hashes}, x -> {code}))").alias("_c"))
    bit = "shiftleft(1L, CAST(x & 63 AS INT))"
    upper = f"if(size(_c) > {LONG}, aggregate(_c, 0L, (a, x) -> if((x & 64) = 0, a, a ^ {bit})), 0L)"
    prefix = f"transform(slice(_c, 1, size(_c) - CAST(ceil(size(_c) * {NUM} / {DEN}) AS INT) + 1), x -> CAST(shiftrightunsigned(x, 32) AS INT))"
    made = coded.select(*_DOC, "line_no", *_KEY, F.size("_c").alias("n"), F.expr(f"aggregate(_c, 0L, (a, x) -> a ^ {bit})").alias("_both"), F.expr(upper).alias("sig2"), F.expr(prefix).alias("prefix"))
    made = made.withColumn("sig", F.col("_both").bitwiseXOR(F.col("sig2")))
    grouped = made.groupBy(*_KEY).agg(F.min(F.expr(_PLACE)).alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sig2").alias("sig2"), F.first("prefix").alias("prefix"))
    return grouped.withColumn("id", F.monotonically_increasing_id())


def _close(a: str, b: str) -> str:
    """Whether sizes and sketches allow the similarity: tokens on one side only are at most n * (DEN - NUM) / (DEN + NUM).
    Where a line of up to LONG tokens takes part, both halves of the other's sketch are laid over each other."""
    apart = f"if({a}.n > {LONG} AND {b}.n > {LONG}, bit_count({a}.sig ^ {b}.sig) + bit_count({a}.sig2 ^ {b}.sig2), bit_count({a}.sig ^ {a}.sig2 ^ {b}.sig ^ {b}.sig2))"
    return f"{a}.n * {DEN} >= {b}.n * {NUM} AND {b}.n * {DEN} >= {a}.n * {NUM} AND {apart} * {DEN + NUM} <= ({a}.n + {b}.n) * {DEN - NUM}"


def _enough(overlap: str, a: str, b: str) -> str:
    return f"({overlap}) * {DEN + NUM} >= ({a}.n + {b}.n) * {NUM}"


#: What two lines can share at most, given their prefixes: what is in both, and the rest of the line whose prefix ends
#: earlier in the order. Codes that stand for two tokens of a line count as shared as often.
_TWICE = "(size(a.prefix) - size(array_distinct(a.prefix)))"
_MOST_SHARED = (
    f"size(array_intersect(a.prefix, b.prefix)) + {_TWICE} + if(element_at(a.prefix, -1) = element_at(b.prefix, -1), 1 + {_TWICE}, 0)"
    " + if(element_at(a.prefix, -1) <= element_at(b.prefix, -1), a.n - size(a.prefix), b.n - size(b.prefix))"
)


def _maybe_in(wanted: DataFrame):
    """A bitmap of BITMAP_WORDS * 64 bits over keys, as a condition: false for most lines that ``wanted`` has not, so that
    those are dropped before they are shuffled. Its size is fixed; with more keys it only lets more lines through."""
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(key, 16) & 63 AS INT))")
    rows = wanted.groupBy(F.expr(f"CAST(key & {BITMAP_WORDS - 1} AS INT)").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()  # BITMAP_WORDS rows at most
    words = [0] * BITMAP_WORDS
    for r in rows:
        words[r["word"]] = r["bits"]
    table = f"CAST(split('{','.join(map(str, words))}', ',') AS ARRAY<BIGINT>)"
    return F.expr(f"get({table}, CAST(key & {BITMAP_WORDS - 1} AS INT)) & shiftleft(1L, CAST(shiftrightunsigned(key, 16) & 63 AS INT)) <> 0")


def line_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document with lines that go: doc_id, the keys of its text and removed (their numbers, in order)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes = saved(line_classes(docs, rarity_levels(docs)))

    # in the order of the table's columns, so that both sides of the join are one exchange
    met = classes.select("n", "sig", "sig2", "id", F.posexplode("prefix").alias("pos", "token"))
    # as if the token were the first that the two have in common
    allowed = f"a.token = b.token AND a.id <> b.id AND {_close('a', 'b')} AND {_enough('least(a.n - a.pos, b.n - b.pos)', 'a', 'b')}"
    contested = saved(met.alias("a").join(met.alias("b"), F.expr(allowed), "left_semi").select("id", "pos", "token"))
    seen = contested.join(classes.select("id", "n", "sig", "sig2", "prefix"), "id").select("id", "n", "sig", "sig2", "pos", "token", "prefix")
    # what most pairs of a large group fail is asked first
    first = f"{allowed} AND (a.pos = 0 OR b.pos = 0 OR NOT arrays_overlap(slice(a.prefix, 1, a.pos), slice(b.prefix, 1, b.pos))) AND {_enough(_MOST_SHARED, 'a', 'b')}"
    contested = saved(seen.alias("a").join(seen.alias("b"), F.expr(first), "left_semi").select("id", "token"))

    # one more pass over the lines: those whose tokens are compared in full, and the places of those that are there often
    asked = contested.select(F.col("id").alias("asked")).distinct()
    wanted = classes.select("id", "n", "sig", "sig2", "at", "copies", *_KEY).join(asked, F.col("id") == F.col("asked"), "left").where("asked is not null or copies > 1")
    wanted = saved(wanted.withColumn("asked", F.col("asked").isNotNull()))
    lines = places(docs).where(_maybe_in(wanted)).join(wanted.hint("merge"), _KEY).withColumn("is_first", F.expr(f"at = {_PLACE}"))
    lines = saved(lines.where("copies > 1 or is_first").withColumn("line", F.when(F.col("asked") & F.col("is_first"), F.col("line"))))

    members = lines.where("asked and is_first").dropDuplicates(["id"]).select("id", "n", "sig", "sig2", "at", F.expr(token_hashes("line")).alias("tokens"))
    full = members.hint("merge").join(contested, "id").select("token", "id", "n", "sig", "sig2", "at", "tokens")
    same = _enough("size(array_intersect(a.tokens, b.tokens))", "a", "b")
    later = F.expr(f"a.token = b.token AND a.id <> b.id AND b.at < a.at AND {_close('a', 'b')} AND {same}")
    gone = saved(full.alias("a").join(full.alias("b"), later, "left_semi").select(F.col("id").alias("gone")).distinct())

    hit = lines.select("id", "is_first", *_DOC, "line_no").join(gone, F.col("id") == F.col("gone"), "left").where("gone is not null or not is_first")
    return hit.groupBy(*_DOC).agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def _with_removed(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``keyed``, which has doc_id and the keys of its text, with the column removed, null where nothing goes."""
    named = found.select(*(F.col(c).alias(f"_found_{c}") for c in _DOC), "removed").hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("_found_doc_id")) & (F.col("text_key") == F.col("_found_text_key")) & (F.col("text_key2") == F.col("_found_text_key2"))
    return keyed.join(named, same, "left").select(*keyed.columns, "removed")


def remove_lines(docs: DataFrame, found: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The rows of ``docs`` without the lines in ``found``; n_chars, if there, follows the text. Other columns stay as
    they are, whatever their names. With ``drop_emptied`` rows that lose all their words go; those that had none stay."""
    rows = docs.select(F.struct("*").alias("row"))
    both = _with_removed(rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), *text_keys(F.col("row.text"))), found)
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    cut = both.withColumn("cut", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept))
    if drop_emptied:
        cut = cut.where(F.col("removed").isNull() | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = lambda kind: F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.length("cut")).cast(kind).alias("n_chars")
    made = {"text": lambda f: F.col("cut").cast(f.dataType).alias("text"), "n_chars": lambda f: n_chars(f.dataType)}
    return cut.select(*(made[f.name](f) if f.name in made else F.col("row").getField(f.name).alias(f.name) for f in docs.schema))


def op8_line_dedup(spark, sf_dir):
    """Per document: doc_id, n_lines, n_removed and removed, the numbers of the lines that go. The join back is by the keys
    of the texts, which stay where they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    keyed = docs.select("doc_id", *text_keys(F.col("text")), n_lines.alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return _with_removed(keyed, line_duplicates(docs)).select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
