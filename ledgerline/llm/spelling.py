"""Spelling variants: words one edit apart, found by the halves they share.

A word is split into two segments, its first len // 2 code points and the rest. If two words differ by one edit, the edit
lies in one segment of either word, so the other stands unchanged in the other word: a first segment at its start, a
second one at its end. Words are dealt by these segments to shards. A shard's automaton holds the segments of the words
that own them and scans every word sent there; a hit counts where its offset and the two lengths allow one edit, and
what stands beside the segment is then compared: partners whose rests agree but for one code point are looked up by
rests with a code point left out, and each is verified. A shard emits one row a word, never its pairs.

Segments that more than ``most`` words share are dealt once more, by hash of the owning word; words that look for them
visit each part, so no group outgrows a task, and none is cut short.

Null texts hold no words, empty and very long ones are read whole; a null doc_id counts as an empty string in the hash
that picks misspellings. Repeated rows count again. Ties between forms go to the word that is least by code points. A
table without words gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import saved, small_batches

MIN_CHARS = 7
MIN_COUNT = 2
#: A run whose hash this divides loses a code point.
MISSPELT = 31
#: A form is so many times as frequent as its variant.
FORM_RATIO = 10
#: Words that share a segment, and words a shard, at most on average.
SHARD_WORDS = 20_000
#: Different words that a task counts before it hands them on.
HELD_WORDS = 300_000


def run_pattern(min_chars: int) -> re.Pattern:
    """Maximal runs of letters of at least ``min_chars``."""
    return re.compile(f"[A-Za-zÀ-ÿ]{{{min_chars},}}")


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spelt(doc_id, run: str) -> str:
    """What a lower-cased run becomes in its document."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(min_chars):
    def run(batches):
        runs, held = run_pattern(min_chars).findall, Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w, k in Counter(runs(lowered(t or ""))).items():
                    w = spelt(d, w)
                    if len(w) >= min_chars:
                        held[w] += k
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    return run


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of every word of enough code points and occurrences. Tasks count before the shuffle."""
    small_batches(docs.sparkSession)
    part = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_counted(min_chars), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between ``a`` and ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def shortened(rest: str) -> set[str]:
    """``rest`` and all that is left of it without one of its code points."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


class Shard:
    """The automaton of the segments that some words own, and their partners."""

    def __init__(self, owners: list[tuple[str, int, str]]):
        """``owners``: word, count and side ("<" for its first segment, ">" for its second)."""
        self.rests: dict[str, dict[str, dict]] = {"<": {}, ">": {}}
        self.counts: dict[str, int] = {}
        for w, n, side in owners:
            cut = len(w) // 2
            segment, rest = (w[:cut], w[cut:]) if side == "<" else (w[cut:], w[:cut])
            index = self.rests[side].setdefault(segment, defaultdict(list))
            self.counts[w] = n
            for s in shortened(rest):
                index[s].append(w)
        self.finder = ahocorasick.Automaton()
        for segment in {*self.rests["<"], *self.rests[">"]}:
            self.finder.add_word(segment, segment)
        if len(self.finder):
            self.finder.make_automaton()

    def near(self, word: str) -> list[str]:
        """The owners one edit from ``word`` that share a segment of theirs with it, each once: by the second segment
        only where the first is not shared, which another shard may hold."""
        found: set[str] = set()
        if not len(self.finder):
            return []
        for end, segment in self.finder.iter(word):
            at, size = end + 1 - len(segment), len(word)
            sides = [side for side, fits in (("<", at == 0), (">", end + 1 == size)) if fits and segment in self.rests[side]]
            for side in sides:
                rest = word[len(segment) :] if side == "<" else word[:at]
                index = self.rests[side][segment]
                for w in {w for s in shortened(rest) for w in index.get(s, ())}:
                    if abs(len(w) - size) <= 1 and (side == "<" or not word.startswith(w[: len(w) // 2])) and one_edit(word, w):
                        found.add(w)
        return list(found)


def _scan(group: pd.DataFrame) -> pd.DataFrame:
    """One row a word of the shard with partners there: their number, the most frequent one and its count."""
    own = group[group["owns"]]
    shard = Shard(list(zip(own["word"], own["n"], own["side"], strict=True)))
    rows = []
    for word in group.loc[group["asks"], "word"].unique():
        if near := shard.near(word):
            best = min(near, key=lambda w: (-shard.counts[w], w))
            rows.append((word, len(near), shard.counts[best], best))
    return pd.DataFrame(rows, columns=["word", "n_near", "best_n", "best"])


def segment_rows(words: DataFrame) -> DataFrame:
    """A row for each segment that a word owns or asks for: word, n, side, segment, owns. A word of L code points asks
    for segments of the sizes that words of L - 1 to L + 1 code points have."""
    size = F.length("word")
    half, rest = F.floor(size / 2), F.ceil(size / 2)  # of first and second segments
    sizes = lambda f: F.array_distinct(F.array(*(f((size + d) / 2).cast("int") for d in (-1, 0, 1))))
    first = F.transform(sizes(F.floor), lambda k: F.struct(F.lit("<").alias("side"), F.left("word", k).alias("segment"), (k == half).alias("owns")))
    second = F.transform(sizes(F.ceil), lambda k: F.struct(F.lit(">").alias("side"), F.right("word", k).alias("segment"), (k == rest).alias("owns")))
    return words.select("word", "n", F.inline(F.concat(first, second)))


def neighbours(words: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, best_n, best of every word of ``words`` (word, n) with a near one."""
    words = saved(words)
    rows = segment_rows(words)
    hot = rows.groupBy("side", "segment").count().where(F.col("count") > most).withColumn("parts", F.ceil(F.col("count") / most).cast("int")).drop("count")
    rows = rows.join(saved(hot), ["side", "segment"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    home = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("owns", F.col("owns") & (F.col("part") == home))
    n = max(1, -(-4 * words.count() // most))
    shard = F.pmod(F.xxhash64("side", "segment", "part"), F.lit(n)).alias("shard")
    found = dealt.select(shard, "word", "n", "side", "owns", F.lit(True).alias("asks")).groupBy("shard").applyInPandas(_scan, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each row of ``forms`` (word, form): forms followed to the last. Counts grow along a chain by
    ``FORM_RATIO``, so it has no cycle and few steps, and each round doubles the steps that are taken."""
    now = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = saved(now.join(up, now["root"] == up["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").head(1):
            return now


def variants(docs: DataFrame) -> DataFrame:
    """One row a word of ``docs``: word, n, n_near, form, form_n, root."""
    words = saved(vocabulary(docs))
    near = words.join(neighbours(words), "word", "left")
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    named = saved(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir):
    out = variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


#: The same by SQL: words share what is left of them without the code point at one place, or one is the other without one.
OP11_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w
  FROM documents
), counted AS (
  SELECT doc_id, w, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs WHERE length(w) >= 7 GROUP BY ALL
), hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: (('0x' || substr(x, i, 2))::UTINYINT)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc
), spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cuts AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT DISTINCT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM near GROUP BY word
), named AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), followed AS (
  WITH RECURSIVE up AS (
    SELECT word, word AS root FROM named
    UNION ALL SELECT up.word, named.form FROM up JOIN named ON named.word = up.root WHERE named.form IS NOT NULL
  )
  SELECT up.word, up.root FROM up JOIN named ON named.word = up.root WHERE named.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM named JOIN followed USING (word)
"""
