"""Collocations: phrases of 2 to 3 words that stand together more often than their parts make likely, per language.

A first pass over the texts adds every word and phrase to a sketch: a row of cells, each with the number of occurrences
that hash to it, which is an upper bound for each of them. A phrase may be frequent only where its cell, and those of the
phrases within it, reach the least count; cells that do are kept as bits. A second pass cuts the texts into shards of
``SHARD_CHARS``. The phrases of a shard that the bits admit are compiled into one automaton a language, each guarded by
delimiters at both ends, and the automaton scans the shard and counts all matches, overlapping ones too. Counts of all
shards are summed, and only then thresholds apply. What the sketch admits wrongly falls there, and it rejects nothing
that is frequent, so results are exact at any size of sketch. Its cells grow with the corpus up to ``MOST_CELLS``,
beyond which it admits more, and more partial counts meet in the sum.

Null texts count as empty, a null lang is "und". Repeated rows count again, ties follow score, a and phrase. Tables
without phrases give no rows. Columns other than text and lang are not read.
"""

from __future__ import annotations

from collections import defaultdict
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import mixed, saved, small_batches

MIN_COUNT = 10
#: Part of a phrase's occurrences, in hundredths, that lie within one longer candidate where it is dropped for it.
WITHIN_PCT = 50
MOST_RANKED = 2000
#: Characters of text that a task holds, and scans by one set of automata.
SHARD_CHARS = 12_000_000
#: Least and most cells of the sketch; the bits of the most are 32 MB, which is all that the driver and workers get.
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 28
#: Parts of the sketch that are summed apart.
_BLOCKS = 256

_TO_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
#: Words that are held as strings before they are numbered, and different words that a task keeps numbered.
HELD_WORDS = 200_000
KNOWN_WORDS = 400_000


def tokens(text: str | None) -> list[str]:
    """The words of a text, A-Z in lower case, with a line feed between pieces and empty strings between blanks."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_PIECES)
    return low.replace(b"\n", b" \n ").decode("utf-8", "surrogatepass").split(" ")


class Words:
    """Numbers words; number 0 is the end of a piece, 1 no word. Hashes are by number."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.number = {"\n": 0, "": 1}
        self.names, self.hashes = ["\n", ""], np.zeros(1 << 16, np.uint64)

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.number
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = set(words).difference(known)
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            self.names += new
            if len(known) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(len(known), np.uint64)])
            self.hashes[at : len(known)] = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new), np.uint64, len(new))
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


class Shard:
    """The words of some texts of one language, piece after piece, and the hashes of their phrases."""

    def __init__(self, lang: str, ids: np.ndarray, known: Words, cells: int):
        self.ids = ids
        self.known, self.shift = known, np.uint64(64 - (cells.bit_length() - 1))
        of_lang = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
        h = mixed(known.hashes[ids] + of_lang)
        self.used = np.unique(ids[ids > 0])
        self.singles = mixed(known.hashes[self.used] + of_lang)
        self.single_counts = np.bincount(ids)[self.used] if len(ids) else ids
        is_word = ids > 0
        self.pair_at = np.flatnonzero(is_word[:-1] & is_word[1:])
        pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        self.pairs = pair[self.pair_at]
        self.triple_at = np.flatnonzero(is_word[:-2] & is_word[1:-1] & is_word[2:])
        self.first, self.second = pair[self.triple_at], pair[self.triple_at + 1]
        self.triples = mixed(self.first * np.uint64(0xC2B2AE3D27D4EB4F) + self.second)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The cells of all words and phrases, and how many occurrences fall into each."""
        cells, n = np.unique(np.concatenate([self.pairs, self.triples]) >> self.shift, return_counts=True)
        own = self.singles >> self.shift
        both, at = np.unique(np.concatenate([cells, own]), return_inverse=True)
        return both, np.bincount(at, weights=np.concatenate([n, self.single_counts]), minlength=len(both)).astype(np.int64)

    def counts(self, bits: np.ndarray) -> tuple[list[str], list[int]]:
        """Words and phrases that ``bits`` admit, with their occurrences in this shard; all words together as ""."""

        def likely(h):
            c = h >> self.shift
            return (bits[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0

        names = self.known.names
        ok = likely(self.singles)
        out, n = [names[i] for i in self.used[ok].tolist()], self.single_counts[ok].tolist()
        out.append("")
        n.append(int(self.single_counts.sum()))
        ok2, ok3 = likely(self.pairs), likely(self.first) & likely(self.second) & likely(self.triples)
        finder, found = ahocorasick.Automaton(), []
        for at, h, size in ((self.pair_at[ok2], self.pairs[ok2], 2), (self.triple_at[ok3], self.triples[ok3], 3)):
            one = at[np.unique(h, return_index=True)[1]]  # one occurrence of each, by hash
            found += [" ".join(names[i] for i in p) for p in self.ids[one[:, None] + np.arange(size)].tolist()]
        if not found:
            return out, n
        for k, p in enumerate(found):
            finder.add_word(f" {p} ", k)
        finder.make_automaton()
        # every admitted phrase lies within a run of words of which each two neighbours are admitted: only runs are scanned
        linked = np.zeros(len(self.ids) + 1, bool)
        linked[self.pair_at[ok2] + 1] = True  # to the word before
        run = linked[:-1] | linked[1:]
        at = np.flatnonzero(run)
        starts = np.flatnonzero(~linked[at])
        text = " ".join(map(names.__getitem__, np.insert(self.ids[at], starts, 0).tolist()))
        hits = np.bincount(np.fromiter(map(itemgetter(1), finder.iter(f" {text} ")), np.int64), minlength=len(found))
        return out + found, n + hits.tolist()


def _shards(batches, cells):
    """The texts of a task by language, in shards of bounded size; a longer text is one of its own."""
    known, held, numbered, size = Words(), defaultdict(list), defaultdict(list), 0

    def number(lang):
        ids = known(held[lang])
        numbered[lang].append(ids[ids != 1].astype(np.int32))
        held[lang] = []

    def flush():
        for lang in list(held):
            number(lang)
        for lang in list(numbered):
            yield lang, Shard(lang, np.concatenate(numbered.pop(lang)), known, cells)
        held.clear()
        if len(known.names) > KNOWN_WORDS:
            known.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            size += len(text or "")
            if text:
                held[lang] += tokens(text)
                held[lang].append("\n")
                if len(held[lang]) > HELD_WORDS:
                    number(lang)
            if size > SHARD_CHARS:
                yield from flush()
                size = 0
    yield from flush()


def _sketched(cells, least):
    """Cells of a shard with their counts, in rows of one block of cells each; counts past ``least`` say no more."""

    def run(batches):
        for _, shard in _shards(batches, cells):
            c, n = shard.cells()
            block, first = np.unique(c // np.uint64(cells // _BLOCKS), return_index=True)
            low, n = (c % np.uint64(cells // _BLOCKS)).astype("<u4"), np.minimum(n, least).astype("<u2")
            ends = [*first.tolist(), len(c)][1:]
            spans = list(zip(first.tolist(), ends, strict=True))
            cols = [pa.array(block.astype(np.int64)), pa.array([low[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([n[a:z].tobytes() for a, z in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "low", "n"])

    return run


def _summed(cells, least):
    """Sums the rows of each block, and keeps a bit for every cell that reaches ``least``."""

    def run(batches):
        blocks = defaultdict(lambda: np.zeros(cells // _BLOCKS, np.uint32))
        for b in batches:
            for k, low, n in zip(*(b.column(c).to_pylist() for c in ("block", "low", "n")), strict=True):
                blocks[k][np.frombuffer(low, "<u4")] += np.frombuffer(n, "<u2")
        bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks.keys(), pa.int64()), pa.array(bits, pa.binary())], ["block", "bits"])

    return run


def sketch(texts: DataFrame, cells: int, least: int) -> np.ndarray:
    """One bit a cell: whether the phrases that hash to it occur ``least`` times together."""
    parts = texts.mapInArrow(_sketched(cells, least), "block long, low binary, n binary")
    dealt = parts.repartition(_BLOCKS // 4, "block")
    bits = np.zeros(cells // 8, np.uint8)
    for r in dealt.mapInArrow(_summed(cells, least), "block long, bits binary").toLocalIterator():
        at = r["block"] * (cells // _BLOCKS // 8)
        bits[at : at + cells // _BLOCKS // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _scanned(bits, cells):
    def run(batches):
        for lang, shard in _shards(batches, cells):
            found, n = shard.counts(np.frombuffer(bits.value, np.uint8))
            cols = [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "n"])

    return run


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, cells: int | None = None) -> DataFrame:
    """lang, phrase, n of each word and each phrase of 2 to 3 words that occurs ``least`` times or more, and of all words of a
    lang as the phrase ""."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    if cells is None:
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (chars // 8).bit_length()))
    bits = spark.sparkContext.broadcast(sketch(texts, cells, least).tobytes())
    return texts.mapInArrow(_scanned(bits, cells), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of each phrase in ``counts`` (as by phrase_counts) at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, 3), " ").alias("right"))
    size = F.size(words)
    cuts = counts.where(size > 1).select("lang", "phrase", F.col("n").alias("a"), F.inline(F.when(size == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))))
    part = lambda c, n: counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    ratio = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")).cast("decimal(31,0)"), exact("l") * exact("r"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.withColumn("score", ratio).groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def independent(phrases: DataFrame, within_pct: int = WITHIN_PCT) -> DataFrame:
    """The rows of ``phrases`` that do not lie within one longer phrase for ``within_pct`` of their occurrences."""
    words = F.split("phrase", " ")
    inner = F.array(*(F.array_join(F.slice(words, k, 2), " ") for k in (1, 2)))
    longer = phrases.where(F.size(words) == 3).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    return phrases.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longest IS NULL OR 100 * longest < {within_pct} * a")).drop("longest")


def ranked(phrases: DataFrame, most: int = MOST_RANKED) -> DataFrame:
    """Each lang's first ``most`` phrases, ranked. A part of a lang is ranked first, so no task sorts a whole lang."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
    first = phrases.withColumn("rank", in_part).where(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = MIN_COUNT, most: int = MOST_RANKED, cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first phrases; n is the number of the lang's words."""
    small_batches(docs.sparkSession)
    counts = saved(phrase_counts(docs, least, cells))
    best = ranked(independent(saved(scored(counts))), most)
    return best.join(counts.where("phrase = ''").select("lang", F.col("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS MATERIALIZED (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), totals AS (
  SELECT lang, count(*) AS n FROM places GROUP BY lang
), f AS MATERIALIZED (
  SELECT lang, [x] AS p, count(*) AS f FROM places GROUP BY lang, x HAVING count(*) >= 10
  UNION ALL SELECT lang, [x, y], count(*) FROM places WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= 10
  UNION ALL SELECT lang, [x, y, z], count(*) FROM places WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, l.f AS l, r.f AS r, k, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:len(c.p)]
), scored AS (
  SELECT lang, p, a, unnest(arg_min({'l': l, 'r': r, 'score': score}, (score, k))) FROM cuts GROUP BY lang, p, a
), longest AS (
  SELECT lang, inner_p, max(f) AS longest FROM (SELECT lang, unnest([p[1:2], p[2:3]]) AS inner_p, f FROM f WHERE len(p) = 3) GROUP BY ALL
), kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM scored s LEFT JOIN longest o ON o.lang = s.lang AND o.inner_p = s.p WHERE longest IS NULL OR 100 * longest < 50 * a
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranks JOIN totals USING (lang) WHERE rank <= 2000
"""
