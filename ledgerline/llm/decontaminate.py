"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to ``error_rate`` of its length in character edits. It is split into one piece more than
that budget, so at least one piece occurs unchanged; piece hits are found by one automaton over each text, and the
text around a hit is compared with the whole item by Myers' bit-parallel distance.

Both sides are compared in lower case with runs of white space as one space. Null and empty texts match nothing; null
or empty items match nothing. Items of under ``min_chars`` characters have no error budget and must stand between word
boundaries, as short strings come up by chance; with ``min_chars`` 0 all items are matched alike. An item is a pair of
item_id and plain text: rows that repeat it are one item, and texts that share an id are items of their own. Repeated
document rows repeat their results. Extra columns are left as they are.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import saved, small_batches

ERROR_RATE = 0.1
MIN_CHARS = 32
#: Characters of items that are matched in one pass over the documents; more items take more passes.
BLOCK_CHARS = 1_000_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, most: int) -> list[tuple[int, str]]:
    """Offset and text of each of ``most`` + 1 pieces of nearly equal length."""
    n = most + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def budget(item: str, error_rate: float, min_chars: int = MIN_CHARS) -> int:
    return int(len(item) * error_rate) if len(item) >= min_chars else 0


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text``, and the end of the first such substring."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = ((mh << 1) | ~((eq | mv) | ph)) & full
        mv = ph & (eq | mv) & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The automaton of all pieces of a block of items, and what their verification needs."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int = MIN_CHARS):
        self.ids = defaultdict(list)
        for i, t in dict.fromkeys((i, plain(t)) for i, t in items):
            if t:
                self.ids[t].append(i)
        self.min_chars = min_chars
        self.items = [(t, budget(t, error_rate, min_chars)) for t in self.ids]
        self.masks: dict = {}
        found = defaultdict(list)
        for k, (t, most) in enumerate(self.items):
            for at, piece in pieces(t, most):
                found[piece].append((k, at))
        self.finder = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.finder.add_word(piece, (len(piece), uses))
        if found:
            self.finder.make_automaton()

    def _masks(self, key, pattern: str):
        if key not in self.masks:
            self.masks[key] = char_masks(pattern)
        return self.masks[key]

    def _near(self, text: str, k: int, at: int, size: int, start: int) -> bool:
        """Whether the text around a hit also fits twice, then four times the piece within that part's share of the
        budget. Where the whole item fits, some hit passes: a part with the least errors for its length has a half
        that has too, down to a piece with none."""
        item, most = self.items[k]
        lo, hi, n = at, at + size, most + 1
        piece = next(p for p in range(n) if len(item) * p // n == at)
        for scale in (2, 4):
            first = piece // scale * scale
            a, b = len(item) * first // n, len(item) * min(n, first + scale) // n
            if b - a >= len(item) or (a, b) == (lo, hi):
                return True
            errors = min(n, first + scale) - first - 1
            window = text[max(0, start + a - at - errors) : start + b - at + errors]
            if myers(self._masks((k, a, b), item[a:b]), b - a, window)[0] > errors:
                return False
        return True

    def matches(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, errors allowed, end in the plain text) of each item: its least distance to any part of the
        text, and the end of the first such part."""
        text = plain(raw)
        if not text or not self.items:
            return []
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, set[int]] = defaultdict(set)
        for end, (size, uses) in self.finder.iter(text):
            for k, at in uses:
                item, most = self.items[k]
                start = end + 1 - size  # of the piece in the text
                whole = start - at
                if k in best and best[k][0] == 0 or whole in done[k]:
                    continue  # nothing is better, or this very window was searched
                if len(item) < self.min_chars:
                    if not (text[max(0, start - 1) : start].strip() or text[start + size : start + size + 1].strip()):
                        best[k] = (0, start + size)
                    continue
                if not self._near(text, k, at, size, start):
                    continue
                done[k].add(whole)
                a = max(0, whole - most)
                d, e = myers(self._masks((k,), item), len(item), text[a : whole + len(item) + most])
                if d <= most and (k not in best or (d, a + e) < best[k]):
                    best[k] = (d, a + e)
        return [(i, d, self.items[k][1], e) for k, (d, e) in best.items() for i in self.ids[self.items[k][0]]]


def _plain_items(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([plain(t) for t in b.column("text").to_pylist()], pa.string())], ["item_id", "text"])


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS):
    """The items as lists of (item_id, plain text) of about ``block_chars`` characters; one list is in memory at a time.
    Items are made plain before rows that repeat one become one, and are dealt by hash of both columns, so no block
    gathers copies and none is matched twice."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    named = saved(named.mapInArrow(_plain_items, "item_id long, text string").where("text <> ''").distinct())
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _found(block, error_rate, min_chars):
    def run(batches):
        own = Matcher(block.value, error_rate, min_chars)
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in own.matches(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "allowed", "end_char"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document row and item that occurs in it: doc_id, item_id, distance, allowed, end_char."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in item_blocks(items, block_chars):
        part = texts.mapInArrow(_found(spark.sparkContext.broadcast(block), error_rate, min_chars), "doc_id long, item_id long, distance long, allowed long, end_char long")
        out = part if out is None else out.union(part)
    return out


def _clean(block, error_rate, min_chars):
    def run(batches):
        own = Matcher(block.value, error_rate, min_chars)
        for b in batches:
            yield b.filter(pa.array([not own.matches(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item occurs."""
    small_batches(docs.sparkSession)
    for block in item_blocks(items, block_chars):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), error_rate, min_chars), docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, items)
