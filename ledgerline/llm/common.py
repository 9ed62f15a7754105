"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and the controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD_PATTERN).findall

#: Rows and bytes that travel to Python in one Arrow batch at most; a longer row is a batch of its own.
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 32 << 20

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_CACHED_WORDS = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where that is unset, one of our own on a machine
    that is driver and executor at once, and an error on a cluster, whose machines share no folder of ours."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, and its size is known."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch by the session's settings, which stay so, as plans read them when they
    run. Tighter settings of the session are kept."""
    for key, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def count_words(text):
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_keys(text) -> list:
    """What tells a document from others of its doc_id, as columns."""
    text = text.cast("string")
    return [F.xxhash64(text).alias("text_key"), F.hash(text).alias("text_key2")]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash: every input bit sways every output bit."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words, kept in a table of bounded size. ``norm`` is applied to a word before hashing."""

    def __init__(self, norm=None):
        self.known: dict[str, int] = {}
        self.norm = norm

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > _CACHED_WORDS:
                known.clear()
            norm, digest = self.norm, xxhash.xxh3_64_intdigest
            for w in set(words).difference(known):
                known[w] = digest((norm(w) if norm else w).encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


#: Words are hashed as polynomials of their bytes, so many bytes at a time (a longer word is a block of its own).
_BLOCK = 1 << 16
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX2)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE, and of its inverse, modulo 2 ** 64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


_UP, _DOWN = _powers(_BLOCK)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and where each text's begin, with the end of the last.
    Nulls have no words. Bytes are looked at in place: only the bytes of white space are below 128 and part words."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    _, where, data = texts.buffers()
    o = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data else np.zeros(0, np.uint8)
    o = o - o[0]
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    heads, tails = o[:-1][o[:-1] < len(data)], o[1:][o[1:] > 0] - 1
    first[heads], last[tails] = ~space[heads], ~space[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        n = int(ends[to - 1] - lo)
        up, down = (_UP, _DOWN) if n <= _BLOCK else _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data[lo : lo + n]] * up[:n], out=sums[1:])
        s = starts[at:to] - lo
        out[at:to] = (sums[ends[at:to] - lo] - sums[s]) * down[s]
        at = to
    return mixed(out), np.searchsorted(starts, o)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words; of all words together where there are fewer than n, none where there are none."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    # polynomials of 1, 2, 4, ... words; those that n is the sum of are put together
    power, size, base, done, out = h, 1, _BASE, 0, None
    while True:
        if n & size:
            out = power if out is None else out[: len(h) - done - size + 1] * np.uint64(base) + power[done:]
            done += size
        size *= 2
        if size > n:
            return mixed(out)
        power = power[: len(power) - size // 2] * np.uint64(base) + power[size // 2 :]
        base = base * base % (1 << 64)


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """The least or greatest (np.minimum, np.maximum) of each w values of x in a row."""
    size = 1
    while size * 2 <= w:
        x, size = op(x[:-size], x[size:]), size * 2
    return op(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (id, comp) per vertex, comp the least id reached.

    Every vertex takes the least label around it, then the label of its label, until the sum of labels stands still,
    so rounds grow with the logarithm of a component's diameter. Each half round is written out, so that a hub's rows
    meet in a sort-merge join of two plain exchanges, which adaptive execution can split.
    """
    e = edges.where("a <> b").select("a", "b")
    both = saved(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    total = None
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        hooked = saved(labels.join(around, F.col("id") == F.col("a")).select("id", F.least("comp", "m").alias("comp")))
        up = hooked.select(F.col("id").alias("up"), F.col("comp").alias("top"))
        labels = saved(hooked.join(up, F.col("comp") == F.col("up")).select("id", F.col("top").alias("comp")))
        now = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
