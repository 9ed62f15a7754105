"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Two texts are linked if the Jaccard similarity of their sets of word 5-grams is at least the threshold. A text of
fewer words is one gram; a text without words (null, empty or white space) is linked to nothing and is its own class.
What is linked are gram sets: each row has the set of its own text, whether its doc_id repeats or not, and links to
sets other than its own count once, however many rows have them. A row with a null doc_id is left unlinked, with a null
class. Columns other than doc_id and text are not read. An empty table gives no rows.

How it scales. Texts with the same gram set are one class from the start, by a map-side aggregation, so thousands of
copies cost as much as one. Band hashes of the classes meet in one shuffle; each bucket links its members to its
least member, which is linear in the bucket, and each member keeps the least of these. The connected components of these links hold every candidate pair, since
two members of one bucket hang on the same least member. Inside a component, classes are cut into cells by size (a
linked pair has sizes within the threshold of each other) and cells into blocks of bounded size; each pair of blocks
is one unit of work, which counts links and passes on only a spanning forest of them. So no pair list grows with the
square of a group, no unit of work grows with a group, and no link inside a component is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WordHashes, components, find_words, gram_hashes, saved, small_batches, text_keys

WORDS, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold itself shares a band; pairs above it do so more likely.
RECALL, MAX_HASHES = 0.9999, 128
BLOCK_DOCS, BLOCK_GRAMS = 256, 1_000_000
_CHUNK = 2048
#: What names a row's text: its doc_id and 96 bits of the text's hashes.
_ROW = ["doc_id", "text_key", "text_key2"]


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows a band, hence fewest false candidates, with which the recall is reached within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))))
        if bands * rows <= most:
            best = bands, rows
    assert best, "no banding reaches this recall"
    return best


def grams(text: str | None, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    return np.unique(gram_hashes(hashes(find_words(text or "")), n))


def band_hashes(g: np.ndarray, bands: int, rows: int, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(g), _CHUNK):
        np.minimum(low, ((g[k : k + _CHUNK, None] * mult + add) >> np.uint64(1)).min(0), out=low)
    low = low.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = (out ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _signed(bands: int, rows: int, n: int):
    def run(batches):
        import xxhash

        rng = np.random.default_rng(20240101)
        mult = rng.integers(1, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, bands * rows, np.uint64)
        hashes = WordHashes()
        for b in batches:
            keys, sizes, sigs = [], [], []
            for t in b.column("text").to_pylist():
                g = grams(t, hashes, n)
                sizes.append(len(g))
                keys.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                sigs.append(band_hashes(g, bands, rows, mult, add) if len(g) else None)
            made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _ROW), *made], [*_ROW, "set_key", "n_grams", "bands"])

    return run


def _grammed(n: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            found = [grams(t, hashes, n).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("comp", "cell", "id", "n_blocks", "n_next", "n_last")), pa.array(found, pa.list_(pa.int64()))], ["comp", "cell", "id", "n_blocks", "n_next", "n_last", "grams"])

    return run


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], stack = False, [root]
        while stack:
            u = stack.pop()
            new = np.flatnonzero(linked[u] & left)
            left[new] = False
            out += [(u, int(v)) for v in new]
            stack += new.tolist()
    return out


def links(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of links among sets; side 0 meets all, 1 meets 2 only."""
    sizes = np.array([len(s) for s in sets], np.float64)
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    keep = seen[at] > 1
    at, row = at[keep], row[keep]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    column = np.cumsum(np.concatenate([[0], np.diff(at) != 0])) if len(at) else at
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, 4_000_000 // max(1, len(sets)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), min(width, int(column[-1]) + 1 - lo)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    out = both * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(out, False)
    return out & ((side[:, None] != side[None, :]) | (side[:, None] == 0))


def _verified(threshold: float):
    def work(ids, sides, sets):
        linked = links(sets, np.array(sides), threshold)
        counts = linked.sum(1)
        rows = [(i, None, int(n)) for i, n in zip(ids, counts, strict=True) if n]
        return rows + [(ids[u], ids[v], 0) for u, v in forest(linked)]

    def run(batches):
        task, ids, sides, sets = None, [], [], []
        for b in batches:
            out = []
            flat = np.asarray(b.column("grams").values)
            ends = np.asarray(b.column("grams").offsets)
            for k, (t, i, s) in enumerate(zip(b.column("task").to_pylist(), b.column("id").to_pylist(), b.column("side").to_pylist(), strict=True)):
                if t != task:
                    out += work(ids, sides, sets) if len(ids) > 1 else []
                    task, ids, sides, sets = t, [], [], []
                ids.append(i)
                sides.append(s)
                sets.append(flat[ends[k] : ends[k + 1]].copy())
            yield _rows(out)
        if len(ids) > 1:
            yield _rows(work(ids, sides, sets))

    return run


def _rows(rows):
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n"])


def block_tasks(threshold: float):
    """Explodes a member of a cell into the pairs of blocks that its block is in: a column of structs (task, side)."""
    own = F.pmod(F.xxhash64("id"), F.col("n_blocks"))
    key = lambda *parts: F.concat_ws(":", "comp", *[p.cast("string") for p in parts])
    seq = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    made = lambda r, f: F.transform(r, f)
    pair = lambda t, s: F.struct(t.alias("task"), s.cast("int").alias("side"))
    inside_first = made(seq(own, F.col("n_blocks") - one), lambda b: pair(key(F.col("cell"), own, F.col("cell"), b), F.when(b == own, 0).otherwise(1)))
    inside_second = made(seq(zero, own - one), lambda b: pair(key(F.col("cell"), b, F.col("cell"), own), F.lit(2)))
    above = made(seq(zero, F.col("n_next") - one), lambda b: pair(key(F.col("cell"), own, F.col("cell") + 1, b), F.lit(1)))
    below = made(seq(zero, F.col("n_last") - one), lambda b: pair(key(F.col("cell") - 1, b, F.col("cell"), own), F.lit(2)))
    return F.explode(F.concat(inside_first, inside_second, above, below))


def classified(docs: DataFrame, threshold: float, n: int, recall: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, the keys of its text, first and head (doc_id and keys of the least text with
    its gram set, and of the least in its class), n_links and n_copies, all four null where it has no set."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = bands_and_rows(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", *text_keys(F.col("text")), "text")
    signed = saved(texts.mapInArrow(_signed(bands, rows, n), "doc_id long, text_key long, text_key2 int, set_key binary, n_grams long, bands array<long>"))
    known = signed.where("doc_id is not null and set_key is not null")
    sets = known.groupBy("set_key").agg(F.min(F.struct(*_ROW)).alias("first"), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    sets = saved(sets.withColumn("id", F.monotonically_increasing_id()))
    banded = sets.select("id", F.explode("bands").alias("band"))
    heads = saved(banded.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("band", "head"))
    # a member hangs on the least of its buckets' heads, and so do the other heads: one link a member, not one a band
    hung = banded.join(heads, "band").groupBy("id").agg(F.min("head").alias("b"), F.collect_set("head").alias("heads"))
    edges = hung.select(F.explode(F.array_append("heads", F.col("id"))).alias("a"), "b").where("a <> b").distinct()
    comps = components(edges)

    cell = F.floor(F.log(F.col("n_grams").cast("double")) / float(np.log(1 / threshold)) + 1e-9).cast("long")
    members = saved(comps.join(sets.select("id", "n_grams", "first.*"), "id").select("id", "comp", "n_grams", cell.alias("cell"), *_ROW))
    sizes = members.groupBy("comp", "cell").agg(F.count("*").alias("docs"), F.sum("n_grams").alias("grams"))
    whole = members.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n_grams").alias("grams")).where((F.col("docs") > BLOCK_DOCS) | (F.col("grams") > BLOCK_GRAMS)).select("comp")
    large = sizes.join(whole, "comp").select("comp", "cell", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long").alias("n_blocks"))
    large = saved(large)
    near = lambda by, name: large.select("comp", (F.col("cell") + by).alias("cell"), F.col("n_blocks").alias(name))
    cells = saved(large.join(near(-1, "n_next"), ["comp", "cell"], "left").join(near(1, "n_last"), ["comp", "cell"], "left").na.fill(0, ["n_next", "n_last"]))
    counts = (F.coalesce(c, F.lit(v)).cast("long").alias(c) for c, v in (("n_blocks", 1), ("n_next", 0), ("n_last", 0)))
    placed = members.join(cells, ["comp", "cell"], "left").select("comp", F.when(F.col("n_blocks").isNull(), 0).otherwise(F.col("cell")).alias("cell"), "id", *counts, *(F.col(c).alias(f"_{c}") for c in _ROW))
    named = saved(placed)
    # a text that rows repeat goes to the join once, by a map-side aggregation
    once = texts.where("doc_id is not null").groupBy(*_ROW).agg(F.first("text").alias("text"))
    same = (F.col("_doc_id") == F.col("doc_id")) & (F.col("_text_key") == F.col("text_key")) & (F.col("_text_key2") == F.col("text_key2"))
    full = named.hint("merge").join(once, same).select("comp", "cell", "id", "n_blocks", "n_next", "n_last", "text")
    schema = "comp long, cell long, id long, n_blocks long, n_next long, n_last long, grams array<long>"
    with_grams = full.mapInArrow(_grammed(n), schema)
    units = with_grams.withColumn("_t", block_tasks(threshold)).select(F.col("_t.task").alias("task"), "id", F.col("_t.side").alias("side"), "grams")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = units.repartition(parts, "task").sortWithinPartitions("task")
    found = saved(ordered.mapInArrow(_verified(threshold), "a long, b long, n long"))

    linked = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    about = sets.select("id", "set_key", "first", "n_copies").join(linked, "id", "left").join(components(found.where("b is not null").select("a", "b")), "id", "left")
    about = saved(about.select("set_key", "first", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "comp"))
    tops = about.where("comp is not null").groupBy(F.col("comp").alias("_comp")).agg(F.min("first").alias("top"))
    about = saved(about.join(tops, F.col("comp") == F.col("_comp"), "left").select("set_key", "first", F.coalesce("top", "first").alias("head"), "n_links", "n_copies"))
    own = signed.select(*_ROW, F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    return own.join(about, "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, rep_id (least doc_id with the same gram set), class_id (least doc_id over
    all links, direct or not), n_links (other gram sets it is linked to) and n_copies (rows with its gram set)."""
    found = classified(docs, threshold, n, recall)
    return found.select(
        "doc_id", F.coalesce("first.doc_id", "doc_id").alias("rep_id"), F.coalesce("head.doc_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` but those of which a class keeps another: each class keeps its text of least doc_id, and of
    texts with that doc_id one. Rows that share doc_id and text stay or go together; rows with a null doc_id stay."""
    found = classified(docs, threshold, n, recall)
    gone = saved(found.where(F.struct(*_ROW) != F.col("head")).select(*(F.col(c).alias(f"_{c}") for c in _ROW)).distinct())
    rows = docs.select(F.struct("*").alias("row"))
    keyed = rows.select("row", F.col("row.doc_id").cast("long").alias("_id"), *text_keys(F.col("row.text")))
    same = (F.col("_id") == F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("text_key2") == F.col("_text_key2"))
    return keyed.join(gone.hint("merge"), same, "left_anti").select("row.*")


def op3_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
