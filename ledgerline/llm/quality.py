"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Null or empty texts count as texts without words. Every input row gives one row, so repeated rows give repeated
results; a null doc_id stays null. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import find_words, saved, small_batches

SYMBOLS = "#*$%&|<>"
#: The weight of what rules are written for, as a part of all texts.
PRIOR = 0.1

_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ended", "n_bangs", "n_distinct"]
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _STATS)


def text_stats(text: str | None) -> list[int]:
    """The counts of one text, in the order of _STATS."""
    text = text or ""
    words = find_words(text)
    n = len(words)
    seen: set[str] = set()
    dup = lines = ended = 0
    for line in text.split("\n"):
        if line and find_words(line):
            lines += 1
            ended += line.rstrip("\x20\t\r\x0b\x0c")[-1:] in ".!?:;\"'"
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        counts = Counter(grams)
        if len(counts) < len(grams):
            hit = np.fromiter((counts[g] > 1 for g in grams), bool, len(grams))
            cover = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(hit)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeat = int((np.cumsum(cover)[:n] > 0).sum())
    symbols = sum(map(text.count, SYMBOLS))
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    return [n, sum(map(len, words)), symbols, dup, repeat, lines, upper, upper + lower, ended, text.count("!"), len(set(words))]


def _stats(batches):
    for b in batches:
        rows = [text_stats(t) for t in b.column("text").to_pylist()]
        cols = np.array(rows, np.int64).reshape(-1, len(_STATS)).T
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols)], ["doc_id", *_STATS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stats, _SCHEMA)


def rules() -> dict:
    """Name to (vote, when): a rule votes 1 (good) or -1 (bad) where its condition holds and abstains elsewhere, also
    where its ratio is null."""
    per_word = lambda c: F.col(c) / F.nullif(F.col("n_words"), F.lit(0))
    per_line = lambda c: F.col(c) / F.nullif(F.col("n_lines"), F.lit(0))
    upper = F.col("n_upper") / F.nullif(F.col("n_letters"), F.lit(0))
    mean = per_word("word_chars")
    return {
        "symbols": (-1, per_word("n_symbols") > 0.1),
        "capitals": (-1, upper > 0.4),
        "dup_lines": (-1, (F.col("n_dup_lines") >= 2) & (per_line("n_dup_lines") > 0.3)),
        "repeats": (-1, per_word("n_repeat_words") > 0.15),
        "bangs": (-1, per_word("n_bangs") > 0.1),
        "word_length": (-1, (mean < 2) | (mean > 14)),
        "variety": (-1, F.col("n_words").between(20, 200) & (per_word("n_distinct") < 0.3)),
        "prose": (1, (per_line("n_ended") > 0.5) & mean.between(3, 9) & (F.col("n_words") >= 30)),
        "clean": (1, (per_word("n_symbols") < 0.01) & (upper < 0.2)),
    }


def fit_rules(patterns: list[tuple[list[int], int]], votes_for: list[int], rounds: int = 50) -> np.ndarray:
    """EM over the patterns of rules that voted, with their counts: the log odds of a good text as [bias, then for each
    rule (if it abstains, if it votes)]. There are at most 2 ** rules patterns, whatever the corpus.

    The priors say what a rule is written for: to vote where it is right. They weigh PRIOR of all texts, so that a rule
    which fires on a frequent kind of junk is not taken for a property of good texts."""
    fired = np.array([p for p, _ in patterns], bool).reshape(-1, len(votes_for))
    count = np.array([c for _, c in patterns], float)
    against, weight = np.array(votes_for) < 0, PRIOR * count.sum() + 1
    mean = np.where(against, [[0.25], [0.01]], [[0.3], [0.8]])  # how often it fires on bad texts, on good ones
    bad_vote = fired[:, against].any(1)
    post = np.where(bad_vote, 0.1, 0.95)
    for _ in range(rounds):
        part = np.stack([(1 - post) * count, post * count])
        share = (part[1].sum() + 0.8 * weight) / (count.sum() + weight)
        fires = (part @ fired + weight * mean) / (part.sum(1, keepdims=True) + weight)
        odds = np.stack([np.log((1 - fires[1]) / (1 - fires[0])), np.log(fires[1] / fires[0])])
        logit = np.log(share / (1 - share)) + np.where(fired, odds[1], odds[0]).sum(1)
        post = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return np.array([np.log(share / (1 - share)), *odds.T.ravel()])


def score_quality(docs: DataFrame, keep_above: float = 0.5) -> DataFrame:
    """Per row: the counts, base_failed, p_good (posterior) and kept. Texts are read once; the counts of all of them
    are written out, their vote patterns counted over the whole corpus, and only those counts reach the driver."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = saved(measured(docs)).withColumn("base_failed", failed)
    named = rules()
    voted = stats.select("*", *(F.coalesce(when, F.lit(False)).alias(f"vote_{k}") for k, (_, when) in named.items()))
    cols = [f"vote_{k}" for k in named]
    found = [([r[c] for c in cols], r["count"]) for r in voted.where("not base_failed").groupBy(*cols).count().collect()]
    bias, *odds = map(float, fit_rules(found, [v for v, _ in named.values()]))
    logit = F.lit(bias)
    for k, c in enumerate(cols):
        logit = logit + F.when(F.col(c), odds[2 * k + 1]).otherwise(odds[2 * k])
    return voted.withColumn("p_good", 1 / (1 + F.exp(-logit))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_above))


def op1_quality(spark, sf_dir):
    out = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
