"""Prompt search: an inverted index as a table, prefix terms joined by AND, bm25 order, hits by session.

The index is (token, doc, n, at), sorted by token. ``index_hits`` reads the postings of a query's terms only: their prefixes
are pushed down to the Parquet scan, where the order of tokens prunes row groups. ``matches`` and ``ranked`` do the same
over texts without an index, in one pass over their tokens. Scores are those of bm25 with k1 1.2 and b 0.75; another engine
may order ties otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.scratch import cut

K1, B = 1.2, 0.75
INDEXED_CHARS = 2000
SNIPPET_TOKENS = 8
MAX_HITS = 500


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[list[str]]:
    """Each white-space part of a query as its tokens: more than one is a phrase, whose last is a prefix."""
    import re

    parts = [[t for t in re.split(r"[\W_]+", p.lower()) if t] for p in query.split()]
    return [p for p in parts if p]


def searchable(steps: DataFrame) -> DataFrame:
    """Prompts, cut to what is indexed."""
    return steps.where("kind = 'prompt'").withColumn("text", F.substring("text", 1, INDEXED_CHARS))


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of docs (doc, text): token, doc, n and at (positions); doc and length."""
    listed = docs.select("doc", tokens(F.col("text")).alias("t"))
    postings = listed.select("doc", F.posexplode("t").alias("pos", "token")).groupBy("token", "doc").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("pos")).alias("at"))
    return postings, listed.select("doc", F.size("t").alias("length"))


def _held(terms: list[list[str]]) -> Column:
    """Whether the tokens in _t hold every term."""

    def held(term: list[str]) -> Column:
        n = len(term)
        if n == 1:
            return F.exists("_t", lambda x: F.startswith(x, F.lit(term[0])))
        at = F.sequence(F.lit(0), F.size("_t") - n)
        fits = lambda k: _every([F.get("_t", k + i) == term[i] for i in range(n - 1)]) & F.startswith(F.get("_t", k + (n - 1)), F.lit(term[-1]))
        return F.when(F.size("_t") >= n, F.exists(at, fits)).otherwise(False)

    return _every([held(x) for x in terms])


def matches(docs: DataFrame, query: str) -> DataFrame:
    """Docs that hold every term; without terms none."""
    terms = query_terms(query)
    if not terms:
        return docs.where("false")
    return docs.withColumn("_t", tokens(F.col("text"))).where(_held(terms)).drop("_t")


def _every(parts) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _bm25(parts: list[tuple], length: Column, docs: Column, mean: Column) -> Column:
    """Score of a doc from (uses, docs that have the term) of each term."""
    score = F.lit(0.0)
    for n, having in parts:
        score = score + F.log((docs - having + 0.5) / (having + 0.5) + 1) * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))
    return score


def _snippet(words: Column, prefix: str) -> Column:
    first = F.array_position(F.transform(words, lambda x: F.startswith(x, F.lit(prefix))), True)
    return F.array_join(F.slice(words, F.greatest(first - SNIPPET_TOKENS // 2, F.lit(1)).cast("int"), SNIPPET_TOKENS), " ")


def ranked(docs: DataFrame, query: str, most: int = MAX_HITS) -> DataFrame:
    """The best ``most`` matching docs with score and snippet, best first. ``docs`` has doc and text. Texts are taken
    apart once, into a row of counts each; the best docs are joined back to their own columns."""
    terms = query_terms(query)
    if not terms:
        return docs.where("false").withColumns({"score": F.lit(0.0), "snippet": F.lit("")})
    has = lambda term: F.size(F.filter("_t", lambda x: F.startswith(x, F.lit(term[-1]))))
    listed = docs.select("doc", tokens(F.col("text")).alias("_t"))
    counted = cut(listed.select("doc", F.size("_t").alias("_n"), _held(terms).alias("_held"), *(has(t).alias(f"_n{k}") for k, t in enumerate(terms))))
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *(F.count_if(F.col(f"_n{k}") > 0).alias(f"_df{k}") for k in range(len(terms))))
    score = _bm25([(F.col(f"_n{k}"), F.col(f"_df{k}")) for k in range(len(terms))], F.col("_n"), F.col("_docs"), F.col("_mean"))
    best = counted.where("_held").crossJoin(F.broadcast(stats)).select("doc", score.alias("score")).orderBy(F.desc("score"), "doc").limit(most)  # stats are one row
    out = docs.join(F.broadcast(best), "doc")  # ``most`` rows
    return out.select(*docs.columns, "score", _snippet(tokens(F.col("text")), terms[0][-1]).alias("snippet")).orderBy(F.desc("score"), "doc")


def index_hits(postings: DataFrame, lengths: DataFrame, query: str, most: int = MAX_HITS) -> DataFrame:
    """The best ``most`` docs that hold every term, by the index alone: doc and score, best first."""
    terms = query_terms(query)
    if not terms:
        return postings.where("false").select("doc", F.lit(0.0).alias("score"))
    prefixes = [t[-1] for t in terms]
    begins = [F.startswith("token", F.lit(p)) for p in prefixes]
    exact = sorted({x for t in terms for x in t[:-1]})
    read = postings.where(_any([*begins, *([F.col("token").isin(exact)] if exact else [])]))
    uses = read.groupBy("doc").agg(*(F.sum(F.when(w, F.col("n")).otherwise(0)).alias(f"_n{k}") for k, w in enumerate(begins)))
    for k, term in enumerate(terms):
        if len(term) == 1:
            held = F.col(f"_n{k}") > 0
            uses = uses.withColumn(f"_h{k}", held)
            continue
        # places where each token of the phrase stands as far from its start as it should
        own = [F.when(F.startswith("token", F.lit(x)) if i == len(term) - 1 else F.col("token") == x, F.lit(i)) for i, x in enumerate(term)]
        at = read.select("doc", F.explode(F.array(*own)).alias("i"), "at").where("i is not null").select("doc", "i", F.explode("at").alias("place")).select("doc", "i", (F.col("place") - F.col("i")).alias("start"))
        whole = at.groupBy("doc", "start").agg(F.count_distinct("i").alias("m")).where(F.col("m") == len(term)).select("doc").distinct().withColumn(f"_h{k}", F.lit(True))
        uses = uses.join(whole, "doc", "left")
    stats = lengths.agg(F.count("*").alias("_docs"), F.avg("length").alias("_mean")).crossJoin(uses.agg(*(F.count_if(F.col(f"_n{k}") > 0).alias(f"_df{k}") for k in range(len(terms)))))
    held = uses.where(_every([F.coalesce(f"_h{k}", F.lit(False)) for k in range(len(terms))])).join(lengths, "doc").crossJoin(F.broadcast(stats))  # one row
    score = _bm25([(F.col(f"_n{k}"), F.col(f"_df{k}")) for k in range(len(terms))], F.col("length"), F.col("_docs"), F.col("_mean"))
    return held.select("doc", score.alias("score")).orderBy(F.desc("score"), "doc").limit(most)


def index_ranked(postings: DataFrame, lengths: DataFrame, docs: DataFrame, query: str, most: int = MAX_HITS) -> DataFrame:
    """As ``ranked``, by the index; ``docs`` is read for the hits' own columns and snippets only."""
    terms = query_terms(query)
    out = docs.join(F.broadcast(index_hits(postings, lengths, query, most)), "doc")  # ``most`` rows
    snippet = _snippet(tokens(F.col("text")), terms[0][-1]) if terms else F.lit("")
    return out.select(*docs.columns, "score", snippet.alias("snippet")).orderBy(F.desc("score"), "doc")


def session_hits(hits: DataFrame, most: int | None = None) -> DataFrame:
    """session_id, hits and snippet of the best hit, best session first."""
    rank = F.struct(-F.col("score"), "doc")
    out = hits.groupBy("session_id").agg(F.count("*").alias("hits"), F.min_by("snippet", rank).alias("snippet"), F.min(rank).alias("_r")).orderBy("_r").drop("_r")
    return out if most is None else out.limit(most)


def highlights(text: Column, query: str) -> Column:
    """Starts (from 0) of a query's terms in a text, without regard to case: array of (start, length), in order."""
    found = [F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.lower(F.substring(text, i, F.lit(len(t)))) == t), lambda i: F.struct((i - 1).alias("start"), F.lit(len(t)).alias("length"))) for t in dict.fromkeys(query.lower().split())]
    return F.array_sort(F.concat(*found)) if found else F.array().cast("array<struct<start:int,length:int>>")
