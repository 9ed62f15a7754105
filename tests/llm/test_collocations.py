"""op12: collocations against SQL and a plain count, with a sketch too small for the texts, edges."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import collocations as C


def plain(rows, least=10, most=2000):
    """Counts of every phrase, then the rules one by one."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for cut in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(cut, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = {}
    for key, a in f.items():
        lang, *w = key
        if len(w) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            found[key] = (a, *min(cuts))
    out, longest = [], Counter()
    for (lang, *w), (a, *_) in found.items():
        if len(w) == 3:
            for inner in ((lang, *w[:2]), (lang, *w[1:])):
                longest[inner] = max(longest[inner], a)
    for lang in total:
        kept = []
        for key, (a, score, _, left, right) in found.items():
            if key[0] == lang and (key not in longest or 100 * longest[key] < 50 * a):
                kept.append((-score, -a, " ".join(key[1:]).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def sample(seed, n=500):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["né", "NÉ", "Zu", "a-b", "'t", "ß"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "!", "\n", "\x0b", " "]) for _ in range(r.randint(0, 90)))
        rows.append((r.choice(["en", "en", "en", "de", None, "und"]), text.replace("w1 ", "w1 w2 w3 ")))
    return rows


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("cells", "chars", "most"), [(1 << 16, 8_000_000, 2000), (1 << 20, 700, 5)])
def test_collocations_are_those_of_full_counts(spark, monkeypatch, cells, chars, most):
    rows = sample(3)
    monkeypatch.setattr(C, "SHARD_CHARS", chars)
    got = result(C.collocations(spark.createDataFrame(rows, "lang string, text string"), cells=cells, most=most))
    assert got == plain(rows, most=most) and len(got) > (10 if most > 5 else 3)


def test_a_full_sketch_loses_nothing(spark):
    """With so few cells that all of them are full, every phrase is admitted and counts stay exact."""
    rows = [("en", " ".join(f"w{k * j % 997}" for k in range(3000))) for j in range(1, 30)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert result(C.collocations(df, least=3, cells=1 << 16)) == plain(rows, least=3)


def test_edges(spark):
    rows = [(None, None), ("en", ""), ("en", "a a a " * 20_000), ("en", "x"), ("en", " \t.,\n"), (None, "b c " * 10), (None, "b c " * 10)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1)).withColumn("rank", F.lit(0))
    got = result(C.collocations(df))
    assert got == [x for x in plain(rows)] and any(x[2] == "a a" or x[2] == "a a a" for x in got)
    assert C.collocations(df.limit(0)).collect() == []


def test_sql_agrees():
    rows = sample(9)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(C.OP12_SQL).fetchall()) == plain(rows)
