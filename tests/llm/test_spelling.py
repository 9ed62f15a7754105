"""op11: spelling variants against every pair of words, hot segments, edges."""

import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import spelling as S


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs, min_chars=7, min_count=2):
    """Every pair of words by the textbook distance."""
    n = Counter()
    for d, t in docs:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                w = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                n[w] += 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}
    near = {w: [v for v in n if edits(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def result(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def sample(seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcéö") for _ in range(r.randint(6, 11))) for _ in range(25)]
    docs = []
    for d in range(150):
        words = []
        for _ in range(30):
            w = list(r.choice(stems[: 1 + int(24 * r.random() ** 3)]))
            while r.random() < 0.3:
                k, kind = r.randrange(len(w)), r.random()
                w[k : k + (kind > 0.3)] = r.choice("abcéö") if kind < 0.6 else ""
            words.append("".join(w).title() if r.random() < 0.2 else "".join(w))
        docs.append((d if r.random() < 0.9 else None, r.choice([" ", "-", "1 "]).join(words)))
    return docs


@pytest.mark.parametrize("most", [3, 20_000])
def test_variants_are_those_of_all_pairs(spark, most, monkeypatch):
    docs = sample(5)
    monkeypatch.setattr(S.neighbours, "__defaults__", (most,))
    got = result(S.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    want = plain(docs)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(form and root != form for _, form, root, *_ in want) and sum(x[4] > 1 for x in want) > 50


def test_edges(spark):
    long = "wordlike " * 50_000
    rows = [(1, None, "x"), (2, "", "y"), (3, long, None), (3, long, None), (None, "wordlike wordlikes wordlikes", "z"), (None, "Straße×÷ ÀÉÎÕÜßàé", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").withColumn("n", F.lit(7)).withColumn("segment", F.lit("s"))
    got = result(S.variants(docs))
    assert set(got) == plain([r[:2] for r in rows]) and len(got) >= 2
    assert S.variants(docs.limit(0)).collect() == []


def test_one_edit():
    words = ["", "a", "b", "ab", "ba", "abc", "aab", "abb", "bab", "abab", "baba", "aabb"]
    assert all(S.one_edit(a, b) == (edits(a, b) == 1) for a in words for b in words)


def test_sql_agrees(spark):
    docs = sample(8)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert set(con.execute(S.OP11_SQL).fetchall()) == plain(docs)
