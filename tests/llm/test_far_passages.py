"""op9: passages whose parts repeat elsewhere, and documents of several rows."""

import random

from ledgerline.llm import passages as P


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def edited(r, passage, edits):
    out = list(passage)
    for at in range(10, len(out), len(out) // edits):
        out[at] = words(r, 1)[0]
    return out


def test_parts_in_earlier_documents_do_not_hide_a_passage(spark):
    r, rows = random.Random(1), []
    for k in range(40):
        passage = words(r, 100)
        for n, (a, z) in enumerate(((0, 40), (30, 70), (60, 100))):
            rows.append((10 * k + n, words(r, 20) + passage[a:z] + words(r, 20)))
        rows.append((10 * k + 5, words(r, 30) + passage + words(r, 30)))
        rows.append((10 * k + 6, words(r, 10) + edited(r, passage, 4) + words(r, 10)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(x["doc_id"], x["match_id"]) for x in P.repeated_passages(df).collect()}
    assert sum((10 * k + 6, 10 * k + 5) in found for k in range(40)) >= 38
    assert all(d // 10 == m // 10 for d, m in found)


def test_rows_that_share_an_id_are_not_mixed(spark):
    r, rows = random.Random(2), []
    for k in range(40):
        passage = words(r, 60)
        rows += [(10 * k, passage), (10 * k + 1, passage[:32]), (10 * k + 1, passage[28:]), (10 * k + 2, passage[:55])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = [(x["doc_id"], x["match_id"], x["start"], x["end"], x["distance"]) for x in P.repeated_passages(df).collect()]
    assert sorted(found) == [(10 * k + 2, 10 * k, 0, 55, 0) for k in range(40)]


def test_partners_that_edits_take_do_not_hide_a_passage(spark):
    """All far partners of a seed count, so edits may take the next ones; parts of the passage stand in earlier documents."""
    r, rows = random.Random(3), []
    for k in range(60):
        passage = words(r, 90)
        for n, (a, z) in enumerate(((0, 35), (28, 63), (55, 90))):
            rows.append((10 * k + n, words(r, 20) + passage[a:z] + words(r, 20)))
        rows.append((10 * k + 5, words(r, 30) + passage + words(r, 30)))
        other = list(passage)
        for at in r.sample(range(90), 9):
            other[at] = words(r, 1)[0]
        rows.append((10 * k + 6, words(r, 10) + other + words(r, 10)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(x["doc_id"], x["match_id"]) for x in P.repeated_passages(df).collect()}
    assert sum((10 * k + 6, 10 * k + 5) in found for k in range(60)) >= 50
