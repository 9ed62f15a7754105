"""The pipeline's stages one by one against plain versions, each on what the one before kept."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from ledgerline.llm import decontaminate, toxicity
from ledgerline.llm.common import saved
from tests.llm.test_brute_force import SF, WORD, joined_by_hand, removed_by_hand

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def kept(spark):
    """What went into each stage, and came out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_stages_keep_the_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "mixing"]
    assert all(df.columns == kept[0].columns for df in kept[:-1])


def test_toxicity(spark, kept):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, toxicity.learnable(labels))).collect()}
    assert set(texts(kept[1])) == {d for d, s in scores.items() if s < 0.7}


def test_lines(kept):
    before, after = texts(kept[1]), texts(kept[2])
    gone = removed_by_hand(before)
    cut = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in before.items()}
    emptied = {d for d, t in cut.items() if gone[d] and not WORD.search(t)}
    assert emptied and after == {d: t for d, t in cut.items() if d not in emptied}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].collect() if r["doc_id"] in gone and gone[r["doc_id"]])


def test_near_duplicates(kept):
    before = texts(kept[2])
    by = joined_by_hand(before)
    assert texts(kept[3]) == {d: t for d, t in before.items() if by[d][1] == d}


def test_leaks(spark, kept):
    own = decontaminate.Matcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], decontaminate.ERROR_RATE)
    assert set(texts(kept[4])) == {d for d, t in texts(kept[3]).items() if not own.matches(t)}


def test_mixing(spark, kept):
    """Copies of a document are counted from 0; the words taken of a source come near its share."""
    rows = kept[5].collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert Counter((r["doc_id"], r["copy"]) for r in rows) == Counter((d, k) for d, n in copies.items() for k in range(n))
    assert max(copies.values()) <= 3
    assert sorted((r["doc_id"], r["copy"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r["doc_id"], r["copy"]) for r in rows)
