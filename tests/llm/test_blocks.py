"""op5: results do not depend on how items are cut into blocks, and no block grows with copies."""

from ledgerline.llm import decontaminate as D

TEXT = "the quick brown fox jumps over the lazy dog near the old river bank"


def found(docs, items, block):
    cols = ("doc_id", "item_id", "distance", "allowed", "end_char")
    return sorted(tuple(r[c] for c in cols) for r in D.find_leaks(docs, items, block_chars=block).collect())


def test_blocks_do_not_change_results(spark):
    other = [f"another item number {k} with words enough to be looked for in texts" for k in range(40)]
    items = [(7, TEXT), (7, TEXT.upper()), (8, TEXT), (None, TEXT), (9, None), (9, " "), (10, TEXT.replace(" ", "  "))] + list(enumerate(other, 100))
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {TEXT} it was"), (2, "nothing here"), (3, other[3].title()), (1, f"so {TEXT} it was"), (None, TEXT[:-4] + "tank")], "doc_id long, text string")
    rows = lambda block: sorted(map(str, D.find_leaks(docs, items, block_chars=block).collect()))
    want = rows(D.BLOCK_CHARS)
    assert len(want) == 2 * 4 + 40 + 4  # the other items are within each other's budgets
    assert rows(200) == want and rows(5000) == want
    assert sorted(r["text"] for r in D.drop_leaks(docs, items, block_chars=200).collect()) == ["nothing here"]


def test_copies_of_an_item_are_one(spark):
    items = spark.createDataFrame([(1, TEXT)] * 300 + [(k, f"item {k} of many others that stand here once") for k in range(2, 103)], "item_id long, text string")
    blocks = list(D.item_blocks(items, 1000))
    assert sum(map(len, blocks)) == 102 and max(map(len, blocks)) < 60
