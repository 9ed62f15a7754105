"""What every operator makes of nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import chat, common, decontaminate, lines, mixing, near_duplicates, passages, pii, quality, toxicity, warc

LONG = " ".join(f"word{k % 5000}" for k in range(60_000))
ROWS = [
    (1, "the first text of some words. It ends here.", "en", "a", 10),
    (1, "the first text of some words. It ends here.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "en", "b", 4),
    (None, "a text without an id", "en", None, 5),
    (5, LONG, "en", "a", len(LONG)),
    (6, "x" * 200_000, "en", "a", 200_000),
    (7, LONG + " more", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ["id", "key", "row", "found", "removed", "gone", "copy", "copies", "size", "rate", "score", "comp", "_doc", "at", "text_"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the first text of some words. It ends here."), (2, None), (3, ""), (None, "an item without an id, which is long enough")], "item_id long, text string")


def operators(labels, items):
    weights = lambda d: toxicity.fit_toxicity(d, labels)
    return {
        "quality": quality.score_quality,
        "toxicity": lambda d: toxicity.score_toxicity(d, weights(d)),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, weights(d)),
        "near": near_duplicates.near_duplicates,
        "drop_near": near_duplicates.drop_near_duplicates,
        "leaks": lambda d: decontaminate.find_leaks(d, items),
        "drop_leaks": lambda d: decontaminate.drop_leaks(d, items),
        "mix": mixing.mix,
        "lines": lines.line_duplicates,
        "remove_lines": lambda d: lines.remove_lines(d, lines.line_duplicates(d)),
        "passages": passages.repeated_passages,
        "pii": pii.find_pii,
    }


NAMES = ["quality", "toxicity", "drop_toxic", "near", "drop_near", "leaks", "drop_leaks", "mix", "lines", "remove_lines", "passages", "pii"]
PER_ROW = ["quality", "toxicity", "near", "pii", "remove_lines"]


@pytest.mark.parametrize("name", NAMES)
def test_edges(docs, labels, items, name):
    rows = operators(labels, items)[name](docs).collect()
    if name in PER_ROW:
        assert len(rows) == len(ROWS)
    if name.startswith(("drop", "remove")):
        assert rows and set(rows[0].asDict()) == set(docs.columns)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, items, name):
    assert operators(labels, items)[name](docs.where("false")).collect() == []


def test_empty_side_tables(docs, labels, items):
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.where("false"))).collect()} == {0.5}
    assert decontaminate.find_leaks(docs, items.where("false")).collect() == []
    assert decontaminate.drop_leaks(docs, items.where("false")).count() == len(ROWS)


def test_repeated_rows_and_ties(docs):
    found = {(r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in near_duplicates.near_duplicates(docs).collect()}
    assert (1, 1, 2, 0) in found and (5, 5, 1, 1) in found and (7, 5, 1, 1) in found
    assert (2, 2, 1, 0) in found and (None, None, 1, 0) in found
    kept = [r["doc_id"] for r in near_duplicates.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 1, 2, 3, 4, None, 5, 6], key=str)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_lines_of_texts_that_share_an_id(spark, tmp_path, doc_id):
    """Texts under one doc_id lose lines of their own only, and copies go wherever they stand."""
    new = lambda k: f"line {k} holds words{k} of its own{k}"
    same = "a line that both of these texts hold"
    a, b, c = [new(1), same, new(2)], [new(3), same, new(4)], [new(5), new(6), new(7), same]
    df = spark.createDataFrame([(doc_id, "\n".join(x), 1) for x in (a, b, c)], "doc_id long, text string, n_chars long")
    kept = [r["text"].split("\n") for r in lines.remove_lines(df, lines.line_duplicates(df)).collect()]
    assert sorted([y for y in x if y != same] for x in kept) == sorted([y for y in x if y != same] for x in (a, b, c))
    assert sum(x.count(same) for x in kept) == 1
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lines.op8_line_dedup(spark, str(tmp_path)).collect()
    assert sum(r["n_removed"] for r in rows) == 2
    assert all(0 <= n < r["n_lines"] for r in rows for n in r["removed"])


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://a", ""), (2, "http://b", "<p>x</p>" * 50_000)], "page_id long, url string, html string").withColumn("block", F.lit(1))
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8
    assert len({r["record_id"] for r in rows}) == 6  # the repeated row repeats its two
    assert warc.derive(warc.responses(pages.where("false"))).collect() == []


def seconds(work):
    began = time.time()
    work()
    return time.time() - began


@pytest.mark.parametrize("unit", ["<!--", "<script>", "<script ", "<style>a", "<p ", "<x", "</", "&amp;", "\n \n", "</script "])
def test_warc_of_a_hostile_page(spark, unit):
    """A megabyte of what is never closed takes time in proportion, and the result is defined."""
    html = "<p>before</p>" + unit * (1_000_000 // len(unit))
    pages = spark.createDataFrame([(1, "http://a", html)], "page_id long, url string, html string")
    assert seconds(lambda: warc.derive(warc.responses(pages)).write.format("noop").mode("overwrite").save()) < 20
    text = next(r["block"] for r in warc.derive(warc.responses(pages)).collect() if r["warc_type"] == "conversion")
    assert text.startswith("before")
    if unit in ("<!--", "<script>", "<script ", "<style>a", "<p ", "<x"):
        assert text == "before"


@pytest.mark.parametrize("unit", ["a@b.co ", "1.2.3.4 ", "+12345678 ", "token='sk_aB3dE5fG7hIjKlMnOpQ1' ", "bob [at] x [dot] org ", "a@b.co,call 555-123-4567 "])
def test_pii_of_a_full_text(spark, unit):
    """20,000 matches and more in one text take time in proportion; base spans are all there, added ones overlap none."""
    n = 20_000
    df = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
    out = []
    assert seconds(lambda: out.extend(pii.find_pii(df).collect())) < 40
    found = sorted([tuple(m)[1:] for m in [*out[0]["base"], *out[0]["added"]]])
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    if "[" not in unit and "sk_" not in unit:
        assert len(out[0]["base"]) == n and out[0]["base"][-1]["start"] == len(unit) * (n - 1)


def test_toxicity_of_repeated_labels(spark):
    """A doc_id that many label rows or texts have is learnt once, by most of its labels."""
    docs = spark.createDataFrame([(k, f"word{k} bad thing" if k % 2 else f"word{k} good thing") for k in range(200)] + [(1, f"other text {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(0, 0)] * 2000 + [(2, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    weights = toxicity.fit_toxicity(docs, labels, max_rows=100)
    rows = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.where("text like 'word%'"), weights).collect()}
    assert min(s for d, s in rows.items() if d % 2) > max(s for d, s in rows.items() if not d % 2)


def test_no_folder_of_its_own_on_a_cluster():
    """Without a shared folder a cluster gets an error, not a folder that other machines do not see."""

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.scratch_dir(Session())


def test_chat_of_a_long_conversation(spark):
    """A conversation of 5,000 turns, which another leaves at every 50th: keys and intervals stay few."""
    rows = [(1, t, "user", f"turn {t}") for t in range(5000)]
    rows += [(2 + k, t, "user", f"turn {t}" if t < 50 * k else f"own {k} {t}") for k in range(1, 20) for t in range(50 * k + 2)]
    turns, trees = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert trees.agg(F.max(F.size("attends")), F.count("*"), F.countDistinct("tree")).first()[:] == (2, 5000 + 2 * 19, 1)
    back = chat.read_back(turns, trees, f"{chat.TOKENIZERS}/{chat.VOCABULARY}").agg(F.sum("n_turns")).first()[0]
    assert back == len(rows)


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, ""), (None, 0, "user", "x"), (None, 1, "assistant", "y" * 100_000), (3, 0, "user\nrole\\", "<|im_end|>\n<|im_start|>\\")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    turns, trees = chat.format_chats(conversations)
    back = {r["conv_id"]: r for r in chat.read_back(turns, trees, f"{chat.TOKENIZERS}/{chat.VOCABULARY}").collect()}
    assert {k: r["n_turns"] for k, r in back.items()} == {1: 3, 2: 1, None: 2, 3: 1}
    assert back[None]["loss_chars"] == 100_000
    turns, trees = chat.format_chats(conversations.where("false"))
    assert turns.count() == 0 and trees.count() == 0


def test_pipeline_of_odd_rows(spark, docs, labels, items, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*plain.columns, "copy"]
    assert out.where("doc_id = 1").count() == 0  # it is a test item
