"""Each operator against a plain version of its contract, on the driver's tables and on planted cases."""

import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import chat, decontaminate, lines, mixing, near_duplicates, passages, pii, quality, toxicity, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_as_sql(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: [str(row[c]) for c in sorted(row)]
    assert sorted(key(r.asDict()) for r in df.collect()) == sorted(key(dict(zip(names, r, strict=True))) for r in result.fetchall())


def test_quality_counts(spark, texts):
    for r in quality.op1_quality(spark, SF).collect():
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(grams)
        repeated = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
        own = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(own) - len(set(own)), len(repeated))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_follows_labels(spark):
    both = quality.op1_quality(spark, SF).join(table(spark, "labels"), "doc_id").where("quality is not null and not base_failed")
    right, n = both.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count("*")).first()
    assert right >= 0.97 * n


def test_em_finds_the_bad_rules():
    rng = random.Random(1)
    rows = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        rows[tuple(int(rng.random() < (0.02 if good else 0.6)) for _ in range(3)) + (int(rng.random() < (0.8 if good else 0.2)),)] += 1
    bias, *odds = quality.fit_rules([(list(k), n) for k, n in rows.items()], [-1, -1, -1, 1])
    score = lambda p: bias + sum(odds[2 * k + v] for k, v in enumerate(p))
    assert score((0, 0, 0, 1)) > 0 > score((1, 1, 1, 0)) and score((1, 1, 0, 0)) < 0


def test_toxicity_held_out(spark):
    """On the largest table of labels that is here; held-out rows are never learnt from."""
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF
    rows = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["toxic"], r["score"]) for r in rows if r["held_out"]]
    bad, good = [s for t, s in held if t], [s for t, s in held if not t]
    auc = sum((x > y) + 0.5 * (x == y) for x in bad for y in good) / (len(bad) * len(good))
    assert auc >= 0.9 and sum(s >= 0.7 for s in good) <= 0.01 * len(good)


def test_ftrl_is_sparse_and_learns():
    import numpy as np

    model, rng = toxicity.Ftrl(1000, l1=1.0), np.random.default_rng(0)
    for _ in range(400):
        y = int(rng.random() < 0.5)
        model.learn(np.unique(np.concatenate([[y], rng.integers(10, 1000, 5)])), y)
    w = model.weights(slice(0, 1000))
    assert w[1] > 0.5 and w[0] < -0.5 and (w == 0).mean() > 0.5


def grams(text, n=5):
    words = WORD.findall(text or "")
    return {tuple(words[k : k + n]) for k in range(len(words) - min(n, len(words)) + 1)} if words else set()


def joined_by_hand(texts):
    """Links between different gram sets, and classes."""
    sets = defaultdict(list)
    for i, t in texts.items():
        if g := frozenset(grams(t)):
            sets[g].append(i)
    own = sorted(sets, key=lambda g: min(sets[g]))
    index, links = defaultdict(list), Counter()
    up = list(range(len(own)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, g in enumerate(own):
        shared = Counter(j for x in g for j in index[x])
        for j, n in shared.items():
            if n >= 0.8 * len(g | own[j]) - 1e-9:
                links[k] += 1
                links[j] += 1
                a, b = sorted((top(k), top(j)))
                up[b] = a
        for x in g:
            index[x].append(k)
    out = {i: (i, i, 0, 1) for i in texts}
    for k, g in enumerate(own):
        for i in sets[g]:
            out[i] = (min(sets[g]), min(sets[own[top(k)]]), links[k], len(sets[g]))
    return out


def varied(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"other{rng.randrange(10_000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def crowd():
    """One large group of near copies, some of them exact, beside texts of their own."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = {k: varied(rng, base, rng.randrange(5)) for k in range(60)}
    rows |= {100 + k: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 80))) for k in range(40)}
    return rows | {200: rows[0], 201: rows[0], 202: "two words", 203: "two words"}


@pytest.mark.parametrize("block", [256, 7])
def test_near_duplicates(spark, texts, crowd, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", block)
    rows = crowd if block == 7 else texts
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["rep_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == joined_by_hand(rows)


def test_near_duplicates_of_repeated_ids(spark):
    """Links are between gram sets, however often rows, ids or texts repeat."""
    words = [f"w{k}" for k in range(60)]
    a, b, c, other = " ".join(words), " ".join([*words[:59], "x"]), " ".join([*words[:59], "y"]), "a text of its own that nothing else is like at all"
    rows = [(1, a), (1, a), (2, b), (2, other), (3, c), (3, c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in near_duplicates.near_duplicates(df).collect()], key=str)
    want = [(1, 1, 1, 2, 2), (1, 1, 1, 2, 2), (2, 2, 1, 2, 1), (2, 2, 2, 0, 1), (3, 3, 1, 2, 2), (3, 3, 1, 2, 2), (None, None, None, 0, 1)]
    assert got == sorted(want, key=str)
    assert sorted([tuple(r) for r in near_duplicates.drop_near_duplicates(df).collect()], key=str) == sorted([(1, a), (1, a), (2, other), (None, a)], key=str)


def test_bands_reach_the_recall():
    bands, rows = near_duplicates.bands_and_rows()
    assert bands * rows <= near_duplicates.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= near_duplicates.RECALL


def test_warc_sql(spark, duck):
    same_as_sql(warc.op4_warc(spark, SF), duck, warc.OP4_SQL)


def test_warc_records_are_read(spark, tmp_path):
    """Response records of files, plain and gzip, with headers and dates of their own, become linked records."""
    said = lambda k, body: f"HTTP/1.1 {200 + k} OK\r\nX-Own: {k}\r\n\r\n{body}"
    bodies = ["<p>one &amp; two</p>", "", "line\r\nend\r\n", "<b>é 𝒳</b>"]
    records = []
    for k, body in enumerate(bodies):
        block = said(k, body).encode()
        head = f"WARC/1.{k % 2}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Target-URI: http://x/{k}\r\nWARC-Date: 2020-01-0{k + 1}T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
        records += [head.encode() + block + b"\r\n\r\n", b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n"]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:4]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[4:-1]))
    read = warc.read_warc(spark, str(tmp_path))
    got = {r["record_id"]: r for r in read.collect()}
    assert sorted(got) == [f"<urn:uuid:{k}>" for k in range(4)] and all(r["whole"] for r in got.values())
    for k, body in enumerate(bodies):
        r = got[f"<urn:uuid:{k}>"]
        assert (r["payload"], r["http_headers"] + r["payload"]) == (body, said(k, body)) and r["warc_date"] == f"2020-01-0{k + 1}T00:00:00Z"
    made = {(r["refers_to"], r["warc_type"]): r for r in warc.derive(read).collect()}
    assert made["<urn:uuid:0>", "conversion"]["block"] == "one & two" and "http-status: 203" in made["<urn:uuid:3>", "metadata"]["block"]
    assert made["<urn:uuid:1>", "metadata"]["source_headers"].endswith("X-Own: 1\r\n\r\n") and made["<urn:uuid:2>", "conversion"]["target_uri"] == "http://x/2"


def test_warc_members(spark):
    derived = warc.derive(warc.responses(table(spark, "pages").limit(5)))
    rows = {r["record_id"]: r for r in derived.collect()}
    for m in warc.warc_members(derived).collect():
        head, _, rest = gzip.decompress(m["member"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        r = rows[m["record_id"]]
        body = rest[: int(fields["Content-Length"])]
        assert body.decode() == r["block"] and fields["WARC-Refers-To"] == r["refers_to"] and rest[len(body) :] == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row), row.index(min(row))


def test_myers_is_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (20, 60))
        assert decontaminate.myers(decontaminate.char_masks(p), len(p), t)[0] == least_distance(p, t)[0]


def leaks_by_hand(items, text, min_chars):
    """Each item's least distance to a part of the text and the end of the first such part, from the whole table of distances."""
    out, text = set(), decontaminate.plain(text)
    for i, item in {(i, decontaminate.plain(x)) for i, x in items} - {(i, "") for i, _ in items}:
        if len(item) >= min_chars:
            d, end = least_distance(item, text)
            if d <= int(len(item) * 0.1):
                out.add((i, d, int(len(item) * 0.1), end))
        elif m := re.search(rf"(?<!\S){re.escape(item)}(?!\S)", text):
            out.add((i, 0, 0, m.end()))
    return out


@pytest.mark.parametrize("min_chars", [0, 32])
def test_pigeonhole_is_exact(min_chars):
    rng = random.Random(5)
    said = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = [(k, said(rng.randrange(8 if k % 2 else 33, 90)).strip() + "x") for k in range(8)]
    items += [(9, items[0][1]), (0, items[0][1].upper()), (0, items[2][1]), (10, None), (11, " ")]
    own = decontaminate.Matcher(items, 0.1, min_chars)
    hits = 0
    for _ in range(150):
        text = said(60)
        for _ in range(rng.randrange(1, 4)):  # several occurrences, some near each other, of unequal distances
            item = decontaminate.plain(rng.choice(items[:8])[1])
            for _ in range(rng.randrange(0, int(len(item) * 0.1) + 3)):
                at = rng.randrange(len(item))
                item = item[:at] + rng.choice(["", "z", "zz"]) + item[at + rng.randrange(2) :]
            text += rng.choice(["", " "]) + item + rng.choice([" ", said(5)])
        got = own.matches(text)
        hits += len(got)
        assert len(set(got)) == len(got) and set(got) == leaks_by_hand(items, text, min_chars)
    assert hits > 150


def test_leaks(spark, texts):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.op5_decontaminate(spark, SF).collect()}
    items = {r["item_id"]: decontaminate.plain(r["text"]) for r in table(spark, "benchmark").collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if len(x) >= 32 and x in decontaminate.plain(t)}
    assert exact and exact <= found
    blocks = decontaminate.find_leaks(table(spark, "documents"), table(spark, "benchmark"), block_chars=500)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == found
    left = {r["doc_id"] for r in decontaminate.drop_leaks(table(spark, "documents"), table(spark, "benchmark")).collect()}
    assert left == set(texts) - {d for d, _ in found}


def test_leaks_have_the_least_distance(spark, texts):
    """Every document with every item, by the whole table of distances on those that share a word of 6 letters or more."""
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()][:6]
    some = dict(sorted(texts.items())[:60])
    few = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(d, t[:3000]) for d, t in some.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["allowed"], r["end_char"]) for r in decontaminate.find_leaks(df, few.union(few)).collect()}
    assert got == {(d, *m) for d, t in some.items() for m in leaks_by_hand(items, t[:3000], decontaminate.MIN_CHARS)}


def test_tokens_are_the_tokenizers_own():
    enc, rng = chat.tokenizer(f"{chat.TOKENIZERS}/{chat.VOCABULARY}"), random.Random(6)
    for sep in (" ", "  ", "\n", "é ", "1 "):
        text = sep.join(rng.choice(["word", "don't", "x", "12", "!?", "naïve"]) for _ in range(20_000))
        assert chat.encode(enc, text) == enc.encode_ordinary(text)
    for run in ("y" * 60_000, " " * 60_000, " \n" * 40_000 + "end"):
        assert chat.encode(enc, run) == enc.encode_ordinary(run)
    spaces = "a" + " " * 400_000 + "b"
    assert enc.decode(chat.encode(enc, spaces)) == spaces


def test_chats_round_trip(spark):
    said = f"{chat.END}{chat.START}assistant ok"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in table(spark, "conversations").collect()] + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    by = defaultdict(list)
    for c, t, role, text in sorted(rows):
        by[c].append((role, text))
    got = {r["conv_id"]: r for r in chat.op6_chat(spark, SF).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        lost = "".join(t for role, t in turns if role == "assistant")
        shown = "".join(f"{chat.START}{role}\n{chat.escape(t)}{chat.END}\n" for role, t in turns)
        r = got[c]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(turns), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(shown))


def test_chat_trees(spark):
    """Shared turns are emitted once; a node attends to its ancestors' tokens and no others."""
    rng = random.Random(11)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {rng.randrange(2)} of {t}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns, trees = chat.format_chats(df)
    nodes = {r["node"].hex(): r for r in trees.collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((role, text))
    assert len(nodes) == len({tuple(v[: k + 1]) for v in by.values() for k in range(len(v))})
    places = defaultdict(list)
    for n, r in nodes.items():
        places[r["tree"].hex()].append((r["start"], r["start"] + len(r["tokens"]), n))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for n, r in nodes.items():
        ids, up = [], r["parent"]
        while up:
            ids.append(up.hex())
            up = nodes[ids[-1]]["parent"]
        covered = {x for u in r["attends"] for x in range(u["start"], u["end"])}
        want = {x for i in ids for x in range(nodes[i]["start"], nodes[i]["start"] + len(nodes[i]["tokens"]))}
        assert covered == want and r["position"] == len(want) and len(ids) == r["depth"]
        assert len(r["attends"]) <= 1 + math.log2(len(by))


def test_mixing_sql(spark, duck):
    same_as_sql(mixing.op7_mixing(spark, SF), duck, mixing.OP7_SQL)


def test_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 0, None: 5}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_rates(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    capped, target = set(), {}
    while True:  # shares by weight, again and again, until none is above three times its size
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
        if not (over := {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}):
            break
        capped |= over
    assert got == pytest.approx(target)


def test_mix_repeats_documents(spark):
    rows = [(k, "w " * 10, "a" if k % 10 else "b") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter((r["source"], r["doc_id"]) for r in mixing.mix(df).collect())
    by = Counter()
    for (s, _), n in taken.items():
        by[s] += n
        assert n <= 3
    assert by["b"] == 600 and abs(by["a"] - 1400) < 100
    assert Counter((r["source"], r["doc_id"]) for r in mixing.mix(df.repartition(3)).collect()) == taken


def test_texts_without_ids_draw_for_themselves(spark):
    rows = [(None, f"w {k}", "a" if k % 2 else "b") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter(r["source"] for r in mixing.mix(df).collect())
    assert abs(taken["a"] - 4000 / 3) < 150 and abs(taken["b"] - 8000 / 3) < 150


def removed_by_hand(texts):
    want, sets, index = {}, [], defaultdict(list)
    for d in sorted(texts):
        want[d] = []
        for k, line in enumerate(texts[d].split("\n")):
            if not (own := set(WORD.findall(line))):
                continue
            shared = Counter(j for w in own for j in index[w])
            if any(9 * n >= 4 * (len(own) + len(sets[j])) for j, n in shared.items()):
                want[d].append(k)
            for w in own:
                index[w].append(len(sets))
            sets.append(own)
    return want


def test_line_dedup(spark, texts):
    assert {r["doc_id"]: list(r["removed"]) for r in lines.op8_line_dedup(spark, SF).collect()} == removed_by_hand(texts)


def test_line_dedup_of_near_lines(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    kinds = [[rng.choice(base) for _ in range(rng.randrange(1, 40))] for _ in range(8)]
    texts = {}
    for d in range(80):
        own = [varied(rng, rng.choice(kinds), rng.randrange(8)) if rng.random() < 0.8 else " ".join(rng.choices(base, k=rng.randrange(1, 12))) for _ in range(6)]
        texts[d] = "\n".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = removed_by_hand(texts)
    assert {r["doc_id"]: list(r["removed"]) for r in lines.line_duplicates(df).collect()} == {d: v for d, v in want.items() if v}
    for r in lines.remove_lines(df, lines.line_duplicates(df)).collect():
        assert r["text"] == "\n".join(x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if k not in want[r["doc_id"]])


def test_line_dedup_of_long_and_short_sketches(spark):
    """Near lines on both sides of the size from which a sketch has two halves, words apart by any white space."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(3000)]
    kinds = [rng.sample(base, rng.randrange(lines.LONG - 14, lines.LONG + 15)) for _ in range(12)] + [rng.sample(base, 150) for _ in range(2)]
    texts = {}
    for d in range(60):
        own = []
        for _ in range(4):
            line = list(rng.choice(kinds))
            line = [w for w in line if rng.random() > 0.08] + rng.sample(base, rng.randrange(9))
            own.append("".join(w + rng.choice([" ", "  ", "\t", "\x0b", "\x0c", "\r"]) for w in line) if rng.random() < 0.5 else " ".join(line))
        texts[d] = "\n".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = removed_by_hand(texts)
    assert sum(map(len, want.values())) > 60
    assert {r["doc_id"]: list(r["removed"]) for r in lines.line_duplicates(df).collect()} == {d: v for d, v in want.items() if v}


def test_texts_are_split_once(spark):
    """No filter that the optimizer adds splits every text or line a second time."""
    df = spark.createDataFrame([(1, "a b\nc")], "doc_id long, text string")
    plan = lines.places(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_passages_are_found(spark):
    """A passage of 60 words, with a few edits, in texts of their own; nothing else repeats."""
    rng = random.Random(9)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    edited = passage[:20] + ["changed"] + passage[21:40] + passage[41:]
    texts = {0: fresh(100), 1: fresh(40) + passage + fresh(50), 2: fresh(10) + edited + fresh(10), 3: fresh(300), 4: passage, 5: fresh(40) + passage[:45] + fresh(9)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["match_id"]): r for r in passages.repeated_passages(df).collect()}
    assert set(got) == {(2, 1), (4, 1)}
    assert (got[4, 1]["start"], got[4, 1]["end"], got[4, 1]["match_start"], got[4, 1]["distance"]) == (0, 60, 40, 0)
    assert (got[2, 1]["start"], got[2, 1]["end"], got[2, 1]["distance"]) == (10, 69, 2)


def test_every_repeated_window_is_found(spark, texts):
    """Each place where 50 words in a row stand in an earlier document as well is in some row, and rows hold what they say."""
    words = {d: WORD.findall(t) for d, t in texts.items()}
    found = defaultdict(list)
    for r in passages.op9_passages(spark, SF).collect():
        assert r["match_id"] < r["doc_id"] and min(r["end"] - r["start"], r["match_end"] - r["match_start"]) >= 50
        own, other = words[r["doc_id"]][r["start"] : r["end"]], words[r["match_id"]][r["match_start"] : r["match_end"]]
        assert passages.word_distance(own, other) <= r["distance"] <= 0.2 * min(len(own), len(other))
        found[r["doc_id"]].append((r["start"], r["end"]))
    first, places, missed = {}, 0, 0
    for d in sorted(words):
        own = [tuple(words[d][k : k + 50]) for k in range(len(words[d]) - 49)]
        for k, w in enumerate(own):
            if first.setdefault(w, d) < d:
                places += 1
                missed += not any(a <= k and k + 50 <= b for a, b in found[d])
    assert places > 1000 and missed <= 0.02 * places


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.05, 0.98), (0.1, 0.95), (0.15, 0.7)])
def test_recall_by_edit_rate(spark, rate, least):
    """Passages of 60 words with words replaced at random, among words of their own."""
    rng = random.Random(int(100 * rate))
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(200):
        passage = fresh(60)
        copy = list(passage)
        for at in rng.sample(range(60), round(60 * rate)):
            copy[at] = fresh(1)[0]
        rows += [(2 * k, " ".join(fresh(40) + passage + fresh(30))), (2 * k + 1, " ".join(fresh(25) + copy + fresh(35)))]
    got = {(r["doc_id"], r["match_id"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(2 * k + 1, 2 * k) for k in range(200)} and len(got) >= least * 200


@pytest.mark.parametrize("halves", [((0, 40), (20, 60)), ((0, 30), (30, 60))])
def test_passages_whose_parts_occur_earlier(spark, halves):
    """Two documents share 60 words, parts of which stand in earlier documents: 30 such passages, all of them found."""
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for k in range(30):
        passage = fresh(60)
        for j, (a, b) in enumerate(halves):
            texts[100 * k + j] = fresh(30) + passage[a:b] + fresh(30)
        texts[100 * k + 10] = fresh(20) + passage + fresh(35)
        texts[100 * k + 20] = fresh(45) + passage + fresh(15)
    texts[9001] = fresh(5) + ["again"] * 180 + fresh(5)
    texts[9002] = fresh(9) + ["again"] * 130 + fresh(3)
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    rows = [r for r in passages.repeated_passages(df).collect()]
    got = {(r["doc_id"], r["match_id"]): (r["start"], r["end"], r["match_start"], r["match_end"], r["distance"]) for r in rows if r["doc_id"] < 9000}
    assert got == {(100 * k + 20, 100 * k + 10): (45, 105, 20, 80, 0) for k in range(30)}
    again = [r for r in rows if r["doc_id"] > 9000]
    assert {(r["doc_id"], r["match_id"]) for r in again} == {(9002, 9001)}
    assert {p for r in again for p in range(r["start"], r["end"])} == set(range(9, 139))


def test_fenwick_gives_the_best_so_far():
    rng = random.Random(12)
    for _ in range(50):
        tree, put = passages.Fenwick(30), {}
        for who in range(60):
            at, value = rng.randrange(30), rng.random()
            tree.put(at, value, who)
            put[who] = (at, value)
            upto = rng.randrange(-1, 30)
            below = [(v, w) for w, (p, v) in put.items() if p <= upto]
            assert tree.upto(upto) == (max(below) if below else (float("-inf"), -1))


def test_chains_are_best():
    """The best chain's score against the quadratic recurrence, on matches that do not overlap; chains ascend in both."""
    rng = random.Random(4)
    k, gap, step = passages.K, passages.GAP_COST, 10
    for _ in range(200):
        matches = sorted({(step * rng.randrange(5), step * rng.randrange(5)) for _ in range(rng.randrange(1, 20))})  # so near each other that no chain is cut
        best = {}
        for a, b in matches:
            best[a, b] = k + max([0.0, *(best[x, y] - gap * (a + b - x - y) for x, y in best if x < a and y < b)])
        found = passages.chains(matches)
        assert sorted(m for c in found for m in c) == matches
        assert all(p[0] < q[0] and p[1] < q[1] for c in found for p, q in zip(c, c[1:], strict=False))
        assert all(q[0] - p[0] <= passages.MAX_GAP + k and q[1] - p[1] <= passages.MAX_GAP + k for c in found for p, q in zip(c, c[1:], strict=False))
        score = lambda c: k * len(c) - gap * (c[-1][0] + c[-1][1] - c[0][0] - c[0][1])
        assert max(map(score, found)) == pytest.approx(max(best.values()))


def spans_by_hand(text):
    def luhn(s):
        total = 0
        for k, c in enumerate(reversed(s)):
            d = int(c) * (1 + k % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, p, good in kinds for m in re.finditer(p, text) if good(m[0])]


def test_pii_base(spark, texts):
    odd = {
        10**6: "a@b.c.@d.e x@y a.b@c-d.e_f@g.h é+1 (2) 345-67-89 +12345678", 10**6 + 1: "1.2.3.4.5.6.7.8 256.1.1.1 01.2.3.255 1.2.3", 10**6 + 2: "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111", 10**6 + 3: "\x01a@b.co\x01",
        10**6 + 4: "+" * 5000 + "1" * 5000 + "@" + "." * 5000, 10**6 + 5: "𝒳 me@x.org 𝒳", 10**6 + 6: "a" * 50_000, 10**6 + 7: "1 " * 20_000,
    }
    rows = texts | odd
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = pii.find_pii(df)
    seen = Counter()
    for r in found.select("doc_id", "base", "added", F.sha2(pii._joined(F.col("base")), 256).alias("sha"), pii._joined(F.concat("base", "added")).alias("all")).collect():
        want = spans_by_hand(rows[r["doc_id"]])
        assert r["sha"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), r["doc_id"]
        assert [tuple(m) for m in r["base"]] == want
        assert all(not (a["start"] < b["end"] and b["start"] < a["end"]) for a in r["added"] for b in r["base"])
        seen.update(k for k, _, _ in want)
    assert set(seen) == {"email", "ip", "card", "phone"}


def test_pii_adds_secrets(spark):
    rows = [(k, f"token = 'sk_{'aB3dE5fG7h' * 3}{k:04d}' and mail bob [at] example [dot] org, call 555-123-{k:04d} now") for k in range(50)] + [(100 + k, "plain words without anything to find") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {m["kind"] for m in r["added"]} for r in pii.find_pii(df).collect()}
    assert all("secret" in got[k] for k in range(50)) and not any(got[100 + k] for k in range(50))


def test_pii_finds_what_base_patterns_miss(spark):
    """Keys that follow a name in the driver's own documents: nearly all are found, and little else is added."""
    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    key = re.compile(r"token = \"([0-9a-f]{32,})\"")
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, m.start(1), m.end(1)) for d, t in docs.items() for m in key.finditer(t)}
    rows = pii.op10_pii(spark, sf).collect()
    got = {(r["doc_id"], int(a), int(b)) for r in rows for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x) if kind == "secret"}
    assert len(want) >= 10 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want) + 2
    for r in rows:
        kinds = Counter(x.split(":")[0] for x in r["spans"].split(",") if x)
        assert r["n_secret"] == kinds["secret"] and r["n_spans"] == sum(kinds.values()) == r["n_added"] + sum(r[f"n_{k}"] for k in pii.BASE)
