"""op9: a text that repeats itself does not make rows with the square of its repeats, and batches do not change results."""

import random

import numpy as np
import pyarrow as pa

from ledgerline.llm import passages as P


class Everything:
    """A bitmap that holds every pair."""

    value = np.full(P._MAP_WORDS, 0xFFFFFFFFFFFFFFFF, np.uint64)


def batches(rows, sizes):
    kinds, names = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), ["doc_id", "kind", "pos", "end", "seed"]
    while rows:
        n = next(sizes)
        part, rows = rows[:n], rows[n:]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], k) for i, k in enumerate(kinds)], names)


def test_a_pair_is_one_row_a_document():
    line = [random.Random(1).randrange(1 << 60) for _ in range(12)]  # a line of 60 words with a seed each 5, 40 times
    rows = [(d, 1, 60 * k + 5 * i, 0, s) for d in (3, 9) for k in range(40) for i, s in enumerate(line)]
    found = [x for b in P._paired(Everything)(batches(rows, iter(lambda: 97, 0))) for x in b.to_pylist()]
    assert len(found) == len({(x["pair"], x["doc_id"]) for x in found}) and {x["doc_id"] for x in found} == {3, 9}
    assert max(len(x["here"]) for x in found) >= 39  # all places are kept


def test_batches_of_seeds_do_not_matter():
    r = random.Random(2)
    rows = [(d, 0, 7, 70, 0) for d in range(9)] + [(d, 1, p, 0, r.randrange(20)) for d in range(9) for p in sorted(r.sample(range(400), 60))]
    rows.sort(key=lambda x: x[:3])
    for task in (P._pair_keys, P._paired(Everything), P._uncovered):
        whole, cut = (sorted(str(x) for b in task(batches(rows, iter(lambda n=n: n, 0))) for x in b.to_pylist()) for n in (10000, 13))
        assert whole == cut and whole


def test_matches_in_order_score_as_by_the_tree():
    r = random.Random(3)
    for _ in range(300):
        a = b = 0
        matches = []
        for _ in range(r.randrange(1, 20)):
            a, b = a + r.choice([1, 4, 5, 9, 30]), b + r.choice([1, 4, 5, 9, 30])
            matches.append((a, b))
        assert P._in_order(matches, P.K) == P._out_of_order(matches, P.K)
