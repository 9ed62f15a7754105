"""Substring dedup by collinear chaining: finds fuzzy passages that repeat across documents.

Each text gives seeds: the least hashed k-mer of words in every window of WINDOW k-mers, so any WINDOW + K - 1 words
that two texts share give at least one seed in common. A seed's occurrences are joined to its first occurrence, in the
document of least doc_id, which is linear in the occurrences. The matches of a document with one other are chained in
order of both positions, maximising matched words less gap costs with a Fenwick tree, and chains are aligned on the
words themselves: gaps between anchors are compared by edit distance, ends go on as far as words outweigh edits.

A passage whose parts occur earlier in several documents has seeds that point to each of those, and no chain of its own
length. So pairs of repeated seeds that span MIN_WORDS words, which no such part holds, are joined to their own first
occurrence where no passage holds them yet, chained and aligned alike (``far_matches``). And where all seeds of MIN_WORDS words repeat and no chain's passage holds these words, the windows of MIN_WORDS
words themselves are looked up, in all documents that hold the least k-mer of such a window, and joined to their first
occurrence. Windows are compared by 64 bits of their hash. Where a text repeats a window over itself, as in a run of one
word, it is reported at steps of MIN_WORDS.

A row says that words start to end of doc_id (end exclusive) are a fuzzy copy of words match_start to match_end of
match_id, an earlier document, with ``distance`` word edits. Passages are MIN_WORDS words or more on both sides, with
edits for at most 1 - IDENTITY of them. That is what a row may have, not what is always found: a chain needs two seeds of
K equal words, so of short passages some with edits for over a tenth of the words are missed (README, recall by edit rate).

Null and empty texts have no passages. Rows that share a doc_id count as one document: seeds of all rows are
taken, and a chain is aligned on each of its texts by those anchors that the text holds. Rows with a null doc_id are left out, as nothing could name them. Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import gram_hashes, mixed, saved, sliding, small_batches, word_hashes

K, WINDOW = 5, 10
MIN_WORDS, IDENTITY = 50, 0.8
#: Cost of a word skipped between two matches, and the score a chain needs to be looked at.
GAP_COST, MIN_SCORE = 0.1, 6.5
#: Gaps and ends up to so many words are aligned; a chain with a longer gap is two passages.
MAX_GAP = 40
#: What an edit costs at the ends of a chain, in words, so that ends with more than 1 - IDENTITY edits are left off; and
#: how far an end may fall behind its best.
EDIT_COST, DROP = 3.0, 15.0


def seeds(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the minimizers of a text's k-mers; the rightmost of equal ones in a window."""
    if len(h) < k:
        return h[:0], np.zeros(0, np.int64)
    g = gram_hashes(h, k)
    w = min(window, len(g))
    least = sliding(np.minimum, g, w)
    edge = np.zeros(w - 1, np.uint64)
    # a position is a window's least if the greatest of the leasts of the windows around it is its own
    at = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), w) == g)
    if np.any((np.diff(at) < w) & (g[at[1:]] == g[at[:-1]])):  # equal ones in a window
        views = np.lib.stride_tricks.sliding_window_view(g[::-1], w)[::-1]
        at = np.unique(np.arange(len(g) - w + 1) + w - 1 - views.argmin(1))
    return g[at], at


def _texts(b):
    """Hashes of the words of each row's text."""
    h, bounds = word_hashes(b.column("text"))
    return [h[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


#: Words of several texts are looked at together, so many at a time (a longer text is looked at alone).
_CHUNK = 1 << 17


def _chunks(bounds: np.ndarray):
    """Ranges of texts, given where their words begin, of at most _CHUNK words or of one text."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _CHUNK, "right")) - 1)
        yield at, to
        at = to


def text_seeds(h: np.ndarray, bounds: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of several texts, whose words are one after another: hashes, positions in their text, and which text's."""
    sizes = np.diff(bounds)
    few = (sizes >= k) & (sizes < window + k - 1)  # one window, not full
    at, again = np.zeros(0, np.int64), few
    if len(h) >= window + k - 1:
        g = gram_hashes(h, k)
        least = sliding(np.minimum, g, window)
        # a window over two texts is none
        ends = bounds[1:-1]
        crossing = np.repeat(ends, window + k - 2) - np.tile(np.arange(1, window + k - 1), len(ends))
        least[crossing[(crossing >= 0) & (crossing < len(least))]] = 0
        edge = np.zeros(window - 1, np.uint64)
        at = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), window) == g)
        text = np.searchsorted(bounds, at, "right") - 1
        tied = (np.diff(at) < window) & (g[at[1:]] == g[at[:-1]]) & (text[1:] == text[:-1])
        again = few.copy()
        again[text[1:][tied]] = True
        at = at[~again[text]]
    cols = []
    if len(at):
        text = np.searchsorted(bounds, at, "right") - 1
        cols.append((g[at], at - bounds[text], text))
    for i in np.flatnonzero(again):
        found, places = seeds(h[bounds[i] : bounds[i + 1]], k, window)
        cols.append((found, places, np.full(len(found), i)))
    return tuple(np.concatenate(c) for c in zip(*cols, strict=True)) if cols else (h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))


def _seeded(batches):
    for b in batches:
        h, bounds = word_hashes(b.column("text"))
        ids, cols = np.asarray(b.column("doc_id")), [[np.zeros(0, k)] for k in (np.int64, np.int64, np.int32)]
        for lo, hi in _chunks(bounds):
            found, at, text = text_seeds(h[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            for c, x in zip(cols, (found.view(np.int64), ids[lo:hi][text], at.astype(np.int32)), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["seed", "doc_id", "pos"])


class Fenwick:
    """Greatest value, with its owner, among positions up to one."""

    def __init__(self, n: int):
        self.best, self.who = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, value: float, who: int) -> None:
        best, own = self.best, self.who
        at += 1
        while at < len(best):
            if value > best[at]:
                best[at], own[at] = value, who
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        value, who, best = float("-inf"), -1, self.best
        at += 1
        while at > 0:
            if best[at] > value:
                value, who = best[at], self.who[at]
            at -= at & -at
        return value, who


def chains(matches: list[tuple[int, int]], k: int = K) -> list[list[tuple[int, int]]]:
    """Splits matches (position here, position there) into chains that ascend in both, best first, by the recurrence
    score(i) = k + max(0, max over earlier j of score(j) - GAP_COST * words skipped on both sides)."""
    matches = sorted(set(matches))
    score, back = _in_order(matches, k) if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(matches, matches[1:])) else _out_of_order(matches, k)
    used, out = [False] * len(matches), []
    for i in sorted(range(len(matches)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and (chain[-1][0] - matches[i][0] > MAX_GAP + k or chain[-1][1] - matches[i][1] > MAX_GAP + k):
                out.append(chain[::-1])
                chain = []
            chain.append(matches[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _in_order(matches: list[tuple[int, int]], k: int) -> tuple[list[float], list[int]]:
    """Scores and earlier matches where all matches ascend in both texts. The last match is then always the best to go on from,
    as it overlaps by less than its own words."""
    score, back, value = [], [], float("-inf")
    for i, (a, b) in enumerate(matches):
        gain = value - GAP_COST * (a + b)
        score.append(k + gain if gain > 0 else float(k))
        back.append(i - 1 if gain > 0 else -1)
        if gain > 0:  # words that overlap count once
            score[i] -= max(0, k - min(a - matches[i - 1][0], b - matches[i - 1][1]))
        value = score[i] + GAP_COST * (a + b)
    return score, back


def _out_of_order(matches: list[tuple[int, int]], k: int) -> tuple[list[float], list[int]]:
    ranks = {p: r for r, p in enumerate(sorted({b for _, b in matches}))}
    tree, score, back = Fenwick(len(ranks)), [0.0] * len(matches), [-1] * len(matches)
    at = 0
    while at < len(matches):
        stop = at
        while stop < len(matches) and matches[stop][0] == matches[at][0]:
            stop += 1
        for i in range(at, stop):
            a, b = matches[i]
            value, who = tree.upto(ranks[b] - 1)
            gain = value - GAP_COST * (a + b)
            score[i], back[i] = (k + gain, who) if who >= 0 and gain > 0 else (float(k), -1)
            if back[i] >= 0:  # words that overlap count once
                score[i] -= max(0, k - min(a - matches[back[i]][0], b - matches[back[i]][1]))
        for i in range(at, stop):
            tree.put(ranks[matches[i][1]], score[i] + GAP_COST * (matches[i][0] + matches[i][1]), i)
        at = stop
    return score, back


def _score(chain: list[tuple[int, int]], k: int = K) -> float:
    total, last = float(k), chain[0]
    for a, b in chain[1:]:
        step = min(a - last[0], b - last[1])
        total += min(k, step) - GAP_COST * max(0, max(a - last[0], b - last[1]) - k)
        last = (a, b)
    return total


def _may_chain(first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False for pairs of documents whose matches make no chain of MIN_SCORE: those with one match, and those with two that
    lie too far apart. By a hair too generous, as ``chains`` decides."""
    may = size > 2
    two = np.flatnonzero(size == 2)
    i = first[two]
    da, db = a[i + 1] - a[i], np.where(a[i + 1] > a[i], b[i + 1] - b[i], 0)
    total = K + np.minimum(K, np.minimum(da, db)) - GAP_COST * np.maximum(0, np.maximum(da, db) - K)
    may[two] = (da > 0) & (db > 0) & (total > MIN_SCORE - 0.01)
    return may


def _chained(batches):
    """Streams matches sorted by document, other document and position; keeps one pair's matches at a time, which the
    document's length bounds."""
    kept = []

    def done(pieces):
        d, m, a, b = (np.concatenate(c) for c in zip(*pieces, strict=True))
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])]))
        size = np.diff(np.append(first, len(d)))
        out = []
        for i, n in zip(*(x[_may_chain(first, size, a, b)].tolist() for x in (first, size)), strict=True):
            own = list(zip(a[i : i + n].tolist(), b[i : i + n].tolist(), strict=True))
            out += [(int(d[i]), int(m[i]), [x for x, _ in c], [y for _, y in c]) for c in chains(own) if _score(c) >= MIN_SCORE]
        return _chain_rows(out)

    for batch in batches:
        if not batch.num_rows:
            continue
        d, m, a, b = (np.asarray(batch.column(c)) for c in ("doc_id", "match_id", "pos", "match_pos"))
        a, b = a.astype(np.int64), b.astype(np.int64)
        # the last pair of the batch may go on in the next
        other = np.flatnonzero((d != d[-1]) | (m != m[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if kept and (cut or kept[-1][0][-1] != d[0] or kept[-1][1][-1] != m[0]):
            yield done([*kept, (d[:cut], m[:cut], a[:cut], b[:cut])])
            kept = []
        elif cut:
            yield done([(d[:cut], m[:cut], a[:cut], b[:cut])])
        kept.append((d[cut:], m[cut:], a[cut:], b[cut:]))
    if kept:
        yield done(kept)


def _chain_rows(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "match_id", "here", "there"])


def word_distance(x: list[int], y: list[int]) -> int:
    """Edit distance of two short word lists, by Myers' bit vectors: bit i of a vector is word i of x."""
    if x == y:
        return 0
    if not x or not y:
        return len(x) + len(y)
    held: dict[int, int] = {}
    for i, a in enumerate(x):
        held[a] = held.get(a, 0) | 1 << i
    every, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    more, less, score = every, 0, len(x)
    for b in y:
        equal = held.get(b, 0)
        down = equal | less
        right = (((equal & more) + more) ^ more) | equal
        up, low = less | (every & ~(right | more)), more & right
        score += 1 if up & last else -1 if low & last else 0
        up, low = up << 1 | 1, low << 1
        more, less = (low | ~(down | up)) & every, up & down & every
    return score


def extend(x: list[int], y: list[int]) -> tuple[int, int, int]:
    """How far two word lists go together from their starts, and with how many edits: where words less EDIT_COST an edit
    are most. For each number of edits the furthest point on each diagonal is kept, and points that fall DROP behind the
    best are given up, so texts that part cost a few steps."""
    best, front, edits = (0.0, 0, 0, 0), {0: 0}, 0
    while front:
        reached = {}
        for d, i in front.items():
            j = i - d
            while i < len(x) and j < len(y) and x[i] == y[j]:
                i, j = i + 1, j + 1
            score = (i + j) / 2 - EDIT_COST * edits
            if score > best[0]:
                best = (score, i, j, edits)
            reached[d] = (score, i)
        front, edits = {}, edits + 1
        for d, (score, i) in reached.items():
            if score < best[0] - DROP:
                continue
            for to, at in ((d, i + 1), (d + 1, i + 1), (d - 1, i)):  # a word replaced, only here, only there
                if at <= len(x) and at - to <= len(y) and at > front.get(to, -1):
                    front[to] = at
    return best[1:]


def align(x: list[int], y: list[int], x0: int, y0: int, here: list[int], there: list[int], k: int = K) -> tuple[int, int, int, int, int] | None:
    """Start and end here, start and end there and edits of a chain's passage. x and y are the words from x0 and y0."""
    # only anchors that these two texts hold count: rows that share an id give a chain anchors of several texts
    places = [(p - x0, q - y0) for p, q in zip(here, there, strict=True)]
    places = [(p, q) for p, q in places if p >= 0 and q >= 0 and len(x) >= p + k and len(y) >= q + k and x[p : p + k] == y[q : q + k]]
    if not places:
        return None
    (start_a, start_b), edits = places[0], 0
    end_a, end_b = start_a + k, start_b + k
    for p, q in places[1:]:
        stop_a, stop_b = p + k, q + k
        if p < end_a or q < end_b:  # overlaps what is aligned: only the same diagonal goes on at no cost
            shift = max(end_a - p, end_b - q)
            if (end_a - p) != (end_b - q) or shift >= k:
                continue
            p, q = p + shift, q + shift
        edits += word_distance(x[end_a:p], y[end_b:q])
        end_a, end_b = stop_a, stop_b
    n, m, more = extend(x[end_a : end_a + MAX_GAP * 5], y[end_b : end_b + MAX_GAP * 5])
    end_a, end_b, edits = end_a + n, end_b + m, edits + more
    n, m, more = extend(x[max(0, start_a - MAX_GAP * 5) : start_a][::-1], y[max(0, start_b - MAX_GAP * 5) : start_b][::-1])
    return start_a - n + x0, end_a + x0, start_b - m + y0, end_b + y0, edits + more


PAD = MAX_GAP * 5


def _row_words(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words of rows' texts, one array for rows that follow one another with the same text, and which is whose."""
    new = np.ones(len(texts), bool)
    if len(texts) > 1:
        new[1:] = ~np.asarray(pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).fill_null(False))
    h, bounds = word_hashes(texts.take(pa.array(np.flatnonzero(new))))
    h = h.view(np.int64)
    return [h[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], np.cumsum(new) - 1


def _cut(batches):
    """Cuts the words of a chain's passage, and PAD words around, out of the document's own text."""
    for b in batches:
        words, which = _row_words(b.column("text"))
        out, starts = [], []
        for i, chain in zip(which, b.column("here").to_pylist(), strict=True):
            starts.append(max(0, chain[0] - PAD))
            out.append(words[i][starts[-1] : chain[-1] + K + PAD].tobytes())
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.binary()), pa.array(starts, pa.int32())], [*names, "own_words", "own_from"])


def _aligned(batches):
    """Aligns chains with the other document's text, those of one other document together. A chain that lies within a passage
    already found in the same two documents says nothing new and is left out, as texts that repeat themselves have many."""
    match, held = None, {}
    for b in batches:
        rows = []
        words, which = _row_words(b.column("text"))
        cols = (b.column(c).to_pylist() for c in ("doc_id", "match_id", "here", "there", "own_words", "own_from"))
        for i, (d, m, here, there, own_words, own_from) in enumerate(zip(*cols, strict=True)):
            if m != match:
                match, held = m, {}
            own = held.setdefault(d, [])
            if any(lo <= here[0] and here[-1] + K <= hi for lo, hi in own):
                continue
            other_from = max(0, there[0] - PAD)
            other = words[which[i]][other_from : there[-1] + K + PAD].tolist()
            found = align(np.frombuffer(own_words, np.int64).tolist(), other, own_from, other_from, here, there)
            if found:
                rows.append((d, m, *found))
                if _long_enough(*found):
                    own.append(found[:2])
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "match_id", "start", "end", "match_start", "match_end", "distance"])


def _long_enough(start: int, end: int, match_start: int, match_end: int, distance: int) -> bool:
    size = min(end - start, match_end - match_start)
    return size >= MIN_WORDS and distance <= (1 - IDENTITY) * size


#: Documents lie so far apart where positions of several are one array: further than a text is long.
_APART = 1 << 33


class _Documents:
    """Passages and repeated seeds of some documents, whole, in order: ids; held, the passages (start, end) by start; p and s,
    places and hashes of seeds; held and p from the document's number times _APART on."""

    def __init__(self, ids, kind, pos, end, seed):
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        self.ids, base = ids[new], (np.cumsum(new) - 1) * _APART
        own = kind != 0
        self.held = np.stack([pos[~own] + base[~own], end[~own] + base[~own]], 1)
        self.p, self.s = pos[own] + base[own], seed[own].view(np.uint64)

    def reach(self, p: np.ndarray) -> np.ndarray:
        """The furthest end of the passages that begin at each place or before."""
        if not len(self.held):
            return np.full(len(p), -1)
        before = np.searchsorted(self.held[:, 0], p, "right") - 1
        return np.where(before >= 0, np.maximum.accumulate(self.held[:, 1])[np.maximum(before, 0)], -1)


def _documents(batches):
    """Streams documents' passages (kind 0) and then their repeated seeds, in order of documents; gives _Documents for those that
    each batch completes. Keeps one document's rows at a time."""
    rows = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(c)) for c in ("doc_id", "kind", "pos", "end", "seed")]
        other = np.flatnonzero(cols[0] != cols[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (rows and rows[-1][0][-1] != cols[0][0]):
            yield _Documents(*(np.concatenate(c) for c in zip(*rows, [c[:cut] for c in cols], strict=True)))
            rows = []
        rows.append([c[cut:] for c in cols])
    if rows:
        yield _Documents(*(np.concatenate(c) for c in zip(*rows, strict=True)))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Lists of values that follow one another, given where each begins."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int32)), pa.array(values))


def _heads(*cols: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], 0)
    return np.flatnonzero(new)


def _uncovered(batches):
    """The starts of the windows of MIN_WORDS words that no passage holds and whose seeds may all repeat, and the least seeds
    of these windows."""
    for docs in _documents(batches):
        p, s = docs.p, docs.s
        first = np.flatnonzero(np.diff(p, prepend=-_APART) > WINDOW)  # runs of seeds
        last = p[np.append(first[1:], len(p)) - 1] if len(p) else p
        lo = np.maximum(p[first] // _APART * _APART, p[first] - WINDOW + 1)
        n = np.maximum(0, last - (MIN_WORDS - K - WINDOW + 1) - lo + 1)
        starts = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        starts = starts[docs.reach(starts) < starts + MIN_WORDS]
        a, z = np.searchsorted(p, starts), np.searchsorted(p, starts + MIN_WORDS - K, "right")
        starts, a, z = starts[z > a], a[z > a], z[z > a]
        doc = starts // _APART
        spans = _heads(a, z)
        least = np.minimum.reduceat(np.append(s, s[:1]), np.stack([a[spans], z[spans]], 1).ravel())[::2] if len(spans) else s[:0]
        order = np.lexsort((least, doc[spans]))
        least, of = least[order], doc[spans][order]
        once = _heads(least, of)
        cols = [pa.array(docs.ids[doc[_heads(doc)]]), _lists((starts % _APART).astype(np.int32), _heads(doc)), _lists(least[once].view(np.int64), _heads(of[once]))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "starts", "least"])


def _pairs_of(docs: _Documents) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of all pairs of repeated seeds that span MIN_WORDS words or more, MAX_GAP more at most, and that no
    passage holds. Seeds that pairs chain to go on from there, so wider pairs say nothing new."""
    p, s = docs.p, docs.s
    first = np.maximum(np.searchsorted(p, p + MIN_WORDS - K), np.searchsorted(p, docs.reach(p) - K, "right"))
    n = np.maximum(0, np.searchsorted(p, p + MIN_WORDS + MAX_GAP, "right") - first)
    one = np.repeat(np.arange(len(p)), n)
    two = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + first[one]
    return mixed(s[one] * np.uint64(0x9E3779B97F4A7C15) + s[two]).view(np.int64), p[one], p[two]


def _pair_keys(batches):
    """Hashes of the far pairs, each once a document."""
    for docs in _documents(batches):
        h, a, _ = _pairs_of(docs)
        doc = a // _APART
        order = np.lexsort((h, doc))
        yield pa.RecordBatch.from_arrays([pa.array(h[order][_heads(h[order], doc[order])])], ["pair"])


def _paired(shared):
    """The far pairs that the bitmap ``shared`` holds, each once a document: its first places, and all places of its first seed
    and of its second. A text that repeats itself has a pair at as many places as the square of its repeats."""

    def run(batches):
        for docs in _documents(batches):
            h, a, b = _pairs_of(docs)
            kept = _in_map(h.view(np.uint64), shared.value)
            h, a, b = h[kept], a[kept], b[kept]

            def places(x, y):
                """In order of document, pair, x and y: hash, x and y where a pair begins, and the different x of each."""
                order = np.lexsort((y, x, h, a // _APART))  # noqa: B023
                key, x, y = h[order], x[order], y[order]  # noqa: B023
                pair, once = _heads(key, x // _APART), _heads(key, x)
                return key[pair], x[pair], y[pair], _lists((x[once] % _APART).astype(np.int32), np.searchsorted(once, pair))

            key, x, y, here = places(a, b)
            here2 = places(b, a)[-1]
            cols = [pa.array(key), pa.array(docs.ids[x // _APART]), *(pa.array((c % _APART).astype(np.int32)) for c in (x, y)), here, here2]
            yield pa.RecordBatch.from_arrays(cols, ["pair", "doc_id", "pos", "pos2", "here", "here2"])

    return run


def far_matches(repeats: DataFrame, passages: DataFrame) -> DataFrame:
    """Matches (doc_id, match_id, pos, match_pos) of what no passage holds yet: by pairs of repeated seeds that span a passage's
    length, joined to their own first occurrence. A document that holds parts of less than MIN_WORDS words has no such pair, so
    parts that stand in several earlier documents do not keep two later ones apart that share the whole."""
    parts = int(repeats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = passages.select("doc_id", F.lit(0).alias("kind"), F.col("start").alias("pos"), "end", F.lit(0).cast("long").alias("seed"))
    both = both.union(repeats.select("doc_id", F.lit(1), F.col("pos").cast("long"), F.lit(0).cast("long"), "seed"))
    ordered = both.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind", "pos")
    # pairs that several documents have are few, so only hashes are counted, and places are made for what is left
    several = saved(ordered.mapInArrow(_pair_keys, "pair long").groupBy("pair").count().where("count > 1").select("pair"))
    shared = repeats.sparkSession.sparkContext.broadcast(_bit_map(several, "pair"))
    places = ordered.mapInArrow(_paired(shared), "pair long, doc_id long, pos int, pos2 int, here array<int>, here2 array<int>")
    pairs = saved(places.join(several, "pair", "left_semi"))
    first = pairs.groupBy("pair").agg(F.min(F.struct("doc_id", "pos", "pos2")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id < last")
    met = "concat(transform(here, x -> struct(x AS pos, f.pos AS match_pos)), transform(here2, x -> struct(x AS pos, f.pos2 AS match_pos)))"
    hits = pairs.join(first, "pair").where("doc_id > f.doc_id").select("doc_id", F.col("f.doc_id").alias("match_id"), F.inline(F.expr(met)))
    return hits.distinct()


def _asked(batches):
    """Hashes of the windows that start at a row's starts, each once a text with all its places."""
    for b in batches:
        out = []
        for i, h, starts in zip(b.column("doc_id").to_pylist(), _texts(b), b.column("starts").to_pylist(), strict=True):
            g = gram_hashes(h, MIN_WORDS)
            at = np.array([a for a in starts if a < len(g)], np.int32)
            if len(at):
                order = np.argsort(g[at], kind="stable")
                wins, heads = np.unique(g[at][order], return_index=True)
                out += [(w, i, places) for w, places in zip(wins.view(np.int64), np.split(at[order], heads[1:]), strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], ["win", "doc_id", "places"])


def _answers(shared):
    """Hashes of the windows whose least k-mer is at one of a row's positions, those that the bitmap ``shared`` holds, with their
    first place in the text. A window's least k-mer is a seed, so it is at such a position if it equals one that is."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)

    def windows(h, bounds, at):
        """Windows, which text's and their places there; ``at`` are places among the words of all texts."""
        if len(h) < MIN_WORDS:
            return h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = gram_hashes(h, K)
        asked = np.full(len(g), none)
        asked[at] = g[at]
        asked = sliding(np.minimum, asked, MIN_WORDS - K + 1)
        starts = np.flatnonzero((asked == sliding(np.minimum, g, MIN_WORDS - K + 1)) & (asked != none))
        text = np.searchsorted(bounds, starts, "right") - 1
        whole = starts + MIN_WORDS <= bounds[text + 1]
        starts, text = starts[whole], text[whole]
        win = gram_hashes(h, MIN_WORDS)[starts]
        kept = _in_map(win, shared.value)
        win, text, starts = win[kept], text[kept], starts[kept]
        order = np.lexsort((starts, win, text))
        once = order[_heads(win[order], text[order])]
        return win[once], text[once], starts[once] - bounds[text[once]]

    def run(batches):
        for b in batches:
            h, bounds = word_hashes(b.column("text"))
            where = b.column("at")
            ids, place = np.asarray(b.column("doc_id")), np.asarray(where.flatten()).astype(np.int64)
            text = np.repeat(np.arange(len(ids)), np.asarray(where.value_lengths()))
            place += bounds[text]
            place, text = (x[place + K <= bounds[text + 1]] for x in (place, text))
            cols = [[np.zeros(0, k)] for k in (np.int64, np.int64, np.int32)]
            for lo, hi in _chunks(bounds):
                at = place[np.searchsorted(text, lo) : np.searchsorted(text, hi)] - bounds[lo]
                win, of, start = windows(h[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], at)
                for c, x in zip(cols, (win.view(np.int64), ids[lo:hi][of], start.astype(np.int32)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["win", "doc_id", "pos"])

    return run


#: Words of 64 bits of the maps of windows and of pairs that are looked for: 2 MB, whatever their number; more only let more pass.
_MAP_WORDS = 1 << 18


def _bit_map(wanted: DataFrame, key: str) -> np.ndarray:
    word, bit = F.expr(f"CAST({key} & {_MAP_WORDS - 1} AS INT)"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({key}, 58) AS INT))")
    out = np.zeros(_MAP_WORDS, np.int64)
    for r in wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect():  # _MAP_WORDS rows at most
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _in_map(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bits[(x & np.uint64(_MAP_WORDS - 1)).astype(np.int64)] >> (x >> np.uint64(58))) & np.uint64(1) == 1


def window_runs(hits: list[tuple[int, int]], size: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """Joins equal windows (position here, position there), in order, to passages: start and end here, and there. Of a
    window there that meets overlapping ones here, those at steps of its size and the last are taken."""
    last, held, taken = {}, {}, []
    for a, b in hits:
        if b in last and a - last[b] < size:
            held[b] = a
            continue
        if b in held and a - held[b] >= size:
            taken.append((held[b], b))
        held.pop(b, None)
        last[b] = a
        taken.append((a, b))
    taken += [(a, b) for b, a in held.items()]
    out = []
    for a, b in sorted(taken, key=lambda m: (m[0] - m[1], m[0])):
        if out and out[-1][0] - out[-1][2] == a - b and a <= out[-1][1]:
            out[-1] = (out[-1][0], a + size, out[-1][2], b + size)
        else:
            out.append((a, a + size, b, b + size))
    return out


def _joined(batches):
    """Streams equal windows, with all their places in the document, sorted by document and other document."""
    key, own = None, []

    def rows(found):
        cols = list(zip(*found, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "match_id", "start", "end", "match_start", "match_end", "distance"])

    for b in batches:
        out = []
        for d, m, places, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "match_id", "places", "match_pos")), strict=True):
            if (d, m) != key:
                out += [(*key, *r, 0) for r in window_runs(sorted(own))] if own else []
                key, own = (d, m), []
            own += [(x, y) for x in places]
        yield rows(out)
    if own:
        yield rows([(*key, *r, 0) for r in window_runs(sorted(own))])


def _asked_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` that a bitmap of the ``doc_id`` of ``ids`` holds, so that most others are not shuffled. The bitmap is
    broadcast and of _MAP_WORDS words at most; more ids only let more pass."""
    hashed = F.xxhash64("doc_id")
    word, bit = hashed.bitwiseAND(_MAP_WORDS - 1), F.expr("shiftleft(1L, CAST(shiftrightunsigned(xxhash64(doc_id), 58) AS INT))")
    bits = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    kept = texts.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word")).where(F.col("_bits").bitwiseAND(bit) != 0)
    return kept.select(texts.columns)


def _documents_of(occurrences: DataFrame, key: str) -> DataFrame:
    """The first document of each key that several documents have. Numbers are grouped by hash, structs by sorting, so the
    place there is looked up by ``_met`` for what is left."""
    grouped = occurrences.groupBy(key).agg(F.min("doc_id").alias("match_id"), F.max("doc_id").alias("last"))
    # saved, so that what joins it is a join of two plain exchanges, of which a hot key's part can be dealt to several tasks
    return saved(grouped.where("match_id < last").select(key, "match_id"))


def _met(repeats: DataFrame, key: str) -> DataFrame:
    """The first place in its first document of each key."""
    return repeats.where("doc_id = match_id").groupBy(key).agg(F.min("pos").alias("match_pos"))


def exact_windows(texts: DataFrame, repeats: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages of equal words that repeat and that none of ``passages`` holds."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = passages.select("doc_id", F.lit(0).alias("kind"), F.col("start").alias("pos"), "end", F.lit(0).cast("long").alias("seed"))
    earlier = repeats.where("match_id < doc_id")  # a window that an earlier document has holds no seed that is new here
    both = held.union(earlier.select("doc_id", F.lit(1), F.col("pos").cast("long"), F.lit(0).cast("long"), "seed"))
    ordered = both.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind", "pos")
    open_ = saved(ordered.mapInArrow(_uncovered, "doc_id long, starts array<int>, least array<long>"))
    askers = _asked_texts(texts, open_).join(open_.select(F.col("doc_id").alias("_doc"), "starts").hint("merge"), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "starts")
    asked = saved(askers.mapInArrow(_asked, "win long, doc_id long, places array<int>"))
    shared = texts.sparkSession.sparkContext.broadcast(_bit_map(asked, "win"))
    wanted = open_.select(F.explode("least").alias("seed")).distinct()
    at = repeats.join(wanted, "seed", "left_semi").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("pos").alias("at"))
    at = saved(at)
    looked = _asked_texts(texts, at.select(F.col("_doc").alias("doc_id"))).join(at.hint("merge"), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "at")
    windows = saved(looked.mapInArrow(_answers(shared), "win long, doc_id long, pos int"))
    repeated = saved(windows.join(_documents_of(windows, "win"), "win").where("doc_id = match_id"))
    first = repeated.groupBy("win").agg(F.min("match_id").alias("match_id"), F.min("pos").alias("match_pos"))
    hits = asked.join(first, "win").where("doc_id > match_id").select("doc_id", "match_id", "places", "match_pos")
    ordered = hits.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "match_id")
    more = ordered.mapInArrow(_joined, "doc_id long, match_id long, start long, end long, match_start long, match_end long, distance long")
    every = passages.withColumn("kind", F.lit(0)).unionByName(more.distinct().withColumn("kind", F.lit(1)))
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "kind", "match_id", "match_start").rowsBetween(Window.unboundedPreceding, -1)
    kept = every.withColumn("reach", F.max("end").over(before)).where("kind = 1 and (reach is null or reach < end)")
    return kept.select(*passages.columns)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """One row per passage: doc_id, match_id, start, end, match_start, match_end, distance."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found = saved(texts.mapInArrow(_seeded, "seed long, doc_id long, pos int"))
    # a task's part of the first documents, and of the first places, is one row a seed
    repeats = saved(found.join(_documents_of(found, "seed").hint("shuffle_hash"), "seed").select("seed", "doc_id", "match_id", "pos"))
    matches = repeats.where("doc_id <> match_id").join(_met(repeats, "seed").hint("shuffle_hash"), "seed").select("doc_id", "match_id", "pos", "match_pos")
    best = aligned_chains(texts, matches, min_words, identity)
    far = saved(far_matches(repeats, best))
    late = aligned_chains(texts, far, min_words, identity)
    best = saved(best.union(late.join(best, ["doc_id", "match_id", "start", "end"], "left_anti").select(best.columns)))
    more = exact_windows(texts, repeats, best)
    return best.union(more.where((F.col("end") - F.col("start")) >= min_words))


def aligned_chains(texts: DataFrame, matches: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Passages by the chains of ``matches`` (doc_id, match_id, pos, match_pos)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = matches.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "match_id", "pos")
    schema = "doc_id long, match_id long, here array<int>, there array<int>"
    linked = saved(ordered.mapInArrow(_chained, schema))
    own_texts = _asked_texts(texts, linked).select(F.col("doc_id").alias("_own"), "text")
    own = linked.hint("merge").join(own_texts, F.col("doc_id") == F.col("_own")).select("doc_id", "match_id", "here", "there", "text")
    cut = saved(own.mapInArrow(_cut, f"{schema}, own_words binary, own_from int"))
    other_texts = _asked_texts(texts, linked.select(F.col("match_id").alias("doc_id"))).select(F.col("doc_id").alias("_other"), "text")
    other = cut.hint("merge").join(other_texts, F.col("match_id") == F.col("_other")).select(*cut.columns, "text")
    aligned = other.mapInArrow(_aligned, "doc_id long, match_id long, start long, end long, match_start long, match_end long, distance long")
    size = F.least(F.col("end") - F.col("start"), F.col("match_end") - F.col("match_start"))
    long = aligned.where((size >= min_words) & (F.col("distance") <= (1 - identity) * size))
    best = long.groupBy("doc_id", "match_id", "start", "end").agg(F.min(F.struct("distance", "match_start", "match_end")).alias("m"))
    return saved(best.select("doc_id", "match_id", "start", "end", "m.match_start", "m.match_end", "m.distance"))


def op9_passages(spark, sf_dir):
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
