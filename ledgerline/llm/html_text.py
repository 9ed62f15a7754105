"""Main text of pages by a tree-structured graphical model over their DOM nodes.

A page becomes a tree of block elements whose leaves are blocks of text. Every node is not content, content, or a mixture
of both; its features give it a potential, and so does each pair of parent and child. Sum-product messages pass from the
leaves to the root and back and give every node's marginal probability of content; a block of text is kept where it is
0.5 or more. Weights maximise the likelihood of labelled pages: their gradient is what the labels show less what
the marginals expect. Labelled are pages of the corpus that mark their main text by an article or main element (at most
``MAX_TRAIN_PAGES``, taken evenly by hash; in one of ``HIDDEN`` that element is turned to a div before they are learnt from)
and ``MAX_LAYOUTS`` pages of other layouts, as a corpus may show few. One task learns; the weights, of fixed size, are
broadcast, and one pass over the pages extracts their texts.

Null, empty and textless pages give an empty text. Pages that are cut short or wrongly nested are closed as browsers do,
a comment, script or style that never ends goes on to the end of the page, and pages of any length or depth are read
whole, without recursion. Repeated rows repeat their results; a null page_id or url stays. Columns other than page_id,
url and html are not read. A table without pages gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import small_batches
from ledgerline.llm.page_layouts import labelled_pages

MAX_TRAIN_PAGES = 500
MAX_LAYOUTS = 700
#: One in so many pages of the corpus is learnt from without the element that marks its main text.
HIDDEN = 4
ROUNDS = 120
#: Elements within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page.
SKIPPED = frozenset("script style title textarea noscript template iframe object svg math canvas select button audio video xmp noembed noframes".split())
#: What a start tag closes: the elements, and those that keep it from looking further up.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["tbody"]
_KEEPS_P = frozenset({"td", "th", "table", "caption", "object", "button"})

_TOKEN = re.compile(
    r"""(?P<text>[^<]++)|<!--(?P<comment>>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)|<[!?/][^>]*+>?|<""", re.S
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden|data-gold)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s"'/]|$)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

N_STATES = 3  # not content, content, a mixture
_HASHED = 1 << 12
_KINDS = ["text", "h", "p", "list", "item", "table", "marked", "box", "other"]
_KIND_OF = {
    **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "h"), "p": "p", "blockquote": "p", "pre": "p", **dict.fromkeys("ul ol dl menu".split(), "list"), **dict.fromkeys("li dt dd".split(), "item"),
    **dict.fromkeys("table tbody thead tr td th".split(), "table"), **dict.fromkeys("nav header footer aside form article main".split(), "marked"), **dict.fromkeys("div section body html center figure".split(), "box"),
}


class Tree:
    """The nodes of one page in document order: tag or "" for a block of text, parent, names, text and its link part."""

    def __init__(self):
        self.tags, self.parents, self.names, self.texts, self.linked, self.gold = ["#root"], [-1], [()], [None], [0], [None]

    def add(self, tag, parent, names=(), text=None, linked=0, gold=None) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.texts.append(text)
        self.linked.append(linked)
        self.gold.append(gold)
        return len(self.tags) - 1


class Parser:
    """Reads pages; what attributes say is kept by their text in a table of bounded size."""

    def __init__(self):
        self.known: dict[str, tuple[tuple[str, ...], int | None]] = {}

    def attributes(self, raw: str) -> tuple[tuple[str, ...], int | None]:
        """Name parts of an element, and whether labels call it main text."""
        if raw not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            names, gold = [], None
            for m in _NAMED.finditer(raw):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "data-gold":
                    gold = int(value == "1")
                elif key in ("hidden", "aria-hidden"):
                    names += ["#hidden"] if value.lower() != "false" else []
                elif key == "style":
                    names += ["#hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
                else:
                    names += [p.lower().rstrip("s") for p in _PARTS.findall(value)[:12]]
            self.known[raw] = tuple(dict.fromkeys(names)), gold
        return self.known[raw]

    def tree(self, page: str) -> Tree:
        t = Tree()
        stack, opened = [("#root", 0)], Counter()  # open elements with their block nodes
        run, linked, in_link = [], 0, 0  # the block of text at hand

        def flush():
            nonlocal linked
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    t.add("", stack[-1][1], text=text, linked=min(linked, len(text)))
                run.clear()
                linked = 0

        def close():
            nonlocal in_link
            name, _ = stack.pop()
            opened[name] -= 1
            in_link -= name == "a"

        def close_to(found, stops):
            """Closes up to the outermost of the elements ``found`` that no element of ``stops`` hides."""
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in found:
                    cut = k
                    if len(found) == 1:
                        break
            if cut is not None:
                flush()
                while len(stack) > cut:
                    close()

        at, size, scan = 0, len(page), _TOKEN.match
        while at < size:
            m = scan(page, at)
            at = m.end()
            text = m["text"]
            if text is None and m["tag"] is None:
                if m[0] == "<":
                    text = "<"
                else:
                    continue
            if text is not None:
                run.append(text)
                if in_link:
                    linked += len(text)
                continue
            tag = m["tag"].lower()
            if m["end"]:
                if opened[tag]:
                    if tag not in INLINE:
                        flush()
                        while stack[-1][0] != tag:
                            close()
                        close()
                    else:  # an inline end tag closes no block
                        k = len(stack) - 1
                        while stack[k][0] in INLINE and stack[k][0] != tag:
                            k -= 1
                        if stack[k][0] == tag:
                            del stack[k]
                            opened[tag] -= 1
                            in_link -= tag == "a"
                continue
            if tag in SKIPPED:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(page, at)
                at = end.end() if end else size
                run.append(" ")
                continue
            if tag in INLINE:
                if tag in VOID:
                    run.append(" ")
                else:
                    if tag == "a" and in_link:
                        continue
                    stack.append((tag, stack[-1][1]))
                    opened[tag] += 1
                    in_link += tag == "a"
                continue
            flush()
            if opened["p"]:
                close_to({"p"}, _KEEPS_P)
            if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
                close_to(*CLOSES[tag])
            if tag in VOID:
                continue
            names, gold = self.attributes(m["attrs"])
            stack.append((tag, t.add(tag, stack[-1][1], names, gold=gold)))
            opened[tag] += 1
        flush()
        return t


def _bucket(x: np.ndarray, edges) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % _HASHED


class Nodes:
    """The nodes of some pages that hold text, as arrays: parents, depths, edge kinds and features."""

    def __init__(self, trees: list[Tree]):
        tags, names, texts, linked, parents, pages, gold = [], [], [], [], [], [], []
        for k, t in enumerate(trees):
            base, below = len(tags), [False] * len(t.tags)
            for i in range(len(t.tags) - 1, -1, -1):
                if t.texts[i] is not None:
                    below[i] = True
                if below[i] and i:
                    below[t.parents[i]] = True
            place = {}
            for i, ok in enumerate(below):
                if ok:
                    place[i] = base + len(place)
                    tags.append(t.tags[i])
                    names.append(t.names[i])
                    texts.append(t.texts[i])
                    linked.append(t.linked[i])
                    gold.append(t.gold[i])
                    parents.append(place[t.parents[i]] if i else -1)
                    pages.append(k)
        self.tags, self.names, self.texts, self.gold = tags, names, texts, gold
        n = self.n = len(tags)
        self.page, self.parent = np.array(pages, np.int64), np.array(parents, np.int64)
        self.leaf = np.array([t is not None for t in texts], bool)
        depth = [0] * n
        for i, p in enumerate(parents):
            if p >= 0:
                depth[i] = depth[p] + 1
        self.depth = np.array(depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max() + 2 if n else 1))
        self.levels = [x for x in np.split(order, cuts) if len(x)]
        kind = {k: i for i, k in enumerate(_KINDS)}
        self.kind = np.array([kind["text"] if t is not None else kind[_KIND_OF.get(tag, "other")] for tag, t in zip(tags, texts, strict=True)], np.int64)
        self._features(np.array(linked, float))

    def up(self, x: np.ndarray) -> np.ndarray:
        """Sums of a leaf value over all that is below each node."""
        x = x.astype(float)
        for level in self.levels[:0:-1]:
            x += np.bincount(self.parent[level], weights=x[level], minlength=self.n)
        return x

    def _features(self, linked):
        own = [t or "" for t in self.texts]
        chars = np.array([len(t) for t in own], float)
        marks = np.array([t.count(".") + t.count(",") + t.count("?") + t.count("!") + t.count("。") for t in own], float)
        total, links, points, leaves = self.up(chars), self.up(linked), self.up(marks), self.up(self.leaf.astype(float))
        root = np.zeros(self.page.max() + 1 if self.n else 0)
        root[self.page[self.depth == 0]] = total[self.depth == 0]
        before = np.cumsum(chars) - chars
        first = np.zeros(len(root))
        first[self.page[self.depth == 0]] = before[self.depth == 0]
        of = np.maximum(root[self.page], 1) if self.n else root
        kind = self.leaf.astype(np.int64)
        groups = [
            _bucket(np.log2(total + 1), np.arange(2, 14, 1.5)), _bucket(links / np.maximum(total, 1), [0.01, 0.15, 0.35, 0.6, 0.9]), _bucket(100 * points / np.maximum(total, 1), [0.2, 0.8, 1.5, 2.5, 5]),
            _bucket(total / of, [0.02, 0.1, 0.3, 0.5, 0.7, 0.9]), _bucket(np.log2(total / np.maximum(leaves, 1) + 1), np.arange(3, 10)), _bucket((before - first[self.page]) / of if self.n else of, [0.01, 0.2, 0.5, 0.8, 0.95]),
            np.array([(t[-1:] in ".!?:;\"'”»") + 2 * (t[:1].isupper()) for t in own], np.int64),
        ]
        at, ids, offset = [], [], _HASHED
        rows = np.arange(self.n)
        for g in groups:
            at.append(rows)
            ids.append(offset + g * 2 + kind)
            offset += 32
        self.n_features = offset
        cache: dict[str, int] = {}

        def hashed(name):
            if name not in cache:
                cache[name] = _hashed(name)
            return cache[name]

        more_at, more = [], []
        for i, (tag, names) in enumerate(zip(self.tags, self.names, strict=True)):
            p = self.parent[i]
            more.append(hashed(f"<{tag}" if tag else f"in {self.tags[p]}"))
            more_at.append(i)
            for name in names:
                more += (hashed(name), hashed(f"{self.kind[i]} {name}"))
                more_at += (i, i)
        self.at = np.concatenate([*at, np.array(more_at, np.int64)]) if self.n else np.zeros(0, np.int64)
        self.ids = np.concatenate([*ids, np.array(more, np.int64)]) if self.n else np.zeros(0, np.int64)

    def labels(self) -> np.ndarray:
        """States by what the nearest labelled element says of each block: of elements, by most of their text."""
        main = np.zeros(self.n)
        said = [0] * self.n
        for i in range(self.n):
            said[i] = self.gold[i] if self.gold[i] is not None else said[self.parent[i]] if self.parent[i] >= 0 else 0
        chars = np.array([len(t or "") for t in self.texts], float)
        main = self.up(chars * np.array(said)) / np.maximum(self.up(chars), 1)
        return np.where(main > 0.7, 1, np.where(main < 0.05, 0, 2))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


class Model:
    """Weights by feature and state, and by kind of child, parent's state and child's state."""

    def __init__(self, node: np.ndarray, edge: np.ndarray):
        self.node, self.edge = node, edge

    @staticmethod
    def size() -> tuple[tuple[int, int], tuple[int, int, int]]:
        return (_HASHED + 7 * 32, N_STATES), (len(_KINDS), N_STATES, N_STATES)

    def marginals(self, nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each node's states, and of the states of parent and child for each node but roots."""
        n = nodes.n
        own = np.zeros((n, N_STATES))
        for s in range(N_STATES):
            own[:, s] = np.bincount(nodes.at, weights=self.node[nodes.ids, s], minlength=n)
        own[nodes.leaf, 2] = -50.0  # a block of text is no mixture
        pair = self.edge[nodes.kind]  # of node: parent's state, own state
        sent = np.zeros((n, N_STATES))  # to the parent
        for level in nodes.levels[:0:-1]:
            sent[level] = _logsum(pair[level] + own[level][:, None, :], 2)
            for s in range(N_STATES):
                own[:, s] += np.bincount(nodes.parent[level], weights=sent[level, s], minlength=n)
        told = np.zeros((n, N_STATES))  # by the parent
        both = np.zeros((n, N_STATES, N_STATES))
        for level in nodes.levels[1:]:
            p = nodes.parent[level]
            rest = own[p] + told[p] - sent[level]
            joint = pair[level] + rest[:, :, None]
            told[level] = _logsum(joint, 1)
            joint = joint + own[level][:, None, :]
            both[level] = np.exp(joint - _logsum(joint.reshape(-1, N_STATES * N_STATES), 1)[:, None, None])
        belief = own + told
        return np.exp(belief - _logsum(belief, 1)[:, None]), both

    def texts(self, trees: list[Tree]) -> list[str]:
        """The main text of each page: its blocks with a content marginal of 0.5 or more, in order."""
        nodes, out = Nodes(trees), [[] for _ in trees]
        if nodes.n:
            content = self.marginals(nodes)[0][:, 1] >= 0.5
            for i in np.flatnonzero(content & nodes.leaf).tolist():
                out[nodes.page[i]].append(nodes.texts[i])
        return ["\n".join(x) for x in out]


def fit(pages: list[str], rounds: int = ROUNDS, rate: float = 0.15, l2: float = 2e-5) -> Model:
    """Weights of most likelihood on labelled ``pages``, by full gradients with a step of its own for each weight."""
    parser = Parser()
    nodes = Nodes([parser.tree(p) for p in pages])
    gold = nodes.labels()
    shapes = Model.size()
    model = Model(*(np.zeros(s) for s in shapes))
    child = np.flatnonzero(nodes.parent >= 0)
    shown = np.zeros((nodes.n, N_STATES))
    shown[np.arange(nodes.n), gold] = 1
    shown_pairs = np.zeros((nodes.n, N_STATES, N_STATES))
    shown_pairs[child, gold[nodes.parent[child]], gold[child]] = 1
    moments = [[np.zeros(s), np.zeros(s)] for s in shapes]
    for k in range(1, rounds + 1):
        own, both = model.marginals(nodes)
        grads = [np.zeros(s) for s in shapes]
        off, off_pairs = shown - own, (shown_pairs - both)[child]
        for s in range(N_STATES):
            grads[0][:, s] = np.bincount(nodes.ids, weights=off[nodes.at, s], minlength=shapes[0][0])
            for z in range(N_STATES):
                grads[1][:, s, z] = np.bincount(nodes.kind[child], weights=off_pairs[:, s, z], minlength=len(_KINDS))
        for w, g, (m, v) in zip((model.node, model.edge), grads, moments, strict=True):
            g = g / max(nodes.n, 1) - l2 * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return model


_MARKED = re.compile(r"<(article|main)(?=[\s/>])", re.I)
_UNMARKED = re.compile(r"<(nav|aside|footer|header|form)(?=[\s/>])", re.I)


def labelled(page: str, hidden: bool) -> str:
    """A page of the corpus with the labels that its own elements give; ``hidden``: without the element that marks the text."""
    page = _UNMARKED.sub(r'<\1 data-gold="0"', page)
    if hidden:
        page = re.sub(r"</(article|main)\s*>", "</div>", page, flags=re.I)
        return _MARKED.sub('<div data-gold="1"', page)
    return _MARKED.sub(r'<\1 data-gold="1"', page)


def learnable(pages: DataFrame, most: int = MAX_TRAIN_PAGES) -> DataFrame:
    """At most ``most`` different pages that mark their main text, those of least hash."""
    marked = pages.select(F.col("html").cast("string").alias("html")).where("html rlike '(?i)<(article|main)[ >]' and length(html) < 200000").select("html", F.xxhash64("html").alias("h"))
    last = marked.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return marked.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"])


def _learnt(layouts, rounds):
    def run(batches):
        pages = sorted((h, p) for b in batches for h, p in zip(b.column("h").to_pylist(), b.column("html").to_pylist(), strict=True) if p)
        model = fit([labelled(p, k % HIDDEN == 0) for k, (_, p) in enumerate(pages)] + labelled_pages(layouts), rounds)
        yield pa.RecordBatch.from_arrays([pa.array([model.node.tobytes()], pa.binary()), pa.array([model.edge.tobytes()], pa.binary())], ["node", "edge"])

    return run


def fit_content(pages: DataFrame, most: int = MAX_TRAIN_PAGES, layouts: int = MAX_LAYOUTS, rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """The weights, learnt by one task from bounded numbers of pages: 104 KB and 648 bytes."""
    small_batches(pages.sparkSession)
    none = pages.sparkSession.range(1).select(F.lit(None).cast("string").alias("html"), F.lit(0).cast("long").alias("h"))  # layouts are learnt in any case
    row = learnable(pages, most).union(none).coalesce(1).mapInArrow(_learnt(layouts, rounds), "node binary, edge binary").first()
    return bytes(row["node"]), bytes(row["edge"])


def model_of(weights: tuple[bytes, bytes]) -> Model:
    return Model(*(np.frombuffer(w).reshape(s) for w, s in zip(weights, Model.size(), strict=True)))


def _extracted(weights):
    def run(batches):
        model, parser = model_of(weights.value), Parser()
        for b in batches:
            texts = model.texts([parser.tree(p or "") for p in b.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, weights: tuple[bytes, bytes]) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``."""
    spark = pages.sparkSession
    small_batches(spark)
    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    out = read.mapInArrow(_extracted(spark.sparkContext.broadcast(weights)), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op13_html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, fit_content(pages))
