"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of tags it
stands in. A block is a vector of its hashed path (tags and the words of class, id and role), its
hashed words and a few figures; a bidirectional LSTM in numpy reads the blocks of the whole page in
both directions and labels each. Article blocks are joined.

The labels to learn from are the page's own structure on a bounded sample of pages (SAMPLE): blocks
within article or main are text unless a part of the path names a menu, notice, advert, comment and
so on. Each sampled page is also learned in changed forms, with other names for the article's tags
and with foreign blocks put between its own, so that the labeller doesn't rest on one tag. Text in
tags that are never an article's (menus, footers, forms, scripts ...) is read for context only.

Rows
    null and empty html give an empty text, as do pages without an article block. Unclosed tags end
    with the element around them; an unclosed svg, button, object and the like at the next block; an
    unclosed comment, script or style reaches to the end. Self-closed svg and math are empty.
    Repeated rows are labelled each; html is read whole. Further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.samples import sigmoid
from corpus_search.llm.tables import small_batches, spread, whole
from corpus_search.llm.words import BY_LETTERS, U, hashed_words, mix

SAMPLE, SAMPLE_BYTES, SAMPLE_BLOCKS = 300, 100_000, 60
BINS, HIDDEN = 64, 16
FIGURES = 6
INPUT = 2 * BINS + FIGURES

# Tags of HTML and names that sites give to parts of a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr del label".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select button object math canvas audio video head".split())
LITERAL = frozenset("script style".split())
NEVER = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent notice "
    "notification alert popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget "
    "related recommended share sharing social comment comments reply replies discussion respond footer header "
    "masthead form login signup subscribe newsletter search copyright disclaimer legal pagination pager tags meta".split()
)
ARTICLES = ("article", "main", "div content", "div post", "section entry", "div story body", "main article")
STRANGE = ("div comments", "section comments", "ul comment", "div sidebar", "div cookie notice", "div ad", "div related", "div share", "section newsletter", "div menu", "div promo banner", "header", "header masthead")

TAG = re.compile(r"""<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)(>|(?=<)|$)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>)""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float = 0.0  # part of the text within links
    form: int = -1  # number of the outermost form around it

    @property
    def barred(self) -> bool:
        return any(p.split(" ", 1)[0] in NEVER for p in self.path)


def raw_end(page: str, name: str, at: int) -> int:
    """Where an element ends whose content is no text of the page; -1 if it is not closed. Those of
    one name may stand in each other."""
    depth = 1
    for tag in re.compile(rf"<(/?){name}\b[^>]*?(/?)>", re.I).finditer(page, at):
        if tag[1]:
            depth -= 1
        elif not tag[2] and name not in LITERAL:
            depth += 1
        if not depth:
            return tag.end()
    return -1


def without_wrappers(page: list[Block]) -> list[Block]:
    """The blocks with the forms that hold the page taken out of their paths."""
    names = [[p.split(" ", 1)[0] for p in b.path] for b in page]
    total = sum(len(b.text) for b in page)
    for form in {b.form for b in page} - {-1}:
        inside = [i for i, b in enumerate(page) if b.form == form]
        prose = sum(bool(set(names[i]) & PROSE) for i in inside)
        holds = any(MAIN & set(names[i][names[i].index("form") + 1 :]) for i in inside)
        if holds or (prose > 1 and 2 * sum(len(page[i].text) for i in inside) >= total):
            for i in inside:
                at = names[i].index("form")
                page[i].path = page[i].path[:at] + page[i].path[at + 1 :]
    return page


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[str] = []
    buffer: list[str] = []
    linked = at = links = forms = 0
    unclosed = False  # in an element that ends with the block

    def close() -> None:
        nonlocal linked, unclosed
        if unclosed:
            buffer.clear()
            unclosed = False
        raw = "".join(buffer)
        text = " ".join(html.unescape(raw).split())
        if text:
            path = tuple(p for p in stack if p.split(" ", 1)[0] not in INLINE)
            inside = any(p.split(" ", 1)[0] == "form" for p in path)
            out.append(Block(path, text, min(1.0, linked / len(raw)), forms if inside else -1))
        buffer.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if links:
            linked += len(text)

    n = len(page)
    while at < n:
        tag = TAG.search(page, at)
        if not tag:
            take(page[at:])
            break
        if tag.start() > at:
            take(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[6] or "").lower()
        if not name:
            if tag[0] == "<!--":
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            continue
        ending = (tag[1] or tag[5]) == "/"
        if name in RAW and not ending:
            if name in ("svg", "math") and tag[0].rstrip(">").endswith("/"):
                close()
                continue
            end = raw_end(page, name, at)
            if name == "head" and end < 0:
                continue
            close()
            if end >= 0 or name in LITERAL:
                at = end if end >= 0 else n
            else:
                unclosed = True
            continue
        if name in RAW:
            continue
        if name == "a":
            links = max(0, links - 1) if ending else links + 1
        if name in INLINE:
            continue
        close()
        if name in EMPTY:
            continue
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].split(" ", 1)[0] == name:
                    del stack[i:]
                    break
            if name != "a":
                links = 0
            continue
        if stack and stack[-1].split(" ", 1)[0] in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and name in (
            "p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "blockquote", "pre", "footer", "nav", "aside"
        ) and stack[-1].split(" ", 1)[0] == "p":
            stack.pop()
        elif stack and stack[-1].split(" ", 1)[0] == name and name in ("li", "dt", "dd", "tr", "td", "th"):
            stack.pop()
        if name == "form" and not any(p.split(" ", 1)[0] == "form" for p in stack):
            forms += 1
        more = " ".join(" ".join(WORD.findall((a or b or c).lower())) for a, b, c in NAMED.findall(tag[3] or tag[7] or ""))
        stack.append(f"{name} {more}".strip())
    close()
    return without_wrappers(out)


def foreign(path: tuple[str, ...]) -> bool:
    """Whether a part of the path names something that is not the article."""
    words = [p.split() for p in path]
    return any(w[0] in NEVER or NAMES & set(w[1:]) for w in words)


def prose_labels(page: list[Block]) -> list[int]:
    """Of a page without article or main: 1 for what stands in the innermost element that holds most
    of the page's prose (sentences of some length, not links), under no foreign name."""
    prose: Counter[tuple[str, ...]] = Counter()
    for b in page:
        if len(b.text) >= 60 and re.search(r"[.!?]", b.text) and b.linked < 0.5 and not foreign(b.path):
            for depth in range(len(b.path)):
                prose[b.path[: depth + 1]] += len(b.text)
    if not prose:
        return [0] * len(page)
    most = max(prose.values())
    inner = max((p for p, size in prose.items() if 10 * size >= 6 * most), key=lambda p: (len(p), prose[p]))
    if inner[-1].split(" ", 1)[0] in PROSE and len(inner) > 1:
        inner = inner[:-1]
    return [int(b.path[: len(inner)] == inner and not foreign(b.path[len(inner) :])) for b in page]


def page_labels(page: list[Block]) -> list[int]:
    labels = [weak_label(b) for b in page]
    return labels if any(labels) else prose_labels(page)


def weak_label(block: Block) -> int:
    """1: within article or main and under no foreign name."""
    words = [p.split() for p in block.path]
    inside = [i for i, w in enumerate(words) if w[0] in MAIN]
    if not inside:
        return 0
    return int(not foreign(block.path[inside[0] + 1 :]))


def vectors(page: list[Block]) -> np.ndarray:
    """A row per block: hashed path, hashed words, figures."""
    x = np.zeros((len(page), INPUT), np.float32)
    if not page:
        return x
    for texts, low in (([" ".join(b.path) for b in page], 0), ([b.text for b in page], BINS)):
        for words in hashed_words(pa.array(texts), BY_LETTERS):
            h = mix(words.hashes + U(low))
            key = (words.row + words.first) * BINS + (h % U(BINS)).astype(np.int64)
            sign = 1 - 2 * ((h >> U(33)) & U(1)).astype(np.int64)
            x[:, low : low + BINS] += np.bincount(key, sign, len(page) * BINS).reshape(-1, BINS)
    x[:, BINS : 2 * BINS] /= np.maximum(1, np.linalg.norm(x[:, BINS : 2 * BINS], axis=1, keepdims=True))
    size = np.array([len(b.text) for b in page])
    x[:, -6] = np.log1p(size) / 5
    x[:, -5] = [b.linked for b in page]
    x[:, -4] = np.arange(len(page)) / len(page)
    x[:, -3] = [b.text.count(".") / (1 + len(b.text)) * 20 for b in page]
    x[:, -2] = [len(b.path) / 10 for b in page]
    x[:, -1] = size / max(1, size.sum())
    return x


@dataclass
class Direction:
    w: np.ndarray
    u: np.ndarray
    b: np.ndarray

    def run(self, x: np.ndarray, there: np.ndarray, keep: bool = False):
        """States (steps, pages, hidden) over steps in the given order; padded steps pass on."""
        steps, pages, _ = x.shape
        z = x @ self.w + self.b
        h, c, out, saved = *np.zeros((2, pages, HIDDEN), z.dtype), [], []
        for t in range(steps):
            a = z[t] + h @ self.u
            i, f, o = (sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            s = np.tanh(new_c)
            on = there[t][:, None]
            if keep:
                saved.append((h, c, i, f, o, g, s, on))
            h, c = np.where(on, o * s, h), np.where(on, new_c, c)
            out.append(h)
        return np.array(out), saved

    def back(self, x: np.ndarray, saved: list, slope: np.ndarray) -> list[np.ndarray]:
        dw, du, db = (np.zeros_like(p) for p in (self.w, self.u, self.b))
        dh = dc = np.zeros((x.shape[1], HIDDEN))
        for t in range(len(saved) - 1, -1, -1):
            h, c, i, f, o, g, s, on = saved[t]
            dh = dh + slope[t]
            pass_h, pass_c = np.where(on, 0, dh), np.where(on, 0, dc)
            ds = np.where(on, dh * o * (1 - s * s) + dc, 0)
            da = np.concatenate(
                [ds * g * i * (1 - i), ds * c * f * (1 - f), np.where(on, dh * s, 0) * o * (1 - o), ds * i * (1 - g * g)], axis=1
            )
            dw += x[t].T @ da
            du += h.T @ da
            db += da.sum(0)
            dh, dc = da @ self.u.T + pass_h, ds * f + pass_c
        return [dw, du, db]


@dataclass
class Labeller:
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)

        def direction() -> Direction:
            b = np.zeros(4 * HIDDEN)
            b[HIDDEN : 2 * HIDDEN] = 1
            return Direction(rng.normal(0, 0.15, (INPUT, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), b)

        return Labeller(direction(), direction(), rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1))

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.w, self.forward.u, self.forward.b, self.backward.w, self.backward.u, self.backward.b, self.out, self.bias]

    def states(self, x: np.ndarray, there: np.ndarray, keep: bool = False):
        a, one = self.forward.run(x, there, keep)
        b, two = self.backward.run(x[::-1], there[::-1], keep)
        return np.concatenate([a, b[::-1]], axis=2), one, two

    def label(self, pages: list[np.ndarray], most: int = 4096) -> list[np.ndarray]:
        """Probabilities of the blocks of each page; pages of like length go together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            some = order[-max(1, min(128, most // longest)) :]
            del order[-len(some) :]
            x, there = stacked([pages[i] for i in some])
            p = sigmoid(self.states(x, there)[0] @ self.out + self.bias)
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k]
        return out


def stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, there = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], there[: len(page), k] = page, True
    return x, there


def changed(page: list[Block], strangers: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page under other tag names, with foreign blocks among its own; and the labels."""
    name = tuple(ARTICLES[rng.integers(len(ARTICLES))].split(",")[0:1])
    out, labels = [], []
    for b, y in zip(page, page_labels(page), strict=True):
        path = b.path
        if y and (at := next((i for i, p in enumerate(path) if p.split()[0] in MAIN), -1)) >= 0:
            path = path[:at] + name + path[at + 1 :]
        if strangers and rng.random() < 0.12:
            strange = STRANGE[rng.integers(len(STRANGE))]
            inner = path[: rng.integers(1, len(path) + 1)] if path else ()
            for _ in range(rng.integers(1, 4)):
                f = strangers[rng.integers(len(strangers))]
                out.append(Block((*inner, strange, ("p", "div", "li")[rng.integers(3)]), f.text, f.linked * float(rng.random() < 0.5)))
                labels.append(0)
        out.append(Block(path, b.text, b.linked))
        labels.append(y)
    return out, labels


def train(pages: list[str], seed: int = 0, rounds: int = 6) -> Labeller:
    rng, model = np.random.default_rng(seed), Labeller.new(seed)
    parsed = [p for p in map(blocks, pages) if any(page_labels(p))]
    every = [b for p in parsed for b in p]
    strangers = [Block((), " ".join(b.text.split()[:40]), b.linked) for b in every]
    data = []
    for p in parsed:
        for k in range(3):
            bs, y = changed(p, strangers, rng) if k else (p, page_labels(p))
            low = int(rng.integers(0, max(1, len(bs) - SAMPLE_BLOCKS + 1)))
            data.append((vectors(bs)[low : low + SAMPLE_BLOCKS], np.array(y[low : low + SAMPLE_BLOCKS], float)))
    ps = model.parameters()
    m, v, step = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
    for _ in range(rounds if data else 0):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 32):
            some = [data[i] for i in order[at : at + 32]]
            x, there = stacked([s[0] for s in some])
            y = np.zeros(there.shape)
            for k, s in enumerate(some):
                y[: len(s[1]), k] = s[1]
            h, one, two = model.states(x, there, keep=True)
            error = np.where(there, sigmoid(h @ model.out + model.bias) - y, 0) / there.sum()
            dh = error[:, :, None] * model.out
            slopes = [
                *model.forward.back(x, one, dh[:, :, :HIDDEN]),
                *model.backward.back(x[::-1], two, dh[::-1, :, HIDDEN:]),
                (h * error[:, :, None]).sum((0, 1)),
                np.array([error.sum()]),
            ]
            step += 1
            for i, g in enumerate(slopes):
                g = np.clip(g, -1, 1)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                ps[i] -= 1e-2 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    for d in (model.forward, model.backward):
        d.w, d.u, d.b = (p.astype(np.float32) for p in (d.w, d.u, d.b))
    model.out, model.bias = model.out.astype(np.float32), model.bias.astype(np.float32)
    return model


def _extractor(sent):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Labeller = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                pages = [blocks(x.as_py()) for x in part.column("_html")]
                texts = []
                for page, p in zip(pages, model.label([vectors(b) for b in pages]), strict=True):
                    texts.append(" ".join(b.text for b, q in zip(page, p, strict=True) if q >= 0.5 and not b.barred))
                kept = [c for c in part.schema.names if c != "_html"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"]
                )

    return extract


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: id, url, text and its number of code points."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), whole(html_col).alias("_html"))
    short = rows.filter(F.octet_length("_html").between(1, SAMPLE_BYTES)).withColumn(
        "key", F.xxhash64("id", "url", "_html")
    )
    # Only the smallest hashes go through the driver first, so that no task sends pages in vain.
    least = [r[0] for r in short.select("key").orderBy("key").limit(SAMPLE).collect()]
    sample = short.filter(F.col("key") <= max(least, default=0)).limit(SAMPLE).select("key", "_html")
    model = train([r["_html"] for r in sorted(sample.collect())])  # SAMPLE pages of at most SAMPLE_BYTES
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = spread(rows).mapInArrow(
        _extractor(spark.sparkContext.broadcast(model)), f"id {kinds[0]}, url {kinds[1]}, text string"
    )
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars")
    )
