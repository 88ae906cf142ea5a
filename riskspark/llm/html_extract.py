"""Main-text extraction with a recurrent block labeller.

A page is read into leaf blocks: the text between two block-level tags, with the path of open
elements (their tags, and the words of their class, id and role). A bidirectional LSTM in numpy
reads the page's whole sequence of blocks; each block enters as the mean vector of its hashed path tokens, the
mean vector of its hashed words, and its length, link share, depth and place. Every block gets a
probability from the states of both directions, so a block is judged in its document's context.

Training labels come from the pages themselves: on pages that mark their main container by name
(``MAIN``), blocks inside it and outside the named side parts (``SIDE``) are main text. Each
training page is also read in other dress: its containers get other names of their kind, and side
blocks with running text (comments, notices, sidebars) are put between, so that the labeller learns
the names of layouts that its sample doesn't show. And it is read bare: every name is a made-up one and the
containers are plain ones, so that text, links, lengths and neighbours must decide. The sample has at most ``TRAIN_PAGES`` pages
(the smallest hashes of the page id), in one task. Extraction is one narrow pass over whole pages.

Defined cases: NULL or empty html gives the empty text; an unclosed script, style, textarea, title or comment
reaches to the page's end; the other dropped elements go with their content only if they have a closing tag of
their own, else only the tag goes; head is no element of its own, as all that may stand in it is dropped
anyway; wrong nesting never fails; a page of any number of blocks is read whole, with memory in proportion to
its blocks (pages are labelled together up to ``CELLS`` places, longer ones alone); repeated rows and rows of
equal or NULL id are extracted one by one, and columns other than the ids and html are ignored; an empty table
gives no rows; without a training page that names its main container, the labeller trains on the built-in
layouts alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import groups_of, map_rows, pa_schema

TRAIN_PAGES = 300
BUCKETS, EMBED, HIDDEN, SCALARS = 4096, 12, 12, 4
EPOCHS, MINIBATCH, RATE = 6, 16, 0.01
FEWEST_EXAMPLES = 400  # small samples are dressed more often
CELLS, CHARS_AT_ONCE = 1 << 14, 1 << 21  # places (longest page x pages) labelled together, characters read together

#: Names of containers (tags, or words of class, id and role), by kind; fixed values.
MAIN = ("article", "main", "content", "post", "entry", "story", "articlebody")
SIDE = (
    "nav", "menu", "navbar", "header", "masthead", "footer", "aside", "sidebar", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored",
    "cookie", "consent", "notice", "alert", "popup", "modal", "form", "login", "newsletter", "subscribe", "search", "share", "social", "related", "breadcrumb",
    "comments", "comment", "replies", "discussion", "copyright", "widget", "toolbar",
)
SIDE_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "label", "legend", "option")
CONTAINERS = ("nav", "header", "footer", "aside", "menu", "dialog")  # of these, those that only group
#: Elements whose content is never text of the page: those up to the next closing tag, or without one up to the
#: page's end, and those that nest and need a closing tag; fixed values.
RAW = "script|style|textarea|title"
DROPPED = "template|noscript|iframe|svg|math|object"
FOREIGN = ("svg", "math")  # "/>" closes these and what is in them
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label".split()
)
DROPPED_TAGS = frozenset(DROPPED.split("|"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag ends an open element of these; fixed values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

ATTRS = r"[^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?=[\s>/])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRS})>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
HIDING = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?=[\s>/])[^>]*>|<(?P<end>/?)(?P<tag>{DROPPED})(?=[\s>/]){ATTRS}>", re.S | re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
OPENED = re.compile(r"<[a-zA-Z/!?]")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")

Block = tuple[tuple[str, ...], str, float]  # path tokens, text, share of its characters inside links


def named_words(attrs: str) -> tuple[str, ...]:
    return tuple("." + w for m in NAMES.finditer(attrs) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower()))


def dropped_spans(page: str) -> dict[int, int]:
    """Start and stop of every ``DROPPED`` element with a closing tag; nested ones of a name are counted."""
    opened: dict[str, list[int]] = {tag: [] for tag in DROPPED.split("|")}
    spans: dict[int, int] = {}
    at = 0
    while m := HIDING.search(page, at):
        at = m.end()
        foreign = any(opened[tag] for tag in FOREIGN)
        if m["raw"]:
            if not foreign:
                closing = RAW_END[m["raw"].lower()].search(page, at)
                at = closing.end() if closing else len(page)
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                if opened[tag]:
                    spans[opened[tag].pop()] = at
            elif not ((foreign or tag in FOREIGN) and m[0].endswith("/>")):
                opened[tag].append(m.start())
    return spans


def tokens(page: str) -> Iterator[re.Match | None]:
    """Matches of ``TOKEN``; None for a ``DROPPED`` element with its content."""
    spans: dict[int, int] | None = None
    at: int | None = 0
    while at is not None:
        first, at = at, None
        for m in TOKEN.finditer(page, first):
            if m["tag"] and not m["end"] and m["tag"].lower() in DROPPED_TAGS:
                spans = dropped_spans(page) if spans is None else spans
                at = spans.get(m.start())
                if at is not None:
                    yield None
                    break
            yield m


def read_blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order, with decoded, trimmed, single-spaced texts."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(unescape(raw).split())
            if text:
                path = tuple(t for _, tokens in stack if _ in BLOCK for t in tokens)
                blocks.append((path, text, min(1.0, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    page, last, tail = (html or "").rpartition(">")
    for m in tokens(page + last + OPENED.split(tail, maxsplit=1)[0]):  # a tag that the page's end cuts off is no text
        if m is None:
            parts.append(" ")
            continue
        text = m["text"]
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                    in_link = 0
            elif tag == "a":
                in_link = 0
            continue
        if tag not in BLOCK:
            if tag == "br":
                parts.append(" ")
            in_link = in_link or tag == "a"
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        ends = ("p", *CLOSES.get(tag, ()))
        while stack and stack[-1][0] in ends:
            stack.pop()
        stack.append((tag, (tag, *named_words(m["attrs"]))))
    flush()
    return blocks


def kind_of(token: str) -> str:
    word = token.lstrip(".")
    if token in SIDE_TAGS or token[0] == "." and word in SIDE:
        return "side"
    return "main" if word in MAIN and (token[0] == "." or word in ("article", "main")) else ""


def silver(path: tuple[str, ...]) -> int:
    kinds = [kind_of(t) for t in path]
    return int("main" in kinds and "side" not in kinds)


def dressed(blocks: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page with other container names of the same kinds, and side blocks with running text."""
    renamed: dict[str, tuple[str, ...]] = {}

    def pick(names: tuple[str, ...], tag: str) -> tuple[str, ...]:
        return (tag, "." + names[rng.integers(len(names))])

    def rename(token: str) -> tuple[str, ...]:
        kind = kind_of(token)
        if not kind:
            return (token,)
        if token not in renamed:
            tag = ("div", "section", "div")[rng.integers(3)]
            if kind == "main":
                renamed[token] = (token,) if rng.random() < 0.4 else pick(MAIN, tag)
            else:
                renamed[token] = (SIDE_TAGS[rng.integers(5)],) if rng.random() < 0.3 else pick(SIDE, tag)
        return renamed[token]

    texts = [t for p, t, _ in blocks if silver(p)] or ["word"]
    out: list[tuple[Block, int]] = []
    for path, text, links in blocks:
        out.append(((tuple(t for token in path for t in rename(token)), text, links), silver(path)))
    for _ in range(rng.integers(2, 6)):
        at = rng.integers(len(out) + 1)
        tag = ("div", "section", "ul")[rng.integers(3)]
        named = (SIDE_TAGS[rng.integers(len(SIDE_TAGS))],) if rng.random() < 0.4 else pick(SIDE, tag)
        path = ("html", "body", *(out[at - 1][0][0][2:-1] if at and rng.random() < 0.5 else ()), *named, ("p", "div", "li")[rng.integers(3)])
        added = [((path, texts[rng.integers(len(texts))], float(rng.random() < 0.2)), 0) for _ in range(rng.integers(1, 5))]
        out[at:at] = added
    return [b for b, _ in out], [y for _, y in out]


def bare(blocks: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page without names: words of class, id and role are made up, and tags that tell a container's kind are plain ones."""
    made: dict[str, str] = {}

    def other(token: str) -> str:
        if token not in made:
            if token[0] == ".":
                made[token] = f".x{rng.integers(1 << 30)}"
            elif token in MAIN or token in CONTAINERS:
                made[token] = ("div", "section", "div")[rng.integers(3)]
            else:
                made[token] = token
        return made[token]

    return [(tuple(map(other, path)), text, links) for path, text, links in blocks], [silver(path) for path, _, _ in blocks]


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


class Labeller:
    """Bidirectional LSTM over block sequences; all parameters in one dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        size = 2 * EMBED + SCALARS

        def normal(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = params or {
            "path": rng.normal(0, 0.3, (BUCKETS, EMBED)), "word": rng.normal(0, 0.3, (BUCKETS, EMBED)),
            "xf": normal(size, 4 * HIDDEN), "hf": normal(HIDDEN, 4 * HIDDEN), "bf": np.repeat([0, 1.0, 0, 0], HIDDEN),
            "xb": normal(size, 4 * HIDDEN), "hb": normal(HIDDEN, 4 * HIDDEN), "bb": np.repeat([0, 1.0, 0, 0], HIDDEN),
            "out": normal(2 * HIDDEN, 1), "bias": np.zeros(1),
        }
        self.paths: dict[tuple[str, ...], list[int]] = {}
        self.words: dict[str, int] = {}

    def features(self, pages: list[list[Block]]) -> dict[str, np.ndarray]:
        """Hashed tokens of all blocks one after the other, with scalars and each block's place."""
        if len(self.words) > 1 << 18:
            self.words.clear()
        if len(self.paths) > 1 << 14:
            self.paths.clear()
        path_ids, path_n, word_ids, word_n, scalars = [], [], [], [], []
        words = self.words
        for blocks in pages:
            for i, (path, text, links) in enumerate(blocks):
                ids = self.paths.get(path)
                if ids is None:
                    ids = self.paths[path] = [bucket(t) for t in path] or [bucket("")]
                path_ids += ids
                path_n.append(len(ids))
                split = text.lower().split()
                got = list(map(words.get, split))
                if None in got:
                    for w in split:
                        if w not in words:
                            words[w] = bucket(w)
                    got = [words[w] for w in split]
                word_ids += got
                word_n.append(len(got))
                scalars.append((np.log1p(len(split)) / 5, links, len(path) / 10, i / len(blocks)))
        page = np.repeat(np.arange(len(pages)), [len(b) for b in pages])
        step = np.concatenate([np.arange(len(b)) for b in pages]) if pages else page
        return {"path_ids": np.array(path_ids, np.int64), "path_n": np.array(path_n), "word_ids": np.array(word_ids, np.int64), "word_n": np.array(word_n), "scalars": np.array(scalars).reshape(-1, SCALARS), "page": page, "step": step}

    def inputs(self, f: dict[str, np.ndarray]) -> np.ndarray:
        means = []
        for kind in ("path", "word"):
            starts = np.cumsum(np.r_[0, f[f"{kind}_n"][:-1]])
            means.append(np.add.reduceat(self.p[kind][f[f"{kind}_ids"]], starts) / f[f"{kind}_n"][:, None])
        return np.hstack([*means, f["scalars"]])

    def run(self, x: np.ndarray, mask: np.ndarray, way: str, traced: bool = True) -> tuple[np.ndarray, list]:
        """States (steps, pages, HIDDEN) of one direction; padded steps keep the state. The trace for the gradients is kept only if asked for."""
        steps, n = mask.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        given = x @ self.p["x" + way] + self.p["b" + way]
        states, trace = np.zeros((steps, n, HIDDEN)), [None] * steps
        for t in range(steps) if way == "f" else reversed(range(steps)):
            z = given[t] + h @ self.p["h" + way]
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in (0, 1, 3))
            g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if traced:
                trace[t] = (i, f, g, o, c, h, squashed, m)
            c = m * new + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            states[t] = h
        return states, trace

    def back(self, grad: np.ndarray, trace: list, x: np.ndarray, way: str, grads: dict) -> np.ndarray:
        """Gradients through one direction; returns those of its inputs."""
        steps = len(trace)
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dz_all = np.zeros((steps, grad.shape[1], 4 * HIDDEN))
        gh = np.zeros_like(self.p["h" + way])
        for t in reversed(range(steps)) if way == "f" else range(steps):
            i, f, g, o, c, h, squashed, m = trace[t]
            dh = dh + grad[t]
            dnew = m * (dc + dh * o * (1 - squashed**2))
            dz = np.hstack([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dnew * i * (1 - g**2), m * dh * squashed * o * (1 - o)])
            dz_all[t] = dz
            gh += h.T @ dz
            dh = (1 - m) * dh + dz @ self.p["h" + way].T
            dc = (1 - m) * dc + dnew * f
        grads["x" + way] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        grads["h" + way], grads["b" + way] = gh, dz_all.sum(axis=(0, 1))
        return dz_all @ self.p["x" + way].T

    def forward(self, f: dict[str, np.ndarray], pages: int, traced: bool = True) -> tuple:
        flat = self.inputs(f)
        steps = int(f["step"].max()) + 1
        x, mask = np.zeros((steps, pages, flat.shape[1])), np.zeros((steps, pages))
        x[f["step"], f["page"]] = flat
        mask[f["step"], f["page"]] = 1
        hf, tf = self.run(x, mask, "f", traced)
        hb, tb = self.run(x, mask, "b", traced)
        both = np.concatenate([hf, hb], axis=2)[f["step"], f["page"]]
        chance = 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"])[:, 0]))
        return chance, both, x, tf, tb

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
        out = [np.zeros(0)] * len(pages)
        some: list[int] = []
        for at, k in enumerate(order):
            some.append(k)
            if at + 1 < len(order) and len(pages[order[at + 1]]) * (len(some) + 1) <= CELLS:
                continue
            chance = self.forward(self.features([pages[j] for j in some]), len(some), traced=False)[0]
            for j, part in zip(some, np.split(chance, np.cumsum([len(pages[j]) for j in some])[:-1])):
                out[j] = part
            some = []
        return out

    def fit(self, pages: list[tuple[list[Block], list[int]]], seed: int = 3) -> None:
        """Adam on the cross-entropy of all blocks."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        count = 0
        for _ in range(EPOCHS):
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda k: len(pages[k][0]) // 8)
            starts = list(range(0, len(order), MINIBATCH))
            for a in rng.permutation(starts).tolist():
                some = order[a : a + MINIBATCH]
                f = self.features([pages[k][0] for k in some])
                y = np.concatenate([pages[k][1] for k in some]).astype(float)
                chance, both, x, tf, tb = self.forward(f, len(some))
                dlogit = ((chance - y) / len(y))[:, None]
                grads = {"out": both.T @ dlogit, "bias": dlogit.sum(axis=0)}
                dstate = np.zeros((*x.shape[:2], 2 * HIDDEN))
                dstate[f["step"], f["page"]] = dlogit @ self.p["out"].T
                dx = self.back(dstate[:, :, :HIDDEN], tf, x, "f", grads) + self.back(dstate[:, :, HIDDEN:], tb, x, "b", grads)
                dflat = dx[f["step"], f["page"]]
                for j, kind in enumerate(("path", "word")):
                    n = f[f"{kind}_n"]
                    grads[kind] = np.zeros_like(self.p[kind])
                    np.add.at(grads[kind], f[f"{kind}_ids"], np.repeat(dflat[:, j * EMBED : (j + 1) * EMBED] / n[:, None], n, axis=0))
                count += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= RATE * (first[k] / (1 - 0.9**count)) / (np.sqrt(second[k] / (1 - 0.999**count)) + 1e-8)


#: A page in the built-in layout, for samples that name no main container.
PLAIN = "<body><nav><ul><li><a href='/'>home</a></ul></nav><main><h1>title</h1><p>first words of a text.<p>more words, and more.</main><footer>copyright</footer>"


def train(pages: list[str | None], seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    read = [b for b in map(read_blocks, pages) if any(silver(p) for p, _, _ in b)] or [read_blocks(PLAIN)] * 100
    examples = []
    for blocks in read:
        examples.append((blocks, [silver(p) for p, _, _ in blocks]))
        times = max(2, -(-FEWEST_EXAMPLES // len(read)))
        examples += [dressed(blocks, rng) for _ in range(times)] + [bare(blocks, rng) for _ in range(times // 2)]
    labeller = Labeller()
    labeller.fit(examples)
    return labeller.p


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, np.ndarray]:
    """Fit on the ``TRAIN_PAGES`` pages with the smallest hash of their id."""
    draw = F.xxhash64("id")
    ids = pages.select(F.col(id_col).alias("id")).where("id is not null").orderBy(draw, "id").limit(TRAIN_PAGES)
    texts = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    # the sample is bounded: its ids may be broadcast, and one task holds its pages
    sample = texts.join(F.broadcast(ids.distinct()), "id").repartition(1).sortWithinPartitions(draw, "id", "html")
    ddl = "name string, rows int, value binary"
    schema = pa_schema(pages.sparkSession, ddl)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        html = [h for b in batches for h in b.column(0).to_pylist()]
        for name, v in train(html).items():
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [len(v)], "value": [v.astype("<f4").tobytes()]}, schema=schema)

    got = sample.select("html").mapInArrow(fit, ddl).collect()
    if not got:
        return train([])
    return {r["name"]: np.frombuffer(r["value"], "<f4").reshape((r["rows"],) if r["name"] in ("bf", "bb", "bias") else (r["rows"], -1)).astype(float) for r in got}


def main_text(blocks: list[Block], chance: np.ndarray) -> str:
    return "\n".join(text for (_, text, _), c in zip(blocks, chance.tolist()) if c >= 0.5)


def extract(pages: DataFrame, params: dict[str, np.ndarray], id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``id_cols`` and the main ``text`` of every page."""
    labellers: list[Labeller] = []

    def batch(cols: dict[str, list]) -> dict[str, list]:
        if not labellers:
            labellers.append(Labeller(params))
        html, texts = cols["html"], []
        for i, j in groups_of(html, len(html), CHARS_AT_ONCE):
            blocks = [read_blocks(h) for h in html[i:j]]
            texts += map(main_text, blocks, labellers[0].probabilities(blocks))
        return {**{f"id{k}": cols[f"id{k}"] for k in range(len(id_cols))}, "text": texts}

    kinds = [pages.schema[c].dataType.simpleString() for c in id_cols]
    picked = pages.select(*(F.col(c).alias(f"id{k}") for k, c in enumerate(id_cols)), F.col(html_col).cast("string").alias("html"))
    found = map_rows(picked, batch, ", ".join([*(f"id{k} {t}" for k, t in enumerate(kinds)), "text string"]))
    return found.withColumnsRenamed({f"id{k}": c for k, c in enumerate(id_cols)})
