"""HTML extraction: a recurrent labeller reads a page's blocks in order and keeps the main text.

A page becomes a sequence of blocks, each with the path of tags (and their class and id words) that
lead to it. A block's vector sums embeddings of its hashed path and words with a few measures; a
bidirectional LSTM in numpy, so with the whole page as context, labels every block. The network is
trained here, on pages composed at random from the parts that pages are made of; no page of the
input is needed, and training takes seconds.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import random
import re
import zlib
from functools import cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import hashed_words, map_texts, shared_dir
from tracelake.llm.packed import mapped, put

#: Tags that start and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav "
    "ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Tags whose content is no text of the page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head")
#: A start of one of these ends an open one of those, up to the nearest container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("article aside blockquote body div dl fieldset footer form header main nav ol section table td th ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)>|<[!?][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int  # characters within links


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, character references decoded and white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(w for _, words in stack for w in words), text, linked))
            held = []
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            held.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1] and name in _ENDS:
            if name == "head":  # a title or script inside ends by itself; what a head holds is no text
                end = re.compile(r"</head(?=[\s/>])[^>]*>|<body(?=[\s/>])", re.I).search(page, at)
                at = (end.start() if page[end.start() + 1] != "/" else end.end()) if end else at
            elif m[3][-1:] != "/":
                end = _ENDS[name].search(page, at)
                at = end.end() if end else n
            continue
        if name == "a":
            links = 0 if m[1] else 1
            continue
        if name in ("br", "wbr"):
            held.append(" " if name == "br" else "")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        links = 0
        if name in VOID:
            continue
        # A paragraph ends where any block starts; items end where their next one starts.
        ended = ("p", *CLOSES.get(name, ()))
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            ended += ("h1", "h2", "h3", "h4", "h5", "h6")
        while stack and stack[-1][0] in ended:
            stack.pop()
        if name in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[name]:
                    del stack[k:]
                    break
                if stack[k][0] in _HOLDS and not (name in ("tr", "td", "th") and stack[k][0] in ("td", "th")):
                    break
        words = [name]
        if m[3]:
            for found in _NAMES.finditer(m[3]):
                words += [f".{w}" for w in _PARTS.findall((found[1] or found[2] or found[3] or "").lower())]
        stack.append((name, tuple(words)))
    flush()
    return out


# --- vectors ------------------------------------------------------------------------

PATHS, WORDS, EMBEDDED, MEASURES, HIDDEN = 8192, 2048, 12, 6, 16


class Net(NamedTuple):
    path: np.ndarray  # PATHS x EMBEDDED
    word: np.ndarray
    wx: np.ndarray  # 2 x inputs x 4 HIDDEN, forward and backward
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray  # 2 HIDDEN + 1


class Page(NamedTuple):
    paths: np.ndarray  # hashed path words of all blocks
    path_first: np.ndarray
    words: np.ndarray
    word_first: np.ndarray
    measures: np.ndarray


def vectors(found: list[Block]) -> Page:
    """Hashed path and words of a page's blocks, and measures of each block."""
    paths = [[zlib.crc32(f"{w}/{min(d, 2)}".encode()) % PATHS for d, w in enumerate(reversed(b.path))] or [0] for b in found]
    h, first = hashed_words([b.text for b in found])
    size = np.array([len(b.text) for b in found], np.float32)
    count = np.diff(first)
    marks = np.array([b.text.count(".") + b.text.count(",") for b in found], np.float32)
    at = np.arange(len(found), dtype=np.float32) / max(len(found), 1)
    link = np.array([b.linked for b in found], np.float32) / np.maximum(size, 1)
    # Words are the same in all scripts and cases; without any, a block has one of its own.
    measures = np.stack([np.log1p(size) / 8, np.minimum(link, 1), np.minimum(marks / np.maximum(count, 1), 1), at, (count < 4).astype(np.float32), np.ones(len(found), np.float32)], axis=1)
    return Page(np.concatenate([np.array(p) for p in paths]), np.cumsum([0, *map(len, paths)]), (h % np.uint64(WORDS)).astype(np.int64), first, measures)


def _mean(table: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the rows at each block's places."""
    n = np.diff(first)
    sums = np.zeros((len(n), table.shape[1]), np.float32)
    some = n > 0
    if some.any():
        sums[some] = np.add.reduceat(table[at], first[:-1][some], axis=0)
    return sums / np.maximum(n, 1)[:, None]


def _inputs(net: Net, pages: list[Page]) -> np.ndarray:
    return np.concatenate([np.concatenate([_mean(net.path, p.paths, p.path_first), _mean(net.word, p.words, p.word_first), p.measures], axis=1) for p in pages])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """One direction over x (steps, pages, inputs); masked steps hold the state."""
    steps, n = mask.shape
    h = c = np.zeros((n, HIDDEN), np.float32)
    hs, held = np.empty((steps, n, HIDDEN), np.float32), []
    every = x @ wx + b
    for t in range(steps):
        z = every[t] + h @ wh
        g = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        c_new = f * c + i * u
        tc = np.tanh(c_new)
        m = mask[t][:, None]
        if keep:
            held.append((h, c, i, f, o, u, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
        hs[t] = h
    return hs, held


def _padded(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages, ...) with a mask, and each row's place in it."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x = np.zeros((int(lengths.max(initial=0)), len(lengths), flat.shape[1]), np.float32)
    x[step, page] = flat
    mask = np.arange(len(x))[:, None] < lengths
    return x, mask, (step, page)


def _states(net: Net, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    ahead, held_a = _run(x, mask, net.wx[0], net.wh[0], net.b[0], keep)
    back, held_b = _run(x[::-1], mask[::-1], net.wx[1], net.wh[1], net.b[1], keep)
    return ahead, back[::-1], held_a, held_b


def label(net: Net, pages: list[Page]) -> list[np.ndarray]:
    """Probability that each block is main text, by page."""
    lengths = np.array([len(p.measures) for p in pages])
    if not lengths.sum():
        return [np.zeros(0)] * len(pages)
    x, mask, at = _padded(_inputs(net, pages), lengths)
    ahead, back, _, _ = _states(net, x, mask)
    p = _sigmoid(ahead[at] @ net.out[:HIDDEN] + back[at] @ net.out[HIDDEN : 2 * HIDDEN] + net.out[-1])
    return np.split(p, np.cumsum(lengths)[:-1])


# --- training -------------------------------------------------------------------------


def _back(dh: np.ndarray, x: np.ndarray, held: list, wx: np.ndarray, wh: np.ndarray):
    """Gradients of one direction from those of its states."""
    dwx, dwh, db, dx = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, np.float32), np.empty_like(x)
    carry_h = carry_c = np.zeros_like(dh[0])
    for t in reversed(range(len(held))):
        h, c, i, f, o, u, tc, m = held[t]
        total = dh[t] + carry_h
        g = np.where(m, total, 0)
        dc = np.where(m, carry_c, 0) + g * o * (1 - tc * tc)
        dz = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), g * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        dwx += x[t].T @ dz
        dwh += h.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ wx.T
        carry_h = dz @ wh.T + np.where(m, 0, total)
        carry_c = dc * f + np.where(m, 0, carry_c)
    return dwx, dwh, db, dx


def _spread(shape: tuple, at: np.ndarray, first: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Gradient of a table from those of the means of its rows."""
    n = np.diff(first)
    out = np.zeros(shape, np.float32)
    np.add.at(out, at, np.repeat(d / np.maximum(n, 1)[:, None], n, axis=0))
    return out


def _gradient(net: Net, pages: list[Page], wanted: np.ndarray) -> Net:
    lengths = np.array([len(p.measures) for p in pages])
    x, mask, at = _padded(_inputs(net, pages), lengths)
    ahead, back, held_a, held_b = _states(net, x, mask, keep=True)
    state = np.concatenate([ahead[at], back[at], np.ones((len(wanted), 1), np.float32)], axis=1)
    d = (_sigmoid(state @ net.out) - wanted).astype(np.float32) / len(wanted)
    dh = np.zeros((2, *ahead.shape), np.float32)
    dh[0][at], dh[1][at] = d[:, None] * net.out[:HIDDEN], d[:, None] * net.out[HIDDEN : 2 * HIDDEN]
    wx_a, wh_a, b_a, dx_a = _back(dh[0], x, held_a, net.wx[0], net.wh[0])
    wx_b, wh_b, b_b, dx_b = _back(dh[1][::-1], x[::-1], held_b, net.wx[1], net.wh[1])
    dx = (dx_a + dx_b[::-1])[at]
    first = lambda k: np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[k]) for p in pages]))])
    path = _spread(net.path.shape, np.concatenate([p.paths for p in pages]), first(1), dx[:, :EMBEDDED])
    word = _spread(net.word.shape, np.concatenate([p.words for p in pages]), first(3), dx[:, EMBEDDED : 2 * EMBEDDED])
    return Net(path, word, np.stack([wx_a, wx_b]), np.stack([wh_a, wh_b]), np.stack([b_a, b_b]), state.T @ d)


#: Names of page parts that are not main text, each with words that such parts use.
PARTS = {
    "nav menu navbar navigation topbar breadcrumb breadcrumbs toc": "home about contact products news blog menu shop archive login register",
    "header masthead banner top brand logo": "welcome to the official site search sign in",
    "footer bottom copyright colophon legal": "© copyright all rights reserved privacy policy terms imprint contact",
    "sidebar aside widget rail secondary": "popular recent posts categories tags archives follow us",
    "related recommended more teaser promo": "you may also like read more related stories next",
    "ad ads advert advertisement sponsor sponsored promotion": "buy now sale offer sponsored discount order today",
    "notice cookie consent alert gdpr popup modal overlay warning": "we use cookies accept all settings this site javascript agree",
    "newsletter subscribe signup form search login": "enter your email subscribe name password send submit",
    "share social buttons toolbar tools meta byline": "share tweet facebook print email comments posted by",
    "comments comment reply respond discussion disqus thread feedback": "reply says thanks great post i agree report ago wrote",
}
MAIN = "article main content post entry story text body page".split()
#: Class words that say nothing of what an element is: utilities and layouts.
NOISE = "flex grid row col md lg sm mx px py mt mb text size font bg color wp block group is layout constrained has link style align wide items center gap rounded border inner wrapper container elementor element widget w full max auto".split()
_OWN_TAG = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "newsletter": "form", "search": "form", "related": "aside", "notice": "div", "ad": "div"}


def compose(rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page's blocks and which are main text, from random parts in random order and nesting."""
    syllables = ["".join(rng.choices("aeioubcdfglmnprstvéüñ", k=rng.randint(2, 4))) for _ in range(40)]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", "", "", ",", "."]) for _ in range(n)).capitalize() + rng.choice([".", ".", "", "!"])
    out: list[Block] = []
    wanted: list[int] = []
    root = ["html", "body"][rng.choice([0, 0, 0, 1]) :]
    wrap = [f".{rng.choice(['wrap', 'container', 'site', 'page', 'layout'])}"] if rng.random() < 0.4 else []
    root += ["div", *wrap] if wrap else []
    # Deep pages: wrappers around everything, and elements with many class words.
    deep_page = rng.random() < 0.35
    # Old pages: cells of tables in place of sections.
    cells = rng.random() < 0.1
    noise = lambda: [f".{rng.choice(NOISE)}" for _ in range(rng.randint(0, 7))]
    if deep_page:
        root += [w for _ in range(rng.randint(0, 6)) for w in ("div", *noise())]

    def widened(path: list[str]) -> list[str]:
        """The path below the root with class words at its elements and wrappers between them."""
        wide: list[str] = []
        for w in path:
            if not w.startswith(".") and wide:
                wide += [x for _ in range(rng.choice([0, 0, 1, 2])) for x in ("div", *noise())]
            wide += [w, *noise()]
        return wide

    def add(path: list[str], text: str, linked: bool, main: int) -> None:
        path = [*root, *widened(path[len(root) :])] if deep_page else path
        out.append(Block(tuple(path), text, len(text) if linked else 0))
        wanted.append(main)

    def part(path: list[str], names: str) -> None:
        name = rng.choice(names.split())
        plain = names.split()[0]
        style = rng.random()
        tag = _OWN_TAG.get(plain, rng.choice(["div", "section"])) if style < 0.7 else "div"
        second = [f".{rng.choice(names.split())}"] if rng.random() < 0.25 else []
        own = ["table", "tr", "td", *([f".{name}"] if rng.random() < 0.7 else [])] if cells else [tag] if style < 0.35 and tag != "div" else [tag, f".{name}", *second, *([f".{rng.choice(['box', 'block', 'area', 'list', 'inner'])}"] if rng.random() < 0.3 else [])]
        said = PARTS[names].split()
        own_words = rng.random() < 0.5  # some parts hold prose like any other
        for _ in range(rng.randint(1, 7)):
            inner = rng.choice([[], ["ul", "li"], ["p"], ["div"], ["h3"], ["ul", "li"], ["span"], ["p"], ["label"], ["li"], ["h2"], ["h4"], ["h1"] if plain in ("header", "nav") else ["h2"]])
            n = rng.choice([1, 1, 2, 3, 5, 8, 15, 40])
            text = " ".join(rng.choice(said) for _ in range(min(n, 8))) if own_words and rng.random() < 0.8 else prose(n)
            add([*path, *own, *[t for t in inner if t != "span"]], text, plain in ("nav", "related", "sidebar") and rng.random() < 0.8, 0)

    def main(path: list[str]) -> None:
        form = rng.random()
        own = ["table", "tr", "td", *([f".{rng.choice(MAIN)}"] if form < 0.7 else [])] if cells else ["article"] if form < 0.4 else ["article", f".{rng.choice(MAIN)}"] if form < 0.5 else ["main"] if form < 0.6 else ["main", "article"] if form < 0.65 else ["div", f".{rng.choice(MAIN)}"] if form < 0.9 else []
        if rng.random() < 0.8:
            add([*path, *own, *(["header"] if own and rng.random() < 0.1 else []), rng.choice(["h1", "h1", "h1", "h2"])], prose(rng.randint(1, 10)), False, 1)
        deep = [*own, *rng.choice([[], [], [], [], ["section"], ["div"]])]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = rng.random()
            if kind < 0.8:
                add([*path, *deep, "p"], prose(rng.choice([1, 1, 2, 4, 10, 30, 60, 120])), rng.random() < 0.02, 1)
            elif kind < 0.86:
                add([*path, *deep, rng.choice(["h2", "h3", "h4"])], prose(rng.randint(1, 6)), False, 1)
            elif kind < 0.95:
                for _ in range(rng.randint(1, 5)):
                    add([*path, *deep, rng.choice(["ul", "ol"]), "li"], prose(rng.choice([1, 3, 8, 20])), rng.random() < 0.05, 1)
            else:
                add([*path, *own, *rng.choice([["blockquote"], ["blockquote", "p"], ["pre"], ["table", "tr", "td"], ["figure", "figcaption"], ["div"], ["section", "p"]])], prose(rng.choice([3, 10, 30])), False, 1)
            if rng.random() < 0.08:  # what stands in an article without being of it
                part([*path, *own], rng.choice([*PARTS][3:]))

    for _ in range(rng.randint(0, 4)):
        part(root, rng.choice([*PARTS][:9]))
    if rng.random() < 0.97:
        main(root)
    for _ in range(rng.randint(0, 4)):
        part(root, rng.choice([*PARTS][2:]))
    return (out, wanted) if out else compose(rng)


@cache
def trained(seed: int = 1, pages: int = 2600, epochs: int = 5, batch: int = 25) -> Net:
    """A network trained on composed pages with Adam; the same for the same arguments."""
    rng = random.Random(seed)
    gen = np.random.default_rng(seed)
    made = [compose(rng) for _ in range(pages)]
    data = [(vectors(b), np.array(w, np.float32)) for b, w in made]
    inputs = 2 * EMBEDDED + MEASURES
    draw = lambda *shape, scale: (gen.standard_normal(shape) * scale).astype(np.float32)
    b = np.zeros((2, 4 * HIDDEN), np.float32)
    b[:, HIDDEN : 2 * HIDDEN] = 1
    net = Net(draw(PATHS, EMBEDDED, scale=0.02), draw(WORDS, EMBEDDED, scale=0.02), draw(2, inputs, 4 * HIDDEN, scale=inputs**-0.5), draw(2, HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), b, draw(2 * HIDDEN + 1, scale=0.2))
    one, two, k = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for epoch in range(epochs):
        rng.shuffle(data)
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for at in range(0, pages, batch):
            part = data[at : at + batch]
            grads = _gradient(net, [p for p, _ in part], np.concatenate([w for _, w in part]))
            k += 1
            for w, g, m, v in zip(net, grads, one, two):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return net


def network(spark: SparkSession, **options: int) -> Net:
    """trained(), kept in the shared folder by its arguments and this code, so that another driver reads it."""
    code = hashlib.sha256(Path(__file__).read_bytes() + repr(sorted(options.items())).encode()).hexdigest()[:16]
    folder, name = shared_dir(spark), f"html-net-{code}"
    try:
        flat = mapped(folder, name).view("<f4")
    except FileNotFoundError:
        net = trained(**options)
        put(folder, name, np.concatenate([w.ravel() for w in net]).astype("<f4").tobytes())
        return net
    inputs = 2 * EMBEDDED + MEASURES
    shapes = ((PATHS, EMBEDDED), (WORDS, EMBEDDED), (2, inputs, 4 * HIDDEN), (2, HIDDEN, 4 * HIDDEN), (2, 4 * HIDDEN), (2 * HIDDEN + 1,))
    ends = np.cumsum([math.prod(x) for x in shapes])
    return Net(*(w.reshape(x) for w, x in zip(np.split(flat, ends[:-1]), shapes)))


# --- pages ------------------------------------------------------------------------------


def main_texts(net: Net, pages: list[str], threshold: float = 0.5) -> list[str]:
    """Main text of each page: its blocks that are labelled so, joined by an empty line."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    # Pages of like length go together, about so many blocks at once.
    order = sorted(range(len(pages)), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 512 and len(found[order[end]]) * (end + 1 - at) <= 20_000:
            end += 1
        some = [k for k in order[at:end] if found[k]]
        for k, p in zip(some, label(net, [vectors(found[k]) for k in some]) if some else []):
            out[k] = "\n\n".join(b.text for b, keep in zip(found[k], p >= threshold) if keep)
        at = end
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row. A null or empty page, and one without main text, gives ''; repeated rows get equal results; extra columns are left out; an empty table gives an empty one."""
    net = network(pages.sparkSession)

    def work(ids: list, texts: list) -> dict:
        got = main_texts(net, texts)
        return {"doc_id": [i["p"] for i in ids], "url": [i["u"] for i in ids], "text": got, "n_chars": list(map(len, got))}

    keyed = pages.select(F.struct(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u")).alias("doc_id"), F.col(html).alias("text"))
    return map_texts(keyed, work, "doc_id long, url string, text string, n_chars long").withColumnRenamed("doc_id", "page_id")

