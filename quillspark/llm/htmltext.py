"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with the path of open
elements. A block becomes a vector of its hashed path (tags, and words of class, id and
role), its hashed words and a few numbers, and a bidirectional LSTM in numpy reads the
page's blocks forwards and backwards, so each is labelled in view of the whole document.
Blocks labelled as main text are joined in page order.

Training: no table says which blocks are main text. ``PAGES`` pages are made up from many
layouts, and of these it is known which blocks were put in as main text, whatever their
names: in ``NAMELESS`` of the pages no class or id tells anything, so paths, links, words
and places must. They are joined by the ``SAMPLE`` pages of the table with the least hash of
page_id (a bound that holds the driver's share constant), labelled by their elements and
structural names. Every page is then labelled in full.

A page is read once, from front to back, whatever is in it: a tag or comment that never
ends is text or nothing, and paths share their parts, so time and memory follow the page's
length. Elements more than ``DEPTH`` deep take part in no path.

Cases: null, empty or tagless html is no block or one; scripts, styles, comments and
templates are never text; unclosed and stray tags are tolerated; very long pages are read
whole; a page without main blocks has text ''; a block at the cut is not main text; rows
that repeat a page_id are extracted each (and learned from once, by their least html); an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PATH, WORDS, NUMBERS, HIDDEN = 128, 24, 5, 16
INPUT = PATH + WORDS + NUMBERS
PAGES, SAMPLE, EPOCHS, BATCH, SEED = 1200, 160, 8, 32, 11
#: Share of made-up pages without telling names; deepest element that a path has; blocks of a page that are labelled together; what main text bears on made-up pages.
NAMELESS, DEPTH, LONG, MARK = 0.25, 64, 2048, "\ue000"

#: How a tag or comment begins; a tag of a name alone ends there, too.
_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)(>)?|[!?/])")
#: What ends a tag, or a quoted value in it.
_TAG_END = re.compile(r"[>\"']")
#: Elements whose content is never text.
RAW = set("script style noscript template iframe svg textarea".split())
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements without content, and those that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html head title body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Names of elements, classes, ids and roles that hold main text, and of those that don't.
MAIN = "article main content entry post story body text page".split()
ASIDE = (
    "head title nav menu header masthead banner footer foot aside sidebar side widget ad ads advert advertisement adverts promo sponsor sponsored notice notices cookie consent gdpr alert popup modal overlay newsletter subscribe signup login register form "
    "search share sharing social related recommended more comments comment reply replies respond discussion disqus tags pagination pager breadcrumb breadcrumbs skip legal copyright toolbar button select option label fieldset navigation complementary contentinfo dialog"
).split()
_ASIDE = frozenset(ASIDE)


class Path:
    """An open element: its tag, the element around it, the nearest block element around it if it is none itself, and the names on the way from the top.

    None refers to itself, so that a page's elements are given up with the page, not by the garbage collector.
    """

    __slots__ = ("around", "depth", "link", "names", "tag", "within")

    def __init__(self, tag: str = "", names: tuple[str, ...] = (), around: Path | None = None):
        self.tag, self.around = tag, around
        self.depth = around.depth + 1 if around else 0
        self.link = bool(around) and (around.link or tag == "a")
        self.within = None if tag in BLOCKS or around is None else around.block
        self.names: frozenset[str] = around.names if around else frozenset()
        if self.depth <= DEPTH and not self.names.issuperset(names):
            self.names = self.names.union(names)

    @property
    def block(self) -> Path:
        return self.within or self


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in page order: text, open or close.

    A search starts where the last one ended, and what was once sought to the end of the page
    in vain is not sought again, so the page is gone over once for each kind of end.
    """
    at, n, never = 0, len(page), set()

    def find(what: str, start: int) -> int:
        """The place, or -1: remembered, as what is not ahead of one place is not ahead of later ones."""
        if what in never:
            return -1
        k = page.find(what, start)
        if k < 0:
            never.add(what)
        return k

    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        if m[0] == "<!--":
            k = find("-->", m.end())
            at = n if k < 0 else k + 3
            continue
        if m[2] is None:
            k = find(">", m.end())
            if k < 0:
                yield "text", "", page[m.start() : m.end()]
                at = m.end()
            else:
                at = k + 1
            continue
        # the tag ends at the first > outside quotes; a quote without an end is an ordinary character
        at, end = m.end(), m.start(3)
        after = at if end < 0 else end
        while end < 0 and "quotes" not in never:
            k = _TAG_END.search(page, at)
            if k is None:
                never.add("quotes")
            elif k[0] == ">":
                end = k.start()
            else:
                q = find(k[0], k.end())
                at = k.end() if q < 0 else q + 1
        if end < 0:  # quotes don't match, so they count for nothing from here on
            end = find(">", after)
        if end < 0:
            yield "text", "", page[m.start() : m.end()]
            at = m.end()
            continue
        name, rest = m[2].lower(), page[after:end]
        at = end + 1
        if m[1]:
            yield "close", name, ""
            continue
        if name in RAW:
            if not rest.endswith("/"):
                at = _raw_end(page, name, at, never)
            continue
        yield "open", name, rest


def _raw_end(page: str, name: str, at: int, never: set[str]) -> int:
    """Where the content of a script or the like is over: after its end tag, or with the page."""
    if f"</{name}" in never:
        return len(page)
    m = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    if m is None:
        never.add(f"</{name}")
        return len(page)
    return m.end()


def blocks(page: str | None) -> list[tuple[Path, str, int, int]]:
    """(path, text, linked characters, all characters) of each leaf block with text, in page order."""
    out: list[tuple[Path, str, int, int]] = []
    buf: list[str] = []
    links, top = [0, 0], Path()
    opened: dict[str, list[Path]] = {}  # of each tag, outer ones first

    def flush() -> None:
        if buf:
            t = " ".join(html.unescape("".join(buf)).split())
            if t:
                out.append((top, t, links[0], max(links[1], 1)))
            buf.clear()
            links[:] = [0, 0]

    def leave(to: Path) -> Path:
        """What is around ``to``, once it and all that is in it are closed."""
        at = top
        while True:
            opened[at.tag].pop()
            if at is to:
                return at.around
            at = at.around

    for kind, tag, rest in tokens(page or ""):
        if kind == "text":
            buf.append(rest)
            links[1] += len(rest)
            if top.link:
                links[0] += len(rest)
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if kind == "close":
            # an inline element ends within its block only
            if opened.get(tag) and (tag in BLOCKS or opened[tag][-1].block is top.block):
                top = leave(opened[tag][-1])
            continue
        if tag in VOID or rest.endswith("/"):
            continue
        near = top.block
        if tag in BLOCKS and (near.tag == "p" or near.tag == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option")):
            top = leave(near)
        names = [tag]
        if "=" in rest:
            for a in _ATTR.findall(rest):
                names += _NAME.findall("".join(a).lower())
        top = Path(tag, tuple(names), top)
        opened.setdefault(tag, []).append(top)
    flush()
    return out


class _Slots(dict):
    """Twice a word's place among WORDS, plus one if it counts as 1; begun anew after ``KNOWN`` words, so that memory is bounded."""

    KNOWN = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.KNOWN:
            self.clear()
        h = crc32(word.encode("utf-8", "replace"))
        slot = self[word] = h % WORDS * 2 + (h >> 16 & 1)
        return slot


_SLOTS = _Slots()


@lru_cache(maxsize=20_000)
def _names_vector(names: frozenset[str]) -> np.ndarray:
    v = np.zeros(PATH, dtype=np.float32)
    for name in names:
        for salt in "ab":
            h = crc32((salt + name).encode("utf-8", "replace"))
            v[h % PATH] += 1.0 if h >> 16 & 1 else -1.0
    return v


def vectors(found: list, at: int = 0, to: int | None = None) -> np.ndarray:
    """The input of the network: a row for each block of a page, or of those from ``at`` on."""
    some = found[at:to]
    x = np.zeros((len(some), INPUT), dtype=np.float32)
    if not some:
        return x
    slots, lengths = bytearray(), []
    for i, (path, t, _, _) in enumerate(some):
        x[i, :PATH] = _names_vector(path.names)
        w = t.split()
        slots += bytes(map(_SLOTS.__getitem__, w))
        lengths.append(len(w))
    n = np.array(lengths)
    # a block's words are counted by place and sign, in whole numbers, for all blocks at once
    rows = np.repeat(np.arange(len(some)) * (2 * WORDS), n)
    counts = np.bincount(rows + np.frombuffer(slots, np.uint8), minlength=len(some) * 2 * WORDS).reshape(-1, WORDS, 2)
    x[:, PATH : PATH + WORDS] = counts[:, :, 1] - counts[:, :, 0]
    x[:, PATH : PATH + WORDS] /= (4 * n**0.5).astype(np.float32)[:, None]
    linked, chars, size, stops = np.array([(linked, chars, len(t), t.count(".")) for _, t, linked, chars in some]).T
    x[:, PATH + WORDS :] = np.stack([np.log1p(n) / 5, linked / chars, size / n / 20, stops / n, (at + np.arange(len(some))) / len(found)], axis=1)
    return x


def teach(found: list) -> np.ndarray:
    """For a table's page: 1 for blocks that elements and structural names mark as main text."""
    within = next((n for n in ("article", "main") if any(n in p.names for p, *_ in found)), None)
    return np.array([float((within is None or within in p.names) and not _ASIDE.intersection(p.names)) for p, *_ in found])


def known(page: str) -> tuple[list, np.ndarray]:
    """For a made-up page: its blocks, and 1 for those put in as main text, which bear MARK."""
    found = blocks(page)
    y = np.array([float(MARK in t) for _, t, *_ in found])
    return [(p, t.replace(MARK, ""), a, b) for p, t, a, b in found], y


class BiLstm:
    """One bidirectional layer; the label of a block is linear in both states and the block's own vector."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"o": np.zeros(2 * HIDDEN + INPUT + 1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": g(INPUT, 4 * HIDDEN), f"u{d}": g(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """States (batch, time, HIDDEN), and what the last step leaves; a masked step leaves the state as it was."""
        b, t, _ = x.shape
        h, c = state or (np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32))
        out = np.zeros((b, t, HIDDEN), np.float32)
        pre = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + h @ self.p[f"u{d}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if tape is not None:
                tape.append((k, h, c, i, f, o, g, tc, m))
            c = m * c2 + (1 - m) * c
            h = m * o * tc + (1 - m) * h
            out[:, k] = h
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        o = self.p["o"]
        return self._run(x, mask, "f")[0] @ o[:HIDDEN] + self._run(x, mask, "b")[0] @ o[HIDDEN : 2 * HIDDEN] + x @ o[2 * HIDDEN : -1] + o[-1]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over unmasked blocks, by back-propagation through time."""
        tapes: dict[str, list] = {"f": [], "b": []}
        s = {d: self._run(x, mask, d, tapes[d])[0] for d in "fb"}
        o = self.p["o"]
        z = s["f"] @ o[:HIDDEN] + s["b"] @ o[HIDDEN : 2 * HIDDEN] + x @ o[2 * HIDDEN : -1] + o[-1]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()).astype(np.float32)
        e = lambda a: np.einsum("bt,btk->k", dz, a)
        grad = {"o": np.concatenate([e(s["f"]), e(s["b"]), e(x), [dz.sum()]]).astype(np.float32)}
        for n, d in enumerate("fb"):
            dout = dz[:, :, None] * o[n * HIDDEN : (n + 1) * HIDDEN]
            u, du = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for k, h, c, i, f, og, g, tc, m in reversed(tapes[d]):
                dh = dh + dout[:, k]
                dh_in, dc_in = dh * m, dc * m
                do = dh_in * tc
                dc2 = dc_in + dh_in * og * (1 - tc * tc)
                dzk = np.hstack([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * og * (1 - og), dc2 * i * (1 - g * g)])
                dpre[:, k] = dzk
                du += h.T @ dzk
                dh = dh * (1 - m) + dzk @ u.T
                dc = dc * (1 - m) + dc2 * f
            flat = dpre.reshape(-1, 4 * HIDDEN)
            grad |= {f"w{d}": x.reshape(-1, INPUT).T @ flat, f"u{d}": du, f"c{d}": flat.sum(axis=0)}
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> BiLstm:
        """Adam over batches of pages of like length."""
        r = np.random.default_rng(SEED)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        groups = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
        m1, m2, step = {k: 0 * v for k, v in self.p.items()}, {k: 0 * v for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            for j in r.permutation(len(groups)):
                x, mask, y = padded([p[0] for p in groups[j]], [p[1] for p in groups[j]])
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    rate = 0.02 if epoch < epochs - 2 else 0.005
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """Whether each block is main text; pages run together in batches of like length, and long ones by themselves."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: -len(pages[i]))
        at = 0
        while at < len(order):
            if len(pages[order[at]]) > LONG:
                out[order[at]] = self.label_long(pages[order[at]])
                at += 1
                continue
            some = order[at : at + max(1, min(256, 40_000 // len(pages[order[at]])))]
            x, mask, _ = padded([vectors(pages[i]) for i in some])
            z = self.logits(x, mask)
            for row, i in enumerate(some):
                out[i] = z[row, : len(pages[i])] > 0
            at += len(some)
        return out

    def label_long(self, found: list) -> np.ndarray:
        """The same for one page, LONG blocks at a time in either direction, so that memory follows LONG."""
        o, z = self.p["o"], np.full(len(found), self.p["o"][-1], np.float32)
        for n, d in enumerate("fb"):
            state = None
            starts = range(0, len(found), LONG)
            for a in starts if d == "f" else reversed(starts):
                x = vectors(found, a, a + LONG)
                out, state = self._run(x[None], np.ones((1, len(x)), np.float32), d, state=state)
                z[a : a + LONG] += out[0] @ o[n * HIDDEN : (n + 1) * HIDDEN] + (x @ o[2 * HIDDEN : -1] if d == "f" else 0)
        return z > 0


def padded(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(map(len, xs))
    x, mask, y = np.zeros((len(xs), t, INPUT), np.float32), np.zeros((len(xs), t), np.float32), np.zeros((len(xs), t), np.float32)
    for i, v in enumerate(xs):
        x[i, : len(v)], mask[i, : len(v)] = v, 1
        if ys is not None:
            y[i, : len(v)] = ys[i]
    return x, mask, y


def made_up_page(r: random.Random, nameless: bool = False) -> str:
    """A page of a random layout, MARK in each piece of its main text; if nameless, only paths, links, words and places tell it."""
    word = lambda: "".join(r.choice("the an on re ti st ou ing der ion es la que en sch ar ció".split()) for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    main = lambda a, b: MARK + say(a, b)

    def aside(name: str) -> str:
        tag = name if name in ("nav", "header", "footer", "aside", "form", "menu") and r.random() < 0.6 else r.choice(("div", "section", "ul", "div"))
        attr = "" if tag == name else f' {r.choice(("class", "id", "class", "role"))}="{name}{r.choice(("", "", "-box", " wide", "_1"))}"'
        kind = r.random()
        if nameless:
            tag, attr, kind = r.choice(("div", "section", "ul", "div")), f' class="{word()}"' * (r.random() < 0.5), r.choice((0, 0, 1))
        head = f"<h{r.randint(2, 4)}>{say(1, 4)}</h2>" if r.random() < 0.3 else ""
        if kind < 0.4:
            inner = "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(r.randint(1, 7)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind < 0.7:
            inner = "".join(f"<p>{say(4, 40)}.</p>" for _ in range(r.randint(1, 4)))
        else:
            inner = f"{say(1, 4)}" if nameless else f"{say(2, 20)}."
        return f"<{tag}{attr}>{head if tag != 'ul' else ''}{inner}</{tag}>"

    def body() -> str:
        out = [f"<h1>{main(3, 10)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(3 if nameless else 1, 12)):
            kind = r.random()
            if kind < 0.75:
                out.append(f"<p>{'<b>' * (r.random() < 0.15)}{main(12 if nameless else 1, 60)}.{'<br>' * (r.random() < 0.2)}{'</p>' * (r.random() < 0.9)}")
            elif kind < 0.82:
                out.append(f"<h2>{main(1, 6)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{main(2, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{main(5, 30)}</blockquote>")
            elif kind < 0.95:
                out.append(f"<table><tr><td>{main(1, 4)}</td><td>{main(1, 4)}</td></tr></table>")
            elif not nameless:
                out.append(aside(r.choice(ASIDE[2:])))
        return "".join(out)

    style = r.random()
    core = f"<article>{body()}</article>" if style < 0.6 else f"<main>{body()}</main>" if style < 0.8 else f'<div class="{r.choice(MAIN)}">{body()}</div>'
    kind = r.random()
    if nameless:
        core = f"<div{f' id="{word()}"' * (style < 0.5)}>{body()}</div>"
    elif style < 0.6 and kind < 0.3:
        beside = "".join(aside(r.choice(ASIDE[2:])) for _ in range(r.randint(0, 3)))
        core = f"<main>{core}{beside}</main>" if r.random() < 0.5 else f"<main>{beside}{core}</main>"
    elif style < 0.6 and kind < 0.5:
        core = f'<main><div class="{r.choice(MAIN)}">{core}</div></main>'
    before = "".join(aside(r.choice(ASIDE[2:])) for _ in range(r.randint(0, 4)))
    after = "".join(aside(r.choice(ASIDE[2:])) for _ in range(r.randint(0, 4)))
    return f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title></head><body>{before}{core}{after}</body></html>"


def training_pages(r: random.Random, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of so many made-up pages."""
    made = [known(made_up_page(r, r.random() < NAMELESS)) for _ in range(count)]
    return [(vectors(f), y) for f, y in made]


def fit(pages: DataFrame) -> BiLstm:
    """A network trained on made-up pages and a bounded sample of the table's."""
    r = random.Random(SEED)
    ids = pages.where("html is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    # SAMPLE numbers are broadcast, and SAMPLE pages come back, however many rows repeat a page_id
    some = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()
    return BiLstm().train(training_pages(r, PAGES) + [(vectors(f)[:LONG], teach(f)[:LONG]) for f in (blocks(x.html) for x in some)])


def extract(pages: DataFrame, model: BiLstm) -> DataFrame:
    """(page_id, url, text) of each page."""
    weights = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiLstm()
        net.p = weights
        for b in batches:
            texts: list[str] = []
            raw = b.column("html").to_pylist()
            for i in range(0, len(raw), 512):
                found = [blocks(x) for x in raw[i : i + 512]]
                for f, keep in zip(found, net.label(found), strict=True):
                    texts.append("\n".join(x[1] for x, k in zip(f, keep, strict=True) if k))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
