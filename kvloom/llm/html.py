"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags). A block is seen as a vector: its tag path (tags and the
words of class, id and role, hashed), its words (hashed) and a few measures. A bidirectional LSTM in numpy reads the
page's sequence of vectors in both directions, so that each block is labelled in the context of the whole page; the
blocks labelled as article are joined.

The labeller is trained here, on pages that `training_page` writes by rule from a fixed seed (kinds of pages, names of
containers, lengths), never on the table it reads; training takes seconds and is done once in a process.

Scale: one pass over the pages, no shuffle; the weights (some ten thousand numbers) go with the task. A block is held as the
numbers of its path's slots and two dozen measures, paths are projected once each, and gates are made for some hundred
steps at a time, so memory stays in proportion to the text of one page, however long or deeply nested.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_names, table

PATH_SLOTS, LEAF_SLOTS, WORD_SLOTS, MEASURES = 256, 64, 16, 7
INPUTS = PATH_SLOTS + LEAF_SLOTS + WORD_SLOTS + MEASURES
HIDDEN = 16
SEED = 3
TRAINING_PAGES = 1500
EPOCHS = 7

#: Fixed by the HTML standard: elements without content, elements whose content isn't markup, elements in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that aren't shown. Of those in SWALLOW an unclosed one takes the rest of the page; of the others only its tag goes.
SWALLOW = frozenset("script style iframe textarea xmp".split())
HIDDEN_ELEMENTS = SWALLOW | frozenset("noscript template object svg math".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>",
    re.S,
)
_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in HIDDEN_ELEMENTS}
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Block:
    """text, and where it stands: path (slots of all open tags and names), leaf (slots of the innermost), depth, linked characters."""

    __slots__ = ("depth", "leaf", "linked", "path", "text")

    def __init__(self, path: tuple, leaf: tuple, depth: int, text: str, linked: int):
        self.path, self.leaf, self.depth, self.text, self.linked = path, leaf, depth, text, linked


def _slot(x: str, n: int) -> int:
    return zlib.crc32(x.encode()) % n


@lru_cache(maxsize=20_000)
def _element(tag: str, names: tuple) -> tuple[tuple, tuple]:
    """Slots of an element in a path, and as the innermost one."""
    words = ("<" + tag, *names)
    return tuple({_slot(w, PATH_SLOTS) for w in words}), tuple(sorted({_slot(w, LEAF_SLOTS) for w in words}))


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order; text has its references decoded and white space as one blank.

    A self-closed svg or math has no content; an unclosed noscript, template, object, svg or math doesn't hide what follows.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple, tuple]] = []
    held: dict[int, int] = {}  # slots of the open elements, and how many hold each
    opened: dict[str, int] = {}
    parts: list[str] = []
    unclosed: set[str] = set()
    path: tuple | None = ()
    linked, in_link = 0, False

    def close():
        nonlocal linked, path
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                if path is None:
                    path = tuple(sorted(held))
                out.append(Block(path, stack[-1][2] if stack else (), len(stack), text, linked))
            parts.clear()
        linked = 0

    def pop():
        nonlocal path
        tag, slots, _ = stack.pop()
        opened[tag] -= 1
        for x in slots:
            held[x] -= 1
            if not held[x]:
                del held[x]
        path = None

    page, at = page or "", 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            linked += len(piece) if in_link else 0
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name, end, rest = name.lower(), m["end"], m["rest"]
        if name in HIDDEN_ELEMENTS:
            if not end and not (name in ("svg", "math") and rest.endswith("/")):
                shut = None if name in unclosed else _ENDS[name].search(page, at)
                if shut:
                    at = shut.end()
                else:
                    unclosed.add(name)
                    at = len(page) if name in SWALLOW else at
            continue
        if name in INLINE:
            if name == "a":
                in_link = not end
            continue
        close()
        if name in VOID:
            continue
        if end:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            in_link = False
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            pop()
        names = tuple(w for x in _NAMED.findall(rest) for w in _WORDS.findall("".join(x).lower())) if "=" in rest else ()
        if not rest.endswith("/"):
            stack.append((name, *_element(name, names)))
            opened[name] = opened.get(name, 0) + 1
            for x in stack[-1][1]:
                held[x] = held.get(x, 0) + 1
            path = None
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def measures(found: list[Block]) -> np.ndarray:
    """The hashed words and the measures of blocks, without their paths."""
    x = np.zeros((len(found), WORD_SLOTS + MEASURES), np.float32)
    for i, b in enumerate(found):
        words = b.text.lower().split()
        slots = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_SLOTS for w in words], minlength=WORD_SLOTS)
        x[i, :WORD_SLOTS] = slots / len(words)
        n = len(b.text)
        x[i, WORD_SLOTS:] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, min(b.linked / n, 1), b.text.count(".") / len(words), i / len(found), (len(found) - i) / len(found), min(b.depth, 30) / 10)
    return x


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), INPUTS), np.float32)
    for i, b in enumerate(found):
        x[i, list(b.path)] = 1
        x[i, [PATH_SLOTS + a for a in b.leaf]] = 1
    x[:, PATH_SLOTS + LEAF_SLOTS :] = measures(found)
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, rng: np.random.Generator):
        self.w = {}
        for side in "fb":
            self.w[f"{side}x"] = (rng.standard_normal((INPUTS, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.w[f"{side}h"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.w[f"{side}b"] = np.zeros(4 * HIDDEN, np.float32)
            self.w[f"{side}b"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.w["o"] = (rng.standard_normal(2 * HIDDEN) * 0.15).astype(np.float32)
        self.w["ox"] = np.zeros(INPUTS, np.float32)
        self.w["ob"] = np.zeros(1, np.float32)
        self.projected: dict[tuple, np.ndarray] = {}

    def __getstate__(self):
        return {"w": self.w, "projected": {}}

    def _run(self, x: np.ndarray, live: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (pages, blocks, HIDDEN) in the order of x; live marks real blocks, others pass the state on."""
        n, t, _ = x.shape
        gates = x @ self.w[f"{side}x"] + self.w[f"{side}b"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, t, HIDDEN), np.float32)
        for k in range(t):
            z = gates[:, k] + h @ self.w[f"{side}h"]
            i, f, o = (1 / (1 + np.exp(-z[:, a * HIDDEN : (a + 1) * HIDDEN])) for a in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = live[:, k, None]
            c2 = np.where(on, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(on, o * tc, h)
            if keep is not None:
                keep.append((h, c, i, f, o, g, tc, on))
            h, c = h2, c2
            out[:, k] = h
        return out

    def _mirror(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each page's real blocks in reverse order."""
        at = np.arange(x.shape[1])[None, :]
        back = np.where(at < n[:, None], n[:, None] - 1 - at, at)
        return x[np.arange(len(x))[:, None], back]

    def forward(self, x: np.ndarray, n: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Chances (pages, blocks) that a block is of the article. n: blocks of each page."""
        live = np.arange(x.shape[1])[None, :] < n[:, None]
        steps = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        mirrored = self._mirror(x, n)
        states = {"f": self._run(x, live, "f", steps["f"]), "b": self._mirror(self._run(mirrored, live, "b", steps["b"]), n)}
        both = np.concatenate((states["f"], states["b"]), axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + x @ self.w["ox"] + self.w["ob"], -30, 30)))
        if keep is not None:
            keep |= {"live": live, "steps": steps, "both": both, "mirrored": mirrored}
        return p

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        p = self.forward(x, n, keep)
        d = np.where(keep["live"], p - y, 0).astype(np.float32) / max(int(n.sum()), 1)
        grad = {"o": np.einsum("ntk,nt->k", keep["both"], d), "ox": np.einsum("ntk,nt->k", x, d), "ob": np.array([d.sum()], np.float32)}
        d_both = d[:, :, None] * self.w["o"]
        for side, d_out, given in (("f", d_both[:, :, :HIDDEN], x), ("b", self._mirror(d_both[:, :, HIDDEN:], n), keep["mirrored"])):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"{side}h"])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for k in range(x.shape[1] - 1, -1, -1):
                h, c, i, f, o, g, tc, on = keep["steps"][side][k]
                dh = dh + d_out[:, k]
                dcell = np.where(on, dc + dh * o * (1 - tc * tc), 0)
                dz = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), np.where(on, dh, 0) * tc * o * (1 - o), dcell * i * (1 - g * g)), axis=1)
                gh += h.T @ dz
                dz_all[:, k] = dz
                dh = np.where(on, 0, dh) + dz @ self.w[f"{side}h"].T
                dc = np.where(on, dcell * f, dc)
            grad |= {f"{side}h": gh, f"{side}x": np.einsum("nti,ntg->ig", given, dz_all, optimize=True), f"{side}b": dz_all.sum(axis=(0, 1))}
        return grad

    def label(self, pages: list[list[Block]], at_once: int = 128) -> list[np.ndarray]:
        """For each page (its blocks), which blocks are of the article."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        start = 0
        while start < len(order):
            longest = len(pages[order[min(start + at_once, len(order)) - 1]])
            size = max(1, min(at_once, 100_000 // longest))
            own = order[start : start + size][::-1]
            start += size
            logits = self.logits([pages[i] for i in own])
            for i, x in zip(own, np.split(logits, np.cumsum([len(pages[i]) for i in own])[:-1])):
                out[i] = x >= 0
        return out

    def _paths(self, found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each block's path in a table, and the table: gates of both sides and the output by paths alone."""
        table, places, seen = [], np.empty(len(found), np.int32), {}
        for i, b in enumerate(found):
            key = b.path, b.leaf
            at = seen.get(key)
            if at is None:
                row = self.projected.get(key)
                if row is None:
                    if len(self.projected) >= 20_000:
                        self.projected.clear()
                    slots = [*b.path, *(PATH_SLOTS + x for x in b.leaf)]
                    row = self.projected[key] = np.concatenate([self.w[k][slots].sum(axis=0).reshape(-1) for k in ("fx", "bx", "ox")])
                at = seen[key] = len(table)
                table.append(row)
            places[i] = at
        return places, np.array(table, np.float32)

    def logits(self, pages: list[list[Block]], steps: int = 512) -> np.ndarray:
        """Log odds of all blocks, page after page; pages don't grow in length and none is empty."""
        n = np.array([len(p) for p in pages])
        found = [b for p in pages for b in p]
        starts, (places, table), rest = np.cumsum(n) - n, self._paths(found), np.concatenate([measures(p) for p in pages])
        tail = PATH_SLOTS + LEAF_SLOTS
        out = table[places, 8 * HIDDEN] + rest @ self.w["ox"][tail:] + self.w["ob"][0]
        for side, o in (("f", self.w["o"][:HIDDEN]), ("b", self.w["o"][HIDDEN:])):
            columns = slice(0, 4 * HIDDEN) if side == "f" else slice(4 * HIDDEN, 8 * HIDDEN)
            own, wx, wh, bias = table[:, columns], self.w[f"{side}x"][tail:], self.w[f"{side}h"], self.w[f"{side}b"]
            h = c = np.zeros((len(pages), HIDDEN), np.float32)
            for first in range(0, int(n[0]), steps):
                live = int((n > first).sum())
                k = np.arange(first, min(first + steps, int(n[0])))[None, :]
                at = np.minimum(k, n[:live, None] - 1)
                at = starts[:live, None] + (at if side == "f" else n[:live, None] - 1 - at)
                gates = own[places[at]] + rest[at] @ wx + bias
                for j in range(k.shape[1]):
                    m = int((n > first + j).sum())  # the pages that go on are the first ones
                    z = gates[:m, j] + h[:m] @ wh
                    s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                    c = s[:, HIDDEN : 2 * HIDDEN] * c[:m] + s[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                    h = s[:, 2 * HIDDEN :] * np.tanh(c)
                    out[at[:m, j]] += h @ o
        return out


def _padded(pages: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(pages), max(map(len, pages)), INPUTS), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
    return x


#: Names that containers go by, as the generator of training pages writes them.
NAMES = {
    "article": "article content post entry story text main body detail single page",
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs links tabs",
    "header": "header masthead top logo branding title bar",
    "footer": "footer bottom copyright legal colophon credits",
    "sidebar": "sidebar aside widget related popular recent side rail tags",
    "notice": "notice cookie consent banner alert popup modal gdpr overlay message",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion",
    "form": "form newsletter subscribe search login signup contact",
    "comments": "comments comment replies reply discussion respond thread feedback",
}
TAGS = {
    "menu": "nav nav div ul header", "header": "header header div", "footer": "footer footer div", "sidebar": "aside aside div section", "notice": "div div section aside dialog",
    "advert": "div div aside section ins", "form": "form form div section", "comments": "div section section ol ul",
}


def training_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page by rule, and for each of its blocks whether it is of the article. Words are random syllables."""
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que la des sch ung ción ado".split()
    letters = "aeiouybcdfghjklmnprstvwz"
    # each page has a vocabulary of its own sort: listed syllables, or letters at random
    sort = rng.random() < 0.5
    word = lambda: "".join(rng.choice(syllables) if sort else rng.choice(letters) + rng.choice(letters) for _ in range(rng.randint(1, 4)))
    hint = {"notice": "cookies accept privacy", "form": "subscribe email search name submit", "comments": "reply says ago likes", "footer": "© rights reserved terms", "advert": "buy now offer sponsored", "menu": "home about contact news"}
    out: list[tuple[str, bool | None]] = []  # markup, or text with its label

    def words(lo, hi, kind=None):
        w = [rng.choice(hint[kind].split()) if kind in hint and rng.random() < 0.15 else word() for _ in range(rng.randint(lo, hi))]
        return " ".join([w[0].capitalize(), *w[1:]]) + rng.choice(("", ".", "."))

    def mark(x):
        out.append((x, None))

    def text(x, label):
        out.append((rng.choice(("{}", "{}", "{}", "<b>{}</b>", "<span>{}</span>", '<a href="/x">{}</a>' if not label or rng.random() < 0.1 else "{}", "<b>{}")).format(x), label))

    def named(kind):
        r = rng.random()
        name = rng.choice(NAMES[kind].split())
        extra = rng.choice(("", "", " " + word(), "-" + word(), " clearfix", " col"))
        return f' {rng.choice(("class", "class", "id"))}="{name}{extra}"' if r < 0.85 else ""

    def chunk(kind):
        tag = rng.choice(TAGS[kind].split())
        plain = tag in ("div", "section", "ul", "ol", "ins", "dialog")
        attr = named(kind) if plain or rng.random() < 0.6 else ""
        if plain and not attr and kind not in ("menu", "footer", "form"):  # these show by what they hold, others need a name
            attr = f' class="{rng.choice(NAMES[kind].split())}"'
        mark(f"<{tag}{attr}>")
        style = rng.random()
        n = rng.randint(1, 7)
        if kind in ("menu", "footer", "header") and rng.random() < 0.25:
            out.append((" ".join(f'<a href="/{word()}">{words(1, 2, kind)}</a>' for _ in range(n)), False))
        elif kind == "menu" or style < 0.3:
            inner = tag not in ("ul", "ol") and rng.random() < 0.8
            mark("<ul>" if inner else "")
            for _ in range(n):
                mark("<li>")
                out.append((f'<a href="/{word()}">{words(1, 3, kind)}</a>', False) if kind == "menu" else (words(1, 12, kind), False))
                mark("</li>" if rng.random() < 0.8 else "")
            mark("</ul>" if inner else "")
        elif style < 0.75 or kind == "comments":
            for _ in range(n if kind in ("comments", "sidebar") else rng.randint(1, 2)):
                t = rng.choice(("p", "div", "h3", "p"))
                mark(f"<{t}>")
                text(words(1, 60 if kind in ("comments", "sidebar", "notice") else 25, kind), False)
                mark(f"</{t}>")
        else:
            text(words(1, 25, kind), False)
        if kind == "form" and rng.random() < 0.5:
            mark('<input name="q"><button>')
            out.append((words(1, 2, kind), False))
            mark("</button>")
        mark(f"</{tag}>")

    def article():
        bare = rng.random() < 0.1
        tag = rng.choice(("article", "article", "article", "main", "div", "div", "section"))
        outer = rng.random() < 0.3
        mark("<main>" if outer else "")
        attr = named("article") if tag in ("div", "section") or rng.random() < 0.3 else ""
        if tag in ("div", "section") and rng.random() < 0.4:  # without a name, or with one that says nothing
            attr = rng.choice(("", "", f' id="{word()}"', f' class="{word()} {word()}"', f' id="x{rng.randint(1, 99)}"', ' style="margin:0"'))
        layers = rng.choice((0, 0, 0, 1, 2)) if tag in ("div", "section") else 0
        mark("" if bare else f"<{tag}{attr}>" + "<div>" * layers)
        paragraph = rng.choice(("p", "p", "p", "div")) if tag != "article" or rng.random() < 0.2 else "p"
        if rng.random() < 0.8:
            h = rng.choice(("h1", "h1", "h2"))
            wrap = rng.random() < 0.15
            mark("<header>" if wrap else "")
            mark(f"<{h}>")
            text(words(1, 14), True)
            mark(f"</{h}>")
            mark("</header>" if wrap else "")
        for i in range(rng.choice((1, 2, 3, 5, 8, 14, 25))):
            r = rng.random()
            if r < 0.7:
                mark(f"<{paragraph}>")
                if rng.random() < 0.15:
                    text(words(1, 30), True)
                    mark("<br>")
                text(words(*rng.choice(((1, 2), (3, 20), (20, 120)))), True)
                mark(f"</{paragraph}>" if paragraph == "div" or rng.random() < 0.7 else "")
            elif r < 0.81:
                mark("<ul>")
                for _ in range(rng.randint(1, 5)):
                    mark("<li>")
                    text(words(1, 20), True)
                    mark("</li>")
                mark("</ul>")
            elif r < 0.88:
                mark("<blockquote><p>")
                text(words(2, 50), True)
                mark("</p></blockquote>")
            elif r < 0.93:
                h = rng.choice(("h2", "h3", "h4"))
                mark(f"<{h}>")
                text(words(1, 8), True)
                mark(f"</{h}>")
            elif r < 0.95:
                mark(rng.choice(("<figure><img>", '<figure><svg class="i"/>', "<figure>")) + "<figcaption>")
                text(words(2, 16), True)
                mark("</figcaption></figure>")
            elif r < 0.97:
                mark("<table><tr>")
                for _ in range(rng.randint(1, 6)):
                    mark("<td>")
                    text(words(1, 4), True)
                    mark("</td>")
                mark("</tr></table>")
            else:
                chunk(rng.choice(("advert", "advert", "form", "sidebar")))
        if rng.random() < 0.1 and not bare:
            chunk("comments")
        mark("" if bare else "</div>" * layers + f"</{tag}>")
        mark("</main>" if outer else "")

    if rng.random() < 0.08:  # a fragment without a frame
        for _ in range(rng.randint(1, 6)):
            mark("<p>" if rng.random() < 0.7 else "<div>")
            text(words(1, 60), True)
            mark(rng.choice(("</p>", "<br>")))
    else:
        mark("<!DOCTYPE html><html><head><title>")
        out.append((words(2, 10), False))
        mark("</title></head><body>")
        wrapped = rng.random() < 0.3
        mark(rng.choice(("<div>", "<div><div>", f'<div class="{rng.choice(("wrapper", "container", "page", "site"))}">', f'<div id="{word()}">')) if wrapped else "")
        for kind in ("header", "menu", "notice", "advert", "form"):
            if rng.random() < (0.75 if kind == "menu" else 0.4):
                chunk(kind)
        if rng.random() < 0.25:
            chunk("sidebar")
        if rng.random() < 0.97:
            article()
        for kind in ("advert", "comments", "sidebar", "form", "notice", "footer"):
            if rng.random() < (0.75 if kind == "footer" else 0.35):
                chunk(kind)
        mark("</div>" if wrapped else "")
        mark("</body></html>")
    # two texts without a mark between them would be one block; a mark always stands between them here
    return "".join(x for x, _ in out), [label for x, label in out if label is not None]


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        page, labels = training_page(rng)
        found = blocks(page)
        if len(found) == len(labels) and found:
            data.append((vectors(found), np.array(labels, np.float32)))
    net = Labeller(np.random.default_rng(seed))
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step, batch = 0, 24
    for epoch in range(epochs):
        rate = 0.02 * 0.55**epoch
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 8, rng.random()))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        for own in groups:
            n = np.array([len(data[i][0]) for i in own])
            y = np.zeros((len(own), n.max()), np.float32)
            for r, i in enumerate(own):
                y[r, : n[r]] = data[i][1]
            step += 1
            for k, g in net.gradients(_padded([data[i][0] for i in own]), n, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def extract(pages: DataFrame, html: str = "html", *keep: str, labeller: Labeller | None = None) -> DataFrame:
    """keep, text, n_chars for each row. Null and empty pages, and pages without an article, have an empty text.

    Equal rows give equal rows, no rows give none. A kept column by the name of a result comes back as <name>_given.
    """
    net = labeller or trained()
    kept = given_names(keep, ("text", "n_chars"))

    def each(batches):
        for b in batches:
            texts, held, size = [], [], 0
            for x in b.column(b.num_columns - 1):
                page = x.as_py()
                held.append(page)
                size += len(page or "")
                if len(held) == 256 or size > 4_000_000:
                    texts += article_texts(net, held)
                    held, size = [], 0
            texts += article_texts(net, held)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    given = pages.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)), F.col(html).cast("string").alias("__html"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(each, f"{kinds}text string, n_chars long")


def article_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(x) for x in pages]
    return [" ".join(x.text for x, yes in zip(own, labels) if yes) for own, labels in zip(found, net.label(found))]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), "html", "page_id", "url")
