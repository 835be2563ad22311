"""Main-text extraction: a recurrent labeller decides for every block of a page whether it belongs to the article.

A page is cut into leaf blocks at block-level tags. Each block has a vector of its tag path (hashed tag, class and id
words of its NEAREST innermost open block elements), a hashed-word vector of its text and a few figures. A bidirectional LSTM in numpy
reads the whole sequence of a page's blocks and gives each a probability; blocks at 0.5 or more are joined in page
order. Training uses generated pages with known labels (`training_page`, seeded; no row of any table), by
backpropagation through time on the driver, once for each process.

Defined results: a null or empty page has an empty text; script, style, title and template content, comments, CDATA
sections, declarations and markup are never text; a tag that isn't closed ends before the next `<`, a quote that doesn't
close like one ends its tag at the next `>`, and a `<` that begins no markup is text; broken nesting is repaired by closing the
innermost matching element; reading takes time in proportion to the page, whatever it holds; white space inside a block,
line breaks included, becomes one space; whole pages of any length are read; rows repeat independently; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import arrow_map

#: Elements that begin and end a block (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select "
    "summary table tbody td textarea tfoot th thead tr ul video audio".split()
)
#: Elements whose content is never text (fixed values).
RAW = frozenset("script style title template svg math".split())
#: Elements that an opening tag of the same kind closes (fixed values).
SELF_CLOSING = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
#: Where markup begins; any other `<` is text.
OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/><]*)|(!--)|(!\[CDATA\[)|[!?/])")
#: An attribute up to the quote of its value, or all of it if it has none.
ATTRIBUTE = re.compile(r"[\s/]*(?:=?[^\s/>=<]+(?:\s*=\s*(?:([\"'])|[^\s>\"'<][^\s><]*)?)?|[=])")
AFTER_TAG = re.compile(r"[\s/]*")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[a-z]+")

PATH, WORDS, FIGURES = 96, 32, 6
WIDTH = PATH + WORDS + FIGURES
STATE = 16
#: Blocks that go through the network at once.
WIDE = 60_000
#: Open elements that a path names.
NEAREST = 64


class _Finder:
    """Next occurrences of fixed strings at or after positions that only grow, each found once."""

    def __init__(self, page: str):
        self.page, self.at = page, {}

    def __call__(self, what: str, start: int) -> int:
        """The length of the page if there is none."""
        found = self.at.get(what, -1)
        if found < start:
            found = self.page.find(what, start)
            self.at[what] = found = len(self.page) if found < 0 else found
        return found


def _tag_end(page: str, at: int, find: _Finder) -> int:
    """Where a tag whose name ends at `at` is over."""
    n = len(page)
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m:
            break
        at = m.end()
        if m[1]:
            close = find(m[1], at)
            if close + 1 < n and page[close + 1] not in " \t\r\n\f/>" or close >= n:
                # No closing quote: the tag is over where it can be.
                return min(find(">", at) + 1, find("<", at), n)
            at = close + 1
    at = AFTER_TAG.match(page, at).end()
    return at + 1 if at < n and page[at] == ">" else min(find(">", at) + 1, find("<", at), n)


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each block that has text."""
    page = page or ""
    find = _Finder(page)
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    opened: dict[str, int] = {}
    held: list[str] = []
    linked = at = 0
    in_link = False

    def close() -> None:
        """End the block; the stack is still as it was where the block began."""
        nonlocal linked, in_link
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((tuple(s for _, s in stack[-NEAREST:]), text, linked))
            held.clear()
        linked, in_link = 0, False

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while True:
        m = OPEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            held.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        if m[2] is None:
            at = m.end()
            at = find("-->", at - 2) + 3 if m[3] else find("]]>", at) + 3 if m[4] else find(">", at) + 1
            continue
        name, ends = m[2].lower(), m[1] == "/"
        at = _tag_end(page, m.end(), find)
        if name in RAW:
            if not ends and page[at - 2 : at] != "/>":
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = find(">", end.end()) + 1 if end else len(page)
        elif name in BLOCKS:
            close()
            if ends:
                if opened.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
            else:
                shut = SELF_CLOSING.get(name, ())
                while stack and stack[-1][0] in shut:
                    pop()
                if name != "hr":
                    tag = page[m.end() : at]
                    said = " ".join(a or b or c for a, b, c in NAMED.findall(tag)) if "=" in tag else ""
                    stack.append((name, f"{name} {said.lower()}" if said else name))
                    opened[name] = opened.get(name, 0) + 1
        elif name == "br":
            held.append(" ")
        elif name == "a":
            in_link = not ends
    close()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}
_buckets: dict[str, int] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 50_000:
            _paths.clear()
        v = np.zeros(PATH, np.float32)
        for depth, step in enumerate(reversed(path)):
            tag, *names = step.split(" ", 1)
            words = [f"<{tag}", *(f".{w}" for w in WORD.findall(names[0]))] if names else [f"<{tag}"]
            for w in words:
                v[zlib.crc32(w.encode()) % PATH] += 1.0 if depth < 3 else 0.5
        _paths[path] = v
    return _paths[path]


def features(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> np.ndarray:
    """(blocks of all pages, WIDTH)."""
    each = [b for p in pages for b in p]
    x = np.zeros((len(each), WIDTH), np.float32)
    if not each:
        return x
    if len(_buckets) > 500_000:
        _buckets.clear()
    known, flat, sizes = _buckets, [], np.empty(len(each), np.int64)
    for i, (path, text, linked) in enumerate(each):
        x[i, :PATH] = _path_vector(path)
        words = text.lower().split()
        sizes[i] = len(words)
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = zlib.crc32(w.encode()) % WORDS
            flat.append(k)
        n = len(text)
        tag = path[-1] if path else ""
        x[i, PATH + WORDS :] = (np.log1p(n) / 5, min(1.0, linked / max(1, n)), text[-1] in ".!?…:;\"'»”", tag[:1] == "h" and tag[1:2].isdigit(), "©" in text, len(words) < 4)
    at = np.repeat(np.arange(len(each)), sizes) * WORDS + np.array(flat, np.int64)
    counts = np.bincount(at, minlength=len(each) * WORDS).reshape(len(each), WORDS)
    x[:, PATH : PATH + WORDS] = counts / np.maximum(1, sizes)[:, None]
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


class BlockLstm:
    """Bidirectional LSTM of STATE units a direction with one logistic output a block. Gates: input, forget, output, cell."""

    def __init__(self, seed: int = 11):
        r, h = np.random.default_rng(seed), STATE
        self.p = {"out": r.normal(0, 0.3, (2 * h, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 0.15, (WIDTH, 4 * h))
            self.p[f"u{d}"] = r.normal(0, 0.2, (h, 4 * h))
            self.p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, real: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """(time, n, STATE); real (time, n) is 0 on padding, where the state stays as it is."""
        h, n = STATE, x.shape[1]
        u = self.p[f"u{d}"]
        into = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.empty((len(x), n, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = into[t] + s @ u
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            on = real[t][:, None]
            c1 = gates[:, h : 2 * h] * c + gates[:, :h] * new
            tc = np.tanh(c1)
            if keep is not None:
                keep[t] = gates, new, c, s, tc
            s, c = on * gates[:, 2 * h :] * tc + (1 - on) * s, on * c1 + (1 - on) * c
            out[t] = s
        return out

    def probabilities(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.states(x, real, d) for d in "fb"], axis=2)
        return _sigmoid(both @ self.p["out"] + self.p["bias"])[:, :, 0]

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h = STATE
        keep: dict[str, dict] = {"f": {}, "b": {}}
        both = np.concatenate([self.states(x, real, d, keep[d]) for d in "fb"], axis=2)
        p = _sigmoid(both @ self.p["out"] + self.p["bias"])[:, :, 0]
        dz = ((p - y) * real / real.sum())[:, :, None]
        grads = {"out": np.einsum("tnh,tnk->hk", both, dz), "bias": dz.sum(axis=(0, 1))}
        back = dz @ self.p["out"].T
        for k, d in enumerate("fb"):
            u, gw, gu, gc = self.p[f"u{d}"], np.zeros_like(self.p[f"w{d}"]), np.zeros_like(self.p[f"u{d}"]), np.zeros(4 * h, np.float32)
            ds = dc = np.zeros((x.shape[1], h), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                gates, new, c, s, tc = keep[d][t]
                on = real[t][:, None]
                ds = ds + back[t][:, k * h : (k + 1) * h]
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dh = on * ds
                dcell = on * dc + dh * o * (1 - tc * tc)
                g = np.concatenate([dcell * new * i * (1 - i), dcell * c * f * (1 - f), dh * tc * o * (1 - o), dcell * i * (1 - new * new)], axis=1)
                gw += x[t].T @ g
                gu += s.T @ g
                gc += g.sum(axis=0)
                ds = (1 - on) * ds + g @ u.T
                dc = (1 - on) * dc + dcell * f
            grads |= {f"w{d}": gw, f"u{d}": gu, f"c{d}": gc}
        return grads


#: Words of class and id names in generated pages, and phrases of page furniture (fixed values).
MAIN_NAMES = ["content", "main", "post", "article", "entry", "story", "body", "text", "article-body", "post-content", "entry-content", "main-content", "story-body"]
SIDE = {
    "menu": (["nav", "menu", "navbar", "navigation", "main-menu", "breadcrumbs", "breadcrumb", "topnav", "toc"], ["home", "about us", "contact", "products", "next", "previous"]),
    "header": (["header", "masthead", "site-header", "page-header", "top", "branding", "logo"], ["welcome", "daily news", "our blog", "search"]),
    "footer": (["footer", "site-footer", "bottom", "copyright", "legal", "colophon"], ["© 2024 all rights reserved", "terms of use", "privacy policy", "imprint", "© the authors"]),
    "sidebar": (["sidebar", "side", "aside", "widget", "related", "related-posts", "recommended", "popular", "trending", "tags"], ["most read", "related articles", "popular posts", "see also"]),
    "notice": (["cookie", "cookie-notice", "notice", "banner", "consent", "gdpr", "alert", "popup", "modal", "overlay"], ["we use cookies to improve your experience", "accept all", "this site uses cookies", "please update your browser"]),
    "advert": (["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adbox"], ["advertisement", "sponsored", "buy now", "limited offer", "click here"]),
    "form": (["form", "search", "newsletter", "subscribe", "login", "signup", "contact-form"], ["subscribe", "enter your e-mail", "sign in", "send", "search"]),
    "comments": (["comments", "comment", "comment-list", "discussion", "replies", "respond", "disqus", "reader-comments"], ["leave a reply", "great post!", "reply", "says:", "i agree with this"]),
    "share": (["share", "social", "sharing", "follow", "tools"], ["share on", "tweet", "like", "print", "e-mail"]),
}


def _word(r: random.Random) -> str:
    return "".join(r.choice(["th", "er", "an", "in", "re", "ou", "qu", "ei", "sch", "ción", "eau", "ment", "la", "to", "be", "ka", "mo", "st", "ü", "é", "o", "a"]) for _ in range(r.randint(1, 4)))


def _prose(r: random.Random, least: int, most: int) -> str:
    n = r.randint(least, most)
    marks = r.choice(["", "", "", "###", "!!", "%%%", " |"])
    words = [_word(r) + (marks if r.random() < 0.5 else "") + ("," if r.random() < 0.1 else "") for _ in range(n)]
    text = " ".join(words)
    return (text[:1].upper() + text[1:] + r.choice([".", ".", ".", "?", "", "!"])).replace("&", "&amp;")


def training_page(r: random.Random) -> tuple[str, list[int]]:
    """A generated page and the label of each of its blocks (1: article)."""
    parts: list[str] = []
    labels: list[int] = []

    def put(text: str, label: int, tag: str) -> str:
        labels.append(label)
        inner = f"<b>{text}</b>" if r.random() < 0.1 else text
        return f"<{tag}>{inner}" + (f"</{tag}>" if r.random() < 0.9 or tag == "div" else "")

    def side(kind: str) -> None:
        names, phrases = SIDE[kind]
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if r.random() < 0.4 or tag in ("div", "section"):
            tag = tag if tag in ("section", "form") and r.random() < 0.5 else "div"
            open_ = f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names)}">'
        else:
            open_ = f"<{tag}>" if r.random() < 0.6 else f'<{tag} class="{r.choice(names)}">'
        parts.append(open_)
        how = r.random()
        if kind == "comments" or (kind in ("advert", "notice", "sidebar", "footer") and how < 0.5):
            for _ in range(r.randint(1, 6 if kind == "comments" else 2)):
                text = _prose(r, 3, 40) if r.random() < 0.75 else r.choice(phrases)
                if r.random() < 0.4:
                    labels.append(0)
                    parts.append(f"<div>{text}</div>")
                else:
                    parts.append(put(text, 0, r.choice(["p", "p", "li", "div"])))
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                parts.append(put(r.choice(phrases) if r.random() < 0.5 else _prose(r, 1, 5), 0, r.choice(["label", "button", "p"])))
        elif how < 0.7 and kind in ("menu", "header", "sidebar", "footer", "share"):
            parts.append("<ul>")
            for _ in range(r.randint(2, 9)):
                text = r.choice(phrases) if r.random() < 0.3 else _prose(r, 1, 3).rstrip(".?!")
                labels.append(0)
                parts.append(f'<li><a href="/{_word(r)}">{text or "x"}</a></li>')
            parts.append("</ul>")
        else:
            labels.append(0)
            text = r.choice(phrases) if r.random() < 0.5 else _prose(r, 2, 20)
            parts.append(text if r.random() < 0.5 else f"<span>{text}</span>")
        parts.append(f"</{open_[1:].split()[0].rstrip('>')}>")

    parts.append(f"<!DOCTYPE html><html><head><title>{_prose(r, 3, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>")
    for kind in ("notice", "header", "menu", "advert"):
        if r.random() < (0.7 if kind in ("menu", "advert") else 0.35):
            side(kind)
    outer = r.random()
    wrap = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">' if outer < 0.4 else ""
    parts.append(wrap)
    if wrap and r.random() < 0.3:
        side("sidebar")
    form = r.random()
    tag = "article" if form < 0.5 else r.choice(["main", "div", "section", "div"])
    parts.append(f"<{tag}>" if tag in ("article", "main") and r.random() < 0.7 else f'<{tag} {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}">')
    if r.random() < 0.9:
        parts.append(put(_prose(r, 1, 9), 1, "h1"))
    if r.random() < 0.4:
        labels.append(1)
        parts.append(f"<p><b>{_prose(r, 2, 9)}<br>")
    for _ in range(r.choice([1, 2, 3, 5, 8, 12, 25])):
        what = r.random()
        if what < 0.75:
            parts.append(put(_prose(r, 1, 60), 1, "p"))
        elif what < 0.83:
            parts.append(put(_prose(r, 1, 6), 1, r.choice(["h2", "h3"])))
        elif what < 0.9:
            parts.append("<ul>" + "".join(f"<li>{_prose(r, 1, 12)}</li>" for _ in range(3)) + "</ul>")
            labels.extend([1, 1, 1])
        elif what < 0.94:
            parts.append(put(_prose(r, 3, 25), 1, r.choice(["blockquote", "pre", "td", "div"])))
        else:
            side(r.choice(["advert", "share", "advert", "form"]))
    cut = r.random() < 0.08
    if not cut:
        parts.append(f"</{tag}>")
        if r.random() < 0.35:
            side("comments")
        if r.random() < 0.3:
            side("sidebar")
        if wrap:
            parts.append("</div>")
        if r.random() < 0.8:
            side("footer")
        parts.append("</body></html>" if r.random() < 0.9 else "")
    return "".join(parts), labels


def padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, vectors))
    x, real = np.zeros((longest, len(vectors), WIDTH), np.float32), np.zeros((longest, len(vectors)), np.float32)
    for i, v in enumerate(vectors):
        x[: len(v), i], real[: len(v), i] = v, 1
    return x, real


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1500, steps: int = 1400, batch: int = 48, rate: float = 0.02, seed: int = 17) -> BlockLstm:
    """The labeller, trained on `pages` generated pages."""
    r = random.Random(seed)
    examples = []
    while len(examples) < pages:
        page, labels = training_page(r)
        found = blocks(page)
        if len(found) == len(labels) and found:
            examples.append((features([found]), np.array(labels, np.float32)))
    net, pick = BlockLstm(), np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = [examples[i] for i in pick.integers(0, len(examples), batch)]
        x, real = padded([v for v, _ in chosen])
        y = np.zeros(real.shape, np.float32)
        for i, (_, labels) in enumerate(chosen):
            y[: len(labels), i] = labels
        lr = rate * (1 - step / (steps + 1))
        for k, g in net.gradients(x, real, y).items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label_pages(net: BlockLstm, pages: list[list]) -> list[np.ndarray]:
    """Probability of each block of each page, read as whole sequences side by side."""
    x = features(pages)
    ends = np.cumsum([len(p) for p in pages])
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= WIDE:
            end += 1
        group = order[at:end]
        p = net.probabilities(*padded([x[ends[i] - len(pages[i]) : ends[i]] for i in group]))
        for k, i in enumerate(group):
            out[i] = p[: len(pages[i]), k]
        at = end
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_blocks: bool = False) -> DataFrame:
    """page_id, url, text, n_chars for every row; with_blocks adds labels (array of text, probability)."""
    net = df.sparkSession.sparkContext.broadcast(trained())

    def make():
        def work(batch):
            pages = [blocks(h) for h in batch.column(1).to_pylist()]
            marks = label_pages(net.value, pages)
            texts = ["\n\n".join(b[1] for b, p in zip(page, m, strict=True) if p >= 0.5) for page, m in zip(pages, marks, strict=True)]
            return {
                "page_id": batch.column(0),
                "url": batch.column(2),
                "text": texts,
                "n_chars": [len(t) for t in texts],
                "labels": [[{"block": b[1], "probability": float(p)} for b, p in zip(page, m, strict=True)] for page, m in zip(pages, marks, strict=True)] if with_blocks else None,
            }

        return work

    rows = df.select(F.col(id_col), F.col(html_col), F.col(url_col))
    id_type = rows.schema[0].dataType.simpleString()
    schema = f"page_id {id_type}, url string, text string, n_chars long" + ", labels array<struct<block:string,probability:double>>" * with_blocks
    return arrow_map(rows, schema, make)
