"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between two block-level tags. Every block has a tag path (names, classes,
ids and roles of the open elements) and words; both are hashed to short vectors. A bidirectional LSTM in
numpy reads the blocks of the whole page in order and labels each one as main text or not.

The network is trained here, when first used, on ``TRAINING_PAGES`` pages that are written by a generator of
layouts, for which the label of every block is known: main text in containers of various names among menus,
headers, footers, side columns, notices, adverts, forms and reader comments, in well-formed and in broken
markup. The words in them are made up, so it cannot learn the topics of a corpus. Training
takes a few seconds, its seed is fixed, and the weights (about 65,000 numbers) are sent to the tasks.

Defined results: a null or empty page gives an empty text; repeated rows repeat; an empty table gives no
rows; scripts, styles, comments and the head are markup and never blocks; bytes beyond a broken tag are text. Kept
columns pass through; one named ``text`` or ``n_chars`` is replaced. Pages are read whole.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fenestra.llm.common import ship, slices, with_fields

ship(__name__)

TRAINING_PAGES = 1_000
EPOCHS = 8
SEED = 11
HIDDEN = 24
PATH_DIM, WORD_DIM, SHAPE_DIM = 256, 32, 6
INPUTS = PATH_DIM + WORD_DIM + SHAPE_DIM
#: Pages that go through the network together, and their blocks with padding; a page alone may have more.
PAGES_AT_ONCE, BLOCKS_AT_ONCE = 64, 8_192
#: Words whose hash a task remembers; beyond it the memory starts anew.
REMEMBERED = 200_000

# Fixed values of HTML: elements without an end tag, elements that stand in a line of text (formulas among them), elements whose
# text is no text, and elements that end when one of the same kind begins.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr math maction mfrac mi mn mo mover mroot mrow ms mspace msqrt "
                 "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
HIDDEN_TEXT = frozenset("script style template noscript title textarea svg iframe object head".split())
#: Elements that may stand in a head; any other one, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
RAW_TEXT = frozenset("script style textarea title".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Elements that name a part of the page by themselves; others do by a class, id or role.
PARTS = frozenset("article main nav header footer aside form fieldset section".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PIECE = re.compile(r"[a-z]+")


def _path_words(tag: str, attributes: str) -> tuple[str, ...]:
    named = "" if "=" not in attributes else " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
    return (tag, *[f".{w}" for w in _PIECE.findall(named.lower())])


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path words, text, characters inside links) of every block with text, in page order.

    The path words are those of all open elements, then again those of the innermost named one.
    """
    page = page or ""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, at, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            inner = next((words for tag, words in reversed(stack) if len(words) > 1 or tag in PARTS), ())
            path = tuple(w for _, words in stack for w in words)
            out.append((path + tuple(f">{w}" for w in inner), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def push_text(raw: str) -> None:
        nonlocal linked
        if hidden and stack[-1][0] == "head" and raw.strip():
            pop(len(stack) - 1)
        if raw and not hidden:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(tag == "a" for tag, _ in stack[-3:]):
                linked += len(text)

    def pop(upto: int) -> None:
        nonlocal hidden
        while len(stack) > upto:
            tag, _ = stack.pop()
            hidden -= tag in HIDDEN_TEXT

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            push_text(page[at:])
            break
        push_text(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if hidden and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag == "body":
            for i, (name, _) in enumerate(stack):
                if name == "head":
                    pop(i)
                    break
        elif tag in SELF_CLOSING or tag not in INLINE:
            # a new block ends an open paragraph; a new item ends the item before it
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or (name == tag and tag in SELF_CLOSING):
                    pop(i)
                    break
                if name not in INLINE:
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        stack.append((tag, _path_words(tag, m[3])))
        hidden += tag in HIDDEN_TEXT
        if tag in RAW_TEXT:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            pop(len(stack) - 1)
    flush()
    return out


class Vectors:
    """Input vectors of blocks; remembers hashes of words and vectors of paths."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def word(self, w: str) -> int:
        at = self.words.get(w)
        if at is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            at = self.words[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % WORD_DIM
        return at

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        vector = self.paths.get(path)
        if vector is None:
            if len(self.paths) >= REMEMBERED:
                self.paths.clear()
            vector = np.zeros(PATH_DIM)
            for w in set(path) - {"html", "body"}:
                # two signed places for each word, so that words rarely look alike
                h, half = zlib.crc32(w.encode("utf-8", "replace")), PATH_DIM // 2
                base = half if w[0] == ">" else 0
                vector[base + h % half] += 1.0
                vector[base + (h >> 8) % half] += 1.0 if h >> 31 else -1.0
            self.paths[path] = vector
        return vector

    def page(self, found: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
        x = np.zeros((len(found), INPUTS))
        for i, (path, text, linked) in enumerate(found):
            words = text.split()
            x[i, :PATH_DIM] = self.path(path)
            counts = np.bincount([self.word(w) for w in words], minlength=WORD_DIM)
            x[i, PATH_DIM:PATH_DIM + WORD_DIM] = counts / np.sqrt(counts @ counts)
            x[i, PATH_DIM + WORD_DIM:] = (np.log1p(len(words)) / 4, linked / len(text), min(text.count(".") / 4, 2),
                                          len(path) / 16, i / len(found), text[-1] in ".!?:;")
        return x


Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _initial(rng: np.random.Generator) -> Weights:
    w: Weights = {}
    for d in ("f", "b"):
        w[f"x{d}"] = rng.normal(0, INPUTS ** -0.5, (INPUTS, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
        w[f"c{d}"] = np.zeros(4 * HIDDEN)
        w[f"c{d}"][HIDDEN:2 * HIDDEN] = 1.0  # remember at first
    w["out"] = rng.normal(0, 0.1, 2 * HIDDEN)
    w["in"] = np.zeros(INPUTS)
    w["bias"] = np.zeros(1)
    return w


def _run(w: Weights, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction over (pages, steps, inputs); masked steps leave the state as it is."""
    pages, steps, _ = x.shape
    h = c = np.zeros((pages, HIDDEN))
    gates_in = x @ w[f"x{d}"] + w[f"c{d}"]
    out, trace = np.zeros((pages, steps, HIDDEN)), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = gates_in[:, t] + h @ w[f"h{d}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[:, t, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep:
            trace.append((t, i, f, o, g, h, c, tanh, m))
        c = m * new + (1 - m) * c
        h = m * (o * tanh) + (1 - m) * h
        out[:, t] = h
    return out, trace


def scores(w: Weights, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Log-odds that each block is main text."""
    forward, backward = _run(w, "f", x, mask, False)[0], _run(w, "b", x, mask, False)[0]
    return np.concatenate([forward, backward], axis=2) @ w["out"] + x @ w["in"] + w["bias"]


def _gradients(w: Weights, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> Weights:
    """Gradients of the mean logistic loss, back through time in both directions."""
    (hf, tf), (hb, tb) = _run(w, "f", x, mask, True), _run(w, "b", x, mask, True)
    both = np.concatenate([hf, hb], axis=2)
    error = (_sigmoid(both @ w["out"] + x @ w["in"] + w["bias"]) - y) * mask / mask.sum()
    grads: Weights = {"out": np.einsum("pt,pth->h", error, both), "bias": np.array([error.sum()]),
                      "in": np.einsum("pt,pti->i", error, x)}
    for d, trace, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, None))):
        back = error[:, :, None] * w["out"][part]
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        gh = np.zeros_like(w[f"h{d}"])
        dh = dc = np.zeros((len(x), HIDDEN))
        for t, i, f, o, g, h, c, tanh, m in reversed(trace):
            dh = dh + back[:, t]
            new_h, new_c = m * dh, m * dc + m * dh * o * (1 - tanh ** 2)
            dz = np.concatenate([new_c * g * i * (1 - i), new_c * c * f * (1 - f), new_h * tanh * o * (1 - o),
                                 new_c * i * (1 - g ** 2)], axis=1)
            dz_all[:, t] = dz
            gh += h.T @ dz
            dh = (1 - m) * dh + dz @ w[f"h{d}"].T
            dc = (1 - m) * dc + new_c * f
        grads[f"h{d}"], grads[f"x{d}"] = gh, np.einsum("pti,ptk->ik", x, dz_all)
        grads[f"c{d}"] = dz_all.sum(axis=(0, 1))
    return grads


# Names under which the layouts hold main text and everything else.
_MAIN = ["article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div#story", "section.post-body",
         "div.main-text", "article.post", "main#content", "div.page-content", "td.text", "div.entry", "div#main"]
_OTHER = {
    "menu": ["nav", "ul.menu", "div.nav", "div#navigation", "div.breadcrumb", "nav.main-menu", "div.menu", "ul.nav", "div.toolbar"],
    "header": ["header", "div.header", "div#masthead", "header.site-header", "div.top-bar", "div.logo"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal"],
    "side": ["aside", "div.sidebar", "div#sidebar", "div.related", "aside.widget", "div.widget", "div.recommended", "section.more"],
    "notice": ["div.cookie-notice", "div.notice", "div#consent", "div.banner", "div.alert", "div.gdpr", "div.popup", "div.notification"],
    "advert": ["div.ad", "div.advert", "div.ads", "div.sponsored", "div#ad", "div.promo", "ins.adsbygoogle", "div.advertisement", "section.sponsor"],
    "form": ["form", "div.newsletter", "form.search", "div.subscribe", "div.login", "fieldset", "form#signup"],
    "comments": ["div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment", "div.replies", "section#disqus",
                 "div.reader-comments", "div.discussion"],
    "share": ["div.share", "div.social", "ul.share-buttons", "div.tags", "div.meta-links"],
}
_SAID = {"footer": "© copyright all rights reserved", "notice": "we use cookies accept privacy policy", "form": "search email subscribe sign up",
         "comments": "reply said posted comment", "menu": "home about contact", "advert": "sponsored advertisement buy now",
         "share": "share tweet print", "side": "related popular read more", "header": "logo welcome"}


def _written_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of the generator, and for each of its blocks whether it is main text."""
    pick = lambda values: values[int(rng.integers(len(values)))]
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    word = lambda: "".join(letters[k] for k in rng.integers(0, len(letters), int(rng.integers(1, 11))))
    labels: list[bool] = []

    def sentence(least: int, most: int, extra: str = "") -> str:
        words = [word() for _ in range(int(rng.integers(least, most)))] + (extra.split() if rng.random() < 0.4 else [])
        return " ".join(np.array(words, object)[rng.permutation(len(words))]).capitalize() + pick([".", "", ".", "!"])

    def wrapped(name: str, inner: str) -> str:
        tag, _, rest = re.match(r"(\w+)([.#])?(.*)", name).groups()
        kind = "id" if "#" in name else "class"
        close = f"</{tag}>" if rng.random() < 0.97 or tag in ("td",) else ""
        return f"<{tag}" + (f' {kind}="{rest}"' if rest else "") + f">{inner}{close}"

    def other(kind: str) -> str:
        said = _SAID[kind]
        if kind == "menu" or rng.random() < 0.2:
            n = int(rng.integers(2, 9))
            labels.extend([False] * n)
            items = "".join(f'<li><a href="/{word()}">{sentence(1, 3, "")}</a>' + pick(["</li>", "</li>", ""]) for _ in range(n))
            inner = f"<ul>{items}</ul>"
        else:
            n = int(rng.integers(1, 4 if kind != "comments" else 7))
            labels.extend([False] * n)
            most = 40 if kind in ("comments", "side", "advert") else 14
            tags = [pick(["p", "div", "p", "h3", "label" if n == 1 else "p"]) for _ in range(n)]
            inner = "".join(f"<{t}>{sentence(2, most, said)}</{t}>" for t in tags) if n > 1 or rng.random() < 0.5 else sentence(2, most, said)
        return wrapped(pick(_OTHER[kind]), inner)

    def main_text() -> str:
        out = ""
        if rng.random() < 0.85:
            labels.append(True)
            out += f"<{(t := pick(['h1', 'h1', 'h2']))}>{sentence(2, 12)}</{t}>"
        for _ in range(int(rng.integers(1, 12))):
            r = rng.random()
            if r < 0.08:
                out += other(pick(["advert", "share", "side", "form", "notice"]))
                continue
            labels.append(True)
            text = sentence(1, 4) if rng.random() < 0.2 else " ".join(sentence(2, 24) for _ in range(int(rng.integers(1, 5))))
            if r < 0.2:  # broken: an inline element and the paragraph stay open
                out += f"<p><b>{text}<br>"
            elif r < 0.28:
                out += f"<ul><li>{text}</li></ul>"
            elif r < 0.34:
                out += f"<blockquote>{text}</blockquote>"
            elif r < 0.4:
                out += f'<p>{text[:9]}<a href="/x">{text[9:30]}</a>{text[30:]}</p>'
            elif r < 0.5:
                out += f"<{(t := pick(['h2', 'h3', 'td', 'div', 'pre']))}>{text}</{t}>" if rng.random() < 0.6 else f"<p>{text}"
            else:
                out += f"<p>{text}</p>"
        if rng.random() < 0.1:
            out += other("comments")
        return out

    before = [k for k in ("header", "menu", "notice", "advert", "side", "form") if rng.random() < 0.5]
    after = [k for k in ("share", "comments", "side", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.5]
    body = "".join(other(k) for k in before)
    name = pick(_MAIN)
    middle = wrapped(name, main_text()) if rng.random() > 0.03 else ""
    if name.startswith("td"):
        middle = f"<table><tr>{middle}</tr></table>"
    body += middle + "".join(other(k) for k in after)
    for _ in range(int(rng.integers(0, 2))):
        body = wrapped(pick(["div.wrapper", "div#page", "div.container", "div.site", "div.row"]), body)
    return f"<html><head><title>{word()}</title></head><body>{body}</body></html>", labels


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((len(pages), longest, INPUTS)), np.zeros((len(pages), longest))
    for i, p in enumerate(pages):
        x[i, :len(p)], mask[i, :len(p)] = p, 1.0
    return x, mask


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """The network's weights: Adam on generated pages, in batches of pages of like length."""
    rng = np.random.default_rng(seed)
    vectors, data = Vectors(), []
    while len(data) < pages:
        page, labels = _written_page(rng)
        found = blocks(page)
        if len(found) == len(labels):  # in broken markup blocks may merge; their label is then unknown
            data.append((vectors.page(found), np.array(labels, float)))
    data.sort(key=lambda d: len(d[0]))
    w, size = _initial(rng), 16
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        for start in rng.permutation(range(0, pages, size)):
            group = data[start:start + size]
            x, mask = _padded([d[0] for d in group])
            y = np.zeros(mask.shape)
            for i, (_, labels) in enumerate(group):
                y[i, :len(labels)] = labels
            step += 1
            for k, g in _gradients(w, x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.01 * 0.8 ** epoch / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                w[k] = w[k] - rate * first[k] / (1 - 0.9 ** step)
    return w


def label(w: Weights, pages: list[list[tuple]], vectors: Vectors) -> list[np.ndarray]:
    """Per page, which of its blocks are main text; pages of like length share a run of the network."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    start = 0
    while start < len(order):
        upto = start + 1
        while upto < len(order) and upto - start < PAGES_AT_ONCE and (upto + 1 - start) * len(pages[order[upto]]) <= BLOCKS_AT_ONCE:
            upto += 1
        part, start = order[start:upto], upto
        odds = scores(w, *_padded([vectors.page(pages[i]) for i in part]))
        for row, i in zip(odds, part):
            out[i] = row[:len(pages[i])] > 0
    return out


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """The kept columns, ``text`` (main blocks joined by an empty line) and ``n_chars``; one narrow pass."""
    shared = pages.sparkSession.sparkContext.broadcast(trained() if weights is None else weights)
    schema = with_fields(pages, keep, "text string, n_chars bigint")
    carried = [c for c in schema.names if c not in ("text", "n_chars")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in slices(batches):
            found = [blocks(p) for p in batch.column(len(carried)).to_pylist()]
            texts = ["\n\n".join(b[1] for b, k in zip(page, kept) if k)
                     for page, kept in zip(found, label(shared.value, found, vectors))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carried)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*carried, "text", "n_chars"])

    columns = [F.col(f"`{c}`") for c in carried]
    return pages.select(*columns, F.col(f"`{html_col}`").alias("_html")).mapInArrow(task, schema)
