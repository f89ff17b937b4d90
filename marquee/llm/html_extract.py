"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page becomes the sequence of its leaf blocks: runs of text between borders of block-level elements, with the chain of
ancestors. Features are ancestor tags, words of ancestors' class, id and role, and what the text is like. The field has two
labels (rest, main), is trained on labelled pages by maximum likelihood, and is small enough to ship inside a task.

The labelled pages are made by a rule (labelled_pages): no table holds labels for blocks. They cover common layouts with
menus, headers, footers, sidebars, notices, adverts, forms and comments, marked by tags alone, by class names, or both.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches

#: Element names of the HTML standard, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("head iframe noscript script style svg template title".split())
#: An opening tag ends an open element of these names, as the standard's parsing rules say.
ENDS = {**dict.fromkeys("li".split(), {"li"}), **dict.fromkeys("dd dt".split(), {"dd", "dt"}), "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES_P = BLOCK - {"button", "option", "legend", "summary", "title", "head", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A quote opens a value only after =, and the value ends at the same quote however far; without one, at the next ">". Groups are possessive, so that each
#: tag is read once. A tag that the end of the page cuts off is no text, as the standard says.
_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[\"'][^>]*+|[^\s>]++)?+)?+)*+)(>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
#: What these hold is text up to their end tag.
RAW = {name: re.compile(f"</{name}[\\s/>]", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words of class names and ids by what they tell, fixed values.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc topbar toolbar skip",
    "head": "header masthead banner logo branding site",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar aside side widget related recommended trending popular recirc more teaser promo rail sticky tags tag share social follow sharing author bio",
    "note": "cookie cookies consent notice gdpr privacy alert popup modal overlay toast subscribe newsletter signup paywall disclaimer banner message",
    "ad": "ad ads advert adverts advertisement sponsor sponsored dfp adsense promo promoted outbrain taboola",
    "form": "form search login signin register input",
    "talk": "comment comments reply replies respond discussion disqus thread reader readers",
    "main": "article content entry main post body story text prose page paragraph",
}
_HINT = {word: hint for hint, words in HINTS.items() for word in words.split()}


#: Elements whose opening ends others (ENDS) and those that such an end doesn't reach beyond.
_LISTS = frozenset({"ul", "ol", "dl", "table", "select", "menu"})
_SPECIAL = _LISTS.union(*ENDS.values())
_INLINE = frozenset({"a", "b", "strong", "em", "label"})
_INNER = frozenset({"header", "footer", "aside", "nav", "form", "section", "ul"})


class Element:
    """An open element with pointers to its parent, the nearest block and the nearest list part, and what its ancestors tell."""

    __slots__ = ("tag", "hints", "hidden", "parent", "block", "special", "leaf", "found", "inner")

    def __init__(self, tag: str, hints: frozenset, hidden: bool, parent: Element | None):
        self.tag, self.hints, self.hidden, self.parent = tag, hints, hidden, parent
        self.block = self if tag in BLOCK else parent and parent.block
        self.special = self if tag in _SPECIAL else parent and parent.special
        plain = tag not in ("html", "body")
        self.leaf = tag if plain and tag in BLOCK else parent.leaf if parent else "none"
        new = {f"hint={h}" for h in hints}
        if plain and (tag in BLOCK or tag in _INLINE):
            new.add(f"in={tag}")
        #: inner: features of what lies between here and the nearest article or main; None outside of any.
        self.inner = frozenset({"inmain"}) if tag in ("article", "main") else parent and parent.inner
        if self.inner and tag in _INNER:
            self.inner |= {f"inmain+{tag}"}
        have = parent.found if parent else frozenset()
        self.found = have if new <= have else have | new  # as many as there are names of tags and hints, at any depth


class Blocks:
    """Collects (element, text, characters in links) for each leaf block."""

    def __init__(self):
        self.at: Element | None = None
        self.count: Counter = Counter()
        self.out: list[tuple[Element | None, str, int]] = []
        self.text: list[str] = []
        self.linked = 0
        self.hidden = 0

    def border(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.out.append((self.at, text, self.linked))
            self.text, self.linked = [], 0

    def close(self, last: Element) -> None:
        """Close the open elements up to last."""
        while True:
            gone = self.at
            self.at = gone.parent
            self.count[gone.tag] -= 1
            self.hidden -= gone.hidden
            if gone is last:
                return

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.border()
        if tag in CLOSES_P and self.at and self.at.block and self.at.block.tag == "p":
            self.close(self.at.block)
        if tag in ENDS:
            near = self.at and self.at.special
            while near and near.tag not in ENDS[tag] and near.tag not in _LISTS:
                near = near.parent and near.parent.special
            if near and near.tag in ENDS[tag]:
                self.close(near)
        if tag in ("br", "hr", "img"):
            self.text.append(" ")
        if tag in VOID:
            return
        words = set()
        away = tag in HIDDEN
        for name, *values in _ATTRIBUTE.findall(attrs) if attrs else ():
            name = name.lower()
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                words |= {_HINT.get(w.lower()) for w in _TOKEN.findall("".join(values))}
            away |= name == "hidden" or name == "style" and "display:none" in "".join(values).replace(" ", "").lower()
        self.at = Element(tag, frozenset(words - {None}), away, self.at)
        self.count[tag] += 1
        self.hidden += away

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.border()
        if self.count[tag]:
            last = self.at
            while last.tag != tag:
                last = last.parent
            self.close(last)

    def data(self, data: str) -> None:
        if data and not self.hidden:
            if "&" in data:
                data = unescape(data)
            self.text.append(data)
            if self.count["a"]:
                self.linked += len(data.strip())


def leaf_blocks(html: str) -> list[tuple[Element | None, str, int]]:
    page, at = Blocks(), 0
    while tag := _TAG.search(html, at):
        page.data(html[at : tag.start()])
        at = tag.end()
        slash, name, attrs, closed = tag.groups()
        if name and closed:
            name = name.lower()
            if slash:
                page.end(name)
            elif name in RAW:
                end = RAW[name].search(html, at)
                at = end.start() if end else len(html)
                page.border()
            else:
                page.start(name, attrs)
    page.data(html[at:])
    page.border()
    return page.out


#: What a short text can hold, lower case, between spaces where a word must stand alone; fixed values.
_SIGNS = {
    "copyright": ("©", "(c) 1", "(c) 2", "all rights reserved"),
    "cookie": ("cookie", "consent", "privacy", "gdpr", "datenschutz", "confidentialit"),
    "subscribe": ("subscribe", "newsletter", " sign up", " sign in", " login", " log in", "register", "abonn"),
    "share": (" share", " tweet", "follow us", " related", "read more", "read next", "previous", "next page", "advertisement", "sponsored"),
    "reply": (" reply", " comment", " says ", " says:", " wrote:", "posted by", " likes", "kommentar", "antworten"),
}


def features(blocks: list[tuple[Element | None, str, int]]) -> list[list[str]]:
    """Names of the features that each block has."""
    out, n = [], len(blocks)
    for k, (at, text, linked) in enumerate(blocks):
        found = {"bias", f"leaf={at.leaf if at else 'none'}"}
        if at:
            found |= at.found
            found |= at.inner or frozenset()
        words = text.count(" ") + 1
        found.add(f"words={min(6, words.bit_length())}")
        density = linked / max(1, len(text))
        found.add(f"links={0 if density == 0 else 1 if density < 0.3 else 2 if density < 0.8 else 3}")
        found.add(f"stop={text[-1] in '.!?…:;\"»”'}")
        found.add(f"place={min(3, 4 * k // n)}")
        if k == 0 or k == n - 1:
            found.add(f"edge={'first' if not k else 'last'}")
        if words < 40:
            low = f" {text.lower()} "
            found |= {f"sign={name}" for name, parts in _SIGNS.items() if any(p in low for p in parts)}
        out.append(list(found))
    return out


# ---- the field ---------------------------------------------------------------------------------------------------

MAIN = 1
Model = tuple[dict[str, tuple[float, float]], tuple[tuple[float, float], tuple[float, float]]]


def trained(sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 100, rate: float = 0.3, ridge: float = 2e-3) -> Model:
    """Weights by gradient ascent (Adam) on the mean log likelihood with a ridge; forward and backward sums run over all pages at once."""
    names = {f: i for i, f in enumerate(sorted({f for x, _ in sequences for b in x for f in b}))}
    pages, most = len(sequences), max(len(y) for _, y in sequences)
    x = np.zeros((pages, most, len(names)), np.float32)
    y, mask = np.zeros((pages, most), int), np.zeros((pages, most), bool)
    for p, (blocks, labels) in enumerate(sequences):
        for k, found in enumerate(blocks):
            x[p, k, [names[f] for f in found]] = 1
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
    flat, gold = x[mask], np.eye(2)[y]
    both = mask[:, 1:]
    pairs = np.einsum("pka,pkb,pk->ab", gold[:, :-1], gold[:, 1:], both)
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    m, v, beta = [0, 0], [0, 0], (0.9, 0.99)
    logsum = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    for step in range(1, rounds + 1):
        score = np.zeros((pages, most, 2))
        score[mask] = flat @ w
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, most):
            forward[:, k] = np.where(mask[:, k, None], score[:, k] + logsum(forward[:, k - 1, :, None] + t, 1), forward[:, k - 1])
        for k in range(most - 2, -1, -1):
            backward[:, k] = np.where(mask[:, k + 1, None], logsum(t + (score[:, k + 1] + backward[:, k + 1])[:, None, :], 2), 0)
        total = logsum(forward[:, -1], 1)
        belief = np.exp(forward + backward - total[:, None, None])
        edges = np.exp(forward[:, :-1, :, None] + t + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        grads = (flat.T @ (gold - belief)[mask] / pages - ridge * w, (pairs - (edges * both[:, :, None, None]).sum((0, 1))) / pages - ridge * t)
        for i, (param, g) in enumerate(zip((w, t), grads, strict=True)):
            m[i], v[i] = beta[0] * m[i] + (1 - beta[0]) * g, beta[1] * v[i] + (1 - beta[1]) * g * g
            param += rate * (m[i] / (1 - beta[0] ** step)) / (np.sqrt(v[i] / (1 - beta[1] ** step)) + 1e-8) / (1 + 0.02 * step)
    return {f: tuple(w[i].tolist()) for f, i in names.items()}, tuple(map(tuple, t.tolist()))


def decoded(blocks: list[list[str]], model: Model) -> list[int]:
    """The most probable labels (Viterbi)."""
    weights, t = model
    back, best = [], None
    for found in blocks:
        a = b = 0.0
        for f in found:
            if f in weights:
                a, b = a + weights[f][0], b + weights[f][1]
        if best is None:
            best = (a, b)
            continue
        from0, from1 = best[0] + t[0][0] >= best[1] + t[1][0], best[0] + t[0][1] >= best[1] + t[1][1]
        back.append((0 if from0 else 1, 0 if from1 else 1))
        best = (a + (best[0] + t[0][0] if from0 else best[1] + t[1][0]), b + (best[0] + t[0][1] if from1 else best[1] + t[1][1]))
    if best is None:
        return []
    out = [int(best[1] > best[0])]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


# ---- labelled pages ----------------------------------------------------------------------------------------------


def labelled_pages(n: int = 240, seed: int = 7) -> Iterator[tuple[str, list[int]]]:
    """Pages by a rule, with a label for each leaf block (1: main text)."""
    rng = random.Random(seed)
    syllables = "an er in on th ti or re he st en at es le la de un ou ri so".split()

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def line(low: int, high: int, stop: bool = True) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + (rng.choice([".", ".", ".", "!", "?"]) if stop else "")

    for _ in range(n):
        labels: list[int] = []
        marked = rng.random() < 0.6  # class names tell; else tags do
        bare = not marked and rng.random() < 0.2

        def add(html: str, label: int, labels: list[int] = labels) -> str:
            labels.append(label)
            return html

        def box(tag: str, names: str, body: str, marked: bool = marked, bare: bool = bare) -> str:
            plain = "div" if bare or (marked and rng.random() < 0.5) else tag
            return f'<{plain}{f" class={chr(34)}{rng.choice(names.split())}{chr(34)}" if marked or plain != tag else ""}>{body}</{plain}>'

        def links(low: int, high: int) -> str:
            return "<ul>" + "".join(add(f'<li><a href="/{word()}">{line(1, 2, False)}</a></li>', 0) for _ in range(rng.randint(low, high))) + "</ul>"

        def notice() -> str:
            return rng.choice(['<div class="cookie-banner">{}</div>', '<div id="consent">{}</div>', '<div class="notice">{}</div>', '<div role="alert">{}</div>', '<section class="newsletter">{}</section>']).format(
                add(f"<p>{rng.choice(['We use cookies.', 'Subscribe to our newsletter.', line(4, 14)])}</p>", 0)
            )

        def advert() -> str:
            return rng.choice(['<div class="ad">{}</div>', '<aside class="advert">{}</aside>', '<div class="sponsored">{}</div>', '<div id="ad-slot">{}</div>', '<div class="promo">{}</div>']).format(add(line(3, 14), 0))

        def form() -> str:
            return "<form>" + add(f"<label>{line(1, 3, False)}</label>", 0) + "<input name=q>" + add(f"<button>{line(1, 2, False)}</button>", 0) + "</form>"

        def comments() -> str:
            tag, name = rng.choice([("section", "comments"), ("div", "comment-list"), ("div", "reader-comments"), ("ol", "commentlist"), ("div", "discussion")])
            body = add(f"<h3>{rng.choice(['Comments', 'Reader comments', line(1, 3, False)])}</h3>", 0) if rng.random() < 0.6 else ""
            for _ in range(rng.randint(1, 4)):
                inner = add(f"<p>{line(4, 40)}</p>", 0)
                if rng.random() < 0.3:
                    inner = f'<div class="{rng.choice(["comment-body", "comment-text", "comment-content"])}">{inner}</div>'
                body += f'<div class="comment">{inner}</div>' if tag != "ol" else f'<li class="comment">{inner}</li>'
            return f'<{tag} {rng.choice(["class", "id"])}="{name}">{body}</{tag}>'

        def aside() -> str:
            body = add(f"<h3>{line(1, 4, False)}</h3>", 0) if rng.random() < 0.5 else ""
            body += links(2, 5) if rng.random() < 0.6 else add(f"<p>{line(4, 25)}</p>", 0)
            if rng.random() < 0.2:
                body = f'<div class="{rng.choice(["content", "widget-content", "text"])}">{body}</div>'
            return f'<div class="{rng.choice(["sidebar", "related", "widget", "share-tools"])}">{body}</div>' if marked or bare else f"<aside>{body}</aside>"

        def article() -> str:
            body = ""
            title = f"<h1>{line(2, 9, rng.random() < 0.5)}</h1>"
            if rng.random() < 0.9:
                body += add(f"<header>{title}</header>" if rng.random() < 0.15 else title, 1)
            for k in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
                kind = rng.random()
                if kind < 0.08 and k:
                    body += add(f"<h2>{line(1, 6, False)}</h2>", 1)
                elif kind < 0.14:
                    body += "<ul>" + "".join(add(f"<li>{line(1, 20, rng.random() < 0.6)}</li>", 1) for _ in range(rng.randint(2, 5))) + "</ul>"
                elif kind < 0.19:
                    body += "<blockquote>" + add(f"<p>{line(4, 30)}</p>", 1) + "</blockquote>"
                elif kind < 0.22:
                    body += "<table><tr>" + "".join(add(f"<td>{line(1, 4, False)}</td>", 1) for _ in range(4)) + "</tr></table>"
                elif kind < 0.24:
                    body += "<pre>" + add(line(3, 15, False), 1) + "</pre>"
                elif kind < 0.35:
                    body += add(f"<p>{line(1, 5)}</p>", 1)
                elif kind < 0.42:
                    body += add(f'<p>{line(4, 20)} <a href="/{word()}">{line(1, 4, False)}</a> {line(2, 20)}</p>', 1)
                elif kind < 0.47:
                    body += add(f"<p><b>{line(1, 30)}<br>", 1)
                else:
                    body += add(f"<p>{line(6, 90)}</p>", 1)
                if rng.random() < 0.05:
                    body += rng.choice([advert, notice, aside, form])()
            if rng.random() < 0.15:
                body += comments()
            if rng.random() < 0.1:
                body += "<footer>" + add(f"<p>{line(2, 10)}</p>", 0) + "</footer>"
            open_, close = rng.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>")])
            return open_ + body + close

        page = notice() if rng.random() < 0.25 else ""
        if rng.random() < 0.4:
            page += box("header", "header site-header masthead", add(f"<p>{line(1, 5, False)}</p>", 0) + (links(2, 4) if rng.random() < 0.4 else ""))
        if rng.random() < 0.85:
            page += box("nav", "nav menu navbar", links(2, 7))
        for part, chance in ((advert, 0.4), (form, 0.15), (aside, 0.2)):
            page += part() if rng.random() < chance else ""
        page += article()
        for part, chance in ((comments, 0.3), (aside, 0.3), (form, 0.2), (advert, 0.2), (notice, 0.2)):
            page += part() if rng.random() < chance else ""
        if rng.random() < 0.85:
            foot = rng.choice([f"&copy; {word()}.example &middot; {line(3, 12)}", line(3, 15), f"All rights reserved. {line(2, 6)}"])
            page += box("footer", "footer site-footer", add(f"<p>{foot}</p>" if rng.random() < 0.5 else foot, 0) + (links(2, 4) if rng.random() < 0.2 else ""))
        yield f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title><style>p{{margin:0}}</style></head><body><script>var t='</p>';</script>{page}</body></html>", labels


@functools.cache
def default_model() -> Model:
    sequences = []
    for html, labels in labelled_pages():
        blocks = leaf_blocks(html)
        if len(blocks) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        sequences.append((features(blocks), labels))
    return trained(sequences)


def main_text(html: str, model: Model) -> str:
    blocks = leaf_blocks(html)
    labels = decoded(features(blocks), model)
    return "\n".join(text for (_, text, _), label in zip(blocks, labels, strict=True) if label == MAIN)


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html): the main text, blocks joined by line feeds.

    White space inside a block becomes one space. A null or empty html, or a page without main text, gives an empty text.
    Markup that doesn't close is closed where the standard's rules or the end close it. Pages of any length are read whole, in
    time that grows with their length at any depth of nesting. Repeated rows each get a row; other columns are ignored; an
    empty table gives an empty result.
    """
    model = model or default_model()
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            texts = [main_text(h, model) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_batches(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
