"""Pages as arrays of their elements and strings: a small parser, and columns that climb and read them.

The parser only lists what a page holds. Which ancestor is a card, what its title is and so on is DataFrame work on the arrays.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ancestors that a link or a time knows, nearest first.
CLIMB = 10
#: Element names of the HTML standard, fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style template".split())
#: What an opening tag ends, and the elements it doesn't reach out of; names of the HTML standard, fixed values.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "caption"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "caption"), "tfoot": ("tbody", "thead"), "thead": ("caption",)}
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
_CELLS = frozenset("table caption td th button template".split())
SCOPES = {"li": ("ul", "ol", "menu", "table"), "dd": ("dl", "table"), "dt": ("dl", "table"), "option": ("select",), "optgroup": ("select",), **dict.fromkeys("tr tbody tfoot thead".split(), ("table",)), **dict.fromkeys(("td", "th"), ("table", "tr"))}
#: Elements before which an open paragraph ends; names of the HTML standard, fixed values.
_ENDS_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
NODE = "struct<i int, tag string, cls string, href string, at string, upto int, first int, last int, path array<int>>"
PAGE = f"struct<nodes array<{NODE}>, strings array<string>>"


class _Tree(HTMLParser):
    """Elements in page order, each with the strings from first to last and its descendants up to upto.

    An opening tag ends the elements of ENDS and open paragraphs, an end tag what is open inside its element; neither reaches
    out of the scopes of SCOPES. Places of the open elements are kept by name, so that a page takes time by its length only.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.strings: list[str] = []
        self.open: list[dict] = []
        self.at: dict[str, list[int]] = {}  # places in open by name, the innermost last

    def _place(self, names: tuple[str, ...] | frozenset[str]) -> int:
        place = -1
        for n in names:
            at = self.at.get(n)
            if at and at[-1] > place:
                place = at[-1]
        return place

    def handle_starttag(self, tag, attrs):
        for ended, scope in ((ENDS.get(tag, ()), SCOPES.get(tag, ())), (("p",) if tag in _ENDS_P else (), _CELLS)):
            place = self._place(ended)
            if place >= 0 and place > self._place(scope):
                self._close(place)
        found = dict(attrs)
        path = [n["i"] for n in self.open[: -CLIMB - 1 : -1]] if "href" in found or "datetime" in found else []
        node = {"i": len(self.nodes), "tag": tag, "cls": found.get("class") or "", "href": found.get("href"), "at": found.get("datetime"), "upto": 0, "first": len(self.strings), "last": 0, "path": path}
        self.nodes.append(node)
        if tag in _VOID:
            node["upto"], node["last"] = len(self.nodes), len(self.strings)
        else:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _close(self, place: int) -> None:
        """Close what is open from a place on."""
        while len(self.open) > place:
            node = self.open.pop()
            self.at[node["tag"]].pop()
            node["upto"], node["last"] = len(self.nodes), len(self.strings)

    def handle_endtag(self, tag):
        place = self._place((tag,))
        if place >= 0 and place > (-1 if tag in _TABLE else self._place(_CELLS)):
            self._close(place)

    def handle_data(self, data):
        data = " ".join(data.split())
        if data and not (self.open and self.open[-1]["tag"] in _SILENT):
            self.strings.append(data)

    def page(self) -> dict:
        self.close()
        self._close(0)
        return {"nodes": self.nodes, "strings": self.strings}


class _Anchors(HTMLParser):
    """Targets of the anchors of a page, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.hrefs += [v for k, v in attrs if k == "href" and v is not None][:1]


def _tree(html: str | None) -> dict:
    tree = _Tree()
    tree.feed(html or "")
    return tree.page()


def _parsed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_tree(x) for x in html], columns=["nodes", "strings"])


def parsed(html: Column | str) -> Column:
    """nodes and strings of a page; a null page has none."""
    return F.pandas_udf(_parsed, PAGE)(html)


def _hrefs(html: pd.Series) -> pd.Series:
    def of(page: str | None) -> list[str]:
        found = _Anchors()
        found.feed(page or "")
        found.close()
        return found.hrefs

    return pd.Series([of(h) for h in html], dtype=object)


def hrefs(html: Column | str) -> Column:
    """Targets of a page's anchors in page order, however they are quoted; what scripts and comments hold is none."""
    return F.pandas_udf(_hrefs, "array<string>")(html)


def _join(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href or "")
    except ValueError:
        return None


def _absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def absolute(base: Column | str, href: Column | str) -> Column:
    """href resolved against base, `../` and the like too; null if it is no URL."""
    return F.pandas_udf(_absolute, "string")(base, href)


def _absolute_all(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([[_join(b, h) for h in (hs if hs is not None else [])] for b, hs in zip(base, hrefs, strict=True)], dtype=object)


def absolute_all(base: Column | str, hrefs: Column | str) -> Column:
    return F.pandas_udf(_absolute_all, "array<string>")(base, hrefs)


def markdown_lines(html: Column | str, url: Column | str) -> Column:
    """Strings of a page, one line each; a link with a label is one line `[label](absolute url)`."""
    return F.pandas_udf(_markdown_lines, "array<string>")(html, url)


def _markdown_lines(html: pd.Series, url: pd.Series) -> pd.Series:
    def of(page, base):
        tree, out, at = _tree(page), [], 0
        for n in tree["nodes"]:
            if n["tag"] == "a" and n["href"] and n["first"] >= at and n["last"] > n["first"]:
                out += tree["strings"][at : n["first"]]
                out.append(f"[{' '.join(tree['strings'][n['first'] : n['last']])}]({_join(base, n['href'])})")
                at = n["last"]
        return out + tree["strings"][at:]

    return pd.Series([of(h, u) for h, u in zip(html, url, strict=True)], dtype=object)


def text_of(strings: Column, node: Column) -> Column:
    """The strings of an element, joined by spaces."""
    return F.array_join(F.slice(strings, node["first"] + 1, node["last"] - node["first"]), " ")


def within(nodes: Column, block: Column) -> Column:
    """The elements inside a block, in page order."""
    return F.slice(nodes, block["i"] + 2, block["upto"] - block["i"] - 1)
