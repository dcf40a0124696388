"""Page structure (F41): a tree from an open-element stack, a cascade of selectors, the block with most text. A small helper in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements without an end, elements whose content never counts, selectors in the order of their trial, block elements, length
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
GONE = {"script", "style", "nav", "footer", "header", "aside", "iframe", "noscript"}
SELECTORS = (
    ".BambooHR-ATS-board",
    ".BambooHR-ATS-Description",
    "[data-qa='job-description']",
    ".job-board__description",
    "#jobDescription",
    ".careers-description",
    "main",
    "article",
    "[role='main']",
    ".job-description",
    ".job-details",
    ".job-content",
    ".posting-description",
    "#job-description",
    "#job-details",
    ".description",
    ".content",
    ".main-content",
    "[class*='description']",
    "[class*='job-posting']",
    "[class*='posting-content']",
)
BLOCKS, LONGEST = ("div", "section", "article"), 20_000


class Tree(HTMLParser):
    """Elements in document order: tag, attributes, parent, and the range of text pieces inside.

    An end tag closes its nearest open element and all opened since; one that nothing opened is ignored; what is open at the end is closed there.
    """

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.pieces: list[str] = []
        self._open: list[int] = []
        self._gone = 0  # open elements that don't count
        self.feed(page)
        self.close()
        self._close_from(0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags.append(tag)
        self.attrs.append({} if self._gone or tag in GONE else {k: v or "" for k, v in attrs})
        self.parents.append(self._open[-1] if self._open else -1)
        self.begins.append(len(self.pieces))
        self.ends.append(-2 if self._gone or tag in GONE else -1)  # -2: never chosen
        if tag not in VOID:
            self._open.append(len(self.tags) - 1)
            self._gone += tag in GONE
        elif self.ends[-1] == -1:
            self.ends[-1] = len(self.pieces)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self._open) - 1, -1, -1):
            if self.tags[self._open[at]] == tag:
                self._close_from(at)
                return

    def _close_from(self, at: int) -> None:
        for i in self._open[at:]:
            self._gone -= self.tags[i] in GONE
            if self.ends[i] == -1:
                self.ends[i] = len(self.pieces)
        del self._open[at:]

    def handle_data(self, data: str) -> None:
        if not self._gone and data.strip():
            self.pieces.append(data.strip())

    def first(self, selector: str) -> int | None:
        """The first element that a selector (tag, .class, #id, [attribute='value'], [class*='part']) names."""
        if selector[0] == "[":
            name, value = selector[1:-1].split("=", 1)
            value, part = value.strip("'"), name.endswith("*")
            name = name.rstrip("*")
            test = lambda i: name in self.attrs[i] and (value in self.attrs[i][name] if part else self.attrs[i][name] == value)
        elif selector[0] == ".":
            test = lambda i: selector[1:] in self.attrs[i].get("class", "").split()
        elif selector[0] == "#":
            test = lambda i: self.attrs[i].get("id") == selector[1:]
        else:
            test = lambda i: self.tags[i] == selector
        return next((i for i in range(len(self.tags)) if self.ends[i] >= 0 and test(i)), None)

    def length(self, i: int) -> int:
        return sum(map(len, self.pieces[self.begins[i] : self.ends[i]]))

    def text(self, i: int) -> str:
        return "\n".join(line.strip() for piece in self.pieces[self.begins[i] : self.ends[i]] for line in piece.split("\n") if line.strip())


def posting_of(page: str) -> tuple[str, str] | None:
    """(what was chosen, text): the first selector's element, else the block with most text, else the body; none if there is nothing."""
    tree = Tree(page)
    for selector in SELECTORS:
        i = tree.first(selector)
        if i is not None:
            return selector, tree.text(i)[:LONGEST]
    blocks = [i for i, tag in enumerate(tree.tags) if tag in BLOCKS and tree.ends[i] >= 0]
    i = max(blocks, key=tree.length) if blocks else tree.first("body")  # of equals the first
    return None if i is None else ("largest" if blocks else "body", tree.text(i)[:LONGEST])


@F.pandas_udf(T.StructType([T.StructField("source", T.StringType()), T.StructField("text", T.StringType())]))
def posting(pages: pd.Series) -> pd.DataFrame:
    """a posting's text and how it was found; nulls for null pages and pages without any block or body."""
    found = [None if p is None else posting_of(p) for p in pages]
    return pd.DataFrame({"source": [f and f[0] for f in found], "text": [f and f[1] for f in found]})
