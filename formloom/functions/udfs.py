"""The Python functions of the library: Arrow batches, only what built-in expressions can't say."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the order of the arguments counts."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: From so many characters on, SequenceMatcher leaves frequent ones of the second string out.
POPULAR = 200


def _in_blocks(a: str, b: str) -> int:
    """Characters of the longest common block, the first in a and then in b, and of those on both sides of it."""
    n, k, at = len(a), 0, 0
    for i in range(n):
        while i + k < n and a[i : i + k + 1] in b:
            k, at = k + 1, i
    if not k:
        return 0
    j = b.index(a[at : at + k])
    return k + (_in_blocks(a[:at], b[:j]) if at and j else 0) + (_in_blocks(a[at + k :], b[j + k :]) if at + k < n and j + k < len(b) else 0)


def similarity(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b).ratio()``, without its indexes for short strings."""
    if len(a) >= POPULAR or len(b) >= POPULAR or not (a or b):
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _in_blocks(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The greater similarity of a name, as it is or with its words turned round, to another; each pair once a batch."""
    known: dict[tuple[str, str], float] = {}

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        turned = " ".join(reversed(x.split(" ")))
        if y in (x, turned):
            return 1.0
        return max(similarity(v, y) for v in {x, turned})

    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = one(*pair)
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfkc(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).replace("’", "'"))


@F.pandas_udf(T.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance between word lists."""

    def one(x: str, y: str) -> int:
        xs, ys = (x or "").split(), (y or "").split()
        row = list(range(len(ys) + 1))
        for i, p in enumerate(xs, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(ys, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


class _Page(HTMLParser):
    """Text of a page, of its main region, its title, and its tables as rows of cell texts."""

    #: Class of the div whose text is the main region.
    REGION = "region-content"

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.region: list[str] = []
        self.titles: list[str] = []
        self.rows: list[list[str]] = []
        self.open: set[str] = set()
        self.depth = 0  # of divs, inside the first region; -1 after it

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "div":
            own = any(k == "class" and self.REGION in (v or "") for k, v in attrs)
            self.depth += self.depth > 0 or (own and self.depth == 0)
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.rows[-1].append("")
        if tag in ("script", "style", "title", "td"):
            self.open.add(tag)

    def handle_endtag(self, tag: str) -> None:
        self.open.discard(tag)
        if tag == "div" and self.depth > 0:
            self.depth = self.depth - 1 or -1

    def handle_data(self, data: str) -> None:
        if self.open & {"script", "style"}:
            return
        if "title" in self.open:
            self.titles.append(data)
            return
        self.text.append(data)
        if self.depth > 0:
            self.region.append(data)
        if "td" in self.open and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


_PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("region", T.StringType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])


@F.pandas_udf(_PAGE)
def html_page(html: pd.Series) -> pd.DataFrame:
    """Title, text, main region (null without one) and table rows (cells squeezed, blank ones dropped) of real-world HTML."""
    out = []
    for source in html:
        page = _Page()
        page.feed(source or "")
        page.close()
        cells = [[c for c in (" ".join(x.split()) for x in row) if c] for row in page.rows]
        out.append((" ".join("".join(page.titles).split()), " ".join(" ".join(page.text).split()), "".join(page.region) if page.depth else None, [r for r in cells if r]))
    return pd.DataFrame(out, columns=["title", "text", "region", "rows"])
