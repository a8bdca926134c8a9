"""Articles of web pages as Markdown: parsing needs state, so this is an Arrow UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TITLE, NO_CONTENT = "Untitled", "*No content available*"
_HIDDEN = frozenset("script style noscript template svg head nav footer aside form iframe button".split())
_BLOCK = frozenset("p div section article main header ul ol table tr blockquote figure figcaption body html".split())
_VOID = frozenset("br hr img input meta link source wbr area base col embed track".split())


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = ""
        self.stack: list[str] = []
        self.hidden = 0
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        at = dict(attributes)
        if tag not in _VOID:
            self.stack.append(tag)
            self.hidden += tag in _HIDDEN
        if self.hidden:
            return
        if tag in _BLOCK:
            self.out.append("\n\n")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "img" and at.get("src"):
            self.out.append(f"![{at.get('alt') or ''}]({at['src']})")
        elif tag == "a":
            self.links.append(at.get("href") or "")
            self.out.append("[" if self.links[-1] else "")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            open_ = self.stack.pop()
            shown = not self.hidden
            self.hidden -= open_ in _HIDDEN
            if shown:
                self._close(open_)
            if open_ == tag:
                break

    def _close(self, tag: str) -> None:
        if tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag in _BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if "title" in self.stack and not self.title:
            self.title = " ".join(data.split())
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(page: str | None, with_title: bool = True) -> str:
    """An article's Markdown under its title: the first article element, else main, else the body."""
    page = page or ""
    for tag in ("article", "main", "body"):
        m = re.search(rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\Z)", page)
        if m:
            break
    head, w = _Writer(), _Writer()
    head.feed(page[: page.lower().find("<body") if "<body" in page.lower() else len(page)] if m else page)
    w.feed(m[1] if m else page)
    w.close()
    while w.stack:  # what the page leaves open
        w.handle_endtag(w.stack[-1])
    lines = [x.strip() if not x.endswith("  ") else x.strip() + "  " for x in "".join(w.out).split("\n")]
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    title = f"# {head.title or NO_TITLE}\n\n" if with_title else ""
    return title + (body + "\n" if body else NO_CONTENT + "\n")


def article_markdown(c: Column, with_title: bool = True) -> Column:
    """to_markdown() of a column; null pages have no content."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: to_markdown(x, with_title))

    return run(c)


def message_parts(c: Column, url: Column) -> Column:
    """Markdown as a list of texts and images in order (structs type, text, url), addresses made absolute; nothing at all is one text
    that says so."""

    def parts(markdown: str | None, base: str | None) -> list[dict]:
        out = []
        for i, x in enumerate(re.split(r"!\[.*?\]\((.*?)\)", markdown or "")):
            if i % 2:
                out.append({"type": "image_url", "text": None, "url": urljoin(base or "", x.strip())})
            elif x.strip():
                out.append({"type": "text", "text": x.strip(), "url": None})
        return out or [{"type": "text", "text": "No content available", "url": None}]

    @F.pandas_udf("array<struct<type:string,text:string,url:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([parts(x, y) for x, y in zip(a, b, strict=True)])

    return run(c, url)
