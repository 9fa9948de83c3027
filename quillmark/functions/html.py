"""Text, title, metadata and links of HTML, and robots rules for URLs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BREAKS = frozenset("title p div br li tr h1 h2 h3 h4 h5 h6 table ul ol article section header footer nav body td blockquote pre".split())
_SILENT = frozenset(("script", "style", "noscript", "template"))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.meta, self.links = [], [], {}, []
        self.silent = self.in_title = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
        if tag == "title":
            self.in_title = 1
        if tag in _BREAKS:
            self.parts.append("\n")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "meta" and (a.get("name") or a.get("property")) and a.get("content") is not None:
            self.meta[a.get("name") or a.get("property")] = a["content"]

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "title":
            self.in_title = 0
        if tag in _BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.silent:
            return
        if self.in_title:
            self.title.append(data)
        self.parts.append(data)


def parse(page: str | None) -> tuple[str, str, dict[str, str], list[str]]:
    """(text, title, meta, links); lines are trimmed and empty ones dropped."""
    p = _Page()
    p.feed(page or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(p.title).split()), p.meta, p.links


def extracted(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, content_type, text, title, meta, links of a column of HTML."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(x) for x in pdf[column]]
            yield pd.DataFrame({key: pdf[key], "content_type": "text/html", "text": [r[0] for r in rows], "title": [r[1] for r in rows], "meta": [r[2] for r in rows], "links": [r[3] for r in rows]})

    return pages.select(key, column).mapInPandas(task, f"{key} {dict(pages.dtypes)[key]}, content_type string, text string, title string, meta map<string,string>, links array<string>")


def url_path(url: Column) -> Column:
    """Decoded lower-case path; / if there is none."""
    return F.lower(F.coalesce(F.nullif(F.try_url_decode(F.try_parse_url(url, F.lit("PATH"))), F.lit("")), F.lit("/")))


def robots_allowed(url: Column, rules: list[tuple[str, bool]], mode: str = "RULES") -> Column:
    """The first rule whose prefix starts the path decides; none allows. /robots.txt is always allowed. Disallowing the empty prefix allows."""
    if mode in ("ALLOW_ALL", "ALLOW_NONE"):
        return F.lit(mode == "ALLOW_ALL")
    path = url_path(url)
    out = F.when(path == "/robots.txt", F.lit(True))
    for prefix, allow in rules:
        out = out.when(F.startswith(path, F.lit(prefix)), F.lit(allow or prefix == ""))
    return out.otherwise(F.lit(True))


def parse_robots(text: str, agent: str) -> list[tuple[str, bool]]:
    """Rules of robots.txt for an agent, or else for *; longer names of agents match first."""
    groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
    naming = False
    for line in text.splitlines():
        name, _, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not naming:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            naming = True
        elif name in ("allow", "disallow") and groups:
            naming = False
            groups[-1][1].append((value.lower(), name == "allow"))
    best: tuple[int, list[tuple[str, bool]]] = (-1, [])
    for names, rules in groups:
        for n in names:
            rank = 0 if n == "*" else len(n) if n and n in agent.lower() else -1
            if rank > best[0]:
                best = (rank, rules)
    return best[1]
