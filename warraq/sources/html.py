"""Records of already fetched article listings, by the standard library's HTML parser."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Rule:
    """Where a field stands: a tag with a class (both optional), and the attribute to take, else its text."""

    tag: str = ""
    cls: str = ""
    attr: str = ""
    many: bool = False

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        return (not self.tag or tag == self.tag) and (not self.cls or self.cls in attrs.get("class", "").split())


class _Records(HTMLParser):
    def __init__(self, record: Rule, fields: dict[str, Rule], base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.record, self.fields, self.base = record, fields, base
        self.rows: list[dict[str, list[str]]] = []
        self.stack: list[tuple[str, bool, list[str]]] = []  # tag, whether it opens a record, fields whose text it holds
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        opens = self.record.fits(tag, a)
        if opens:
            self.depth += 1
            self.rows.append({f: [] for f in self.fields})
        held = []
        if self.depth:
            for f, rule in self.fields.items():
                if rule.fits(tag, a):
                    if rule.attr:
                        if rule.attr in a:
                            self.rows[-1][f].append(urljoin(self.base, a[rule.attr]) if rule.attr in ("href", "src") else a[rule.attr])
                    else:
                        self.rows[-1][f].append("")
                        held.append(f)
        if tag not in _VOID:
            self.stack.append((tag, opens, held))

    def handle_endtag(self, tag: str) -> None:
        while any(t == tag for t, _, _ in self.stack):
            t, opens, _ = self.stack.pop()
            self.depth -= opens
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        for _, _, held in self.stack:
            for f in held:
                self.rows[-1][f][-1] += data


def parse_records(html: str | None, record: Rule, fields: dict[str, Rule], base: str = "") -> list[dict[str, list[str]]]:
    """The records of a page, each field as a list of collapsed texts; NULL gives none."""
    parser = _Records(record, fields, base)
    parser.feed(html or "")
    return [{f: [" ".join(v.split()) for v in values] for f, values in row.items()} for row in parser.rows]


def extract_records(pages: DataFrame, record: Rule, fields: dict[str, Rule], html: str = "html", url: str = "url") -> DataFrame:
    """(url, pos, a column for each field): records of fetched pages; fields of many values are arrays, others their first value or NULL."""
    schema = ", ".join(["url string", "pos int", *(f"`{f}` {'array<string>' if r.many else 'string'}" for f, r in fields.items())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for u, h in zip(frame[url], frame[html]):
                for pos, r in enumerate(parse_records(h, record, fields, u or ""), 1):
                    rows.append((u, pos, *(list(dict.fromkeys(v)) if fields[f].many else next((x for x in v if x), None) for f, v in r.items())))
            yield pd.DataFrame(rows, columns=["url", "pos", *fields])

    return pages.select(url, html).mapInPandas(run, schema)


def download_link(view: str) -> str:
    """The download address of a view address."""
    return view.replace("/view/", "/download/")
