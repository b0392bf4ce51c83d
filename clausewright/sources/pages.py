"""Extraction from ruling pages: an HTML walk in Arrow batches, one row a page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ids on a ruling page, the word that belongs in its sections only, and the title of a page without a name.
SECTIONS = {"card_info": "supplement_date", "pen_info": "pen_supplement_date"}
TEXTS = ("card_text", "supplement", "pen_effect", "pen_supplement")
WORD = "補足情報"
NO_NAME = "カードに関連するＱ＆Ａ"

FIELDS = (*TEXTS, *SECTIONS.values())


class Walk(HTMLParser):
    """Open divs are a stack of (what, name): a section, a text in a section, or anything else."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[tuple[str, str]] = []
        self.sink: list[str] | None = None
        self.found: dict[str, str] = {}
        self.title = ""
        self.links = 0
        self.stray: list[str] = []

    def _inner(self, what: str) -> str | None:
        return next((name for w, name in self.stack if w == what), None)

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        text = self._inner("text")
        if tag == "div":
            name = given.get("id", "")
            if not text and not self._inner("section") and name in SECTIONS:
                self.stack.append(("section", name))
            elif not text and self._inner("section") and name in TEXTS:
                self.stack.append(("text", name))
                self.sink = []
            else:
                self.stack.append(("", name))
        elif tag == "br" and text:
            self.sink.append("\n")
        elif tag == "title" or (tag == "span" and not text and self._inner("section") and "update" in given.get("class", "").split()):
            self.sink = []
        elif tag == "a" and "href" in given:
            self.links += 1

    def handle_endtag(self, tag):
        said = "".join(self.sink or ()).strip()
        if tag == "title":
            self.title, self.sink = said, None
        elif tag == "span" and self.sink is not None and not self._inner("text"):
            if said:
                self.found.setdefault(SECTIONS[self._inner("section")], said)
            self.sink = None
        elif tag == "div" and self.stack:
            what, name = self.stack.pop()
            if what == "text":
                if said:
                    self.found[name] = said
                self.sink = None

    def handle_data(self, data):
        if self.sink is not None:
            self.sink.append(data)
        else:
            self.handle_comment(data)

    def handle_comment(self, data):
        if WORD in data and not self._inner("section"):
            self.stray.append(data.strip()[:80])

    def name(self) -> str | None:
        first = self.title.partition(" | ")[0].strip()
        return first if first and first != NO_NAME else None


def walk(html: str | None) -> Walk:
    page = Walk()
    page.feed(html or "")
    page.close()
    return page


def extract(pages: DataFrame, key: str = "cid", html: str = "html") -> DataFrame:
    """key, title, name_ja, links, the texts and dates of a page, and stray: where the word occurs outside the sections. Null where a page has no such part."""
    columns = [key, "title", "name_ja", "links", *FIELDS, "stray"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, p.title, p.name(), p.links, *(p.found.get(f) for f in FIELDS), p.stray) for i, p in zip(batch[key], map(walk, batch[html]), strict=True)]
            yield pd.DataFrame(rows, columns=columns)

    kind = pages.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, title string, name_ja string, links int, " + ", ".join(f"{f} string" for f in FIELDS) + ", stray array<string>"
    return pages.select(key, html).mapInPandas(run, schema)


def supplements(pages: DataFrame) -> DataFrame:
    """Extracted pages that have a card text."""
    return extract(pages).where("card_text IS NOT NULL").drop("title", "links", "stray")


def report(extracted: DataFrame) -> DataFrame:
    """One row of counters: included, no_card_info, no_supplement, pendulum, stray."""
    has = F.col("card_text").isNotNull()
    return extracted.agg(
        F.count_if(has).alias("included"),
        F.count_if(~has).alias("no_card_info"),
        F.count_if(has & F.col("supplement").isNull()).alias("no_supplement"),
        F.count_if(has & F.col("pen_effect").isNotNull()).alias("pendulum"),
        F.coalesce(F.sum(F.size("stray")), F.lit(0)).alias("stray"),
    )
