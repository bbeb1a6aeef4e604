"""Page text: capping and cutting into passages. Cutting walks one text at a time, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET, HARD_MAX, TEXT_CAP = 1000, 1200, 20_000
_AFTER_SENTENCE = re.compile(r"[.!?](?=\s)")


def cap_text(c: Column, cap: int = TEXT_CAP) -> Column:
    """At most cap characters: whole paragraphs while they fit, else words of the first one, else its head."""
    paragraphs = F.split(c, "\n")
    # Length of the text up to and with each paragraph, as a running sum.
    upto = F.aggregate(paragraphs, F.array().cast("array<int>"), lambda t, p: F.concat(t, F.array(F.coalesce(F.try_element_at(t, F.lit(-1)) + 1, F.lit(0)) + F.length(p))))
    fit = F.size(F.filter(upto, lambda n: n <= cap))
    head = F.substring(c, 1, cap)
    words = F.regexp_extract(head, r"(?s)^(.+) [^ ]*\z", 1)
    short = F.regexp_replace(F.when(words != "", words).otherwise(head), r"(?U)\s+\z", "")
    return F.when(F.length(c) <= cap, c).when(fit > 0, F.array_join(F.slice(paragraphs, F.lit(1), fit), "\n")).otherwise(short)


class _Blocks(HTMLParser):
    """Paragraph texts of a page that stand outside navigation, forms, tables and scripts; those inside an article or main
    element are told apart."""

    # Element names of the HTML standard.
    OUTSIDE = frozenset("script style nav header footer aside form table noscript template svg select button iframe head".split())
    BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption div section article main body br".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipped: list[str] = []
        self.inside = 0
        self.piece: list[str] = []
        self.found: list[tuple[bool, str]] = []

    def flush(self):
        text = " ".join("".join(self.piece).split())
        self.piece.clear()
        if text:
            self.found.append((self.inside > 0, text))

    def handle_starttag(self, tag, attrs):
        if tag in self.OUTSIDE:
            self.flush()
            self.skipped.append(tag)
        elif tag in self.BLOCK:
            self.flush()
        self.inside += tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        if tag in self.skipped:
            del self.skipped[self.skipped.index(tag) :]
        if tag in ("article", "main"):
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data):
        if not self.skipped:
            self.piece.append(data)


@F.pandas_udf(T.StringType())
def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Readable paragraphs of a page, one a line: those of its article or main element where it has one with text, else all.
    Null for null or for what cannot be read; never raises."""

    def read(page: str) -> str | None:
        blocks = _Blocks()
        try:
            blocks.feed(page)
            blocks.close()
        except (ValueError, AssertionError):  # malformed markup declarations
            return None
        blocks.flush()
        best = [t for inside, t in blocks.found if inside] or [t for _, t in blocks.found]
        return "\n".join(best)

    for s in pages:
        yield s.map(read, na_action="ignore")


def page_outcome(html: Column, min_chars: int = 200, cap: int = TEXT_CAP) -> Column:
    """(status, text): `ok` with the capped main text, or `no_text` where there are fewer than min_chars characters."""
    text = F.coalesce(F.trim(main_text(html)), F.lit(""))
    enough = F.length(text) >= min_chars
    return F.struct(F.when(enough, "ok").otherwise("no_text").alias("status"), F.when(enough, cap_text(text, cap)).alias("text"))


def cut_paragraph(text: str, target: int = TARGET, hard_max: int = HARD_MAX) -> Iterator[str]:
    """Pieces of at most hard_max: cut behind the last sentence that ends by the target, else by the maximum, else at the
    last space, else hard."""
    while len(text) > hard_max:
        ends = [m.end() for m in _AFTER_SENTENCE.finditer(text, 0, hard_max + 1) if m.end() <= hard_max]
        early = [e for e in ends if e < target]
        late = [e for e in ends if e < hard_max]
        at = early[-1] + 1 if early else late[-1] + 1 if late else text.rfind(" ", 0, hard_max + 1)
        if at <= 0:
            at = hard_max
        yield text[:at].rstrip()
        text = text[at:].lstrip()
    if text:
        yield text


def passages_of(text: str, target: int = TARGET, hard_max: int = HARD_MAX) -> list[str]:
    out: list[list[str]] = []
    size = 0
    for paragraph in filter(None, map(str.strip, text.split("\n"))):
        for piece in cut_paragraph(paragraph, target, hard_max):
            if out and size + 1 + len(piece) <= target:
                out[-1].append(piece)
                size += 1 + len(piece)
            else:
                out.append([piece])
                size = len(piece)
    return ["\n".join(p) for p in out]


def split_passages(texts: DataFrame, key: str = "article_id", text: str = "text", target: int = TARGET, hard_max: int = HARD_MAX) -> DataFrame:
    """(key, idx, passage) of every text; empty and null texts have none."""
    if not 1 <= target <= hard_max:
        raise ValueError("need 1 <= target <= hard_max")

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: passages_of(t, target, hard_max), na_action="ignore")

    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(cut(text)).alias("idx", "passage"))
