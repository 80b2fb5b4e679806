"""Page documents to ordered content blocks and markdown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags whose text is not content, and block types by tag.
HIDDEN = {"script", "style", "template", "noscript"}
BLOCK_TYPES = {
    "title": "title", "h1": "heading1", "h2": "heading2", "h3": "heading3", "h4": "heading4",
    "h5": "heading5", "h6": "heading6", "p": "text", "div": "text", "article": "text", "section": "text",
    "li": "list_item", "pre": "code", "tr": "table_row", "blockquote": "quote",
}
TEXT_LAYER_CHARS = 100

_BLOCKS = "array<struct<block_type:string, text:string>>"
# Bytes of markup that are Python objects at a time (one page at least), whatever the length of an Arrow batch.
SLICE_BYTES = 2_000_000
_MARKUP = r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<[^>]*>"


class _BlockReader(HTMLParser):
    """Collects ``(block_type, text)`` in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self._open = ["text"]
        self._words: list[str] = []
        self._hidden = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._words).split())
        if text:
            self.blocks.append((self._open[-1], text))
        self._words = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden += 1
        elif tag in BLOCK_TYPES:
            self._flush()
            self._open.append(BLOCK_TYPES[tag])
        elif tag == "img":
            self._flush()
            self.blocks.append(("image", dict(attrs).get("src") or ""))
        elif tag in ("br", "td", "th"):
            self._words.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag in BLOCK_TYPES:
            self._flush()
            if BLOCK_TYPES[tag] in self._open[1:]:
                while self._open.pop() != BLOCK_TYPES[tag]:
                    pass

    def handle_data(self, data):
        if not self._hidden:
            self._words.append(data)

    def read(self, html: str) -> list[tuple[str, str]]:
        self.feed(html)
        self.close()
        self._flush()
        return self.blocks


def _read_pages(pages: list[str | None]) -> pa.Array:
    """Blocks of some pages as one Arrow array."""
    found = [_BlockReader().read(html or "") for html in pages]
    flat = [block for blocks in found for block in blocks]
    parts = [pa.array([block[i] for block in flat], pa.string()) for i in (0, 1)]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["block_type", "text"]))


def _page_slices(batch: pa.Array) -> Iterator[pa.Array]:
    """Consecutive pages of a batch with about ``SLICE_BYTES`` of markup."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch), 0), dtype=np.int64))
    first = done = 0
    while first < len(ends):
        stop = max(int(np.searchsorted(ends, done + SLICE_BYTES, side="right")), first + 1)
        yield batch.slice(first, stop - first)
        first, done = stop, int(ends[stop - 1])


def read_batch(batch: pa.Array) -> pa.Array:
    """Blocks of a batch of pages. Each slice becomes Arrow before the next: the objects of a batch never lie there together."""
    return pa.concat_arrays([_read_pages([]), *(_read_pages(part.to_pylist()) for part in _page_slices(batch))])


def page_blocks(html: str | Column) -> Column:
    """Blocks of a page as an array in document order. Only the markup goes to Python."""

    @F.arrow_udf(_BLOCKS)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield read_batch(batch)

    return read(F.col(html) if isinstance(html, str) else html)


def extract_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, block_pos, block_type, text)``."""
    return pages.select(key, F.posexplode(page_blocks(html)).alias("block_pos", "block")).select(
        key, "block_pos", "block.*"
    )


def to_markdown(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One markdown text per page, built inside the row: a page's blocks never leave it."""

    def line(b: Column) -> Column:
        kind, text = b["block_type"], b["text"]
        level = F.regexp_extract(kind, r"^heading(\d)$", 1)
        return (
            F.when(kind == "title", F.concat(F.lit("# "), text))
            .when(level != "", F.concat(F.repeat(F.lit("#"), F.coalesce(level.try_cast("int"), F.lit(1))), F.lit(" "), text))
            .when(kind == "list_item", F.concat(F.lit("- "), text))
            .when(kind == "quote", F.concat(F.lit("> "), text))
            .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
            .when(kind == "table_row", F.concat(F.lit("| "), text, F.lit(" |")))
            .when(kind == "image", F.concat(F.lit("![]("), text, F.lit(")")))
            .otherwise(text)
        )

    blocks = pages.select(key, page_blocks(html).alias("blocks"))
    return blocks.select(key, F.size("blocks").alias("n_blocks"),
                         F.array_join(F.transform("blocks", line), "\n\n").alias("markdown"))


def text_layer(html: str | Column) -> Column:
    """Visible text without markup, white space collapsed."""
    html = F.col(html) if isinstance(html, str) else html
    return F.trim(F.regexp_replace(F.regexp_replace(html, _MARKUP, " "), r"\s+", " "))


def route_pages(pages: DataFrame, html: str = "html", min_chars: int = TEXT_LAYER_CHARS) -> DataFrame:
    """Adds ``text_chars`` and ``route``: ``txt`` where the page has a text layer, else ``ocr``."""
    routed = pages.withColumn("text_chars", F.coalesce(F.length(text_layer(html)), F.lit(0)))
    return routed.withColumn("route", F.when(F.col("text_chars") < min_chars, "ocr").otherwise("txt"))
