"""Chunks: character windows, packed paragraphs with overlap, parents and children.

The loops depend on what they have cut before, so they are plain Python, one call a section, run in Arrow batches.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARENT_SIZE, PARENT_OVERLAP, CHILD_SIZE, CHILD_OVERLAP = 1000, 150, 500, 50
_BLANK = re.compile(r"\n\s*\n")


def split_characters(text: str, size: int, overlap: int) -> list[str]:
    """Windows of at most ``size`` characters that end before white space and overlap by about ``overlap``.

    A window also begins behind white space. One that reaches the end is followed by one of the overlap alone, as long as that
    makes progress.
    """
    gaps = [i for i, c in enumerate(text) if c in " \n"]
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            before = bisect.bisect_left(gaps, end) - 1
            if before >= 0 and gaps[before] > start:
                end = gaps[before]
        if piece := text[start:end].strip():
            out.append(piece)
        start = end - overlap if end - overlap > start else end
        inside = bisect.bisect_left(gaps, start)
        if start < n and inside < len(gaps):  # begin behind white space
            start = gaps[inside] + 1
    return out


def overlap_tail(text: str, overlap: int) -> str:
    """The last ``overlap`` characters, back to the start of a word."""
    if overlap <= 0 or not text:
        return ""
    at = max(0, len(text) - overlap)
    while at and not text[at - 1].isspace():
        at -= 1
    return text[at:].strip()


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip() for x in _BLANK.split(text)) if p]


def _joined(head: str, body: str) -> str:
    return f"{head}\n\n{body}".strip() if head else body


def _fitting_tail(last: str, body: str, size: int, overlap: int) -> str:
    """The tail of the last chunk that leaves room for the body, cut by words from its front."""
    tail = overlap_tail(last, min(overlap, max(0, size - len(body) - 2)))
    while tail and len(_joined(tail, body)) > size:
        tail = (tail.split(maxsplit=1)[1:] or [""])[0]
    return tail


def chunk_text(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed into chunks of at most ``size`` characters, each begun with the tail of the one before.

    A paragraph over ``size`` is cut by its own window, with the same size and overlap, and every window is a chunk.
    """
    out: list[str] = []
    held = ""
    for p in paragraphs(text):
        if len(p) > size:
            if held:
                out.append(held.strip())
                held = ""
            windows = split_characters(p, size, overlap)
            if windows and out and overlap > 0 and overlap_tail(out[-1], overlap):
                windows[0] = _joined(_fitting_tail(out[-1], windows[0], size, overlap), windows[0])
            out += windows
            continue
        head = held or (overlap_tail(out[-1], overlap) if out else "")
        if len(_joined(head, p)) > size:
            if held:
                out.append(held.strip())
            head = overlap_tail(out[-1], overlap) if out else ""
            if len(_joined(head, p)) > size:
                head = _fitting_tail(out[-1], p, size, overlap)
        held = _joined(head, p)
    if held:
        out.append(held.strip())
    return out


def _chunk_task(size: int, overlap: int, whole: bool):
    import pandas as pd

    def task(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                text = r.content or ""
                pieces = [text] if whole and text and len(text) <= size else chunk_text(text, size, overlap)
                rows += [(*r[:-1], i, p) for i, p in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=[*frame.columns[:-1], "piece", "content"])

    return task


def chunked(df: DataFrame, keys: list[str], size: int, overlap: int, whole: bool = False) -> DataFrame:
    """keys, piece (from 0) and content for the chunks of ``content``. ``whole``: texts that fit stay as they are."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", piece int, content string"
    return df.select(*keys, "content").mapInPandas(_chunk_task(size, overlap, whole), schema)


def flat_chunks(sections: DataFrame, key: str = "document_id", size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP) -> DataFrame:
    """Chunks with an index over the whole document; the level of untitled preambles is null."""
    out = chunked(sections, [key, "section_index", "title", "level", "page_number"], size, overlap)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("section_index", "piece")) - 1
    out = out.withColumn("chunk_index", nth.cast("int"))
    return out.select(key, F.concat_ws("-", F.col(key).cast("string"), "chunk_index").alias("chunk_id"), "chunk_index", "title", F.nullif("level", F.lit(0)).alias("level"), "page_number", "content")


def parents(sections: DataFrame, key: str = "document_id", name: str | None = None, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP) -> DataFrame:
    """Parent chunks: id, title (``Sección n`` by default), breadcrumb of document and title."""
    kept = [key, "section_index", "title", "level", "page_number"] + ([name] if name else [])
    out = chunked(sections, kept, size, overlap)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("section_index", "piece")) - 1
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Sección "), (F.col("section_index") + 1).cast("string")))
    doc = F.col(name) if name else F.col(key).cast("string")
    out = out.withColumns({"parent_no": nth.cast("int"), "title": title})
    return out.select(
        key, F.concat(F.lit("parent_"), "parent_no").alias("parent_id"), "parent_no", "section_index", "title", F.concat_ws(" > ", doc, "title").alias("breadcrumb"), "content", "page_number", F.col("level").alias("heading_level")
    )


def children(parent_rows: DataFrame, key: str = "document_id", size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Child chunks; a parent that fits is its own only child."""
    out = chunked(parent_rows, [key, "parent_id", "breadcrumb"], size, overlap, whole=True)
    return out.select(key, F.concat("parent_id", F.lit("_child_"), "piece").alias("child_id"), "parent_id", F.col("piece").alias("position"), F.concat(F.lit("["), "breadcrumb", F.lit("]")).alias("breadcrumb"), "content")
