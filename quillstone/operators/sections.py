"""Sections of documents: Markdown headings, text headings, page markers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
# fixed values
_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)[.)]?\s+\S")
_LABEL = re.compile(r"^(?:cap[ií]tulo|secci[oó]n|chapter|section)\s+\w+", re.IGNORECASE)

SECTION = "section_index int, title string, level int, content string, page_number int"


def markdown_sections(text: str) -> Iterator[tuple]:
    """(index, title, level, content, page): a heading's title is the path of the headings above it.

    What stands before the first heading is a section of level 0 without title, if it is not blank; sections
    without content stay.
    """
    path: dict[int, str] = {}
    title, level, body, n = None, 0, [], 0
    for line in [*text.split("\n"), None]:
        m = _HEADING.match(line.strip()) if line is not None else None
        if line is None or m:
            content = "\n".join(body).strip()
            if level or content:
                yield n, title, level, content, None
                n += 1
            if m:
                level = len(m[1])
                path = {k: v for k, v in path.items() if k < level} | {level: m[2].strip()}
                title, body = " > ".join(path[k] for k in sorted(path)), []
        else:
            body.append(line)


def _text_level(line: str) -> int:
    s = line.strip()
    if not s or len(s) >= 80:
        return 0
    if m := _NUMBERED.match(s):
        return m[1].count(".") + 1
    if _LABEL.match(s) or (len(s) > 3 and s.isupper()):
        return 1
    return 0


def text_sections(text: str, whole: bool = True) -> Iterator[tuple]:
    """Sections by short lines that are numbered, labelled or in capitals; those without content go; one at least.

    A title is the path of the headings above, as in Markdown. ``whole``: headings without any content are the content of
    the one section left, else it is empty.
    """
    path: dict[int, str] = {}
    title, level, body, out = None, 0, [], []
    for line in [*text.split("\n"), None]:
        found = _text_level(line) if line is not None else 0
        if line is None or found:
            content = "\n".join(body).strip()
            if content:
                out.append((title, level, content))
            if line is not None:
                path = {k: v for k, v in path.items() if k < found} | {found: line.strip()}
                title, level, body = " > ".join(path[k] for k in sorted(path)), found, []
        else:
            body.append(line)
    if not out:
        out.append((None, 0, text.strip() if whole else ""))
    for n, (title, level, content) in enumerate(out):
        yield n, title, level, content, None


def _sections_udf(function):
    import pandas as pd

    def task(frames):
        for frame in frames:
            rows = [(r.key, *s) for r in frame.itertuples() for s in function(r.text or "")]
            yield pd.DataFrame(rows, columns=["key", "section_index", "title", "level", "content", "page_number"])

    return task


def _apply(df: DataFrame, key: str, text: str, function) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(_sections_udf(function), f"key {kind}, {SECTION}").withColumnRenamed("key", key)


def parse_markdown(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    return _apply(df, key, text, markdown_sections)


def parse_text(df: DataFrame, key: str = "document_id", text: str = "text", whole: bool = True) -> DataFrame:
    return _apply(df, key, text, partial(text_sections, whole=whole))


PAGE_MARK = r"\[PÁGINA (\d+)\]"


def parse_pages(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """Sections by ``[PÁGINA n]`` marks, without title and of level 0; empty pages go. A text without marks is one section.

    Built-in functions only.
    """
    numbers = F.regexp_extract_all(F.col(text), F.lit(PAGE_MARK), F.lit(1))
    bodies = F.slice(F.split(text, PAGE_MARK, -1), 2, 1 << 30)
    pages = df.select(key, F.posexplode(F.arrays_zip(numbers.alias("n"), bodies.alias("body"))).alias("at", "p"))
    pages = pages.select(key, "at", F.col("p.n").cast("int").alias("page_number"), F.btrim("p.body", F.lit(" \t\r\n")).alias("content")).filter("content <> ''")
    index = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    none = F.lit(None)
    pages = pages.select(key, index.cast("int").alias("section_index"), none.cast("string").alias("title"), F.lit(0).alias("level"), "content", "page_number")
    whole = df.filter(F.size(F.regexp_extract_all(F.col(text), F.lit(PAGE_MARK), F.lit(1))) == 0)
    return pages.union(whole.select(key, F.lit(0), none.cast("string"), F.lit(0), F.btrim(text, F.lit(" \t\r\n")), none.cast("int")))


def is_markdown(name: Column, text: Column) -> Column:
    """Markdown files, and PDF text without page marks."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return ext.isin(".md", ".markdown") | ((ext == ".pdf") & ~text.rlike(PAGE_MARK))


def detect_sections(df: DataFrame, key: str = "document_id", name: str = "name", text: str = "text") -> DataFrame:
    """Every document's sections by its kind: Markdown, pages, or plain text."""
    md, paged = is_markdown(F.col(name), F.col(text)), F.col(text).rlike(PAGE_MARK)
    columns = [key, "section_index", "title", "level", "content", "page_number"]
    parts = [parse_markdown(df.filter(md), key, text), parse_pages(df.filter(~md & paged), key, text), parse_text(df.filter(~md & ~paged), key, text)]
    return parts[0].select(*columns).union(parts[1].select(*columns)).union(parts[2].select(*columns))


def keep_sections(sections: DataFrame, key: str = "document_id", markdown: bool = False) -> DataFrame:
    """Clean titles and contents, then drop noise under the safeguards. Markdown markers go if the source is Markdown; empty titles are null."""
    from ..functions import text as T
    from .noise import filter_sections

    cleaned = sections.withColumns({"title": F.nullif(T.clean_title(F.col("title"), markdown), F.lit("")), "content": T.clean_text(F.col("content"), markdown)})
    return filter_sections(cleaned, key)
