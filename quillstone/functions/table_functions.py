"""Sections and chunks as table functions of Spark SQL, for ``LATERAL`` joins.

``text_sections(text [, kind])`` and ``text_chunks(text [, size, overlap])`` take a text; ``table_chunks(TABLE(...), text, size, overlap)`` takes a table
and passes its columns through, so its schema follows from what it is given. All check their arguments when a query is analysed,
before anything runs. A row is handled by itself, so nothing is shuffled.

Null texts have one empty section, as in :func:`quillstone.operators.sections.parse_text`, and no chunks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, IntegralType, NullType, StringType, StructField, StructType

from ..operators.chunking import PARENT_OVERLAP, PARENT_SIZE, chunk_text
from ..operators.sections import markdown_sections, text_sections

SECTION = StructType(
    [StructField("section_index", IntegerType()), StructField("title", StringType()), StructField("level", IntegerType()), StructField("content", StringType()), StructField("page_number", IntegerType())]
)
KINDS = {"text": text_sections, "markdown": markdown_sections}


def _text(name: str, argument: AnalyzeArgument) -> None:
    if argument.isTable or not isinstance(argument.dataType, (StringType, NullType)):
        raise ValueError(f"{name} must be a text")


def _sizes(size: AnalyzeArgument | None, overlap: AnalyzeArgument | None) -> None:
    for name, a in (("size", size), ("overlap", overlap)):
        if a is not None and not (a.isConstantExpression and isinstance(a.dataType, IntegralType) and a.value is not None):
            raise ValueError(f"{name} must be a constant whole number")
    width, lap = size.value if size else PARENT_SIZE, overlap.value if overlap else PARENT_OVERLAP
    if width < 1 or not 0 <= lap <= width:
        raise ValueError("size must be positive, and overlap between 0 and size")


class TextSections:
    """(section_index, title, level, content, page_number) of a text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text("text", text)
        if kind is not None and (not kind.isConstantExpression or kind.value not in KINDS):
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        return AnalyzeResult(SECTION)

    def eval(self, text: str | None, kind: str = "text"):
        yield from KINDS[kind](text or "")


class TextChunks:
    """(piece, chunk) of a text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text("text", text)
        _sizes(size, overlap)
        return AnalyzeResult(StructType([StructField("piece", IntegerType()), StructField("chunk", StringType())]))

    def eval(self, text: str | None, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP):
        yield from enumerate(chunk_text(text or "", size, overlap))


class TableChunks:
    """All columns of a table, and piece and chunk of its column ``text``; names that clash get an underscore."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a TABLE")
        if not text.isConstantExpression or text.value not in rows.dataType.names:
            raise ValueError(f"text must name a column: {', '.join(rows.dataType.names)}")
        if not isinstance(rows.dataType[text.value].dataType, StringType):
            raise ValueError(f"column {text.value} must be a text")
        _sizes(size, overlap)
        fields, names = list(rows.dataType.fields), {n.lower() for n in rows.dataType.names}
        for name, kind in (("piece", IntegerType()), ("chunk", StringType())):
            while name in names:
                name += "_"
            fields.append(StructField(name, kind))
        return AnalyzeResult(StructType(fields))

    def eval(self, row, text: str, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP):
        for piece, chunk in enumerate(chunk_text(row[text] or "", size, overlap)):
            yield (*row, piece, chunk)


def register(spark: SparkSession) -> None:
    """Make the three functions known to a session's SQL."""
    for name, handler in (("text_sections", TextSections), ("text_chunks", TextChunks), ("table_chunks", TableChunks)):
        spark.udtf.register(name, udtf(handler))
