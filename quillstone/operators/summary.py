"""Summaries with numbered references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finish_sentence, key_sentence

# --- fixed values -----------------------------------------------------------------------------------------------
MESSAGES = {
    "es": {
        "header": "Fuentes",
        "empty_detail": "No se pudo generar un resumen con el contenido disponible en este documento. Verifica que el documento tenga texto suficiente e inténtalo de nuevo.",
        "empty_short": "No se pudo generar el resumen.",
        "partial": "El documento admite %d párrafos de los %d solicitados.",
        "generic": "Documento completo",
    },
    "en": {
        "header": "Sources",
        "empty_detail": "The executive summary could not be generated from the content available in this document. Make sure the document contains enough text and try again.",
        "empty_short": "The executive summary could not be generated.",
        "partial": "The document supports %d paragraphs out of the %d requested.",
        "generic": "Full document",
    },
    "pt": {
        "header": "Fontes",
        "empty_detail": "Não foi possível gerar um resumo com o conteúdo disponível neste documento. Verifique se o documento tem texto suficiente e tente novamente.",
        "empty_short": "Não foi possível gerar o resumo.",
        "partial": "O documento admite %d parágrafos dos %d solicitados.",
        "generic": "Documento completo",
    },
}
PAGE = "p. "
LEGACY_HEAD = r"(?i)^(?:resumen ejecutivo|executive summary)"
# ----------------------------------------------------------------------------------------------------------------


def message(key: str, code: Column, *values: Column) -> Column:
    """A message in es, en or pt."""
    out = lambda c: F.format_string(MESSAGES[c][key], *values) if values else F.lit(MESSAGES[c][key])
    return F.when(code == "en", out("en")).when(code == "pt", out("pt")).otherwise(out("es"))


def _clean(c: Column) -> Column:
    return F.btrim(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(" .:-—"))


def numbered_references(sources: DataFrame, run: str = "run_id", item: str = "item_idx", nth: str = "source_no", section: str = "section", pages: str = "pages") -> DataFrame:
    """Sources with ``ref_no``: references, the same section and pages being one, numbered by first appearance.

    ``pages`` is an array of numbers; only positive ones count. A source without a section takes the last part of its ``breadcrumb``, if
    there is that column; one with neither section nor pages is no reference.
    """
    crumb = _clean(F.element_at(F.filter(F.split(F.coalesce("breadcrumb", F.lit("")), "[>|]"), lambda x: F.btrim(x) != ""), -1)) if "breadcrumb" in sources.columns else F.lit("")
    rows = sources.withColumns({section: F.coalesce(F.nullif(_clean(F.col(section)), F.lit("")), F.nullif(crumb, F.lit("")), F.lit("")), pages: F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(pages), F.array().cast("array<int>")), lambda p: p > 0)))})
    keyed = rows.filter((F.col(section) != "") | (F.size(pages) > 0)).withColumn("ref_key", F.concat_ws("|", F.lower(section), F.array_join(F.col(pages).cast("array<string>"), ",")))
    first = keyed.groupBy(run, "ref_key").agg(F.min(F.struct(item, nth)).alias("first"))
    first = first.select(run, "ref_key", F.row_number().over(Window.partitionBy(run).orderBy("first")).alias("ref_no"))
    return keyed.join(first, [run, "ref_key"])


def markers(numbered: DataFrame, run: str = "run_id", item: str = "item_idx") -> DataFrame:
    """(run, item, markers): ``[1][2]`` for each item, numbers rising."""
    refs = F.array_sort(F.collect_set("ref_no"))
    return numbered.groupBy(run, item).agg(F.array_join(F.transform(refs, lambda r: F.concat(F.lit("["), r.cast("string"), F.lit("]"))), "").alias("markers"))


def reference_lines(numbered: DataFrame, language: str = "es", run: str = "run_id", section: str = "section", pages: str = "pages") -> DataFrame:
    """(run, ref_no, line): one line a reference, its pages in brackets."""
    at = F.struct("item_idx", "source_no")
    first = numbered.groupBy(run, "ref_no").agg(F.min_by(section, at).alias(section), F.min_by(pages, at).alias(pages))
    listed = F.array_join(F.transform(pages, lambda p: F.concat(F.lit(PAGE), p.cast("string"))), ", ")
    label = F.coalesce(F.nullif(section, F.lit("")), F.lit(MESSAGES[language]["generic"]))
    return first.select(run, "ref_no", F.concat(F.lit("["), F.col("ref_no").cast("string"), F.lit("] "), label, F.when(F.size(pages) > 0, F.concat(F.lit(" ("), listed, F.lit(")"))).otherwise("")).alias("line"))


def composed(points: DataFrame, sources: DataFrame, language: str = "es", run: str = "run_id", item: str = "item_idx", titles: DataFrame | None = None) -> DataFrame:
    """(run, summary): a paragraph a point with its markers; then, if anything is cited, a header, the document's title and the references.

    Points without text give no paragraph, and their sources no number. titles: run, title.
    """
    said = points.withColumn("said", paragraph(points)).filter("said <> ''")
    numbered = numbered_references(sources.join(said.select(run, item), [run, item], "left_semi"), run, item)
    marked = said.join(markers(numbered, run, item), [run, item], "left")
    body = F.concat_ws(" ", "said", F.nullif("markers", F.lit("")))
    text = marked.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(item, body.alias("p")))), lambda x: x["p"]), "\n\n").alias("body"))
    lines = reference_lines(numbered, language, run).groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_no", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    out = text.join(lines, run, "left")
    out = out.join(titles.select(run, F.nullif(F.btrim("title"), F.lit("")).alias("title")), run, "left") if titles is not None else out.withColumn("title", F.lit(None).cast("string"))
    listed = F.when(F.col("lines").isNotNull(), F.concat_ws("\n", F.lit(MESSAGES[language]["header"]), "title", "lines"))
    return out.select(run, F.concat_ws("\n\n", "body", listed).alias("summary"))


def paragraph(points: DataFrame) -> Column:
    """A point as one block: its key sentence, then its effect."""
    parts = [F.nullif(key_sentence(F.coalesce("punto_clave", F.lit(""))), F.lit(""))]
    if "impacto_negocio" in points.columns:
        parts.append(F.nullif(finish_sentence(F.coalesce("impacto_negocio", F.lit(""))), F.lit("")))
    return F.concat_ws(" ", *parts)


def split_summary(text: Column) -> tuple[Column, Column]:
    """(paragraphs, reference lines) of a composed summary, split at the first line that is a header; the header is the first reference line."""
    headers = [m["header"].lower() for m in MESSAGES.values()]
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.btrim(x))
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).isin(headers)), True).cast("int")
    some = lambda a: F.filter(a, lambda x: x != "")
    body = F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)
    return some(body), F.when(at > 0, some(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)))).otherwise(F.array().cast("array<string>"))


def legacy_paragraphs(text: Column) -> Column:
    """Paragraphs of an older summary, "1. point: effect" lines below a heading: without heading and numbers."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.btrim(x)), lambda x: (x != "") & ~x.rlike(LEGACY_HEAD))
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^\d+\.\s*", ""))
