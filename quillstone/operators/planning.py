"""Coverage planning: substantive chunks, section weights, allocations, samples, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values -----------------------------------------------------------------------------------------------
NOISE_TITLES = [
    "indice", "tabla de contenido", "tabla de contenidos", "introduccion", "referencias", "bibliografia", "anexo", "apendice", "glosario", "conclusion", "conclusiones", "portada", "resumen",
    "agradecimientos", "dedicatoria", "prologo", "prefacio", "lista de figuras", "lista de tablas", "licencia", "licencias", "creditos", "colofon", "aviso legal",
    "table of contents", "contents", "introduction", "references", "bibliography", "appendix", "annex", "glossary", "conclusions", "summary", "overview", "acknowledgements", "dedication",
    "foreword", "preface", "list of figures", "list of tables", "license", "licenses", "licensing", "credits", "legal notice", "disclaimer",
    "sumario", "indice geral", "referencias bibliograficas",
]
NOISE_PARTS = ["table of content", "tabla de contenido", "list of figure", "list of table", "lista de figur", "lista de tabla", "creative common", "creative commons", "licencia", "license"]
MIN_SUBSTANTIVE, FRAGMENT, CONTEXT = 80, 300, 1500
CAPACITY_WARNING = {
    "es": "El documento tiene contenido suficiente para generar %d elemento(s) con calidad verificada. Se solicitaron %d. Se generará la cantidad viable sin incluir contenido inventado.",
    "en": "The document has enough content to generate %d verified item(s). %d were requested. Only the viable count will be generated; no fabricated content will be added.",
}
CAPACITY_NOTICE = {
    "es": "Tu documento dio para %d elementos verificados. Con un documento más extenso podrás generar los %d solicitados.",
    "en": "Your document supported %d verified items. With a longer document you can generate the %d requested items.",
    "pt": "Seu documento suportou %d itens verificados. Com um documento mais extenso você poderá gerar os %d solicitados.",
}
# ----------------------------------------------------------------------------------------------------------------

PAGE_TITLE = r"(?iu)^(?:(?:p[áa]gina|p[áa]g\.?|page)\s*)?\d+(?:\s*(?:de|of|/)\s*\d+)?$"
SIGN_TITLE = r"(?i)^(?:[ivxlcdm.\s\-#*_]+|[#*_~`>\s.\-:,;]+)$"


def looks_like_prose(text: Column) -> Column:
    """Long lines, at least half of all, and 40 words."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    long_lines = F.size(F.filter(lines, lambda x: F.length(x) >= 60))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return (F.size(lines) > 0) & (long_lines >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2))) & (words >= 40)


def is_substantive(title: str, content: str, keep_prose: bool = False) -> Column:
    """Whether a chunk has some length and a title that isn't that of a list, notice or index."""
    raw = F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    bare = F.trim(F.regexp_replace(raw, r"^[\d.\-)\s]+", ""))
    named = raw.isin(NOISE_TITLES) | bare.isin(NOISE_TITLES)
    if keep_prose:
        named = named & ~F.coalesce(looks_like_prose(F.col(content)), F.lit(False))
    part = F.lit(False)
    for p in NOISE_PARTS:
        part = part | raw.contains(p) | bare.contains(p)
    return ~named & ~part & (F.length(T.strip(F.coalesce(F.col(content), F.lit("")))) >= MIN_SUBSTANTIVE)


def is_page_title(title: str) -> Column:
    """Whether a title is but a page, a roman number or signs."""
    raw = F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    return raw.rlike(PAGE_TITLE) | raw.rlike(SIGN_TITLE)


def substantive(chunks: DataFrame, title: str = "title", content: str = "content", keep_prose: bool = False) -> DataFrame:
    """Substantive chunks; page and roman titles become null."""
    return chunks.filter(is_substantive(title, content, keep_prose)).withColumn(title, F.when(~is_page_title(title), F.col(title)))


def sections_of(chunks: DataFrame, doc: str = "document_id", position: str = "position", title: str = "title", content: str = "content") -> DataFrame:
    """(doc, section_title, section_no, weight, n_chunks): chunks grouped by title in order of first appearance.

    Chunks without a title are sections of their own, named by a counter.
    """
    blank = F.coalesce(F.trim(F.col(title)), F.lit("")) == ""
    counter = F.sum(blank.cast("int")).over(Window.partitionBy(doc).orderBy(position))
    name = F.when(blank, F.concat(F.lit("Sección "), counter.cast("string"))).otherwise(F.trim(F.col(title)))
    grouped = chunks.withColumn("section_title", name).groupBy(doc, "section_title").agg(
        F.min(position).alias("first_position"), F.sum(F.length(content)).cast("long").alias("weight"), F.count("*").alias("n_chunks")
    )
    nth = F.row_number().over(Window.partitionBy(doc).orderBy("first_position")) - 1
    return grouped.withColumn("section_no", nth.cast("int")).drop("first_position")


def allocate(sections: DataFrame, target: Column | int, doc: str = "document_id", order: str = "section_no", weight: str = "weight") -> DataFrame:
    """Items per section in proportion to weight, one at least; one correction of one item a section at most.

    What is missing goes one by one to the heaviest sections, what is over is taken from the largest allocations above
    one. With more sections than items the sum exceeds the target.
    """
    target = F.lit(target) if isinstance(target, int) else target
    whole = Window.partitionBy(doc)
    total = F.greatest(F.sum(weight).over(whole), F.lit(1))
    rows = sections.withColumn("target", target.cast("long")).withColumn("base", F.greatest(F.lit(1), F.floor(F.col("target") * F.col(weight) / total)).cast("long"))
    rows = rows.withColumn("diff", F.col("target") - F.sum("base").over(whole))
    heavy = F.row_number().over(whole.orderBy(F.desc(weight), order))
    large = F.row_number().over(whole.orderBy(F.desc("base"), order))
    rows = rows.withColumns({"heavy": heavy, "large": large})
    change = F.when((F.col("diff") > 0) & (F.col("heavy") <= F.col("diff")), 1).when((F.col("diff") < 0) & (F.col("large") <= -F.col("diff")) & (F.col("base") > 1), -1).otherwise(0)
    return rows.withColumn("allocated_items", F.col("base") + change).drop("base", "diff", "heavy", "large", "target")


def round_robin(chunks: DataFrame, doc: str = "document_id", section: str = "section_no", nth: str = "chunk_no", content: str = "content", budget: int = 4 * CONTEXT) -> DataFrame:
    """Fragments of up to 300 characters, first chunks of all sections before second ones, until the budget is used."""
    rows = chunks.withColumn("fragment", F.substring(T.strip(F.coalesce(F.col(content), F.lit(""))), 1, FRAGMENT)).filter("fragment <> ''")
    before = Window.partitionBy(doc).orderBy(nth, section).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum(F.length("fragment")).over(before), F.lit(0)))
    return rows.filter(F.col("used") < budget).drop("used")


def holistic_context(sample: DataFrame, doc: str = "document_id", section_title: str = "section_title", section: str = "section_no", nth: str = "chunk_no", budget: int = 4 * CONTEXT) -> DataFrame:
    """(doc, context): the sample's fragments with their sections, in sampling order, cut at the budget."""
    parts = F.array_sort(F.collect_list(F.struct(nth, section, F.concat(F.lit("["), section_title, F.lit("] "), "fragment").alias("part"))))
    return sample.groupBy(doc).agg(F.substring(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n"), 1, budget).alias("context"))


def first_page(chunks: DataFrame, keys: list[str], position: str = "position", page: str = "page_number") -> DataFrame:
    """(keys, page): the first positive page number of each group."""
    return chunks.groupBy(*keys).agg(F.min_by(F.when(F.col(page) > 0, F.col(page)), F.when(F.col(page) > 0, F.col(position))).alias("page_number"))


def section_context(chunks: DataFrame, doc: str = "document_id", section: str = "section_title", position: str = "position", content: str = "content", budget: int = CONTEXT) -> DataFrame:
    """(doc, section, context, chunk_ids): each chunk's window of an even share of the budget, 300 characters at least."""
    n = F.count("*").over(Window.partitionBy(doc, section))
    share = F.greatest(F.lit(300), F.floor(F.lit(budget) / n))
    window = F.substr(F.col(content), F.lit(1), share.cast("int"))
    rows = chunks.withColumn("part", F.when(F.length(content) <= share, F.col(content)).otherwise(F.regexp_replace(window, r"\s+\S*$", "")))
    parts = F.array_sort(F.collect_list(F.struct(position, "chunk_id", "part")))
    return rows.groupBy(doc, section).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"), F.transform(parts, lambda p: p["chunk_id"]).alias("chunk_ids"))


def match_concepts(topics: DataFrame, concepts: DataFrame, doc: str = "document_id", topic: str = "topic", position: str = "position") -> DataFrame:
    """Each topic with the first concept of its document that it contains or that contains it; null without one.

    Joined by document, each with its few topics and concepts. Equal topic rows stay apart.
    """
    rows = topics.withColumn("_row", F.monotonically_increasing_id())
    t, c = F.lower(F.col(topic)), F.lower(F.col("concept"))
    hits = rows.join(concepts.select(doc, "concept", F.col(position).alias("_at")), doc).filter(t.contains(c) | c.contains(t))
    first = hits.groupBy(doc, *[x for x in topics.columns if x != doc], "_row").agg(F.min_by("concept", "_at").alias("concept")).drop("_row")
    missed = rows.join(hits.select(doc, "_row").distinct(), [doc, "_row"], "left_anti").drop("_row").withColumn("concept", F.lit(None).cast("string"))
    return first.select(*topics.columns, "concept").unionByName(missed)


def batches_of(sections: DataFrame, doc: str = "document_id", order: str = "section_no", items: str = "allocated_items", cap: int = 1 << 30, target: Column | None = None) -> DataFrame:
    """How many items to ask a section for: never more than its share, the batch size, or what remains of the target."""
    from ..functions.labels import batch_size

    whole = Window.partitionBy(doc)
    target = target if target is not None else F.sum(items).over(whole)
    done = F.coalesce(F.sum(items).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ask = F.greatest(F.lit(0), F.least(F.lit(cap), F.col(items), batch_size(target), target - done))
    return sections.withColumn("ask", ask.cast("long"))


def capacity_warning(viable: Column, requested: Column, language: Column) -> Column:
    """The plan's notice that a text bears fewer items than were asked for; languages with "es" in their name, or none, get Spanish."""
    name = F.lower(F.coalesce(language, F.lit("")))
    spanish = (name == "") | name.contains("es") | name.contains("span") | name.contains("castellano")
    return F.when(viable < requested, F.when(spanish, F.format_string(CAPACITY_WARNING["es"], viable, requested)).otherwise(F.format_string(CAPACITY_WARNING["en"], viable, requested)))


def capacity_notice(effective: Column, requested: Column, code: Column) -> Column:
    """The platform's notice of the same in es, en or pt."""
    out = F.format_string(CAPACITY_NOTICE["en"], effective, requested)
    for key in ("pt", "es"):
        out = F.when(code == key, F.format_string(CAPACITY_NOTICE[key], effective, requested)).otherwise(out)
    return out


def provider_for(fmt: Column, profiles: list[tuple[str, str]], default: str) -> Column:
    """The provider of the first profile whose format the given one contains."""
    out = F.lit(default)
    for key, provider in reversed(profiles):
        out = F.when(F.lower(fmt).contains(key), provider).otherwise(out)
    return out
