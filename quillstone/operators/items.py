"""Texts of generated items, garbage, deterministic stand-ins, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
PRIMARY = ["frente", "pregunta", "titulo", "punto_clave", "narracion"]
FULL = ["frente", "dorso", "pregunta", "respuesta_correcta", "justificacion", "justificacion_didactica", "pista_didactica", "titulo", "instruccion", "ejemplo", "narracion", "punto_clave", "impacto_negocio"]
AUDIT = ["frente", "pregunta", "dorso", "respuesta_correcta", "justificacion", "titulo", "instruccion", "narracion", "punto_clave", "impacto_negocio"]
CLAIM = ["dorso", "respuesta_correcta", "justificacion", "instruccion", "narracion", "punto_clave", "impacto_negocio"]
GROUNDING = ["frente", "dorso", "pregunta", "respuesta_correcta", "justificacion", "titulo", "instruccion", "narracion", "punto_clave", "impacto_negocio"]
FORMAT_KEYS = ["frente", "pregunta", "titulo", "paso", "punto_clave", "narracion", "escena"]
# ----------------------------------------------------------------------------------------------------------------


def _value(item: Column, name: str) -> Column:
    return F.nullif(F.btrim(item.getField(name)), F.lit(""))


def _joined(item: Column, names: list[str], fields: list[str]) -> Column:
    return F.concat_ws(" ", *[_value(item, n) for n in names if n in fields])


def item_texts(items: DataFrame, item: str = "item") -> DataFrame:
    """Add primary, full, audit, claim and grounding text of an item struct; fields that it lacks count as absent."""
    fields = items.schema[item].dataType.names
    it = F.col(item)
    primary = F.coalesce(*[F.nullif(it.getField(n), F.lit("")) for n in PRIMARY if n in fields], F.lit(""))
    options = F.filter(it.getField("opciones"), lambda o: F.btrim(o) != "") if "opciones" in fields else F.array().cast("array<string>")
    full = F.concat_ws(" ", F.nullif(_joined(it, FULL, fields), F.lit("")), F.nullif(F.array_join(F.transform(options, F.btrim), " "), F.lit("")))
    full = F.coalesce(F.nullif(full, F.lit("")), primary)
    audit = F.coalesce(F.nullif(_joined(it, AUDIT, fields), F.lit("")), primary)
    grounding = F.coalesce(F.nullif(_joined(it, GROUNDING, fields), F.lit("")), full)
    claim = F.coalesce(F.nullif(_joined(it, CLAIM, fields), F.lit("")), grounding)
    return items.withColumns({"primary_text": primary, "full_text": full, "audit_text": audit, "claim_text": claim, "grounding_text": grounding})


def is_garbage(items: DataFrame, item: str = "item", clarity: Column | None = None, reviewer: Column | None = None, lexical: Column | None = None) -> Column:
    """An item to drop: nothing in front, no back or answer, under five words, or unclear and unverified.

    Items of none of the known formats are never garbage. Expects the columns of :func:`item_texts`.
    """
    fields = items.schema[item].dataType.names
    it = F.col(item)
    there = lambda n: it.getField(n).isNotNull() if n in fields else F.lit(False)
    empty = lambda n: F.coalesce(F.btrim(it.getField(n)), F.lit("")) == "" if n in fields else F.lit(True)
    known = reduce(lambda a, b: a | b, [there(n) for n in FORMAT_KEYS])
    no_options = F.coalesce(F.size(it.getField("opciones")), F.lit(0)) <= 0 if "opciones" in fields else F.lit(True)
    words = F.size(F.filter(F.split("grounding_text", r"\s+"), lambda w: w != ""))
    bad = (F.btrim("primary_text") == "") | (there("frente") & empty("dorso")) | (there("pregunta") & empty("respuesta_correcta") & no_options) | (words < 5)
    if clarity is not None:
        doubt = ~F.coalesce(reviewer if reviewer is not None else F.lit(True), F.lit(True)) | ~F.coalesce(lexical if lexical is not None else F.lit(False), F.lit(False))
        bad = bad | (F.coalesce(clarity, F.lit("")).isin("Baja", "Low") & doubt)
    return known & bad


def sentences(text: Column, least: int = 15) -> Column:
    """Sentences of over ``least`` characters."""
    return F.filter(F.transform(F.split(text, "[.!?]"), lambda s: F.btrim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > least)


def fallback_items(topics: DataFrame, fmt: str, topic: str = "topic", context: str = "context", nth: str = "item_idx") -> DataFrame:
    """Deterministic items from a topic's sentences, marked ``es_fallback``, each citing its first 100 characters."""
    found = sentences(F.col(context))
    chosen = F.coalesce(F.get(found, F.pmod(F.col(nth), F.greatest(F.size(found), F.lit(1))).cast("int")), F.col(topic))
    fields = {
        "flashcards": {"frente": F.concat(F.lit("¿Qué indica el documento sobre "), topic, F.lit("?")), "dorso": chosen},
        "quiz": {"pregunta": F.concat(F.lit("¿Cuál afirmación es correcta sobre "), topic, F.lit("?")), "respuesta_correcta": chosen, "justificacion": chosen},
        "tutorial": {"titulo": F.col(topic), "instruccion": chosen},
        "executive_summary": {"punto_clave": chosen, "impacto_negocio": F.lit("")},
        "class_script": {"narracion": chosen},
    }[fmt]
    out = topics.withColumn("item", F.struct(*[F.coalesce(v, F.lit("")).alias(k) for k, v in fields.items()]))
    return out.withColumns({"es_fallback": F.lit(True), "extracto": F.substring(chosen, 1, 100)})


def shuffled_options(items: DataFrame, options: str = "opciones", answer: str = "respuesta_correcta", key: str = "gid") -> DataFrame:
    """Options in an order drawn from the item's key; items whose options lack the answer, or that have under two, stay."""
    o = F.col(options)
    mixed = F.transform(F.array_sort(F.transform(o, lambda x: F.struct(F.md5(F.concat(F.col(key), F.lit(":"), x)).alias("h"), x.alias("x")))), lambda s: s["x"])
    return items.withColumn(options, F.when((F.size(o) >= 2) & F.array_contains(o, F.col(answer)), mixed).otherwise(o))


def renumbered(items: DataFrame, run: str, order: str, name: str = "paso") -> DataFrame:
    from pyspark.sql import Window

    return items.withColumn(name, F.row_number().over(Window.partitionBy(run).orderBy(order)))


def anki_ids(deck: Column) -> Column:
    """A stable deck id from its name."""
    return (F.pmod(F.crc32(deck.cast("binary")), F.lit(1_000_000_000)) + 1_000_000_000).cast("long")


def anki_rows(cards: DataFrame, front: str = "frente", back: str = "dorso") -> DataFrame:
    """Escaped fields of an Anki note, and the CSV line with doubled quotes."""
    from ..functions.text import html_escaped

    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return cards.withColumns({"front_html": html_escaped(F.col(front)), "back_html": html_escaped(F.col(back)), "csv_line": F.concat_ws(",", quoted(front), quoted(back))})
