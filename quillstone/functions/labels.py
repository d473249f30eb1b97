"""Label lookups, quantities and routing decisions as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
LANGUAGE_NAMES = {"es": "Spanish", "en": "English", "pt": "Portuguese"}
LANGUAGE_ALIASES = {
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "es-419"],
    "en": ["en", "eng", "english", "inglés", "ingles"],
    "pt": ["pt", "por", "portuguese", "portugués", "portugues", "br", "pt-br"],
}
FORMAT_ALIASES = [
    ("flashcards", "flashcards"), ("flashcard", "flashcards"), ("tarjetas", "flashcards"), ("quiz", "quiz"), ("cuestionario", "quiz"), ("cuestionarios", "quiz"),
    ("tutorial", "tutorial"), ("guia practica", "tutorial"), ("guía práctica", "tutorial"), ("resumen ejecutivo", "executive_summary"), ("resumen", "executive_summary"),
    ("executive summary", "executive_summary"), ("executive_summary", "executive_summary"), ("tldr", "executive_summary"), ("guion de clase", "class_script"),
    ("guion", "class_script"), ("class script", "class_script"), ("class_script", "class_script"),
]
LEVELS = {"breve": 0, "brief": 0, "estandar": 1, "standard": 1, "amplio": 2, "wide": 2, "exhaustivo": 3, "comprehensive": 3}
QUANTITIES = {
    "flashcards": [10, 20, 40, 80],
    "quiz": [5, 10, 20, 30],
    "tutorial": [4, 8, 15, 25],
    "executive_summary": [3, 5, 10, 15],
    "class_script": [3, 5, 8, 12],
}
# ----------------------------------------------------------------------------------------------------------------


def _map(values: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def language_code(c: Column, default: str = "es") -> Column:
    """es, en or pt for any alias; the default for others."""
    alias = {a: code for code, names in LANGUAGE_ALIASES.items() for a in names}
    return F.coalesce(F.try_element_at(_map(alias), F.lower(F.btrim(c))), F.lit(default))


def language_name(code: Column) -> Column:
    return F.try_element_at(_map(LANGUAGE_NAMES), code)


def format_key(c: Column) -> Column:
    """The canonical format: an alias, else the first alias that the name contains."""
    name = F.lower(F.btrim(c))
    out = F.try_element_at(_map(dict(FORMAT_ALIASES)), name)
    part = F.lit(None).cast("string")
    for alias, key in reversed(FORMAT_ALIASES):
        part = F.when(name.contains(alias), key).otherwise(part)
    return F.coalesce(out, part, name)


def level_quantity(fmt: Column, level: Column) -> Column:
    """The number of items of a format at a level of detail; 20 for unknown formats or levels."""
    nth = F.try_element_at(_map(LEVELS), F.lower(F.btrim(level)))
    out = F.lit(None).cast("int")
    for key, row in QUANTITIES.items():
        out = F.when(fmt == key, F.get(F.array(*map(F.lit, row)), nth)).otherwise(out)
    return F.coalesce(out, F.lit(20))


def clamped_quantity(asked: Column, least: Column | int = 1, most: Column | int = 100) -> Column:
    """A number of items of one's own within the range of its format."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (least, most))
    return F.greatest(low, F.least(high, asked))


def accepted_quantity(asked: Column) -> Column:
    """Whether a request may ask for so many items; none asked is accepted."""
    return F.coalesce(asked <= 100, F.lit(True))


def is_uuid(c: Column) -> Column:
    """32 hexadecimal digits, with any dashes, in braces or behind ``urn:uuid:``."""
    bare = F.btrim(F.replace(F.replace(F.lower(c), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")), F.lit("{}"))
    return F.coalesce(F.replace(bare, F.lit("-"), F.lit("")).rlike("^[0-9a-f]{32}$"), F.lit(False))


def storage_backend(preferred: Column, oci: Column, supabase: Column) -> Column:
    """The backend that is used, by what is available: a preference never forces a broken one."""
    return F.when((preferred == "supabase") & supabase, "supabase").when(oci, "oci").when(supabase, "supabase").otherwise("local")


def min_chars_per_item(fmt: Column) -> Column:
    return F.when(fmt.contains("flashcard"), 50).when(fmt.contains("quiz"), 80).otherwise(120)


def capacity(fmt: Column, chars: Column, requested: Column) -> Column:
    """How many items a text can bear: capped only if it is short and more was asked than it bears."""
    most = F.greatest(F.lit(3), F.floor(chars / min_chars_per_item(fmt))).cast("long")
    return F.when((requested > most) & (chars < 800), most).otherwise(F.greatest(requested, most))


def trust_seal(percent: Column) -> Column:
    return F.when(percent >= 90, "excelente").when(percent >= 75, "alta").when(percent >= 60, "media").otherwise("baja")


def days_left_status(days: Column) -> Column:
    return F.when(days > 7, "green").when(days >= 4, "amber").when(days >= 1, "red").otherwise("today")


def embedding_provider(model: Column) -> Column:
    name = F.lower(model)
    return F.when(name.contains("gemini"), "gemini").when(name.contains("jina"), "jina").otherwise("local")


def embedding_batch_size(provider: Column, total: Column) -> Column:
    return F.when(provider == "gemini", 20).when(provider == "jina", 50).otherwise(total)


def is_rate_limit(message: Column, code: Column | None = None) -> Column:
    """Quota errors: status 429 as a code or a word of the message, or an exhausted resource."""
    told = message.contains("RESOURCE_EXHAUSTED") | message.rlike(r"\b429\b")
    return told if code is None else F.coalesce(code == 429, F.lit(False)) | told


def is_splittable(provider: Column, message: Column, code: Column) -> Column:
    """Whether a smaller batch can mend an error: payload errors, never quota errors."""
    payload = F.coalesce(code == 400, F.lit(False)) | message.contains("INVALID_ARGUMENT")
    return ~is_rate_limit(message, code) & F.when(provider == "gemini", payload).otherwise(provider == "jina")


def retry_wait(message: Column, code: Column | None = None) -> Column:
    """Seconds to wait after an error: for quota errors the delay that the message suggests and one more, between 5 and 90, or 60
    without a hint; 5 for other errors."""
    hint = F.regexp_extract(message, r"(?i)retry(?:Delay|\s+in)\D{0,5}(\d+(?:\.\d+)?)\s*s", 1)
    suggested = F.least(F.lit(90.0), F.greatest(F.lit(5.0), F.try_to_number(F.nullif(hint, F.lit("")), F.lit("999999.999")).cast("double") + 1))
    return F.when(~is_rate_limit(message, code), F.lit(5.0)).when(hint == "", F.lit(60.0)).otherwise(suggested)


def study_minutes(items: Column) -> Column:
    return F.greatest(F.lit(3), 2 * items)


def batch_size(target: Column) -> Column:
    return F.when(target <= 10, 5).when(target <= 30, 8).otherwise(10)
