"""Text normalisation as Column expressions (no Python on the executors)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
SPACES = "\u00a0\u202f\u2007\u2009"
INVISIBLE = "\u00ad\u200b\u2060\ufeff"
BROKEN_LIGATURES = {
    r"con[gq]uración": "configuración", r"con[gq]uraciones": "configuraciones", r"con[gq]urar": "configurar", r"con[gq]urado": "configurado",
    r"con[gq]urada": "configurada", r"de[gq]nición": "definición", r"de[gq]nir": "definir", r"de[gq]nido": "definido", r"signi[gq]cado": "significado",
    r"signi[gq]ca": "significa", r"especi[gq]car": "especificar", r"especi[gq]cación": "especificación", r"[gq]gura": "figura",
}
PAGE_NUMBER_LINE = r"^(?:(?:p[áa]gina|p[áa]g\.?|page)\s*\d+(?:\s*(?:de|of|/)\s*\d+)?|\d+\s*(?:de|of|/)\s*\d+|[-–—]\s*\d+\s*[-–—])$"
MARKDOWN_STRUCTURE = r"^(#{1,6}\s|\||[-*+]\s|>|```|\d+[.)]\s)"
ENGLISH_STOPWORDS = (
    "the and of in is to with for that this from by are as at be an have has which allows ensures provides system management interface "
    "their they will would about there into can"
).split()
SPANISH_STOPWORDS = (
    "el la los las un una unos unas de del en es son y o con para por que este esta estos estas su sus como al se lo permite garantiza "
    "proporciona sistema gestion gestión"
).split()
# ----------------------------------------------------------------------------------------------------------------

ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it: expressions with lambdas are not freed of common parts."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\u00a0]+", ""), r"[\s\u00a0]+$", "")


def normalize_characters(c: Column) -> Column:
    """Ligatures become letters, special spaces a space, invisible characters nothing; words that lost a ligature are repaired."""
    signs = lambda x: reduce(lambda y, kv: F.replace(y, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), F.translate(x, SPACES + INVISIBLE, " " * len(SPACES)))
    mended = lambda x: reduce(lambda y, kv: F.regexp_replace(y, rf"(?iu)\b{kv[0]}\b", kv[1]), BROKEN_LIGATURES.items(), x)
    # what most texts lack is looked for first, in one pass each
    c = bound(c, lambda x: F.when(x.rlike(f"[{''.join(LIGATURES)}{SPACES}{INVISIBLE}]"), signs(x)).otherwise(x))
    broken = r"(?u)\b(?:" + "|".join(BROKEN_LIGATURES) + r")\b"
    return bound(c, lambda x: F.when(F.lower(x).rlike(broken), mended(x)).otherwise(x))


def normalized_count(c: Column) -> Column:
    """How many characters :func:`normalize_characters` changes."""
    return F.regexp_count(c, F.lit(f"[{''.join(LIGATURES)}{SPACES}{INVISIBLE}]"))


def unify_line_ends(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def is_page_number_line(line: Column) -> Column:
    return strip(line).rlike("(?iu)" + PAGE_NUMBER_LINE)


def drop_page_number_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_page_number_line(x)), "\n")


def join_hyphenated_lines(c: Column) -> Column:
    """Rejoin a word that a line end broke after a hyphen, if the next line goes on in lower case."""
    return F.regexp_replace(c, r"(?<=[A-Za-zÁÉÍÓÚÜÑáéíóúüñ])-[ \t]*\n[ \t]*(?=[a-záéíóúüñ])", "")


def strip_markdown_markers(c: Column) -> Column:
    """Without emphasis and quote markers; text that holds inline code keeps its code spans' content as it is.

    Code spans are taken apart by splitting; emphasis goes only from the parts between them.
    """
    quote = r"(?m)^([ \t]{0,3})>+(?![ \t]*[\d=])[ \t]?"

    def plain(x: Column) -> Column:
        for pattern in (
            r"\*\*(?=\S)(.+?)(?<=\S)\*\*",
            r"(?U)(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)",
            r"(?U)(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])",
            r"(?U)(?<!\w)_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)",
        ):
            x = F.regexp_replace(x, pattern, "$1")
        return x

    c = F.regexp_replace(c, quote, "$1")
    code = F.regexp_extract_all(c, F.lit(r"`([^`\n]+)`"), F.lit(1))
    rest = F.split(c, r"`[^`\n]+`", -1)
    return F.array_join(F.transform(rest, lambda x, i: F.concat(plain(x), F.coalesce(F.get(code, i), F.lit("")))), "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of blanks inside a line become one, the indentation stays; table rows only lose what trails; at most one
    blank line in a row."""

    def line(x: Column) -> Column:
        return bound(F.regexp_replace(x, r"\s+$", ""), lambda right: F.when(F.ltrim(x).startswith("|"), right).otherwise(inner(right)))

    def inner(right: Column) -> Column:
        # blanks behind a sign that is none become one, where there are two or a tab
        return F.when(right.rlike(r"[^ \t][ \t]*(?:\t|  )[ \t]*[^ \t]"), F.regexp_replace(right, r"(?<=[^ \t])[ \t]+", " ")).otherwise(right)

    return F.regexp_replace(F.array_join(F.transform(F.split(c, "\n"), line), "\n"), r"\n{3,}", "\n\n")


def scrub_pdf_artifacts(c: Column) -> Column:
    """Without control characters, PDF streams, dictionaries, objects, and lines with PDF tokens."""
    patterns = (
        r"(?i)stream[\s\S]*?endstream",
        r"<<[\s\S]*?>>",
        r"(?i)\d+\s+\d+\s+obj[\s\S]*?endobj",
        r"(?im)^.*(?:%PDF-|\b\d+\s+\d+\s+R\b|/FlateDecode|/Filter\b|/FontDescriptor\b|/MediaBox\b|/Parent\b|/Catalog\b|/Length\b|startxref|%%EOF|xref\b|trailer\b).*$",
        r"(?i)(?:%?\s*startxref[\s\d]*|%%EOF|xref\s*\d+\s*\d+|\b\d{5,}\b(?=\s*$|\s*R\b))",
    )
    # no pattern matches a text without one of these: most texts are read once
    some = r"(?i)endstream|<<|endobj|%PDF-|/(?:FlateDecode|Filter|FontDescriptor|MediaBox|Parent|Catalog|Length)\b|xref|%%EOF|trailer|\d\s+R\b|\d{5}"
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]", "")
    return bound(c, lambda x: F.when(x.rlike(some), reduce(lambda y, p: F.regexp_replace(y, p, ""), patterns, x)).otherwise(x))


def clean_text(c: Column, strip_markdown: bool = False) -> Column:
    """The whole cleaning; stretches between code fences are cleaned, fenced ones stay as they are."""
    def prose(x: Column) -> Column:
        x = join_hyphenated_lines(drop_page_number_lines(x))
        return collapse_whitespace(strip_markdown_markers(x) if strip_markdown else x)

    # a part that opens with a fence holds code if an odd number of fences has been met, else its first line closes it
    def numbered(parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(parts, 1, i + 1), lambda y: F.ltrim(y).startswith("```"))).alias("n")))

    def one(p: Column) -> Column:
        closing = (p["n"] % 2 == 0) & F.ltrim(p["x"]).startswith("```")
        head = F.regexp_extract(p["x"], r"^[^\n]*\n?", 0)
        return F.when(p["n"] % 2 == 1, p["x"]).when(closing, F.concat(head, prose(F.substr(p["x"], F.length(head) + 1)))).otherwise(prose(p["x"]))

    parts = F.split(unify_line_ends(normalize_characters(scrub_pdf_artifacts(c))), r"(?m)(?=^[ \t]*```)", -1)
    return strip(bound(parts, lambda ps: F.array_join(F.transform(numbered(ps), one), "")))


def clean_title(c: Column, strip_markdown: bool = True) -> Column:
    """A title by the same rules, in one line, and without Markdown unless told otherwise."""
    return F.btrim(F.regexp_replace(clean_text(c, strip_markdown), r"\s+", " "))


def normalize_title(c: Column) -> Column:
    """Runs of white space become one; colons, dots and dashes go from the ends."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(":.-–— "))


def preview(c: Column, n: int = 80) -> Column:
    return F.substring(F.btrim(F.regexp_replace(c, r"\s+", " ")), 1, n)


def token_estimate(c: Column) -> Column:
    """About 3.5 characters a token, at least one, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(F.length(c) / 3.5)).cast("long")


def stopword_count(c: Column, words: list[str]) -> Column:
    tokens = language_tokens(c)
    return F.size(F.filter(tokens, lambda t: t.isin(words)))


def language_tokens(c: Column) -> Column:
    letters = "a-zA-ZáéíóúñÁÉÍÓÚÑ"
    edge = r"[\p{L}\p{N}_]"
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?<!{edge})([{letters}]{{2,}})(?!{edge})"), F.lit(1))


def is_language_pure(c: Column, target: str | None = "Spanish") -> Column:
    """False if a text that should be Spanish has three or more English stopwords, and more than Spanish ones."""
    name = (target or "es").strip().lower()
    if not (name.startswith("es") or "span" in name):
        return F.lit(True)
    english, spanish = stopword_count(c, ENGLISH_STOPWORDS), stopword_count(c, SPANISH_STOPWORDS)
    impure = (F.size(language_tokens(c)) >= 4) & (english >= 3) & (english > spanish)
    return ~F.coalesce(impure, F.lit(False))


def unaccent(c: Column) -> Column:
    return F.translate(c, *ACCENTS)


def _decomposed(texts):
    import unicodedata

    import pandas as pd

    return pd.Series([t and "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).lower().strip() for t in texts], dtype=object)


def search_form(c: Column) -> Column:
    """For searches: compatibility decomposition of all scripts without combining marks, in lower case, without white space at the ends; null is empty.

    Texts of ASCII alone need no decomposition and do not leave the JVM.
    """
    text = F.coalesce(c, F.lit(""))
    other = text.rlike(r"[^\x00-\x7f]")
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"^[\s\x1c-\x1f]+", ""), r"[\s\x1c-\x1f]+$", ""))
    return F.when(other, F.pandas_udf(_decomposed, "string")(F.when(other, text))).otherwise(plain)


def slug(c: Column, separator: str = "-", most: int | None = None) -> Column:
    """Lower-case ASCII letters and digits, all else one separator."""
    out = F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", separator)
    out = F.btrim(out, F.lit(separator))
    return F.rtrim(F.substring(out, 1, most), F.lit(separator)) if most else out


def label_slug(c: Column, most: int = 40) -> Column:
    """Part of an object key: letters without accents, other characters beyond ASCII dropped, dashes between words."""
    plain = F.regexp_replace(unaccent(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", "")
    out = F.lower(F.btrim(F.regexp_replace(plain, "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    return F.btrim(F.substring(out, 1, most), F.lit("-"))


def safe_filename(c: Column) -> Column:
    """The last part of a path, with underscores for what is not a letter, digit, dot, dash or underscore."""
    base = F.regexp_replace(F.regexp_replace(c, r"(?s)^.*[/\\]", ""), r"[^a-zA-Z0-9_.-]", "_")
    clean = F.btrim(F.regexp_replace(base, r"\.{2,}", "."), F.lit("._"))
    return F.when(clean == "", "documento_fuente").otherwise(clean)


def safe_user(c: Column) -> Column:
    clean = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    return F.when(clean == "", "anonimo").otherwise(clean)


def document_key(user: Column, text: Column, name: Column) -> Column:
    """Object key of a source document, by the hash of its content."""
    return F.concat_ws("/", F.lit("usuarios"), safe_user(user), F.lit("documentos"), F.sha2(text, 256), safe_filename(name))


def content_key(user: Column, content_id: Column, title: Column, fmt: Column, profile: Column, day: Column, version: Column) -> Column:
    """Object key of generated content below its id: title, format, profile, day, and the version beyond the first; without any
    of the three names the version alone."""
    parts = F.filter(F.array(label_slug(title, 40), label_slug(fmt, 20), label_slug(profile, 20)), lambda x: x != "")
    named = F.concat(F.array_join(parts, "-"), F.lit("-"), F.date_format(day, "yyyyMMdd"), F.when(version > 1, F.concat(F.lit("-v"), version.cast("string"))).otherwise(""))
    plain = F.concat(F.lit("v"), version.cast("string"))
    own = F.btrim(F.regexp_replace(content_id, r"[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    return F.concat(F.lit("usuarios/"), safe_user(user), F.lit("/contenidos/"), own, F.lit("/"), F.when(F.size(parts) == 0, plain).otherwise(named), F.lit(".json"))


def document_title(name: Column, text: Column) -> Column:
    """A file name without extension, dashes as spaces; numbers give way to the first line of over 10 characters."""
    base = F.btrim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), "[-_]+", " "))
    first = F.get(F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x)) > 10), F.lit(0))
    return F.when((base == "") | base.rlike(r"^\d+$"), F.substring(F.btrim(first), 1, 60)).otherwise(base)


def strip_json_fences(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def strip_step_prefix(c: Column) -> Column:
    """Without repeated ``Paso N:`` or ``Step N:`` before a title."""
    return F.regexp_replace(c, r"(?i)^(?:\s*(?:paso|step)\s*\d+\s*[:.\-]\s*)+", "")


def finish_sentence(c: Column) -> Column:
    """Without white space around it, a full stop at the end if it lacks a sign."""
    body = F.btrim(c)
    return F.when(body == "", body).when(body.rlike(r"[.!?…]$"), body).otherwise(F.concat(body, F.lit(".")))


def key_sentence(c: Column) -> Column:
    """A key point as a sentence: first letter in upper case, one full stop at the end."""
    body = F.rtrim(F.btrim(c), F.lit("."))
    return finish_sentence(F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 1 << 30)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def context_window(text: Column, budget: Column | int, focus: Column | None = None) -> Column:
    """At most ``budget`` characters (200 at least) of a text, around ``focus`` (its first 200 characters) if it occurs.

    The window begins at a word; it ends after the last sentence of its last 200 characters, else at a word.
    """
    size = F.greatest(F.lit(200), budget if isinstance(budget, Column) else F.lit(budget)).cast("int")
    wanted = F.substring(F.lower(strip(F.coalesce(focus, F.lit("")))), 1, 200) if focus is not None else F.lit("")

    def placed(v):
        at = F.when(v["wanted"] != "", F.position(v["wanted"], F.lower(v["clean"])) - 1).otherwise(-1)
        first = F.greatest(F.lit(0), at - F.floor(v["size"] / 3).cast("int"))
        end = F.least(F.length(v["clean"]), F.when(at >= 0, first).otherwise(0) + v["size"])
        start = F.when(at >= 0, F.greatest(F.lit(0), end - v["size"])).otherwise(0)
        return F.when(F.length(v["clean"]) <= v["size"], v["clean"]).otherwise(_let(F.struct(v["clean"].alias("clean"), v["size"].alias("size"), start.alias("start"), end.alias("end")), cut))

    def cut(v):
        head = F.substr(v["clean"], F.lit(1), v["end"])
        tail = F.substring(head, -200, 200)
        sentence = F.length(F.regexp_extract(tail, r"(?s)^(.*\.) ", 1))
        by_word = F.length(F.regexp_replace(head, r"\S+\z", ""))
        stop = F.when(v["end"] >= F.length(v["clean"]), v["end"]).when(sentence > 0, v["end"] - F.length(tail) + sentence).otherwise(by_word)
        skipped = F.when(v["start"] > 0, F.length(F.regexp_extract(F.substr(v["clean"], v["start"] + 1, v["size"]), r"^\S*\s*", 0))).otherwise(0)
        return _let(F.struct(v["clean"].alias("clean"), v["size"].alias("size"), (v["start"] + skipped).alias("start"), stop.alias("stop")), taken)

    def taken(v):
        window = strip(F.substr(v["clean"], v["start"] + 1, F.greatest(F.lit(0), v["stop"] - v["start"])))
        return F.when(window != "", window).otherwise(strip(F.substr(v["clean"], F.lit(1), v["size"])))

    return _let(F.struct(strip(F.coalesce(text, F.lit(""))).alias("clean"), size.alias("size"), wanted.alias("wanted")), placed)


def pdf_safe(c: Column) -> Column:
    """Typographic signs as plain ones; what Latin-1 lacks becomes a question mark."""
    c = F.translate(c, "‘’“”–—•", "''\"\"--*")
    c = F.replace(c, F.lit("…"), F.lit("..."))
    return F.regexp_replace(c, r"[^\u0000-ÿ]", "?")


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit("\n"), F.lit("<br>"))
