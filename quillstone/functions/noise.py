"""Noise classes of sections as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_title, strip

# --- fixed values -----------------------------------------------------------------------------------------------
PATTERNS: dict[str, dict[str, list[str]]] = {
    "legal": {
        "title_patterns": [
            r"copyright", r"derechos\s+de\s+autor", r"aviso\s+legal", r"informaci[oó]n\s+legal", r"legal\s+(?:notices?|information)", r"disclaimer", r"exenci[oó]n\s+de\s+responsabilidad",
            r"descargo\s+de\s+responsabilidad", r"marcas?\s+(?:registradas?|comerciales?)", r"trademarks?", r"t[eé]rminos\s+y\s+condiciones", r"terms\s+(?:and|of)\s+(?:conditions|use)",
            r"licencias?", r"licenses?", r"licensing", r"creative\s+commons", r"cr[eé]ditos?", r"credits?", r"colof[oó]n",
        ],
        "content_patterns": [
            r"©", r"\bcopyright\b", r"\ball\s+rights\s+reserved\b", r"\btodos\s+los\s+derechos\s+(?:est[aá]n\s+)?reservados\b", r"\bprohibid[ao]\s+(?:su|la|el)\s+(?:reproducci[oó]n|copia|distribuci[oó]n)\b",
            r"\bmarcas?\s+(?:registradas?|comerciales?)\b", r"\b(?:registered\s+)?trademarks?\b", r"\bdisclaimer\b", r"\bexenci[oó]n\s+de\s+responsabilidad\b", r"\bsin\s+previo\s+aviso\b",
            r"\bwithout\s+(?:prior\s+)?notice\b", r"\bcreative\s+commons\b", r"\bdistribuye\s+bajo\s+(?:una\s+)?licencia\b", r"\bdistributed\s+under\s+(?:a\s+)?(?:creative\s+commons|license)\b",
            r"\breconocimiento(?:‑|-|\s+)no\s*comercial\b", r"\bcopyleft\b", r"\blicencia\s+(?:de\s+uso|creative\s+commons|gpl|mit|apache|cc\b)",
        ],
    },
    "revision_history": {
        "title_patterns": [
            r"revision\s+history", r"version\s+history", r"revision\s+record", r"document\s+history", r"change\s*log", r"historial\s+de\s+(?:revisiones|cambios|versiones)",
            r"hist[oó]rico\s+de\s+(?:revisiones|cambios|versiones)", r"control\s+de\s+(?:cambios|versiones|revisiones)", r"registro\s+de\s+(?:cambios|revisiones)",
        ],
        "line_patterns": [r"^[\s|*\-]*(?:rev(?:isi[oó]n)?\.?|versi[oó]n|version)\s*[:\-]?\s*[A-Za-z0-9][\w.]*"],
    },
    "index_lists": {
        "title_patterns": [
            r"^[íi]ndice(?:\s+(?:general|alfab[eé]tico|de\s+(?:contenidos?|tablas|figuras|ilustraciones|im[aá]genes|anexos|ap[eé]ndices)))?$", r"^tabla\s+de\s+contenidos?$", r"^contenidos?$",
            r"^table\s+of\s+contents$", r"^contents$", r"^list\s+of\s+(?:tables|figures|illustrations)$", r"^lista\s+de\s+(?:tablas|figuras|ilustraciones|im[aá]genes)$",
        ],
    },
    "normative_appendix": {
        "title_patterns": [
            r"declaraci[oó]n\s+(?:de\s+)?(?:conformidad|cumplimiento)", r"declaration\s+of\s+(?:conformity|compliance)", r"certificaciones", r"certifications",
            r"cumplimiento\s+(?:normativo|ambiental|regulatorio|reglamentario)", r"(?:regulatory|environmental)\s+(?:compliance|information)", r"informaci[oó]n\s+(?:regulatoria|normativa)",
            r"marcado\s+ce", r"ce\s+marking", r"\b(?-i:RoHS|REACH|WEEE)\b",
        ],
    },
    "near_empty": {
        "chapter_title_patterns": [
            r"^cap[ií]tulo\s+(?:\d+|[ivxlc]+)$", r"^chapter\s+(?:\d+|[ivxlc]+)$", r"^parte\s+(?:\d+|[ivxlc]+)$", r"^part\s+(?:\d+|[ivxlc]+)$", r"^secci[oó]n\s+\d+$", r"^section\s+\d+$",
        ],
        "blank_page_patterns": [
            r"p[áa]gina\s+(?:intencionalmente\s+)?(?:dejada\s+)?en\s+blanco", r"p[áa]gina\s+(?:se\s+)?dej[óo]\s+en\s+blanco", r"intencionalmente\s+(?:en\s+blanco|vac[ií]a)",
            r"intentionally\s+(?:left\s+)?blank", r"left\s+blank",
        ],
        "protected_patterns": [r"\b(?:advertencia|peligro|precauci[oó]n|cuidado|atenci[oó]n|importante|warning|danger|caution|important)\b"],
    },
}
CATEGORIES = ("legal", "revision_history", "index_lists", "normative_appendix", "near_empty")
MIN_LEGAL, MAX_LEGAL_CHARS, MIN_REVISION_LINES, MAX_REVISION_CHARS = 2, 1500, 3, 2000
MIN_LEADER_LINES, MIN_LEADER_RATIO, MIN_SECTION_CHARS, MAX_DISCARD = 2, 0.4, 40, 0.4
# ----------------------------------------------------------------------------------------------------------------

YEAR = r"\b(?:19|20)\d{2}\b"
DOT_LEADER = r"(?:(?:\.[ \t]?){4,}|…+)[ \t]*(?:\d+|[ivxlcdm]+)[ \t]*$"


def load_patterns(overrides: dict | None = None) -> dict[str, dict[str, list[str]]]:
    """The patterns, lists that ``overrides`` names replaced; unknown names and invalid patterns are passed over."""
    import re

    out = {k: {n: list(v) for n, v in lists.items()} for k, lists in PATTERNS.items()}
    for category, lists in (overrides or {}).items():
        for name, values in (lists or {}).items():
            if name in out.get(category, {}):
                good = []
                for v in values:
                    try:
                        re.compile(v.replace("(?-i:", "(?:"))
                        good.append(v)
                    except re.error:
                        pass
                out[category][name] = good
    return out


def _any(patterns: list[str]) -> str:
    return "(?iu)(?:" + "|".join(patterns) + ")"


def _hit(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(c.rlike(_any(patterns)), F.lit(False)) if patterns else F.lit(False)


def category(title: Column, content: Column, patterns: dict | None = None, categories: tuple[str, ...] = CATEGORIES) -> Column:
    """The first class that fits, in fixed order, else null; blank content is never noise."""
    p = patterns or PATTERNS
    name = normalize_title(F.coalesce(title, F.lit("")))
    lines = F.filter(F.split(content, "\n"), lambda x: strip(x) != "")
    legal_hits = reduce(lambda a, b: a + b, [content.rlike("(?iu)" + x).cast("int") for x in p["legal"]["content_patterns"]], F.lit(0))
    leaders = F.size(F.filter(lines, lambda x: x.rlike("(?iu)" + DOT_LEADER)))
    dated = F.size(F.filter(lines, lambda x: x.rlike(YEAR) & _hit(x, p["revision_history"]["line_patterns"])))
    blank = _hit(content, p["near_empty"]["blank_page_patterns"])
    useful = F.length(F.regexp_replace(F.regexp_replace(content, _any(p["near_empty"]["blank_page_patterns"]), ""), r"[^\p{L}\p{N}]", ""))
    protected = _hit(F.concat_ws("\n", name, content), p["near_empty"]["protected_patterns"])
    tests = {
        "legal": _hit(name, p["legal"]["title_patterns"]) | ((F.length(content) <= MAX_LEGAL_CHARS) & (legal_hits >= MIN_LEGAL)),
        "revision_history": _hit(name, p["revision_history"]["title_patterns"]) | ((F.length(content) <= MAX_REVISION_CHARS) & (dated >= MIN_REVISION_LINES)),
        "index_lists": _hit(name, p["index_lists"]["title_patterns"]) | ((leaders >= MIN_LEADER_LINES) & (leaders >= MIN_LEADER_RATIO * F.size(lines))),
        "normative_appendix": _hit(name, p["normative_appendix"]["title_patterns"]),
        "near_empty": ~protected & (useful < MIN_SECTION_CHARS) & ((name == "") | _hit(name, p["near_empty"]["chapter_title_patterns"]) | blank),
    }
    out = F.when(F.coalesce(strip(content), F.lit("")) == "", F.lit(None).cast("string"))
    for c in CATEGORIES:
        if c in categories:
            out = out.when(tests[c], c)
    return out
