"""Queries of citations, models, stored outputs and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import citations as C
from ..operators import diagnostics as Q
from .registry import Tables, query


def _case(t: Tables):
    """Runs are sources: documents are excerpts of the plan, and every item cites the document two further on."""
    d = t.documents
    place = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("Sección "), "lang", F.lit(" "), (F.col("doc_id") % 11).cast("string")))
    crumb = F.concat(F.col("source"), F.lit(" > "), F.col("lang"))
    excerpts = d.select(F.col("source").alias("run_id"), F.concat(F.lit("chunk "), (F.col("doc_id") / 2).cast("long")).alias("chunk_id"), place.alias("section"), (F.col("doc_id") % 7).alias("page"), crumb.alias("breadcrumb"), F.col("doc_id").alias("nth"))
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Otra "), (F.col("doc_id") % 4).cast("string")))
    cited = F.concat(F.lit("chunk "), ((F.col("doc_id") + 2) / 4).cast("long"))
    sources = d.filter("doc_id % 6 <> 1").select(F.col("source").alias("run_id"), F.col("doc_id").alias("item_idx"), cited.alias("chunk_id"), own.alias("section"), (F.col("doc_id") % 2).alias("page"), F.lit("").alias("breadcrumb"))
    items = d.select(F.col("source").alias("run_id"), F.col("doc_id").alias("item_idx"))
    return items, sources, excerpts


_CASE = """
WITH e AS (SELECT source AS run_id, 'chunk ' || (doc_id // 2) AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Sección ' || lang || ' ' || (doc_id % 11) END AS section, doc_id % 7 AS page, source || ' > ' || lang AS breadcrumb, doc_id AS nth FROM documents),
s AS (SELECT source AS run_id, doc_id AS item_idx, 'chunk ' || ((doc_id + 2) // 4) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN ' Otra ' || (doc_id % 4) END AS section, doc_id % 2 AS page FROM documents WHERE doc_id % 6 <> 1),
l AS (SELECT run_id, chunk_id, max_by(section, nth) AS located FROM e WHERE section <> '' GROUP BY ALL),
c AS (SELECT s.run_id, s.item_idx, coalesce(located, nullif(trim(section), '')) AS cited FROM s LEFT JOIN l USING (run_id, chunk_id))
"""


@query(_CASE + """
SELECT d.source AS run_id, d.doc_id AS item_idx, coalesce(string_agg(DISTINCT cited, '|' ORDER BY cited), '__sin_fuente__') AS sections
FROM documents d LEFT JOIN c ON c.run_id = d.source AND c.item_idx = d.doc_id GROUP BY ALL
""")  # fmt: skip
def cited_sections(t: Tables):
    """The sections that an item cites."""
    return C.section_keys(*_case(t)).withColumn("sections", F.array_join("sections", "|"))


@query(_CASE + """
SELECT run_id, section, row_number() OVER (PARTITION BY run_id ORDER BY min(nth), section)::INTEGER AS nth FROM e
WHERE section <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.run_id = e.run_id AND c.cited = e.section) GROUP BY run_id, section
""")  # fmt: skip
def pending_sections(t: Tables):
    """Sections that nothing cites yet."""
    _, sources, excerpts = _case(t)
    return C.pending_sections(sources, excerpts)


@query(_CASE + """
, f AS (SELECT run_id, chunk_id, min_by(page, nth) AS fp, min_by(section, nth) AS fs, min_by(breadcrumb, nth) AS fb FROM e GROUP BY ALL)
SELECT s.run_id, s.item_idx, coalesce(nullif(s.page, 0), CASE WHEN fp > 0 THEN fp END) AS page, coalesce(nullif(s.section, ''), nullif(fs, ''), s.section) AS section, coalesce(nullif(fb, ''), '') AS breadcrumb
FROM s LEFT JOIN f USING (run_id, chunk_id)
""")  # fmt: skip
def enriched_sources(t: Tables):
    """Citations with the page, section and breadcrumb that they lack."""
    _, sources, excerpts = _case(t)
    return C.enriched(sources, excerpts).select("run_id", "item_idx", "page", "section", "breadcrumb")


def _passages(t: Tables):
    rows = t.documents.select(F.col("source").alias("run_id"), F.concat(F.lit("chunk "), "doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("doc_id").alias("nth"))
    return rows.filter("nth % 4 = 0"), rows


@query("""
SELECT source AS run_id, 'chunk ' || doc_id AS chunk_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id % 4 <> 0, doc_id) <= 10
""")
def supplemented_facts(t: Tables):
    """Passages, supplemented by other chunks up to ten."""
    return C.supplemented(*_passages(t), 10).select("run_id", "chunk_id")


@query("""
SELECT a.source AS run_id, a.doc_id AS item_idx, 'chunk ' || (a.doc_id + 1) AS chunk_id, md5(coalesce(b.text, '')) AS text_md5
FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.source = a.source
""")
def repair_context(t: Tables):
    """The texts of cited passages that a repair is shown."""
    sources = t.documents.select(F.col("source").alias("run_id"), F.col("doc_id").alias("item_idx"), F.concat(F.lit("chunk "), F.col("doc_id") + 1).alias("chunk_id"))
    return C.cited_texts(sources, *_passages(t)).select("run_id", "item_idx", "chunk_id", F.md5("text").alias("text_md5"))


@query("""
WITH m AS (SELECT source AS run_id, lang AS provider, count(DISTINCT doc_id % 5) AS n, string_agg(DISTINCT lang || '/m' || (doc_id % 5), ',' ORDER BY lang || '/m' || (doc_id % 5)) AS d FROM documents WHERE doc_id % 5 > 0 GROUP BY ALL)
SELECT run_id, string_agg(CASE provider WHEN 'en' THEN 'E' ELSE provider END || '(' || n || ')', ', ' ORDER BY provider) AS models,
  string_agg(CASE WHEN provider = 'en' THEN replace(d, 'en/', 'E/') ELSE d END, ',' ORDER BY provider) AS detail FROM m GROUP BY run_id
""")
def models_used(t: Tables):
    """Distinct models by provider."""
    calls = t.documents.select(F.col("source").alias("run_id"), F.col("lang").alias("provider"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("m"), (F.col("doc_id") % 5).cast("string"))).alias("model"))
    return Q.models_used(calls, {"en": "E"})


@query("""
SELECT doc_id, source || ' ' || lang || ' x y' AS item_text FROM documents
""")
def text_without_citations(t: Tables):
    """Q8: an item's own texts and lists of texts, without its sources."""
    fields = F.struct(F.col("source").alias("frente"), F.col("lang").alias("dorso"), F.array(F.lit("x"), F.lit("y")).alias("opciones"), F.col("doc_id").alias("n"), F.array(F.struct(F.col("text").alias("extracto"))).alias("fuentes"))
    return Q.item_text(t.documents.select("doc_id", fields.alias("item")), "item").select("doc_id", "item_text")


@query(r"""
WITH j AS (SELECT doc_id, json_object('metadatos', json_object('aviso_cantidad', CASE WHEN doc_id % 3 = 0 THEN 'hay 6 items' ELSE 'hay 16' END), 'evaluacion_calidad', json_object('observaciones', doc_id::VARCHAR)) AS r FROM documents),
f AS (SELECT doc_id, 'aviso_cantidad' AS field, json_extract_string(r, '$.metadatos.aviso_cantidad') AS value FROM j UNION ALL SELECT doc_id, 'observaciones', json_extract_string(r, '$.evaluacion_calidad.observaciones') FROM j)
SELECT * FROM f WHERE regexp_matches(value, '\b6\b')
""")
def stored_number_signals(t: Tables):
    """Q11: fields of stored outputs that hold a number by itself."""
    notice = F.when(F.col("doc_id") % 3 == 0, "hay 6 items").otherwise("hay 16")
    stored = F.to_json(F.struct(F.struct(notice.alias("aviso_cantidad")).alias("metadatos"), F.struct(F.col("doc_id").cast("string").alias("observaciones")).alias("evaluacion_calidad")))
    return Q.number_signals(t.documents.select("doc_id", stored.alias("response_json")), "doc_id", "6")


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE coalesce(source, 'General') END AS profile, 'Tutorial' AS format, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE greatest(1, 3 * (doc_id % 4)) END::BIGINT AS minutes,
  CASE WHEN doc_id % 5 = 0 THEN 0.5::DOUBLE END AS score, CASE doc_id % 4 WHEN 0 THEN 'Alta' WHEN 1 THEN 'Baja' WHEN 2 THEN 'Media' ELSE 'Alta' END AS clarity FROM documents
""")
def library_projects(t: Tables):
    """Q15: stored rows as projects, with nested defaults."""
    d = t.documents
    clarity = F.element_at(F.array(F.lit("High"), F.lit("Low"), F.lit("Media"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = d.select(
        "doc_id", F.col("source").alias("recipient_profile"), F.lit(None).cast("string").alias("output_format"), (F.col("doc_id") % 4).alias("n_items"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("perfil_aplicado"), F.lit(None).cast("string").alias("formato_generado"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(7)).cast("long").alias("tiempo"), F.when(F.col("doc_id") % 5 == 0, F.lit(0.5)).alias("score"), clarity.alias("claridad"),
    )
    return Q.projects(rows).select("doc_id", "profile", "format", "minutes", "score", "clarity")


@query("""
SELECT event_id, user_id <= 100 AS accepted, greatest(1, least(60, user_id)) AS clamped, false AS uuid,
  CASE WHEN user_id % 3 = 0 AND user_id % 2 = 0 THEN 'supabase' WHEN user_id % 5 = 0 THEN 'oci' WHEN user_id % 2 = 0 THEN 'supabase' ELSE 'local' END AS backend FROM events
""")
def request_checks(t: Tables):
    """Quantities, ids and the backend of requests."""
    u = F.col("user_id")
    backend = L.storage_backend(F.when(u % 3 == 0, "supabase").otherwise("oci"), u % 5 == 0, u % 2 == 0)
    return t.events.select("event_id", L.accepted_quantity(u).alias("accepted"), L.clamped_quantity(u, 1, 60).cast("long").alias("clamped"), L.is_uuid(u.cast("string")).alias("uuid"), backend.alias("backend"))


@query("""
WITH c AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN '429 Too Many, retry in 7.5s' WHEN 1 THEN 'RESOURCE_EXHAUSTED' WHEN 2 THEN 'INVALID_ARGUMENT: too long' ELSE 'retry in 9s' END AS m, user_id % 2 = 0 AS gem, user_id FROM events)
SELECT event_id, user_id % 4 < 2 AS limited, user_id % 4 = 2 AND gem OR user_id % 4 >= 2 AND NOT gem AS splittable, CASE user_id % 4 WHEN 0 THEN 8.5 WHEN 1 THEN 60 ELSE 5 END::DOUBLE AS wait_s FROM c
""")
def provider_errors(t: Tables):
    """Classes of provider errors and the waits after them."""
    u = F.col("user_id")
    m = F.when(u % 4 == 0, "429 Too Many, retry in 7.5s").when(u % 4 == 1, "RESOURCE_EXHAUSTED").when(u % 4 == 2, "INVALID_ARGUMENT: too long").otherwise("retry in 9s")
    rows = t.events.select("event_id", m.alias("m"), F.when(u % 2 == 0, "gemini").otherwise("jina").alias("p"), F.lit(None).cast("int").alias("code"))
    c = F.col
    return rows.select("event_id", L.is_rate_limit(c("m"), c("code")).alias("limited"), L.is_splittable(c("p"), c("m"), c("code")).alias("splittable"), L.retry_wait(c("m"), c("code")).alias("wait_s"))


@query(r"""
SELECT doc_id, 'usuarios/' || source || '/contenidos/c_' || doc_id || '/' || lang || '-flashcards-' || CASE WHEN doc_id % 2 = 0 THEN 'docente-' ELSE '' END || '20240102' || CASE WHEN doc_id % 3 > 1 THEN '-v' || (doc_id % 3) ELSE '' END || '.json' AS key FROM documents
""")
def content_keys(t: Tables):
    """Object keys of generated content."""
    n = F.col("doc_id")
    key = T.content_key(F.col("source"), F.concat(F.lit("c/"), n.cast("string")), F.col("lang"), F.lit("Flashcards!"), F.when(n % 2 == 0, "Docente"), F.lit("2024-01-02").cast("date"), n % 3)
    return t.documents.select("doc_id", key.alias("key"))
