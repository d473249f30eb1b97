"""Queries of the generation flow: plans, excerpts, batches, published items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import generation as X
from ..operators import summary as S
from .registry import Tables, query

_DOC = "source || '-' || (doc_id // 40)"


def _planned(t: Tables):
    """Documents of up to forty chunks, some under navigational or page titles; a third of them are asked for summaries."""
    n = F.col("doc_id")
    doc = F.concat("source", F.lit("-"), F.floor(n / 40).cast("string"))
    title = F.when(n % 11 == 0, "Introduction").when(n % 7 == 0, F.concat(F.lit("página "), n.cast("string"))).otherwise(F.col("lang"))
    chunks = t.documents.select(doc.alias("document_id"), n.alias("position"), F.concat(F.lit("chunk-"), n.cast("string")).alias("chunk_id"), title.alias("title"), F.col("text").alias("content"), F.col("lang").alias("breadcrumb"), (n % 4).alias("page_number"))
    fmt = F.get(F.array(*map(F.lit, ["resumen", "Tutorial ", "flashcards"])), (F.floor(n / 40) % 3).cast("int"))
    requests = t.documents.select(doc.alias("document_id"), fmt.alias("fmt"), F.lit(12).alias("requested"), F.lit("English").alias("language")).distinct()
    return chunks, requests


_PLAN = rf"""
WITH c AS (SELECT {_DOC} AS document_id, doc_id AS position, 'chunk-' || doc_id AS chunk_id, CASE WHEN doc_id % 11 = 0 THEN 'Introduction' WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS title, coalesce(text, '') AS content, lang, doc_id % 4 AS page,
  (doc_id // 40) % 3 = 0 AS summary, (doc_id // 40) % 3 = 2 AS cards FROM documents),
l AS (SELECT *, length(regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', '')) >= 80 AS long, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM c),
f AS (SELECT *, long AND coalesce(title, '') <> 'Introduction' AS plain, long AND (coalesce(title, '') <> 'Introduction' OR len(ls) > 0 AND len(list_filter(ls, lambda x: length(x) >= 60)) >= greatest(1, floor(len(ls) / 2)) AND len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) >= 40) AS prose FROM l),
a AS (SELECT *, bool_or(plain) OVER w AS any_plain, bool_or(prose) OVER w AND summary AS any_prose FROM f WINDOW w AS (PARTITION BY document_id)),
u AS (SELECT *, sum(CASE WHEN plain OR NOT any_plain THEN length(content) ELSE 0 END) OVER (PARTITION BY document_id) AS total FROM a),
k AS (SELECT *, CASE WHEN title IS NULL AND NOT (any_plain OR any_prose) THEN 'página ' || position ELSE title END AS t FROM u WHERE CASE WHEN any_prose THEN prose ELSE plain OR NOT any_plain END),
s AS (SELECT *, coalesce(t, 'Sección ' || sum(CASE WHEN t IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY position)) AS section_title FROM k),
n AS (SELECT *, min(position) OVER (PARTITION BY document_id, section_title) AS first, row_number() OVER (PARTITION BY document_id, section_title ORDER BY position) - 1 AS chunk_no FROM s),
p AS (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY first) - 1 AS section_no FROM n)
"""


@query(_PLAN + """
, g AS (SELECT document_id, section_no, section_title, sum(length(content)) AS weight, count(*) AS n_chunks, min_by(chunk_id, position) AS chunk, min_by(page, position) FILTER (page > 0) AS page, any_value(summary) AS summary, any_value(cards) AS cards, any_value(total) AS total FROM p GROUP BY ALL),
v AS (SELECT *, greatest(3, total // CASE WHEN cards THEN 50 ELSE 120 END) AS most FROM g),
q AS (SELECT *, 12 > most AND total < 800 AS capped, CASE WHEN 12 > most AND total < 800 THEN least(12, most) ELSE 12 END AS viable FROM v),
b AS (SELECT *, greatest(1, floor(viable * weight / (sum(weight) OVER (PARTITION BY document_id))::DOUBLE)) AS base FROM q WHERE NOT summary),
d AS (SELECT *, viable - sum(base) OVER (PARTITION BY document_id) AS diff, row_number() OVER (PARTITION BY document_id ORDER BY weight DESC, section_no) AS heavy, row_number() OVER (PARTITION BY document_id ORDER BY base DESC, section_no) AS large FROM b),
o AS (SELECT document_id, section_no, section_title, n_chunks, base + CASE WHEN diff > 0 AND heavy <= diff THEN 1 WHEN diff < 0 AND large <= -diff AND base > 1 THEN -1 ELSE 0 END AS items, chunk, page, capped, viable, most, CASE WHEN cards THEN 'distributed' ELSE 'sequential' END AS strategy FROM d
  UNION ALL SELECT document_id, min(section_no), min_by(section_title, section_no), sum(n_chunks), any_value(viable), min_by(chunk, section_no), min_by(page, section_no) FILTER (page IS NOT NULL), any_value(capped), any_value(viable), any_value(most), 'holistic' FROM q WHERE summary GROUP BY document_id)
SELECT document_id, strategy, section_no::BIGINT AS section_no, section_title, n_chunks::BIGINT AS n_chunks, items::BIGINT AS allocated_items, chunk AS primary_chunk_id, page::BIGINT AS page_number, (CASE WHEN capped THEN most ELSE greatest(12, most) END)::BIGINT AS capacity, viable::BIGINT AS viable,
  CASE WHEN capped AND viable < 12 THEN 'The document has enough content to generate ' || viable::BIGINT || ' verified item(s). 12 were requested. Only the viable count will be generated; no fabricated content will be added.' END AS warning FROM o
""")  # fmt: skip
def coverage_plan(t: Tables):
    """Sections of each document with their items, by strategy of the format."""
    out = X.coverage_plan(*_planned(t))
    return out.withColumn("section_no", F.col("section_no").cast("long"))


@query(_PLAN + """
, x AS (SELECT *, regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '')[1:300] AS fragment FROM p WHERE summary),
r AS (SELECT *, coalesce(sum(length(fragment)) OVER (PARTITION BY document_id ORDER BY chunk_no, section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM x WHERE fragment <> ''),
e AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_no, section_no) AS nth, '[' || chunk_id || '] SECTION: ' || section_title || ' | ' || lang || CASE WHEN page > 0 THEN ' | p.' || page ELSE '' END || chr(10) || regexp_replace(fragment, '\\s+$', '') AS block FROM r WHERE used < 6000)
SELECT document_id, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY nth)) AS md5, count(*)::BIGINT AS n FROM e GROUP BY document_id
""".replace("\\\\", "\\"))  # fmt: skip
def summary_prompts(t: Tables):
    """What the writer of a summary is shown of the whole document."""
    shown = X.excerpts(X.planned_chunks(*_planned(t)).filter("strategy = 'holistic'"))
    info = X.joined_blocks(shown, ["document_id"], "Document")
    return info.join(shown.groupBy("document_id").agg(F.count("*").alias("n")), "document_id").select("document_id", F.md5("chunk_info").alias("md5"), "n")


def _echo(calls):
    """A deterministic generator: it answers every second call with as many cards as asked for, others with what can't be read."""
    card = F.transform(F.sequence(F.lit(1), F.col("item_count")), lambda k: F.struct(F.concat(F.lit("Card "), k.cast("string"), F.lit(" of the call")).alias("frente"), F.md5(F.concat("prompt", k.cast("string"))).alias("dorso")))
    raw = F.when(F.pmod(F.col("call_no"), F.lit(2)) == 0, F.concat(F.lit("```json\n"), F.to_json(card), F.lit("\n```"))).otherwise("sorry")
    return calls.select("run_id", "call_no", raw.alias("raw"))


@query()
def generated_batches(t: Tables):
    """Items of runs by batches, stand-ins where an answer can't be read."""
    chunks, requests = _planned(t)
    planned = X.kept(X.planned_chunks(chunks, requests).filter("strategy = 'distributed'"))
    info = X.joined_blocks(X.excerpts(planned), ["document_id", "section_no"])
    plan = X.kept(X.coverage_plan(chunks, requests, planned).join(info, ["document_id", "section_no"]))
    topics = plan.select(
        F.col("document_id").alias("run_id"), F.col("section_no").alias("topic_no"), F.col("section_title").alias("topic"), F.col("chunk_info").alias("context"), F.col("primary_chunk_id").alias("chunk_id"), F.col("page_number").alias("page"),
        "chunk_info", F.col("allocated_items").alias("target_items"),
    )
    requests = plan.select(F.col("document_id").alias("run_id"), F.col("viable").alias("target")).distinct()
    out = X.generated(topics, requests, _echo, "Write {item_count} cards about {topic}.\n{chunk_info}", "flashcards")
    return out.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("es_fallback").alias("n_fallback"), F.max("item_idx").alias("last"))


def _items(t: Tables):
    n = F.col("doc_id")
    run = F.concat("source", F.lit("-"), F.floor(n / 100).cast("string"))
    title = F.concat(F.when(n % 2 == 0, "Paso 3: Step 4 - ").otherwise(""), F.when(n % 5 != 0, F.concat(F.lit("Tema "), "lang")).otherwise(""))
    item = F.struct(title.alias("titulo"), F.regexp_extract("text", r"^([^\n]{1,200})", 1).alias("instruccion"), F.lit("").alias("ejemplo"))
    items = t.documents.select(run.alias("run_id"), F.concat(F.lit("g"), n.cast("string")).alias("gid"), n.alias("item_idx"), X.as_item(item).alias("item"), (n % 3 != 0).alias("grounded"), F.lit(False).alias("es_fallback"))
    low = F.when(n % 4 == 0, "Baja").otherwise("")
    records = t.documents.filter("doc_id % 9 <> 1").select(run.alias("run_id"), F.concat(F.lit("g"), n.cast("string")).alias("gid"), (n % 8 != 5).alias("verified"), low.alias("clarity"), F.lit(None).cast("array<string>").alias("issues"))
    targets = t.documents.select(run.alias("run_id")).distinct().withColumns({"target": F.lit(30), "requested": F.lit(40), "language": F.lit("es"), "clarity": F.lit(None).cast("string"), "observations": F.lit(" bien "), "warning": F.lit(None).cast("string")})
    return items, records, targets


_ITEMS = r"""
WITH i AS (SELECT source || '-' || (doc_id // 100) AS run_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Paso 3: Step 4 - ' ELSE '' END || CASE WHEN doc_id % 5 <> 0 THEN 'Tema ' || lang ELSE '' END AS titulo, coalesce(regexp_extract(text, '^([^\n]{1,200})', 1), '') AS instruccion, doc_id % 3 <> 0 AS lexical,
  CASE WHEN doc_id % 9 <> 1 THEN doc_id % 8 <> 5 END AS vote, doc_id % 9 <> 1 AND doc_id % 4 = 0 AS low FROM documents),
g AS (SELECT *, trim(titulo) = '' AND trim(instruccion) = '' AS nothing, len(list_filter(string_split_regex(trim(titulo) || ' ' || trim(instruccion), '\s+'), lambda x: x <> '')) AS words FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY doc_id) - 1 AS nth FROM g WHERE NOT (trim(titulo) = '' OR words < 5 OR low AND NOT (coalesce(vote, true) AND lexical))),
f AS (SELECT *, lexical AND coalesce(vote, true) AS verified FROM k WHERE nth < 30)
"""


@query(_ITEMS + """
, p AS (SELECT run_id, count(*) AS n, count(*) FILTER (verified) AS ok FROM f GROUP BY run_id),
r AS (SELECT DISTINCT run_id FROM i)
SELECT run_id, 40::INTEGER AS requested, coalesce(n, 0)::BIGINT AS generated, round_even(coalesce(ok, 0) / greatest(1, coalesce(n, 0))::DOUBLE, 2) AS score, greatest(3, 2 * coalesce(n, 0))::BIGINT AS minutes,
  coalesce(ok, 0) || ' de ' || coalesce(n, 0) || ' elementos verificados. bien' AS observations, NULL::VARCHAR AS notice, NULL::VARCHAR AS warning FROM r LEFT JOIN p USING (run_id)
""")  # fmt: skip
def published_outcome(t: Tables):
    """Scores, notices and times of outputs."""
    items, records, targets = _items(t)
    return X.outcome(X.published(items, records, targets, "tutorial"), targets, "tutorial")


@query(_ITEMS + r"""
SELECT run_id, nth::INTEGER AS nth, 'Paso ' || (nth + 1) || ': ' || CASE WHEN doc_id % 5 <> 0 THEN trim(regexp_replace(titulo, '^Paso 3: Step 4 - ', '')) ELSE 'Módulo ' || (nth + 1) END AS heading, verified, CASE WHEN low THEN 'Baja' ELSE 'Alta' END AS clarity FROM f
""")  # fmt: skip
def published_steps(t: Tables):
    """Published items, assembled as steps of a tutorial."""
    items, records, targets = _items(t)
    final = X.published(items, records, targets, "tutorial")
    return X.assembled(final, "tutorial").join(final.select("run_id", "nth", "verified", "clarity"), ["run_id", "nth"]).select("run_id", "nth", "heading", "verified", "clarity")


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::INTEGER AS n_body, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END::INTEGER AS n_references, source AS first FROM documents
""")
def stored_summaries(t: Tables):
    """Paragraphs and references of stored summaries, composed or of the older form."""
    n = F.col("doc_id")
    body = F.when(n % 2 == 0, F.concat(F.col("source"), F.lit("\n\n FUENTES \n[1] x\n"))).otherwise(F.concat(F.lit("Resumen ejecutivo (2 PUNTOS):\n1. "), F.col("source"), F.lit("\n2.  b: c")))
    paragraphs, references = S.split_summary(body)
    lines = F.when(n % 2 == 0, paragraphs).otherwise(S.legacy_paragraphs(body))
    return t.documents.select("doc_id", F.size(lines).alias("n_body"), F.size(references).alias("n_references"), F.get(lines, F.lit(0)).alias("first"))


@query()
def focused_windows(t: Tables):
    """Windows around a passage, cut at sentences or words."""
    return t.documents.select("doc_id", F.length(T.context_window(F.col("text"), 300, F.substring("text", 500, 40))).alias("chars"))


_RAW = """CASE doc_id % 8
 WHEN 0 THEN '{"frente": "' || source || '", "dorso": "' || lang || '", "fuentes": [{"chunk_id": "c' || doc_id || '", "extracto": "x", "pagina": ' || doc_id || '}]}'
 WHEN 1 THEN '{"front": "' || source || '", "back": "b", "frente": "first", "pista_didactica": null}'
 WHEN 2 THEN '{"frente": "' || source || '"}'
 WHEN 3 THEN '{"frente": ' || doc_id || ', "dorso": ["' || lang || '"], "fuentes": {}}'
 WHEN 4 THEN 'no json from ' || source
 WHEN 5 THEN '```json' || chr(10) || '{"frente": "f", "dorso": "' || lang || '", "extra": 1}' || chr(10) || '```'
 WHEN 6 THEN '{"frente": "f", "dorso": "d", "fuentes": [{"chunk_id": "c"}, {"chunk_id": 7, "extracto": "y", "pagina": "seven"}, ' || doc_id || ']}'
 ELSE '[' || doc_id || ']' END"""


@query(f"""
WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(trim(raw), '^```json', ''), '```$', ''), ' ' || chr(10)) AS j FROM r),
v AS (SELECT doc_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM c),
o AS (SELECT doc_id, j, coalesce(json_extract(j, '$.frente'), json_extract(j, '$.front')) AS front, coalesce(json_extract(j, '$.dorso'), json_extract(j, '$.back')) AS back, json_extract(j, '$.fuentes') AS sources FROM v),
s AS (SELECT doc_id, unnest(json_extract(sources, '$[*]')) AS s, generate_subscripts(json_extract(sources, '$[*]'), 1) - 1 AS i FROM o WHERE json_type(sources) = 'ARRAY'),
p AS (
  SELECT doc_id, '' AS path, CASE WHEN j IS NULL THEN 'json_invalid' ELSE 'object_type' END AS problem FROM o WHERE j IS NULL OR json_type(j) <> 'OBJECT'
  UNION ALL SELECT doc_id, 'frente', CASE WHEN front IS NULL THEN 'missing' ELSE 'string_type' END FROM o WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(front), '') <> 'VARCHAR'
  UNION ALL SELECT doc_id, 'dorso', CASE WHEN back IS NULL THEN 'missing' ELSE 'string_type' END FROM o WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(back), '') <> 'VARCHAR'
  UNION ALL SELECT doc_id, 'fuentes', 'list_type' FROM o WHERE json_type(j) = 'OBJECT' AND json_type(sources) NOT IN ('ARRAY', 'NULL')
  UNION ALL SELECT doc_id, 'fuentes.' || i, 'object_type' FROM s WHERE json_type(s) <> 'OBJECT'
  UNION ALL SELECT doc_id, 'fuentes.' || i || '.' || f, CASE WHEN json_extract(s, '$.' || f) IS NULL THEN 'missing' ELSE 'string_type' END FROM s CROSS JOIN (VALUES ('chunk_id'), ('extracto')) n(f)
    WHERE json_type(s) = 'OBJECT' AND coalesce(json_type(json_extract(s, '$.' || f)), '') <> 'VARCHAR'
  UNION ALL SELECT doc_id, 'fuentes.' || i || '.pagina', 'int_type' FROM s WHERE json_type(s) = 'OBJECT' AND json_extract(s, '$.pagina') IS NOT NULL AND try_cast(json_extract_string(s, '$.pagina') AS BIGINT) IS NULL
), n AS (SELECT doc_id, string_agg(path || ':' || problem, ',' ORDER BY path, problem) AS problems FROM p GROUP BY doc_id)
SELECT o.doc_id, coalesce(problems, '') AS problems, CASE WHEN problems IS NULL THEN json_extract_string(front, '$') END AS front,
  CASE WHEN problems IS NULL THEN json_extract_string(back, '$') END AS back, CASE WHEN problems IS NULL THEN json_array_length(sources) END::INTEGER AS n_sources
FROM o LEFT JOIN n USING (doc_id)
""")
def validated_generation(t: Tables):
    """Answers against the contract of a card; conforming ones under the model's own names."""
    from ..operators import schemas as N

    v = N.parsed(F.expr(_RAW))
    rows = t.documents.select("doc_id", N.violations(v, N.FLASHCARD).alias("vs"), N.instance(v, N.FLASHCARD).alias("card"))
    told = F.array_join(F.transform(F.array_sort("vs"), lambda x: F.concat(x["path"], F.lit(":"), x["problem"])), ",")
    return rows.select("doc_id", told.alias("problems"), "card.front", "card.back", F.when(F.col("card.sources").isNotNull(), F.size("card.sources")).alias("n_sources"))
