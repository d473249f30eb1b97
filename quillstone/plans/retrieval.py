"""Queries of retrieval and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import planning as P
from ..operators import retrieval as R
from .registry import Tables, query

QUERY = "the of licensed anand"

_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
_BM25 = r"""
w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean_size FROM w),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ws)) AS term FROM w) GROUP BY term),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df CROSS JOIN stats),
eps AS (SELECT avg(idf) AS m FROM idf),
weight AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM idf CROSS JOIN eps WHERE term IN ('the', 'of', 'licensed', 'anand')),
f AS (SELECT doc_id, len(ws) AS dl, t.term, len(list_filter(ws, lambda x: x = t.term)) AS f, t.idf FROM w CROSS JOIN weight t),
scores AS (SELECT doc_id, round(sum(CASE WHEN f > 0 THEN idf * (f * 2.5) / (f + 1.5 * (1 - 0.75 + 0.75 * dl / mean_size)) ELSE 0 END), 6) AS score FROM f CROSS JOIN stats GROUP BY doc_id)
"""


def _query_vector(t: Tables) -> list[float]:
    return t.embeddings.filter("vec_id = 0").select("embedding").first()[0]


@query(f"""
SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 10
""")
def vector_topk(t: Tables):
    """Exact cosine top 10."""
    return R.top_k(t.embeddings, _query_vector(t), 10).select("vec_id", "score")


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS score FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)
SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1)::BIGINT AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""")
def vector_topk_many(t: Tables):
    """Top 5 for every fiftieth vector as query, against all rows in blocks of queries."""
    queries = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = R.top_k_many(t.embeddings, queries, 5)
    return out.select("query_id", "vec_id", "score", F.col("rank").cast("long"))


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding)::INTEGER AS dimension, 96::INTEGER AS adjusted FROM embeddings
""")
def vector_shapes(t: Tables):
    """Norms and adjusted dimensions."""
    return t.embeddings.select("vec_id", F.round(R.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dimension"), F.size(R.adjusted(F.col("embedding"), 96)).alias("adjusted"))


@query(f"""
WITH s AS (SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 3 DESC, 1 LIMIT 15)
SELECT label AS parent_id, max(score) AS score FROM s GROUP BY label ORDER BY 2 DESC, 1 LIMIT 5
""")
def parent_resolution(t: Tables):
    """Parents of the best children from a pool of three times as many."""
    hits = R.top_k(t.embeddings, _query_vector(t), 15).select("vec_id", F.col("label").alias("parent_id"), "score")
    return R.best_parents(hits)


@query(f"WITH {_BM25} SELECT doc_id, score FROM scores")
def bm25_scores(t: Tables):
    """Okapi scores of all documents."""
    return R.bm25(t.documents, QUERY)


@query(f"""
WITH {_BM25},
lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS l FROM scores),
den AS (SELECT e.vec_id AS doc_id, row_number() OVER (ORDER BY round({_COS}, 6) DESC, e.vec_id) - 1 AS d FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
fused AS (SELECT coalesce(lex.doc_id, den.doc_id) AS doc_id, 1.0::DOUBLE / (60 + coalesce(d, (SELECT n FROM stats))) + 1.0::DOUBLE / (60 + coalesce(l, (SELECT n FROM stats))) AS rrf FROM lex FULL JOIN den ON lex.doc_id = den.doc_id)
SELECT doc_id, round(rrf, 6) AS rrf, (row_number() OVER (ORDER BY rrf DESC, doc_id) - 1)::BIGINT AS rank FROM fused ORDER BY 3 LIMIT 10
""")
def hybrid_retrieval(t: Tables):
    """Fused retrieval, the top 10. The flagship."""
    q = F.array(*[F.lit(float(x)) for x in _query_vector(t)])
    dense = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.round(R.cosine(F.col("embedding"), q), 6).alias("score"))
    return R.fused_top(dense, R.bm25(t.documents, QUERY), 10).select("doc_id", F.round("rrf", 6).alias("rrf"), "rank")


@query(r"""
WITH s AS (SELECT doc_id, source, regexp_extract(text, '^(\S+)', 1) AS title, text FROM documents)
SELECT doc_id, title FROM (SELECT doc_id, title, lower(trim(title)) AS raw, trim(regexp_replace(lower(trim(title)), '^[\d.\-)\s]+', '')) AS bare, text FROM s)
WHERE raw NOT IN ('licencia', 'license', 'summary', 'contents') AND NOT contains(raw, 'license') AND NOT contains(raw, 'licencia') AND length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) >= 80
  AND NOT (regexp_matches(raw, '^(?:(?:p[áa]gina|p[áa]g\.?|page)\s*)?\d+(?:\s*(?:de|of|/)\s*\d+)?$') OR regexp_matches(raw, '^(?:[ivxlcdm.\s\-#*_]+|[#*_~`>\s.\-:,;]+)$'))
""")
def substantive_chunks(t: Tables):
    """chunks that carry content, those with page or roman titles apart."""
    rows = t.documents.select("doc_id", F.regexp_extract("text", r"^(\S+)", 1).alias("title"), F.col("text").alias("content"))
    return P.substantive(rows).filter("title is not null").select("doc_id", "title")


@query(r"""
SELECT doc_id, len(l) > 0 AND len(list_filter(l, lambda x: length(x) >= 60)) >= greatest(1, floor(len(l) / 2)) AND len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) >= 40 AS prose
FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
""")
def prose_predicate(t: Tables):
    """texts that read as prose."""
    return t.documents.select("doc_id", P.looks_like_prose(F.col("text")).alias("prose"))


def _chunk_rows(t: Tables):
    return t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("position"), F.col("lang").alias("title"), F.col("text").alias("content"))


_ALLOC = """
WITH g AS (SELECT source AS document_id, lang AS section_title, sum(length(text))::BIGINT AS weight, count(*)::BIGINT AS n_chunks, min(doc_id) AS p FROM documents GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY p) - 1 AS section_no FROM g),
b AS (SELECT *, greatest(1, floor(20 * weight / (sum(weight) OVER (PARTITION BY document_id))::DOUBLE))::BIGINT AS base FROM s),
d AS (SELECT *, 20 - sum(base) OVER (PARTITION BY document_id) AS diff, row_number() OVER (PARTITION BY document_id ORDER BY weight DESC, section_no) AS heavy, row_number() OVER (PARTITION BY document_id ORDER BY base DESC, section_no) AS large FROM b),
a AS (SELECT document_id, section_title, section_no, weight, (base + CASE WHEN diff > 0 AND heavy <= diff THEN 1 WHEN diff < 0 AND large <= -diff AND base > 1 THEN -1 ELSE 0 END)::BIGINT AS allocated_items FROM d)
"""


@query(_ALLOC + "SELECT document_id, section_title, section_no::INTEGER AS section_no, weight, allocated_items FROM a")
def coverage_allocation(t: Tables):
    """Items per section in proportion to its characters."""
    return P.allocate(P.sections_of(_chunk_rows(t)), 20).select("document_id", "section_title", "section_no", "weight", "allocated_items")


@query(_ALLOC + """
SELECT document_id, section_title, greatest(0, least(allocated_items, 8, 20 - coalesce(sum(allocated_items) OVER (PARTITION BY document_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS ask FROM a
""")
def generation_batches(t: Tables):
    """How many items each section is asked for."""
    rows = P.allocate(P.sections_of(_chunk_rows(t)), 20)
    return P.batches_of(rows, target=F.lit(20)).select("document_id", "section_title", "ask")


@query("""
SELECT doc_id, CASE WHEN 20 > greatest(3, length(text) // 50) AND length(text) < 800 THEN greatest(3, length(text) // 50) ELSE greatest(20, greatest(3, length(text) // 50)) END::BIGINT AS capacity,
  CASE WHEN 20 > greatest(3, length(text) // 50) AND length(text) < 800 THEN 'El documento tiene contenido suficiente para generar ' || greatest(3, length(text) // 50) || ' elemento(s) con calidad verificada. Se solicitaron 20. Se generará la cantidad viable sin incluir contenido inventado.' END AS warning
FROM documents
""")
def capacity(t: Tables):
    """How many cards a text bears, and the warning."""
    cap = L.capacity(F.lit("flashcards"), F.length("text"), F.lit(20)).cast("long")
    return t.documents.select("doc_id", cap.alias("capacity"), P.capacity_warning(cap, F.lit(20), F.lit("es")).alias("warning"))


@query("""
WITH c AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS chunk_no, dense_rank() OVER (PARTITION BY source ORDER BY lang) - 1 AS section_no, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')[1:300] AS fragment FROM documents),
u AS (SELECT *, coalesce(sum(length(fragment)) OVER (PARTITION BY source ORDER BY chunk_no, section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c WHERE fragment <> '')
SELECT source AS document_id, doc_id, chunk_no::INTEGER AS chunk_no, section_no::INTEGER AS section_no, length(fragment)::INTEGER AS chars FROM u WHERE used < 6000
""".replace("\\\\", "\\"))
def round_robin_sample(t: Tables):
    """Fragments of all sections in turn up to the budget."""
    from pyspark.sql import Window

    by = Window.partitionBy("source", "lang").orderBy("doc_id")
    rows = t.documents.select(
        F.col("source").alias("document_id"), "doc_id", (F.row_number().over(by) - 1).alias("chunk_no"), (F.dense_rank().over(Window.partitionBy("source").orderBy("lang")) - 1).alias("section_no"), F.col("text").alias("content")
    )
    return P.round_robin(rows).select("document_id", "doc_id", "chunk_no", "section_no", F.length("fragment").alias("chars"))


@query("""
SELECT doc_id, CASE WHEN contains(lower(lang), 'e') THEN 'gemini' WHEN contains(lower(lang), 'f') THEN 'groq' ELSE 'openrouter' END AS provider,
 CASE (doc_id % 3) WHEN 0 THEN 'gemini' WHEN 1 THEN 'jina' ELSE 'local' END AS embedder,
 CASE (doc_id % 3) WHEN 0 THEN 20 WHEN 1 THEN 50 ELSE 211 END AS batch FROM documents
""")
def provider_routing(t: Tables):
    """Providers of formats, models and batches."""
    model = F.get(F.array(*map(F.lit, ["gemini-embedding@768", "jina-v3@768", "minilm@384"])), F.pmod("doc_id", F.lit(3)).cast("int"))
    tool = L.embedding_provider(model)
    return t.documents.select("doc_id", P.provider_for(F.col("lang"), [("e", "gemini"), ("f", "groq")], "openrouter").alias("provider"), tool.alias("embedder"), L.embedding_batch_size(tool, F.lit(211)).alias("batch"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w),
x AS (SELECT doc_id, h // 2 % 32 AS i, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)::DOUBLE) AS size FROM x GROUP BY doc_id),
f AS (SELECT doc_id, arg_min(i, (-abs(x), i)) AS strongest, arg_min(x, (-abs(x), i)) AS x FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN size > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, 32::INTEGER AS dimension, CASE WHEN size > 0 THEN strongest END::INTEGER AS strongest, CASE WHEN size > 0 THEN round(f.x / size, 6) END AS value
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
""")
def offline_embeddings(t: Tables):
    """Hashed word vectors as a stand-in for a model; their strongest coordinates."""
    v = R.hashed_embeddings(t.documents, dimension=32)
    size = F.round(R.norm(F.col("embedding")), 6)
    ranked = F.array_sort(F.transform("embedding", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"), x.alias("x"))))
    top = F.when(size > 0, F.get(ranked, F.lit(0)))
    return v.select("doc_id", size.alias("norm"), F.size("embedding").alias("dimension"), top["i"].alias("strongest"), F.round(top["x"], 6).alias("value"))
