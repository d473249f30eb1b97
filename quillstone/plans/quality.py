"""Queries of items: texts, grounding, scores, de-duplication, summaries, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import dedup as D
from ..operators import diagnostics as Q
from ..operators import grounding as G
from ..operators import items as I
from ..operators import summary as S
from ..operators.similar import greedy_dedup
from .registry import Tables, query

_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]{{4,}}'))"
_NEG = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: x IN ('no','nunca','jamás','jamas','sin','excepto','neither','nor','not','never','without','except')))"


def _cards(t: Tables):
    """Two-field cards from dialogues: what is asked in front, what is answered behind."""
    asked = t.conversations.filter("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("frente"))
    answered = t.conversations.filter("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("dorso"))
    rows = asked.join(answered, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", F.struct("frente", F.coalesce("dorso", F.lit("")).alias("dorso")).alias("item"))


_CARDS = """
WITH i AS (SELECT a.conv_id, a.turn, a.text AS frente, coalesce(b.text, '') AS dorso FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.turn % 2 = 1 WHERE a.turn % 2 = 0),
x AS (SELECT *, concat_ws(' ', nullif(trim(frente, ' '), ''), nullif(trim(dorso, ' '), '')) AS g FROM i)
"""


@query(_CARDS + r"""
SELECT conv_id, turn, frente AS primary_text, g AS grounding_text, coalesce(nullif(trim(dorso, ' '), ''), g) AS claim_text FROM x
""")
def item_texts(t: Tables):
    """V1 to V5: the texts of items."""
    out = I.item_texts(_cards(t))
    return out.select("conv_id", "turn", "primary_text", "grounding_text", "claim_text")


@query(_CARDS + r"""
SELECT conv_id, turn, (trim(frente, ' ') = '' OR trim(dorso, ' ') = '' OR len(list_filter(string_split_regex(g, '\s+'), lambda w: w <> '')) < 5) AS garbage FROM x
""")
def garbage_items(t: Tables):
    """items to drop."""
    out = I.item_texts(_cards(t))
    return out.select("conv_id", "turn", I.is_garbage(out).alias("garbage"))


def _grounding_case(t: Tables):
    """Each benchmark text claimed of one document: passage and claim meet by number."""
    docs = t.documents.select(F.col("doc_id").alias("n"), F.col("text").alias("passage"))
    return t.benchmark.select("item_id", F.col("text").alias("claim")).join(docs, F.col("item_id") == F.col("n")).drop("n")


@query(f"""
WITH g AS (SELECT b.item_id, b.text AS claim, d.text AS passage FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, round(CASE WHEN len({_WORDS.format('claim')}) > 0 THEN len(list_intersect({_WORDS.format('claim')}, {_WORDS.format('passage')})) / len({_WORDS.format('claim')})::DOUBLE ELSE 0 END, 6) AS overlap,
  len({_NEG.format('claim')})::BIGINT AS negations, contains(lower(trim(passage)), lower(trim(claim))) AS verbatim FROM g
""")
def ground_overlap(t: Tables):
    """Overlaps, negations, verbatim passages."""
    c, p = F.col("claim"), F.col("passage")
    return _grounding_case(t).select(
        "item_id", F.round(G.share(G.words(c), G.words(p)), 6).alias("overlap"), F.size(G.negations(c)).cast("long").alias("negations"), F.lower(F.btrim(p)).contains(F.lower(F.btrim(c))).alias("verbatim")
    )


@query(r"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '\b\d+([.,]\d+)?\b') AS whole, list_transform(regexp_extract_all(text, '\b\d+([.,]\d+)?\b', 1), lambda x: coalesce(x, '')) AS suffix FROM documents)
SELECT doc_id, len(whole)::BIGINT AS numbers, len(list_distinct(suffix))::BIGINT AS marks, len(list_distinct(whole))::BIGINT AS strict_marks FROM n
""")
def ground_numeric(t: Tables):
    """V6: what the numeric gate sees, by default and strictly."""
    c = F.col("text")
    return t.documents.select("doc_id", F.regexp_count(c, F.lit(r"\b\d+([.,]\d+)?\b")).cast("long").alias("numbers"), F.size(G.number_marks(c)).cast("long").alias("marks"), F.size(G.number_marks(c, True)).cast("long").alias("strict_marks"))


def _grounding_tables(t: Tables):
    """Runs are sources: items are the openings of documents, passages the documents; every third cites another one."""
    d = t.documents.select(F.col("source").alias("run_id"), "doc_id", "text")
    items = d.select("run_id", F.concat(F.lit("ground_"), "doc_id").alias("gid"), F.substring("text", 1, 120).alias("claim_text"), F.substring("text", 1, 200).alias("grounding_text"))
    cited = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("nowhere "), "doc_id")).otherwise(F.concat(F.lit("chunk "), "doc_id"))
    sources = d.select("run_id", F.concat(F.lit("ground_"), "doc_id").alias("gid"), cited.alias("chunk_id"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.substring("text", 20, 60)).alias("extracto"))
    passages = d.select("run_id", F.concat(F.lit("chunk "), "doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("doc_id").alias("nth"))
    return items, sources, passages


_P, _E, _C = "lower(trim(passage))", "lower(trim(extracto))", "claim"
_MARKS = r"list_distinct(list_transform(regexp_extract_all(coalesce({}, ''), '\b\d+([.,]\d+)?\b', 1), lambda x: coalesce(x, '')))"


@query(rf"""
WITH i AS (SELECT source AS run_id, doc_id, substr(text, 1, 120) AS claim, substr(text, 1, 200) AS g, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(text, 20, 60) END AS extracto, text FROM documents),
w AS (SELECT *, {_WORDS.format('g')} AS gw FROM i),
n AS (SELECT w.run_id, w.doc_id, p.doc_id AS pid, len(list_intersect(w.gw, {_WORDS.format('p.text')})) AS hits, len(w.gw) AS total
      FROM w JOIN documents p ON p.source = w.run_id WHERE w.doc_id % 3 = 0 AND len(w.gw) > 0),
b AS (SELECT run_id, doc_id, pid FROM n WHERE hits / total::DOUBLE >= 0.25 QUALIFY row_number() OVER (PARTITION BY run_id, doc_id ORDER BY hits DESC, pid) = 1),
r AS (SELECT w.*, CASE WHEN w.doc_id % 3 = 0 THEN d.text ELSE w.text END AS passage FROM w LEFT JOIN b USING (run_id, doc_id) LEFT JOIN documents d ON d.doc_id = b.pid)
SELECT run_id, 'ground_' || doc_id AS gid, coalesce({_P} <> '' AND (
  {_E} <> '' AND (contains({_P}, {_E}) OR contains({_E}, {_P}))
  OR len(list_filter({_NEG.format(_C)}, lambda x: NOT list_contains({_NEG.format(_P)}, x))) = 0 AND len(list_filter({_MARKS.format(_C)}, lambda x: NOT list_contains({_MARKS.format(_P)}, x))) = 0
     AND (len({_WORDS.format(_E)}) > 0 AND len(list_intersect({_WORDS.format(_E)}, {_WORDS.format(_P)})) / len({_WORDS.format(_E)})::DOUBLE >= 0.45
          OR {_E} = '' AND len(gw) > 0 AND len(list_intersect(gw, {_WORDS.format(_P)})) / len(gw)::DOUBLE >= 0.25)), false) AS grounded FROM r
""")
def grounding_verifier(t: Tables):
    """Sources resolved to passages and judged; items with any verified source."""
    items, sources, passages = _grounding_tables(t)
    return G.grounded(items, G.verify(items, sources, passages, language="English", order="nth")).select("run_id", "gid", "grounded")


@query("""
WITH i AS (SELECT d.source AS run_id, 'ground_' || d.doc_id AS gid, contains(d.text, 'e') AS grounded, coalesce(l.quality = 1, true) AS vote FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT run_id, count(*)::BIGINT AS n, round_even(least(1.0::DOUBLE, sum((grounded AND vote)::INT)::DOUBLE / greatest(1, count(*))), 2)::DOUBLE AS score FROM i GROUP BY run_id
""")
def critic_score(t: Tables):
    """The verified share, a missing vote counting as yes."""
    items = t.documents.select(F.col("source").alias("run_id"), F.concat(F.lit("ground_"), "doc_id").alias("gid"), F.col("text").contains("e").alias("grounded"))
    records = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("run_id"), F.concat(F.lit("ground_"), "doc_id").alias("gid"), (F.col("quality") == 1).alias("verified"), F.lit("Alta").alias("clarity"))
    return G.score(G.with_critic(items, records))


@query("""
WITH i AS (SELECT d.source AS run_id, d.doc_id, coalesce(l.quality = 1, true) AS ok, coalesce(l.toxic = 1, false) AS low FROM documents d LEFT JOIN labels l USING (doc_id)),
p AS (SELECT run_id, bool_or((NOT ok OR low) AND doc_id % 2 = 0) AS weak, count(*) AS n FROM i GROUP BY run_id)
SELECT run_id, CASE WHEN weak THEN 'repair' WHEN n < 60 THEN 'refiner' ELSE 'formatter' END AS route FROM p
""")
def routing(t: Tables):
    """Repair, refine or format."""
    rows = t.documents.join(t.labels, "doc_id", "left")
    items = rows.select(
        F.col("source").alias("run_id"), F.coalesce(F.col("quality") == 1, F.lit(True)).alias("verified"), F.when(F.col("toxic") == 1, "Baja").alias("clarity"), (F.col("doc_id") % 2 != 0).alias("repaired")
    )
    targets = t.documents.select(F.col("source").alias("run_id")).distinct().withColumns({"target": F.lit(60), "capacity": F.lit(1000)})
    return G.route(items, targets)


@query("SELECT CASE WHEN o_totalprice / 5000 >= 90 THEN 'excelente' WHEN o_totalprice / 5000 >= 75 THEN 'alta' WHEN o_totalprice / 5000 >= 60 THEN 'media' ELSE 'baja' END AS seal, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def trust_seals(t: Tables):
    """Buckets of a percentage."""
    return t.orders.groupBy(L.trust_seal(F.col("o_totalprice") / 5000).alias("seal")).agg(F.count("*").alias("n"))


@query(r"""
WITH s AS (SELECT doc_id, source, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 15) AS ss FROM documents)
SELECT doc_id, '¿Qué indica el documento sobre ' || source || '?' AS frente, coalesce(ss[(doc_id % greatest(len(ss), 1)) + 1], source) AS dorso, substr(coalesce(ss[(doc_id % greatest(len(ss), 1)) + 1], source), 1, 100) AS extracto FROM s
""")
def fallback_items(t: Tables):
    """Deterministic cards from sentences."""
    topics = t.documents.select("doc_id", F.col("source").alias("topic"), F.col("text").alias("context"), F.col("doc_id").alias("item_idx"))
    return I.fallback_items(topics, "flashcards").select("doc_id", "item.frente", "item.dorso", "extracto")


@query("""
WITH n AS (SELECT source AS run_id, count(*) AS n FROM documents GROUP BY source)
SELECT run_id, (n + u)::BIGINT AS item_idx, (n + u) % 3 AS topic_no FROM n CROSS JOIN unnest(range(0, 5)) AS r(u)
""")
def refiner_completion(t: Tables):
    """What a run is short of, topics taken in turn."""
    items = t.documents.select(F.col("source").alias("run_id"), "doc_id")
    targets = items.groupBy("run_id").agg((F.count("*") + 5).alias("target"))
    topics = t.documents.select(F.col("source").alias("run_id")).distinct().select("run_id", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("topic_no"), F.lit(f"topic {i}").alias("topic"), F.lit("x").alias("context")) for i in range(3)])).alias("s")).select("run_id", "s.*")
    return G.completion(items, topics, targets).select("run_id", F.col("item_idx").cast("long"), "topic_no")


@query("""
WITH w AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY ALL),
o AS (SELECT doc_id, w, i, count(*) OVER (PARTITION BY doc_id) AS n FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 4)
SELECT 'ground_' || doc_id AS gid, string_agg(w, '|' ORDER BY CASE WHEN n >= 2 THEN md5('ground_' || doc_id || ':' || w) END, i) AS opciones FROM o GROUP BY doc_id
""")
def quiz_shuffle(t: Tables):
    """Options in an order drawn from the item."""
    rows = t.documents.select(F.concat(F.lit("ground_"), "doc_id").alias("gid"), F.slice(F.array_distinct(F.split("text", " ")), 1, 4).alias("opciones"), F.get(F.split("text", " "), F.lit(0)).alias("respuesta_correcta"))
    return I.shuffled_options(rows).select("gid", F.array_join("opciones", "|").alias("opciones"))


@query()
def fuzzy_dedup(t: Tables):
    """The greedy fuzzy rule over the turns of every conversation."""
    rows = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("item_idx"), "text")
    return greedy_dedup(rows).select("run_id", "item_idx")


@query("""
SELECT source AS run_id, min(doc_id) AS item_idx FROM documents GROUP BY source, substr(lower(trim(text, ' ')), 1, 160)
""")
def point_dedup(t: Tables):
    """The first of points that begin alike."""
    rows = t.documents.select(F.col("source").alias("run_id"), F.col("doc_id").alias("item_idx"), "text")
    return D.exact_first(rows, D.point_key(F.col("text"))).select("run_id", "item_idx")


@query("""
SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY min(doc_id), lang)::INTEGER AS nth FROM documents GROUP BY source, lang
""")
def unique_in_order(t: Tables):
    """D3: distinct values by first appearance."""
    return D.unique_in_order(t.documents, "source", "lang", "doc_id")


@query("""
WITH r AS (SELECT source AS run_id, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) > 1 AS later FROM documents)
SELECT run_id, doc_id FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY later, doc_id) <= 7
""")
def summary_prune(t: Tables):
    """The first point of each section, then others, to the target."""
    rows = t.documents.select(F.col("source").alias("run_id"), F.col("lang").alias("section"), F.col("doc_id").alias("item_idx"))
    return D.prune(rows, 7).select("run_id", F.col("item_idx").alias("doc_id"))


def _points(t: Tables):
    """Runs of at most a hundred points, each of one source."""
    run = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string"))
    d = t.documents.select(run.alias("run_id"), F.col("doc_id").alias("item_idx"), "lang", "text")
    points = d.select("run_id", "item_idx", F.regexp_extract("text", r"^([^\n.]{1,60})", 1).alias("punto_clave"))
    pages = F.when(F.col("item_idx") % 2 == 0, F.array(F.lit(4), F.lit(3))).otherwise(F.array(F.lit(0)))
    sources = d.select("run_id", "item_idx", F.lit(1).alias("source_no"), F.concat(F.lit(" Sección  "), "lang").alias("section"), pages.alias("pages"))
    return points, sources


_REFS = r"""
WITH d AS (SELECT source || '-' || (doc_id // 100) AS run_id, doc_id AS item_idx, 'Sección ' || lang AS section, CASE WHEN doc_id % 2 = 0 THEN ' (p. 3, p. 4)' ELSE '' END AS pages, rtrim(trim(regexp_extract(text, '^([^\n.]{1,60})', 1)), '.') AS p FROM documents),
k AS (SELECT *, lower(section) || '|' || pages AS ref_key FROM d),
r AS (SELECT run_id, ref_key, row_number() OVER (PARTITION BY run_id ORDER BY min(item_idx)) AS ref_no, min_by(section, item_idx) AS section, min_by(pages, item_idx) AS pages FROM k WHERE __KEPT GROUP BY run_id, ref_key)
"""


@query(_REFS.replace("__KEPT", "true") + "SELECT run_id, ref_no::INTEGER AS ref_no, '[' || ref_no || '] ' || section || pages AS line FROM r")
def summary_references(t: Tables):
    """Reference numbers by first appearance."""
    return S.reference_lines(S.numbered_references(_points(t)[1])).select("run_id", "ref_no", "line")


@query(_REFS.replace("__KEPT", "p <> ''") + r"""
, b AS (SELECT run_id, item_idx, ref_no, (CASE WHEN p[1] = 'ß' THEN 'SS' ELSE upper(p[1]) END) || substr(p, 2) || CASE WHEN regexp_matches(p, '[.!?…]$') THEN '' ELSE '.' END AS p FROM k JOIN r USING (run_id, ref_key) WHERE p <> ''),
body AS (SELECT run_id, string_agg(p || ' [' || ref_no || ']', chr(10) || chr(10) ORDER BY item_idx) AS t FROM b GROUP BY run_id),
lines AS (SELECT run_id, string_agg('[' || ref_no || '] ' || section || pages, chr(10) ORDER BY ref_no) AS l FROM r GROUP BY run_id)
SELECT run_id, length(t || chr(10) || chr(10) || 'Fuentes' || chr(10) || run_id || chr(10) || l)::INTEGER AS chars, md5(t || chr(10) || chr(10) || 'Fuentes' || chr(10) || run_id || chr(10) || l) AS md5 FROM body JOIN lines USING (run_id)
""")
def summary_composed(t: Tables):
    """Summaries with markers, the title and references."""
    points, sources = _points(t)
    titles = points.select("run_id", F.col("run_id").alias("title")).distinct()
    return S.composed(points, sources, titles=titles).select("run_id", F.length("summary").alias("chars"), F.md5("summary").alias("md5"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:idiot|stupid|moron)\b'))::BIGINT AS hits, contains(lower(text), 'licensed') AS phrase FROM documents
WHERE regexp_matches(text, '(?i)\b(?:idiot|stupid|moron)\b') OR contains(lower(text), 'licensed')
""")
def forbidden_phrases(t: Tables):
    """Q1: forbidden phrases and patterns."""
    return Q.forbidden(t.documents, "doc_id", "text", ["licensed"], [r"\b(?:idiot|stupid|moron)\b"])


@query("SELECT source AS run_id, md5(text) AS text_md5, count(*)::BIGINT AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_items(t: Tables):
    """Q3: equal items within an output."""
    rows = t.documents.select(F.col("source").alias("run_id"), "text")
    return Q.duplicates(rows, "run_id", "text").select("run_id", F.md5("text").alias("text_md5"), "n")


@query("""
SELECT doc_id, list_aggregate(list_filter([CASE WHEN length(extract) = 0 THEN 'missing' END, CASE WHEN length(extract) BETWEEN 1 AND 39 THEN 'short' END, CASE WHEN sim IN (0.95, 0.98, 0.85) THEN 'fixed' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS faults
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 1, CASE WHEN doc_id % 2 = 0 THEN 30 ELSE 60 END) END AS extract, CASE WHEN doc_id % 5 = 0 THEN 0.95 ELSE 0.5 END AS sim FROM documents)
WHERE length(extract) < 40 OR sim IN (0.95, 0.98, 0.85)
""")
def citation_hygiene(t: Tables):
    """Q4: faults of citations."""
    e = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.substr("text", F.lit(1), F.when(F.col("doc_id") % 2 == 0, 30).otherwise(60)))
    rows = t.documents.select("doc_id", e.alias("extracto"), F.when(F.col("doc_id") % 5 == 0, 0.95).otherwise(0.5).alias("similitud_score"))
    return Q.citation_faults(rows).select("doc_id", "faults")


@query("SELECT count(DISTINCT quality) <= 1 AND count(*) > 1 AS one_score, bool_or(quality = 0) AS has_fixed FROM labels")
def score_degeneracy(t: Tables):
    """Q5: whether all outputs share a score, or hold a given one."""
    return Q.degenerate(t.labels, "quality", 0)


@query()
def output_similarity(t: Tables):
    """Q7: similarity of all pairs of a run's outputs (the turns of a conversation), for every run."""
    rows = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("item_idx"), "text")
    out = D.output_similarity(rows)
    return out.select("run_id", F.round("average", 6).alias("average"), F.round("maximum", 6).alias("maximum"), "over_limit")


@query(r"""
SELECT doc_id, greatest(8, ceil(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) / 100.0))::BIGINT AS minutes, trim(string_split_regex(text, '[.!?]')[1]) AS concept FROM documents
""")
def reading_time(t: Tables):
    """Q16: reading time and first sentence."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return t.documents.select("doc_id", F.greatest(F.lit(8), F.ceil(words / 100)).cast("long").alias("minutes"), F.btrim(F.get(F.split("text", "[.!?]"), F.lit(0))).alias("concept"))


@query(r"""
SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
""")
def json_fields(t: Tables):
    """Lenient JSON objects as rows of key and value."""
    return Q.json_pairs(t.events, "event_id", "props")


@query(r"""
SELECT doc_id, regexp_replace('Paso 1: step 2 - ' || substr(text, 1, 30), '^(?:\s*(?i:paso|step)\s*\d+\s*[:.\-]\s*)+', '') AS title FROM documents
""")
def step_prefixes(t: Tables):
    """Titles without step prefixes."""
    return t.documents.select("doc_id", T.strip_step_prefix(F.concat(F.lit("Paso 1: step 2 - "), F.substring("text", 1, 30))).alias("title"))
