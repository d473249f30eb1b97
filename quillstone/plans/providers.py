"""Queries of calls to providers: the embedding chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding as E
from .registry import Tables, query

#: Stand-ins that fail by size and by quota.
_TOO_LARGE, _OUT, _LATER, _DAILY = "INVALID_ARGUMENT: request too large", "out of memory", "429 RESOURCE_EXHAUSTED, retry in 7s", "RESOURCE_EXHAUSTED for today"


def _chain() -> list[E.Provider]:
    chars = F.aggregate("texts", F.lit(0), lambda s, t: s + F.length(t["text"]))
    later = (F.col("attempt") == 1) & (F.col("batch") >= 1) & ((F.col("list_id") + F.col("batch")) % 3 == 0)
    daily = (F.col("list_id") % 5 == 0) & (F.col("batch") >= 2)
    gemini = F.when(later, _LATER).when(daily, _DAILY).when(chars > 15_000, _TOO_LARGE)
    kind = F.when(later, "per_minute").when(daily, "daily")
    jina = F.when((F.col("list_id") % 7 == 3) & (F.col("batch") == 0), "503 unavailable").when(chars > 40_000, "payload too large")
    local = F.when(F.exists("texts", lambda t: F.length(t["text"]) > 30_000), _OUT)
    return [E.rule_provider("gemini", gemini, F.when(kind.isNotNull(), 429).otherwise(400), kind), E.rule_provider("jina", jina, F.lit(413)), E.rule_provider("local", local)]


@query(f"""
WITH RECURSIVE t AS (
  SELECT doc_id, doc_id // 64 AS list_id, (doc_id % 64)::INT AS position, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS h FROM documents
), l AS (
  SELECT list_id, max(position) + 1 AS n, sum(greatest(1, round_even(chars / 3.5::DOUBLE, 0)))::BIGINT AS tokens FROM t GROUP BY list_id
), upto AS (
  SELECT list_id, position + 1 AS at, sum(chars) OVER w AS chars, count(*) FILTER (chars > 30000) OVER w AS big FROM t WINDOW w AS (PARTITION BY list_id ORDER BY position)
  UNION ALL SELECT list_id, 0, 0, 0 FROM l
), b AS (
  SELECT list_id, p, batch, attempt, batch * size AS lo, least(batch * size + size, n) AS hi
  FROM l CROSS JOIN (VALUES (0, 20), (1, 50), (2, 256)) v(p, size) CROSS JOIN range(1, 4) a(attempt), LATERAL (SELECT unnest(range(0, (n - 1) // size + 1)) AS batch)
), calls AS (
  SELECT list_id, p, batch, attempt, lo, hi FROM b
  UNION ALL
  SELECT list_id, p, batch, attempt, CASE WHEN side = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN side = 0 THEN (lo + hi) // 2 ELSE hi END
  FROM (
    SELECT c.*, CASE WHEN p = 0 AND attempt = 1 AND batch >= 1 AND (c.list_id + batch) % 3 = 0 THEN false WHEN p = 0 AND c.list_id % 5 = 0 AND batch >= 2 THEN false
      WHEN p = 0 THEN y.chars - x.chars > 15000 WHEN p = 1 THEN (c.list_id % 7 = 3 AND batch = 0) OR y.chars - x.chars > 40000 ELSE false END AND hi - lo > 1 AS split
    FROM calls c JOIN upto x ON x.list_id = c.list_id AND x.at = lo JOIN upto y ON y.list_id = c.list_id AND y.at = hi
  ) CROSS JOIN (VALUES (0), (1)) s(side) WHERE split
), told AS (
  SELECT c.list_id, p, batch, attempt,
    CASE WHEN p = 0 AND attempt = 1 AND batch >= 1 AND (c.list_id + batch) % 3 = 0 THEN 'later' WHEN p = 0 AND c.list_id % 5 = 0 AND batch >= 2 THEN 'daily'
      WHEN hi - lo = 1 AND ((p = 0 AND y.chars - x.chars > 15000) OR (p = 1 AND ((c.list_id % 7 = 3 AND batch = 0) OR y.chars - x.chars > 40000))) THEN 'size'
      WHEN p = 2 AND y.big > x.big THEN 'memory' END AS fault
  FROM calls c JOIN upto x ON x.list_id = c.list_id AND x.at = lo JOIN upto y ON y.list_id = c.list_id AND y.at = hi
), tried AS (
  SELECT list_id, p, batch, attempt, bool_or(fault IS NOT NULL) AS failed, coalesce(bool_or(fault = 'daily'), false) AS hopeless FROM told GROUP BY ALL
), reached AS (
  SELECT *, coalesce(bool_and(failed) OVER (PARTITION BY list_id, p, batch ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS here FROM tried
), used AS (
  SELECT list_id, p, batch, count(*) FILTER (here AND failed)::INT AS k, bool_or(here AND failed AND hopeless) AS hopeless FROM reached GROUP BY ALL
), verdict AS (
  SELECT list_id, p, sum(k) > 2 OR bool_or(hopeless) OR bool_or(batch = 0 AND k > 0) OR (p = 0 AND any_value(n) > 900) OR (p = 1 AND any_value(tokens) > 90000) AS lost FROM used JOIN l USING (list_id) GROUP BY list_id, p
), chosen AS (
  SELECT list_id, min(p) FILTER (NOT lost) AS p FROM verdict GROUP BY list_id
)
SELECT t.doc_id, t.list_id, t.position, CASE c.p WHEN 0 THEN 'gemini' WHEN 1 THEN 'jina' WHEN 2 THEN 'local' END AS provider, k + 1 AS attempt,
  CASE WHEN c.p IS NULL THEN '{_OUT}' END AS error, CASE WHEN c.p IS NOT NULL THEN round(('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE, 6) END AS first_coordinate
FROM t JOIN chosen c USING (list_id) LEFT JOIN used u ON u.list_id = t.list_id AND u.p = c.p AND u.batch = t.position // (CASE c.p WHEN 0 THEN 20 WHEN 1 THEN 50 ELSE 256 END)
""")
def embedding_chain(t: Tables):
    """Lists of 64 documents, embedded by the first provider that serves a whole list, or reported."""
    texts = t.documents.select(F.floor(F.col("doc_id") / 64).alias("list_id"), (F.col("doc_id") % 64).alias("position"), "text")
    out = E.embedded(texts, _chain())
    place = (F.col("list_id") * 64 + F.col("position")).alias("doc_id")
    return out.select(place, "list_id", "position", "provider", "attempt", "error", F.round(F.get("embedding", F.lit(0)), 6).alias("first_coordinate"))
