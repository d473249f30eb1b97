"""Queries of lifecycles and limits, over events, orders and customers in the roles of contents, jobs and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import breaker as B
from ..operators import diagnostics as Q
from ..operators import dedup as D
from ..operators import lifecycle as C
from ..operators import limits as M
from .registry import Tables, query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.expr(NOW)


def _contents(t: Tables):
    gone = F.col("event_type").isin("error", "purchase")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("created_at"), F.when(gone, F.col("ts")).alias("deleted_at"),
        F.when(gone, F.col("ts") + F.expr("INTERVAL 15 DAYS")).alias("purge_at"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("purge_failed"),
    )


_CONTENTS = """
WITH c AS (SELECT event_id AS id, user_id::VARCHAR AS user_id, ts AS created_at, CASE WHEN event_type IN ('error', 'purchase') THEN ts END AS deleted_at,
 CASE WHEN event_type IN ('error', 'purchase') THEN ts + INTERVAL 15 DAY END AS purge_at, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS purge_failed FROM events)
"""


@query(_CONTENTS + f"SELECT id FROM c WHERE deleted_at IS NOT NULL AND (purge_at <= {NOW} OR purge_failed = 1)")
def purge_due(t: Tables):
    """F13, ST8, Q17: trash to purge, failed purges among it."""
    return C.due(_contents(t), _now()).select("id")


@query(_CONTENTS + f"SELECT id FROM c WHERE deleted_at IS NOT NULL AND purge_at <= {NOW} ORDER BY purge_at, id LIMIT 50")
def purge_batch(t: Tables):
    """The fifty that expired first."""
    return C.due(_contents(t), _now(), retry_failed=False, limit=50).select("id")


@query(_CONTENTS + f"""
SELECT CASE WHEN d > 7 THEN 'green' WHEN d >= 4 THEN 'amber' WHEN d >= 1 THEN 'red' ELSE 'today' END AS status, count(*)::BIGINT AS n
FROM (SELECT greatest(0, ceil((epoch(purge_at)::BIGINT - epoch({NOW})::BIGINT) / 86400.0))::BIGINT AS d FROM c WHERE deleted_at IS NOT NULL) GROUP BY 1
""")
def trash_status(t: Tables):
    """Days left and their colours."""
    rows = _contents(t).filter("deleted_at is not null")
    return rows.groupBy(L.days_left_status(C.days_left(F.col("purge_at"), _now())).alias("status")).agg(F.count("*").alias("n"))


@query(_CONTENTS + "SELECT user_id, count(*) FILTER (deleted_at IS NULL)::BIGINT AS active, count(deleted_at)::BIGINT AS trashed FROM c GROUP BY user_id")
def library_counts(t: Tables):
    """Active and trashed contents of each user."""
    return _contents(t).groupBy("user_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("active"), F.count("deleted_at").alias("trashed"))


@query("SELECT o_custkey AS content_id, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def job_latest(t: Tables):
    """W10, ST7: the latest job of each content."""
    jobs = t.orders.select(F.col("o_custkey").alias("content_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("version"), F.col("o_orderdate").alias("created_at"))
    return C.latest_job(jobs).select("content_id", "id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def job_pending(t: Tables):
    """The oldest pending jobs."""
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "pendiente").otherwise("completado").alias("estado"))
    return C.pending(jobs).select("id")


_KINDS = "CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'signup' THEN 'retry' ELSE 'fail' END"


def _job_events(t: Tables):
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "signup", "retry").otherwise("fail")
    return t.events.select(F.col("user_id").alias("job_id"), "event_id", "ts", kind.alias("kind"))


@query(f"""
WITH e AS (SELECT user_id AS job_id, ts, {_KINDS} AS kind FROM events), r AS (SELECT job_id, max(ts) FILTER (kind = 'retry') AS since FROM e GROUP BY job_id),
f AS (SELECT e.* FROM e JOIN r USING (job_id) WHERE since IS NULL OR ts > since OR kind = 'retry')
SELECT job_id, CASE WHEN bool_or(kind = 'ok') THEN 'completado' WHEN count(*) FILTER (kind = 'fail') >= 5 THEN 'error' ELSE 'pendiente' END AS estado, count(*) FILTER (kind = 'fail')::BIGINT AS intentos FROM f GROUP BY job_id
""")
def job_states(t: Tables):
    """ST6: states of jobs folded from their events."""
    return C.job_states(_job_events(t))


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
c AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT user_id, event_id, n::BIGINT AS failed_count, CASE WHEN n >= 5 THEN ts + INTERVAL 900 SECOND END AS locked_until FROM c WHERE NOT ok
""")
def lockouts(t: Tables):
    """ST4: failed sign-ins in a row and locks."""
    rows = t.events.select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("ok"))
    return C.lockouts(rows).select("user_id", "event_id", "failed_count", "locked_until")


@query("""
SELECT user_id AS document_id, CASE max_by(event_type, (ts, event_id)) WHEN 'view' THEN 'processing' WHEN 'click' THEN 'ready' ELSE 'failed' END AS status FROM events GROUP BY user_id HAVING max_by(event_type, (ts, event_id)) <> 'purchase'
""")
def document_states(t: Tables):
    """ST9, S16: states of documents from their events."""
    kind = F.when(F.col("event_type") == "view", "registered").when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "purchase", "deleted").otherwise("failed")
    return C.document_states(t.events.select(F.col("user_id").alias("document_id"), "event_id", "ts", kind.alias("kind")))


@query("SELECT vec_id AS document_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def orphan_indexes(t: Tables):
    """Indexes without a document."""
    stores = t.embeddings.select(F.col("vec_id").alias("document_id"))
    return C.orphans(stores, t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id")))


@query("SELECT o_orderkey AS token_id, c_custkey AS user_id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE sha256(o_orderkey::VARCHAR) = sha256('7')")
def token_owner(t: Tables):
    """The owner of a token by its hash."""
    tokens = t.orders.select(F.col("o_orderkey").alias("token_id"), F.col("o_custkey").alias("user_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token_hash"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return C.token_owner(tokens, users, F.lit("7")).select("token_id", "user_id", "name")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey::VARCHAR = '12' OR lower(c_name) = lower('12')")
def user_lookup(t: Tables):
    """A user by id or mail address."""
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    return C.user_by_id_or_email(users, F.lit("12")).select("user_id")


@query("""
SELECT event_id FROM (SELECT event_id, event_type, count(*) FILTER (event_type IN ('click', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM events) WHERE event_type = 'click' AND spent > 0
""")
def token_reuse(t: Tables):
    """ST10: uses of tokens that were used up or revoked."""
    kind = F.when(F.col("event_type") == "click", "use").when(F.col("event_type") == "error", "revoke").otherwise("other")
    return C.reused_tokens(t.events.select(F.col("user_id").alias("token_id"), "event_id", "ts", kind.alias("kind"))).select("event_id")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a')) AND p_type LIKE '%'")
def library_search(t: Tables):
    """names and tags that contain a query."""
    rows = t.part.select("p_partkey", F.col("p_name").alias("name"), F.array("p_brand").alias("tags"), F.lit("x").alias("type"))
    return C.library_search(rows, " A ", "x").select("p_partkey")


@query("""
WITH e AS (SELECT user_id, event_type, ts, epoch_us(ts) AS us FROM events)
SELECT user_id, ts, count(*) OVER d AS requests_day, count(*) OVER m AS requests_minute FROM e
WINDOW d AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), m AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)
""")
def sliding_usage(t: Tables):
    """ST1: requests of the last minute and day."""
    rows = t.events.select("user_id", "ts", F.lit(1).alias("requests"), F.lit(300).alias("tokens"))
    return M.usage(rows).select("user_id", "ts", "requests_day", "requests_minute")


@query("""
WITH RECURSIVE e AS (
  SELECT event_type AS provider, user_id % 4 AS model, event_id, ts, epoch_us(ts) AS us, user_id % 3 = 0 AS fail, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS n FROM events
), p AS (
  SELECT *, CASE WHEN fail AND lag(fail, 1, false) OVER w THEN n END AS pair, count(*) OVER (PARTITION BY provider, model ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 59999999 FOLLOWING) + 1 AS behind FROM e WINDOW w AS (PARTITION BY provider, model ORDER BY n)
), q AS (
  SELECT *, min(pair) OVER (PARTITION BY provider, model ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM p
), trips AS (
  SELECT provider, model, min(pair) AS n FROM q GROUP BY ALL HAVING min(pair) IS NOT NULL
  UNION ALL
  SELECT t.provider, t.model, s.later FROM trips t JOIN q ON q.provider = t.provider AND q.model = t.model AND q.n = t.n JOIN q s ON s.provider = t.provider AND s.model = t.model AND s.n = q.behind WHERE s.later IS NOT NULL
), m AS (
  SELECT q.*, t.n IS NOT NULL AS trip, max(CASE WHEN t.n IS NOT NULL THEN us END) OVER (PARTITION BY q.provider, q.model ORDER BY q.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM q LEFT JOIN trips t ON t.provider = q.provider AND t.model = q.model AND t.n = q.n
), a AS (
  SELECT *, earlier IS NULL OR us >= earlier + 60000000 AS attempted, CASE WHEN trip THEN us ELSE earlier END + 60000000 AS until FROM m
)
SELECT provider, model::VARCHAR AS model, event_id, attempted, (fail AND attempted AND NOT trip)::BIGINT AS failures, CASE WHEN until > us THEN make_timestamp(until) END AS cool_until FROM a
""")
def cooldown_islands(t: Tables):
    """ST3: calls that a breaker lets through, failures in a row and pauses, for each provider and model."""
    rows = t.events.select(F.col("event_type").alias("provider"), (F.col("user_id") % 4).alias("model"), "event_id", "ts", (F.col("user_id") % 3 != 0).alias("ok"))
    return B.breaker(rows)


@query("""
WITH e AS (
  SELECT user_id AS run_id, event_id, ts, CASE event_type WHEN 'view' THEN 'planner' WHEN 'click' THEN 'writer' WHEN 'purchase' THEN 'formatter' ELSE 'critic' END AS stage FROM events
), o AS (
  SELECT *, row_number() OVER w AS nth, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000.0::DOUBLE AS ms, count(*) FILTER (stage = 'formatter') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over
  FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)
)
SELECT run_id, event_id, nth, stage, ms FROM o WHERE over = 0 UNION ALL SELECT run_id, event_id, nth + 1, 'done', 0.0::DOUBLE FROM o WHERE over = 0 AND stage = 'formatter'
""")
def node_progress(t: Tables):
    """ST12: progress of runs by node, ended by the last one."""
    kind = F.when(F.col("event_type") == "view", "planner").when(F.col("event_type") == "click", "writer").when(F.col("event_type") == "purchase", "formatter").otherwise("critic")
    return C.node_progress(t.events.select(F.col("user_id").alias("run_id"), "event_id", "ts", kind.alias("node")))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (
  SELECT user_id, event_id, n, true AS admitted, [us] AS held FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, len(held) < 5, CASE WHEN len(held) < 5 THEN list_append(held, us) ELSE held END
  FROM (SELECT e.user_id, e.event_id, e.n, e.us, list_filter(a.held, lambda t: t + 60000000 > e.us) AS held FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1)
)
SELECT user_id, event_id, admitted FROM a
""")
def admissions(t: Tables):
    """ST5: five calls a minute, refused ones not counted."""
    rows = t.events.select(F.col("user_id"), "event_id", "ts")
    return M.admissions(rows).select("user_id", "event_id", "admitted")


@query()
def simulated_waits(t: Tables):
    """ST2: how long batches would wait."""
    rows = t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("batch_no"), F.lit(20).alias("requests"), F.least(F.lit(20000), F.length("text")).alias("tokens"))
    return M.simulated_waits(rows)


@query("""
WITH e AS (SELECT user_id AS run_id, event_type AS stage, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'view'))
SELECT run_id, stage, (us // 10 + CASE WHEN us % 10 > 5 OR (us % 10 = 5 AND (us // 10) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100 AS ms, calls
FROM (SELECT a.run_id, a.stage, sum(epoch_us(b.ts) - epoch_us(a.ts))::BIGINT AS us, count(*)::BIGINT AS calls FROM e a LEFT JOIN e b ON a.run_id = b.run_id AND a.stage = b.stage AND b.n = a.n + 1 WHERE a.n % 2 = 1 GROUP BY ALL)
""")
def stage_durations(t: Tables):
    """ST13, A10, N5: durations and calls of stages from starts and ends."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = t.events.filter(F.col("event_type").isin("click", "view")).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "ts", F.when(n % 2 == 1, "start").otherwise("end").alias("kind"))
    return C.stage_durations(rows)


@query("""
SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) IN (1, 2) OR row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) IN (1, 2)
""")
def sample_positions(t: Tables):
    """First, second, last but one and last."""
    return Q.sample_positions(t.documents.select("source", "doc_id"), "source", "doc_id").select("source", "doc_id")


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN 'done' WHEN n_regionkey > 2 THEN 'pending' ELSE 'active' END AS state FROM nation")
def stage_states(t: Tables):
    """Q14: stages before, at and after the current one."""
    return Q.stage_states(t.nation.withColumnRenamed("n_regionkey", "nth"), F.lit(2), F.lit(False)).select("n_nationkey", "state")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' AS c_name FROM customer WHERE c_custkey % 2 = 1
""")
def upserts(t: Tables):
    """Rows replaced by key."""
    old = t.customer.select("c_custkey", "c_name")
    return D.upserted(old, old.filter("c_custkey % 2 = 1").withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("""
SELECT doc_id, sha256(source || ':' || substr(text, 1, 1000) || ':' || lang) AS request_hash FROM documents
""")
def request_hashes(t: Tables):
    """Identities of requests."""
    return t.documents.select("doc_id", Q.request_hash(F.col("source"), F.col("text"), F.col("lang")).alias("request_hash"))


@query("""
SELECT doc_id, 'usuarios/' || coalesce(nullif(source, ''), 'anonymous') || '/documentos/' || doc_id || CASE WHEN lang = 'en' THEN '.pdf' ELSE '.md' END AS object_key, CASE WHEN lang = 'en' THEN 'application/pdf' ELSE 'text/markdown' END AS content_type,
  sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size, lang <> 'es' AS there FROM documents
""")
def stored_documents(t: Tables):
    """Documents uploaded, some deleted again, and what the store says of all of them."""
    from ..sources.objects import DocumentStorage, document_key
    from ..tables import shared_folder, written

    store = DocumentStorage(t.spark, shared_folder(t.spark, "documents"))
    name = F.when(F.col("lang") == "en", "Source.PDF").otherwise("source.md")
    docs = t.documents.select("doc_id", "lang", F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("document_id"), name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    docs = docs.withColumn("object_key", document_key(F.col("user_id"), F.col("document_id"), F.col("name")))
    store.upload_documents(docs)
    told = store.head().select("object_key", "content_type", "sha256", "size")
    before = told.join(docs.select("doc_id", "object_key"), "object_key")
    before = written(before, shared_folder(t.spark, "heads"))
    store.delete(docs.filter("lang = 'es'").select("object_key"))
    return before.join(store.exists(before.select("object_key")), "object_key").select("doc_id", "object_key", "content_type", "sha256", "size", "there")
