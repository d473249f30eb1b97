"""Libraries, trash, job queues, documents, sign-ins: tables as append-only events and their latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
RETENTION_DAYS, MAX_ATTEMPTS, LOCK_AFTER, LOCK_SECONDS = 15, 5, 5, 900
LAST_NODE = "formatter"
# ----------------------------------------------------------------------------------------------------------------


def active(contents: DataFrame, user: str) -> DataFrame:
    """A user's contents that are not in the trash, newest first."""
    return contents.filter((F.col("user_id") == user) & F.col("deleted_at").isNull()).orderBy(F.desc("created_at"), "id")


def trash(contents: DataFrame, user: str) -> DataFrame:
    """A user's trash, what goes first on top."""
    return contents.filter((F.col("user_id") == user) & F.col("deleted_at").isNotNull()).orderBy("purge_at", "id")


def due(contents: DataFrame, now: Column, retry_failed: bool = True, limit: int | None = None) -> DataFrame:
    """Trash whose time is over; with ``retry_failed`` also rows whose purge failed. A limit takes the oldest."""
    when = F.col("purge_at") <= now
    if retry_failed:
        when = when | (F.col("purge_failed") == 1)
    rows = contents.filter(F.col("deleted_at").isNotNull() & when)
    return rows.orderBy("purge_at", "id").limit(limit) if limit else rows


def soft_deleted(contents: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Contents with the given ids moved to the trash for the time of retention."""
    hit = contents.join(ids.select("id", F.lit(True).alias("hit")), "id", "left")
    go = F.col("hit") & F.col("deleted_at").isNull()
    kept_days = F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")
    return hit.withColumns({"deleted_at": F.when(go, now).otherwise(F.col("deleted_at")), "purge_at": F.when(go, now + kept_days).otherwise(F.col("purge_at"))}).drop("hit")


def restored(contents: DataFrame, ids: DataFrame) -> DataFrame:
    hit = contents.join(ids.select("id", F.lit(True).alias("hit")), "id", "left")
    return hit.withColumns({c: F.when(F.col("hit").isNull(), F.col(c)) for c in ("deleted_at", "purge_at")}).drop("hit")


def purged(contents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Contents after a purge: rows whose objects are gone go, the others are marked. outcomes: id, ok."""
    out = contents.join(outcomes.select("id", F.col("ok").alias("gone")), "id", "left").filter(~F.coalesce("gone", F.lit(False)))
    return out.withColumn("purge_failed", F.when(F.col("gone").isNotNull(), 1).otherwise(F.col("purge_failed"))).drop("gone")


def purge_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if("ok").alias("purged"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"))


def _seconds(at: Column) -> Column:
    """Seconds since 1970, to the nearest whole one, halves to the even one."""
    return F.rint(F.unix_micros(at.cast("timestamp")) / 1e6)


def days_left(purge_at: Column, now: Column) -> Column:
    """Days until a purge, each begun one counted; 0 when its time is over."""
    return F.greatest(F.lit(0), F.ceil((_seconds(purge_at) - _seconds(now)) / 86400)).cast("long")


def latest_job(jobs: DataFrame, key: str = "content_id") -> DataFrame:
    """Each content's latest job: highest version, then newest."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version"), F.desc("created_at"), F.desc("id")))
    return jobs.withColumn("_n", place).filter("_n = 1").drop("_n")


def pending(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.filter("estado = 'pendiente'").orderBy("created_at", "id").limit(limit)


def job_states(events: DataFrame, job: str = "job_id", at: str = "ts", kind: str = "kind") -> DataFrame:
    """(job, estado, intentos) from events ok, fail and retry: attempts count from the last retry; five fail a job."""
    last_retry = events.groupBy(job).agg(F.max(F.when(F.col(kind) == "retry", F.col(at))).alias("since"))
    rows = events.join(last_retry, job).filter(F.col("since").isNull() | (F.col(at) > F.col("since")) | (F.col(kind) == "retry"))
    folded = rows.groupBy(job).agg(F.count_if(F.col(kind) == "fail").alias("intentos"), F.bool_or(F.col(kind) == "ok").alias("done"))
    state = F.when(F.col("done"), "completado").when(F.col("intentos") >= MAX_ATTEMPTS, "error").otherwise("pendiente")
    return folded.select(job, state.alias("estado"), F.col("intentos").cast("long").alias("intentos"))


def error_text(message: Column) -> Column:
    return F.substring(message, 1, 200)


def lockouts(attempts: DataFrame, user: str = "user_id", at: str = "ts", ok: str = "ok", nth: str = "event_id") -> DataFrame:
    """Failed attempts with their number since the last success, and ``locked_until`` from the fifth on."""
    order = Window.partitionBy(user).orderBy(at, nth)
    run = F.sum(F.col(ok).cast("int")).over(order)
    rows = attempts.withColumn("_run", F.coalesce(run, F.lit(0)))
    count = F.count_if(~F.col(ok)).over(Window.partitionBy(user, "_run").orderBy(at, nth).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("failed_count", count).filter(~F.col(ok))
    until = F.when(F.col("failed_count") >= LOCK_AFTER, F.col(at) + F.expr(f"INTERVAL {LOCK_SECONDS} SECONDS"))
    return rows.withColumn("locked_until", until).drop("_run")


def document_states(events: DataFrame, doc: str = "document_id", at: str = "ts") -> DataFrame:
    """(doc, status) from events registered, ready, failed and deleted; deleted documents are gone."""
    last = events.groupBy(doc).agg(F.max_by("kind", F.struct(at, "event_id")).alias("kind"))
    status = F.when(F.col("kind") == "registered", "processing").when(F.col("kind") == "ready", "ready").otherwise("failed")
    return last.filter("kind <> 'deleted'").select(doc, status.alias("status"))


def deletable(documents: DataFrame, ids: DataFrame | None = None, skip_processing: bool = True) -> DataFrame:
    """Documents to delete: the given ones or all, those in processing left out."""
    rows = documents if ids is None else documents.join(ids, "document_id", "left_semi")
    return rows.filter("status <> 'processing'") if skip_processing else rows


def orphans(stores: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Stored indexes without a document."""
    return stores.join(documents.select(key), key, "left_anti")


def token_owner(tokens: DataFrame, users: DataFrame, token: Column) -> DataFrame:
    """The users that a token's hash belongs to; revoked and expired tokens are the caller's to judge."""
    return tokens.filter(F.col("token_hash") == F.sha2(token, 256)).join(users, "user_id")


def user_by_id_or_email(users: DataFrame, value: Column) -> DataFrame:
    return users.filter((F.col("user_id").cast("string") == value) | (F.lower("email") == F.lower(value)))


def reused_tokens(events: DataFrame, token: str = "token_id", at: str = "ts") -> DataFrame:
    """Uses of a refresh token after it was used up or revoked; each such family is to be revoked."""
    order = Window.partitionBy(token).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.count_if(F.col("kind").isin("use", "revoke")).over(order)
    return events.withColumn("_spent", spent).filter((F.col("kind") == "use") & (F.col("_spent") > 0)).drop("_spent")


def library_search(rows: DataFrame, query: str, kind: str | None = None, name: str = "name", tags: str | None = "tags") -> DataFrame:
    """Rows whose name or a tag contains the query, of one type if given."""
    q = query.strip().lower()
    hit = F.lower(name).contains(q)
    if tags:
        hit = hit | F.exists(tags, lambda t: F.lower(t).contains(q))
    rows = rows.filter(hit) if q else rows
    return rows.filter(F.col("type") == kind) if kind else rows


def stage_durations(events: DataFrame, run: str = "run_id", stage: str = "stage", at: str = "ts") -> DataFrame:
    """(run, stage, ms, calls) from start and end events, paired in order."""
    order = Window.partitionBy(run, stage).orderBy(at)
    end = F.lead(at).over(order)
    spans = events.withColumn("_end", end).filter("kind = 'start'")
    micros = F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    ms = F.bround(F.sum(micros).cast("decimal(20,3)") / 1000, 2).cast("double")
    return spans.groupBy(run, stage).agg(ms.alias("ms"), F.count("*").alias("calls"))


def node_progress(events: DataFrame, run: str = "run_id", at: str = "ts", node: str = "node", nth: str = "event_id") -> DataFrame:
    """(run_id, event_id, nth, stage, ms): one stage for each node that finished, in order, with the time since the stage before, and ``done``
    behind the first last node; nothing of a run follows that. A run served from the cache has only its last node."""
    order = Window.partitionBy(run).orderBy(at, nth)
    last = F.col(node).eqNullSafe(F.lit(LAST_NODE))
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.select(
        F.col(run).alias("run_id"), F.col(nth).alias("event_id"), F.row_number().over(order).alias("nth"), F.col(node).alias("stage"), ((us - F.lag(us).over(order)) / 1000).alias("ms"),
        F.coalesce(F.count_if(last).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("over"), last.alias("last"),
    )
    rows = rows.filter("over = 0")
    done = F.struct((F.col("nth") + 1).alias("nth"), F.lit("done").alias("stage"), F.lit(0.0).alias("ms"))
    own = F.struct("nth", "stage", "ms")
    return rows.select("run_id", "event_id", F.explode(F.when(F.col("last"), F.array(own, done)).otherwise(F.array(own))).alias("s")).select("run_id", "event_id", F.col("s.nth").cast("long").alias("nth"), "s.stage", "s.ms")
