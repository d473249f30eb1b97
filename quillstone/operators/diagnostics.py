"""Diagnostics of outputs and lenient JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
MIN_EXTRACT, FIXED_SCORES = 40, [0.95, 0.98, 0.85]
ITEM_LISTS = ["items", "elementos", "quiz", "flashcards", "preguntas", "data"]
# ----------------------------------------------------------------------------------------------------------------


def forbidden(df: DataFrame, key: str, text: str, phrases: list[str], patterns: list[str]) -> DataFrame:
    """(key, hits, phrase): how often patterns occur, whether a phrase does; rows with either."""
    c = F.col(text)
    hits = reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit("(?i)" + p)) for p in patterns], F.lit(0)).cast("long")
    phrase = reduce(lambda a, b: a | b, [F.lower(c).contains(p.lower()) for p in phrases], F.lit(False))
    return df.select(key, hits.alias("hits"), phrase.alias("phrase")).filter("hits > 0 or phrase")


def duplicates(df: DataFrame, run: str, text: str) -> DataFrame:
    return df.groupBy(run, text).agg(F.count("*").alias("n")).filter("n > 1")


def citation_faults(sources: DataFrame, extract: str = "extracto", similarity: str = "similitud_score") -> DataFrame:
    """Sources with what is wrong with them: missing, short, or of a fixed similarity."""
    n = F.length(F.coalesce(F.col(extract), F.lit("")))
    found = F.concat_ws(",", F.when(n == 0, "missing"), F.when((n > 0) & (n < MIN_EXTRACT), "short"), F.when(F.col(similarity).isin(FIXED_SCORES), "fixed"))
    return sources.withColumn("faults", found).filter("faults <> ''")


def degenerate(scores: DataFrame, score: str, fixed: float) -> DataFrame:
    return scores.agg(((F.countDistinct(score) <= 1) & (F.count("*") > 1)).alias("one_score"), F.bool_or(F.col(score) == fixed).alias("has_fixed"))


def origin_faults(outputs: DataFrame) -> DataFrame:
    """Outputs from a fallback or demo, first runs from a cache, outputs without a call. outputs: run_id, origin, attempt,
    planificar, generar, verificar."""
    calls = F.col("planificar") + F.col("generar") + F.col("verificar")
    fault = F.when(F.col("origin").isin("fallback", "demo"), "origin").when((F.col("attempt") == 1) & (F.col("origin") == "cache"), "cached").when((F.col("origin") != "cache") & (calls == 0), "no_calls")
    return outputs.withColumn("fault", fault).filter("fault is not null")


def count_mismatch(outputs: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    return outputs.filter(~F.col(expected).eqNullSafe(F.col(actual)))


def repeated_requests(runs: DataFrame, key: str = "request_hash") -> DataFrame:
    """Runs after the first of a hash that did not come from the cache."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(key).orderBy("ts"))
    return runs.withColumn("nth", nth).filter((F.col("nth") > 1) & (F.col("origin") != "cache"))


def request_hash(title: Column, content: Column, *parts: Column) -> Column:
    """Identity of a request: title, the first thousand characters, parameters."""
    return F.sha2(F.concat_ws(":", title, F.substring(content, 1, 1000), *parts), 256)


def json_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, key, value) of the fields of JSON objects; what doesn't parse has none."""
    fields = F.from_json(F.col(column), "map<string,string>", {"mode": "PERMISSIVE"})
    return df.select(key, F.explode(fields).alias("key", "value"))


def item_list(raw: Column, schema: str) -> Column:
    """Items from a generator's answer: a JSON list, a list under one of the usual names, or the text between brackets."""
    from ..functions.text import strip_json_fences

    body = strip_json_fences(raw)
    tries = [F.from_json(F.when(body.startswith("["), body), schema)]
    tries += [F.from_json(F.get_json_object(body, f"$.{n}"), schema) for n in ITEM_LISTS]
    tries.append(F.from_json(F.nullif(F.regexp_extract(body, r"(?s)(\[.*\])", 1), F.lit("")), schema))
    return F.coalesce(*[F.filter(x, lambda i: i.isNotNull()) for x in tries])


def sanitized_metadata(m: Column) -> Column:
    """A map fit for object metadata: lower-case keys of letters, digits and dashes, printable values of 256 characters."""
    m = F.map_filter(m, lambda k, v: v.isNotNull() & (F.btrim(k) != ""))
    m = F.transform_keys(m, lambda k, v: F.regexp_replace(F.lower(k), "[^a-z0-9-]+", "-"))
    return F.transform_values(m, lambda k, v: F.substring(F.regexp_replace(v, r"[^\x20-\x7E]", "?"), 1, 256))


def stage_states(stages: DataFrame, current: Column, failed: Column, nth: str = "nth") -> DataFrame:
    """Stages before the current one are done, it is active or failed, the rest pending."""
    s = F.when(F.col(nth) < current, "done").when(F.col(nth) > current, "pending").when(failed, "error").otherwise("active")
    return stages.withColumn("state", s)


def sample_positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """First, second, last but one and last row of each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    rows = df.withColumns({"position": F.row_number().over(w.orderBy(order)), "total": F.count("*").over(w)})
    return rows.filter(F.col("position").isin(1, 2) | (F.col("position") >= F.col("total") - 1))


def models_used(calls: DataFrame, short: dict[str, str] | None = None, run: str = "run_id", provider: str = "provider", model: str = "model") -> DataFrame:
    """(run, models, detail): ``name(n)`` for each provider with its number of distinct models, and all of them as ``name/model``."""
    names = F.create_map(*[F.lit(x) for kv in (short or {"": ""}).items() for x in kv])
    per = calls.filter(F.coalesce(F.col(model), F.lit("")) != "").groupBy(run, provider).agg(F.array_sort(F.collect_set(model)).alias("ms"))
    label = F.coalesce(F.try_element_at(names, F.col(provider)), F.col(provider))
    rows = per.withColumn("s", F.struct(provider, F.concat(label, F.lit("("), F.size("ms"), F.lit(")")).alias("m"), F.array_join(F.transform("ms", lambda x: F.concat(label, F.lit("/"), x)), ",").alias("d")))
    out = rows.groupBy(run).agg(F.array_sort(F.collect_list("s")).alias("s"))  # one row a provider
    return out.select(run, F.array_join("s.m", ", ").alias("models"), F.array_join("s.d", ",").alias("detail"))


def item_text(items: DataFrame, item: str = "item", without: str = "fuentes") -> DataFrame:
    """Items with ``item_text``: all their string fields and lists of strings, joined by spaces, but for the citations."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema[item].dataType.fields if f.name != without}
    parts = [F.col(f"{item}.`{k}`") if v == "string" else F.array_join(f"{item}.`{k}`", " ") for k, v in kinds.items() if v in ("string", "array<string>")]
    return items.withColumn("item_text", F.concat_ws(" ", *parts))


#: Paths of the fields of a stored output that notices appear in; fixed values.
NOTICE_FIELDS = {
    "aviso_cantidad": "$.metadatos.aviso_cantidad",
    "observaciones": "$.evaluacion_calidad.observaciones",
    "intro": "$.contenido_adaptado.introduccion_contextualizada",
}


def number_signals(stored: DataFrame, key: str, number: str, json: str = "response_json") -> DataFrame:
    """(key, field, value) of the fields of stored outputs that hold a number by itself."""
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.get_json_object(json, p).alias("value")) for k, p in NOTICE_FIELDS.items()])
    return stored.select(key, F.inline(fields)).filter(F.col("value").rlike(rf"\b{number}\b"))


def projects(rows: DataFrame) -> DataFrame:
    """Stored rows as projects: metadata first, then the row, then defaults; a score only where there is one."""
    clarity = F.when(F.col("claridad") == "High", "Alta").when(F.col("claridad") == "Medium", "Media").when(F.col("claridad") == "Low", "Baja").otherwise(F.col("claridad"))
    return rows.withColumns(
        {
            "profile": F.coalesce("perfil_aplicado", "recipient_profile", F.lit("General")),
            "format": F.coalesce("formato_generado", "output_format", F.lit("Tutorial")),
            "minutes": F.coalesce("tiempo", F.greatest(F.lit(1), 3 * F.col("n_items"))).cast("long"),
            "clarity": F.coalesce(clarity, F.lit("Alta")),
        }
    )
