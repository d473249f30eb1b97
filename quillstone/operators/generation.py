"""Generation around a generator boundary: coverage plans, prompts, batches, summary rounds, repair, final content.

A generator is a function from calls (run_id, call_no, item_count, prompt) to answers (run_id, call_no, raw), ``raw`` being JSON text or
null. It sees all calls of a step as one frame, so it can be a pandas UDF on any number of executors. A ``keep`` function stands behind each step that
calls it, so that an answer is asked for once and no plan holds the steps before it twice; by default (:func:`kept`) it writes a table and
reads it again.
Runs and documents are bounded (a request yields a hundred items at most); windows and lists here are by run or by document.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..tables import shared_folder, written
from . import citations as C
from . import dedup as D
from . import diagnostics as Q
from . import grounding as G
from . import items as I
from . import planning as P
from . import summary as S

Generator = Callable[[DataFrame], DataFrame]

# --- fixed values -----------------------------------------------------------------------------------------------
HOLISTIC = ["resumen ejecutivo", "resumen", "executive_summary"]
SEQUENTIAL = ["tutorial", "guion de clase", "guion", "class_script"]
SEPARATOR = "\n\n---\n\n"
NO_CHUNK, SUMMARY_ROUNDS = "chunk-001", 3
UNCOVERED = "\n\nSECTIONS NOT COVERED YET (write the points only about these): "
UNGROUNDED, UNVERIFIED = "Ungrounded: no cited source was verified.", "Sin verificación de cita."
QUIZ_REASON = {True: "Fundamento técnico verificado.", False: "Core technical foundation."}
MODULE, STEP = {True: "Módulo ", False: "Module "}, {True: "Paso ", False: "Step "}
FIELDS = [
    "frente", "dorso", "pista_didactica", "pregunta", "respuesta_correcta", "justificacion", "justificacion_didactica", "titulo", "instruccion", "ejemplo",
    "punto_clave", "impacto_negocio", "narracion",
]
# ----------------------------------------------------------------------------------------------------------------

_TEXTS = ", ".join(f"{n}: string" for n in FIELDS) + ", opciones: array<string>"
ITEM = f"struct<{_TEXTS}>"
SOURCE = "struct<chunk_id: string, extracto: string, seccion: string, breadcrumb: string, pagina: int>"
ANSWER = f"array<struct<{_TEXTS}, fuentes: array<{SOURCE}>, item_index: int>>"


def kept(frame: DataFrame) -> DataFrame:
    """The frame as a written table in the shared folder."""
    return written(frame, shared_folder(frame.sparkSession, "generation"))


def as_item(c: Column) -> Column:
    """Any struct of an item's fields as the struct of all fields."""
    return F.from_json(F.to_json(c), ITEM)


# Plans ----------------------------------------------------------------------------------------------------------


def planned_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The chunks that the plan of each document uses, with strategy, section_title, section_no, chunk_no and total_chars.

    chunks: document_id, position, chunk_id, title, content, breadcrumb, page_number. requests: document_id, fmt, requested, language, one
    row a document. A document without substantive chunks uses all. Summaries also use what reads as prose under a navigational title.
    All windows are by document, behind one shuffle.
    """
    fmt = F.lower(F.btrim(F.coalesce(F.nullif("fmt", F.lit("")), F.lit("flashcards"))))
    asked = requests.select("document_id", fmt.alias("fmt"), F.col("requested").cast("long").alias("requested"), "language")
    strategy = F.when(F.col("fmt").isin(HOLISTIC), "holistic").when(F.col("fmt").isin(SEQUENTIAL), "sequential").otherwise("distributed")
    whole = Window.partitionBy("document_id")
    rows = chunks.join(asked.withColumn("strategy", strategy), "document_id").withColumn("content", F.coalesce("content", F.lit("")))
    rows = rows.withColumns({"plain": P.is_substantive("title", "content"), "prose": P.is_substantive("title", "content", True)})
    rows = rows.withColumns({"any_plain": F.bool_or("plain").over(whole), "any_prose": F.bool_or("prose").over(whole) & (F.col("strategy") == "holistic")})
    rows = rows.withColumn("plain", F.col("plain") | ~F.col("any_plain"))
    rows = rows.withColumn("total_chars", F.sum(F.when(F.col("plain"), F.length("content")).otherwise(0)).over(whole))
    rows = rows.filter(F.when(F.col("any_prose"), F.col("prose")).otherwise(F.col("plain")))
    title = F.when(~((F.col("any_plain") | F.col("any_prose")) & P.is_page_title("title")), F.btrim("title"))
    rows = rows.withColumn("title", F.nullif(title, F.lit("")))
    counter = F.sum(F.col("title").isNull().cast("int")).over(whole.orderBy("position"))
    rows = rows.withColumn("section_title", F.coalesce("title", F.concat(F.lit("Sección "), counter.cast("string"))))
    by_section = Window.partitionBy("document_id", "section_title")
    rows = rows.withColumns({"first": F.min("position").over(by_section), "chunk_no": F.row_number().over(by_section.orderBy("position")) - 1})
    rows = rows.withColumn("section_no", F.dense_rank().over(whole.orderBy("first")) - 1)
    return rows.drop("plain", "prose", "any_plain", "any_prose", "first")


def coverage_plan(chunks: DataFrame, requests: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """(document_id, strategy, section_no, section_title, n_chunks, allocated_items, primary_chunk_id, page_number, capacity, viable, warning).

    One row a section, its items in proportion to its characters; for summaries one row a document. Only short texts cap what was asked.
    ``planned`` is what :func:`planned_chunks` gives, where it is at hand.
    """
    rows = planned_chunks(chunks, requests) if planned is None else planned
    named, paged = F.coalesce("chunk_id", F.lit("")) != "", F.col("page_number") > 0
    same = ["strategy", "fmt", "requested", "language", "total_chars"]
    sections = rows.groupBy("document_id", "section_no", "section_title").agg(
        F.sum(F.length("content")).cast("long").alias("weight"),
        F.count("*").alias("n_chunks"),
        F.min_by(F.when(named, F.col("chunk_id")), F.when(named, F.col("position"))).alias("primary_chunk_id"),
        F.min_by(F.when(paged, F.col("page_number")), F.when(paged, F.col("position"))).alias("page_number"),
        *[F.any_value(c).alias(c) for c in same],
    )
    most = F.greatest(F.lit(3), F.floor(F.col("total_chars") / L.min_chars_per_item(F.col("fmt")))).cast("long")
    capped = (F.col("requested") > most) & (F.col("total_chars") < 800)
    sections = sections.withColumns({"capacity": L.capacity(F.col("fmt"), F.col("total_chars"), F.col("requested")), "viable": F.when(capped, F.greatest(F.lit(1), F.least("requested", most))).otherwise(F.col("requested"))})
    sections = sections.withColumn("warning", F.when(capped, P.capacity_warning(F.col("viable"), F.col("requested"), F.col("language"))))
    out = ["document_id", "strategy", "section_no", "section_title", "n_chunks", "allocated_items", "primary_chunk_id", "page_number", "capacity", "viable", "warning"]
    apart = P.allocate(sections.filter("strategy <> 'holistic'"), F.col("viable")).select(*out)
    lead = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("section_no"))).alias(c)
    one = sections.filter("strategy = 'holistic'").groupBy("document_id").agg(
        F.min("section_no").alias("section_no"), *[lead(c) for c in ("strategy", "section_title", "primary_chunk_id", "page_number", "capacity", "viable", "warning")], F.sum("n_chunks").alias("n_chunks")
    )
    both = apart.unionByName(one.withColumn("allocated_items", F.col("viable")).select(*out))
    return both.withColumn("primary_chunk_id", F.coalesce("primary_chunk_id", F.lit(NO_CHUNK)))


def excerpts(planned: DataFrame, budget: int = P.CONTEXT) -> DataFrame:
    """(document_id, section_no, nth, chunk_id, section, breadcrumb, page, text): what of each chunk a writer is shown.

    A chunk of a section gets an even share of the budget, 300 characters at least, cut at a sentence or word. For summaries the first 300
    characters of chunks of all sections in turn, until four budgets are used.
    """
    rows = planned.withColumn("text", T.strip(F.col("content")))
    page = F.when(F.col("page_number") > 0, F.col("page_number")).alias("page")
    out = ["document_id", "section_no", "nth", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.col("section_title").alias("section"), F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"), page, "text"]
    n = F.count("*").over(Window.partitionBy("document_id", "section_title"))
    share = F.greatest(F.lit(300), F.floor(F.lit(budget) / n)).cast("int")
    apart = rows.filter("strategy <> 'holistic'").withColumn("share", share).filter("text <> ''")
    apart = apart.withColumns({"text": T.context_window(F.col("text"), F.col("share")), "nth": F.col("position").cast("long")}).select(*out)
    turns = Window.partitionBy("document_id").orderBy("chunk_no", "section_no")
    one = P.round_robin(rows.filter("strategy = 'holistic'"), budget=4 * budget).withColumn("text", F.col("fragment"))
    return apart.unionByName(one.withColumn("nth", F.row_number().over(turns).cast("long")).select(*out))


# Prompts --------------------------------------------------------------------------------------------------------


def excerpt_block(default: str = "Unknown section") -> Column:
    """A passage under a header with its id, section, breadcrumb and page. Expects the columns of :func:`excerpts`."""
    part = lambda c, before: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c)).otherwise("")
    head = F.concat(F.lit("["), F.coalesce("chunk_id", F.lit("")), F.lit("] SECTION: "), F.coalesce(F.nullif("section", F.lit("")), F.lit(default)))
    return F.concat(head, part(F.col("breadcrumb"), " | "), part(F.col("page").cast("string"), " | p."), F.lit("\n"), T.strip(F.coalesce("text", F.lit(""))))


def braces_doubled(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def filled(template: str, **values: Column) -> Column:
    """A template with columns in place of ``{name}``; what is put in is not read again."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("N/A")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def joined_blocks(shown: DataFrame, keys: list[str], default: str = "Unknown section") -> DataFrame:
    """(keys, chunk_info): the blocks of passages in their order."""
    blocks = F.array_sort(F.collect_list(F.struct("nth", excerpt_block(default).alias("block"))))
    return shown.groupBy(*keys).agg(F.array_join(F.transform(blocks, lambda b: b["block"]), SEPARATOR).alias("chunk_info"))


# Batches --------------------------------------------------------------------------------------------------------


def _answered(calls: DataFrame, generator: Generator, keep) -> DataFrame:
    """Calls with ``found``, the items of their answers; null if none can be read."""
    answers = keep(generator(calls.select("run_id", "call_no", "item_count", "prompt"))).select("run_id", "call_no", Q.item_list(F.col("raw"), ANSWER).alias("found"))
    return calls.join(answers, ["run_id", "call_no"], "left").withColumn("found", F.when(F.size("found") > 0, F.col("found")))


def generated(topics: DataFrame, requests: DataFrame, generator: Generator, template: str, fmt: str, keep=kept) -> DataFrame:
    """(run_id, item_idx, item, fuentes, es_fallback): the items of each run.

    topics: run_id, topic_no, topic, context, chunk_id, page, chunk_info, target_items. requests: run_id, target. Up to ten items over several
    topics are asked for in one call. Where that gives nothing, and for more items, each topic is asked in turn for its share, never more than a
    batch or what is still missing; answers that can't be read give way to stand-ins, and once the target is reached no topic is asked.

    What a topic is asked for depends on what came before it. All topics are asked at once as if every answer had the length asked for; then each run
    is walked again with the answers that came, and only topics for which that changes the number are asked once more (see :func:`_walked`).
    """
    rows = topics.join(requests, "run_id").withColumn("n_topics", F.count("*").over(Window.partitionBy("run_id")))
    sorted_ = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("topic_no", F.col(c).alias("x")))), lambda s: s["x"])
    whole = rows.filter("target <= 10 and n_topics > 1").groupBy("run_id").agg(
        F.any_value("target").cast("long").alias("item_count"), sorted_("topic").alias("names"), sorted_("chunk_info").alias("infos"),
        F.min_by("chunk_id", "topic_no").alias("chunk_id"), F.min_by("page", "topic_no").alias("page"),
    )
    names = F.array_join(F.array_distinct(F.filter("names", lambda n: n != "")), ", ")
    whole = whole.select("run_id", F.lit(-1).alias("call_no"), "item_count", _prompt(template, names, F.array_join("infos", SEPARATOR)).alias("prompt"))
    whole = keep(_answered(whole, generator, keep).filter("found is not null"))
    first = whole.select("run_id", F.posexplode("found").alias("item_idx", "i"), "item_count").filter("item_idx < item_count").select("run_id", F.col("item_idx").cast("long"), "i", F.lit(False).alias("es_fallback"))

    rest = rows.join(whole.select("run_id"), "run_id", "left_anti")
    share = F.least(F.coalesce("target_items", L.batch_size(F.col("target"))), L.batch_size(F.col("target"))).cast("long")
    rest = keep(rest.withColumn("share", share))
    answers = None
    while True:
        walked = _walked(rest, answers)
        ask = walked.filter("not known").drop("known", "before")
        if not (answers is None or ask.head(1)):
            break
        calls = rest.join(ask, ["run_id", "topic_no"]).withColumn("call_no", F.col("topic_no").cast("int")).withColumn("prompt", _prompt(template, F.col("topic"), F.col("chunk_info")))
        new = keep(_answered(calls, generator, keep).select("run_id", "topic_no", "item_count", "found"))
        answers = new if answers is None else answers.unionByName(new)
    asked = rest.join(walked, ["run_id", "topic_no"]).join(answers, ["run_id", "topic_no", "item_count"])
    read = asked.filter("found is not null").select("run_id", "before", F.posexplode("found").alias("k", "i")).select("run_id", (F.col("before") + F.col("k")).alias("item_idx"), "i", F.lit(False).alias("es_fallback"))
    lost = asked.filter("found is null").withColumn("item_idx", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("item_count") - 1)))
    stand_ins = I.fallback_items(lost, fmt).select("run_id", "item_idx", F.from_json(F.to_json("item"), ANSWER[len("array<") : -1]).alias("i"), "es_fallback", _own_source().alias("s"))
    items = first.unionByName(read).select("run_id", "item_idx", as_item(F.col("i")).alias("item"), F.col("i.fuentes").alias("fuentes"), "es_fallback")
    return items.unionByName(stand_ins.select("run_id", "item_idx", as_item(F.col("i")).alias("item"), F.array("s").alias("fuentes"), "es_fallback"))


def _walked(rest: DataFrame, answers: DataFrame | None) -> DataFrame:
    """(run_id, topic_no, item_count, before, known): the topics that are asked, in turn, for what is missing then, and whether that answer is there.

    rest: run_id, topic_no, share, target. answers: run_id, topic_no, item_count, found. An answer that is not there yet counts as what is asked for, as
    does one that can't be read. A run's topics are few, and only their numbers are gathered.
    """
    none = F.lit(None).cast("array<struct<asked:bigint,n:bigint>>")
    rows = rest.select("run_id", "topic_no", "share", F.col("target").cast("long").alias("target"))
    if answers is None:
        rows = rows.withColumn("came", none)
    else:
        length = F.when(F.col("found").isNull(), F.col("item_count")).otherwise(F.size("found")).cast("long")
        told = answers.groupBy("run_id", "topic_no").agg(F.collect_list(F.struct(F.col("item_count").cast("long").alias("asked"), length.alias("n"))).alias("came"))
        rows = rows.join(told, ["run_id", "topic_no"], "left")
    runs = rows.groupBy("run_id").agg(F.any_value("target").alias("target"), F.array_sort(F.collect_list(F.struct("topic_no", "share", "came"))).alias("topics"))
    kind = rest.schema["topic_no"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast(f"array<struct<topic_no:{kind},item_count:bigint,before:bigint,known:boolean>>").alias("out"))

    def step(state: Column, topic: Column) -> Column:
        want = F.least(topic["share"], F.col("target") - state["n"])
        came = F.get(F.filter(topic["came"], lambda a: a["asked"] == want), F.lit(0))["n"]
        row = F.struct(topic["topic_no"].alias("topic_no"), want.alias("item_count"), state["n"].alias("before"), came.isNotNull().alias("known"))
        return F.when(want > 0, F.struct((state["n"] + F.coalesce(came, want)).alias("n"), F.concat(state["out"], F.array(row)).alias("out"))).otherwise(state)

    return runs.select("run_id", F.inline(F.aggregate("topics", start, step)["out"]))


def _prompt(template: str, topic: Column, info: Column) -> Column:
    return filled(template, topic=topic, item_count=F.col("item_count"), chunk_info=braces_doubled(info))


def _own_source() -> Column:
    """The citation of a stand-in: its topic's chunk."""
    return F.struct(F.coalesce("chunk_id", F.lit(NO_CHUNK)).alias("chunk_id"), F.col("extracto"), F.lit(None).cast("string").alias("seccion"), F.lit(None).cast("string").alias("breadcrumb"), F.when(F.col("page") > 0, F.col("page")).cast("int").alias("pagina"))


def sources_of(items: DataFrame, order: str = "item_idx") -> DataFrame:
    """(run_id, order, source_no, chunk_id, extracto, section, breadcrumb, page) of items with ``fuentes``."""
    s = items.select("run_id", order, F.posexplode("fuentes").alias("source_no", "s"))
    return s.select("run_id", order, "source_no", F.col("s.chunk_id").alias("chunk_id"), F.col("s.extracto").alias("extracto"), F.col("s.seccion").alias("section"), F.col("s.breadcrumb").alias("breadcrumb"), F.col("s.pagina").alias("page"))


def summary_points(shown: DataFrame, requests: DataFrame, generator: Generator, template: str, rounds: int = SUMMARY_ROUNDS, keep=kept) -> DataFrame:
    """(run_id, item_idx, item, fuentes): points of summaries over whole documents.

    shown: run_id and the columns of :func:`excerpts`. requests: run_id, target, title. Up to three rounds ask for what is missing, later
    ones for the sections that no point covers; a run whose answer can't be read ends. Points that begin alike are one. Of more points
    than asked for, the first of each section stay before others. There are no stand-ins.
    """
    blocks = shown.filter("chunk_id <> ''")
    first = Window.partitionBy("run_id", "chunk_id").orderBy("nth")
    blocks = blocks.withColumn("again", F.row_number().over(first)).filter("again = 1").drop("again")
    points, alive = None, requests.select("run_id", "target", "title")
    for r in range(rounds):
        if points is None:
            info, state = joined_blocks(blocks, ["run_id"], "Document"), alive.withColumns({"item_count": F.col("target"), "note": F.lit("")})
        else:
            pending = C.pending_sections(sources_of(points), shown)
            names = pending.groupBy("run_id").agg(F.count("*").alias("n_pending"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "section"))), lambda s: s["section"]), ", ").alias("names"))
            have = points.groupBy("run_id").agg(F.count("*").alias("have"))
            state = alive.join(have, "run_id", "left").join(names, "run_id", "left").withColumn("missing", F.col("target") - F.coalesce("have", F.lit(0)))
            state = state.filter((F.col("missing") > 0) | F.col("names").isNotNull())
            state = state.withColumns({"item_count": F.when(F.col("missing") > 0, F.col("missing")).otherwise(F.col("n_pending")), "note": F.coalesce(F.concat(F.lit(UNCOVERED), "names"), F.lit(""))})
            some = blocks.withColumn("wanted", F.btrim("section")).join(pending.select("run_id", F.col("section").alias("wanted")), ["run_id", "wanted"], "left_semi")
            info = joined_blocks(some, ["run_id"], "Document").withColumnRenamed("chunk_info", "few").join(joined_blocks(blocks, ["run_id"], "Document"), "run_id", "right").select("run_id", F.coalesce("few", "chunk_info").alias("chunk_info"))
        calls = state.join(info, "run_id").withColumns({"call_no": F.lit(r), "item_count": F.col("item_count").cast("long")})
        calls = calls.select("run_id", "call_no", "item_count", F.concat(_prompt(template, F.col("title"), F.col("chunk_info")), "note").alias("prompt"))
        asked = keep(_answered(calls, generator, keep))
        alive = alive.join(asked.filter("found is not null").select("run_id"), "run_id", "left_semi")
        new = asked.select("run_id", F.posexplode("found").alias("k", "i")).select("run_id", (F.lit(r * 1_000_000) + F.col("k")).cast("long").alias("item_idx"), as_item(F.col("i")).alias("item"), F.col("i.fuentes").alias("fuentes"))
        new = new.filter(F.btrim(F.coalesce("item.punto_clave", F.lit(""))) != "")
        points = keep(D.exact_first(new if points is None else points.unionByName(new), D.point_key(F.col("item.punto_clave"))))
    cited = C.section_keys(points, sources_of(points), shown).withColumn("section", F.array_join("sections", "|")).drop("sections")
    chosen = D.prune(points.join(cited, ["run_id", "item_idx"]).join(requests.select("run_id", "target"), "run_id"), F.col("target"))
    return chosen.select("run_id", "item_idx", "item", "fuentes")


# Repair ---------------------------------------------------------------------------------------------------------


def repaired(items: DataFrame, records: DataFrame, passages: DataFrame, chunks: DataFrame, targets: DataFrame, topics: DataFrame, generator: Generator, critic, fmt: str, language: str = "Spanish", keep=kept) -> tuple[DataFrame, DataFrame]:
    """Items and records after one round of repair.

    items: run_id, gid, item_idx, item, fuentes, grounded, repaired, es_fallback. records: run_id, gid, verified, clarity, issues. passages,
    chunks: run_id, chunk_id, content, nth. targets: run_id, target. topics: run_id, topic_no, topic, context, chunk_id, page. The weak items
    of a run (ungrounded or unclear, not repaired yet) are one call with their issues and cited texts. What comes back keeps its old sources
    if it has none, is verified and reviewed again (``critic``: items -> records), and goes if it is still unverified or garbage. What a run
    lacks then is filled with stand-ins that are verified and no garbage; summaries are not filled.
    """
    rows = items.join(records.select("run_id", "gid", "clarity", "issues"), ["run_id", "gid"], "left")
    weak = ~F.col("repaired") & (~F.col("grounded") | F.coalesce("clarity", F.lit("")).isin("Baja", "Low"))
    issues = F.concat(F.when(F.col("grounded"), F.array().cast("array<string>")).otherwise(F.array(F.lit(UNGROUNDED))), F.coalesce("issues", F.array().cast("array<string>")))
    failing = rows.filter(weak).withColumn("issues", issues)
    texts = C.cited_texts(sources_of(failing), passages, chunks).join(sources_of(failing).select("run_id", "item_idx", "chunk_id", "extracto"), ["run_id", "item_idx", "chunk_id"])
    shown = texts.groupBy("run_id", "item_idx").agg(F.collect_list(F.struct("chunk_id", T.context_window(F.col("text"), P.CONTEXT, F.col("extracto")).alias("text"))).alias("cited_source_context"))
    payload = failing.join(shown, ["run_id", "item_idx"], "left").select("run_id", F.struct(F.col("item_idx").alias("item_index"), F.col("item").alias("current_item"), F.col("issues").alias("issues_detected"), F.coalesce("cited_source_context", F.array().cast("array<struct<chunk_id:string,text:string>>")).alias("cited_source_context")).alias("p"))
    calls = payload.groupBy("run_id").agg(F.count("*").alias("item_count"), F.to_json(F.array_sort(F.collect_list("p"), lambda a, b: (a["item_index"] - b["item_index"]).cast("int"))).alias("prompt"))
    answers = keep(_answered(calls.withColumn("call_no", F.lit(0)), generator, keep))
    back = answers.select("run_id", F.explode("found").alias("i")).groupBy("run_id", F.col("i.item_index").cast("long").alias("item_idx")).agg(F.any_value("i").alias("i"))
    tried = failing.join(back, ["run_id", "item_idx"], "left")
    tried = tried.withColumns({"item": F.when(F.col("i").isNotNull(), as_item(F.col("i"))).otherwise(F.col("item")), "fuentes": F.when(F.size("i.fuentes") > 0, F.col("i.fuentes")).otherwise(F.col("fuentes")), "repaired": F.lit(True)}).select(*items.columns)
    again = keep(_verified(tried, passages, chunks, language))
    fresh = critic(again)
    old = records.join(fresh.select("run_id", "gid"), ["run_id", "gid"], "left_anti")
    # A new verdict takes the place of an old one; an item that had none is not given one.
    renewed = old.unionByName(fresh.join(records.select("run_id", "gid"), ["run_id", "gid"], "left_semi").select(*records.columns))
    untouched = items.join(again.select("run_id", "gid"), ["run_id", "gid"], "left_anti")
    judged = keep(I.item_texts(again.unionByName(untouched).join(records.select("run_id", "gid", "clarity", F.col("verified").alias("vote")), ["run_id", "gid"], "left")))
    bad = I.is_garbage(judged, clarity=F.col("clarity"), reviewer=F.col("vote"), lexical=F.col("grounded"))
    kept = judged.filter(~(F.col("repaired") & (bad | ~F.col("grounded")))).select(*items.columns)
    if fmt == "executive_summary":
        return kept, renewed
    more = G.completion(kept, topics, targets, fmt=fmt).withColumn("gid", F.concat(F.lit("replace_"), F.col("item_idx").cast("string")))
    more = more.select("run_id", "gid", (F.col("item_idx") + 1_000_000).alias("item_idx"), as_item(F.col("item")).alias("item"), F.array(_own_source()).alias("fuentes"), F.lit(False).alias("grounded"), F.lit(False).alias("repaired"), "es_fallback")
    more = keep(I.item_texts(_verified(keep(more.select(*items.columns)), passages, chunks, language)))
    return kept.unionByName(more.filter(F.col("grounded") & ~I.is_garbage(more)).select(*items.columns)), renewed


def _verified(items: DataFrame, passages: DataFrame, chunks: DataFrame, language: str) -> DataFrame:
    """Items with ``grounded`` judged anew against passages and the chunks that are no passages."""
    own = ["run_id", "chunk_id", "content", "nth"]
    rest = chunks.join(passages.select("run_id", "chunk_id"), ["run_id", "chunk_id"], "left_anti").select(*own).withColumn("nth", F.struct(F.lit(1).alias("late"), "nth"))
    all_ = passages.select(*own).withColumn("nth", F.struct(F.lit(0).alias("late"), "nth")).unionByName(rest)
    texts = kept(I.item_texts(items))
    verdicts = G.verify(texts, sources_of(items, "gid"), all_, key="gid", language=language, order="nth")
    return G.grounded(items.drop("grounded"), verdicts, key="gid").select(*items.columns)


# Final content --------------------------------------------------------------------------------------------------


def published(items: DataFrame, records: DataFrame, targets: DataFrame, fmt: str, keep=kept) -> DataFrame:
    """Items to publish, with nth from 0 and their record: (…, nth, lexical, reviewer, verified, clarity, issues).

    targets: run_id, target, language, clarity (of the whole output, may be null). Garbage goes, then what exceeds the target; of summaries
    also what repeats an earlier point, and stand-ins. A missing vote counts as yes.
    """
    # a filter on texts would be pushed below them, with a copy of their expressions at each place that names them
    rows = keep(I.item_texts(items.join(records.select("run_id", "gid", F.col("verified").alias("vote"), F.col("clarity").alias("own"), "issues"), ["run_id", "gid"], "left")))
    rows = rows.filter(~I.is_garbage(rows, clarity=F.col("own"), reviewer=F.col("vote"), lexical=F.col("grounded")))
    by = Window.partitionBy("run_id").orderBy("item_idx")
    rows = rows.join(targets.select("run_id", "target", "language", "clarity"), "run_id").withColumn("nth", F.row_number().over(by) - 1).filter("nth < target")
    if fmt == "executive_summary":
        rows = D.short_runs_dedup(rows, text="full_text").filter(~F.coalesce("es_fallback", F.lit(False)))
        rows = rows.withColumn("nth", F.row_number().over(by) - 1)
    spanish = L.language_code(F.col("language")) == "es"
    rows = rows.withColumns({"lexical": F.col("grounded"), "reviewer": F.coalesce("vote", F.lit(True))}).withColumn("verified", F.col("lexical") & F.col("reviewer"))
    clarity = F.coalesce(F.nullif("own", F.lit("")), F.nullif("clarity", F.lit("")), F.when(spanish, "Alta").otherwise("High"))
    issues = F.coalesce("issues", F.when(F.col("verified"), F.array().cast("array<string>")).otherwise(F.array(F.lit(UNVERIFIED))))
    return rows.withColumns({"clarity": clarity, "issues": issues}).drop("vote", "own", "target", "language", "primary_text", "full_text", "audit_text", "claim_text", "grounding_text")


def outcome(final: DataFrame, targets: DataFrame, fmt: str) -> DataFrame:
    """(run_id, requested, generated, score, minutes, observations, notice, warning) of each run, also of those without items.

    targets: run_id, requested, language, observations, warning. The score is the verified share to two places.
    """
    per = final.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("ok"))
    rows = targets.join(per, "run_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "ok": F.coalesce("ok", F.lit(0)), "code": L.language_code(F.col("language"))})
    note = F.when(F.col("code") == "es", F.format_string("%d de %d elementos verificados.", "ok", "n")).otherwise(F.format_string("%d of %d items verified.", "ok", "n"))
    base = F.btrim(F.coalesce("observations", F.lit("")))
    observations = F.when(base.contains(note), F.col("observations")).otherwise(F.btrim(F.concat_ws(" ", note, base)))
    notice, warning = F.lit(None).cast("string"), F.col("warning")
    if fmt == "executive_summary":
        notice = F.when(F.col("n") == 0, S.message("empty_short", F.col("code")))
        partial = S.message("partial", F.col("code"), F.col("n"), F.col("requested"))
        warning = F.when(F.col("n") == 0, F.lit(None)).when(F.col("n") < F.col("requested"), partial).otherwise(warning)
    score = F.bround(F.least(F.lit(1.0), F.col("ok") / F.greatest(F.lit(1), F.col("n"))), 2)
    return rows.select("run_id", "requested", F.col("n").alias("generated"), score.alias("score"), L.study_minutes(F.col("n")).alias("minutes"), observations.alias("observations"), notice.alias("notice"), warning.alias("warning"))


def assembled(final: DataFrame, fmt: str, spanish: bool = True) -> DataFrame:
    """(run_id, nth, heading, body, item) as the format shows its items, steps and scenes numbered from 1.

    Quizzes shuffle their options and get a reason where they lack one. Tutorials lose step prefixes of their titles. Scripts lose Markdown
    at the head of the narration. Summaries are composed by :func:`summary.composed`.
    """
    it, no = F.col("item"), F.col("nth") + 1
    text = lambda n: F.coalesce(it.getField(n), F.lit(""))
    if "quiz" in fmt:
        rows = I.shuffled_options(final.withColumns({"opciones": it.getField("opciones"), "respuesta_correcta": it.getField("respuesta_correcta")}))
        reason = F.coalesce(F.nullif(text("justificacion_didactica"), F.lit("")), F.nullif(text("justificacion"), F.lit("")), F.lit(QUIZ_REASON[spanish]))
        options = F.coalesce("opciones", F.array(*map(F.lit, "ABCD")))
        item = it.withField("opciones", options).withField("respuesta_correcta", F.coalesce("respuesta_correcta", F.lit("A"))).withField("justificacion_didactica", reason)
        heading, body = F.coalesce(it.getField("pregunta"), F.concat(F.lit("Pregunta #"), no.cast("string"))), F.array_join(options, "\n")
    elif "tutorial" in fmt:
        rows = final
        title = F.coalesce(F.nullif(F.btrim(T.strip_step_prefix(F.btrim(text("titulo")))), F.lit("")), F.concat(F.lit(MODULE[spanish]), no.cast("string")))
        item, heading = it.withField("titulo", title), F.concat(F.lit(STEP[spanish]), no.cast("string"), F.lit(": "), title)
        body = T.strip(F.concat_ws("\n\n", text("instruccion"), text("ejemplo")))
    elif "script" in fmt or "guion" in fmt or "clase" in fmt:
        rows = final
        body = T.strip(F.regexp_replace(text("narracion"), r"^(?:#{1,6}\s*|\*{1,2})", ""))
        item, heading = it.withField("narracion", body), no.cast("string")
    else:
        rows, item, heading, body = final, it, text("frente"), text("dorso")
    return rows.select("run_id", "nth", heading.alias("heading"), body.alias("body"), item.alias("item"))
