"""Literal cases of the generation flow with deterministic generators."""

import json

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import generation as X
from quillstone.operators import planning as P


def answering(spark, answers):
    """A generator that answers (run, call) from a dictionary, and what it was asked."""
    asked = {}

    def generator(calls):
        rows = calls.collect()
        asked.update({(r.run_id, r.call_no): (r.item_count, r.prompt) for r in rows})
        return spark.createDataFrame([(r.run_id, r.call_no, answers.get((r.run_id, r.call_no))) for r in rows], "run_id string, call_no int, raw string")

    return generator, asked


def test_windows_around_a_passage(spark):
    text = "".join(f"Sentence number {i:02d} ends here. " for i in range(40))
    row = spark.createDataFrame([(text, "Sentence number 20"), (text, "absent"), ("  short ", "x"), (None, "x"), ("a" * 500, "")], "t string, f string")
    got = [r[0] for r in row.select(T.context_window(F.col("t"), 240, F.col("f"))).collect()]
    assert "Sentence number 20" in got[0] and got[0].endswith(".") and len(got[0]) <= 240 and text.strip()[text.find(got[0]) - 1] == " "
    assert got[1].startswith("Sentence number 00") and got[1].endswith(".") and text.startswith(got[1])
    assert got[2:4] == ["short", ""] and got[4] == "a" * 240


def test_a_document_of_noise_is_used_whole_and_short_texts_cap(spark):
    chunks = [("a", 0, "c0", "Glossary", "x" * 100, "", 0), ("a", 1, "", "page 3", "y" * 20, "", 5), ("b", 0, "k", None, "Z" * 900, "", None)]
    chunks = spark.createDataFrame(chunks, "document_id string, position int, chunk_id string, title string, content string, breadcrumb string, page_number int")
    requests = spark.createDataFrame([("a", "Flashcards", 10, "Spanish"), ("b", "", 30, None)], "document_id string, fmt string, requested int, language string")
    rows = {(r.document_id, r.section_title): r for r in X.coverage_plan(chunks, requests).collect()}
    assert set(rows) == {("a", "Glossary"), ("a", "page 3"), ("b", "Sección 1")}
    assert rows["a", "Glossary"].viable == 3 and rows["a", "Glossary"].warning.startswith("El documento") and rows["a", "page 3"].primary_chunk_id == "chunk-001"
    assert (rows["b", "Sección 1"].capacity, rows["b", "Sección 1"].allocated_items, rows["b", "Sección 1"].warning) == (30, 30, None)
    assert sum(r.allocated_items for r in rows.values() if r.document_id == "a") == 3


def test_one_call_for_few_items_else_one_a_topic(spark):
    topics = [(run, i, f"T{i}", f"The sentence of topic {i} is long enough. ", f"c{i}", i, "{info}", share) for run, share in (("few", 3), ("many", 8)) for i in range(3)]
    topics = spark.createDataFrame(topics, "run_id string, topic_no int, topic string, context string, chunk_id string, page int, chunk_info string, target_items int")
    requests = spark.createDataFrame([("few", 2), ("many", 20)], "run_id string, target int")
    cards = lambda n: json.dumps([{"frente": f"f{i}", "dorso": "d", "fuentes": [{"chunk_id": "c"}]} for i in range(n)])
    generator, asked = answering(spark, {("few", -1): cards(4), ("many", 0): cards(8), ("many", 1): "no", ("many", 2): '{"items": ' + cards(9) + "}"})
    got = X.generated(topics, requests, generator, "{item_count}|{topic}|{chunk_info}", "flashcards").collect()
    assert asked == {("few", -1): (2, "2|T0, T1, T2|" + X.SEPARATOR.join(["{{info}}"] * 3)), ("many", 0): (8, "8|T0|{{info}}"), ("many", 1): (8, "8|T1|{{info}}"), ("many", 2): (4, "4|T2|{{info}}")}
    assert sorted(r.item_idx for r in got if r.run_id == "few") == [0, 1]
    many = {r.item_idx: r for r in got if r.run_id == "many"}
    assert sorted(many) == list(range(25)) and [i for i, r in many.items() if r.es_fallback] and {i for i, r in many.items() if r.es_fallback} == set(range(8, 16))
    assert many[8].fuentes[0].chunk_id == "c1" and many[8].fuentes[0].pagina == 1


def test_concepts_are_matched_within_their_document(spark):
    topics = spark.createDataFrame([("a", "Redes neuronales"), ("a", "Redes neuronales"), ("a", "nada"), ("b", "redes")], "document_id string, topic string")
    concepts = spark.createDataFrame([("a", "neuronales", 2), ("a", "REDES", 1), ("b", "Redes neuronales", 1)], "document_id string, concept string, position int")
    got = sorted((r.document_id, r.topic, r.concept or "") for r in P.match_concepts(topics, concepts).collect())
    assert got == [("a", "Redes neuronales", "REDES"), ("a", "Redes neuronales", "REDES"), ("a", "nada", ""), ("b", "redes", "Redes neuronales")]


def test_later_topics_are_asked_for_what_is_still_missing(spark):
    topics = [(run, i, f"T{i}", "A sentence that is long enough. ", f"c{i}", i, "x", 8) for run in ("short", "none", "long") for i in range(4)]
    topics = spark.createDataFrame(topics, "run_id string, topic_no int, topic string, context string, chunk_id string, page int, chunk_info string, target_items int")
    requests = spark.createDataFrame([("short", 20), ("none", 20), ("long", 20)], "run_id string, target int")
    cards = lambda n: json.dumps([{"frente": f"f{i}", "dorso": "d"} for i in range(n)])
    told = []

    def generator(calls):
        rows = calls.collect()
        told.extend((r.run_id, r.call_no, r.item_count) for r in rows)
        answer = {"short": lambda r: cards(r.item_count - 3 if r.call_no == 0 else r.item_count), "none": lambda r: "sorry", "long": lambda r: cards(12 if r.call_no == 0 else r.item_count)}
        return spark.createDataFrame([(r.run_id, r.call_no, answer[r.run_id](r)) for r in rows], "run_id string, call_no int, raw string")

    got = X.generated(topics, requests, generator, "{topic}", "flashcards").collect()
    per = {run: sorted(r.item_idx for r in got if r.run_id == run) for run in ("short", "none", "long")}
    assert per == {run: list(range(20)) for run in per}
    # the first of 'short' gives 5 of 8: the third is asked again, for 7, the fourth not at all; no call is made twice
    assert sorted(told) == sorted({*told}) and {c for c in told if c[0] == "short"} == {("short", 0, 8), ("short", 1, 8), ("short", 2, 4), ("short", 2, 7)}
    assert {c for c in told if c[0] == "none"} == {("none", 0, 8), ("none", 1, 8), ("none", 2, 4)}
    # the first of 'long' gives more than asked for, which the third makes good
    assert {c for c in told if c[0] == "long"} == {("long", 0, 8), ("long", 1, 8), ("long", 2, 4)} and sum(r.es_fallback for r in got if r.run_id != "none") == 0


def shown_sections(spark, runs):
    rows = [(run, i, i, f"c{i}", s, "", None, f"Text of {s}.") for run in runs for i, s in enumerate("ABC")]
    return spark.createDataFrame(rows, "run_id string, section_no int, nth long, chunk_id string, section string, breadcrumb string, page int, text string")


def points(*told):
    return json.dumps({"items": [{"punto_clave": p, "impacto_negocio": "x", "fuentes": [{"chunk_id": c, "extracto": "Text"}]} for p, c in told]})


def test_summary_rounds_ask_for_what_is_missing_and_uncovered(spark):
    runs = ["grows", "dumb", "full", "many"]
    requests = spark.createDataFrame([("grows", 3, "Doc"), ("dumb", 2, "Doc"), ("full", 3, "Doc"), ("many", 2, "Doc")], "run_id string, target int, title string")
    generator, asked = answering(spark, {
        ("grows", 0): points(("One point", "c0"), ("ONE point", "c0"), (" ", "c1")), ("grows", 1): points(("Two", "c1")), ("grows", 2): "sorry",
        ("dumb", 0): "no json",
        ("full", 0): points(("a", "c0"), ("b", "c1"), ("c", "c2")),
        ("many", 0): points(("a", "c0"), ("b", "c0")), ("many", 1): points(("c", "c1"), ("d", "c2")),
    })
    got = X.summary_points(shown_sections(spark, runs), requests, generator, "{item_count}|{topic}|{chunk_info}").collect()
    text = {run: [r.item.punto_clave for r in sorted((r for r in got if r.run_id == run), key=lambda r: r.item_idx)] for run in runs}
    assert text["grows"] == ["One point", "Two"] and text["dumb"] == [] and text["full"] == ["a", "b", "c"]
    assert text["many"] == ["a", "c"]  # the first of each section before others, two at most
    block = lambda i: f"[c{i}] SECTION: {'ABC'[i]}\nText of {'ABC'[i]}."
    whole = X.SEPARATOR.join(map(block, range(3)))
    assert asked["grows", 0] == (3, f"3|Doc|{whole}") and asked["full", 0] == (3, f"3|Doc|{whole}")
    assert asked["grows", 1] == (2, f"2|Doc|{block(1)}{X.SEPARATOR}{block(2)}{X.UNCOVERED}B, C")
    assert asked["grows", 2] == (1, f"1|Doc|{block(2)}{X.UNCOVERED}C")
    assert asked["many", 1] == (2, f"2|Doc|{block(1)}{X.SEPARATOR}{block(2)}{X.UNCOVERED}B, C")  # enough points, but two sections uncovered
    assert set(asked) == {("grows", 0), ("grows", 1), ("grows", 2), ("dumb", 0), ("full", 0), ("many", 0), ("many", 1)}


def final_items(spark, rows):
    return spark.createDataFrame(rows, "run_id string, gid string, item_idx long, text string, grounded boolean, es_fallback boolean").select(
        "run_id", "gid", "item_idx", X.as_item(F.struct(F.col("text").alias("punto_clave"), F.lit("It matters to every team that works with it.").alias("impacto_negocio"))).alias("item"), "grounded", "es_fallback"
    )


def test_published_summaries_drop_repeats_and_stand_ins(spark):
    first = "The storage engine writes every row to a log before it answers"
    rows = [
        ("r", "g0", 0, first, True, False), ("r", "g1", 1, first + "!", True, False), ("r", "g2", 2, "Indexes are rebuilt at night when few people use the system", False, False),
        ("r", "g3", 3, "Backups are kept for thirty days in another region of the world", True, True), ("s", "h0", 0, "", True, False),
    ]
    records = spark.createDataFrame([("r", "g0", True, "Alta", []), ("r", "g2", True, None, None)], "run_id string, gid string, verified boolean, clarity string, issues array<string>")
    targets = spark.createDataFrame([("r", 5, 6, "es", None, "bien", None), ("s", 5, 6, "en", None, "", None)], "run_id string, target int, requested int, language string, clarity string, observations string, warning string")
    final = X.published(final_items(spark, rows), records, targets, "executive_summary").collect()
    assert [(r.gid, r.nth, r.verified, r.clarity, r.issues) for r in sorted(final, key=lambda r: r.nth)] == [("g0", 0, True, "Alta", []), ("g2", 1, False, "Alta", [X.UNVERIFIED])]
    out = {r.run_id: r for r in X.outcome(X.published(final_items(spark, rows), records, targets, "executive_summary"), targets, "executive_summary").collect()}
    assert (out["r"].generated, out["r"].score, out["r"].minutes, out["r"].observations) == (2, 0.5, 4, "1 de 2 elementos verificados. bien") and out["r"].warning and out["r"].notice is None
    assert out["s"].generated == 0 and out["s"].score == 0 and out["s"].notice and out["s"].warning is None


def test_one_round_of_repair(spark):
    passage = "The storage engine writes every row to a durable log before it answers the client."
    card = lambda front, back: {"frente": front, "dorso": back}
    good, bad = card("What does the storage engine write?", passage), card("What is the moon made of?", "The moon is made of green cheese and nothing else at all.")
    rows = [("r", "g0", 0, good, True, False, False), ("r", "g1", 1, bad, False, False, False), ("r", "g2", 2, bad, False, False, False), ("t", "k0", 0, good, True, False, False)]
    own = [{"chunk_id": "c0", "extracto": "writes every row to a durable log", "seccion": None, "breadcrumb": None, "pagina": None}]
    absent = [own[0] | {"chunk_id": "c9", "extracto": "green cheese from the far side"}]
    items = spark.createDataFrame([(r, g, i, json.dumps(c), json.dumps(absent if g == "g2" else own), a, b, f) for r, g, i, c, a, b, f in rows], "run_id string, gid string, item_idx long, c string, s string, grounded boolean, repaired boolean, es_fallback boolean")
    items = items.select("run_id", "gid", "item_idx", F.from_json("c", X.ITEM).alias("item"), F.from_json("s", f"array<{X.SOURCE}>").alias("fuentes"), "grounded", "repaired", "es_fallback")
    records = spark.createDataFrame([("r", "g0", True, "Alta", []), ("r", "g1", False, "Alta", ["Off topic."]), ("t", "k0", True, "Alta", [])], "run_id string, gid string, verified boolean, clarity string, issues array<string>")
    passages = spark.createDataFrame([("r", "c0", passage, 0), ("t", "c0", passage, 0)], "run_id string, chunk_id string, content string, nth int")
    targets = spark.createDataFrame([("r", 2), ("t", 1)], "run_id string, target int")
    topics = spark.createDataFrame([("r", 0, "Storage", passage, "c0", None)], "run_id string, topic_no int, topic string, context string, chunk_id string, page int")
    mended = json.dumps([{"item_index": 1, **card("What happens before the engine answers?", passage)}])
    generator, asked = answering(spark, {("r", 0): mended})
    critic = lambda again: again.select("run_id", "gid", F.col("grounded").alias("verified"), F.lit("Alta").alias("clarity"), F.array().cast("array<string>").alias("issues"))
    kept, renewed = X.repaired(items, records, passages, passages, targets, topics, generator, critic, "flashcards", language="English")
    prompt = json.loads(asked["r", 0][1])
    assert set(asked) == {("r", 0)} and asked["r", 0][0] == 2 and [p["item_index"] for p in prompt] == [1, 2]
    assert prompt[0]["issues_detected"] == [X.UNGROUNDED, "Off topic."] and prompt[1]["issues_detected"] == [X.UNGROUNDED] and prompt[0]["cited_source_context"][0]["chunk_id"] == "c0"
    got = {(r.run_id, r.gid): r for r in kept.collect()}
    assert set(got) == {("r", "g0"), ("r", "g1"), ("t", "k0")}  # what stays unverified goes
    assert got["r", "g1"].repaired and got["r", "g1"].grounded and got["r", "g1"].item.dorso == passage and got["r", "g1"].fuentes[0].chunk_id == "c0"
    assert {(r.run_id, r.gid): r.verified for r in renewed.collect()} == {("r", "g0"): True, ("r", "g1"): True, ("t", "k0"): True}
