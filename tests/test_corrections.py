"""Literal cases of sections, chunks, keys, waits, citations and grounding."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import labels as L
from quillstone.functions import text as T
from quillstone.operators import chunking as C
from quillstone.operators import citations, grounding, sections, summary


def value(spark, column, **fields):
    row = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in fields.items()))
    return row.select(column).first()[0]


def test_titles_of_text_sections_are_paths():
    text = "1) Uno\nalfa\n1.2. Dos\nbeta\nCapítulo\ngamma\nCapítulo tres\ndelta"
    assert [s[1:4] for s in sections.text_sections(text)] == [("1) Uno", 1, "alfa"), ("1) Uno > 1.2. Dos", 2, "beta\nCapítulo\ngamma"), ("Capítulo tres", 1, "delta")]
    assert list(sections.text_sections("")) == [(0, None, 0, "", None)]


def test_pages_have_no_title_and_a_text_without_marks_is_one(spark):
    df = spark.createDataFrame([("a", "[PÁGINA 1]\nuno\n[PÁGINA 2]\n \n[PÁGINA 3]\ntres"), ("b", " plain ")], "document_id string, text string")
    got = sorted(tuple(r) for r in sections.parse_pages(df).collect())
    assert got == [("a", 0, None, 0, "uno", 1), ("a", 1, None, 0, "tres", 3), ("b", 0, None, 0, "plain", None)]


def test_windows_begin_behind_white_space():
    assert C.split_characters("aaaa bbbb cccc dddd", 10, 3) == ["aaaa bbbb", "cccc dddd", "ddd"]
    assert C.split_characters("ab cd", 10, 0) == ["ab cd"]


def test_oversized_paragraphs_slide_with_full_size_and_overlap():
    long = " ".join(f"w{i:03d}" for i in range(60))
    got = C.chunk_text("short one\n\n" + long + "\n\nend", 60, 10)
    windows = C.split_characters(long, 60, 10)
    assert got[0] == "short one" and got[2 : len(windows) + 1] == windows[1:] and got[1].endswith(windows[0])
    assert got[-1].endswith("end") and all(len(x) <= 60 for x in got)


@pytest.mark.parametrize("message,code,limited,wait", [("429 retry in 7.5s", None, True, 8.5), ("retryDelay: 200s, RESOURCE_EXHAUSTED", None, True, 90.0), ("quota", 429, True, 60.0), ("retry in 9s", None, False, 5.0), ("code 1429", None, False, 5.0)])
def test_waits_after_errors(spark, message, code, limited, wait):
    row = spark.createDataFrame([(message, code)], "m string, c int").select(L.is_rate_limit(F.col("m"), F.col("c")), L.retry_wait(F.col("m"), F.col("c"))).first()
    assert tuple(row) == (limited, wait)


def test_keys_and_quantities(spark):
    assert value(spark, T.safe_filename(F.col("n")), n="../a b/Guía..v2.pdf") == "Gu_a.v2.pdf"
    assert value(spark, T.safe_filename(F.col("n")), n="...") == "documento_fuente"
    assert value(spark, T.label_slug(F.col("n"), 10), n="¡Título  ñandú 東京!") == "titulo-nan"
    key = T.content_key(F.col("u"), F.lit("id 1"), F.lit(None), F.lit(""), F.lit(None), F.lit("2024-05-06").cast("date"), F.lit(2))
    assert value(spark, key, u="@") == "usuarios/anonimo/contenidos/id_1/v2.json"
    assert value(spark, L.level_quantity(F.lit("quiz"), F.col("l")), l="nothing") == 20 and value(spark, L.level_quantity(F.col("f"), F.lit("breve")), f="none") == 20
    assert [value(spark, L.is_uuid(F.col("u")), u=u) for u in ("{12345678-1234-5678-1234-567812345678}", "12345678123456781234567812345678", "12345678", "g" * 32)] == [True, True, False, False]


def test_broken_ligatures_are_repaired(spark):
    assert value(spark, T.normalize_characters(F.col("t")), t="La conguración y la Deqnición; qgura, figurado") == "La configuración y la definición; figura, figurado"


def test_only_the_point_of_a_summary_is_capitalised(spark):
    row = spark.createDataFrame([("el punto..", "su efecto")], "punto_clave string, impacto_negocio string")
    assert row.select(summary.paragraph(row)).first()[0] == "El punto. su efecto."


def test_later_passages_and_children_win_a_name(spark):
    rows = [("r", "a_1", "first", 0), ("r", "a_2", "second", 1), ("r", "p_child_3", "child", 2), ("r", "p", "own", 3), ("r", "q", "own", 4), ("r", "q_child_1", "child", 5), ("r", "chunk_10", "ten", 6), ("r", "chunk_2", "two", 7)]
    got = {r.alias: r.content for r in grounding.aliases(spark.createDataFrame(rows, "run_id string, chunk_id string, content string, n int"), order="n").collect()}
    assert (got["a"], got["p"], got["q"], got["chunk"], got["a_2"]) == ("first", "own", "child", "ten", "second")


def test_nearest_passage_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    pool = [f"word{i}" for i in range(40)]
    items = [(rng.choice("rs"), f"g{i}", " ".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(60)]
    passages = [(rng.choice("rs"), f"c{i}", " ".join([*(rng.choice(pool) for _ in range(rng.randrange(14))), "common"]), i) for i in range(60)]
    want = {}
    for run, key, text in items:
        ws = set(text.split())
        scored = [(-len(ws & set(c.split())), n, c) for r, _, c, n in passages if r == run and ws and len(ws & set(c.split())) >= 0.25 * len(ws)]
        if scored:
            want[key] = min(scored)[2]
    got = grounding.best_overlap(spark.createDataFrame(items, "run_id string, gid string, grounding_text string"), spark.createDataFrame(passages, "run_id string, chunk_id string, content string, n int"), order="n")
    assert {r.gid: r.content for r in got.collect()} == want


def test_citations(spark):
    excerpts = spark.createDataFrame([("r", "c1", "A", 0, "A > x", 1), ("r", "c1", "B", 4, "B", 2), ("r", "c2", "C", 2, "C", 3), ("r", "c3", " ", 1, "", 4)], "run_id string, chunk_id string, section string, page int, breadcrumb string, nth int")
    sources = spark.createDataFrame([("r", 1, "c1", "Z", 0, ""), ("r", 1, "c9", "Z", 7, "own"), ("r", 2, None, None, None, None)], "run_id string, item_idx int, chunk_id string, section string, page int, breadcrumb string")
    items = spark.createDataFrame([("r", i) for i in (1, 2, 3)], "run_id string, item_idx int")
    assert {r.item_idx: r.sections for r in citations.section_keys(items, sources, excerpts).collect()} == {1: ["B", "Z"], 2: ["__sin_fuente__"], 3: ["__sin_fuente__"]}
    assert [(r.section, r.nth) for r in citations.pending_sections(sources, excerpts).orderBy("nth").collect()] == [("A", 1), ("C", 2)]
    full = {(r.item_idx, r.chunk_id): (r.page, r.section, r.breadcrumb) for r in citations.enriched(sources, excerpts).collect()}
    assert full == {(1, "c1"): (None, "Z", "A > x"), (1, "c9"): (7, "Z", "own"), (2, None): (None, None, None)}
