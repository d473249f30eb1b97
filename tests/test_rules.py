"""Literal cases of the operators."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstone.functions import labels as L
from quillstone.functions import noise as N
from quillstone.functions import text as T
from quillstone.operators import chunking as C
from quillstone.operators import cleaning, dedup, grounding, items, limits, planning, sections, summary
from quillstone.operators import noise as noise_filter


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("size,overlap", [(300, 60), (160, 40)])
def test_packed_chunks_keep_size_and_overlap(size, overlap):
    text = "\n\n".join(" ".join(f"w{p}x{i}" for i in range(18)) for p in range(12))
    chunks = C.chunk_text(text, size, overlap)
    assert len(chunks) >= 3 and all(len(c) <= size for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        shared = max(k for k in range(len(b) + 1) if a.replace("\n\n", " ").endswith(b.replace("\n\n", " ")[:k]) or k == 0)
        assert shared >= 0.6 * overlap
    assert {w for c in chunks for w in c.split()} == set(text.split())


def test_character_windows():
    assert [len(x) for x in C.split_characters("A" * 300, 150, 10)] == [150, 150, 20, 10]
    words = " ".join(f"w{i:02d}" for i in range(30))
    pieces = C.split_characters(words, 50, 12)
    assert len(pieces) == 4 and pieces[-1] == "w27 w28 w29"


def test_children_refer_to_parents(spark):
    s = spark.createDataFrame([("d", 0, "T", 1, None, "A" * 300)], "document_id string, section_index int, title string, level int, page_number int, content string")
    parents = C.parents(s, size=150, overlap=10)
    children = C.children(parents, size=50, overlap=50)
    ids = {r.parent_id for r in parents.collect()}
    got = children.collect()
    assert {r.parent_id for r in got} <= ids and len(got) > len(ids)


def test_token_estimate(spark):
    df = spark.createDataFrame([("1234",), ("12345678",)], "t string")
    assert df.agg(F.sum(T.token_estimate(F.col("t")))).first()[0] == 3


@pytest.mark.parametrize("weights,target,expected", [([600, 300, 100], 10, [6, 3, 1]), ([500, 300, 200], 7, [4, 2, 1]), ([1] * 5, 3, [1] * 5)])
def test_allocation(spark, weights, target, expected):
    df = spark.createDataFrame([("d", i, w) for i, w in enumerate(weights)], "document_id string, section_no int, weight long")
    got = planning.allocate(df, target).orderBy("section_no").collect()
    assert [r.allocated_items for r in got] == expected


def verdict(spark, extract, claim, passage, strict=False):
    c = grounding.verdict(F.lit(extract), F.lit(claim), F.lit(claim), F.lit(passage), strict)
    return spark.range(1).select(c).first()[0]


def test_grounding_gates(spark):
    assert verdict(spark, "", "5 nodes store the rows safely", "nodes store rows safely in 12 places")
    assert not verdict(spark, "", "5 nodes store the rows safely", "nodes store rows safely everywhere")
    assert not verdict(spark, "", "5 nodes store the rows safely", "nodes store rows safely in 12 places", strict=True)
    assert verdict(spark, "", "takes 2.5 seconds always", "always takes 7.5 seconds")
    assert not verdict(spark, "", "takes 2.5 seconds always", "always takes 7.1 seconds")
    assert verdict(spark, "rows are stored", "99 rows never", "the rows are stored here")
    assert not verdict(spark, "", "there is no cache here", "there is a cache here")


def test_items_without_sources_are_not_grounded(spark):
    i = spark.createDataFrame([("r", "g")], "run_id string, gid string")
    v = spark.createDataFrame([], "run_id string, gid string, chunk_id string, verified boolean")
    assert grounding.grounded(i, v).first().grounded is False


@pytest.mark.parametrize("ok,n,expected", [(5, 7, 0.71), (1, 8, 0.12), (3, 8, 0.38)])
def test_score_rounds_half_to_even(spark, ok, n, expected):
    df = spark.createDataFrame([("r", i < ok) for i in range(n)], "run_id string, verified boolean")
    assert grounding.score(df).first().score == expected


def test_greedy_dedup_is_first_wins():
    a = "What does the planner decide about every section of a document"
    assert dedup.greedy_unique([a, a + "?", "cache stores rows", "index stores rows"]) == [True, False, True, True]
    assert dedup.greedy_unique(["", ""]) == [True, False]


def test_ratio_bound_is_sound():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(2))
        assert dedup.ratio(a, b) <= dedup.ratio_bound(len(a), len(b)) + 1e-12


def test_repeated_lines(spark):
    rows = [("d", p, f"HEADER\nbody {p}" + ("\nonce" if p == 1 else "")) for p in range(5)]
    got = cleaning.remove_repeated_lines(spark.createDataFrame(rows, "document_id string, page_number int, text string")).orderBy("page_number").collect()
    assert [r.text for r in got] == ["body 0", "body 1\nonce", "body 2", "body 3", "body 4"]
    two = spark.createDataFrame(rows[:2], "document_id string, page_number int, text string")
    assert {r.text for r in cleaning.remove_repeated_lines(two).collect()} == {r[2] for r in rows[:2]}


@pytest.mark.parametrize("line,gone", [("Página 5 de 100", True), ("- 7 -", True), ("53 de 363", True), ("[PÁGINA 5]", False)])
def test_page_number_lines(spark, line, gone):
    assert one(spark, T.is_page_number_line(F.col("t")), t=line) is gone


@pytest.mark.parametrize("text,expected", [("**bold**", "bold"), ("PART_NUMBER_A1", "PART_NUMBER_A1"), ("a * b * c", "a * b * c"), ("> 80°C", "> 80°C"), ("> quote", "quote"), ("`*x*` and *y*", "*x* and y")])
def test_markdown_markers(spark, text, expected):
    assert one(spark, T.strip_markdown_markers(F.col("t")), t=text) == expected


def test_cleaning_keeps_code_and_is_idempotent(spark):
    text = "exam-\nple  of   text\nPágina 3\n```\nkeep   this\n7 de 9\n```\nlast  line"
    once = one(spark, T.clean_text(F.col("t")), t=text)
    assert once == "example of text\n```\nkeep   this\n7 de 9\n```\nlast line"
    assert one(spark, T.clean_text(F.col("t")), t=once) == once


def category(spark, title, content):
    df = spark.createDataFrame([(title, content)], "title string, content string")
    return df.select(N.category(F.col("title"), F.col("content"))).first()[0]


def test_noise_classes(spark):
    toc = "One ........ 1\nTwo ........ 2\nThree ....... 3\nsome words\nmore words"
    assert category(spark, "Part one of it", toc) == "index_lists"
    assert category(spark, "Capítulo 3", "ten chars.") == "near_empty"
    assert category(spark, "Capítulo 3", "Advertencia: hot") is None
    assert category(spark, "ÍNDICE", "x" * 100) == "index_lists"
    assert category(spark, "Far reach", "y " * 100) is None
    assert category(spark, "x", " \n ") is None


def test_noise_safeguards(spark):
    rows = [("d", i, "Copyright" if i < 2 else "Body of it", "z" * 50) for i in range(4)]
    df = spark.createDataFrame(rows, "document_id string, section_index int, title string, content string")
    assert noise_filter.filter_sections(df).count() == 4  # half of the characters
    more = df.union(spark.createDataFrame([("d", 4, "Body of it", "z" * 500)], df.schema))
    assert noise_filter.filter_sections(more).count() == 3


def test_headings():
    got = list(sections.markdown_sections("intro\n# A\ntext\n## B\n### C\nmore\n# D"))
    assert [(s[1], s[2], s[3]) for s in got] == [(None, 0, "intro"), ("A", 1, "text"), ("A > B", 2, ""), ("A > B > C", 3, "more"), ("D", 1, "")]
    got = list(sections.text_sections("1. First\nbody one\n1.2 Second\nbody two\nEMPTY HEADING\nCAPITALS\nbody three"))
    assert [(s[1], s[2]) for s in got] == [("1. First", 1), ("1. First > 1.2 Second", 2), ("CAPITALS", 1)]


def test_references_are_numbered_by_first_appearance(spark):
    rows = [("r", 0, 1, "Alpha", [1]), ("r", 0, 2, "Beta", [2, 3, 2]), ("r", 1, 1, " beta. ", [3, 2]), ("r", 2, 1, "", None)]
    numbered = summary.numbered_references(spark.createDataFrame(rows, "run_id string, item_idx int, source_no int, section string, pages array<int>"))
    assert {r.item_idx: r.markers for r in summary.markers(numbered).collect()} == {0: "[1][2]", 1: "[2]"}
    assert sorted(r.line for r in summary.reference_lines(numbered, "en").collect()) == ["[1] Alpha (p. 1)", "[2] Beta (p. 2, p. 3)"]


@pytest.mark.parametrize("days,colour", [(8, "green"), (7, "amber"), (4, "amber"), (3, "red"), (1, "red"), (0, "today")])
def test_days_left(spark, days, colour):
    assert one(spark, L.days_left_status(F.col("d")), d=days) == colour


@pytest.mark.parametrize("percent,seal", [(90, "excelente"), (75, "alta"), (60, "media"), (59, "baja")])
def test_seals(spark, percent, seal):
    assert one(spark, L.trust_seal(F.col("p")), p=percent) == seal


def test_language_purity(spark):
    assert one(spark, T.is_language_pure(F.col("t")), t="the cache of the node es el") is False
    assert one(spark, T.is_language_pure(F.col("t")), t="the of is") is True


def test_garbage(spark):
    df = spark.createDataFrame([Row(item=Row(frente="Hola", dorso="Mundo")), Row(item=Row(frente="What is a plan of it", dorso="A tree of operators")), Row(item=Row(frente="", dorso="x"))])
    out = items.item_texts(df)
    assert [r[0] for r in out.select(items.is_garbage(out)).collect()] == [True, False, True]


def test_sliding_limiter():
    s = limits.SlidingLimiter(requests=2, tokens=100, per_day=5)
    assert s.reserve(0, 1, 10) and s.reserve(1, 1, 10) and not s.reserve(2, 1, 10)
    assert s.wait(2, 1, 10) == 0 + 60 - 2 + limits.MARGIN_S
    assert math.isinf(s.wait(2, 1, 1000)) and s.reserve(61, 1, 10)
    assert limits.admitted([0, 1, 2, 3, 4, 5, 60, 61]) == [True] * 5 + [False] + [True, True]


def test_stores(spark, tmp_path):
    from quillstone.sources.store import ObjectStore

    store = ObjectStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a/1", bytearray(b"x"), "t"), ("../b", bytearray(b"y"), "t")], "object_key string, content binary, content_type string")
    assert {r.action: r.n for r in store.put(rows).collect()} == {"upload": 1, "refuse": 1}
    assert {r.action for r in store.put(rows).collect()} == {"skip", "refuse"}
    assert bytes(store.get(rows).first().content) == b"x"
    store.delete(rows)
    assert store.manifest().count() == 0 and store.get(rows).count() == 0


def test_files(spark, tmp_path):
    from quillstone.sources import files

    (tmp_path / "a.md").write_text("# T\nbody")
    (tmp_path / "b.exe").write_text("no")
    assert {r.fault for r in files.files(spark, str(tmp_path)).collect()} == {None, "extension"}
    assert files.texts(spark, str(tmp_path)).first().text == "# T\nbody"


def test_output_similarity_equals_brute_force_for_every_run(spark):
    from collections import defaultdict
    from itertools import combinations
    from types import SimpleNamespace

    from quillstone.operators.dedup import ratio
    from quillstone.plans import quality

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    extra = [(10**9, i, "user", f"text number {i % 7} of {i}") for i in range(60)] + [(10**9 + 1, 0, "user", "alone")]
    turns = turns.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    runs = defaultdict(list)
    for r in turns.collect():
        runs[r.conv_id].append((r.turn, r.text or ""))
    got = {r.run_id: r for r in quality.output_similarity(SimpleNamespace(conversations=turns)).collect()}
    assert len(runs) > 20 and set(got) == set(runs)
    for run, outputs in runs.items():
        want = [ratio(x[1], y[1]) for x, y in combinations(sorted(outputs), 2)]
        assert got[run].over_limit == sum(w > 0.7 for w in want)
        if want:
            assert abs(got[run].average - sum(want) / len(want)) < 1e-5 and abs(got[run].maximum - max(want)) < 1e-5
        else:
            assert got[run].average is None
