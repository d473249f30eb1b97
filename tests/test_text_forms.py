"""Titles and search forms: literal cases, and Python's own decomposition."""

import random
import unicodedata

from pyspark.sql import functions as F

from quillstone.functions import text as T


def values(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x"))
    return [r.x for r in sorted(df.collect(), key=lambda r: r.i)]


def test_titles_lose_markdown_unless_told_otherwise(spark):
    titles = ["**Bold** and _thin_", "`code` *x*", "  two\n lines ", "plain", "", None, "snake_case_name", "ﬁrst  __title__"]
    assert values(spark, titles, T.clean_title) == ["Bold and thin", "code x", "two lines", "plain", "", None, "snake_case_name", "first title"]
    assert values(spark, titles[:2], lambda c: T.clean_title(c, strip_markdown=False)) == ["**Bold** and _thin_", "`code` *x*"]


def test_search_forms_are_decompositions_of_all_scripts(spark):
    rng = random.Random(7)
    signs = "aÁñçßŁłǅﬁ①Ⅳ²ｱがйёΆώאָऄกำ한글́ͅ \t\x1f İıſ"
    texts = [None, "", "  MiXed ASCII\n", "\x1c x \x1f", "Ḗḗ ế Ѷ", "Crème Brûlée", "x́y"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    want = ["".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower().strip() for t in texts]
    assert values(spark, texts, T.search_form) == want
