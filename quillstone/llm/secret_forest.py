"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame operations only.

Candidates are stretches of 16 and more key-like characters with a digit, and quoted or bare values of 8 and more
characters after a credential word and ``=`` or ``:``. The text between candidates gives the neighbouring words; a
path column (where the document comes from) gives the path. The forest sees the candidate's length, the transitions
between character classes, shares of classes, the share of distinct characters, how much of it dictionary words cover,
the path and the neighbouring words. It is trained on a small table of labelled findings made by :func:`findings`.

One row for each candidate: its place (code points, end exclusive), the probability, the verdict; never the value itself.

Defined cases: a null text has no candidate; a null path counts as empty; each of repeated rows gives its own
candidates; texts without candidates give no row; an empty table gives an empty result; other columns pass
inside ``row``.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

CREDENTIAL = r"(?i:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
KEY = "[A-Za-z0-9_+/=-]"
ASSIGNED = rf"{CREDENTIAL}[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?"
VALUE = "[A-Za-z0-9_+/=!@$%^&*.-]{8,}"
START = rf"(?<!{KEY})(?=[A-Za-z_+/=-]*+[0-9])"
#: Group 1 is what stands before an assigned value. Other stretches end before a credential word with a value of its own.
CANDIDATE = rf"({ASSIGNED}){VALUE}|{START}(?!{KEY}{{0,15}}?{ASSIGNED}{VALUE})(?:{KEY}{{16,}}?(?={ASSIGNED}{VALUE})|{KEY}{{16,}})"
#: A cheap test of whether a text can hold a candidate at all.
NEAR = 60
DICTIONARY = (
    "the and for with this that from test example sample dummy changeme placeholder your key token value data user name file path index "
    "version build release module package class function config default string number object array result image page item"
).split()
HASH_WORDS = r"sha|md5|hash|checksum|commit|digest|uuid|guid|etag|revision|isbn|serial|order|invoice|card|phone|build"
FEATURES = ["length", "transitions", "digits", "uppers", "lowers", "signs", "hexadecimal", "distinct", "dictionary", "test_path", "credential_before", "hash_before", "assigned", "quoted"]


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The forest's view of a candidate."""
    n = F.length(value).cast("double")
    share = lambda p: F.regexp_count(value, F.lit(p)) / n
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    near = F.lower(before)
    return {
        "length": n,
        "transitions": share(change),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        "hexadecimal": flag(value.rlike("^[0-9a-fA-F]+$")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "dictionary": 1.0 - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "test_path": flag(F.lower(path).rlike("test|example|sample|mock|fixture|doc")),
        "credential_before": flag(near.rlike(f"(?:{CREDENTIAL})[^a-z]{{0,4}}[a-z]{{0,8}}[^a-z0-9]{{0,6}}$")),
        "hash_before": flag(near.rlike(f"(?:{HASH_WORDS})[^a-z]{{0,4}}[a-z]{{0,8}}[^a-z0-9]{{0,6}}$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
    }


def findings(n: int = 600, seed: int = 7) -> list[dict]:
    """Labelled findings: secrets of usual forms in usual places, and look-alikes (digests, ids, numbers, paths, slugs)."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, digits = "0123456789abcdef", "0123456789"
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    word = lambda: rng.choice(DICTIONARY)
    good_before = ['token = "', "api_key = '", "secret: ", 'password="', "Authorization: Bearer ", "access_key=", 'auth_token: "', "private key = "]
    bad_before = ["commit ", "sha256: ", 'md5 = "', "checksum=", "order ", "see ", "uuid ", "build: ", "card ", "in the ", "of ", 'etag: "']
    out = []
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            kind = rng.randrange(8)
            value = [
                pick(hexa, rng.choice([32, 40, 64])),
                "AKIA" + pick(b64[:26] + digits, 16),
                "ghp_" + pick(b64[:62], 36),
                pick(b64, rng.choice([24, 32, 40, 44])),
                "sk_live_" + pick(b64[:62], 24),
                pick(b64[26:52], rng.randrange(5, 8)) + pick(digits, rng.randrange(1, 4)) + pick("!@$%^&*", 1) + pick(b64[26:62], rng.randrange(1, 4)),
                pick(b64[:62] + "!@$%^&*", rng.randrange(8, 16)),
                pick(b64[:52], rng.choice([12, 16, 24, 32])),
            ][kind]
            before = rng.choice(good_before)
            if kind in (1, 2, 4) and rng.random() < 0.4:
                before = rng.choice(["in the ", "and ", "use ", ""])
            path = rng.choice(["src/main", "config", "deploy", "src0", "app/settings"])
        else:
            kind = rng.randrange(9)
            value = [
                pick(hexa, rng.choice([32, 40, 64])),
                pick(digits, rng.randrange(16, 22)),
                "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
                "_".join([word(), word(), word(), pick(digits, 2)]),
                "/".join([word(), word(), word(), "v" + pick(digits, 1)]),
                pick("abcdefghijklmnopqrstuvwxyz", 18) + pick(digits, 1),
                "your-" + word() + "-" + word() + "-123",
                "".join(rng.choice(("ing", "ter", "mon", "ado", "per", "ent", "sol", "ver", "al", "tu")) for _ in range(rng.randrange(3, 6))).ljust(8, "s") + rng.choice(["", "", "."]),
                rng.choice(["your-", "my_", "the.", "os.", "self."]) + word() + rng.choice(["-", "_", "."]) + word(),
            ][kind]
            before = rng.choice(good_before if kind in (7, 8) else bad_before + good_before[:3] if kind in (3, 6) else bad_before)
            path = rng.choice(["src/main", "docs", "tests/fixtures", "src0", "examples"])
        quote = before[-1:] if before[-1:] in "\"'" else ""
        out.append({"value": value, "before": before, "after": quote + rng.choice([" ", "\n", ".", ""]), "path": path, "label": 1.0 if secret else 0.0})
    return out


def train(spark: SparkSession, table: list[dict] | None = None, trees: int = 30, depth: int = 7, seed: int = 11):
    """The forest, from labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    schema = "array<struct<value:string,before:string,after:string,path:string,label:double>>"
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table or findings())), schema)))
    seen = rows.select("label", *[c.alias(k) for k, c in features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).items()])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(seen)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(vectors.select("vector", "label"))


def candidates(docs: DataFrame, text: str = "text", path: str | None = "source", keep: list[str] | None = None) -> DataFrame:
    """``row``, place, value and neighbourhood of every candidate."""
    keep = docs.columns if keep is None else keep
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), where.alias("path"), text_of(docs, text).alias("t"))
    rows = rows.filter(F.col("t").rlike(CANDIDATE))
    rows = rows.withColumns({"whole": F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)), "lead": F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(1)), "between": F.split("t", CANDIDATE, -1)})
    values = F.zip_with("whole", "lead", lambda w, p: F.substr(w, F.length(p) + 1))
    between = F.transform("between", lambda b, i: F.concat(b, F.coalesce(F.get("lead", i), F.lit(""))))
    rows = rows.select("row", "path", values.alias("values"), between.alias("between"), F.transform("lead", lambda p: p != "").alias("assigned"))
    lead = F.transform("values", lambda v, i: F.length(F.get(F.col("between"), i)) + F.length(v))
    begin = F.aggregate(
        F.arrays_zip(lead.alias("lead"), F.transform("values", lambda v: F.length(v)).alias("size")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x["lead"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["lead"] - x["size"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    rows = rows.withColumn("starts", begin)
    each = rows.select("row", "path", "between", "starts", "assigned", F.posexplode("values").alias("i", "value"))
    each = each.filter(F.get("assigned", F.col("i")) | F.col("value").rlike("[0-9]"))  # a stretch may have been cut before its digit
    tail, head = F.get("between", F.col("i")), F.get("between", F.col("i") + 1)
    return each.select(
        "row", "path", "value", F.substring(tail, -NEAR, NEAR).alias("before"), F.substring(head, 1, NEAR).alias("after"), F.get("starts", F.col("i")).cast("long").alias("start")
    )


def scan(docs: DataFrame, text: str = "text", path: str | None = "source", keep: list[str] | None = None, threshold: float = 0.5, model=None) -> DataFrame:
    """``row``, start, end, probability, is_secret and sha256 of every candidate."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = model or train(docs.sparkSession)
    found = candidates(docs, text, path, keep)
    seen = found.select("row", "start", "value", *[c.alias(k) for k, c in features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).items()])
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(seen))
    p = F.round(vector_to_array("probability")[1], 6)
    return judged.select("row", "start", (F.col("start") + F.length("value")).alias("end"), p.alias("probability"), (p >= threshold).alias("is_secret"), F.sha2("value", 256).alias("sha256"))
