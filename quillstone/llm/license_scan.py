"""License scans by a positional rare-token index, in DataFrame operations only: one pass, no shuffle.

The index holds, for every word of the license templates, its postings (template, position) and its inverse document
frequency over the templates. A template has postings for its own ``RAREST`` words of highest IDF, and a file is looked up by all
of these words that it holds, at all their places, so no notice crowds out another one. Each place meets the word's postings; the
difference of the two positions says where the template would begin in the file. Sorted by template and difference, matches whose
differences lie within ``DRIFT`` words of each other belong to one alignment, and its weight is the sum of
the IDF of its matched posting positions. A template whose best alignment carries ``SHARE`` of the weight of all its postings is a
candidate, and is found if one of its mandatory key phrases stands in the file, word by word; phrases are looked for last, and only
those of candidates.

Base labels come from exact phrases, at all their places; the method adds labels of its own.

Defined cases: a null text counts as empty: no words, no labels, score 0; rows are judged one by one, so repeated rows
and ids, ties and other columns of any name change nothing; an empty table gives an empty result; texts of any length
are scanned whole.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAREST, DRIFT, SHARE = 24, 3, 0.6
#: Postings of one template at most: a bit each in a long.
MOST_POSTINGS = 62

FUNCTION_WORDS = "a an and any are as at be by for from in is it may not of on or so that the this to was were will with you".split()

#: label -> phrase; fixed by the query's contract.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: name -> (notice as it stands in files, mandatory key phrases of which one must stand in the file). A name is a label
#: and, after a colon, the form of the notice.
TEMPLATES: dict[str, tuple[str, list[str]]] = {
    "mit:short": ("released under the mit license", ["under the mit license", "licensed under mit"]),
    "apache-2:short": ("licensed under the apache license version 2 0", ["apache license version 2"]),
    "gpl:short": ("this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    "lgpl:short": ("licensed under the gnu lesser general public license version 3", ["gnu lesser general public license"]),
    "mpl-2:short": ("licensed under the mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    "cc-by-nc:short": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa:short": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "bsd:short": ("licensed under the bsd 3 clause license", ["the bsd 3 clause license", "the bsd 2 clause license"]),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "deal in the software without restriction"],
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0",
        ["apache license version 2", "apache org licenses license 2 0"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee is hereby granted"],
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu general public license"],
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation either version 2 1 of the license or at your option any later version",
        ["gnu lesser general public license"],
    ),
    "agpl": ("released under the gnu affero general public license version 3 as published by the free software foundation", ["gnu affero general public license"]),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
        "file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license v 2 0", "mozilla public license version 2 0"],
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0", "creative commons attribution 3 0"]),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike", "creative commons attribution share alike"]),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial", "creative commons attribution non commercial"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal public domain dedication", ["cc0 1 0 universal", "waived all copyright and related or neighboring rights"]),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["free and unencumbered software released into the public domain"]),
    "proprietary": ("all rights reserved unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", ["strictly prohibited proprietary and confidential", "all rights reserved unauthorized copying"]),
}


class PositionalIndex:
    """Postings and IDF of the words of all templates, and each template's weight under its own rarest words."""

    def __init__(self, templates: dict[str, tuple[str, list[str]]], rarest: int = RAREST):
        self.labels = list(templates)
        words = [templates[t][0].split() for t in self.labels]
        holders: dict[str, set[int]] = {}
        for t, ws in enumerate(words):
            for w in ws:
                holders.setdefault(w, set()).add(t)
        self.idf = {w: round(math.log(1 + len(words) / len(h)), 6) for w, h in holders.items()}
        for w in FUNCTION_WORDS:  # stand everywhere in files: no way to find a license by them
            self.idf.pop(w, None)
        self.postings: dict[str, list[tuple[int, int, int]]] = {}  # template, position, number of the posting in its template
        self.weight = []
        for t, ws in enumerate(words):
            own = sorted(set(ws) & set(self.idf), key=lambda w: (-self.idf[w], w))[:rarest]
            places = [(w, p) for p, w in enumerate(ws) if w in own][:MOST_POSTINGS]
            for n, (w, p) in enumerate(places):
                self.postings.setdefault(w, []).append((t, p, n))
            self.weight.append(sum(self.idf[w] for w, _ in places))
        self.phrases = [templates[t][1] for t in self.labels]


@lru_cache(1)
def default_index() -> PositionalIndex:
    return PositionalIndex(TEMPLATES)


def lowered(text: Column) -> Column:
    """A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _anchor(phrase: str, index: PositionalIndex) -> int:
    """The number of the phrase's rarest word."""
    return max(range(len(parts := phrase.split())), key=lambda j: (index.idf.get(parts[j], 0.0), -j))


def _starts(words: Column, hits: Column, phrase: str, at: int) -> Column:
    """Positions where the words of a phrase stand one after the other, from the places of its word number ``at``."""
    parts = phrase.split()

    def here(i):
        out = i >= 0
        for j, w in enumerate(parts):
            out = out & (F.get(words, i + j) == w)
        return out

    return F.filter(F.transform(F.filter(hits, lambda h: h["w"] == parts[at]), lambda h: h["i"] - at), here)


def _behind_a_barrier(rows: DataFrame, *names: str, **columns: Column) -> DataFrame:
    """Named columns and new ones, as rows of a generator: later filters and projections don't copy the expressions."""
    return rows.select(*names, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, index: PositionalIndex | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``; all if None), n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = index or default_index()
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.regexp_extract_all(lowered(text_of(docs, text)), F.lit(f"({WORD})"), F.lit(1)).alias("w"))

    # the places of rare words
    anchors = {label: _anchor(p, index) for label, p in BASE.items()}
    rare = sorted({*index.postings, *[BASE[label].split()[j] for label, j in anchors.items()]})
    no_hits = F.array().cast("array<struct<w:string,i:int>>")
    places = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(rare))
    rows = rows.withColumn("hits", F.when(F.arrays_overlap("w", F.array(*map(F.lit, rare))), places).otherwise(no_hits))
    rows = _behind_a_barrier(rows, "row", w=F.col("w"), hits=F.coalesce("hits", no_hits))

    # base places, and the postings of all places in order of template and difference
    literal = F.from_json(F.lit(_as_json(index)), "map<string,struct<idf:double,posts:array<struct<t:int,p:int,n:int>>>>")
    rows = rows.withColumn("index", literal)
    found = F.transform("hits", lambda h: F.struct(h["i"].alias("i"), F.try_element_at("index", h["w"]).alias("e")))
    none = F.array().cast("array<struct<t:int,o:int,n:int,idf:double>>")
    matches = F.flatten(
        F.transform(found, lambda h: F.coalesce(F.transform(h["e"]["posts"], lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"), p["n"].alias("n"), h["e"]["idf"].alias("idf"))), none))
    )
    rows = rows.withColumn("best", F.when(F.size("hits") > 0, _alignments(F.array_sort(matches))))
    weights = F.array(*map(F.lit, index.weight))
    strong = F.filter("best", lambda b: b["top"] >= SHARE * F.get(weights, b["t"]))
    bases = [F.struct(F.lit(label).alias("label"), _starts(F.col("w"), F.col("hits"), p, anchors[label]).alias("at")) for label, p in BASE.items()]
    rows = _behind_a_barrier(rows, "row", w=F.col("w"), strong=strong, base=F.when(F.size("hits") > 0, F.filter(F.array(*bases), lambda b: F.size(b["at"]) > 0)))

    # key phrases of the candidates
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    rows = rows.withColumn("joined", F.when(F.size("strong") > 0, joined))
    phrases = F.array(*[F.array(*[F.lit(f" {p} ") for p in ps]) for ps in index.phrases])
    verified = F.filter("strong", lambda b: F.exists(F.get(phrases, b["t"]), lambda p: F.col("joined").contains(p)))
    labels = F.array(*[F.lit(label.split(":")[0]) for label in index.labels])
    extra = F.transform(verified, lambda b: F.struct(F.get(labels, b["t"]).alias("label"), F.least(F.lit(1.0), b["top"] / F.get(weights, b["t"])).alias("s")))
    rows = _behind_a_barrier(
        rows, "row", n_words=F.size("w").cast("long"), places=F.flatten(F.transform("base", lambda b: b["at"])), names=F.transform("base", lambda b: b["label"]), extra=F.when(F.size("strong") > 0, extra)
    )
    no_names = F.array().cast("array<string>")
    names, more = F.coalesce("names", no_names), F.coalesce(F.transform("extra", lambda v: v["label"]), no_names)
    best = F.coalesce(F.array_max(F.transform("extra", lambda v: v["s"])), F.lit(0.0))
    return _behind_a_barrier(
        rows,
        "row",
        n_words=F.col("n_words"),
        n_base=F.coalesce(F.size("places"), F.lit(0)).cast("long"),
        first_word=F.array_min("places").cast("long"),
        last_word=F.array_max("places").cast("long"),
        base_labels=F.array_join(F.array_sort(F.array_distinct(names)), ","),
        labels=F.array_join(F.array_sort(F.array_distinct(F.concat(names, more))), ","),
        score=F.when(F.size(names) > 0, F.lit(1.0)).otherwise(best),
    )


def _as_json(index: PositionalIndex) -> str:
    import json

    return json.dumps({w: {"idf": index.idf[w], "posts": [{"t": t, "p": p, "n": n} for t, p, n in ps]} for w, ps in index.postings.items()})


def _alignments(matches: Column) -> Column:
    """(t, top): each template met, with the weight of its best alignment; from matches sorted by template and difference.

    One fold: an alignment ends where the template changes or the difference jumps, and only then is anything appended.
    """
    template = "struct<t:int,top:double>"
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"), F.array().cast(f"array<{template}>").alias("done"))
    closed = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["t"].alias("t"), acc["top"].alias("top"))))

    def step(acc, m):
        new = acc["t"] != m["t"]
        joins = ~new & (m["o"] - acc["o"] <= DRIFT)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), m["n"])
        again = joins & (acc["seen"].bitwiseAND(bit) != 0)
        total = F.when(again, acc["sum"]).when(joins, acc["sum"] + m["idf"]).otherwise(m["idf"])
        seen = F.when(joins, acc["seen"].bitwiseOR(bit)).otherwise(bit)
        top = F.when(new, total).otherwise(F.greatest(acc["top"], total))
        return F.struct(m["t"].alias("t"), m["o"].alias("o"), seen.alias("seen"), total.alias("sum"), top.alias("top"), F.when(new & (acc["t"] >= 0), closed(acc)).otherwise(acc["done"]).alias("done"))

    return F.aggregate(matches, start, step, lambda acc: F.when(acc["t"] < 0, acc["done"]).otherwise(closed(acc)))
