"""Key concepts of sections: one- and two-word phrases nearest to the section's own vector."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
MOST_CONCEPTS, LONGER_THAN = 4, 50
WORDS = r"\w\w+"
# ----------------------------------------------------------------------------------------------------------------
DIMENSION, BLOCK = 256, 4096


def phrases(text: str) -> list[str]:
    """Distinct words of two signs or more and pairs of such words, in lower case, in alphabetical order."""
    words = re.findall(WORDS, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def hashed_vectors(texts: list[str], dimension: int = DIMENSION):
    """A stand-in for a model: each word adds one, or takes it away, at a coordinate; all by the word's MD5."""
    import numpy as np

    spots: dict[str, tuple[int, int]] = {}
    out = np.zeros((len(texts), dimension))
    for row, text in zip(out, texts):
        for w in re.findall(WORDS, text.lower()):
            if w not in spots:
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                spots[w] = (h // 2 % dimension, 1 if h % 2 else -1)
            i, s = spots[w]
            row[i] += s
    return out


def _unit(m):
    import numpy as np

    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def chosen(text: str, embed: Callable = hashed_vectors, most: int = MOST_CONCEPTS, diversity: float = 0.0, longer_than: int = LONGER_THAN) -> list[tuple[str, float]]:
    """The ``most`` phrases of highest cosine with the text, or, with a diversity, each next one by maximal marginal relevance.

    Cosines are rounded to six digits, ties go to the phrase that is first in alphabetical order. With a diversity, the phrases are taken from the
    ``4 * most`` nearest ones.
    """
    import numpy as np

    if len(text) <= longer_than:
        return []
    names = phrases(text)
    if not names:
        return []
    whole = _unit(embed([text]))[0]
    near = np.concatenate([np.round(_unit(embed(names[a : a + BLOCK])) @ whole, 6) for a in range(0, len(names), BLOCK)])
    order = np.lexsort((np.arange(len(names)), -near))
    if diversity <= 0:
        return [(names[i], float(near[i])) for i in order[:most]]
    pool = order[: 4 * most]
    unit = _unit(embed([names[i] for i in pool]))
    alike = np.round(unit @ unit.T, 6)
    taken = [0]
    while len(taken) < min(most, len(pool)):
        rest = [j for j in range(len(pool)) if j not in taken]
        gain = [round(float((1 - diversity) * near[pool[j]] - diversity * alike[j, taken].max()), 6) for j in rest]
        taken.append(min(zip((-g for g in gain), (names[pool[j]] for j in rest), rest))[2])
    return [(names[pool[j]], float(near[pool[j]])) for j in taken]


def key_concepts(sections: DataFrame, id_col: str = "doc_id", text: str = "text", embed: Callable = hashed_vectors, most: int = MOST_CONCEPTS, diversity: float = 0.0) -> DataFrame:
    """(id, nth from 1, concept, score): up to four concepts of each section of more than 50 signs; others have none.

    ``embed`` maps a list of texts to an array of vectors, in Python beside the data. A section whose embedding fails raises; null texts
    have no concepts.
    """
    kind = sections.schema[id_col].dataType.simpleString()

    def task(frames):
        import pandas as pd

        for frame in frames:
            rows = [(i, n, c, s) for i, t in zip(frame["id"], frame["text"]) for n, (c, s) in enumerate(chosen(t, embed, most, diversity), 1)]
            yield pd.DataFrame(rows, columns=["id", "nth", "concept", "score"])

    long = sections.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.length("text") > LONGER_THAN)
    return long.mapInPandas(task, f"id {kind}, nth long, concept string, score double").withColumnRenamed("id", id_col)
