"""MinHash near-dedup with DartMinHash signatures.

Every element (a shingle with a weight) is a strip of the weight-rank plane, and hashed darts fall into the plane at
unit rate. The plane is cut into cells, one stratum of weight by one slice of rank; the hash of (element, stratum,
slice) says how many darts fall into the cell and where. A dart counts if its weight lies below the element's weight.
Darts are hashed to the ``k`` coordinates and each coordinate keeps the dart of lowest rank. Slices are thrown in
ascending rank, so a text is done as soon as all its coordinates are filled, after about ``k ln k`` darts however many
elements it has. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Weight 1 for each distinct shingle (the default) gives plain Jaccard similarity of shingle sets.

Steps of :func:`near_duplicates`, each table written to the shared folder:

1. one pass over the texts: a 128-bit hash of the words, the signature, the number of shingles;
2. exact copies meet by hash (a map-side combined minimum), one representative each goes on;
3. bands of the signature; in each bucket every member is paired with the leaders (the lowest and the highest number,
   again plain aggregates); pairs whose signatures agree too little are dropped (``floor`` lies over four
   standard deviations below the threshold);
4. exact Jaccard similarity of the shingle sets: first each text with its best leader, then, components
   known, every remaining pair between different components;
5. buckets with pairs beside those of the leaders, whose members lie in different components: every pair of such
   members at the threshold shares a shingle among the rarest of both, and parity maps end most of the others
   (:func:`rare_pairs`); each text's nearest is verified first, then all pairs that these links leave in different components;
6. connected components by hooking and pointer jumping, in written tables.

Defined cases: null and empty texts, and texts without any word, are alone in their class; a text of one to four words
has one shingle of all its words; rows are told apart by their words, so different texts that share an id, or have none,
are documents of their own; a class is named by the lowest id in it, null ids sort first; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bounded_batches, materialize, text_of, trimmed

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS
FLOOR = 0.62
BASE_SLICE = 1 / 64
#: Rows of a file of sets, signatures or documents, and of links, at most on average.
FILE_SETS, FILE_LINKS = 5_000, 10_000
#: 64-bit words of a set's parity map.
MAP_WORDS = 16


def _slices():
    """Slices of the rank axis: 1/64, doubling up to 1, then of length 1 for ever."""
    yield 0.0, BASE_SLICE
    at = BASE_SLICE
    while at < 1:
        yield at, at
        at *= 2
    while True:
        yield at, 1.0
        at += 1.0


def _poisson_cdf(area: float) -> np.ndarray:
    p, total, out = math.exp(-area), 0.0, []
    for i in range(int(area + 12 * math.sqrt(area) + 12)):
        total += p
        out.append(total)
        p *= area / (i + 1)
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def _strata(weights: np.ndarray):
    """Strata of the weight axis, [0,1), [1,2), [2,4) ...: (number, start, length, elements that reach into it)."""
    n, start, length = 0, 0.0, 1.0
    while len(at := np.flatnonzero(weights > start)):
        yield n, start, length, at
        n, start, length = n + 1, start + length, max(1.0, start + length)


def signatures(elements: np.ndarray, bounds: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """(texts, k) 64-bit signatures; texts without elements get zeros."""
    texts = len(bounds) - 1
    best = np.full(texts * k, np.inf)
    name = np.zeros(texts * k, np.uint64)
    who = ta.owners(bounds)
    if weights is None:
        parts = [(0, 0.0, 1.0, elements, who, None)]
    else:
        parts = [(n, start, length, elements[at], who[at], weights[at]) for n, start, length, at in _strata(weights)]
    open_ = np.diff(bounds) > 0
    for number, (start, length) in enumerate(_slices()):
        if not open_.any():
            break
        for stratum, low, tall, elem, owner, weight in parts:
            if not len(elem):
                continue
            cell = ta.mix64(elem + np.uint64((number * 0x9E3779B97F4A7C15 + stratum * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64)))
            cdf = _poisson_cdf(length * tall)
            u = _unit(cell)
            hit = np.flatnonzero(u >= cdf[0])
            count = np.searchsorted(cdf, u[hit], side="right")
            hit = np.repeat(hit, count)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
            dart = ta.mix64(cell[hit] ^ (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
            if weight is not None:
                inside = low + tall * _unit(ta.mix64(dart + np.uint64(1))) < weight[hit]
                dart, hit = dart[inside], hit[inside]
            rank = start + length * _unit(ta.mix64(dart + np.uint64(2)))
            slot = owner[hit] * k + (dart % np.uint64(k)).astype(np.int64)
            order = np.lexsort((dart, rank, slot))
            slot, rank, dart = slot[order], rank[order], dart[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            slot, rank, dart = slot[first], rank[first], dart[first]
            better = rank < best[slot]
            best[slot[better]] = rank[better]
            name[slot[better]] = dart[better]
        full = np.isfinite(best).reshape(texts, k).all(1)
        if (full & open_).any():
            open_ &= ~full
            parts = [(n, lo, t, e[m := open_[o]], o[m], None if w is None else w[m]) for n, lo, t, e, o, w in parts]
    return name.reshape(texts, k)


def _sign_task(batches):
    for batch in batches:
        text = batch.column("text")
        for a, b in ta.slices(text, 1_000_000):
            words, bounds = ta.word_hashes(*ta.flat_bytes(text.slice(a, b - a), lower=True))
            elems, at = ta.distinct(*ta.shingle_hashes(words, bounds, WIDTH, whole=True))
            sig = (signatures(elems, at) >> np.uint64(48)).astype(np.uint16)
            nth = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
            key = [ta.per_text(ta.mix64(words + (nth + np.uint64(1)) * np.uint64(c)).view(np.int64), bounds) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            yield pa.record_batch(
                {
                    **{c: batch.column(c).slice(a, b - a) for c in ("doc_id", "x1", "x2")},
                    "h1": pa.array(key[0]),
                    "h2": pa.array(key[1]),
                    "n_words": pa.array(np.diff(bounds).astype(np.int64)),
                    "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                }
            )


def _keys(docs: DataFrame, id_col: str, text: str) -> dict:
    """What tells rows apart without Python: the id, and two hashes of the text as it stands."""
    t = text_of(docs, text)
    return {"doc_id": F.col(f"`{id_col}`").cast("long"), "x1": F.xxhash64(t), "x2": F.xxhash64(F.lit(1), t)}


def sign(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x1, x2, h1, h2, n_words, sig) of every document: hashes of its text and of its words, and its signature."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[c.alias(k) for k, c in _keys(docs, id_col, text).items()], text_of(docs, text).alias("text"))
    return rows.mapInArrow(trimmed(_sign_task), "doc_id long, x1 long, x2 long, h1 long, h2 long, n_words long, sig binary")


def _agree_task(floor: float):
    """Pairs whose signatures agree in a share of ``floor`` of the coordinates or more, with that share."""

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            est = (x == y).mean(1)
            near = np.flatnonzero(est >= floor)
            yield pa.record_batch({"a": batch.column("a").take(pa.array(near)), "b": batch.column("b").take(pa.array(near)), "est": pa.array(est[near])})

    return trimmed(task)


def _set_task(batches):
    for batch in batches:
        text = batch.column("text")
        for a, b in ta.slices(text):
            words, bounds = ta.word_hashes(*ta.flat_bytes(text.slice(a, b - a), lower=True))
            elems, at = ta.shingle_hashes(words, bounds, WIDTH, whole=True)
            elems, at = ta.distinct(elems >> np.uint64(32), at)
            elems = elems.astype(np.uint32)
            yield pa.record_batch(
                {"node": batch.column("node").slice(a, b - a), "elems": pa.array([elems[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())}
            )


def _jaccard_task(threshold: float):
    """Pairs whose sets have a Jaccard similarity of ``threshold`` or more."""

    def task(batches):
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ea"), batch.column("eb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near[i] = both / max(1, len(x) + len(y) - both) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return trimmed(task)


def _token_task(batches):
    for batch in batches:
        for node, root, elems in zip(*(batch.column(c).to_pylist() for c in ("node", "root", "elems"))):
            tokens = np.frombuffer(elems, np.uint32).astype(np.int64)
            same = lambda x, t: pa.array(np.full(len(tokens), x), t)  # noqa: B023, E731
            yield pa.record_batch({"node": same(node, pa.int64()), "root": same(root, pa.int64()), "n": same(len(tokens), pa.int32()), "token": pa.array(tokens)})


def _map_task(batches):
    for batch in batches:
        maps = np.zeros((batch.num_rows, 64 * MAP_WORDS), np.uint8)
        for row, elems in enumerate(batch.column("elems").to_pylist()):
            maps[row] = np.bincount(np.frombuffer(elems, np.uint32) % (64 * MAP_WORDS), minlength=64 * MAP_WORDS) & 1
        words = np.packbits(maps, axis=1).view(np.int64)
        yield pa.record_batch({"node": batch.column("node"), **{f"w{i}": pa.array(words[:, i]) for i in range(MAP_WORDS)}})


def rare_pairs(sets: DataFrame, threshold: float = THRESHOLD, most: int | None = None) -> DataFrame:
    """(a, b, shared), a < b: of the sets (node, root, elems), a superset of the pairs of different roots at the threshold.

    Prefix filtering: with elements in one order for all sets, the rarest first, the smaller set of such a pair has one
    of its first ``n - 2t / (1 + t) n + 1`` elements in common with the first ``n - t n + 1`` of the larger one. What a
    family below the threshold shares lies behind its smaller prefix. Elements under one root only make no pair, and
    the most common root of an element is not paired with itself. ``shared`` counts the elements by which a pair was found.

    A map of a set has in each bit the parity of the elements hashed to it. What two sets share cancels out, so the bits
    in which their maps differ are at most the elements in which the sets differ; pairs with more than
    ``(1 - t) / (1 + t)`` of both sizes are below the threshold and end in the join itself.

    ``most``: the rows at most that ``sets`` has or is joined from, if known; then small tables have few files.
    """
    tokens = materialize(sets.mapInArrow(trimmed(_token_task), "node long, root long, n int, token long"), "crowd-tokens", most, FILE_SETS)
    order = Window.partitionBy("node").orderBy("c", "token")
    counted = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("c")), "token").withColumn("pos", F.row_number().over(order))
    within = lambda share: F.col("pos") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1
    prefix = counted.filter(within(threshold)).select("token", "node", "root", "n", "pos", within(2 * threshold / (1 + threshold)).alias("short"))
    prefix = materialize(prefix, "crowd-prefixes", tokens.count())
    by_root = prefix.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token")
    main = by_root.agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("token", "main")
    maps = sets.select("node", "elems").mapInArrow(trimmed(_map_task), ", ".join(["node long", *(f"w{i} long" for i in range(MAP_WORDS))]))
    met = materialize(prefix.join(main, "token").join(maps, "node"), "crowd-met", prefix.count(), FILE_LINKS)
    x, y = met.filter("root <> main").alias("x"), met.alias("y")
    smaller = "struct(x.n, x.node) < struct(y.n, y.node)"
    both = f"x.token = y.token and x.root <> y.root and if({smaller}, x.short, y.short) and least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) - 1e-6"
    once = "(y.root = y.main or x.node < y.node)"
    enough = f"1 + least(x.n - x.pos, y.n - y.pos) >= {threshold / (1 + threshold)} * (x.n + y.n) - 1e-6"
    differ = " + ".join(f"bit_count(x.w{i} ^ y.w{i})" for i in range(MAP_WORDS))
    near = f"{differ} <= {(1 - threshold) / (1 + threshold)} * (x.n + y.n) + 1e-6"
    found = x.join(y, F.expr(f"{both} and {once} and {enough} and {near}"))
    return found.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.count("*").alias("shared"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the lowest id of its connected component.

    Each round hooks every node's root to the lowest root among its neighbours and then jumps pointers; rounds are
    written tables. The driver sees one count a round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b")
    both = materialize(both.distinct(), f"{label}-edges", 2 * edges.count(), FILE_LINKS)
    roots = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
    roots = materialize(roots, label, both.count(), FILE_LINKS)
    nodes = roots.count()
    while True:
        there = both.join(roots.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy("a").agg(F.min("r").alias("near"))
        hooked = roots.join(there.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("new"))
        # a root moves to the lowest root that any node below it has met
        moved = hooked.groupBy(F.col("root").alias("old")).agg(F.min("new").alias("to"))
        step = hooked.join(moved, hooked["root"] == moved["old"]).select("node", "root", F.least("new", "to").alias("new"))
        jump = moved.select(F.col("old").alias("j_node"), F.col("to").alias("j_to"))
        step = step.join(jump, step["new"] == jump["j_node"], "left").select("node", "root", F.least("new", F.coalesce("j_to", "new")).alias("new"))
        step = materialize(step, label, nodes, FILE_LINKS)
        changed = step.filter("new <> root").limit(1).count()
        roots = step.select("node", F.col("new").alias("root"))
        if not changed:
            return roots


def _classes(docs: DataFrame, id_col: str, text: str, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """(doc_id, x1, x2, h1, h2, n_words, class_id, stays, chosen) of every row; ``chosen`` marks the one text of a class
    that is left of it."""
    signed = materialize(sign(docs, id_col, text), "signatures")
    n = signed.count()
    worded = signed.filter("n_words > 0")
    first = worded.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "x1", "x2", "sig")).alias("m")).select("h1", "h2", "m.*")
    # numbers for the texts; the written table fixes them
    first = materialize(first.withColumn("node", F.monotonically_increasing_id()), "representatives", n, FILE_SETS)
    nodes = first.select("node", "sig")
    bands = nodes.select("node", F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])).alias("band", "key"))
    bands = bands.select("node", "key")
    leaders = [F.min("node"), F.max("node")]
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*leaders)).alias("leaders")).filter("n > 1")
    # members that are no leaders are paired with leaders only; rare_pairs covers them
    crowd = materialize(bands.join(buckets.filter(F.col("n") >= F.size("leaders") + 2).select("key"), "key").select("key", "node"), "crowd", BANDS * n)
    pairs = bands.join(buckets, "key").select("node", F.explode("leaders").alias("leader")).filter("node <> leader")
    pairs = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    # tasks that filter themselves: Spark would evaluate a function of a column twice, below the filter and in it, in a worker each
    pairs = (
        pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_agree_task(floor), "a long, b long, est double")
    )
    pairs = materialize(pairs, "pairs", 2 * BANDS * n)  # a node and its bucket's leaders
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct()
    needed = first.select("node", F.col("doc_id").alias("of"), "x1", "x2").join(needed, "node", "left_semi")
    rows = docs.select(*[c.alias(k) for k, c in _keys(docs, id_col, text).items()], text_of(docs, text).alias("text"))
    # merge at every size: the ids grow with the input, and plans that turn with the size would hide how they grow
    rows = rows.alias("r").join(needed.alias("n").hint("merge"), F.expr("r.x1 = n.x1 and r.x2 = n.x2 and r.doc_id <=> n.of")).select("node", "text")
    sets = materialize(rows.mapInArrow(trimmed(_set_task), "node long, elems binary"), "shingle-sets", n, FILE_SETS)
    sets = sets.groupBy("node").agg(F.min("elems").alias("elems"))

    def verified(some: DataFrame) -> DataFrame:
        wide = some.join(sets.select(F.col("node").alias("a"), F.col("elems").alias("ea")), "a").join(sets.select(F.col("node").alias("b"), F.col("elems").alias("eb")), "b")
        return wide.select("a", "b", "ea", "eb").mapInArrow(_jaccard_task(threshold), "a long, b long")

    best = pairs.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = materialize(verified(best), "links", n, FILE_SETS)
    roots = components(links, "roots")
    named = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    apart = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
    apart = apart.select("a", "b", F.coalesce("root_a", "a").alias("ra"), F.coalesce("root_b", "b").alias("rb")).filter("ra <> rb")
    more = materialize(verified(apart.join(best, ["a", "b"], "left_anti").select("a", "b")), "more-links", n + pairs.count(), FILE_SETS)  # a task reads sets besides pairs
    links = links.union(more)
    if more.limit(1).count():
        roots = components(links, "all-roots")
    rooted = crowd.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    loose = materialize(rooted.join(mixed, "key", "left_semi").select("node", "root").distinct(), "crowd-apart", n + crowd.count(), FILE_LINKS)
    if loose.limit(1).count():
        found = materialize(rare_pairs(loose.join(sets, "node"), threshold, n), "crowd-pairs")
        # first each text with the one that shares most; what these links join needs no further pairs
        nearest = [found.groupBy(x).agg(F.max_by(y, F.struct("shared", y)).alias(y)).select("a", "b") for x, y in (("a", "b"), ("b", "a"))]
        nearest = materialize(nearest[0].union(nearest[1]).distinct(), "crowd-nearest", 2 * found.count(), FILE_LINKS)
        links = links.union(materialize(verified(nearest), "crowd-links", n + nearest.count(), FILE_SETS))
        roots = components(links, "crowd-roots")
        apart = found.join(nearest, ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left")
        apart = apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        rest = materialize(verified(apart), "crowd-more-links", n + found.count(), FILE_SETS)
        if rest.limit(1).count():
            roots = components(links.union(rest), "last-roots")
    rep = first.drop("sig").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rep.groupBy("root").agg(F.min(F.struct("doc_id", "x1", "x2")).alias("low"))
    out = signed.drop("sig").join(rep.join(lowest, "root").select("h1", "h2", "low"), ["h1", "h2"], "left")
    alone, low = F.col("n_words") == 0, F.col("low")
    stays = alone | F.col("doc_id").eqNullSafe(low["doc_id"])
    return out.select(
        "doc_id", "x1", "x2", "h1", "h2", "n_words", F.when(alone, F.col("doc_id")).otherwise(low["doc_id"]).alias("class_id"),
        stays.alias("stays"), (alone | stays & (F.col("x1") == low["x1"]) & (F.col("x2") == low["x2"])).alias("chosen"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """(doc_id, h1, h2, class_id, stays) for every row of ``docs``; of equal rows (id and text) each is given.

    ``stays`` marks the rows of the lowest id in the class.
    """
    return _classes(docs, id_col, text, threshold, floor).select("doc_id", "h1", "h2", "class_id", "stays")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class. Rows that repeat its id and text give one row; texts without
    words stay, but for those that repeat an id.

    Only the ids and text hashes of rows that go, or that are repeated, are joined to the documents.
    """
    classes = materialize(_classes(docs, id_col, text, **options).select("doc_id", "x1", "x2", "n_words", "chosen"), "classes", docs.count(), FILE_SETS)
    keys = classes.filter("n_words > 0 or doc_id is not null").groupBy("doc_id", "x1", "x2").agg(F.min("chosen").alias("chosen"), F.count("*").alias("n"))
    marks = keys.filter("not chosen or n > 1").select(F.col("doc_id").alias("of"), "x1", "x2", F.when(F.col("chosen"), 2).otherwise(1).alias("mark"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in _keys(docs, id_col, text).items()])
    rows = rows.alias("r").join(marks.alias("m"), F.expr("r.x1 = m.x1 and r.x2 = m.x2 and r.doc_id <=> m.of"), "left").filter("mark is null or mark = 2")
    marked = materialize(rows.select("row", "doc_id", "r.x1", "r.x2", "mark"), "kept-rows", classes.count(), FILE_SETS)
    names = [F.col("row").getField(c).alias(c) for c in docs.columns]
    single = marked.filter("mark is null").select(*names)
    again = marked.filter("mark = 2").groupBy("doc_id", "x1", "x2").agg(F.first("row").alias("row"))
    return single.union(again.select(*names))
