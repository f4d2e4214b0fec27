"""Near-duplicate classes: weighted DartMinHash signatures, banded joining, exact verification, components.

Documents with equal word sequences are one text; only the first of each takes part further on, the others follow
it. A text's shingles of ``n`` words are weighted by how often they occur; texts are linked from a weighted Jaccard
similarity (sum of least counts over sum of greatest counts) of ``threshold`` on. Bands of signatures bring
candidates together, and a candidate is accepted only by its exact similarity:

1. Stars: each text of a bucket is held against one text of it, as many pairs as entries. That joins groups of copies,
   however large, without their pairs. Further stars, around texts of the bucket's largest class, take what the first left.
2. What is left of a bucket with several classes are pairs with a text outside its largest class. These texts meet
   all texts of such buckets by a prefix join: elements are ordered from rare to common, and texts that reach the
   threshold share one of their first few. Bounds on lengths and positions leave out pairs that cannot reach the
   threshold, and no other. So every pair of a bucket is settled, at every size.

Classes are the components of the links. They are found by joins over written tables, in which linked ids become one,
until no link is left; each step's links are held against the classes so far, not against all links before. Buckets,
leaders and classes of many rows are dealt over several tasks.

Defined cases: null texts and empty ones are never linked, texts without a word only if the same string repeats;
a text of fewer than ``n`` words is one shingle; repeated rows fall in one class; rows with a null id form no class
(their class is null). Rows that share an id but not their text are texts of their own. Other columns are ignored by
``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import dartminhash as dart

BANDS, ROWS, STARS = 42, 7, 3
_CHARS = 150_000
#: Prefix join: counters of how common elements are (by their low bits), and how many of them come to the driver as one
#: row. Collisions change the order, never the result.
_COUNTERS, _COUNTER_BLOCK = 1 << 18, 1 << 10


def fingerprints(texts: list[str | None]) -> list[bytes | None]:
    """What equal texts share: a 128-bit hash of the word sequence, or of the string if it has no word; None if there is nothing to compare."""
    import hashlib

    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        w = dart.word_hashes(t)
        out.append(hashlib.blake2b(w.tobytes() if w.size else b"\0" + t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
    return out


def _pieces(texts: list[str], size: int = _CHARS) -> Iterator[slice]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > size:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def text_keys(texts: list[str], n: int, bands: int, rows: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and total weight of each text. Texts without words have weight 0 and no use for their keys: the fingerprint is all that joins them."""
    out, sizes = np.zeros((len(texts), bands), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for s in _pieces(texts):
        el, we, ow = [], [], []
        part = texts[s]
        for i, t in enumerate(part):
            u, c = np.unique(dart.shingles(dart.word_hashes(t), n), return_counts=True)
            el.append(u)
            we.append(c.astype(np.float64) if weighted else np.ones(u.size))
            ow.append(np.full(u.size, i, dtype=np.int64))
        weights, owner = np.concatenate(we), np.concatenate(ow)
        out[s] = dart.band_keys(dart.signatures(np.concatenate(el), weights, owner, len(part), bands * rows), bands, rows)
        sizes[s] = np.bincount(owner, weights, minlength=len(part)).astype(np.int64)
    return out, sizes


def _classed(docs: DataFrame, threshold: float, n: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """id, x (hash of the text), class_id (smallest id of the class), for every row. ``node`` is a text: 64 bits of its fingerprint."""
    spark = docs.sparkSession
    common.text_batches(spark)

    # one pass over the texts: what equal texts share, and the band keys
    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p["t"].tolist()
            fp = fingerprints(texts)
            some = [i for i, f in enumerate(fp) if f is not None]
            out: list = [None] * len(texts)
            size = np.zeros(len(texts), dtype=np.int64)
            for i, k, m in zip(some, *text_keys([texts[i] for i in some], n, bands, rows, weighted)):
                out[i], size[i] = k, m
            node = pd.array([None if f is None else int.from_bytes(f[:8], "big", signed=True) for f in fp], dtype="Int64")
            yield pd.DataFrame({"id": p["id"].astype("Int64"), "x": p["x"].astype("Int64"), "node": node, "size": size, "keys": out})

    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("x"), F.col("text").alias("t"))
    prints = common.cut(ids.mapInPandas(keys, "id long, x long, node long, size long, keys array<long>"))
    known = prints.where(F.col("node").isNotNull() & F.col("id").isNotNull())
    # equal texts: one row (id, x) stands for all and brings the text's elements later
    first = common.cut(known.groupBy("node").agg(F.min(F.struct("id", "x")).alias("rep"), F.min("size").alias("size"), F.min_by("keys", "id").alias("keys")))
    entries = first.where("size > 0").select("node", "size", F.explode("keys").alias("key"))

    # stars
    leader = F.min(F.struct(F.xxhash64("node").alias("o"), "node", "size"))
    heads = entries.groupBy("key").agg(F.count("*").alias("c"), leader.alias("r")).where("c > 1")
    heads = common.cut(heads.select("key", F.col("r.node").alias("lead"), F.col("r.size").alias("lsize")))
    placed = common.cut(entries.join(common.near(heads), "key"))
    used = common.cut(placed.select("node").distinct())
    sets = common.cut(_sets(ids, first.join(common.near(used), "node", "left_semi").select("node", "rep"), n, weighted))
    common.give_back(spark)
    classes = None
    for star in range(STARS):
        pairs = placed.where(F.col("node") != F.col("lead")).where(_fit("size", "lsize", threshold)).select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
        found = common.cut(_verified(common.cut(pairs), sets, threshold))
        classes, met = components(found, classes), placed.select("node", "size", "key")
        placed = common.cut(_around_largest(_with_classes(met, classes), star + 1))
        common.give_back(spark)

    # all that is left between classes
    need = placed.groupBy("node").agg(F.max(F.col("node") != F.col("lead")).alias("outside"))
    need = common.cut(_with_classes(need, classes))
    alike = common.cut(_alike(sets, need, threshold))
    common.give_back(spark)
    found = common.cut(_verified(alike, sets, threshold))
    classes = components(found, classes)
    common.discard(heads, placed, used, sets, alike)
    common.give_back(spark)

    out = common.cut(_with_classes(first.select("node", F.col("rep.id").alias("least")), classes))
    tops = out.groupBy("cls").agg(F.min("least").alias("top"))
    named = common.cut(common.look_up(out, tops, "cls").select("node", F.col("top").alias("class_id")))
    member = prints.select("id", "x", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    joined = common.look_up(member.where("node is not null"), common.near(named), "node").select("id", "x", "class_id")
    return joined.unionByName(member.where("node is null").select("id", "x", F.col("id").alias("class_id")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), for every row of the table."""
    return _classed(docs, threshold, n, bands, rows, weighted).select(F.col("id").alias("doc_id"), "class_id")


def _fit(m: str, k: str, threshold: float):
    """Total weights that a pair above the threshold can have."""
    return F.least(m, k) >= F.lit(threshold) * F.greatest(m, k) - 1e-6


def _with_classes(entries: DataFrame, classes: DataFrame) -> DataFrame:
    return entries.join(common.near(classes.withColumnRenamed("id", "node")), "node", "left").withColumn("cls", F.coalesce("cls", "node"))


def _around_largest(named: DataFrame, order: int) -> DataFrame:
    """Entries of the buckets that hold several classes, with a text of the bucket's largest one; its own members lead themselves."""
    one = F.min(F.struct(F.xxhash64("node", F.lit(order)).alias("o"), "node", "size"))
    kinds = named.groupBy("key", "cls").agg(F.count("*").alias("c"), one.alias("r"))
    heads = kinds.groupBy("key").agg(F.max_by(F.struct("cls", "r"), F.struct("c", F.xxhash64("cls"))).alias("top"), F.count("*").alias("n")).where("n > 1")
    heads = common.near(common.cut(heads.select("key", F.col("top.cls").alias("big"), F.col("top.r.node").alias("lead"), F.col("top.r.size").alias("lsize"))))
    return named.join(heads, "key").select("node", "size", "key", F.when(F.col("cls") == F.col("big"), F.col("node")).otherwise(F.col("lead")).alias("lead"), "lsize")


def _sets(ids: DataFrame, need: DataFrame, n: int, weighted: bool) -> DataFrame:
    """node, s: the elements of each text that is asked for, from the one row that stands for it (repeats of that row go)."""

    @F.pandas_udf("array<long>")
    def sets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([dart.elements(t, n, weighted).view(np.int64) for t in s])

    rows = common.near(common.cut(need.select("node", F.col("rep.id").alias("id"), F.col("rep.x").alias("x"))))
    return ids.join(rows, ["id", "x"]).select("node", sets("t").alias("s")).dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs, a written table, whose exact similarity reaches the threshold. Hot texts of either side are found in the
    pairs alone, so that elements are joined to them once."""
    sa, sb = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = common.look_up_dealt(common.look_up(pairs, sa, "a"), sb, "b", common.heavy_keys(pairs, "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where((shared > 0) & (shared >= F.lit(threshold) * (F.size("x") + F.size("y") - shared) - 1e-9)).select("a", "b")


def prefixes(s: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """The first elements of a set, from rare to common, of which a text that reaches the threshold has one: all of
    them if that text is as long or shorter; the first ``short`` do if it is as long or longer."""
    m = s.size
    order = np.lexsort((s, counts[s & np.int64(_COUNTERS - 1)]))
    long = m - int(np.ceil(threshold * m - 1e-6)) + 1
    short = m - int(np.ceil(2 * threshold / (1 + threshold) * m - 1e-6)) + 1
    return s[order[:long]], short


def _counters(sets: DataFrame) -> np.ndarray:
    """How many sets have an element of each counter. They come to the driver as blocks of bytes, 1 MB in all: as rows,
    each would be an object there."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(_COUNTER_BLOCK, dtype="<i4")
        counts[rows["slot"].to_numpy(dtype=np.int64) % _COUNTER_BLOCK] = np.minimum(rows["c"].to_numpy(dtype=np.int64), 2**31 - 1)
        return pd.DataFrame({"block": [int(rows["slot"].iloc[0]) // _COUNTER_BLOCK], "counts": [counts.tobytes()]})

    slots = sets.select(F.explode("s").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(_COUNTERS - 1)).alias("slot")).agg(F.count("*").alias("c"))
    blocks = slots.groupBy(F.floor(F.col("slot") / _COUNTER_BLOCK)).applyInPandas(packed, "block long, counts binary")
    out = np.zeros(_COUNTERS, dtype=np.int32)
    for r in blocks.collect():  # at most _COUNTERS / _COUNTER_BLOCK rows
        at = r["block"] * _COUNTER_BLOCK
        out[at : at + _COUNTER_BLOCK] = np.frombuffer(r["counts"], dtype="<i4")
    return out


def _alike(sets: DataFrame, need: DataFrame, threshold: float) -> DataFrame:
    """a, b: all pairs of the texts in ``need`` (node, outside, cls) that are of different classes, of which one is
    outside, and that may reach the threshold, by a prefix join on their elements: pairs that it leaves out share too
    little. Pairs that fail the bounds never leave the join."""
    spark = sets.sparkSession
    mine = common.cut(sets.join(need, "node"))
    shared = spark.sparkContext.broadcast(_counters(mine))

    def firsts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for node, outside, cls, s in zip(p["node"], p["outside"], p["cls"], p["s"]):
                s = np.asarray(s, dtype=np.int64)
                t, short = prefixes(s, shared.value, threshold)
                place = np.arange(t.size)
                other = shared.value[t & np.int64(_COUNTERS - 1)] > 1  # an element counted once is in no other set
                yield pd.DataFrame({"t": t[other], "node": node, "outside": outside, "cls": cls, "m": s.size, "i": place[other], "short": (place < short)[other]})

    rows = common.cut(mine.mapInPandas(firsts, "t long, node long, outside boolean, cls long, m long, i long, short boolean"))
    common.discard(mine)
    left = rows.where("short").select("t", F.col("node").alias("u"), F.col("cls").alias("x"), F.col("outside").alias("o"), "m", "i")
    right = rows.select("t", F.col("node").alias("v"), F.col("cls").alias("y"), F.col("outside").alias("p"), F.col("m").alias("k"), F.col("i").alias("j"))
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("m") + F.col("k")) - F.lit(1e-6))
    fits = (left["t"] == right["t"]) & (F.col("x") != F.col("y")) & (F.col("m") <= F.col("k")) & _fit("m", "k", threshold) & (F.least(F.col("m") - F.col("i"), F.col("k") - F.col("j")) >= least)
    ends = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    return left.where("o").join(right, fits).select(*ends).unionByName(left.where("not o").join(right.where("p"), fits).select(*ends)).distinct()


def components(links: DataFrame, known: DataFrame | None = None, most: int = 1_000_000) -> DataFrame:
    """id, cls: the smallest id that links reach, those behind ``known`` (such a result of earlier links) included.
    ``links`` (a, b) is a written table.

    Only links between different known classes count, as links between these. Each round every id goes to its smallest
    neighbour, and by that one's way on to a local minimum; what is left are the links between such minima, so a round
    of star-shaped groups leaves none, and later rounds do not meet the links again. Tables of at most ``most`` links
    are broadcast; beyond that they are joined by shuffles, in which hubs and large classes are dealt over several tasks."""
    few = links.count() <= most and (known is None or known.count() <= most)

    def look_up(many: DataFrame, one: DataFrame, key: str, to: str) -> DataFrame:
        """``many`` with the class of ``key`` in place of it, as ``to``; ``one`` has a row for each."""
        one = one.select(F.col("id").alias(key), F.col("cls").alias("__to"))
        if few:
            many = many.join(F.broadcast(one), key)
        else:
            many = common.look_up(many if hasattr(many, "_written_at") else common.cut(many), one, key)
        return many.select(*[c for c in many.columns if c not in (key, "__to")], F.col("__to").alias(to))

    def between(edges: DataFrame, one: DataFrame) -> DataFrame:
        named = look_up(look_up(edges, one, "a", "u"), one, "b", "v").where("u <> v")
        return common.cut(named.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())

    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    if known is None:
        label = ends = common.cut(ends.withColumn("cls", F.col("id")))
        edges = common.cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        ends = common.cut(ends.join(common.near(known), "id", "left").select("id", F.coalesce("cls", "id").alias("cls"), F.col("cls").isNull().alias("fresh")))
        label = common.cut(known.unionByName(ends.where("fresh").select("id", "cls")))
        edges = between(links, ends)
        common.discard(ends)
    while not edges.isEmpty():
        lower = edges.select(F.col("b").alias("id"), F.col("a").alias("cls")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("cls")))
        root, moved = common.cut(lower.groupBy("id").agg(F.min("cls").alias("cls"))), True
        while moved:
            before, on = root, root.withColumn("old", F.col("cls"))
            root = common.cut(look_up(on, before, "cls", "cls"))
            moved = not root.where("old <> cls").isEmpty()
            common.discard(before)
        root_ids = root.select("id", "cls")
        rest = label.select(F.col("cls").alias("id")).distinct().join(root_ids, "id", "left_anti").withColumn("cls", F.col("id"))
        old_label, label = label, common.cut(look_up(label, root_ids.unionByName(rest), "cls", "cls"))
        old_edges, edges = edges, between(edges, root_ids)
        common.discard(old_label, old_edges, root)
    common.discard(edges)
    return label


def deduplicate(docs: DataFrame, threshold: float = 0.8, n: int = 5, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """The table with one row of each class: that of the smallest id (of several such rows, the one whose text has the
    smallest hash; of equal rows, any). Rows of a null id all stay."""
    classes = common.cut(_classed(docs, threshold, n, bands, rows, weighted).where("id is not null").groupBy("id", "x", "class_id").agg(F.count("*").alias("c")))
    stays = classes.groupBy("class_id").agg(F.min(F.struct("id", "x")).alias("first"))
    marked = common.look_up(classes, stays, "class_id").select("id", "x", "c", (F.struct("id", "x") == F.col("first")).alias("keep"))
    marked = common.cut(marked.where("not keep or c > 1"))
    gone, again, key = common.fresh(docs, "gone", "again", "x")
    named = docs.withColumn(key, F.xxhash64("text"))

    def matching(rows: DataFrame) -> tuple[DataFrame, object]:
        other = common.near(common.cut(rows.select(F.col("id").alias(gone), F.col("x").alias(again))))
        return other, (named["doc_id"].cast("long") == other[gone]) & (named[key] == other[again])

    dropped, on = matching(marked.where("not keep"))
    kept = named.join(dropped, on, "left_anti")
    repeats = common.cut(marked.where("keep"))
    common.give_back(docs.sparkSession)
    if repeats.isEmpty():
        return kept.drop(key)
    other, _ = matching(repeats)
    on = (kept["doc_id"].cast("long") == other[gone]) & (kept[key] == other[again])
    return kept.join(other, on, "left_anti").unionByName(kept.join(other, on, "left_semi").dropDuplicates(["doc_id", key])).drop(key)
