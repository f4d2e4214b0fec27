"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows of ``size`` consecutive words (a shorter item is one
window). Containment of a whole window needs each of its words, so one necessary prefix token is
enough: its rarest word, rarity being counted over all documents. Document words are joined with
these tokens; the token's place in the window and the text's length bound where the window would
lie, and the words there are compared with the window exactly. For that, texts are cut into stretches that
overlap by a window, so that a word's row carries its surroundings and not the whole text: work and rows grow with
the number of words, however long a text is.

Defined cases: a null or wordless text or item has no words and no hits; repeated document rows each
get their own result; repeated items with one id count once, items of equal text each count;
null item ids count as items named ``null``; an empty benchmark hits nothing. Extra columns of the
document table are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Windows up to this number, and up to these bytes, go to every executor; beyond, the joins are shuffled.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Words of a stretch of text, without the overlap.
STRETCH = 64


def windows_of(benchmark: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: words ``w`` (array), their text ``wt``, and the sorted ids of their items."""
    item = F.coalesce(F.col(item_id).cast("string"), F.lit("null"))
    words = benchmark.select(item.alias("item"), common.words_of(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1))))
    cut = words.select("item", "ws", at.alias("at")).select("item", F.slice("ws", F.col("at"), F.least(F.size("ws"), F.lit(size))).alias("w"))
    return cut.groupBy("w").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit is over 0 and
    ``share`` times n_hit reaches n_words)."""
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    return _report(keyed, benchmark, size, share, broadcast_windows)


def _report(keyed: DataFrame, benchmark: DataFrame, size: int, share: int, broadcast_windows: int) -> DataFrame:
    wins = common.cut(windows_of(benchmark, size).withColumn("wt", F.array_join("w", " ")).withColumn("wid", F.xxhash64("wt")))
    size_of = wins.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("wt") * 2 + 64 * F.size("items")), F.lit(0)).alias("b")).first()
    small = size_of["n"] <= broadcast_windows and size_of["b"] <= BROADCAST_BYTES
    near = F.broadcast if small else (lambda df: df)
    vocabulary = wins.select(F.explode("w").alias("token")).distinct()
    tokens = keyed.select(F.explode(common.words_of(F.col("t"))).alias("token"))
    seen = tokens.join(near(vocabulary), "token", "left_semi").groupBy("token").count()
    # rarity of each benchmark word over all documents; a word that no document has is the rarest
    rarity = vocabulary.join(seen, "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("n"))
    spread = wins.select("wid", "wt", F.size("w").alias("len"), F.posexplode("w").alias("o", "token")).join(near(rarity), "token")
    prefix = spread.groupBy("wid", "wt", "len").agg(F.min(F.struct("n", "token", "o")).alias("r"))
    prefix = common.cut(prefix.where(F.col("r.n") > 0).select(F.col("r.token").alias("token"), F.col("r.o").alias("o"), "len", "wt", "wid"))
    # stretches: own words from word k on, and the words of a window less one around them
    around = size - 1
    cuts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0)), F.lit(STRETCH)),
        lambda k: F.struct(k.alias("k"), F.greatest(k - around, F.lit(0)).alias("b"), F.slice("ws", F.greatest(k - around, F.lit(0)) + 1, F.lit(STRETCH + around) + F.least(k, F.lit(around))).alias("c")),
    )
    stretches = keyed.select("d", "h", common.words_of(F.col("t")).alias("ws")).select("d", "h", F.explode(cuts).alias("x")).select("d", "h", "x.k", "x.b", "x.c")
    place = stretches.select("d", "h", "k", "b", "c", F.posexplode(F.slice("c", F.col("k") - F.col("b") + 1, F.lit(STRETCH))).alias("i", "token"))
    start = F.col("k") - F.col("b") + F.col("i") - F.col("o")
    hits = place.join(near(prefix), "token").where((start >= 0) & (start + F.col("len") <= F.size("c")))
    hits = hits.where(F.array_join(F.slice("c", start + 1, F.col("len")), " ") == F.col("wt"))
    hits = common.cut(hits.select("d", "h", (F.col("b") + start).alias("s"), "len", "wid").distinct())
    order = W.partitionBy("d", "h").orderBy("s", "len").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("s") + F.col("len")
    union = hits.select("d", "h", "s", end.alias("e"), F.coalesce(F.max(end).over(order), F.lit(0)).alias("before"))
    covered = union.groupBy("d", "h").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before"))).alias("n_hit"))
    named = wins.select("wid", F.explode("items").alias("item"))
    items = hits.select("d", "h", "wid").distinct().join(near(named), "wid").select("d", "h", "item").distinct()
    items = items.groupBy("d", "h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = covered.join(items, covered["d"].eqNullSafe(items["d"]) & (covered["h"] == items["h"])).select(covered["d"].alias("fd"), covered["h"].alias("fh"), "n_hit", "items")
    counted = keyed.select("d", "h", common.word_count(F.col("t")).alias("n_words"))
    out = counted.join(found, F.col("d").eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("d").alias("doc_id"), F.col("h").alias("text_key"), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), listed.alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """The document rows that are not contaminated, with all their columns."""
    d, h = common.fresh(docs, "d", "h")
    bad = common.cut(contamination(docs, benchmark, size, share).where("contaminated").select(F.col("doc_id").alias(d), F.col("text_key").alias(h)).distinct())
    return docs.join(common.near(bad), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")
