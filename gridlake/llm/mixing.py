"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are aggregated into cells (source, language, topic) of token mass; the cells' weights are raked
to the marginals in turn until the largest gap between a marginal and its target is at most ``tolerance``, or no
longer shrinks (targets that empty cells make unreachable). Each document is sampled with its cell's calibrated
probability: min(1, c x weight / mass), c chosen so that the expected tokens meet the budget. Whether a
document stays follows from a hash of its id, so a run can be repeated.

Cells number at most sources x languages x topics, however many documents there are. Up to ``LOCAL_CELLS`` they are
one partition, and joined back by broadcast; beyond, they are raked by shuffles and joined back by a salted shuffle.

Defined cases: null values of a margin are a category of their own, ``\u0000``; null and empty texts have no
tokens, a cell without tokens gets probability 1 (nothing to weigh); targets for absent categories are
ignored, categories without a target keep their natural share; repeated rows are sampled alike; an empty table
gives an empty result. Rows without an id are drawn by their text. Extra columns stay; columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

NONE = "\u0000"
#: Cells up to this number are held in one partition and broadcast (some 10 MB).
LOCAL_CELLS = 100_000
#: The target shares that the query rakes topics to; sources and languages take their natural shares to the power 0.7.
TOPIC_TARGETS = {"article": 0.4, "note": 0.3, "links": 0.1, "contact": 0.1, "table": 0.07, "shouting": 0.03}
OUTPUT = ("n_tokens", "topic", "weight", "prob", "kept")


def topic_of(text: Column) -> Column:
    """A coarse topic from the text alone: the first class whose mark occurs."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains("@"), "contact").when(t.contains("http://") | t.contains("https://"), "links").when(t.contains(" | "), "table")
        .when(t.contains("!!"), "shouting").when(t.contains("\n"), "article").otherwise("note")
    )


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that the id's text fixes (28 bits of its MD5); without an id, the text does."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("double") / float(1 << 28)


def rake(cells: DataFrame, margins: list[str], targets: dict[str, dict[str, float]] | None = None, temper: float = 0.7, tolerance: float = 1e-13, block: int = 4) -> DataFrame:
    """cells (margins, mass) with a ``weight`` each, summing to 1. Margins without targets get their natural shares to
    the power ``temper``. After each ``block`` of rounds the table is written and its gap to the targets measured."""
    cells = common.cut(cells)
    local = cells.count() <= LOCAL_CELLS
    one = lambda df: df.coalesce(1) if local else df  # noqa: E731  one partition needs no exchange for any window
    whole = cells.agg(F.sum("mass").cast("double")).first()[0] or 0.0
    out = one(cells)
    for m in margins:
        given = (targets or {}).get(m)
        share = F.sum("mass") / F.lit(whole)
        aim = F.pow(share, F.lit(temper))
        if given:
            pick = F.create_map(*[F.lit(x) for k, v in sorted(given.items()) for x in (k, float(v))])
            aim = F.coalesce(F.try_element_at(pick, F.col(m)), share)
        aims = common.cut(cells.groupBy(m).agg(F.when(F.max("mass") > 0, aim).alias("raw")))
        total = aims.agg(F.sum("raw")).first()[0]
        out = out.join(F.broadcast(aims) if local else aims, m).withColumn(f"aim_{m}", F.col("raw") / F.lit(total)).drop("raw")
    out = common.cut(one(out.select(*margins, "mass", *[f"aim_{m}" for m in margins], (F.col("mass") / F.lit(whole)).alias("weight"))))
    gap = None
    while True:
        done = out
        out = one(out)
        for _ in range(block):
            for m in margins:
                there = F.sum("weight").over(W.partitionBy(m))
                out = out.withColumn("weight", F.when(there > 0, F.col("weight") * F.col(f"aim_{m}") / there).otherwise(F.lit(0.0)))
        out = common.cut(out)  # cells, not documents
        common.discard(done)
        gaps = [out.groupBy(m).agg(F.abs(F.sum("weight") - F.max(f"aim_{m}")).alias("g")).agg(F.max("g").alias("g")) for m in margins]
        far = max((r[0] or 0.0 for g in gaps for r in g.collect()), default=0.0)
        if far <= tolerance or (gap is not None and far > 0.5 * gap):
            return out.select(*margins, "mass", "weight")
        gap = far


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """Adds ``prob``: the cells' expected tokens follow the weights, capped at what there is, and sum to budget x all
    tokens. The common factor grows as cells are capped, until no more are: a few sums over the cells."""
    ratio = F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")).otherwise(F.lit(0.0))
    c = cells.withColumn("__r", ratio)
    whole = c.agg(F.sum("mass").cast("double")).first()[0] or 0.0
    factor = 0.0
    while True:
        capped = F.col("__r") * F.lit(factor) > 1
        full, rest = c.agg(F.sum(F.when(capped, F.col("mass"))).cast("double"), F.sum(F.when(~capped, F.col("weight")))).first()
        further = (whole * budget - (full or 0.0)) / rest if rest else factor
        if further <= factor * (1 + 1e-12):
            break
        factor = further
    prob = F.when(F.col("mass") <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(factor) * F.col("__r")))
    return c.withColumn("prob", prob).drop("__r")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = 0.5, temper: float = 0.7, tolerance: float = 1e-13, salts: int = 16) -> DataFrame:
    """Every document row with n_tokens, topic, weight (its share of the mixture), prob and kept."""
    keep = [c for c in docs.columns if c.lower() not in OUTPUT]
    s, g, t, n, cs, cg, ct, cm, cw, cp, salt, cz = common.fresh(docs, "source", "lang", "topic", "n", "cs", "cg", "ct", "cm", "cw", "cp", "salt", "cz")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("source"), F.lit(NONE)).alias(s), F.coalesce(F.col("lang"), F.lit(NONE)).alias(g), topic_of(F.col("text")).alias(t),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(r"\S+")), F.lit(0)).cast("long").alias(n),
    )
    margins = ["source", "lang", "topic"]
    cells = rows.groupBy(F.col(s).alias("source"), F.col(g).alias("lang"), F.col(t).alias("topic")).agg(F.sum(n).alias("mass"))
    fitted = common.cut(calibrate(rake(cells, margins, targets, temper, tolerance), budget))
    side = fitted.select(F.col("source").alias(cs), F.col("lang").alias(cg), F.col("topic").alias(ct), F.col("mass").alias(cm), F.col("weight").alias(cw), F.col("prob").alias(cp))
    on = (F.col(s) == F.col(cs)) & (F.col(g) == F.col(cg)) & (F.col(t) == F.col(ct))
    if fitted.count() <= LOCAL_CELLS:
        joined = rows.join(F.broadcast(side), on)
    else:
        joined = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts))).join(side.withColumn(cz, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), on & (F.col(salt) == F.col(cz)))
    weight = F.when(F.col(cm) > 0, F.col(cw) * F.col(n) / F.col(cm)).otherwise(F.lit(0.0))
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.col(n).alias("n_tokens"), F.col(t).alias("topic"), weight.alias("weight"), F.col(cp).alias("prob"), (uniform(F.col("doc_id"), F.col("text")) < F.col(cp)).alias("kept"))
