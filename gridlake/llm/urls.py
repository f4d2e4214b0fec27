"""URL filter: host rules first, then logistic regression on hashed character n-grams.

The regression learns from a small labelled URL table (``LABELLED``, or one that is passed in) and
sees nothing but host and path. Rules decide before it: a rule fits its host and all subdomains if the
path starts with the rule's; the longest fitting rule wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged by the
method; repeated rows get equal results; other columns are kept, and a column named like an output
is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host and path, blocked). The small labelled table; fixed values, written by hand.
LABELLED: list[tuple[str, int]] = [
    ("cheap-pills.test/buy/viagra", 1), ("www.cheap-pills.example/en/12", 1), ("best-pills-online.test/offer", 1), ("pharmacy-discount.test/pills", 1),
    ("casino-win.test/bonus", 1), ("www.casino-win.example/en/450", 1), ("online-casino.test/slots", 1), ("free-slots-jackpot.test/spin", 1), ("poker-bonus.test/play", 1),
    ("spam-farm.test/links", 1), ("spam-farm.example/fr/728", 1), ("link-farm.test/seo/backlinks", 1), ("win-prize-now.test/claim", 1), ("xxx-videos.test/watch", 1),
    ("adult-cams.test/live", 1), ("replica-watches.test/sale", 1), ("payday-loans-fast.test/apply", 1), ("get-rich-quick.test/crypto", 1), ("hot-singles.test/chat", 1),
    ("cheap-viagra-pills.test/order/1", 1), ("blog.casino-bonus.test/en/3.html", 1), ("m.spam-links.test/en/9", 1), ("torrent-crack.test/keygen", 1), ("warez-download.test/crack", 1),
    ("news.test/world/2020/01/02/story", 0), ("www.city-library.test/catalog/12", 0), ("en.encyclopedia.test/wiki/River", 0), ("docs.project.test/guide/install.html", 0),
    ("blog.gardener.test/en/12", 0), ("www.university.test/research/paper", 0), ("m.weather.test/en/today", 0), ("recipes.test/bread/rye", 0), ("museum.test/exhibits/8", 0),
    ("www.therti.example/en/334/", 0), ("blog.thanon.example/fr/960", 0), ("m.tionble.example/de/25", 0), ("enththe.example/es/77.html", 0), ("thering.example/en/328/", 0),
    ("forum.linux.test/topic/4411", 0), ("maps.test/route/a/b", 0), ("www.school.test/class/5", 0), ("shop.books.test/novel/31", 0), ("travel.test/guide/rome", 0),
    ("science.journal.test/article/10", 0), ("photos.test/album/7", 0), ("blog.cook.test/en/853/", 0), ("code.test/repo/issues/9", 0), ("health.test/advice/sleep", 0),
]

#: (verdict, host, path of the rule), as the contract states them.
RULES: list[tuple[str, str, str]] = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
SIZES, BITS = (3, 4, 5), 16


def grams(host: str, path: str) -> np.ndarray:
    """Hashed n-grams, apart for host and path; each once."""
    out = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            out.update(zlib.crc32((mark + s[i : i + n]).encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for i in range(len(s) - n + 1))
    return np.fromiter(out, dtype=np.int64, count=len(out))


def fit(rows: list[tuple[str, str, int]], rounds: int = 300, step: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent. rows: (host, path, blocked)."""
    w, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return w, bias
    feats, y = [grams(h, p) for h, p, _ in rows], np.array([r[2] for r in rows], dtype=float)
    norm = np.array([1 / np.sqrt(max(1, f.size)) for f in feats])
    flat, row = np.concatenate(feats), np.repeat(np.arange(len(rows)), [f.size for f in feats])
    for _ in range(rounds):
        z = np.bincount(row, w[flat], len(rows)) * norm + bias
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= step * 8 * (np.bincount(flat, (g * norm)[row], 1 << BITS) + l2 * w)
        bias -= step * g.sum()
    return w, bias


def probability(host: str, path: str, w: np.ndarray, bias: float) -> float:
    f = grams(host, path)
    return float(1 / (1 + np.exp(-(w[f].sum() / np.sqrt(max(1, f.size)) + bias))))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return common.ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of the longest fitting rule and its verdict; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """The table with host, path, rule, verdict and score (the regression's probability of a block)."""
    spark = pages.sparkSession
    common.text_batches(spark, 4096)
    table = LABELLED if labelled is None else labelled
    rows = [(u.partition("/")[0], "/" + u.partition("/")[2], y) for u, y in table]
    shared = spark.sparkContext.broadcast(fit(rows))

    @F.pandas_udf("double")
    def udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w, bias = shared.value
        for h, p in parts:
            yield pd.Series([probability(a, b, w, bias) for a, b in zip(h, p)], dtype="float64")

    (tmp,) = common.fresh(pages, "rule")
    new = ("host", "path", "rule", "verdict", "score")
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    src = F.col(f"`{url}`")
    out = pages.select(*keep, host_of(src).alias("host"), path_of(src).alias("path"))
    out = out.withColumn(tmp, rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)).withColumn("score", udf("host", "path"))
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select(*keep, "host", "path", F.col(f"{tmp}.rule").alias("rule"), F.coalesce(F.col(f"{tmp}.verdict"), method).alias("verdict"), "score")
