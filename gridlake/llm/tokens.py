"""Token counts as an exact length histogram.

Documents are encoded whole and aggregated by encoded length; suffix sums over the histogram answer
totals, quantiles and truncated totals for every context limit. The histogram is as long as there
are different lengths; its suffix sums are taken in two levels (ranges of lengths, then lengths), so
no task needs all lengths.

Defined cases: a null or empty text has length 0; an empty table gives an empty histogram; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of the 50k byte-level vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, read once in a process."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def lengths(texts: list[str | None], path: str) -> np.ndarray:
    enc = encoder(path)
    return np.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype=np.int64)


def length_histogram(docs: DataFrame, path: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """n_tokens, n_docs, docs_at_least, tokens_at_least, docs_at_most, share_at_most (of all documents: a length is the
    q-quantile if it is the first whose share reaches q), truncated_total (tokens left if every text is cut at n_tokens).
    Texts are encoded once: the histogram is written before its sums are taken."""
    common.text_batches(docs.sparkSession)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n, c = np.unique(lengths(p["t"].tolist(), path), return_counts=True)
            yield pd.DataFrame({"n_tokens": n, "c": c})

    part = docs.select(F.col(text).alias("t")).mapInPandas(count, "n_tokens long, c long")
    return suffix_sums(common.cut(part.groupBy("n_tokens").agg(F.sum("c").alias("n_docs"))))


def suffix_sums(hist: DataFrame, span: int = 1024) -> DataFrame:
    h = hist.withColumn("part", F.floor(F.col("n_tokens") / span)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("pd"), F.sum("mass").alias("pm"))
    up, down = W.orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1), W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select("part", zero(F.sum("pd").over(up)).alias("ad"), zero(F.sum("pm").over(up)).alias("am"), zero(F.sum("pd").over(down)).alias("bd"), zero(F.sum("pm").over(down)).alias("bm"))
    own = W.partitionBy("part").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    low = W.partitionBy("part").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    j = h.join(parts, "part")
    below = F.sum("mass").over(low) + F.col("bm")
    above = F.sum("n_docs").over(own) + F.col("ad")
    out = j.select("n_tokens", "n_docs", above.alias("docs_at_least"), (F.sum("mass").over(own) + F.col("am")).alias("tokens_at_least"), (F.sum("n_docs").over(low) + F.col("bd")).alias("docs_at_most"), below.alias("below"))
    cut = F.col("below") + F.col("n_tokens") * (F.col("docs_at_least") - F.col("n_docs"))
    share = F.col("docs_at_most") / (F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs"))
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_at_most", share.alias("share_at_most"), cut.alias("truncated_total"))


def total(hist: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens."""
    return hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("n_tokens"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain if every text is cut at the limit."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("n_tokens"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of documents does not exceed; null if there are none."""
    return hist.where(F.col("share_at_most") >= F.lit(q)).agg(F.min("n_tokens").alias("n_tokens"))
