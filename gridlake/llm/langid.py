"""Language identification with a blended-spectrum string kernel.

A text is cut into chunks of ``CHUNK`` symbols (letters lower-cased, everything else one gap).
A chunk's image is the presence of its 1- to 4-grams in a hashed space; the kernel of two chunks is
the cosine of their presence vectors. Landmarks (Nyström) span the function space, one ridge
regression per language is solved on them, and a batch is scored by two matrix products: presence
times landmarks, kernel times coefficients. A document's value is the mean over its chunks,
weighted by length.

Defined cases: a null, empty or letterless text gets ``und`` with score 0; with no labelled row at
all every text gets ``und``; repeated rows get equal results; ties go to the first label in order.
Other columns are kept as they are; a column named like an output is replaced by the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, BITS, GRAMS, BATCH = 4096, 14, (1, 2, 3, 4), 96
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_letters: np.ndarray | None = None


def _symbols() -> np.ndarray:
    """Code point to symbol: itself if a letter, else 0."""
    global _letters
    if _letters is None:
        _letters = np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], dtype=np.uint32)
    return _letters


def presence(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (presence matrix of chunks, each chunk's text number, each chunk's letters)."""
    table, held, number, size = _symbols(), [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        a = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        a = table[a]
        a = np.concatenate(([np.uint32(0)], a, [np.uint32(0)]))
        a = a[(a != 0) | np.concatenate(([True], a[:-1] != 0))]
        if a.size < 2 or not a.any():
            continue
        for k in range(0, a.size, CHUNK):
            piece = a[k : k + CHUNK + max(GRAMS) - 1]
            if piece[:CHUNK].any():
                held.append(piece)
                number.append(i)
                size += 1
            if size == BATCH:
                yield _matrix(held), np.array(number), _count(held)
                held, number, size = [], [], 0
    if size:
        yield _matrix(held), np.array(number), _count(held)


def _count(pieces: list[np.ndarray]) -> np.ndarray:
    return np.array([np.count_nonzero(p[:CHUNK]) for p in pieces], dtype=np.float64)


def _matrix(pieces: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(pieces), 1 << BITS), dtype=np.float32)
    for row, a in enumerate(pieces):
        h = np.zeros(a.size, dtype=np.uint32)
        for n in range(1, max(GRAMS) + 1):
            m = a.size - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ a[n - 1 :]) * _MULT[n - 1]
            h ^= h >> np.uint32(15)
            if n in GRAMS:
                out[row, h[:CHUNK] >> np.uint32(32 - BITS)] = 1.0
    return out


@dataclass
class LanguageModel:
    labels: list[str]
    landmarks: np.ndarray  # columns are landmarks of norm 1
    weights: np.ndarray  # a column for each label
    beta: float = 8.0

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1.0))

    def values(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean value for each text and label; which texts have letters."""
        total, mass = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for x, number, letters in presence(texts):
            np.add.at(total, number, (self.kernel(x) @ self.weights) * letters[:, None])
            np.add.at(mass, number, letters)
        return total / np.maximum(mass, 1.0)[:, None], mass > 0

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        e = np.exp(self.beta * (values - values.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, probability, and the label's own regression value (1: like its examples, -1: like the rest)."""
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), -1.0)
        values, lettered = self.values(texts)
        p = self.probabilities(values)
        best = p.argmax(1)
        return [self.labels[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, p.max(1), 0.0), np.where(lettered, values.max(1), -1.0)


def fit_texts(texts: list[str], langs: list[str], landmarks: int = 96, ridge: float = 1e-4) -> LanguageModel:
    """Solve the ridge regressions on the given rows. Landmarks are dealt over the languages in turn."""
    labels = sorted(set(langs))
    if not labels:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    xs, ys, ws = [], [], []
    for x, number, letters in presence(texts):
        xs.append(x.astype(np.uint8))
        ys += [labels.index(langs[i]) for i in number]
    if not xs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    x, y = np.concatenate(xs), np.array(ys)
    labels_there = sorted(set(ys))
    queues = [list(np.flatnonzero(y == c)) for c in labels_there]
    chosen: list[int] = []
    while len(chosen) < landmarks and any(queues):
        for q in queues:
            if q and len(chosen) < landmarks:
                chosen.append(q.pop(len(q) // 2))
    z = x[chosen].astype(np.float32)
    z /= np.sqrt(np.maximum(z.sum(1, keepdims=True), 1.0))
    model = LanguageModel(labels, np.ascontiguousarray(z.T), np.zeros((len(chosen), len(labels))))
    k = np.concatenate([model.kernel(x[i : i + BATCH].astype(np.float32)) for i in range(0, len(x), BATCH)]).astype(np.float64)
    share = np.bincount(y, minlength=len(labels)).astype(float)
    ws = 1.0 / np.maximum(share[y], 1.0)
    ws /= ws.sum()
    target = np.where(y[:, None] == np.arange(len(labels)), 1.0, -1.0)
    gram = (k * ws[:, None]).T @ k + ridge * (z @ z.T).astype(np.float64) + 1e-9 * np.eye(len(chosen))
    model.weights = np.linalg.solve(gram, (k * ws[:, None]).T @ target)
    values = k @ model.weights
    grid = [1.0, 2.0, 4.0, 8.0, 16.0]
    losses = []
    for b in grid:
        model.beta = b
        losses.append(-np.sum(ws * np.log(np.maximum(model.probabilities(values)[np.arange(len(y)), y], 1e-12))))
    model.beta = grid[int(np.argmin(losses))]
    return model


def fit(docs: DataFrame, per_language: int = 400, total: int = 3000, languages: int = 300, longest: int = 50_000, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Learn from a sample of the learning fold in a fixed pseudo-random order. Documented bounds: the ``languages``
    most frequent labels, about ``per_language`` rows of each, at most 2 x ``total`` rows of at most ``longest``
    characters in all."""
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).alias("g")).where(common.learnable(F.col("d")) & F.col("g").isNotNull() & (F.char_length("t") <= longest))
    counts = {r["g"]: r["count"] for r in rows.groupBy("g").count().orderBy(F.col("count").desc(), "g").limit(languages).collect()}
    if not counts:
        return fit_texts([], [])
    each = max(8, min(per_language, total // len(counts)))
    share = F.create_map(*[F.lit(v) for g, n in sorted(counts.items()) for v in (g, min(1.0, each / n))])
    key = common.order_key(F.col("d"), F.col("t"))
    u = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(u < F.coalesce(F.try_element_at(share, F.col("g")), F.lit(0.0))).orderBy(key, "d", "t", "g").limit(2 * total).collect()
    got.sort(key=lambda r: (r["d"], r["t"], r["g"]))
    model = fit_texts([r["t"] for r in got], [r["g"] for r in got])
    del got
    common.give_back()
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score", likeness_col: str = "likeness") -> DataFrame:
    """The table with ``lang_col``, ``score_col`` and ``likeness_col``, from the whole text alone. The score compares
    the learned languages; the likeness does not depend on how many there are, and tells texts in none of them."""
    spark = docs.sparkSession
    common.text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, likeness double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            lang, score, likeness = shared.value.predict(s.tolist())
            yield pd.DataFrame({"lang": lang, "score": score, "likeness": likeness})

    (tmp,) = common.fresh(docs, "lid")
    new = {lang_col: "lang", score_col: "score", likeness_col: "likeness"}
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], udf(F.col(f"`{text}`")).alias(tmp))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"{tmp}.{f}").alias(n) for n, f in new.items()])
