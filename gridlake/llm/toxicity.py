"""Toxicity by nearest labelled examples.

Labelled examples, toxic and clean, are TF-IDF vectors over the whole vocabulary of words and word beginnings. A term's
weight is multiplied by how sharply it parts the classes (log odds behind a likelihood-ratio test, copies counted
once), never by less than ``FLOOR``: no term is left out, and no example. Examples lie in a block-max inverted index:
each list is cut where it passes from one block of examples to the next, and each piece keeps its largest weight. A
search sums these into an upper bound for every block, reads the blocks by falling bound and stops when no unread
block can enter the nearest k: the result is exact. The neighbours vote with cosine over distance, weighted back to the
classes' shares in the labels; a logistic curve fitted on votes across two halves of the examples makes the vote a
calibrated score, and the nearest are returned as evidence.

Defined cases: null and empty texts, and those that share no word with an example, get the vote of the toxic share;
a document with several labels counts as toxic if one says so, one id with several texts gives several examples;
labels other than 0 and 1 are left out; without labels every score is 0; equal cosines go to the smaller example.
Other columns are kept, and a column named like an output is replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, neardup

_WORD = re.compile(r"[^\W_]+")
#: Letters of a word's beginning, and the least weight of a term.
STEM, FLOOR = 5, 0.05
#: What is added to the distance 1 - cosine in a vote.
NEAR = 0.02


def features(word: str) -> tuple[str, ...]:
    """The word, and its beginning: that joins inflected forms of one stem."""
    return ("=" + word, "^" + word[:STEM]) if len(word) > STEM else ("=" + word,)


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def numbered(texts: list[str | None]) -> tuple[tuple[dict[str, int], dict[str, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """Numbers of all words and of all beginnings, in the order in which they are first seen, and each text's features
    and how often it has them: two small arrays a text, the strings are held once."""
    words: dict[str, int] = {}
    stems: dict[str, int] = {}
    out = []
    for t in texts:
        counts: dict[int, int] = {}
        for w, n in word_counts(t).items():
            i = words.setdefault(w, len(words) + len(stems))
            counts[i] = counts.get(i, 0) + n
            if len(w) > STEM:
                i = stems.setdefault(w[:STEM], len(words) + len(stems))
                counts[i] = counts.get(i, 0) + n
        out.append((np.fromiter(counts, dtype=np.int32, count=len(counts)), np.fromiter(counts.values(), dtype=np.int32, count=len(counts))))
    return (words, stems), out


def families(texts: list[str], bands: int = 12, rows: int = 4) -> list[int]:
    """Examples that are copies of each other, near copies included, count as one when terms are tested:
    else a text that is copied often would make all its words telling."""
    keys = neardup.text_keys(texts, 5, bands, rows, False)[0] if texts else []
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, row in enumerate(keys):
        for k in row:
            parent[root(i)] = root(first.setdefault(int(k), i))
    return [root(i) for i in range(len(texts))]


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and the number of the range that each belongs to."""
    n = stop - start
    of = np.repeat(np.arange(n.size), n)
    return np.arange(of.size) - (np.cumsum(n) - n)[of] + start[of], of


class BlockMaxIndex:
    """Inverted lists in pieces, one for each block of ``block`` examples that a term occurs in, with the piece's largest
    weight. Lists of terms that more than one of ``share`` examples has are kept as full rows instead: their part of the
    product is one matrix product for a whole batch of queries, and it enters the blocks' bounds exactly."""

    def __init__(self, rows: list[dict[int, float] | tuple[np.ndarray, np.ndarray]], terms: int, block: int = 64, share: int = 24) -> None:
        """rows: the weight of each term, or arrays of terms and of weights."""
        self.size, self.block = len(rows), block
        pairs = [(np.fromiter(r, np.int32, len(r)), np.fromiter(r.values(), np.float64, len(r))) if isinstance(r, dict) else r for r in rows]
        sizes = [t.size for t, _ in pairs]
        term = np.concatenate([np.zeros(0, dtype=np.int32), *(t for t, _ in pairs)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in pairs)])
        del pairs
        row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        often = np.flatnonzero(np.bincount(term, minlength=terms) > max(block, len(rows) // share)) if term.size else np.zeros(0, dtype=np.int64)
        #: row of ``full`` that a term has, or -1
        self.place = np.full(terms, -1, dtype=np.int32)
        self.place[often] = np.arange(often.size)
        dense = self.place[term] >= 0
        self.full = np.zeros((often.size, len(rows)))
        self.full[self.place[term[dense]], row[dense]] = weight[dense]
        term, weight, row = term[~dense], weight[~dense], row[~dense]
        order = np.lexsort((row, term))
        term, self.row, self.weight = term[order], row[order], weight[order]
        of_block = self.row // block
        begins = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (of_block[1:] != of_block[:-1])))) if term.size else np.zeros(0, dtype=np.int64)
        self.piece = np.append(begins, term.size)
        self.piece_block = of_block[begins]
        self.piece_top = np.maximum.reduceat(self.weight, begins) if begins.size else np.zeros(0)
        self.of_term = np.searchsorted(term[begins], np.arange(terms + 1))
        self.edges = np.arange(0, len(rows), block)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[int, float]]]:
        """For each query (terms, weights) the k rows of largest dot product over 0, equal ones by row number."""
        if not self.size:
            return [[] for _ in queries]
        often = np.zeros((len(queries), len(self.full)))
        for i, (terms, weights) in enumerate(queries):
            at = self.place[terms]
            often[i, at[at >= 0]] = weights[at >= 0]
        return [self._nearest(known, terms[rare], weights[rare], k) for known, (terms, weights) in zip(often @ self.full, queries) for rare in [self.place[terms] < 0]]

    def _nearest(self, known: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, float]]:
        """``known``: each row's product over the terms with full rows."""
        pieces, of = _ranges(self.of_term[terms], self.of_term[terms + 1])
        of_block, q = self.piece_block[pieces], weights[of]
        bound = np.maximum.reduceat(known, self.edges) + np.bincount(of_block, q * self.piece_top[pieces], minlength=self.edges.size)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_row, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, step = 0, 8
        while at < order.size and (best.size < k or bound[order[at]] >= best[-1] - 1e-9):
            visit = np.zeros(self.edges.size, dtype=bool)
            visit[order[at : at + step]] = True
            mine = visit[of_block]
            places, piece = _ranges(self.piece[pieces[mine]], self.piece[pieces[mine] + 1])
            acc = known + np.bincount(self.row[places], q[mine][piece] * self.weight[places], minlength=self.size)
            acc[~np.repeat(visit, self.block)[: self.size]] = 0
            if best.size == k:
                hit = np.flatnonzero(acc >= best[-1] - 1e-9)
            elif acc.size > 4 * k:
                hit = np.flatnonzero(acc >= max(1e-12, np.partition(acc, -k)[-k] - 1e-9))
            else:
                hit = np.flatnonzero(acc > 0)
            best_row, best = np.concatenate((best_row, hit)), np.concatenate((best, np.round(acc[hit], 12)))
            keep = np.lexsort((best_row, -best))[:k]
            best_row, best = best_row[keep], best[keep]
            at, step = at + step, step * 8
        return [(i, s) for i, s in zip(best_row.tolist(), best.tolist()) if s > 0]


@dataclass
class ToxicityModel:
    #: numbers of words, and of beginnings of longer words
    vocabulary: tuple[dict[str, int], dict[str, int]]
    weight: np.ndarray
    unseen: float
    index: BlockMaxIndex
    toxic: np.ndarray
    ids: list
    class_weight: tuple[float, float]
    base: float
    k: int = 15
    #: slope and offset of the logistic curve from a vote to a score
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of unit length; features that no example has count in the length."""
        words, stems = self.vocabulary
        long = [w for w in counts if len(w) > STEM]
        at = np.array([words.get(w, -1) for w in counts] + [stems.get(w[:STEM], -1) for w in long], dtype=np.int64)
        n = np.array([*counts.values(), *(counts[w] for w in long)], dtype=np.float64)
        known = at >= 0
        other = float((((1 + np.log(n[~known])) * self.unseen) ** 2).sum())
        terms, of = np.unique(at[known], return_inverse=True)
        v = (1 + np.log(np.bincount(of, n[known], minlength=terms.size))) * self.weight[terms]
        norm = math.sqrt(float(v @ v) + other)
        return terms, v / norm if norm else v

    def nearest(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        return self.index.search([self.vector(word_counts(t)) for t in texts], self.k)

    def vote(self, found: list[tuple[int, float]]) -> float:
        w = [min(s, 1.0) / (1 - min(s, 1.0) + NEAR) * self.class_weight[int(self.toxic[i])] for i, s in found]
        total = sum(w)
        return sum(x for x, (i, _) in zip(w, found) if self.toxic[i]) / total if total else self.base

    def score(self, texts: list[str | None], batch: int = 128) -> list[tuple[float, list[tuple]]]:
        """Score and three nearest examples of each text; equal texts are searched once."""
        if not self.ids:
            return [(0.0, [])] * len(texts)
        known: dict = {}
        todo = list(dict.fromkeys(texts))
        for at in range(0, len(todo), batch):
            for t, found in zip(todo[at : at + batch], self.nearest(todo[at : at + batch])):
                x = self.curve[0] * self.vote(found) + self.curve[1]
                known[t] = (1 / (1 + math.exp(-max(-40.0, min(40.0, x)))), [(self.ids[i], s) for i, s in found[:3]])
        return [known[t] for t in texts]


def _telling(df: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """For each feature how sharply a likelihood-ratio test ties it to a class: log odds, 1 from e^4 on; ``FLOOR`` for those that fail it."""
    out, total = np.full(df.shape[1], FLOOR), n[0] + n[1]
    often = np.flatnonzero(df[1] >= 3) if n[0] else np.zeros(0, dtype=np.int64)
    least = 2 * math.log(max(2, often.size)) + 4  # by chance, e^-2 of them pass
    for f, a, b in zip(often.tolist(), df[1][often].tolist(), df[0][often].tolist()):
        e = (a + b) * n[1] / total
        g = 2 * sum(o * math.log(o / x) for o, x in ((a, e), (b, a + b - e), (n[1] - a, n[1] - e), (n[0] - b, n[0] - (a + b - e))) if o > 0 and x > 0)
        if g >= least:
            out[f] = min(1.0, max(FLOOR, abs(math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))) / 4))
    return out


def _index(rows: list[tuple[object, str | None, int]], vocabulary: tuple[dict[str, int], dict[str, int]], counts: list[tuple[np.ndarray, np.ndarray]], family: list[int], share: tuple[float, float]) -> ToxicityModel:
    """The model of some rows; ``vocabulary`` numbers the features that they have, in the order in which they are first seen."""
    y = np.array([r[2] for r in rows], dtype=int)
    size = len(vocabulary[0]) + len(vocabulary[1])
    n = (len({f for f, l in zip(family, y) if l == 0}), len({f for f, l in zip(family, y) if l == 1}))
    df, each = np.zeros((2, size), dtype=np.int32), np.zeros(size, dtype=np.int32)
    by_family: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(family):
        by_family.setdefault((int(y[i]), f), []).append(i)
        each[counts[i][0]] += 1
    for (label, _), own in by_family.items():
        df[label][counts[own[0]][0] if len(own) == 1 else np.unique(np.concatenate([counts[i][0] for i in own]))] += 1
    total = len(rows)
    weight = np.array([math.log((total + 1) / (d + 1)) + 1 for d in range(total + 1)])[each] * _telling(df, n)
    at = [int((y == c).sum()) for c in (0, 1)]
    class_weight = tuple(share[c] * total / at[c] if at[c] else 0.0 for c in (0, 1))
    vectors = []
    for terms, often in counts:
        v = (1 + np.log(often.astype(np.float64))) * weight[terms]
        vectors.append((terms, v / math.sqrt(float(v @ v)) if v.size else v))
    # alike examples in one block: by label, then by their weightiest term
    lead = [int(terms[v == v.max()].max()) if v.size else -1 for terms, v in vectors]
    order = sorted(range(total), key=lambda i: (-y[i], lead[i], i))
    index = BlockMaxIndex([vectors[i] for i in order], size)
    return ToxicityModel(vocabulary, weight, FLOOR * (math.log(total + 1) + 1), index, y[order], [rows[i][0] for i in order], class_weight, share[1])


def _part(own: np.ndarray, vocabulary: tuple[dict[str, int], dict[str, int]], counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[tuple[dict[str, int], dict[str, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """Vocabulary and counts of some of the texts, numbered anew: what the others alone have is unseen there."""
    seen, first = np.unique(np.concatenate([np.zeros(0, dtype=np.int32), *(counts[i][0] for i in own)]), return_index=True)
    number = np.full(len(vocabulary[0]) + len(vocabulary[1]), -1, dtype=np.int32)
    number[seen[np.argsort(first)]] = np.arange(seen.size)
    named = tuple({w: j for w, i in v.items() if (j := int(number[i])) >= 0} for v in vocabulary)
    return named, [(number[counts[i][0]], counts[i][1]) for i in own]


def _curve(votes: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weighted logistic regression of the label on the vote, by Newton steps. A fiftieth of the weight lies on a
    toxic text whose vote is 1 and a clean one whose vote is 0: where examples give no such votes, copies still count."""
    votes, y, w = np.append(votes, (0.0, 1.0)), np.append(y, (0, 1)), np.append(w, [0.02 * w.sum()] * 2)
    x = np.column_stack((votes, np.ones(votes.size)))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta * w.sum()
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * w.sum() * np.eye(2), grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit_texts(rows: list[tuple[object, str | None, int]], share: tuple[float, float] | None = None) -> ToxicityModel:
    """rows: (id, text, label). share: the classes' shares among all labels, if the rows are a sample."""
    rows = sorted(rows, key=lambda r: (str(r[0]), r[1] or "", r[2]))
    y = np.array([r[2] for r in rows], dtype=int)
    vocabulary, counts = numbered([t for _, t, _ in rows])
    family = families([t or "" for _, t, _ in rows])
    share = share or ((float((y == 0).mean()), float((y == 1).mean())) if rows else (1.0, 0.0))
    # each half's votes on the other, families kept together, calibrate; each half's index goes before the next is made
    half = np.array([zlib.crc32(str(rows[f][0]).encode()) & 1 for f in family], dtype=int)
    votes, part, halves = np.zeros(len(rows)), None, False
    for h in (0, 1):
        own, others = np.flatnonzero(half == h), np.flatnonzero(half != h)
        if not own.size or len(set(y[own])) < 2 or not others.size:
            break
        del part
        part = _index([rows[i] for i in own], *_part(own, vocabulary, counts), [family[i] for i in own], share)
        for at in range(0, others.size, 128):
            some = others[at : at + 128]
            votes[some] = [part.vote(f) for f in part.nearest([rows[i][1] for i in some])]
    else:
        halves = bool(rows)
    del part
    model = _index(rows, vocabulary, counts, family, share)
    # too few examples to calibrate: 0.5 where half of the vote is toxic
    model.curve = _curve(votes, y, np.array([model.class_weight[c] for c in y])) if halves else (8.0, -4.0)
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 800, clean_rows: int = 1600, longest: int = 50_000, label: str = "toxic") -> ToxicityModel:
    """Learn from the learning fold. ``toxic_rows``, ``clean_rows`` and ``longest`` (characters) are the
    documented bounds of the labelled sample, rows of repeated ids included; which rows it takes follows a fixed
    pseudo-random order."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(common.learnable(F.col("doc_id")) & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not share:
        return fit_texts([])
    picks = [known.where(F.col("y") == c).orderBy(common.order_key(F.col("doc_id")), "doc_id").limit(n) for c, n in ((0, clean_rows), (1, toxic_rows))]
    sample = F.broadcast(picks[0].unionByName(picks[1]))  # at most clean_rows + toxic_rows rows of two numbers
    got = docs.select("doc_id", "text").where(F.coalesce(F.char_length("text"), F.lit(0)) <= longest).join(sample, "doc_id").select("doc_id", "text", "y")
    got = got.orderBy(common.order_key(F.col("doc_id"), F.col("text")), "doc_id", "text").limit(clean_rows + toxic_rows).collect()
    total = sum(share.values())
    rows = [(r["doc_id"], r["text"], r["y"]) for r in got]
    del got
    model = fit_texts(rows, (share.get(0, 0) / total, share.get(1, 0) / total))
    del rows
    common.give_back()
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", score_col: str = "score", evidence_col: str = "evidence") -> DataFrame:
    """The table with the score of each whole text and its three nearest examples."""
    spark = docs.sparkSession
    common.text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, ids array<string>, sims array<double>")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in parts:
            got = m.score(s.tolist())
            yield pd.DataFrame({"score": [g[0] for g in got], "ids": [[str(i) for i, _ in g[1]] for g in got], "sims": [[x for _, x in g[1]] for g in got]})

    (tmp,) = common.fresh(docs, "tox")
    keep = [c for c in docs.columns if c.lower() not in (score_col.lower(), evidence_col.lower())]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], udf(F.col(f"`{text}`")).alias(tmp))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col(f"{tmp}.score").alias(score_col), F.arrays_zip(F.col(f"{tmp}.ids").alias("doc_id"), F.col(f"{tmp}.sims").alias("cosine")).alias(evidence_col))
