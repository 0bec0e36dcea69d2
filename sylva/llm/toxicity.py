"""Toxicity grades by cumulative-link ordinal regression over sparse words.

A word has as features itself and its first letters (four to six), which stand for
the words made from one stem. The model is P(grade <= k) = s(theta_k - w x): one weight for each feature, shared by the
ordered thresholds theta_1 < theta_2 < theta_3. Expected severity is the sum of
P(grade >= k).

Training uses at most ``SAMPLE`` labelled rows (those of smallest hash). Their words
and stems are counted by class; all whose shares differ clearly become features
(log of one plus the count).

What severity means: labels only say toxic or not, and nothing in the tables says how
toxic. So toxic rows are graded 1 to 3 by the thirds of how many marked words occur in
them (a word is marked if one of its features is far more frequent in toxic rows). Only
the first threshold rests on labels; the others rank texts by how much of what
marks toxic ones they hold, and are no independent judgement of harm. Where graded
labels exist, ``train`` takes them: any ``toxic`` above 1 is used as the grade.

Defined results: a null or empty text has no words and gets the severity of an empty
feature vector; without toxic and clean labels severity is 0 and nothing is toxic;
labels that contradict each other count as the highest; of rows with one id the least
text counts in training; grades whose chances tie give the lower; repeated rows and equal
ids score each; very long texts are read whole; an empty table gives no rows; other
columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stage, tune

#: The most labelled rows that the model is fitted on.
SAMPLE = 20_000
#: Lengths of stems.
STEMS = (4, 5, 6)
#: Standard errors between the classes from which on a word is a feature.
APART = 5.0
GRADES = 3

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word, and a stem of each length that it is longer than."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def count_known(text_words: list[str], known: dict[str, int]) -> Counter:
    """How often each known feature occurs."""
    out: Counter = Counter()
    for word, n in Counter(text_words).items():
        for f in features(word):
            if (k := known.get(f)) is not None:
                out[k] += n
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one for each grade from 1 on
    #: P(grade >= 1) from which on a text counts as toxic
    cut: float = 0.5

    def severity(self, text: str | None) -> tuple[float, list[float]]:
        """Expected severity, and P(grade >= k) for each k."""
        count = count_known(words(text), self.vocabulary) if self.vocabulary else {}
        x = sum(self.weights[k] * np.log1p(n) for k, n in count.items())
        p = 1 / (1 + np.exp(np.clip(self.thresholds - x, -40, 40)))
        return float(p.sum()), p.tolist()


class Sparse:
    """A matrix by its entries: row, column, value."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.values, self.shape = rows, cols, values, shape

    @classmethod
    def of(cls, dense: np.ndarray) -> Sparse:
        rows, cols = np.nonzero(dense)
        return cls(rows, cols, dense[rows, cols], dense.shape)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transpose times ``g``."""
        return np.bincount(self.cols, self.values * g[self.rows], self.shape[1])


def loss(x: Sparse, y: np.ndarray, w: np.ndarray, cuts: np.ndarray, ridge: float = 1.0) -> float:
    """The mean of -log P(grade), and the penalty."""
    full = np.column_stack([np.zeros(len(y)), 1 / (1 + np.exp(-np.clip(cuts[None, :] - x.dot(w)[:, None], -40, 40))), np.ones(len(y))])
    p = np.maximum(full[np.arange(len(y)), y + 1] - full[np.arange(len(y)), y], 1e-12)
    return float(-np.log(p).mean() + ridge * (w @ w) / (2 * len(y)))


def fit(x: Sparse, y: np.ndarray, grades: int = GRADES, ridge: float = 1.0, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood with a ridge penalty, by Adam.
    The gaps between thresholds are exponentials, which keeps them in order."""
    n, m = x.shape
    w, theta, gaps = np.zeros(m), np.log((y < 1).mean() / (y >= 1).mean()), np.full(grades - 1, -1.0)
    first, second, rows = np.zeros(m + grades), np.zeros(m + grades), np.arange(n)
    for t in range(1, steps + 1):
        cuts = theta + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        # P(y <= k) at each row, with 0 before and 1 behind
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - x.dot(w)[:, None], -40, 40)))
        full = np.column_stack([np.zeros(n), below, np.ones(n)])
        slope = full * (1 - full)
        p = np.maximum(full[rows, y + 1] - full[rows, y], 1e-12)
        hi, lo = slope[rows, y + 1] / p, slope[rows, y] / p
        by_cut = np.array([hi[y == k].sum() - lo[y == k + 1].sum() for k in range(grades)]) / n
        grad_w = x.back(lo - hi) / n - ridge * w / n
        grad = np.concatenate([grad_w, [by_cut.sum()], [np.exp(g) * by_cut[k + 1 :].sum() for k, g in enumerate(gaps)]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, theta, gaps = w + move[:m], theta + move[m], gaps + move[m + 1 :]
    return w, theta + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def best_cut(p: np.ndarray, bad: np.ndarray) -> float:
    """The cut that catches the most toxic rows less clean ones, halfway (in log-odds)
    to the next row below."""
    order = np.argsort(-p, kind="stable")
    p, gain = p[order], np.cumsum(np.where(bad[order], 1, -1))
    last = np.append(p[1:] != p[:-1], True)  # rows of equal p go together
    k = int(np.flatnonzero(last)[np.argmax(gain[last])])
    below = p[k + 1] if k + 1 < len(p) else p[k]
    odds = np.log(np.clip([p[k], below], 1e-12, 1 - 1e-12) / (1 - np.clip([p[k], below], 1e-12, 1 - 1e-12)))
    return float(1 / (1 + np.exp(-odds.mean())))


def select_words(counts: DataFrame, n_toxic: int, n_clean: int, apart: float = APART) -> list[tuple[str, float, float]]:
    """(word, share of toxic rows, share of clean rows) of all that tell the classes
    apart, the most telling first. They come from the bounded sample."""
    a, b = F.col("toxic") / F.lit(n_toxic), F.col("clean") / F.lit(n_clean)
    pooled = (F.col("toxic") + F.col("clean")) / F.lit(n_toxic + n_clean)
    error = F.sqrt(pooled * (1 - pooled) * F.lit(1 / n_toxic + 1 / n_clean))
    z = F.when(error > 0, F.abs(a - b) / error).otherwise(0.0)
    rows = counts.filter("toxic + clean >= 5").select("word", a.alias("a"), b.alias("b"), z.alias("z")).filter(F.col("z") >= apart)
    return [(r["word"], r["a"], r["b"]) for r in rows.orderBy(F.desc("z"), "word").collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of ``docs``."""
    tune(docs.sparkSession)
    rows = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(chosen) if sample <= BROADCAST_ROWS else chosen

    @F.arrow_udf("array<string>")
    def word_column(texts: pa.Array) -> pa.Array:
        return pa.array([words(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def feature_column(lists: pa.Array) -> pa.Array:
        return pa.array([list({f: 0 for w in set(x) for f in features(w)}) for x in lists.to_pylist()], pa.list_(pa.string()))

    found = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").cast("int").alias("label"))
    held = stage(found.select("doc_id", "label", (F.col("label") > 0).alias("bad"), word_column("text").alias("words")), "labelled")
    sizes = {r["bad"]: r["n"] for r in held.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Model({}, np.zeros(0), np.zeros(0))
    once = held.select("bad", F.explode(feature_column("words")).alias("word"))
    counts = once.groupBy("word").agg(F.count_if("bad").alias("toxic"), F.count_if(~F.col("bad")).alias("clean"))
    telling = select_words(counts, sizes[True], sizes[False])
    vocabulary = {w: k for k, (w, _, _) in enumerate(telling)}
    marked = {w for w, a, b in telling if a > 5 * b}

    # only counts of the chosen words reach the driver, for the bounded sample
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = count_known(w, vocabulary)
                hits = sum(n for x, n in Counter(w).items() if not marked.isdisjoint(features(x)))
                out.append((label, hits, list(c), list(c.values())))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["label", "hits", "at", "n"])

    sampled = held.orderBy("doc_id").select("label", "words").mapInArrow(sparse, "label int, hits long, at array<int>, n array<int>").collect()
    hits, label = np.array([r["hits"] for r in sampled]), np.array([r["label"] for r in sampled])
    bad = label > 0
    held_by = np.repeat(np.arange(len(sampled)), [len(r["at"]) for r in sampled])
    cols, counted = (np.array([v for r in sampled for v in r[c]], np.int64) for c in ("at", "n"))
    x = Sparse(held_by, cols, np.log1p(counted), (len(sampled), len(vocabulary)))
    cuts = np.quantile(hits[bad], [k / GRADES for k in range(1, GRADES)])
    graded = (label > 1).any()
    y = np.clip(label, 0, GRADES) if graded else np.where(bad, 1 + (hits[:, None] > cuts[None, :]).sum(axis=1), 0)
    w, thresholds = fit(x, y)
    p = 1 / (1 + np.exp(np.clip(thresholds[0] - x.dot(w), -40, 40)))
    return Model(vocabulary, w, thresholds, best_cut(p, bad))


SCORES = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected severity, P(grade >= 1), the likeliest grade, and whether a
    text counts as toxic: from the cut on that tells the sample's classes apart best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                severity, p = model.severity(text)
                exact = [1 - p[0], *(a - b for a, b in zip(p, [*p[1:], 0.0]))] if p else [1.0]
                out.append((doc, severity, p[0] if p else 0.0, int(np.argmax(exact)), bool(p and p[0] >= model.cut)))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()))], names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORES)
