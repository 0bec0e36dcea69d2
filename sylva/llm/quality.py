"""Quality classifier: document evidence with hierarchical empirical Bayes.

1. A logistic model of surface features gives each document a log-odds score. It is
   fitted on at most ``SAMPLE`` labelled rows (those of smallest hash).
2. Scores are added up by site (host, path) and by host, with grouped aggregation over
   all documents. The strength of each prior comes from the spread of the groups by
   the method of moments: hosts shrink towards the global rate, paths towards their
   host, the more the fewer documents they have.
3. A document's posterior adds its own evidence to the log-odds of its path without
   the document itself. It is kept from ``KEEP`` on.

Sites are any two columns, the path below the host. ``site_columns`` makes them from
a URL; ``documents`` has none, so there ``source`` stands for the host and ``lang`` for
the path.

Defined results: a null or blank text is rejected with probability 0; a null host or
path is a site like any other; without labels of both classes the document evidence
is nil and all but blank texts are kept; repeated rows and equal ids count and score
each; labels that contradict each other count as the lower; a posterior of exactly the
cut is kept; very long texts are read whole; an empty table gives no rows; extra columns
stay in ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, broadcast_if_small, free_name, stage, tune

#: The most labelled rows that the model is fitted on.
SAMPLE = 20_000
KEEP = 0.5
#: Evidence of one document is held within these log-odds.
MOST = 12.0

FEATURES = ["log_words", "upper", "digits", "symbols", "marks", "bars", "blanks", "beyond_ascii", "word_length", "variety", "repeats", "line_repeats", "short_lines"]

_SYMBOLS = np.frombuffer(b"#$%&*<=>@^_`~{}[]\\+/", np.uint8)
_MARKS = np.frombuffer(b"!?;:", np.uint8)


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, words and lines over the whole text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, letters, lines = len(raw), max(1, int(count[65:91].sum() + count[97:123].sum())), text.split("\n")
    n_words = len(words)
    return [
        math.log(n_words),
        float(count[65:91].sum()) / letters,
        float(count[48:58].sum()) / n,
        float(count[_SYMBOLS].sum()) / n,
        float(count[_MARKS].sum()) / n,
        float(count[124]) / n,
        float(count[32] + count[9] + count[10]) / n,
        float(count[128:].sum()) / n,
        min(40.0, len(text) / n_words) / 10,
        math.log(len(set(words)) + 1) / math.log(n_words + 1),
        sum(map(str.__eq__, words, words[1:])) / n_words,
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
    ]


@F.arrow_udf(T.ArrayType(T.FloatType()))
def feature_column(texts: pa.Array) -> pa.Array:
    return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float32()))


@dataclass
class Scorer:
    """A fitted logistic model; ``rate`` is the share of good rows in the sample."""

    weights: list[float]
    bias: float
    rate: float

    def evidence(self, x: Column) -> Column:
        """Log-odds that a document adds to those of the sample."""
        terms = [F.lit(w) * x[k].cast("double") for k, w in enumerate(self.weights) if w]
        total = F.lit(self.bias)
        for t in terms:
            total = total + t
        return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), total))


def site_columns(url: Column) -> tuple[Column, Column]:
    """Host and path of a site: the host in lower case, and the first part of the path."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^/?#]*)(?=/)", 1)
    return F.when(host != "", host), F.when(host != "", F.when(path == "", "/").otherwise(path))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Scorer:
    """Newton's method on standardised features, with a ridge penalty."""
    if len(y) == 0 or y.min() == y.max():
        return Scorer([0.0] * len(FEATURES), 0.0, 0.5)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = np.inf
    z = np.column_stack([(x - mean) / spread, np.ones(len(y))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    rate = float(y.mean())
    weights = w[:-1] / spread
    return Scorer(weights.tolist(), float(w[-1] - (weights * mean).sum() - _logit(rate)), rate)


def train(featured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Fit on at most ``sample`` rows of (doc_id, x) that have a label."""
    rows = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(chosen) if sample <= BROADCAST_ROWS else chosen
    # one row an id, so that the bound holds
    found = featured.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality")).orderBy("doc_id").toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    return fit(x, (found["quality"].to_numpy() > 0).astype(float))


SITE = ["host", "path", "n", "good", "host_rate", "strength"]


@dataclass
class Sites:
    """Posterior sums of all sites, and the rate of everything."""

    table: DataFrame  # host, path, n, good, host_rate, strength
    rate: float


def _strength(groups: DataFrame, rate: Column) -> float:
    """Pseudo-documents of a Beta prior about ``rate``, by moments over groups
    (n, good): the spread of their rates beyond what sampling explains."""
    n, good = F.col("n"), F.col("good")
    q = rate * (1 - rate)
    row = groups.agg(F.sum(n * F.pow(good / n - rate, 2)).alias("spread"), F.sum(q).alias("noise"), F.sum(n * q).alias("most"), F.sum(n).alias("n")).first()
    if not row["n"]:
        return 1.0
    between, most = (row["spread"] - row["noise"]) / row["n"], row["most"] / row["n"]
    if most <= 1e-12:
        return 1e4
    return float(min(1e4, max(1.0, most / between - 1))) if between > 0 else 1e4


def sites(scored: DataFrame) -> Sites:
    """From (host, path, p) of all documents."""
    table = stage(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("good")), "sites")
    total = table.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(1 - 1e-6, max(1e-6, total["good"] / total["n"])) if total["n"] else 0.5
    hosts = stage(table.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    strength = _strength(hosts, F.lit(rate))
    ruled = hosts.select(F.col("host").alias("of"), ((F.lit(strength * rate) + F.col("good")) / (strength + F.col("n"))).alias("host_rate"))
    joined = stage(table.join(broadcast_if_small(ruled), F.col("host").eqNullSafe(F.col("of"))).drop("of"), "sites")
    return Sites(joined.withColumn("strength", F.lit(_strength(joined, F.col("host_rate")))), rate)


def posterior(evidence: Column, p: Column, site: dict[str, Column]) -> tuple[Column, Column]:
    """The rate of a document's path without the document, and its own log-odds."""
    rate = (site["strength"] * site["host_rate"] + site["good"] - p) / (site["strength"] + site["n"] - 1)
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate))
    return rate, evidence + F.log(rate / (1 - rate))


def _probability(evidence: Column, rate: float) -> Column:
    return 1 / (1 + F.exp(-(evidence + F.lit(_logit(min(1 - 1e-6, max(1e-6, rate)))))))


def _featured(docs: DataFrame, host: str, path: str) -> DataFrame:
    """(doc_id, host, path, x): what a pass over the texts leaves behind."""
    tune(docs.sparkSession)
    return stage(docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), feature_column(F.col("text")).alias("x")), "features")


def _is_blank(x: Column) -> Column:
    """Only a text without words has no mean length of words."""
    return x[FEATURES.index("word_length")] == 0


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, p_quality, keep of every row."""
    rows = _featured(docs, host, path)
    model = train(rows, labels, sample)
    e = model.evidence(F.col("x"))
    scored = rows.select("doc_id", "host", "path", _is_blank(F.col("x")).alias("blank"), e.alias("evidence"), _probability(e, model.rate).alias("p"))
    found = sites(scored)
    site = {c: f"site_{c}" for c in SITE}
    table = found.table.select(*[F.col(c).alias(n) for c, n in site.items()])
    joined = scored.join(broadcast_if_small(table), F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    path_rate, odds = posterior(F.col("evidence"), F.col("p"), {c: F.col(n) for c, n in site.items()})
    p = F.when(F.col("blank"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-odds)))
    return joined.select("doc_id", "evidence", F.col("site_host_rate").alias("host_rate"), path_rate.alias("path_rate"), p.alias("p_quality"), (p >= keep).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. What a pass over the texts
    finds is staged beside them, so that texts are read once."""
    tune(docs.sparkSession)
    x = free_name(docs, "_x")
    held = stage(docs.withColumn(x, feature_column(F.col("text"))), "featured")
    rows = held.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), F.col(x).alias("x"))
    model = train(rows, labels, sample)
    e = model.evidence(F.col("x"))
    found = sites(rows.select("host", "path", _probability(e, model.rate).alias("p")))
    names = {c: free_name(docs, f"_{c}") for c in SITE}
    table = found.table.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = held.join(broadcast_if_small(table), F.col(host).eqNullSafe(F.col(names["host"])) & F.col(path).eqNullSafe(F.col(names["path"])))
    e = model.evidence(F.col(x))
    _, odds = posterior(e, _probability(e, model.rate), {c: F.col(n) for c, n in names.items()})
    return joined.filter(~_is_blank(F.col(x)) & (odds >= _logit(keep))).select(*[F.col(f"`{c}`") for c in docs.columns])
