"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows learned from at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 10_000
#: Buckets of hashed terms, terms kept as features, and size of a term's factor.
BUCKETS, FEATURES, FACTORS = 1 << 20, 4096, 6
#: Beginnings of words that are terms beside the whole words, so unseen forms of a word still count.
PREFIXES = (4, 5)
#: Standard errors by which a term's odds must differ between the labels to be a feature.
MIN_Z = 4.0
#: Standard errors by which a pair must tell more than its terms alone; there are millions of pairs.
MIN_PAIR_Z = 6.0
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
EPOCHS, BATCH, RATE = 12, 64, 0.03
#: Pull of the linear weights to 0, of the factors of a batch's terms to 0, and of the bias to the log odds of the sample.
#: 0 is a fixed point of a factor's gradient, so a strong pull ends the pair part of the machine.
DECAY, FACTOR_DECAY, BIAS_DECAY = 1e-5, 1e-5, 1e-2
_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    parts = ["=" + word, *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Terms:
    """Distinct terms of texts; words looked up before are remembered."""

    def __init__(self, feature_of: dict[int, int] | None = None):
        self.feature_of, self.known = feature_of, {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        found: set[int] = set()
        for word in set(_WORD.findall(text.lower())) if text else ():
            ids = self.known.get(word)
            if ids is None:
                ids = terms_of(word)
                if self.feature_of is not None:
                    ids = [self.feature_of[i] for i in ids if i in self.feature_of]
                self.known[word] = ids
            found.update(ids)
        return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class Machine:
    """Bias, linear weights and factors of the kept terms."""

    feature_of: dict[int, int]
    bias: float
    linear: np.ndarray
    factor: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        if not len(ids):
            return float(1 / (1 + np.exp(-self.bias)))
        v = self.factor[ids]
        z = self.bias + self.linear[ids].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _apart(yes: np.ndarray, no: np.ndarray, n_yes: float, n_no: float) -> np.ndarray:
    """Standard errors by which odds differ between the labels, of what stands in ``yes`` and ``no`` rows; rare things tell nothing."""
    odds = np.log((yes + 0.5) / (n_yes - yes + 0.5)) - np.log((no + 0.5) / (n_no - no + 0.5))
    error = np.sqrt(1 / (yes + 0.5) + 1 / (n_yes - yes + 0.5) + 1 / (no + 0.5) + 1 / (n_no - no + 0.5))
    return np.where(yes + no >= 3, np.abs(odds) / error, 0)


def pair_gains(rows: list[np.ndarray], label: np.ndarray, terms: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each of ``terms``, how many standard errors a pair with another of them tells more than both alone (``z``)."""
    place = np.full(BUCKETS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    # a bit for each row and term, and the counts of a few hundred terms at a time, as the driver is small
    bits = np.zeros((len(rows), (len(terms) + 7) // 8), np.uint8)
    for i, r in enumerate(rows):
        at, line = place[r], np.zeros(len(terms), bool)
        line[at[at >= 0]] = True
        bits[i] = np.packbits(line)
    gains, n_yes, n_no = np.zeros(len(terms)), label.sum(), len(label) - label.sum()
    for start in range(0, len(terms), 256):
        some = slice(start, start + 256)
        yes, no = np.zeros((2, len(terms[some]), len(terms)), np.float32)
        for count, of in ((yes, np.flatnonzero(label == 1)), (no, np.flatnonzero(label != 1))):
            for k in range(0, len(of), 500):
                block = np.unpackbits(bits[of[k : k + 500]], axis=1, count=len(terms)).astype(np.float32)
                count += block[:, some].T @ block
        for i in range(len(yes)):
            gain = _apart(yes[i].astype(float), no[i].astype(float), n_yes, n_no) - np.maximum(z[start + i], z)
            gain[start + i] = 0
            gains[start + i] = gain.max()
    return gains


def telling_terms(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Buckets whose odds differ most between the labels, then those that tell with another, then the most frequent."""
    yes, no = np.zeros((2, BUCKETS), np.int64)
    for r, y in zip(rows, label):
        (yes if y else no)[r] += 1  # the terms of a row are distinct
    n_yes, n_no = label.sum(), len(label) - label.sum()
    z = _apart(yes, no, n_yes, n_no)
    # a term of one label alone has a wide error; its count tells as well
    alone = np.where((no == 0) & (yes >= 6) | (yes == 0) & (no >= 40 * max(1.0, n_no / max(n_yes, 1))), MIN_Z, 0)
    z = np.maximum(z, alone)
    best = np.argsort(-z, kind="stable")[:FEATURES]
    best = best[z[best] >= MIN_Z]
    # a term of every row is a second bias
    often = np.where((yes + no >= 3) & (yes + no < len(label)), yes + no, 0)
    often = np.argsort(-often, kind="stable")[: np.count_nonzero(often)][:FEATURES]
    gains = pair_gains(rows, label, often, z[often])
    paired = often[np.argsort(-gains, kind="stable")][: np.count_nonzero(gains >= MIN_PAIR_Z)]
    every = np.concatenate([best, paired, often])
    return every[np.sort(np.unique(every, return_index=True)[1])][:FEATURES]


def fit(rows: list[np.ndarray], label: np.ndarray, seed: int = 5) -> Machine:
    """Train on terms and 0/1 labels by Adam on the log loss, in small batches."""
    kept = telling_terms(rows, label)
    feature_of = {int(b): i for i, b in enumerate(kept)}
    data = [np.array([feature_of[b] for b in r.tolist() if b in feature_of], np.int64) for r in rows]
    rng = np.random.default_rng(seed)
    share = (label.sum() + 0.5) / (len(label) + 1)
    n = max(1, len(kept))
    p = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(n), "v": rng.normal(0, 0.03, (n, FACTORS))}
    m, s = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    prior, step = p["b"].copy(), 0
    for _ in range(EPOCHS if len(label) else 0):
        for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // BATCH)):
            lengths = np.array([len(data[i]) for i in part])
            ids = np.concatenate([data[i] for i in part])
            of = np.repeat(np.arange(len(part)), lengths)
            v = p["v"][ids]
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, of, v)
            z = p["b"][0] + np.bincount(of, p["w"][ids], len(part)) + 0.5 * ((sums**2).sum(1) - np.bincount(of, (v**2).sum(1), len(part)))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)
            g = {"b": err.sum() + BIAS_DECAY * (p["b"] - prior), "w": np.bincount(ids, err[of], n) + DECAY * p["w"], "v": np.zeros_like(p["v"])}
            here = np.unique(ids)
            g["v"][here] = FACTOR_DECAY * p["v"][here]
            np.add.at(g["v"], ids, err[of, None] * (sums[of] - v))
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(feature_of, float(p["b"][0]), p["w"], p["v"])


def _terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    terms = Terms()
    for part in parts:
        yield pd.DataFrame({"label": part["label"], "terms": [terms(t) for t in part["text"]]})


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled rows outside the held-out quarter, in the order of a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "label")


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    sample = labelled_sample(docs, labels, "toxic", rows).mapInPandas(_terms, "label int, terms array<int>").toPandas()
    return fit([np.asarray(t, np.int32) for t in sample.pop("terms")], sample["label"].to_numpy(float))


def scorer(machine: Machine) -> Callable[[Column], Column]:
    """Column function from a text to its score."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(machine.feature_of)
        for part in parts:
            yield pd.Series([machine.score(terms(t)) for t in part], dtype=float)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    A score looks at nothing but the whole text. ``labels`` has doc_id and toxic; rows of the
    held-out quarter, null ids and null labels teach nothing, and of several labels of a
    document the largest counts. Null and empty texts hold no term and get the bias, the score
    of a text of which nothing is known. Without labels every score is one half of nothing
    seen, 0.5; an empty table gives an empty one. Equal texts get equal scores.
    """
    model = scorer(learn(docs, labels, rows))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), model(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
