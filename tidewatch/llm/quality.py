"""Quality by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows and rows without a label learned from at most, in hash order of their ids.
TRAIN_ROWS, POOL_ROWS = 10_000, 5_000
#: Rounds of exchange, rows a view labels in a round, and the confidence it needs.
ROUNDS, EXCHANGE, SURE = 4, 400, 0.97
#: Share of labelled rows set aside to calibrate and combine the views.
CALIBRATE = 0.25
#: Quantile bins of a number, hash buckets of a source or language.
BINS, BUCKETS = 8, 64
#: Score below which a document is rejected.
THRESHOLD = 0.5
TEXT = ("words", "distinct", "top", "adjacent", "upper", "symbols", "digits", "pipes", "marks", "length", "long_words", "short_lines", "doubled")
META = ("chars", "lines", "line_length")
_DOUBLED = re.compile(r"([^\w\s])\1")


def text_numbers(text: str | None) -> list[float]:
    """The numbers of ``TEXT`` over the whole text; 0 for each where there is no word."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(TEXT)
    n, chars = len(words), len(text)
    ascii_bytes = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    count = Counter(words)
    letters = sum(map(len, words))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    symbols = int(ascii_bytes[33:48].sum() + ascii_bytes[58:65].sum() + ascii_bytes[91:97].sum() + ascii_bytes[123:127].sum())
    lines = text.split("\n")
    return [
        np.log1p(n), len(count) / n**0.9, max(count.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, upper / n,
        symbols / letters, int(ascii_bytes[48:58].sum()) / letters, int(ascii_bytes[124]) / n,
        int(ascii_bytes[33] + ascii_bytes[35] + ascii_bytes[36] + ascii_bytes[37] + ascii_bytes[38] + ascii_bytes[42]) / n, letters / n,
        sum(len(w) > 20 for w in words) / n, sum(len(x) < 20 for x in lines) / len(lines), len(_DOUBLED.findall(text)) / chars,
    ]


def meta_numbers(chars: float | None, text: str | None) -> list[float]:
    """The numbers of ``META``: the table's own character count and the page's layout."""
    lines = (text or "").count("\n") + 1
    chars = 0.0 if chars is None or chars != chars else float(chars)
    return [np.log1p(max(0.0, chars)), np.log1p(lines), np.log1p(max(0.0, chars) / lines)]


def bucket(kind: str, value: str | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}={value}".encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class View:
    """A logistic model over one-hot bins of numbers and one-hot hash buckets."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def columns(self, numbers: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        bins = (numbers[:, :, None] > self.edges[None, :, :]).sum(2)
        at = bins + np.arange(numbers.shape[1]) * BINS
        return np.concatenate([at, buckets + numbers.shape[1] * BINS + np.arange(buckets.shape[1]) * BUCKETS], 1)

    def logit(self, numbers: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return self.weights[self.columns(numbers, buckets)].sum(1) + self.bias

    def calibrated(self, numbers: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return self.scale[0] * self.logit(numbers, buckets) + self.scale[1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quantile_edges(numbers: np.ndarray) -> np.ndarray:
    """Borders of the bins, closer together at both ends of a number's range."""
    at = [0.02, 0.07, 0.15, 0.5, 0.85, 0.93, 0.98]
    return np.quantile(numbers, at, axis=0).T if len(numbers) else np.zeros((numbers.shape[1], BINS - 1))


def fit_view(numbers: np.ndarray, buckets: np.ndarray, label: np.ndarray, edges: np.ndarray, rounds: int = 150) -> View:
    """Logistic regression by full-batch Adam with weight decay."""
    view = View(edges, np.zeros(numbers.shape[1] * BINS + buckets.shape[1] * BUCKETS), 0.0)
    if not len(label):
        return view
    cols = view.columns(numbers, buckets)
    w, b = view.weights, 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        err = sigmoid(w[cols].sum(1) + b) - label
        g = np.bincount(cols.ravel(), np.repeat(err, cols.shape[1]), len(w)) / len(label) + 3e-4 * w
        gb = err.mean()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        w = w - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        b -= 0.15 * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-8)
    view.weights, view.bias = w, float(b)
    return view


def logistic(x: np.ndarray, label: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights and bias (last) of a small logistic regression, by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 30)):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - label) + 1e-2 * w)
    return w


@dataclass
class CoTrained:
    text: View
    meta: View
    mix: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros((len(text), 0), int)
        a, b = self.text.calibrated(text, none), self.meta.calibrated(meta, buckets)
        return sigmoid(a), sigmoid(b), sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def co_train(known: tuple, label: np.ndarray, pool: tuple, seed: int = 11) -> CoTrained:
    """Train the views on (text, meta, buckets) arrays; each round, a view's surest pool rows teach the other."""
    rng = np.random.default_rng(seed)
    aside = rng.random(len(label)) < CALIBRATE
    text, meta, buckets = known
    none = lambda n: np.zeros((n, 0), int)
    edges = quantile_edges(np.concatenate([text, pool[0]])), quantile_edges(np.concatenate([meta, pool[1]]))
    own = ~aside
    # per view: rows of the pool it learns from, and their pseudo-labels
    given: list[dict[int, float]] = [{}, {}]

    def trained() -> tuple[View, View]:
        views = []
        for v in range(2):
            rows = np.fromiter(given[v], int, len(given[v]))
            extra = np.fromiter(given[v].values(), float, len(given[v]))
            x = np.concatenate([known[v][own], pool[v][rows]])
            tags = np.concatenate([buckets[own], pool[2][rows]]) if v else none(len(x))
            views.append(fit_view(x, tags, np.concatenate([label[own], extra]), edges[v]))
        return views[0], views[1]

    views = trained()
    for _ in range(ROUNDS if len(pool[0]) and len(label) else 0):
        logits = views[0].logit(pool[0], none(len(pool[0]))), views[1].logit(pool[1], pool[2])
        for teacher, learner in ((0, 1), (1, 0)):
            p = sigmoid(logits[teacher])
            new = [i for i in np.argsort(-np.abs(p - 0.5), kind="stable").tolist() if i not in given[learner] and max(p[i], 1 - p[i]) >= SURE]
            # in the proportion the teacher sees them, so the learner's prior stays
            for side in (0, 1):
                part = [i for i in new if (p[i] > 0.5) == side]
                share = np.mean((p > 0.5) == side)
                for i in part[: round(EXCHANGE * share)]:
                    given[learner][i] = float(side)
        views = trained()
    if aside.any() and 0 < label[aside].sum() < aside.sum():
        views[0].scale = tuple(logistic(views[0].logit(text[aside], none(aside.sum()))[:, None], label[aside]))
        views[1].scale = tuple(logistic(views[1].logit(meta[aside], buckets[aside])[:, None], label[aside]))
        both = np.stack([views[0].calibrated(text[aside], none(aside.sum())), views[1].calibrated(meta[aside], buckets[aside])], 1)
        mix = logistic(both, label[aside])
    else:
        mix = np.array([1.0, 1.0, 0.0])
    return CoTrained(views[0], views[1], mix)


def _features(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = np.array([text_numbers(t) for t in part["text"]]).reshape(-1, len(TEXT))
    meta = np.array([meta_numbers(c, t) for c, t in zip(part["n_chars"], part["text"])]).reshape(-1, len(META))
    tags = np.array([[bucket("s", s), bucket("l", x)] for s, x in zip(part["source"], part["lang"])], int).reshape(-1, 2)
    return text, meta, tags


def _feature_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        text, meta, tags = _features(part)
        yield pd.DataFrame({"place": part["place"], "label": part["label"], "text": list(text), "meta": list(meta), "tags": list(tags.astype(np.int32))})


def _base(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "double"}
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, pool_rows: int = POOL_ROWS) -> CoTrained:
    """Train on bounded samples, drawn by hash; the held-out quarter of the labels teaches nothing."""
    base = _base(docs)
    tagged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    tagged = tagged.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    place = F.xxhash64("doc_id")
    known = tagged.where(~held_out(F.col("doc_id"))).orderBy(place, "doc_id").limit(rows)
    free = base.select("doc_id").where("doc_id is not null").join(tagged, "doc_id", "left_anti").orderBy(place, "doc_id").limit(pool_rows)
    drawn = known.union(free.select("doc_id", F.lit(None).cast("int")))
    got = base.join(F.broadcast(drawn), "doc_id").withColumn("place", F.xxhash64("doc_id", F.length("text")))
    got = got.drop("doc_id").mapInPandas(_feature_rows, "place long, label double, text array<double>, meta array<double>, tags array<int>").toPandas()
    got = got.sort_values(["place"], kind="stable", ignore_index=True)
    stack = lambda part: (np.array(part["text"].tolist()).reshape(-1, len(TEXT)), np.array(part["meta"].tolist()).reshape(-1, len(META)), np.array(part["tags"].tolist(), int).reshape(-1, 2))
    labelled = got["label"].notna()
    return co_train(stack(got[labelled]), got.loc[labelled, "label"].to_numpy(float), stack(got[~labelled]))


def with_quality(docs: DataFrame, model: CoTrained) -> DataFrame:
    """``docs`` with a struct column __quality of text_score, meta_score and score."""
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, source, lang, chars in parts:
            a, b, both = model.score(*_features(pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": chars})))
            yield pd.DataFrame({"text_score": a, "meta_score": b, "score": both})

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    score = F.pandas_udf(run, "text_score double, meta_score double, score double")
    return docs.withColumn("__quality", score(F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang, n_chars): doc_id, held_out, text_score, meta_score, score, kept.

    Scores are the calibrated chance of label 1, by the text alone, by the metadata
    alone, and by both; a document with a score of at least ``threshold`` is kept. Null metadata
    is a value of its own, a null n_chars counts as 0, null and empty texts have all
    numbers 0 and are scored like others. ``labels`` has doc_id and quality; null ids and
    labels teach nothing, of several labels of a document the smallest counts, and without labels every
    score is 0.5. Equal rows get equal scores; an empty table gives an empty one.
    """
    scored = with_quality(_base(docs), learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__quality.*", (F.col("__quality.score") >= threshold).alias("kept"))
