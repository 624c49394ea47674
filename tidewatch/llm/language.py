"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

#: Bytes of a window, widths of the filters, and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: Rows per language learned from at most, rows in all, and windows of a row.
ROWS_PER_LANG, TRAIN_ROWS, WINDOWS_PER_ROW = 400, 20_000, 2
EPOCHS, BATCH, RATE = 6, 64, 0.02
#: Windows that are looked at together.
AT_ONCE = 256
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows_of(text: str) -> np.ndarray:
    """The whole text as rows of ``WINDOW`` bytes, A-Z lower-cased; the last row ends in zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    """``filters[w][j]`` has a row of filter weights for each byte at place j of width w."""

    langs: list[str]
    filters: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """Per width, (place, whether of two bytes, summed weights): two neighbouring bytes are one lookup."""
        out = []
        for w, f in zip(WIDTHS, self.filters):
            pairs = [(j, True, (f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            out.append(pairs + ([(w - 1, False, f[w - 1])] if w % 2 else []))
        return out

    def probabilities(self, rows: np.ndarray, tables: list) -> np.ndarray:
        two = rows[:, :-1].astype(np.intp) * 256 + rows[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables):
            n = WINDOW - w + 1
            z = sum(np.take(t, (two if pair else rows)[:, j : j + n], axis=0) for j, pair, t in parts)
            pooled.append(z.max(1))
        return softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.dense + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: np.ndarray, label: np.ndarray, langs: list[str], seed: int = 3) -> Network:
    """Train by Adam on the log loss; max pooling sends a gradient to one place per filter."""
    rng = np.random.default_rng(seed)
    n, classes = len(rows), len(langs)
    p = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    p += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32), np.zeros(classes, np.float32)]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            x, y = rows[part], label[part]
            at, pooled = [], []
            for f, w in zip(p, WIDTHS):
                length = WINDOW - w + 1
                z = sum(f[j][x[:, j : j + length]] for j in range(w))
                a = z.argmax(1)
                at.append(a)
                pooled.append(np.take_along_axis(z, a[:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, 1)
            act = np.maximum(h, 0)
            err = softmax(act @ p[-2] + p[-1])
            err[np.arange(len(part)), y] -= 1
            err /= len(part)
            back = (err @ p[-2].T) * (h > 0)
            grads = []
            for k, (w, a) in enumerate(zip(WIDTHS, at)):
                g = np.zeros_like(p[k])
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (x[np.arange(len(part))[:, None], a + j], np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [act.T @ err, err.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g**2 - s[k])
                p[k] -= (RATE / (1 + step / 200) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return Network(langs, p[:-2], p[-2], p[-1])


def _sampled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        langs, rows = [], []
        for text, lang in zip(part["text"], part["lang"]):
            w = windows_of(text)
            rng = np.random.default_rng(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
            for i in rng.permutation(len(w))[:WINDOWS_PER_ROW]:
                langs.append(lang)
                rows.append(w[i].tobytes())
        yield pd.DataFrame({"lang": langs, "bytes": rows})


def learn(docs: DataFrame, per_lang: int = ROWS_PER_LANG, rows: int = TRAIN_ROWS) -> Network | None:
    """Train on windows of at most ``per_lang`` rows of each language and ``rows`` in all, in hash order of the text."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("lang is not null and text <> ''").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    place = F.xxhash64("doc_id", F.length("text"))
    # ids first: the window deals narrow rows, and keeps only the first of each task
    ids = known.select("doc_id", "lang", place.alias("place"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("r") <= per_lang)
    ids = ids.orderBy("r", "lang").limit(rows).select("doc_id", "lang", "place").distinct()
    sample = known.withColumn("place", place).join(F.broadcast(ids), ["doc_id", "lang", "place"])
    # rows that repeat an id, language and length are one, so the bound on ids bounds the rows
    sample = sample.groupBy("doc_id", "lang", "place").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = sample.select("text", "lang").mapInPandas(_sampled, "lang string, bytes binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "bytes"], ignore_index=True)
    langs = sorted(got["lang"].unique())
    data = np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(-1, WINDOW)
    return fit(data, got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), langs)


def _predicted(network: Network | None):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = network.tables() if network else []
        for part in parts:
            pred, score = [UNKNOWN] * len(part), np.zeros(len(part))
            texts = [(i, t) for i, t in enumerate(part) if t and network and _LETTER.search(t)]
            total = np.zeros((len(part), len(network.langs) if network else 0))
            wait, of, held = [], [], 0

            def flush() -> None:
                if wait:
                    rows, at = np.concatenate(wait), np.repeat(of, [len(w) for w in wait])
                    for k in range(0, len(rows), AT_ONCE):
                        np.add.at(total, at[k : k + AT_ONCE], network.probabilities(rows[k : k + AT_ONCE], tables))
                wait.clear()
                of.clear()

            for i, text in texts:
                w = windows_of(text)
                wait.append(w)
                of.append(i)
                held += len(w)
                if held > 4096:
                    flush()
                    held = 0
            flush()
            for i, _ in texts:
                share = total[i] / total[i].sum()
                pred[i], score[i] = network.langs[int(share.argmax())], float(share.max())
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang_pred string, score double")


def languages(docs: DataFrame, per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    A prediction looks at nothing but the whole text, cut into windows of ``WINDOW`` bytes;
    the mean of the windows' softmax is the score. Rows of the held-out quarter, null
    languages and texts without a letter teach nothing. A text that is null or has no letter is
    ``und`` with score 0; so is every text where nothing can be learned. Equal texts get
    equal predictions, and an empty table gives an empty one.
    """
    model = _predicted(learn(docs, per_lang))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), model(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
