"""Near-duplicate vectors by an inverted multi-index and exact verification.

Every vector is scaled to length 1 and cut into two halves. Each half has a codebook of
its own, learned from a bounded sample, and the pairs of codewords make a product grid;
every vector is kept in the cell of its nearest codewords. A query visits cells in the
order of a lower bound of its distance to them: a vector of a cell is nearer to the
cell's codeword than to any other, so it lies beyond the plane half way between the two,
and the squared bounds of both halves add up. The visit ends at the bound ``reach``
beyond which a partner is not looked for. Reach is learned for a target recall: of
partners drawn in random directions at the very threshold, that share must lie in
visited cells (nearer ones need less). With a target of 1 reach is the radius of the threshold, which loses
nothing for certain. Of two cells the lower one's vectors visit the higher one, so a pair
is looked at once.

Members and visitors of a cell are compared in blocks of bounded size by one product of
matrices, on whole vectors in double precision. A block gives each vector's number of
links and a spanning forest of the links, never the pairs. Equal vectors are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_lookup, stored
from .minhash_dedup import components

THRESHOLD = 0.98
TARGET_RECALL = 0.999
#: Vectors, at most, from which codebooks and reach are learned; all vectors are indexed.
FIT_ROWS = 20_000
#: Partners, at least, that are drawn to learn reach.
DRAWS = 20_000
#: Mean rows of a cell that the size of the codebooks aims at, over all labels, and the largest codebook.
CELL_ROWS, MOST_WORDS = 64, 256
#: Rows of one block of a cell's members or visitors.
BLOCK = 1024


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.to_list(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codebook(half: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Distinct codewords of a half by Lloyd's rounds."""
    if not half.shape[1]:
        return np.zeros((1, 0))
    book = np.unique(half, axis=0)
    book = book[rng.permutation(len(book))[:words]]
    for _ in range(rounds):
        near = _squares(half, book).argmin(1)
        n = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, half)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return np.unique(book, axis=0)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * x @ book.T


def cell_bounds(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the squared lower bound of its distance to each codeword's region."""
    d = _squares(half, book)
    apart = np.sqrt(np.maximum(_squares(book, book), 0))
    np.fill_diagonal(apart, np.inf)
    bound = np.zeros_like(d)
    for w in range(len(book)):
        # 1e-9 makes up for rounding where codewords are very near to each other
        over = (d[:, w : w + 1] - d) / (2 * np.maximum(apart[w], 1e-12)) - 1e-9
        bound[:, w] = np.maximum(over.max(1), 0) ** 2
    return d.argmin(1), bound


class MultiIndex:
    """Two codebooks for each vector length, and the reach of a search."""

    def __init__(self, books: dict[int, tuple[np.ndarray, np.ndarray]], reach: dict[int, float], radius: float) -> None:
        self.books, self.reach, self.radius = books, reach, radius

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell of every unit vector and the bounds of both halves. A length without codebooks has one cell."""
        dim = x.shape[1]
        if dim not in self.books:
            return np.zeros(len(x), np.int64), np.zeros((len(x), 1)), np.zeros((len(x), 1))
        one, two = self.books[dim]
        near1, b1 = cell_bounds(x[:, : dim // 2], one)
        near2, b2 = cell_bounds(x[:, dim // 2 :], two)
        return near1 * len(two) + near2, b1, b2

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cells, and per vector the other cells within reach in the order of their bounds."""
        home, b1, b2 = self.bounds(x)
        limit = self.reach.get(x.shape[1], self.radius) ** 2
        visits = []
        for h, p, q in zip(home, b1, b2):
            i, j = np.flatnonzero(p <= limit), np.flatnonzero(q <= limit)
            total = p[i][:, None] + q[j][None, :]
            a, b = np.nonzero(total <= limit)
            cells = (i[a] * len(q) + j[b])[np.argsort(total[a, b], kind="stable")]
            visits.append(cells[cells != h])
        return home, visits


def learn(sample: list[np.ndarray], words: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL, seed: int = 7) -> MultiIndex:
    """Codebooks of ``words`` codewords a half from unit vectors, by length, and the reach for the target recall."""
    rng = np.random.default_rng(seed)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    index = MultiIndex({}, {}, radius)
    for x in sample:
        dim = x.shape[1]
        index.books[dim] = _codebook(x[:, : dim // 2], words, rng), _codebook(x[:, dim // 2 :], words, rng)
        if target >= 1 or dim < 2:
            continue
        need = []
        drawn = np.tile(x, (math.ceil(DRAWS / len(x)), 1))
        for at in range(0, len(drawn), 1000):
            part = drawn[at : at + 1000]
            side = rng.normal(size=part.shape)
            side -= (side * part).sum(1, keepdims=True) * part
            side /= np.sqrt((side * side).sum(1, keepdims=True))
            home, _, _ = index.bounds(threshold * part + math.sqrt(1 - threshold**2) * side)
            _, b1, b2 = index.bounds(part)
            two = b2.shape[1]
            row = np.arange(len(part))
            need.append(np.sqrt(b1[row, home // two] + b2[row, home % two]))
        index.reach[dim] = min(radius, float(np.quantile(np.concatenate(need), target)) + 1e-9)
    return index


def _placed(index):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, rows in part.groupby(part["vector"].map(len), sort=False):
                unit = _unit(rows["vector"])
                home, visits = index.value.traverse(unit)
                yield pd.DataFrame({"id": rows["id"], "h": rows["h"], "k": rows["k"], "label": rows["label"], "rows": rows["rows"],
                                    "dim": np.int32(unit.shape[1]), "unit": [u.tobytes() for u in unit], "home": home,
                                    "visits": [v[v > h] for v, h in zip(visits, home)]})

    return run


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    new = linked.any(1)
    child, parent = [], []
    while new.any():
        front = np.array([new.argmax()])
        new[front] = False
        while len(front):
            seen = np.flatnonzero(linked[front].any(0) & new)
            child.append(seen)
            parent.append(front[linked[np.ix_(front, seen)].argmax(0)])
            new[seen] = False
            front = seen
    return (np.concatenate(child), np.concatenate(parent)) if child else (np.empty(0, int), np.empty(0, int))


def _compared(threshold: float):
    """Links of one block: members with members of other parts (or all, on the diagonal), members with visitors."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
        side = part["part"].to_numpy()  # the member's block, or -1 for visitors
        linked = x @ x.T >= threshold
        same = side[:, None] == side[None, :]
        diagonal = part["i"].iat[0] == part["j"].iat[0]
        linked &= ~same | (side >= 0)[:, None] if diagonal else ~same
        np.fill_diagonal(linked, False)
        n = linked @ part["rows"].to_numpy(np.float64)
        child, parent = _forest(linked)
        own = [part[c].to_numpy() for c in ("id", "h", "k")]
        some = np.flatnonzero(n)
        a = np.concatenate([some, child])
        b = np.concatenate([some, parent])
        out = {f"a_{c}": v[a] for c, v in zip(("id", "h", "k"), own)} | {f"b_{c}": v[b] for c, v in zip(("id", "h", "k"), own)}
        # a row of a vector with itself carries its number of links, the others are edges
        return pd.DataFrame(out | {"n": np.concatenate([n[some], np.zeros(len(child))]).astype(np.int64)})

    return run


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Rows of every block (label, dim, cell, i, j): members of blocks i and j, or of i with a part of the visitors.

    The first part of the visitors is compared where i = j, part v elsewhere as j = -v.
    """
    cell = ["label", "dim", "cell"]
    base = placed.select("id", "h", "k", "label", "rows", "dim", "unit", F.col("home").alias("cell"))
    visits = placed.select("id", "h", "k", "label", "rows", "dim", "unit", F.explode("visits").alias("cell"))
    members = base.groupBy(cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    visitors = placed.select("label", "dim", F.explode("visits").alias("cell")).groupBy(cell).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    size = stored(members.join(visitors, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(0))), "cells")
    deal = lambda n: F.pmod(F.xxhash64("h", "k", "cell"), n).cast("int")

    base = base.join(size, cell).withColumn("part", deal(F.col("blocks")))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    more = F.when(F.col("parts") > 1, F.sequence(F.lit(-1), 1 - F.col("parts"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    base = base.withColumn("o", F.explode(F.concat(others, more)))
    base = base.withColumn("i", F.when(F.col("o") < 0, F.col("part")).otherwise(F.least("part", "o"))).withColumn(
        "j", F.when(F.col("o") < 0, F.col("o")).otherwise(F.greatest("part", "o")))
    visits = visits.join(size, cell).withColumn("v", deal(F.col("parts"))).withColumn("i", F.explode(others))
    visits = visits.withColumn("j", F.when(F.col("v") == 0, F.col("i")).otherwise(-F.col("v"))).withColumn("part", F.lit(-1))
    columns = [*cell, "i", "j", "part", "id", "h", "k", "rows", "unit"]
    return base.select(columns).union(visits.select(columns))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL,
                 fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label and one length link where their cosine in double precision reaches
    ``threshold``. Rows without id or label, and vectors that are null, empty or zero or hold null, NaN
    or infinite values, link with nothing and stay. n_links counts the other rows linked
    directly, equal vectors included; component_id is the smallest vec_id reachable, a row
    without id has none. Rows that repeat an id are vectors of their own; those that carry their
    component's id are kept. Ties cannot arise, an empty table gives an empty one, other columns are
    not looked at. A group of n near but unequal vectors costs n^2 products of vectors, in
    blocks of at most ``2 * block`` rows; equal ones cost nothing.
    """
    label = F.col("label").cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))  # one zero
    finite = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # 128 bits stand for label and vector; the vectors themselves are grouped
    h, k = F.xxhash64("label", "vector"), F.xxhash64(F.lit(1), "label", "vector")
    classes = stored(rows.where("usable").groupBy("label", "vector", h.alias("h"), k.alias("k")).agg(
        F.min("vec_id").alias("id"), F.count("*").alias("rows")), "vector-classes")

    count = classes.count()
    words = min(MOST_WORDS, 2 ** math.ceil(math.log2(max(4.0, math.sqrt(count / CELL_ROWS)))))
    share = min(1.0, fit_rows / max(1, count))
    drawn = classes.where(F.pmod(F.col("k"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vector").limit(fit_rows).toPandas()["vector"]
    sample = [_unit(part) for _, part in drawn.groupby(drawn.map(len))] if len(drawn) else []
    index = classes.sparkSession.sparkContext.broadcast(learn(sample, words, threshold, target))
    placed = "id long, h long, k long, label string, rows long, dim int, unit binary, home long, visits array<long>"
    placed = stored(classes.select("id", "h", "k", "label", "rows", "vector").mapInPandas(_placed(index), placed), "placed-vectors")
    index.destroy()

    made = "a_id long, a_h long, a_k long, b_id long, b_h long, b_k long, n long"
    found = _blocks(placed, block).groupBy("label", "dim", "cell", "i", "j").applyInPandas(_compared(threshold), made)
    node = lambda x: F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_h").alias("h"), F.col(f"{x}_k").alias("k"))
    found = stored(found.select(node("a").alias("a"), node("b").alias("b"), "n"), "vector-links")
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("links")).select("a.h", "a.k", "links")
    roots = components(found.where("n = 0").select("a", "b"), "vector-components").select("node.h", "node.k", F.col("root.id").alias("root"))

    known = classes.select("h", "k", "id", "rows").join(links, ["h", "k"], "left").join(roots, ["h", "k"], "left")
    known = stored(known.select("h", "k", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"),
                                F.coalesce("root", "id").alias("component_id"), "rows"), "vector-facts")
    ids = stored(rows.select("vec_id", "usable", h.alias("h"), k.alias("k")), "vector-ids")
    out = heavy_lookup(ids.where("usable"), known, ["h", "k"], "rows").select("vec_id", "n_links", "component_id")
    alone = ids.where("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
