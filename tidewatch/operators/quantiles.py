"""Exact quantiles of many columns and probabilities in two scans.

The first scan counts every column and keeps one mergeable rank sketch of it, which
proposes a bracket around each wanted rank. The second scan counts what lies below each
bracket and collapses what lies inside to (value, count). The counts are the proof: a
rank is read only where the bracket holds it, else that column's bracket becomes its whole range and the scan is made
again for it. Collapsed values are dealt to ordered ranges of bounded size, and running sums with
the ranges' offsets give the ranks, so no task holds a column's values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import c
from ..functions.numeric import finite
from .prefix import ordered_parts, prefix_sums

#: Reciprocal of the rank error of the sketch, as a share of the rows.
SKETCH = 10_000


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], sketch: int = SKETCH) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column over its present values, exact; None for a column without values."""
    values = df.select(*[finite(c(n)).alias(f"v{i}") for i, n in enumerate(columns)])
    spread = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-2.0 / sketch, 2.0 / sketch)]
    seen = values.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.percentile_approx(f"v{i}", spread, sketch).alias(f"s{i}") for i in range(len(columns))],
    ).first()
    wanted = []
    for i in range(len(columns)):
        for j, p in enumerate(probs):
            if seen[f"n{i}"]:
                at = p * (seen[f"n{i}"] - 1)
                wanted.append({"col": i, "prob": j, "rank": math.floor(at), "frac": at - math.floor(at), "n": seen[f"n{i}"],
                               "lo": seen[f"s{i}"][2 * j], "hi": seen[f"s{i}"][2 * j + 1]})
    out: list[list[float | None]] = [[None] * len(probs) for _ in columns]
    todo = wanted
    while todo:
        found = _ranked(values, todo)
        again = []
        for k, t in enumerate(todo):
            low, high = found.get(k, (None, None))
            if low is None or (high is None and t["rank"] + 1 < t["n"] and t["frac"]):
                again.append(t | {"lo": -math.inf, "hi": math.inf})
            else:
                out[t["col"]][t["prob"]] = low if not t["frac"] else low + (high - low) * t["frac"]
        todo = again
    return dict(zip(columns, out))


def _ranked(values: DataFrame, wanted: list[dict]) -> dict[int, tuple[float | None, float | None]]:
    """Values at rank and rank + 1 (0-based) of each target, None where its bracket does not hold the rank.

    A value below the bracket is counted under no value, which sorts first.
    """
    cells = [
        F.when(F.col(f"v{t['col']}") <= t["hi"], F.struct(F.lit(k).alias("k"), F.when(F.col(f"v{t['col']}") >= t["lo"], F.col(f"v{t['col']}")).alias("v")))
        for k, t in enumerate(wanted)
    ]
    counts = values.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("k", "v").agg(F.count("*").alias("n"))
    dealt = ordered_parts(counts, ["k", "v"])
    upto = prefix_sums(dealt, ["k"], "_part", ["v"], {"_upto": "n"})
    rank = F.get(F.array(*[F.lit(t["rank"]).cast("long") for t in wanted]), F.col("k"))
    hit = lambda d: F.min(F.when(F.col("_upto") > rank + d, F.struct("_upto", "v")))
    found = upto.groupBy("k").agg(hit(0).alias("low"), hit(1).alias("high")).collect()
    pick = lambda x: x["v"] if x is not None else None
    return {r["k"]: (pick(r["low"]), pick(r["high"])) for r in found}
