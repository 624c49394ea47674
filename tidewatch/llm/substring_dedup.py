"""Substring dedup by hashing normalised units: lines and sentences, cut further after words that a hash picks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Words of a run of repeated units from which it is removed.
MIN_WORDS = 25
#: Words at least of a unit where no line or sentence ends.
UNIT_WORDS = 3
#: The digest of a unit of fewer words looks at words before it, too, so that common phrases do not add up to a run.
DIGEST_WORDS = 8
#: A word in so many, by its hash, ends a unit: in any script, whatever stands around a passage.
CUT_WORDS = 8
#: Units in a table that a task hands on.
CHUNK = 50_000
#: Units of one digest in a table that stay together; further ones are dealt to so many groups.
OFTEN, SALTS = 64, 64
#: Units end at line ends and after marks that end a sentence.
_BORDER = re.compile(r"\n+|(?<=[.!?\u0589\u061f\u06d4\u0964\u0965\u2026\u3002\uff01\uff1f])\s+")
_WORD = re.compile(r"\w+")


class Cuts(dict):
    """Whether a lower-cased word ends a unit; words looked up before are remembered."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % CUT_WORDS == 0
        return out


_CUTS = Cuts()


def units(text: str | None) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, number of words, two halves of a digest) of the units, which hold all words of the text."""
    for start, end, words, digest in _digested(text):
        yield start, end, words, *np.frombuffer(digest, np.int64).tolist()


def _digested(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """The units with the bytes of their digest."""
    if not text:
        return
    start, last = 0, []
    for end, after in [*((m.start(), m.end()) for m in _BORDER.finditer(text)), (len(text), len(text))]:
        found = list(_WORD.finditer(text, start, end))
        words = [m.group().lower() for m in found]
        done = 0
        for k, word in enumerate(words, 1):
            # at least UNIT_WORDS stand before a cut and after it
            if k < len(words) and not (_CUTS[word] and k - done >= UNIT_WORDS and len(words) - k >= UNIT_WORDS):
                continue
            own = words[done:k]
            last = (last + own)[-DIGEST_WORDS:] if len(own) < DIGEST_WORDS else own
            digest = xxhash.xxh3_128_digest(" ".join(last).encode("utf-8", "surrogatepass"))
            yield start, end if k == len(words) else found[k - 1].end(), len(own), digest
            done = k
            start = found[k].start() if k < len(words) else start
        start = after


def _units(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, digests = [], []
    for part in parts:
        for doc, row, text in zip(part["doc_id"].tolist(), part["row_id"].tolist(), part["text"]):
            for i, (start, end, words, digest) in enumerate(_digested(text)):
                rows.extend((doc, row, i, start, end, words))
                digests.append(digest)
            if len(digests) > CHUNK:
                yield _dealt(rows, digests)
                rows, digests = [], []
    yield _dealt(rows, digests)


def _dealt(rows: list[int], digests: list[bytes]) -> pd.DataFrame:
    """The units as a table, ``rows`` six numbers each. Those with a digest that was seen ``OFTEN`` times in it go to one of ``SALTS`` groups of that digest.

    The other units of a digest are in its group 0, where the row before the first that left says that there are more groups.
    """
    out = pd.DataFrame(np.array(rows, np.int64).reshape(-1, 6), columns=["doc_id", "row_id", "at", "start", "end", "words"])
    out["h"], out["k"] = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
    seen = out.groupby(["h", "k"]).cumcount()
    out["salt"] = np.where(seen < OFTEN, 0, 1 + (out["doc_id"] + out["at"]) % SALTS)
    out["more"] = seen >= OFTEN - 1
    return out


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans to remove: doc_id, row_id, start_char, end_char, n_words, keep_doc_ids; one row per span.

    ``docs`` has doc_id and text. Units are compared by their lower-cased words. Of equal
    units the one with the smallest (doc_id, place) stays; the others are repeats. A run
    of neighbouring repeats of ``min_words`` words or more is a span, with the original
    character offsets and the documents where its units stay. So a passage is found
    wherever it stands in a line, but for the units at its ends that hold other words, too,
    and short phrases that many documents share are left alone. Units are cut alike in all scripts.

    Null and empty texts have no units. Rows without a doc_id are not looked at: nothing
    would say which row a span belongs to. Rows that repeat a doc_id are told apart by a hash of their text; of
    equal rows none is the other's repeat. An empty table gives an empty one.
    """
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("row_id", F.xxhash64("text"))
    cut = base.mapInPandas(_units, "doc_id long, row_id long, at int, start int, `end` int, words int, h long, k long, salt int, more boolean")
    # One pass over the units: they meet in the groups of their digest, and only repeats and units of several groups go on.
    group = Window.partitionBy("h", "k", "salt")
    place, other = F.struct("doc_id", "at", "row_id"), "not (doc_id = first.doc_id and at = first.at and row_id = first.row_id)"
    met = cut.withColumn("first", F.min(place).over(group)).withColumn("more", F.max("more").over(group))
    met = stored(met.where(f"more or {other}").select(
        "doc_id", "row_id", "at", "start", "end", "words", "first", "more", *[F.when(F.col("more"), F.col(n)).alias(n) for n in ("h", "k", "salt")]), "repeats")
    # The first unit of a digest of several groups is the least of their first ones; it is handed to each group.
    several = met.where("more")
    firsts = several.groupBy("h", "k", "salt").agg(F.first("first").alias("first"))
    least = firsts.withColumn("first", F.min("first").over(Window.partitionBy("h", "k")))
    columns = ["doc_id", "row_id", "at", "start", "end", "words", F.col("first.doc_id").alias("keep")]
    again = several.drop("first").join(least, ["h", "k", "salt"]).where(other).select(*columns).union(met.where("not more").select(*columns))
    # Equal rows hold equal units, so those of a row are told apart by their place.
    inside = Window.partitionBy("doc_id", "row_id").orderBy("at")
    again = again.repartition("doc_id", "row_id").dropDuplicates(["doc_id", "row_id", "at"])
    runs = again.withColumn("run", F.col("at") - F.row_number().over(inside))
    spans = runs.groupBy("doc_id", "row_id", "run").agg(
        F.min("start").alias("start_char"), F.max("end").alias("end_char"), F.sum("words").alias("n_words"),
        F.array_sort(F.collect_set("keep")).alias("keep_doc_ids"))
    return spans.where(F.col("n_words") >= min_words).drop("run")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of text; their columns and rows are as before."""
    cuts = spans.groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("__cuts"))
    cuts = cuts.select(F.col("doc_id").alias("__doc"), F.col("row_id").alias("__row"), "__cuts")
    text = F.col("text").cast("string")
    full = docs.join(cuts, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64(text) == F.col("__row")), "left")
    start = F.struct(F.lit("").alias("left"), F.lit(0).alias("at"))
    step = lambda s, c: F.struct(
        F.concat(s["left"], F.substring(text, s["at"] + 1, c["start_char"] - s["at"])).alias("left"), c["end_char"].alias("at"))
    ended = F.aggregate("__cuts", start, step, lambda s: F.concat(s["left"], F.substring(text, s["at"] + 1, F.length(text))))
    return full.select(*[F.coalesce(ended, text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
