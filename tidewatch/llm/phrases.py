"""Collocations by merge joins of n-gram count streams in prefix and in suffix order.

Counting takes two scans. The first counts words and pairs of words; a phrase that is
frequent holds only frequent pairs, so the second scan builds phrases of three and four
words only where a bit table of fixed size may know all of their pairs. The table errs
to one side, so at any size it saves work and never loses a phrase. Tasks count with
exact local codes for words, not with hashes, and hand on one row a phrase and chunk.

The frequent counts are then two sorted streams. In prefix order a phrase follows its
first part, in suffix order (words reversed) its last part. The streams of lengths
m and m - 1 are merge-joined level by level, which gives every phrase the counts of all
its beginnings and of all its ends, and every beginning or end the largest count of a
phrase one word longer. No join builds a hash table, and a part with very many
followers is a skewed key of a merge join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

LONGEST = 4
MIN_COUNT = 30
#: A phrase goes where a longer one holds it with this percentage of its count.
INSIDE = 80
TOP = 2000
#: Words a task counts before it hands its counts on, which bounds its memory.
CHUNK_WORDS = 600_000
#: log2 of the bits of the table of frequent pairs: 4 MB.
TABLE_BITS = 25
#: Phrases written out at once.
OUT_ROWS = 50_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_MARK = bytes.maketrans(_BREAKS, b"." * len(_BREAKS))
_COUNTS = "lang string, m int, phrase binary, f long"


class _Codes(dict):
    """Words to dense codes in order of first sight; code 0 is the break between pieces."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.words = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.words)
        self.words.append(word)
        return code


def _words(text: bytes) -> list[bytes]:
    """Lower-cased words (A-Z only), with b"." where a piece ends; the marks are in no word."""
    return text.lower().translate(_MARK).replace(b".", b" . ").split()


def _bits(phrases: list[bytes], lang: str, table_bits: int) -> np.ndarray:
    head = lang.encode("utf-8", "surrogatepass") + b"\t"
    h = np.fromiter((xxhash.xxh64_intdigest(head + p, seed=42) for p in phrases), np.uint64, len(phrases))
    return h >> np.uint64(64 - table_bits)


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, code per place and count of the distinct pairs (high, low) of 32-bit codes."""
    _, at, code, n = np.unique(high << 32 | low, return_index=True, return_inverse=True, return_counts=True)
    return at, code, n


def _texts(places: np.ndarray, m: int, codes: np.ndarray, words: np.ndarray) -> list[bytes]:
    """The phrases of ``m`` words that begin at ``places``."""
    return list(map(b" ".join, zip(*(words[codes[places + i]] for i in range(m)))))


def _count_chunk(codes: np.ndarray, words: np.ndarray, lang: str, known: np.ndarray | None, table_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, places, counts) of one chunk: 0, 1 and 2 words without ``known``, else 3 and 4; a phrase's first place stands for it."""
    two = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    at, pair, n = _distinct(codes[two], codes[two + 1])
    if known is None:
        yield 0, np.zeros(1, np.int64), np.array([(codes > 0).sum()])
        _, first, count = np.unique(codes, return_index=True, return_counts=True)
        word = codes[first] > 0
        yield 1, first[word], count[word]
        yield 2, two[at], n
        return
    may = np.empty(len(at), bool)
    for k in range(0, len(at), OUT_ROWS):
        bits = _bits(_texts(two[at[k : k + OUT_ROWS]], 2, codes, words), lang, table_bits)
        may[k : k + OUT_ROWS] = known[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1
    code = np.full(len(codes) + 3, -1, np.int64)  # per place: the pair that begins there, if it may be frequent
    code[two] = np.where(may[pair], pair, -1)
    three = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
    at, triple, n = _distinct(code[three], code[three + 1])
    yield 3, three[at], n
    in_four = code[three + 2] >= 0
    next_triple = np.full(len(codes) + 3, -1, np.int64)
    next_triple[three] = triple
    four = three[in_four]
    at, _, n = _distinct(triple[in_four], next_triple[four + 1])
    yield 4, four[at], n


def _counter(known, table_bits: int, chunk_words: int):
    """mapInArrow body over (lang, text): partial counts, one row a phrase, language and chunk."""

    def flush(lang: str, parts: list[np.ndarray], codes: _Codes) -> Iterator[pa.RecordBatch]:
        table = None if known is None else known.value
        whole, words = np.concatenate(parts), np.array(codes.words, object)
        for m, places, n in _count_chunk(whole, words, lang, table, table_bits):
            for k in range(0, len(places), OUT_ROWS):
                part = places[k : k + OUT_ROWS]
                phrases = _texts(part, m, whole, words) if m else [b""]
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), m, np.int32)),
                                       pa.array(phrases, pa.binary()), pa.array(n[k : k + OUT_ROWS].astype(np.int64))], names=["lang", "m", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, _Codes] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = vocabulary.setdefault(lang, _Codes())
                words = _words(text.as_py())
                words.append(b".")
                waiting.setdefault(lang, []).append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held >= chunk_words:
                    for key, parts in waiting.items():
                        yield from flush(key, parts, vocabulary[key])
                    vocabulary, waiting, held = {}, {}, 0
        for key, parts in waiting.items():
            yield from flush(key, parts, vocabulary[key])

    return run


def _summed(partial: DataFrame, min_count: int) -> DataFrame:
    whole = partial.groupBy("lang", "m", "phrase").agg(F.sum("f").alias("f"))
    return whole.where((F.col("f") >= min_count) | (F.col("m") == 0)).withColumn("phrase", F.col("phrase").cast("string"))


def pair_table(pairs: DataFrame, table_bits: int = TABLE_BITS) -> np.ndarray:
    """Bytes of a table with one bit set for every frequent pair (lang, phrase); at most ``2 ** table_bits`` bits."""
    place = F.shiftrightunsigned(F.xxhash64(F.concat(F.col("lang"), F.lit("\t"), F.col("phrase"))), 64 - table_bits)
    longs = pairs.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("k")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(max(1, 2**table_bits // 64), np.int64)
    table[longs["k"].to_numpy(np.int64)] = longs["bits"].to_numpy(np.int64)
    return table.astype("<i8").view(np.uint8)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, table_bits: int = TABLE_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(lang, m, phrase, f) of all phrases of up to four words with ``min_count`` occurrences, and, as m = 0, all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    short = stored(_summed(rows.mapInArrow(_counter(None, table_bits, chunk_words), _COUNTS), min_count), "short-phrases")
    known = spark.sparkContext.broadcast(pair_table(short.where("m = 2"), table_bits))
    long = stored(_summed(rows.mapInArrow(_counter(known, table_bits, chunk_words), _COUNTS), min_count), "long-phrases")
    known.destroy()
    return short.union(long)


def _lockstep(counts: DataFrame, order: str) -> DataFrame:
    """Counts of all parts of each phrase in ``order`` (prefix or suffix), and the largest count of one word more.

    Gives (lang, phrase, m, f, parts, longer); ``parts`` holds the counts of the first (last) 1, 2, .. m - 1 words.
    """
    words = F.split("phrase", " ")
    rest = F.slice(words, 1, F.size(words) - 1) if order == "prefix" else F.slice(words, 2, F.size(words) - 1)
    key = F.concat_ws(" ", rest)
    level = counts.where("m = 1").select("lang", "phrase", "m", "f", F.array().cast("array<long>").alias("parts"))
    done = []
    for m in range(2, LONGEST + 1):
        part = level.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), F.col("parts").alias("part_parts"))
        stream = counts.where(F.col("m") == m).select("lang", "phrase", "m", "f", key.alias("part"))
        following = stream.groupBy("lang", "part").agg(F.max("f").alias("longer")).withColumnRenamed("part", "phrase")
        done.append(level.join(following.hint("merge"), ["lang", "phrase"], "left"))
        level = stream.join(part.hint("merge"), ["lang", "part"]).select(
            "lang", "phrase", "m", "f", F.concat("part_parts", F.array("part_f")).alias("parts"))
        level = stored(level, f"{order}-stream")
    done.append(level.withColumn("longer", F.lit(None).cast("long")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _score(f: Column, both: Column) -> Column:
    """floor(2000000 * f / both), exact: the product may pass 64 bits."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * f.cast("decimal(20,0)"), both)


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, inside: int = INSIDE,
                 table_bits: int = TABLE_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang (null: ``und``); other columns are not looked at. Texts are
    lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at spaces
    and tabs. A phrase of 2 to 4 words with ``min_count`` occurrences (overlaps count) is scored
    at its weakest cut, floor(2000000 a / (l + r)), ties to the first cut. It is dropped where
    a phrase that holds it has ``inside`` percent of its count. Equal scores are ordered by a,
    then by phrase in byte order. Null and empty texts have no words; very long texts
    are counted whole (one text must fit a task); repeated rows count again; an empty table
    gives an empty one.
    """
    counts = phrase_counts(docs, min_count, table_bits, chunk_words)
    phrases = counts.where("m > 0")
    left = _lockstep(phrases, "prefix").where("m > 1")
    right = _lockstep(phrases, "suffix").where("m > 1").select(
        "lang", "phrase", F.col("parts").alias("ends"), F.col("longer").alias("longer_left"))
    both = left.join(right.hint("merge"), ["lang", "phrase"])
    # a phrase inside a longer one is inside one that is one word longer and at least as frequent
    longer = F.greatest("longer", "longer_left").cast("decimal(20,0)")
    both = both.where(F.coalesce(100 * longer < inside * F.col("f").cast("decimal(20,0)"), F.lit(True)))
    ends = F.reverse("ends")
    cuts = F.transform("parts", lambda l, i: F.struct(  # noqa: E741
        _score(F.col("f"), l + F.get(ends, i)).alias("score"), (i + 1).alias("k"), l.alias("l"), F.get(ends, i).alias("r")))
    best = both.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
    ranked = best.withColumn("rank", F.row_number().over(
        W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase")))).where(F.col("rank") <= top)
    sizes = counts.where("m = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
                                             F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
