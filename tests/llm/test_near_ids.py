"""Near duplicates where ids repeat or are missing, in any order of the rows, and the stages on odd rows."""

import itertools
import random
import re

import pytest

import corpus_pipeline
from tidewatch.llm import minhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, x long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), 1, 2) for i, t in rows], DOCS).repartition(parts)


def classes(rows, size, percent):
    """All pairs of texts, then the texts of one id."""
    def shingles(t):
        w = [x for x in re.split("[ \t-\r]+", (t or "").lower()) if x]
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    known = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        (i, s), (j, t) = known[a], known[b]
        if s and t and i is not None and j is not None and (i == j or 100 * len(s & t) >= percent * len(s | t)):
            top[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(known):
        ids = [known[m][0] for m in range(len(rows)) if find(m) == find(k)]
        least = min(ids) if s and i is not None else i
        out.append((i, len(s), least, i is None or i == least))
    return sorted(out, key=str)


def texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    a, b = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(2))
    near = lambda t: t + " one more word"
    return a, b, near(a), near(b)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_all_texts_of_an_id_are_compared(spark, order):
    """Document 5 has texts A and B, 7 is near A and 8 near B: all three are one class in every order of the rows."""
    a, b, near_a, near_b = texts()
    rows = [(5, a), (5, b), (7, near_a), (8, near_b), (9, "quite another text"), (9, "quite another text"), (None, a), (None, b), (None, None), (4, ""), (5, " "), (11, None)]
    random.Random(order).shuffle(rows)
    got = minhash_dedup.near_duplicates(frame(spark, rows, order), 2).collect()
    assert sorted((tuple(r) for r in got), key=str) == classes(rows, 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in got if r["n_shingles"] > 50 and r["doc_id"]} == {5: 5, 7: 5, 8: 5}


def test_random_ids_match_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(70)) for _ in range(25)]
    rows = []
    for k in range(140):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((rng.choice([k, k, k, k // 2, k % 7, None]), " ".join(w)))
    got = minhash_dedup.near_duplicates(frame(spark, rows), 2).collect()
    assert sorted((tuple(r) for r in got), key=str) == classes(rows, 2, 80)


def test_near_stage_keeps_one_row_of_a_group(spark):
    """Rows without an id, of one id and equal rows: one of each group stays, clean rows stay."""
    a, b, near_a, near_b = texts()
    rows = [(None, a), (None, near_a), (5, a), (5, b), (5, a), (6, b), (7, near_b), (None, None), (None, None), (8, ""), (9, "clean words here")]
    left = corpus_pipeline.near_stage(spark, frame(spark, rows), "")
    assert left.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
    got = sorted(str(r["text"])[:20] for r in left.collect())
    assert got == sorted([a[:20], b[:20], "None", "None", "", "clean words here"])
    assert corpus_pipeline.near_stage(spark, frame(spark, []), "").count() == 0
