"""Edge cases and brute-force versions of phrase mining, vector groups and conversation tries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import phrases, prefix_trie, vector_dedup

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# phrases

def mined(rows, top, least, inside):
    """Every count by enumeration, every longer candidate tried."""
    f, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    out = []
    for lang in sizes:
        found = {p: n for (l, p), n in f.items() if l == lang and len(p) > 1 and n >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= inside * a for q, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "É", "é", "né e", "x\x01", "x", "中文", "\U0001f600", "zz"]
    sets = [[rng.choice(words) for _ in range(rng.randint(2, 5))] for _ in range(8)]
    rows = []
    for _ in range(300):
        parts = [w for _ in range(rng.randint(1, 8)) for w in (rng.choice(sets) if rng.random() < 0.7 else [rng.choice(words)])]
        text = "".join(w + rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?"]) for w in parts)
        rows.append((text, rng.choice(["en", "en", "en", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), ("  \n..", "xx"), ("Hot pair " * 5_000, "en"), ("hot pair", "en"), ("hot pair", "en")]


@pytest.mark.parametrize("bits,chunk", [(25, 2_000_000), (3, 50)])
def test_phrases_match_enumeration(spark, bits, chunk):
    """A full table of pairs and many small chunks change no result."""
    rows = phrase_rows(5)
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "text string, lang string, f long, phrase string").repartition(5)
    got = phrases.collocations(docs, 20, 6, 80, bits, chunk).collect()
    assert sorted(tuple(r) for r in got) == mined(rows, 20, 6, 80)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_exact_scores_of_very_large_counts(spark):
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big, 2 * big - 1)], "f long, both long").select(phrases._score(F.col("f"), F.col("both"))).first()
    assert row[0] == 2_000_000 * big // (2 * big - 1)


# vectors

def grouped(rows, threshold):
    """All pairs, then the smallest id reachable."""
    ok = [i for i, (v, e, l) in enumerate(rows) if v is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    near = defaultdict(set)
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / abs(a).max(), b / abs(b).max()
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    near[i].add(j)
    top = [r[0] for r in rows]
    for i in ok:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        top[i] = min(rows[j][0] for j in seen)
    return sorted(((r[0], len(near[i]), top[i], r[0] == top[i]) for i, r in enumerate(rows)), key=str)


def vector_rows(seed, dim=16, groups=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12))):
            x = centre + rng.normal(size=dim) * rng.uniform(0, 0.2)
            rows.append((len(rows), (x * rng.uniform(0.1, 1e3)).tolist(), int(g % 3)))
    rows += [(i + 1000, list(r[1]), r[2]) for i, r in enumerate(rows[:10])]  # equal vectors
    rows += [(1100, list(rows[0][1]), None), (1101, None, 1), (1102, [0.0] * dim, 1), (1103, [math.nan] * dim, 1), (1104, [], 1), (1105, [math.inf] + [1.0] * (dim - 1), 1),
             (1106, [None] + [1.0] * (dim - 1), 1), (None, list(rows[0][1]), 0), (1107, [1.0], 1), (1108, [2.0], 1), (1109, [1.0, 2.0, 3.0], 1), (1110, [1e200, 0.0, 1e200], 1),
             (1111, [1e-200, -0.0, 1e-200], 1), (1111, [5.0, 0.0, 5.0], 1), rows[0], rows[3]]
    return rows


SHAPE = "vec_id long, embedding array<double>, label int, id long, h long, rows long, cell string"


@pytest.mark.parametrize("target,block", [(1.0, 1024), (0.999, 3)])
def test_vector_groups_match_all_pairs(spark, target, block):
    """Blocks of three rows, so that cells split into many parts, give the links of whole cells."""
    rows = vector_rows(3)
    table = spark.createDataFrame([(*r, 1, 2, 3, "c") for r in rows], SHAPE).repartition(4)
    got = vector_dedup.near_vectors(table, target=target, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == grouped(rows, 0.98)


def test_hot_and_empty_vectors(spark):
    rows = [(i, [1.0, 2.0, 2.0], 1) for i in range(300)] + [(500, [1.0, 2.0, 2.01], 1), (501, [-1.0, 0.0, 0.0], 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert got[7] == (300, 0, False) and got[0] == (300, 0, True) and got[500] == (300, 0, False) and got[501] == (0, 501, True)
    assert vector_dedup.near_vectors(spark.createDataFrame([], SHAPE)).count() == 0


def test_recall_of_the_grid():
    """Share of pairs near the threshold whose second vector lies in a cell that the first one visits, and the cells visited."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    y = 0.981 * x + math.sqrt(1 - 0.981**2) * side / np.linalg.norm(side, axis=1)[:, None]
    for target, least, most in ((0.999, 0.995, 40), (1.0, 1.0, 1024)):
        index = vector_dedup.learn([x[:2000]], 32, 0.98, target)
        home, visits = index.traverse(x[2000:])
        there, _ = index.traverse(y[2000:])
        assert np.mean([a == b or b in v for a, b, v in zip(home, there, visits)]) >= least
        assert np.mean([len(v) for v in visits]) < most


# conversations

def trie(rows, family=20):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    words = lambda t: len([w for w in re.split("[ \t-\r]+", t) if w])
    leaves, saved = Counter(), Counter()
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(cs) - 1) * words(n[-1][1]) if n else 0
    return sorted((
        (min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), kids[n], leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in sorted(cs) if whole[c] == n).encode()).hexdigest()) for n, cs in members.items()), key=str)


def conversation_rows(seed, deep=30):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, 120):
        if rng.random() < 0.9:
            for turn in range(rng.randint(1, 6)):
                rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello  you", "", None, "a\tb c d"])))
    rows += [(c, t, "user", f"step {t}") for c in range(200, 203) for t in range(deep + c - 200)]
    rows += [(c, 0, "user", "the same") for c in range(300, 420)]
    rows += [(5, 1, "user", "twice"), (5, 1, "user", "twice"), (None, 0, "user", "nobody's"), (7, 3, "user", "long " * 20_000)]
    return rows


TURNS = "conv_id long, turn long, role string, text string, digest string, words string, path string"


@pytest.mark.parametrize("band", [1, 3, 8, 64])
def test_trie_matches_enumeration(spark, band):
    """Any height of a band gives the sums over whole subtrees."""
    rows = conversation_rows(2)
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TURNS).repartition(4)
    got = prefix_trie.prefix_trie(table, band).collect()
    assert sorted((tuple(r) for r in got), key=str) == trie(rows)


def test_empty_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_digest_of_many_chunks(spark):
    ids = [*range(-40, 300, 7), 10**15]
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 4)], "x long, y long, conv_id long").repartition(3)
    got = {(r["x"], r["y"]): r["ends_sha256"] for chunk in (16, 10) for r in prefix_trie.ends_digest(ends, chunk).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"4").hexdigest()}
