"""Edge cases and brute-force versions of the text operators."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import (decontamination, exact_dedup, language, line_dedup, minhash_dedup, mixing, quality,
                           substring_dedup, toxicity, url_rules)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, digest string, size long"


def frame(spark, rows):
    """Documents of (doc_id, text, source) with extra columns whose names clash with inner ones."""
    full = [(i, t, "en" if i is None or i % 2 else None, s, len(t or ""), 1, 2, "x", 3) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def texts(seed, n, words=60, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
    return rng, names, [" ".join(rng.choice(names) for _ in range(words)) for _ in range(n)]


ODD = [(None, "Some text. " * 4, "a"), (1, None, None), (2, "", "b"), (3, "   \n\t", "a"), (4, "One", None), (5, "One", "b"), (5, "One", "b"),
       (6, "long " * 30_000 + "End.", "a"), (7, "é ß Ünd 中文 \U0001f600", "c")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")


def operators(labels, items, docs):
    return {
        "toxicity": lambda: toxicity.toxicity(docs, labels), "quality": lambda: quality.quality(docs, labels),
        "language": lambda: language.languages(docs), "exact": lambda: exact_dedup.exact_duplicates(docs),
        "lines": lambda: line_dedup.line_dedup(docs, 2), "near": lambda: minhash_dedup.near_duplicates(docs, 2),
        "hits": lambda: decontamination.contamination(docs, items), "mixed": lambda: mixing.mixed(docs)}


@pytest.mark.parametrize("name", ["toxicity", "quality", "language", "exact", "lines", "near", "hits", "mixed"])
def test_odd_rows_and_empty_tables(spark, labels, name):
    items = spark.createDataFrame([("a", None), (None, "One two"), ("b", "one")], "item_id string, text string")
    docs = frame(spark, ODD)
    got = operators(labels, items, docs)[name]().collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)
    assert operators(labels.limit(0), items.limit(0), docs.limit(0))[name]().count() == 0
    assert operators(labels.limit(0), items.limit(0), docs)[name]().count() == len(ODD)


def test_spans_of_odd_rows(spark):
    docs = frame(spark, ODD)
    assert {r["doc_id"] for r in substring_dedup.repeated_spans(docs).collect()} <= {1, 2, 3, 4, 5, 6, 7}
    assert substring_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_exact_groups(spark):
    docs = frame(spark, [(1, "ABC É", "s"), (2, "abc É", "s"), (3, "abc é", "s"), (4, None, "s"), (9, "", "s"), (2, "abc É", "s")])
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs, 4).collect())
    assert got == [(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 3, 1, True), (4, 9, 2, False), (9, 9, 2, True)]


def test_near_classes_match_brute_force(spark):
    rng, names, base = texts(3, 60, 70)
    rows = list(enumerate(base))
    for i, t in list(rows):
        for _ in range(rng.randint(0, 6)):
            words = t.split()
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(names)
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), 2).collect()}
    sets = {i: minhash_dedup.word_shingles(t, 2) for i, t in rows}
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in sets}


def test_windows_of_short_and_repeated_items(spark):
    rng, names, base = texts(5, 30, 40, 40)
    items = [("i1", base[0]), ("i2", " ".join(base[1].split()[:4])), ("i3", base[2][:20]), ("i1", base[0]), ("e", "")]
    docs = [(k, t + " " + base[k % 3].upper() + " tail", "s") for k, t in enumerate(base)]
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in decontamination.contamination(
        frame(spark, docs), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for i, t, _ in docs:
        words, hit, ids = t.lower().split(), set(), set()
        for item, text in items:
            own = text.lower().split()
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if n and tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids.add(item)
        assert got[i] == (len(hit), sorted(ids))


def test_spans_match_brute_force_and_are_cut_out(spark):
    rng, names, base = texts(7, 12, 30)
    passage = ". ".join(" ".join(rng.choice(names) for _ in range(12)).capitalize() for _ in range(5)) + "."
    docs = [(i, t + " " + passage + " " + t[::-1] if i % 3 == 0 else t, "s") for i, t in enumerate(base)]
    data = frame(spark, docs)
    spans = substring_dedup.repeated_spans(data)
    first, seen = {}, defaultdict(list)
    for i, t, _ in docs:
        for u in substring_dedup.units(t):
            seen[first.setdefault(u[3:], i)].append(i)
    got = spans.collect()
    assert {r["doc_id"] for r in got} == {3, 6, 9} and all(r["keep_doc_ids"] == [0] for r in got)
    for r in got:
        assert docs[r["doc_id"]][1][r["start_char"] : r["end_char"]] in passage
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_spans(data, spans).collect()}
    assert passage in left[0] and all(passage not in left[i] for i in (3, 6, 9)) and left[1] == docs[1][1]


def test_texts_are_cut_once_and_a_unit_of_many_rows_is_dealt_to_several_groups(spark, tmp_path, monkeypatch):
    line = " ".join(f"word{k}" for k in range(30)) + "."
    docs = [(i, f"alone {i} {'x' * (i % 7)} here.\n{line}\nlast of {i} all.", "s") for i in range(5, 400)] + [(9, line, "s"), (9, line, "s")]
    cut, seen = substring_dedup._units, str(tmp_path / "seen")

    def counted(parts):
        def each():
            for part in parts:
                with open(seen, "a") as f:
                    f.write(f"{len(part)}\n")
                yield part
        yield from cut(each())

    monkeypatch.setattr(substring_dedup, "_units", counted)
    spans = substring_dedup.repeated_spans(frame(spark, docs).repartition(3)).collect()
    assert sum(map(int, open(seen))) == len(docs)
    assert sorted(r["doc_id"] for r in spans) == sorted([9, *range(6, 400)]) and all(r["keep_doc_ids"] == [5] for r in spans)
    assert all(docs[r["doc_id"] - 5][1][r["start_char"] : r["end_char"]].startswith(line[:-1]) for r in spans if r["doc_id"] != 9)
    part = substring_dedup._dealt([0, 0, 0, 0, 1, 3] * 500, [b"0123456789abcdef"] * 500)
    assert (part["salt"] == 0).sum() == substring_dedup.OFTEN and part["more"].sum() == 501 - substring_dedup.OFTEN


def test_mix_gives_targets_to_the_word(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randint(0, 300), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(3, "w w", "a")] * 2
    data = frame(spark, docs)
    rows = mixing.mixed(data, levels=2, blocks_per_shard=8).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, cap = {s: k % 3 + 1 for k, s in enumerate(order)}, {s: 3 * n for s, n in size.items()}
    want, open_ = {}, set(order)
    while open_:
        rest = sum(size.values()) - sum(want.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            want |= share
            break
        want |= {s: cap[s] for s in over}
        open_ -= over
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1 for s in order)
    again = mixing.mixed(data.repartition(5), levels=2, blocks_per_shard=8).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"], r["shards"])
    assert sorted(map(key, rows), key=str) == sorted(map(key, again), key=str)


def test_blocks_of_the_tree_are_disjoint_and_even(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 23), (None, 1)], "source string, blocks long")
    rows = mixing.splitting_tree(quotas, 3, 7).collect()
    assert len({(r["source"], r["block"]) for r in rows}) == len(rows) == 64
    per = defaultdict(int)
    for r in rows:
        per[r["shard"]] += 1
    assert set(per.values()) == {8}


def test_lines_near_the_threshold_are_exact(spark):
    rows = [(i, f"only {i}\nshared line\nrare line" if i < 9 else f"only {i}\n shared line ", f"s{i}") for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows), 10).collect()}
    assert got[0] == rows[0][1] and got[1] == "only 1\nrare line" and got[11] == "only 11"


def test_url_verdicts(spark):
    urls = ["http://A.net/fr/x", "http://www.example.com/en/1", "http://example.com/en/", "no url", None, "", "x://", "http://net/fr/", "http://a.net#/fr/",
            "http://q.org/fr/z?page=1"] + [f"http://h{i}.net/fr/ad/{i}" for i in range(40)] + [f"http://h{i}.org/ad/{i}" for i in range(2)]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.url_verdicts(pages).collect()}
    assert got[0] == ("a.net", "/fr/x", "net/fr/", "block") and got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert all(got[i] == ("", "", None, "allow") for i in (3, 4, 5, 6))
    assert got[8][:3] == ("a.net", "", None) and got[7][3] == "block"
    assert got[50][3] == "block"  # the mined rule: path:ad
    assert url_rules.url_verdicts(pages.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    tox = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    good = quality.quality(docs, labels).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    lang = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert tox > 0.97 and good > 0.95 and lang > 0.97


def test_held_out_quarter(spark):
    got = exact_dedup.exact_duplicates(frame(spark, [(i, "t", "s") for i in range(50)])).select("doc_id").withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit(1))
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == first.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= first.count()
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.contamination(docs, items).where("contaminated").count() == 0
    assert minhash_dedup.near_duplicates(docs).where("not kept").count() == 0
    assert not re.search("Cartesian", corpus_pipeline.STAGES[-1][1](spark, docs, SF)._jdf.queryExecution().executedPlan().toString())


def test_first_meeting_is_the_first_shared_key(spark):
    rng = np.random.default_rng(3)
    m = minhash_dedup
    rows = []
    for k in range(300):
        a = rng.integers(0, 256, m.SYMBOLS, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(m.SYMBOLS, k % (m.RADIUS + 1), replace=False)
        b[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
        rows.append((k, a, b))
    planes = lambda which: m._planes(pd.Series([r[which].tobytes() for r in rows]))
    frame_of = lambda which: spark.createDataFrame([(r[0], [int(v) for v in p]) for r, p in zip(rows, planes(which))], "k int, planes array<long>")
    low, high = m._unlike()
    first = F.transform(F.array(F.struct(low.alias("low"), high.alias("high"))), m._first_meeting)[0]
    got = frame_of(1).alias("x").join(frame_of(2).alias("y"), F.col("x.k") == F.col("y.k")).select("x.k", (F.bit_count(low) + F.bit_count(high)).alias("d"), first.alias("first")).collect()
    assert len(got) == 300
    for r in got:
        _, a, b = rows[r["k"]]
        assert r["d"] == (a != b).sum()
        x, y = m.index_keys(np.stack([a, b]))
        same = np.flatnonzero(x == y)
        assert r["first"] == same[0] and (int(x[same[0]]) & m.PLACES) == same[0]


def test_pairs_of_terms_tell_where_no_term_does():
    rng = np.random.default_rng(1)
    rows, label = [], []
    for k in range(800):
        a, b = k % 2, k // 2 % 2
        rows.append(np.array([7] * a + [9] * b + sorted(rng.choice(np.arange(20, 60), 5, replace=False).tolist()), np.int64))
        label.append(int(a == b))
    machine = toxicity.fit(rows, np.array(label, float))
    x, y = machine.feature_of[7], machine.feature_of[9]
    assert machine.factor[x] @ machine.factor[y] > 1
    score = [machine.score(np.array([machine.feature_of[t] for t in r], np.int64)) for r in rows]
    assert np.mean([(s >= 0.5) == y for s, y in zip(score, label)]) > 0.95


@pytest.mark.parametrize("letters, style", [("абвгдежзик", str), ("αβγδεζηθικ", str), ("abcdefghij", str.upper), ("abcdefghij", str.title), ("abcdefghij", str)])
def test_passages_within_a_sentence_in_any_script_are_found(spark, letters, style):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage = style(words(60))
    docs = [(i, style(words(15)) + " " + passage + " " + style(words(15)), "s") for i in range(4)]
    spans = substring_dedup.repeated_spans(frame(spark, docs)).collect()
    assert {r["doc_id"] for r in spans} == {1, 2, 3} and all(r["keep_doc_ids"] == [0] for r in spans)
    assert all(docs[r["doc_id"]][1][r["start_char"] : r["end_char"]] in passage and r["n_words"] >= 30 for r in spans)


def test_units_hold_all_words():
    rng, _, base = texts(9, 20)
    for t in [*base, "One.\nTwo. Three four!\n\nFIVE SIX", "Да. Нет.\nПривет мир, как твои дела? Хорошо."]:
        got = list(substring_dedup.units(t))
        assert sum(u[2] for u in got) == len(re.findall(r"\w+", t)) == sum(len(re.findall(r"\w+", t[u[0] : u[1]])) for u in got)


def test_a_rule_of_three_tokens_fires(spark):
    parts = [(h, p, q) for h in "ax" for p in "by" for q in "cz"]
    urls = [f"http://{h}.org/{p}/{i}?{q}=1" for i in range(20) for h, p, q in parts]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    sure = {k: parts[k % 8] == ("a", "b", "c") for k in range(len(urls))}
    labels = spark.createDataFrame([(k, b) for k, b in sure.items() if k < 120], "page_id long, blocked boolean")
    got = {r["page_id"]: r["verdict"] == "block" for r in url_rules.url_verdicts(pages, (), labels).collect()}
    assert got == sure


def test_longer_rules_of_kept_ones_are_pruned(spark):
    rows = [(["a", "b", "c"], True)] * 9 + [(["a", "b"], True)] * 9 + [(["a"], False)] * 9 + [(["b"], False)] * 9
    got = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()
    assert sorted(r["tokens"] for r in got) == [["a", "b"], ["c"]]


def test_rows_of_one_id_or_none_are_judged_apart(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where(F.length("text") > 100).first()["text"]
    rows = [(None, item, "s"), (None, "clean words", "s"), (None, None, "s"), (5, item, "s"), (5, "clean too", "s"), (5, item, "s")]
    docs = frame(spark, rows)
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    got = decontamination.contamination(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["contaminated"]) for r in got) == sorted((str(i), t == item) for i, t, _ in rows)
    assert all(r["n_hit"] == (r["n_words"] if r["contaminated"] else 0) for r in got)
    left = corpus_pipeline.decontamination_stage(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left) == [("5", "clean too"), ("None", "None"), ("None", "clean words")]
