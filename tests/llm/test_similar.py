"""Near-duplicate texts by similarity, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_queries import LOWER, rows

import corpus_pipeline
from chronoply.llm import simhash, similar

SCHEMA = "doc_id long, text string"


def brute(docs: list[tuple[int, str | None]], words: int = 5, least: float = 0.8) -> dict[int, int]:
    sets = {}
    for name, text in docs:
        w = (text or "").translate(LOWER).encode().split()
        sets[name] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    names = sorted(sets)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {n: find(n) for n in names}


def edited(rng: random.Random, words: list[str], n: int) -> str:
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def test_documents(spark):
    docs = [(d["doc_id"], d["text"]) for d in rows("documents")]
    got = dict(similar.near_texts(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == brute(docs)


def test_planted_copies(spark):
    """Recall at similarities from 0.8 on; nothing below 0.8 is linked."""
    rng = random.Random(5)
    docs = []
    for k in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        docs += [(3 * k, " ".join(words)), (3 * k + 1, edited(rng, words, max(1, len(words) // 48))), (3 * k + 2, edited(rng, words, len(words) // 20))]
    want = brute(docs)
    got = dict(similar.near_texts(spark.createDataFrame(docs, SCHEMA)).collect())
    linked = [n for n in want if want[n] != n]
    assert len(linked) >= 100
    assert all(got[n] in (n, want[n]) for n in want)
    assert np.mean([got[n] == want[n] for n in linked]) >= 0.97


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"a{k}" for k in range(40))
    docs = spark.createDataFrame([(1, None), (2, ""), (4, text), (4, text), (3, text + "\n"), (None, text), (7, "one"), (8, "ONE")], SCHEMA)
    got = [tuple(r) for r in similar.near_texts(docs).collect()]
    want = [(1, 1), (2, 1), (4, 3), (4, 3), (3, 3), (None, 3), (7, 7), (8, 7)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r.doc_id or 0 for r in simhash.keep_first(docs, similar.near_texts(docs)).collect()) == [0, 1, 3, 7]
    assert similar.near_texts(docs.limit(0)).count() == 0


def joined(pairs, n: int) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_stars_of_large_buckets():
    """A bucket over many batches, before and after the shuffle: close texts are joined by a link each."""
    rng = np.random.default_rng(2)
    prints = np.repeat([0, 2**62 - 1], 300) ^ (1 << rng.integers(0, 60, 600))
    mixed = rng.permutation(600)
    batch = pd.DataFrame({"set": mixed, "bits": prints[mixed], "keys": [np.array([5, 9])] * 600})
    out = pd.concat(similar.near_stars(batch[k : k + 50] for k in range(0, 600, 50))).sort_values("key")
    assert out["centre"].isna().sum() == 2 * 2 * 12  # of 50 texts two centres go on, for each key
    pairs = pd.concat(similar.candidates(out[k : k + 7] for k in range(0, len(out), 7))).to_numpy().tolist()
    assert all(a // 300 == b // 300 for a, b in pairs)
    assert len(set(joined(pairs, 600))) == 2 and len(pairs) < 600 * 2


def test_unlinked_tells_large_buckets():
    rows = pd.DataFrame({"key": [1] * 3 + [2] * 200 + [3] * 2 + [4] * 90, "set": range(295), "n": 10, "root": [*range(204), 0, *[7] * 90], "pos": 0})
    out = pd.concat(similar.unlinked((rows[k : k + 20] for k in range(0, 295, 20)), 0.8))
    pairs = out[out["key"].isna()][["a", "b"]].to_numpy().tolist()
    assert sorted(map(tuple, pairs)) == [(0, 1), (0, 2), (1, 2), (203, 204)]
    assert out["key"].dropna().tolist() == [2]  # the larger bucket of one root has nothing to find


def star(rng: random.Random, copies: int) -> list[tuple[int, str]]:
    """A text and copies of it at a similarity just over 0.8, that are less alike among themselves."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    out = [(0, " ".join(words))]
    while len(out) <= copies:
        at = sorted(rng.sample(range(5, 295), 6))
        if all(b - a >= 5 for a, b in zip(at, at[1:], strict=False)):  # 30 of 296 shingles: 266 / 326
            out.append((len(out), " ".join(f"x{len(out)}y{k}" if k in at else w for k, w in enumerate(words))))
    return out


def test_star_of_copies(spark):
    """A large bucket in which copies are alike to their original only."""
    docs = star(random.Random(3), 400)
    got = dict(similar.near_texts(spark.createDataFrame(docs, SCHEMA)).collect())
    assert brute(docs) == got and set(got.values()) == {0}


def test_thousands_of_near_copies(spark):
    """5,000 copies at some similarity from 0.85 to 1 with their original: one component, and far fewer links than pairs."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = [(k, edited(rng, words, rng.randrange(1, 4)) if k else " ".join(words)) for k in range(5000)]
    rows_, edges = similar.linked_sets(spark.createDataFrame(docs, SCHEMA).repartition(8), "doc_id", "text", 5, 0.8, 3, 2)
    assert edges.count() < 20 * len(docs)
    got = simhash.classes(rows_.select("id", rows_["set"].alias("fp")), edges).collect()
    assert len(got) == 5000 and {r.component_id for r in got} == {0}


def test_large_bucket_over_blocks(spark, monkeypatch):
    """The exact path alone, without any link of the keys, over several blocks of a bucket."""
    monkeypatch.setattr(similar, "BLOCK", 100)
    rng = random.Random(4)
    docs = star(rng, 250)
    words = [["v%d" % rng.randrange(10**6) for _ in range(60)] for _ in range(3)]
    docs += [(1000 + 100 * k + n, edited(rng, w, n % 4)) for k, w in enumerate(words) for n in range(40)]
    sets = {n: similar.shingles(t, 5) for n, t in docs}
    leads = spark.createDataFrame([(n, len(h), n, similar.fold(h), similar.prefix(h, 0.8).tolist()) for n, h in sets.items()], "`set` long, n int, root long, bits binary, lead array<long>")
    met = similar._met(leads, 0.8).collect()
    keys = spark.createDataFrame([(r.key,) for r in met if r.key is not None], "key long")
    large = leads.select(F.explode("lead").alias("key"), "set", "n", "root", "bits").join(keys, "key")
    got = {(r.a, r.b) for r in met if r.key is None} | {tuple(r) for r in similar._across(large, similar._buckets(large), 0.8, False).collect()}
    names = sorted(sets)
    want = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if (both := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - both)}
    assert len(want) >= 250 and want <= got


def test_every_pair_at_the_similarity(spark):
    """Recall of 1 from similarity 0.8 on, short texts included."""
    rng = random.Random(6)
    docs = []
    for k in range(600):
        n = rng.choice((8, 9, 12, 20, 40, 90))
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        near = words[:-1] if n < 40 else [*words[:-2], "z"] if n == 40 else edited(rng, words, 2).split()
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    want = brute(docs)
    assert sum(want[n] != n for n in want) >= 300
    assert dict(similar.near_texts(spark.createDataFrame(docs, SCHEMA)).collect()) == want


def test_one_row_of_each_group(spark):
    """Ids that repeat with other texts, exact copies under one id, and rows without an id."""
    text, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    last = [(9, f"own text {k} " + " ".join(f"{k}y{n}" for n in range(20))) for k in range(3)]
    docs = [(1, text, 1), (9, f"{text} more", 2), *((*r, 3) for r in last), (4, other, 4), (4, other, 5), (None, other, 6), (None, "alone", 7), (None, "alone", 8), (None, None, 9), (None, "", 10)]
    table = spark.createDataFrame(docs, "doc_id long, text string, __rows int").repartition(4)
    kept = corpus_pipeline.keep_one_of_each(spark, table, "")
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((r for r in got if r[1]), key=str) == sorted([(1, text), *last, (4, other), (None, "alone")], key=str)
    assert sum(not r[1] for r in got) == 1
