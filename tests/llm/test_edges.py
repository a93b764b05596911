"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoply.llm import common, decontamination, language, packing, pagetext, quality, queries, rules, sharding, simhash, token_files, urlfilter

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
PLAIN = "The quick brown fox jumps over the lazy dog, and then it rests under an old oak near the quiet river bank."
LONG = " ".join(f"word{k}" for k in range(30_000))
TEXTS = [(1, PLAIN), (1, PLAIN), (2, PLAIN), (None, PLAIN), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, f"{PASSAGE} and more"), (8, "a"), (9, "\x00 é 漢字 \U0001f600"), (10, "same\n" * 40)]
#: Names that the operators use inside.
CLASH = "id h t w g fp size start stop length shard slot block run words pos term piece score y x __t __w __i __s __gone __told row free host page page_id url html key root item_id item".split()


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in CLASH)).repartition(3)


def benchmark(spark, rows=((1, PASSAGE), (None, PASSAGE), (3, None), (4, ""), (4, "a"))):
    return spark.createDataFrame(list(rows), "item_id long, text string").withColumn("id", F.lit(1))


def labels(spark, rows=((1, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 1), (3, None, None), (6, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("y", F.lit(1))


def crc(text):
    return zlib.crc32((text or "").encode())


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, []).cache()


def test_packing(docs, none):
    got = packing.pack(packing.pieces(docs, BYTES)).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in TEXTS)
    assert sum(r.length for r in got if r.doc_id == 4) == 1 and max(r.length for r in got) == 1024
    assert packing.pack(packing.pieces(none, BYTES)).count() == 0


def test_simhash(docs, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    by_id = {i: (f, c) for i, f, c in got if i is not None}
    assert len(got) == 12 and by_id[1] == by_id[2] and by_id[1][1] == 1
    assert {by_id[k] for k in (3, 4, 5)} == {("0" * 16, 3)} and (None, "0" * 16, 3) in got
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect())[2] == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none, simhash.near_duplicates(none)).count() == 0


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/a?b"), (1, "http://WWW.Example.com/en/a?b"), (None, None), (2, "no scheme"), (3, ""), (4, "x://"), (5, "http://a.net/es/" + "p/" * 500), (6, "http://example.com/en/#")]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in rows], "page_id long, url string, host int, tpl int")
    got = sorted(((r.page_id or 0, r.host, r.rule, r.verdict) for r in urlfilter.judge(pages, queries.URL_RULES).collect()), key=repr)
    assert len(got) == len(rows) and (0, "", None, "allow") in got and (4, "", None, "allow") in got
    assert got.count((1, "www.example.com", "www.example.com/en/", "allow")) == 2 and (6, "example.com", "example.com/en/", "block") in got and (5, "a.net", "net/es/", "block") in got
    assert urlfilter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_decontamination(spark, docs, none):
    got = decontamination.contamination(docs, benchmark(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in TEXTS)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[7].n_words, by_id[7].n_hit, by_id[7].contaminated) == (16, 14, True)
    assert (by_id[8].n_hit, by_id[8].contaminated) == (1, True)  # an item of one word
    assert (by_id[3].n_words, by_id[4].n_words, by_id[6].n_words, by_id[6].contaminated) == (0, 0, 30_000, False)
    assert not any(r.n_hit for r in decontamination.contamination(docs, benchmark(spark, [])).collect())
    assert decontamination.contamination(none, benchmark(spark)).count() == 0
    # Beyond the broadcast bound the same joins shuffle.
    shuffled = decontamination.contamination(docs, benchmark(spark), broadcast_terms=0).collect()
    assert sorted(map(repr, shuffled)) == sorted(map(repr, got))


def test_proximity(docs):
    assert [tuple(r) for r in decontamination.near_terms(docs, "two", "five", 3).collect()] == [(7, 1)]
    assert decontamination.near_terms(docs, "two", "five", 2).count() == 0


def test_shards(docs, none):
    got = sharding.shard(docs, 4).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, crc(t)) for i, t in TEXTS)
    assert len({r.shard for r in got if r.text_crc32 == crc(PLAIN)}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(none, 4).count() == 0


def test_quality(spark, docs, none):
    for model in (quality.fit(docs, labels(spark)), quality.fit(none, labels(spark, []))):
        got = quality.classify(docs, model).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
        assert quality.classify(none, model).count() == 0


def test_token_files(spark, docs, none):
    for df, n in ((docs, len(TEXTS)), (none, 0)):
        path = token_files.new_path(spark)
        token_files.write(df, path, WORDS, segment_ids=50)
        got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        assert [r.doc_id for r in got] == ([None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10] if n else [])


def test_page_text(spark):
    menu = "<p>home about contact terms privacy help jobs press</p>"
    rows = [(1, "http://a.x/1", f"<body>{menu}<p>own words here</p>"), (2, "http://a.x/2", f"<body>{menu}<p>other words</p>"), (2, "http://a.x/2", f"<body>{menu}<p>other words</p>"), (None, None, None), (3, None, ""), (4, "u", "<article><p>x &amp; y<p>z"), (5, "u", "<" * 50_000)]
    pages = spark.createDataFrame([(*r, "k", "k") for r in rows], "page_id long, url string, html string, host string, text string")
    got = sorted((r.page_id or 0, r.text) for r in pagetext.extract(pages).collect())
    assert got[:-1] == [(0, ""), (1, "own words here"), (2, "other words"), (2, "other words"), (3, ""), (4, "x & y\n\nz")]
    assert pagetext.extract(pages.limit(0)).count() == 0


def test_page_text_keeps_near_copies_and_quotations(spark):
    """Pages that mark no article: copies that differ in a word, and a passage quoted within a block."""
    menu = "<p>home about contact terms privacy help jobs press</p>"
    body = [" ".join(f"p{k}w{n}" for n in range(80)) for k in range(4)]
    quote = "to be or not to be that is the question"
    texts = [body[0], body[0].replace("p0w40", "changed"), f"{body[1]} {quote} {body[1][::-1]}", f"{body[2]} {quote} {body[2][::-1]}", body[3]]
    pages = spark.createDataFrame([(k, f"http://a.x/{k}", f"<body>{menu}<p>{t}</p>") for k, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pagetext.extract(pages).collect()} == dict(enumerate(texts))


def test_page_text_of_short_hosts(spark):
    """Two near copies alone on a host stay whole."""
    text = " ".join(f"w{n}" for n in range(60))
    texts = [text, text.replace("w30", "changed")]
    pages = spark.createDataFrame([(k, "http://a.x/", f"<body><p>{t}</p>") for k, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pagetext.extract(pages).collect()} == dict(enumerate(texts))


def test_rules(docs, none):
    order = rules.plan(docs, rules.BASE + rules.RULES)
    assert sorted(r.name for r in order) == sorted(r.name for r in rules.BASE + rules.RULES)
    got = {(r.doc_id, r.n_words): r for r in rules.judge(docs, order).collect()}
    assert got[(1, 22)].kept and got[(3, 0)].base_failed and got[(10, 40)].n_repeat_words == 40 and got[(10, 40)].n_dup_lines == 39
    kept = rules.keep(docs, order)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in rules.judge(docs, order).where("kept").collect())
    assert rules.judge(none, rules.plan(none, rules.RULES)).count() == 0


def test_language(spark, docs, none):
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs)).collect()} == {"und"}  # nothing to learn from
    told = spark.createDataFrame([(k, PLAIN if k % 2 else "el perro corre por la calle y la casa es grande", "en" if k % 2 else "es") for k in range(20)], "doc_id long, text string, lang string")
    got = language.identify(docs, language.fit(told)).collect()
    assert len(got) == len(TEXTS) and {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"en"} and {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert language.identify(none, language.fit(none)).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for df in (docs, none):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert now.columns == df.columns, name
                now.write.parquet(str(tmp_path / f"{name}-{df is none}"))
                now = spark.read.schema(df.schema).parquet(str(tmp_path / f"{name}-{df is none}"))
        assert (now.count() > 0) == (df is docs)


def test_phrases_come_in_blocks(spark):
    texts = spark.createDataFrame([(1, "a b c a b"), (2, "b c a")], "h long, t string")
    lists = decontamination.index(texts, spark.createDataFrame([(w,) for w in "abcx"], "term string"))
    wanted = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "a"]), (3, ["c"]), (4, ["x"]), (5, list("abcab"))], "p long, words array<string>")
    want = [(1, 1, 0), (1, 1, 3), (2, 1, 1), (2, 2, 0), (3, 1, 2), (3, 2, 1), (5, 1, 0)]
    for block in (1, decontamination.BLOCK):
        assert sorted(map(tuple, decontamination.phrases(lists, wanted, block=block).collect())) == want


def test_page_suffixes_meet_their_longest_neighbours(spark):
    """What a suffix shares with its neighbours of the sorted array is the most that it shares with any other."""
    streams = {("a", "p"): "x y z x y w x y z x".split(), ("a", "q"): "z x y w u x y z x v".split(), ("b", "r"): "x y z x".split()}
    number = {w: k for k, w in enumerate("vzyxwu")}
    rows = [(h, p, p, k, [number[x] for x in t[k : k + 6]]) for (h, p), t in streams.items() for k in range(len(t))]
    df = spark.createDataFrame(rows, "host string, page string, content string, at int, key array<long>")
    got = {(r.host, r.page, r.at): r.lcp for r in pagetext.common_prefixes(df.repartition(3), 6).collect()}
    most = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = {(h, p, k): max(most(key, other) for g, q, _, m, other in rows if g == h and (q, m) != (p, k)) for h, p, _, k, key in rows}
    assert set(got) == set(want) and all(got[k] in (want[k], 6) for k in want)
    with common.setting(spark, "spark.sql.shuffle.partitions", "1"):  # one range: only its two ends have no neighbour
        got = {(r.host, r.page, r.at): r.lcp for r in pagetext.common_prefixes(df, 6).collect()}
    assert sum(got[k] != want[k] for k in want) <= 2


def test_page_runs_have_one_length(spark):
    """Neighbouring runs that different pages share aren't one long run, and don't go from a block's edge."""
    one, two = ([f"{c}{k}" for k in range(8)] for c in "ab")
    own = [[f"p{p}w{k}" for k in range(60)] for p in range(6)]
    texts = [one + two + own[0], one + own[1], one + own[2], two + own[3], two + own[4], own[5]]
    pages = spark.createDataFrame([(k, f"http://a.x/{k}", f"<body><p>{' '.join(t)}</p>") for k, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pagetext.extract(pages).collect()} == {k: " ".join(t) for k, t in enumerate(texts)}
    menu = [f"m{k}" for k in range(16)]
    texts = [menu + own[k] for k in range(6)]
    pages = spark.createDataFrame([(k, f"http://a.x/{k}", f"<body><p>{' '.join(t)}</p>") for k, t in enumerate(texts)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pagetext.extract(pages).collect()} == {k: " ".join(own[k]) for k in range(6)}
