"""The operators' queries against brute force over a whole small folder."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from chronoply.llm import language, queries, rules, sharding, token_files

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows(name: str) -> list[dict]:
    cur = duckdb.execute(f"SELECT * FROM '{SF}/{name}.parquet'")
    return [dict(zip([d[0] for d in cur.description], r, strict=True)) for r in cur.fetchall()]


@cache
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(path))
    t.encode_special_tokens = True
    return t


def ids(path: str, text: str | None) -> bytes:
    t = tokenizer(path)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def docs() -> list[dict]:
    return rows("documents")


def test_packing(spark, docs):
    got = queries.op1_pack(spark, SF).collect()
    by_doc = defaultdict(list)
    places = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {d["doc_id"] for d in docs}
    for d in docs:
        own, parts, at = ids("byte_bpe_50k.json", d["text"]), sorted(by_doc[d["doc_id"]], key=lambda r: r.piece), 0
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length == 1024 for p in parts[1:])
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(own[at * 4 : (at + p.length) * 4])
            at += p.length
        assert at * 4 == len(own) and (len(parts) == 1 or at > 1024)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.02 * -(-sum(r.length for r in got) // 1024) + 2


def brute_prints(docs):
    out = {}
    for d in docs:
        w = (d["text"] or "").translate(LOWER).encode().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        n = Counter(b for s in sh for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
        out[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * n[b] > len(sh))
    return out


def test_simhash(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    prints = brute_prints(docs)
    values = np.array([prints[d] for d in sorted(prints)], dtype=np.uint64)
    names = sorted(prints)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ v) <= 3) + k + 1:
            a, b = sorted((find(names[k]), find(names[j])))
            root[b] = a
    assert got == {n: (f"{prints[n]:016x}", find(n)) for n in names}


def test_urls(spark):
    got = {r.page_id: r for r in queries.op3_url_templates(spark, SF).collect()}
    pages = rows("pages")
    assert len(got) == len(pages)
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        r = got[p["page_id"]]
        assert (r.host, r.path, r.rule) == (host, path, best and best.name)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")


def test_decontamination(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(queries.OP4_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op4_decontaminate(spark, SF).collect())
    assert got == want and any(r[5] for r in got)


def test_shards(spark, docs):
    got = {r.doc_id: r for r in queries.op5_shards(spark, SF).collect()}
    assert len(got) == len(docs)
    slots, sizes, texts = defaultdict(list), Counter(), {}
    for d in docs:
        r, raw = got[d["doc_id"]], (d["text"] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        assert texts.setdefault(raw, r.shard) == r.shard
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for d in docs:
        groups[(d["text"] or "")] += len((d["text"] or "").encode()) + 1
    assert max(sizes.values()) <= max(1.01 * sum(sizes.values()) / 8, max(groups.values()))


def test_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows("labels")}
    got = queries.op6_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    told = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in told if y == 1], [s for s, y in told if y == 0]
    if good and bad:
        assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.8


def test_token_files(spark, docs):
    got = {r.doc_id: r for r in queries.op7_token_files(spark, SF).collect()}
    at = 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        own, r = ids("word_bpe_49k.json", d["text"]), got[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own) // 4, zlib.crc32(own))
        at += len(own) // 4
    assert len(got) == len(docs)


def test_page_text(spark):
    import html

    got = {r.page_id: r for r in queries.op8_page_text(spark, SF).collect()}
    for p in rows("pages"):
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", p["html"])[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(x for x in parts if x)
        r = got[p["page_id"]]
        assert (r.url, r.text, r.n_chars) == (p["url"], text, len(text))


def test_rules(spark, docs):
    got = {r.doc_id: r for r in queries.op9_rules(spark, SF).collect()}
    kept = 0
    for d in docs:
        t, r = d["text"] or "", got[d["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.base_failed and r.kept)
        kept += r.kept
    assert kept > 0.5 * len(docs)


def test_rules_are_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(queries.OP9_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(tuple(dict(zip(names, r, strict=True)).items()) for r in cur.fetchall())
    got = sorted(tuple((n, r[n]) for n in names) for r in queries.op9_rules(spark, SF).collect())
    assert got == want and any(not dict(r)["kept"] and not dict(r)["base_failed"] for r in got)


def test_rules_have_one_order(spark):
    """The plan is the same each time, and the rule that is reported is the first of its order."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    order = rules.plan(table, rules.RULES)
    assert [r.name for r in order] == [r.name for r in rules.plan(table.repartition(3), rules.RULES)]
    told = {r.doc_id: r.rejected_by for r in rules.judge(table, order).collect()}
    m = rules.Measures.of(F.col("__t"), F.col("__w"))
    every = rules.prepared(table, "text", [F.col("doc_id")]).select("doc_id", *(r.rejects(m).alias(r.name) for r in (*rules.BASE, *order)))
    for r in every.collect():
        base = any(r[x.name] for x in rules.BASE)
        assert told[r.doc_id] == ("base" if base else next((x.name for x in order if r[x.name]), None))


def test_language(spark, docs):
    got = {r.doc_id: r for r in queries.op10_language(spark, SF).collect()}
    held = [(got[d["doc_id"]].lang_pred, d["lang"]) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([a == b for a, b in held if b]) > 0.9


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_codewords_are_decoded_by_brute_force():
    """The nearest codeword under the bits' losses, for one text after the other."""
    rng = np.random.default_rng(3)
    x = language.grams(["the cat sat on the mat", "el gato come pan", "der hund ist da", "", "le chat est la"])
    model = language.fit_codes(x, ["en", "es", "de", "en", "fr"])
    which, lead = model.decode(x)
    for row, w, s in zip(x, which, lead, strict=True):
        margin = row @ model.weights + model.bias
        losses = [sum(t * np.log1p(np.exp(-m * c)) for m, c, t in zip(margin, code, model.trust, strict=True)) for code in model.code]
        shares = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        assert w == int(np.argmin(losses)) and abs(s - shares.max()) < 1e-6
    code = language.codewords(9)
    assert min((code[a] != code[b]).sum() for a in range(9) for b in range(a)) >= 3 and rng is not None


def plain_best_fit(sizes, capacity):
    left, out = [], []
    for size in sizes:
        fits = [(x, k) for k, x in enumerate(left) if x >= size]
        at = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(max(capacity, size))
        left[at] -= size
        if left[at] == 0:
            left[at] = -1
        out.append(at)
    return out, len(left)


def test_tree_is_plain_best_fit():
    rng = np.random.default_rng(4)
    for n, capacity in ((0, 10), (1, 10), (500, 1000), (2000, 97), (50, 5)):
        sizes = sorted(rng.integers(1, capacity + 3, n).tolist(), reverse=True)
        assert sharding.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)


def test_select_of_elias_fano():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (200, 3), (1000, 10**9), (5000, 5001)):
        values = np.sort(rng.integers(0, top, n))
        code = token_files.EliasFano(n, *token_files.EliasFano.encode(values))
        assert [code.select(k) for k in range(n)] == values.tolist() == code.all().tolist()
