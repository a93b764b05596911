"""Fill-in-the-middle against plain Python, on odd texts and the whole small table."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import oracle
from pyspark.sql import functions as F

from chronoply.llm import infill, queries
from test_queries import SF


def plain(doc, text, seed=42, percent=50, first=80):
    t = text or ""
    units = re.findall(infill.UNITS, t)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    draws = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(d % (len(units) + 1) for d in draws[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= percent:
        return len(units), "plain", None, None, t
    spm = draws[3] % 100 < first
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_query(spark):
    assert not oracle.differs(spark, oracle.connection(SF), queries.op13_infill, queries.oracle_sql()["op13_infill"], SF)
    docs = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = {d: plain(d, t) for d, t in docs}
    got = {r.doc_id: r for r in queries.op13_infill(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {d: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) for d, r in got.items()} == {d: (*w[:4], sha(w[4])) for d, w in want.items()}
    assert all(got[d].restored_sha256 == sha(t or "") for d, t in docs)


def test_odd_texts(spark):
    texts = ["", None, " ", "\n\n", "a", " a ", "<P", "x<S>y", "S> M> <", "a\x00b \x85c d", "漢字 é \U0001f600 \U0001f600x", "<M", ">", "<", "a <S b <P c <M d", "w " * 5_000 + "\r\n" * 50]
    rows = [(d, t) for d in (1, 2, 3, 4, 5, 6, 7, 8, None) for t in texts for _ in range(2)]
    df = spark.createDataFrame([(d, t, "?", 1, None) for d, t in rows], "doc_id long, text string, form string, n int, output string").repartition(5)
    for percent, first in ((50, 80), (100, 0), (100, 100), (0, 50)):
        made = infill.fill_in_middle(df, percent=percent, suffix_first=first)
        got = made.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
        assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((d, t or "", *plain(d, t, percent=percent, first=first)) for d, t in rows)
        assert all(r.back == r.text for r in got)
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_long_texts_are_split_like_whole_ones():
    text = "  one\ttwo \U0001f600 漢字\n\n" * 400 + "x" * 900 + " " * 300
    want = [m.end() for m in re.finditer(infill.UNITS, text)]
    for chunk in (1, 7, 64, 1000, 1 << 20):
        assert infill.unit_ends(text, chunk).tolist() == want
