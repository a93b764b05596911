"""Each stage of the pipeline on its own input against brute force or SQL."""

from __future__ import annotations

import duckdb
from test_queries import SF, ids, rows
from test_similar import brute

import corpus_pipeline
from chronoply.llm import quality, queries


def told(sql: str) -> dict[int, dict]:
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return {r[0]: dict(zip(names, r, strict=True)) for r in cur.fetchall()}


def kept(spark, stage) -> list[int]:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    return sorted(r.doc_id for r in out.select("doc_id").collect())


def test_filters_keep_what_their_operators_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in rows("documents")}
    scores = dict(zip(texts, model.score(quality.features(list(texts.values()))), strict=True))
    assert kept(spark, corpus_pipeline.keep_quality) == sorted(d for d, s in scores.items() if s >= 0.3)
    assert kept(spark, corpus_pipeline.keep_by_rules) == sorted(d for d, r in told(queries.OP9_SQL).items() if r["kept"])
    assert kept(spark, corpus_pipeline.drop_contaminated) == sorted(d for d, r in told(queries.OP4_SQL).items() if not r["contaminated"])


def test_one_of_each_group_stays(spark):
    want = brute([(d["doc_id"], d["text"]) for d in rows("documents")])
    assert kept(spark, corpus_pipeline.keep_one_of_each) == sorted(set(want.values()))


def test_packing_holds_every_token(spark):
    out = corpus_pipeline.pack(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    total: dict[int, int] = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {d["doc_id"]: len(ids("byte_bpe_50k.json", d["text"])) // 4 for d in rows("documents")}
