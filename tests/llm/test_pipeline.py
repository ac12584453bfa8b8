"""The pipeline against a plain version on a small table."""

import duckdb

import corpus_pipeline
from gaugeworks.llm import mixing, tokens
from test_operators import SCHEMA, corpus, plain_components, plain_lines


def test_pipeline(spark, tmp_path):
    rows = [r for r in corpus(8, 40) if r[0] != 103]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    outs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"{i}-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}-{name}"))
        outs.append(docs)
        if i < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = {r[0]: r[1] for r in rows}
    known = {d: t for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in outs[0].collect()} == set(known)
    kept = {d: t for d, t in plain_lines(list(known.items())).items() if t is not None}
    assert {r["doc_id"]: r["text"] for r in outs[1].collect()} == kept
    parts = plain_components(list(kept.items()), 5, 80, 100)
    assert {r["doc_id"] for r in outs[2].collect()} == {d for d, (_, c) in parts.items() if c == d}
    db = duckdb.connect()
    db.sql(f"create view documents as from '{tmp_path}/2-ngram_jaccard/*.parquet'")
    taken = {d: t // s for d, s, t in db.sql(f"select doc_id, size, taken from ({mixing.SQL})").fetchall() if s}
    got = {}
    for r in outs[3].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if d in taken}
    code = tokens.coder(tokens.tokenizer_path())
    want = sum(len(code.ids(r["text"])) + 1 for r in outs[3].collect())
    assert outs[4].agg({"length": "sum"}).first()[0] == want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
