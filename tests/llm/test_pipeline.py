"""The stages one after the other, each against its own rule."""

import glob
import os

import duckdb
import pytest
from test_llm import contaminated, linked

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.collect())
    clean, single, decon, mixed, tokens = kept
    want = {k for k, _, c in linked([(r.doc_id, r.text) for r in clean]) if k == c}
    assert {r.doc_id for r in single} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in single for n, h, _ in [contaminated(r.text, items)] if h and 20 * h >= n}
    assert {r.doc_id for r in decon} == want - bad and sorted(decon) == sorted(mixed)
    assert [r.doc_id for r in sorted(tokens, key=lambda r: r.start)] == [r.doc_id for r in mixed]
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(again) == sorted(tokens)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_source_mixing", "op7_benchmark_decontamination", "op8_ngram_jaccard_join", "op10_exact_top_k"])
def test_same_as_sql(spark, name):
    from runlens.llm import queries

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[at[c]] for c in columns]) for r in rel.fetchall())
