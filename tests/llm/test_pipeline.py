"""The pipeline's stages, one after the other, and the registered queries of the subpackage."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest


def test_stages_and_columns(spark, sf_dir, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"
    ]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        assert name == "mixing" or kept.count() <= before
        kept = kept.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in packed.collect()} == ids


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.offset + r.length <= 4096 for r in rows)


def test_odd_and_empty_tables(spark, sf_dir, odd, none):
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, df, sf_dir)
            made.collect()
            assert name == "best_fit_packing" or made.columns == df.columns


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_exact_top_k_search", "op11_source_divergence"])
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    want = sorted(cursor.fetchall())
    columns = [d[0] for d in cursor.description]
    assert sorted(tuple(r) for r in entry.queries()[name](spark, sf_dir).select(*columns).collect()) == want
