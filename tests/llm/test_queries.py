"""The registered queries on the smallest tables: SQL where there is one, plain rows elsewhere."""

import os

import duckdb
import pytest

import corpus_pipeline
from glotweave.llm.oracle import ORACLE
from glotweave.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df, rel = QUERIES[name](spark, SF), c.sql(ORACLE[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(repr(tuple(x[i] for i in at)) for x in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Every stage keeps columns and rows of its input; the result is the last stage's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "copy"]
    got = out.collect()
    assert {r["doc_id"] for r in got} <= ids and len(got) == len({(r["doc_id"], r["copy"]) for r in got})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mixing"]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        part = stage(spark, empty, SF)
        assert part.count() == 0 and part.columns[: len(docs.columns)] == docs.columns, name
