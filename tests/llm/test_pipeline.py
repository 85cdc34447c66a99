"""The corpus pipeline against plain versions of its stages, and the queries against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetscope.llm.common import n_words, table, written
from fleetscope.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.test_near_copies import plain_kept
from tools.check_queries import TABLES, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    problem, _ = compare(QUERIES[name](spark, folder), duck, ORACLES[name])
    assert problem is None, problem


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, SMALL))
        assert docs.columns == before.columns
        assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        kept[name] = before, docs
    before, after = kept["quality classifier"]
    assert after.exceptAll(before).count() == 0
    before, after = kept["line dedup"]
    assert before.select("doc_id").exceptAll(after.select("doc_id")).count() == 0
    before, after = kept["near dedup"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == plain_kept(rows)
    before, after = kept["source mix"]
    words = [x.agg(F.sum(n_words(F.col("text")))).first()[0] for x in (before, after)]
    assert abs(words[0] - words[1]) < 64 * 64
    final = corpus_pipeline.run(spark, SMALL)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert final.count() == after.count()
