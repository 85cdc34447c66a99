"""Host reputation, the toxic filter and the whole pipeline on awkward and empty tables."""

import corpus_pipeline
from fleetscope.llm import host_reputation, importance
from fleetscope.llm.queries import RULES
from tests.llm.test_operators import AWKWARD, COLUMNS

LABELS = "doc_id bigint, quality int, toxic int"


def test_reputation_of_awkward_and_empty_tables(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme/en/1"), (4, "http://"), (5, "http://EXAMPLE.com/en/1?q#f"), (5, "http://EXAMPLE.com/en/1?q#f"),
        (None, "https://a.b.net/fr/2"), (7, "http://x.org/" + "long/" * 50_000), (8, "http://x.org:80/3"), (9, "http://://"),
    ]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 0), (3, 0, 1)], LABELS)
    outcomes = host_reputation.labelled_pages(pages, labels)
    found = host_reputation.judge(pages, outcomes, RULES).collect()
    assert len(found) == len(urls)
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    assert by_id[1][:2] == by_id[2][:2] == by_id[3][:2] == ("", "")
    assert by_id[5] == ("example.com", "/en/1", "example.com/en/", "block")
    assert by_id[None] == ("a.b.net", "/fr/2", "net/fr/", "block")
    none = pages.where("false")
    assert host_reputation.judge(none, host_reputation.labelled_pages(none, labels), RULES).collect() == []
    without = host_reputation.labelled_pages(pages, labels.where("false"))
    assert {r["verdict"] for r in host_reputation.judge(pages, without, []).collect()} == {"allow"}


def test_toxic_filter_of_awkward_and_empty_tables(spark):
    docs = spark.createDataFrame(AWKWARD, COLUMNS)
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, 1, None), (None, 1, 1), (99, 0, 1)], LABELS)
    for known in (labels, labels.where("false"), labels.drop("toxic")):
        kept = docs.where(importance.not_toxic(docs, known)).collect()
        assert all(tuple(r) in set(AWKWARD) for r in kept)
    assert docs.where(importance.not_toxic(docs, labels.where("false"))).count() == len(AWKWARD)
    none = docs.where("false")
    assert none.where(importance.not_toxic(none, labels)).collect() == []


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, None), (None, 1, 1), (99, 0, 1)], LABELS)
    for name, rows in (("some", AWKWARD), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        ids = [r["doc_id"] for r in found.collect()]
        assert set(ids) <= {r[0] for r in rows}
        assert bool(ids) == bool(rows)
