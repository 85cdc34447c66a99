"""The pipeline's quality stage on toxic documents whose labels it has not seen."""

import corpus_pipeline


def test_held_out_toxic_documents_go(spark, tmp_path):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    labels.where("pmod(doc_id, 2) = 0").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).select("doc_id").collect()}
    held = labels.where("pmod(doc_id, 2) = 1 AND quality = 1").collect()
    toxic, clean = ([r["doc_id"] in kept for r in held if r["toxic"] == t] for t in (1, 0))
    print(f"kept toxic {sum(toxic)} of {len(toxic)}, lost clean {len(clean) - sum(clean)} of {len(clean)}")
    assert sum(toxic) < 0.7 * len(toxic)
    assert sum(clean) > 0.97 * len(clean)
