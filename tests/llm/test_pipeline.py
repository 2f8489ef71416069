"""The pipeline's stages on the smallest documents."""

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == corpus_pipeline.COLUMNS, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == counts[-1]
