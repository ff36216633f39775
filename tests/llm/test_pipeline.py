def test_stages_keep_the_columns(spark):
    import corpus_pipeline
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), stage(spark, docs, DATA)
        assert docs.count() <= before, name
        if name != "sharding":
            assert docs.columns == first
    assert docs.count() > 50
