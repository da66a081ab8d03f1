"""The pipeline's stages over nulls, empty and repeated rows, and columns called like those the stages use."""

import corpus_pipeline as pipeline

FOLDER = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, __row long, __file string, "
          "__at int, __time double, row string, component_id string")
LONG = " ".join(f"w{i}" for i in range(40_000))
ROWS = [(1, "a plain text of a few words", "en", "a", 5, "mine", 7, 3, "f", 1, .5, "r", "c"), (2, None, None, None, None, None, None, None, None, None, None, None, None),
        (3, "", "", "", 0, "", 0, 0, "", 0, .0, "", ""), (4, "same text twice over here", "en", "a", 3, "m", 1, 1, "f", 1, .5, "r", "c"),
        (4, "same text twice over here", "en", "a", 3, "m", 1, 1, "f", 1, .5, "r", "c"), (None, "no id here at all today", "de", "b", 1, "z", 3, 1, "f", 1, .5, "r", "c"),
        (5, LONG, "en", "b", len(LONG), "q", 4, 1, "f", 1, .5, "r", "c")]


def test_every_stage_keeps_columns_and_rows_of_odd_documents(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path := str(tmp_path / "docs"))
    docs = spark.read.parquet(path)
    want = {"drop_toxic": 7, "drop_near_duplicates": None, "drop_contaminated": 7, "mix_sources": None, "deal_shards": 7}
    for given in (docs, spark.createDataFrame(ROWS, SCHEMA)):
        for _, stage in pipeline.STAGES:
            out = stage(spark, given, FOLDER)
            rows = out.collect()
            if stage.__name__ == "deal_shards":
                assert set(out.columns) == {*docs.columns, "shard_given", "slot_given"}
                assert {(r["shard"], r["slot"]) for r in rows} == {(0, i) for i in range(7)}
                assert sorted(r["shard_given"] or "" for r in rows) == sorted(r[5] or "" for r in ROWS)
            else:
                assert out.columns == docs.columns
                assert {tuple(r) for r in rows} <= set(ROWS)
            if want[stage.__name__] is not None:
                assert len(rows) == want[stage.__name__]
        # Nulls and empty texts share fingerprint 0 and are one group; the repeated rows are another.
        kept = [r["doc_id"] for r in pipeline.drop_near_duplicates(spark, given, FOLDER).collect()]
        assert sorted(kept, key=str) == [1, 2, 4, 5, None]


def test_an_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []
