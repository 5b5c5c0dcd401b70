import hashlib

import corpus_pipeline
from tests.llm.helpers import docs, words


def test_decoded_bytes_are_the_texts(spark, tmp_path):
    table = [(i, words(i, 120) + " ünï 世界 🙂", f"s{i % 2}") for i in range(40)]
    docs(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {i: t for i, t, _ in table}
    assert rows and all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_writing_leaves_no_intermediate_tables(spark, tmp_path):
    import corpus_pipeline
    from panelspark.llm import common
    from tests.llm.helpers import docs, words

    docs(spark, [(i, words(i, 120 + i), f"s{i % 2}") for i in range(30)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    corpus_pipeline.write(spark, str(tmp_path), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0 and common._WRITTEN == []
