from __future__ import annotations

from quarrylight.operators import index
from quarrylight.streaming.ingest import append_postings, merged_postings
from tests.conftest import rows


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"term{i % 3} the end {i}") for i in range(20)] + [(99, None)], "doc_id bigint, text string")
    docs.where("doc_id < 10").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for more in (None, docs.where("doc_id >= 10")):
        if more is not None:
            more.write.mode("append").parquet(str(tmp_path / "in"))
        append_postings(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert rows(merged_postings(spark, str(tmp_path / "out"))) == rows(index.sized_postings(docs))
