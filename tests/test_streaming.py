from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.index import build_index
from lodestone.streaming.updates import append_documents, start_index


def test_stream_gives_the_batch_index(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/ix"
    rows = [(1, "cat dog"), (2, "dog"), (3, "")]
    spark.createDataFrame(rows[:2], "doc_id long, text string").write.parquet(f"file://{src}/a")
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(f"file://{src}/*")
    append_documents(stream(), out).awaitTermination()
    spark.createDataFrame(rows[2:] + [(1, "bird")], "doc_id long, text string").write.parquet(f"file://{src}/b")
    append_documents(stream(), out).awaitTermination()
    want = build_index(spark.createDataFrame([(1, "bird"), (2, "dog"), (3, "")], "doc_id long, text string"), tokens(F.col("text")))
    got = start_index(spark, out)
    for part in ("postings", "terms", "docs", "meta"):
        assert sorted(map(tuple, getattr(got, part).collect())) == sorted(map(tuple, getattr(want, part).collect()))
