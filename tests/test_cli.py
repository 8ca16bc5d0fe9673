import json

import pytest
from pyspark.sql import functions as F

from lodestone.cli import main
from lodestone.operators import dense


def test_build_search_evaluate(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"doc_id": "a", "raw_text": "cat dog"}, {"doc_id": "b", "tokens": ["dog"], "raw_text": "x"}, {"doc_id": "c", "raw_text": ""}]))
    ix = f"file://{tmp_path}/ix"
    assert "| True | False | False | False | 3 | 1.0 | 2 |" in main(["build", "--corpus", f"file://{tmp_path}/c.json", "--index", ix], spark)
    assert main(["status", "--index", ix], spark).count("\n") == 2
    assert "cat dog" in main(["search", "cat", "--index", ix, "--model", "tfidf"], spark)
    spark.createDataFrame([("1", "dog")], "query_id string, title string").write.parquet(f"file://{tmp_path}/q")
    spark.createDataFrame([("1", "b", 1)], "query_id string, doc_id string, relevance int").withColumn("judged_at", F.current_timestamp()).write.parquet(f"file://{tmp_path}/r")
    out = tmp_path / "out.json"
    main(["evaluate", "--index", ix, "--queries", f"file://{tmp_path}/q", "--qrels", f"file://{tmp_path}/r", "--out", str(out)], spark)
    assert json.loads(out.read_text()) == [{"model": "bm25", "map": 1.0, "recall": 1.0, "p_at_k": 0.1, "ndcg_at_k": 1.0, "num_queries": 1}]
    (tmp_path / "d.json").write_text(json.dumps([{"doc_id": "a"}, {"doc_id": "a"}]))
    with pytest.raises(ValueError):
        main(["build", "--corpus", f"file://{tmp_path}/d.json", "--index", ix], spark)


ENCODER = """
class Letters:
    def encode(self, texts):
        return [[t.count(c) for c in "acdgt"] for t in texts]
"""


def test_models_analyser_and_comparison(spark, tmp_path, monkeypatch):
    (tmp_path / "letters.py").write_text(ENCODER)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "letters.py"))
    texts = {"a": "Running dogs and cats", "b": "A cat runs", "c": "The birds are singing", "d": "Dogs sing", "e": ""}
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"doc_id": k, "raw_text": v}) for k, v in texts.items()))
    ix = f"file://{tmp_path}/ix"
    report = main(["build", "--corpus", f"file://{tmp_path}/c.json", "--format", "jsonl", "--index", ix, "--stem", "--stop-words", "--models", "word2vec", "bert", "--encoder", "letters:Letters", "--dim", "4", "--epochs", "1"], spark)
    assert "| True | True | True | True | 5 |" in report
    hits = lambda *a: main(["search", *a, "--index", ix, "--encoder", "letters:Letters"], spark)
    assert hits("the runs").count("\n") == 3 and hits("singing dog", "--model", "serial").count("\n") >= 3
    for model in ("tfidf", "bert", "word2vec", "parallel"):
        assert hits("dog cat", "--model", model, "--top-k", "2").count("\n") >= 2
    spark.createDataFrame([("1", "dosg sing")], "query_id string, title string").write.parquet(f"file://{tmp_path}/q")
    spark.createDataFrame([("1", "d", 1)], "query_id string, doc_id string, relevance int").withColumn("judged_at", F.current_timestamp()).write.parquet(f"file://{tmp_path}/r")
    spark.createDataFrame([("dogs",), ("sing",)], "word string").write.parquet(f"file://{tmp_path}/d")
    common = ["evaluate", "--index", ix, "--queries", f"file://{tmp_path}/q", "--qrels", f"file://{tmp_path}/r", "--dictionary", f"file://{tmp_path}/d"]
    assert "| map | " in main([*common, "--compare"], spark)
    assert "| bm25 | 1.0 |" in main([*common, "--refine"], spark)
    with pytest.raises(ValueError):
        main(["build", "--corpus", f"file://{tmp_path}/c.json", "--format", "jsonl", "--index", ix, "--models", "bert"], spark)
    out = f"file://{tmp_path}/out"
    (tmp_path / "raw.json").write_text(json.dumps([{"doc_id": 1, "text": " ", "body": "Running cats"}]))
    main(["preprocess", "--corpus", f"file://{tmp_path}/raw.json", "--fields", "text", "body", "--stem", "--out", out], spark)
    assert spark.read.json(out).first().asDict() == {"doc_id": "1", "raw_text": "Running cats", "tokens": ["run", "cat"]}
    main(["build", "--service", "--corpus", out, "--format", "jsonl", "--index", f"file://{tmp_path}/ix2"], spark)
    assert "| False | False | False | None |" in main(["status", "--index", f"file://{tmp_path}/none"], spark)


def test_window_pairs(spark):
    df = spark.createDataFrame([(1, list("abcd")), (2, ["x"]), (3, None), (4, [])], "doc_id long, tokens array<string>")
    got = sorted(map(tuple, dense.window_pairs(df, 2).collect()))
    assert got == sorted((a, b) for i, a in enumerate("abcd") for j, b in enumerate("abcd") if 0 < abs(i - j) <= 2)
    drawn = {tuple(r) for r in dense.window_pairs(df, 2, seed=13).collect()}
    assert drawn <= set(got) and {a for a, _ in drawn} == set("abcd")


def test_vocabulary_and_shares(spark):
    df = spark.createDataFrame([(["b", "a", "b", "a", "c", None],)], "tokens array<string>")
    v = dense.training_vocabulary(df)
    assert list(map(tuple, v.collect())) == [("a", 2), ("b", 2)]
    assert {r.term: r.share for r in dense.sampling_shares(v).collect()} == {"a": 0.5, "b": 0.5}
