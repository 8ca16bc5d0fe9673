"""Vector stores (S7, S8) and word vectors (S10): unit vectors as Parquet, with the model's name, length and number of rows beside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.dense import normalised
from lodestone.operators.index import exists


@dataclass
class VectorStore:
    """vectors (doc_id, vec array<float>), the model's name, the length of its vectors and their number."""

    vectors: DataFrame
    model: str
    dim: int
    n: int

    def doc_ids(self) -> DataFrame:
        return self.vectors.select("doc_id")


def write_store(vectors: DataFrame, path: str, model: str) -> None:
    """Vectors (doc_id, vec) in float32 and of unit length, zero vectors as they are. Rows with a null id or vec, or a null or NaN
    in it, are left out; ids must be unique and all vectors equally long, else an error is raised."""
    whole = vectors.where("doc_id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x))")
    whole.select("doc_id", normalised(F.col("vec")).cast("array<float>").alias("vec")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    stored = spark.read.parquet(f"{path}/vectors")
    figures = stored.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if figures["least"] != figures["most"]:
        raise ValueError(f"vectors of {figures['least']} to {figures['most']} numbers in one store")
    if not stored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("doc_id is repeated")
    spark.createDataFrame([(model, figures["most"] or 0, figures["n"])], "model string, dim int, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def open_store(spark: SparkSession, path: str) -> VectorStore:
    """S8"""
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"no vector store at {path}: write one with write_store")
    meta = spark.read.parquet(f"{path}/meta").first()
    return VectorStore(spark.read.parquet(f"{path}/vectors"), meta["model"], meta["dim"], meta["n"])


def save_words(word_vectors: DataFrame, path: str) -> None:
    """A table (term, vec); the vectors as they are, with their lengths."""
    word_vectors.select("term", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
