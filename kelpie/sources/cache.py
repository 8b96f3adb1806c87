"""The embedding cache: a Parquet table by model identity and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import embed, text
from kelpie.sources.store import ChangeLog

SCHEMA = "identity string, content_hash string, embedding array<double>"


class EmbeddingCache:
    """Only distinct texts that the cache lacks reach the model; hits need the same model identity."""

    def __init__(self, spark: SparkSession, path: str, identity: str, embedder: embed.Embedder = embed.hashing_embedder):
        self.log, self.identity, self.embedder = ChangeLog(spark, path, {"cache": SCHEMA}, ["identity", "content_hash"]), identity, embedder
        #: Texts that went to the model and their tokens, about, observed as they did.
        self.counters = {"embedded": 0, "tokens": 0}

    def entries(self) -> DataFrame:
        return self.log.read("cache").filter(F.col("identity") == self.identity)

    def misses(self, hashed: DataFrame) -> DataFrame:
        """Of rows with a content_hash one for each that the cache lacks."""
        return hashed.dropDuplicates(["content_hash"]).join(self.entries().select("content_hash"), "content_hash", "left_anti")

    def embed(self, rows: DataFrame, column: str = "content") -> DataFrame:
        """Adds embedding to the rows, and what was missing to the cache."""
        hashed = rows.drop("embedding").withColumn("content_hash", text.content_hash(column))
        seen = Observation()
        missing = self.misses(hashed).select("content_hash", column).observe(seen, F.count(F.lit(1)).alias("embedded"), F.sum(text.token_estimate(column)).alias("tokens"))
        new = embed.embed(missing, column, self.embedder).select(F.lit(self.identity).alias("identity"), "content_hash", "embedding")
        self.log.commit(None, {"cache": new})
        for k, n in seen.get.items():
            self.counters[k] += n or 0
        return hashed.join(self.entries().select("content_hash", "embedding"), "content_hash")

    def clear(self) -> None:
        self.log.commit(self.entries(), {})

    def stats(self) -> dict[str, int]:
        return {r["identity"]: r["count"] for r in self.log.read("cache").groupBy("identity").count().collect()}
