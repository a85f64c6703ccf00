"""What turns texts into vectors: a table in, a table out."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.index import DIMENSIONS, hashed_vectors


class EmbeddingUnavailable(RuntimeError):
    """The model cannot be reached or gives no usable answer."""


class Hashing:
    """Counts of hashed tokens at unit length; needs no service."""

    model, dimensions = "hashing-64", DIMENSIONS

    def embed(self, texts: DataFrame) -> DataFrame:
        """(text_hash, embedding) of texts(text_hash, text), one row each."""
        return hashed_vectors(texts, ["text_hash"]).withColumnRenamed("vector", "embedding")


class Served:
    """A model behind HTTP: POST {model, input: [texts]} gives {embeddings: [vectors]}.  Executors ask, ``batch`` texts at a time.

    Vectors are brought to unit length.  ``dimensions`` is learned from the first answer unless it is given.
    """

    def __init__(self, url: str, model: str, dimensions: int | None = None, batch: int = 32, timeout: float = 60.0):
        self.url, self.model, self._dimensions, self.batch, self.timeout = url, model, dimensions, batch, timeout

    @property
    def dimensions(self) -> int:
        if self._dimensions is None:
            self._dimensions = len(_asked(self.url, self.model, ["size"], self.timeout)[0])
        return self._dimensions

    def embed(self, texts: DataFrame) -> DataFrame:
        url, model, batch, timeout = self.url, self.model, self.batch, self.timeout

        def run(parts):
            for pdf in parts:
                vectors = []
                for at in range(0, len(pdf), batch):
                    vectors += _asked(url, model, pdf["text"].iloc[at : at + batch].tolist(), timeout)
                yield pdf[["text_hash"]].assign(embedding=vectors)

        return texts.select("text_hash", "text").mapInPandas(run, "text_hash string, embedding array<double>")


def _asked(url: str, model: str, texts: list[str], timeout: float) -> list[list[float]]:
    request = urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            vectors = json.load(answer)["embeddings"]
    except (OSError, urllib.error.URLError, ValueError, KeyError, TypeError) as e:
        raise EmbeddingUnavailable(f"no embeddings from {url}: {e}") from e
    if len(vectors) != len(texts) or any(not v for v in vectors):
        raise EmbeddingUnavailable(f"{len(vectors)} embeddings for {len(texts)} texts")
    norms = [sum(x * x for x in v) ** 0.5 or 1.0 for v in vectors]
    return [[x / n for x in v] for v, n in zip(vectors, norms)]


def made_by(settings: dict):
    """The embedder that a configuration's ``embedding`` names: with a url a served one."""
    if settings.get("url"):
        return Served(settings["url"], settings["model"], settings.get("dimensions"), settings.get("batch", 32), settings.get("timeout", 60.0))
    return Hashing()


def one_vector(embedder, asked: DataFrame) -> DataFrame:
    """asked(query_id, question) with ``vector``; EmbeddingUnavailable if the model does not answer."""
    texts = asked.select(F.col("query_id").cast("string").alias("text_hash"), F.col("question").alias("text"))
    try:
        got = [(r["text_hash"], [float(x) for x in r["embedding"]]) for r in embedder.embed(texts).collect()]
    except PySparkException as e:
        if EmbeddingUnavailable.__name__ in str(e):
            raise EmbeddingUnavailable(str(e).strip().splitlines()[-1]) from e
        raise
    vectors = asked.sparkSession.createDataFrame(got, "id string, vector array<double>")
    return asked.join(vectors, asked.query_id.cast("string") == vectors.id).drop("id")
