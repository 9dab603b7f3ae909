"""Retrieval for question answering: texts in, chunks stored as records, prompts and answers out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.errors import Other
from nearfield.functions.metrics import Metric
from nearfield.functions.text import chunk_column, is_valid_chunk
from nearfield.operators.collection import Collection
from nearfield.sources.services import ApiChat, Embedder, auto_embedder, embedding
from nearfield.sources.store import RECORD_SCHEMA, Projects, read_texts

#: Fixed texts of the prompt, and chunks in it.
SYSTEM = 'Answer the question clearly and concisely using the context below. Do not say "according to the context" or "the text states" — just answer naturally.'
PROMPT = "Answer the question using only the context below.\n\nContext:\n{context}\n\nQuestion: {question}"
SEPARATOR, DEPTH = "\n---\n", 3


def chunked(texts: DataFrame, size: int) -> DataFrame:
    """(path, i, text) of the valid chunks of (path, text); i counts them from 0 in each text."""
    rows = texts.select("path", F.posexplode(chunk_column(F.col("text"), size)).alias("pos", "text")).where(is_valid_chunk(F.col("text")))
    return rows.withColumn("i", F.row_number().over(W.partitionBy("path").orderBy("pos")) - 1).select("path", "i", "text")


def prompt_column(question: Column, ranked: Column) -> Column:
    """The prompt from a question and an array of structs (rank, text)."""
    context = F.array_join(F.transform(F.array_sort(ranked), lambda x: x["text"]), SEPARATOR)
    head, _, rest = PROMPT.partition("{context}")
    middle = rest.partition("{question}")[0]
    return F.concat(F.lit(head), context, F.lit(middle), question)


class RagEngine:
    def __init__(self, spark: SparkSession, projects: Projects, embedder: Embedder | None = None, chat: Callable[[str, str], str] | None = None):
        self.spark, self.projects = spark, projects
        self.embedder = embedder or auto_embedder()
        self.chat = chat
        self._chunks: list[str] = []
        self.collection = Collection(spark.createDataFrame([], RECORD_SCHEMA))

    def init(self, name: str) -> None:
        if self.projects.exists(name):
            raise Other(f"project '{name}' already exists")
        self.projects.save(name, self.spark.createDataFrame([], RECORD_SCHEMA))

    def load(self, name: str) -> RagEngine:
        records = self.projects.load(name)
        if records.isEmpty():
            raise Other(f"project '{name}' is empty. Run 'add' first.")
        self.collection = Collection(records)
        return self

    def save(self, name: str) -> None:
        self.projects.save(name, self.collection.records())
        if self._chunks:
            self.collection = Collection(self.projects.load(name))
            for folder in self._chunks:
                self.projects.remove(folder)
            self._chunks = []

    def records_of(self, texts: DataFrame, size: int) -> DataFrame:
        """The records of (path, text): id path:i, source, text and its vector."""
        rows = chunked(texts, size)
        return rows.select(F.concat_ws(":", "path", F.col("i").cast("string")).alias("id"), embedding(F.col("text"), self.embedder).alias("vector"), F.col("path").alias("source"), "text")

    def ingest(self, path: str, size: int, pdf_text: Callable[[bytes], str] | None = None) -> int:
        """Adds the files at a path; gives the number of chunks. Files read again replace their chunks."""
        return self.ingest_texts(read_texts(self.spark, path, pdf_text), size)

    def ingest_texts(self, texts: DataFrame, size: int) -> int:
        """The same for a table (path, text). Vectors are made once and kept beside the projects until the next save."""
        folder = f"{self.projects.base}/_chunks-{uuid.uuid4().hex}"
        self.records_of(texts, size).write.parquet(folder)
        self._chunks.append(folder)
        rows = self.spark.read.parquet(folder)
        n = rows.count()
        if n:
            self.collection = self.collection.insert(rows)
        return n

    def _vector(self, text: str) -> list[float]:
        return self.embedder.embed([text])[0]

    def query(self, text: str, k: int) -> list[str]:
        """The texts of the k nearest chunks, each id once; records without text are left out."""
        rows = self.collection.search(self._vector(text), k, Metric.COSINE).select("id", "text").collect()  # k rows
        return [t for t in {r["id"]: r["text"] for r in reversed(rows)}.values() if t is not None][::-1]

    def query_filtered(self, text: str, condition: str, k: int) -> list[str]:
        rows = self.collection.search_filtered(self._vector(text), k, condition, Metric.COSINE).select("text").collect()  # k rows
        return [r["text"] for r in rows if r["text"] is not None]

    def prompt(self, question: str) -> str:
        return PROMPT.format(context=SEPARATOR.join(self.query(question, DEPTH)), question=question)

    def generate(self, question: str) -> str:
        return (self.chat or ApiChat.from_env())(SYSTEM, self.prompt(question))

    def prompts(self, questions: DataFrame) -> DataFrame:
        """(query_id, prompt) for questions (query_id, question), in one batch search."""
        asked = questions.select("query_id", "question", embedding(F.col("question"), self.embedder).alias("query_vector"))
        near = self.collection.search_batch(asked.select("query_id", "query_vector"), DEPTH, Metric.COSINE)
        texts = near.join(self.collection.records().select("id", "text"), "id").where("text is not null")
        ranked = texts.groupBy("query_id").agg(F.collect_list(F.struct("rank", "text")).alias("ranked"))  # DEPTH rows a group
        joined = questions.join(ranked, "query_id", "left")
        return joined.select("query_id", prompt_column(F.col("question"), F.coalesce("ranked", F.array().cast("array<struct<rank:int,text:string>>"))).alias("prompt"))
