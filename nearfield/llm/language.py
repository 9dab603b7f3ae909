"""Language identification by nearest centroid.

A text is a vector of byte trigram counts, hashed to ``DIMS`` places, weighed by inverse document
frequency and scaled to length 1. Each language has several centroids, found by spherical k-means
on a bounded sample of its labelled texts. A text gets the language of the nearest centroid by
cosine; it is rejected if it lies further away than nearly all texts of that language did in
training, with a margin.

The document frequencies cover all training rows; only the centroids are fitted on a sample, of
about ``PER_LANG`` rows a language, chosen by a hash of the id, and for the ``LANGS`` values of lang that most
training rows have. The driver holds the sample of one language at a time.

The limit of rejection is half of the similarity that all but 2 % of a language's sample reach. Of texts of
the tables here that were held out, it rejects less than one in a thousand, nearly all of them keys, numbers or
shouting; of a language that was not learned nearly all (see the tests).

Defined results. Null text, or text without a letter: ``und``, score 0, rejected. Nothing to learn
from: every text is ``und``. Equal texts get equal results; a tie goes to the language that comes
first in code point order. An empty table makes no rows. Texts may be of any length, and are counted whole. Rows
that share a doc_id are texts of their own; null ids are not held out. Further columns are left alone, but for
those named like the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm._shared import arrow_batches, held_out

DIMS = 4096
#: Labelled rows a language that the centroids are fitted on, centroids a language, languages at most.
PER_LANG, CENTROIDS, LANGS = 500, 4, 512
#: A text is rejected below this share of the similarity that all but REJECT_TAIL of a language's texts reach.
#: Texts of languages that were not learned stay under 0.17 there, learned ones reach 0.34 and more.
REJECT_SHARE, REJECT_TAIL = 0.5, 0.02
#: Distinct trigrams from which that limit holds in full; with fewer the cosine is low for any text, by their root.
ENOUGH = 100
#: A cluster of fewer rows than this share of a language's sample (two at least) is outliers, and dropped.
LEAST_CLUSTER = 0.02
UNKNOWN = "und"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BLOCK = 256


def has_letter(text: bytes) -> bool:
    """Whether the text has a letter of any script."""
    folded = text.translate(_FOLD).translate(None, b" ")
    if not folded:
        return False
    return any(97 <= c <= 122 for c in folded[:64]) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def counts(texts: list[bytes]) -> np.ndarray:
    """A row of trigram counts for each text, runs of blanks as one."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(b" " + b" ".join(t.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            code *= np.uint32(2654435761)
            out[i] = np.bincount(code >> np.uint32(20), minlength=DIMS)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length 1; the first is the mean's nearest row, each next one the row furthest from those chosen."""
    k = min(k, len(rows))
    chosen = [int(np.argmax(rows @ rows.mean(0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(1))))
    centroids = rows[chosen]
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(1)
        centroids = unit(np.stack([rows[own == j].mean(0) if (own == j).any() else centroids[j] for j in range(k)]))
    sizes = np.bincount((rows @ centroids.T).argmax(1), minlength=k)
    return centroids[sizes >= min(sizes.max(), max(2, LEAST_CLUSTER * len(rows)))]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[bytes | None]) -> Iterator[tuple[str, float, bool]]:
        for a in range(0, len(texts), _BLOCK):
            part = texts[a : a + _BLOCK]
            made = counts([t or b"" for t in part])
            evidence = np.sqrt(np.minimum(1, (made > 0).sum(1) / ENOUGH))
            likeness = unit(made * self.idf) @ self.centroids.T if self.langs else None
            for i, t in enumerate(part):
                if not self.langs or not t or not has_letter(t):
                    yield UNKNOWN, 0.0, True
                    continue
                best = int(likeness[i].argmax())
                lang = int(self.owner[best])
                score = float(min(1.0, max(0.0, likeness[i, best])))
                yield self.langs[lang], score, score < self.least[lang] * evidence[i]


def fit(training: DataFrame, *, per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> Model:
    """Learns from columns doc_id, text, lang; rows with a null in any of them are left out."""
    arrow_batches(training.sparkSession)
    rows = training.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").dropna()
    counted = rows.groupBy("lang").count()
    total = counted.agg(F.sum("count")).first()[0] or 0
    sizes = {r["lang"]: r["count"] for r in counted.orderBy(F.col("count").desc(), "lang").limit(LANGS).collect()}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), _BLOCK):
                total += (counts(texts[a : a + _BLOCK]) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS), pa.int32()), pa.array(total)], names=["place", "n"])

    seen = np.zeros(DIMS)
    for r in rows.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        seen[r["place"]] = r["n"]
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))]) if sizes else None

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), _BLOCK):
                made = unit(counts(texts[a : a + _BLOCK]) * idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(made)), pa.array([v.tobytes() for v in made], pa.binary())], names=["lang", "vector"])

    langs, found, owner, least = [], [], [], []
    if sizes:
        chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
        sample = chosen.select("lang", "text").mapInArrow(vectors, "lang string, vector binary").orderBy("lang", "vector")
        for lang, several in groupby(sample.toLocalIterator(), lambda r: r["lang"]):
            x = unit(np.stack([np.frombuffer(bytes(r["vector"]), np.float16) for r in several]).astype(np.float32))
            c = spherical_kmeans(x, centroids)
            found.append(c)
            owner += [len(langs)] * len(c)
            langs.append(lang)
            least.append(REJECT_SHARE * np.quantile((x @ c.T).max(1), REJECT_TAIL))
    return Model(langs, idf, np.concatenate(found) if found else np.zeros((0, DIMS), np.float32), np.array(owner, int), np.array(least))


def classify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """Adds lang_pred, score and rejected, with a prefix, to the documents; columns of these names are replaced."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [prefix + n for n in ("lang_pred", "score", "rejected")]
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(shared.value.predict([t if t is None or isinstance(t, bytes) else t.encode() for t in batch.column(at).to_pylist()]))
            batch = batch.append_column(names[0], pa.array([x[0] for x in got], pa.string()))
            batch = batch.append_column(names[1], pa.array([x[1] for x in got], pa.float64()))
            yield batch.append_column(names[2], pa.array([bool(x[2]) for x in got], pa.bool_()))

    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and classifies all: the result of op2, with `rejected`."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    lean = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return classify(lean, model).drop("text")
