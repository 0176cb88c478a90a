"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

Texts become rows of hashed byte bigrams and three counts of repetition (words equal to the word before, lines seen before, lines), weighted by idf and scaled to
length 1. The strongest right singular vectors of the labelled rows make a space of few dimensions, to which every
document is projected. All cosines with all labelled vectors are computed, in blocks of documents; the
nearest ones vote with their label, weighted by a power of the cosine. Values stand on a grid that makes the products exact, and equal cosines go
by the row's number, so a text's score doesn't depend on the block or task that it is in.

idf counts every document. At most `per_label` rows of each label are learned from, the first ones by a hash of doc_id; they are
what every task is sent, so its size has that bound. Labels that contradict each other for a doc_id count as the lower.

Null texts are empty; an empty text is scored like any other. Rows without a doc_id are held out. Without labels every score is 1, so nothing is rejected.
Repeated rows stay. `scored` leaves other columns out, `rejecting` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm._shared import documents, released, slices, table
from gridloom.llm.features import ngram_counts, snapped, unit
from gridloom.llm.langid import first_by_hash, held_out, idf_of

BINS, DIMENSIONS, NEIGHBOURS, POWER, PER_LABEL = 2048, 64, 15, 16, 2000
#: Terms of repetition, and what their idf is multiplied by, as three terms stand against many bigrams.
EXTRA, BOOST = 3, 3
THRESHOLD = 0.3
#: Texts that are vectors at the same time inside a task, and that are compared with all labelled ones.
ROWS, COMPARED = 256, 64
#: Bits of the grids of terms and of vectors: twice these and the row's length (12 and 6 bits) fit in a double.
TERM_GRID, VECTOR_GRID = 20, 23


def counts_of(texts: list[str], bins: int = BINS) -> np.ndarray:
    """Bigram counts, then counts of repetition."""
    more = np.zeros((len(texts), EXTRA), dtype=np.float32)
    for i, text in enumerate(texts):
        words, lines = text.split(), [x for x in text.split("\n") if x]
        more[i] = sum(map(str.__eq__, words, words[1:])), len(lines) - len(set(lines)), len(lines)
    return np.concatenate([ngram_counts(texts, bins, 2, lower=False), more], axis=1)


def _frequencies(docs: DataFrame, bins: int) -> tuple[np.ndarray, int]:
    """In how many texts each term occurs, and how many texts there are."""
    width = bins + EXTRA

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width + 1, dtype=np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                for i in range(0, len(texts), ROWS):
                    found[:width] += (counts_of(texts[i : i + ROWS], bins) > 0).sum(axis=0)
                found[width] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(found)], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(width + 1, dtype=np.int64)
    out[rows["term"]] = rows["n"]
    return out[:width], int(out[width])


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray  # terms by dimensions
    vectors: np.ndarray  # of the labelled rows
    labels: np.ndarray


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(counts) * idf)


def projected(counts: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Vectors of length 1 about, from axes on the grid."""
    return snapped(unit(snapped(weighted(counts, idf), TERM_GRID) @ axes), VECTOR_GRID)


def fitted(docs: DataFrame, labels: DataFrame, bins: int = BINS, dimensions: int = DIMENSIONS, per_label: int = PER_LABEL) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality) of rows that aren't held out; None without labels."""
    idf = idf_of(*_frequencies(docs, bins))
    idf[bins:] *= BOOST
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id")  # a label without its document takes no place in the sample
    ids = first_by_hash(known, "quality", per_label)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 x per_label ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                for i in range(0, len(texts), ROWS):
                    own = part.slice(i, ROWS)
                    rows = [zlib.compress(row.tobytes(), 1) for row in counts_of(texts[i : i + ROWS], bins)]
                    yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.int64()), own.column(2).cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "quality", "counts"])

    made = sample.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, counts binary")
    rows = made.groupBy("doc_id").agg(F.min(F.struct("quality", "counts")).alias("x")).orderBy("doc_id").select("x.*").toPandas()
    if not len(rows):
        return None
    # a block of rows at a time, as the driver holds all terms once anyway
    packed, blocks = rows["counts"].tolist(), range(0, len(rows), ROWS)
    counts = lambda i: np.frombuffer(b"".join(map(zlib.decompress, packed[i : i + ROWS])), dtype=np.float32).reshape(-1, bins + EXTRA)
    terms = np.empty((len(packed), bins + EXTRA))
    for i in blocks:
        terms[i : i + ROWS] = weighted(counts(i), idf)
    gram = terms.T @ terms
    del terms
    axes = snapped(np.linalg.eigh(gram)[1][:, ::-1][:, :dimensions], TERM_GRID)  # right singular vectors, weakest first
    del gram
    model = Model(idf, axes, np.concatenate([projected(counts(i), idf, axes) for i in blocks]), rows["quality"].to_numpy(dtype=np.float64))
    released()
    return model


def votes(texts: list[str], m: Model | None, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
    """The score of each text."""
    if m is None:
        return np.ones(len(texts))
    out = []
    for i in range(0, len(texts), COMPARED):
        cosines = projected(counts_of(texts[i : i + COMPARED], len(m.idf) - EXTRA), m.idf, m.axes) @ m.vectors.T
        k = min(neighbours, cosines.shape[1])
        least = np.partition(cosines, -k, axis=1)[:, -k :][:, :1]
        over, tied = cosines > least, cosines == least
        near = over | tied & (np.cumsum(tied, axis=1) <= k - over.sum(axis=1, keepdims=True))  # of the tied, the first rows
        at = np.nonzero(near)[1].reshape(-1, k)
        weight = np.clip(np.take_along_axis(cosines, at, axis=1), 1e-3, 1) ** power
        out.append((weight * m.labels[at]).sum(axis=1) / weight.sum(axis=1))
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def rejecting(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with the score as one more column."""
    kept, docs = docs.sparkSession.sparkContext.broadcast(model), docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(votes(texts, kept.value))], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op8_lsa_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = rejecting(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
