"""Language identification by nearest centroids of TF-IDF character n-grams.

Texts become rows of hashed trigrams of their letters' bytes, weighted by idf and scaled to length 1. For each language, k-means on
a sample of its texts gives several centroids. A text gets the language of the centroid with the
greatest cosine; `rejected` says that even that one is further than all but a small share of its own training texts are.

idf counts every document with a known language that is not held out; the centroids are fitted on at most `per_lang` texts
of each language, the first ones by a hash of doc_id. A language's rows are
fitted in one task, which has that bound; the driver is sent the centroids, and so are all tasks. Every language is learned: more than `most_langs` of them, whose centroids would be half a gigabyte, raise ValueError. Products are of values on a grid, so exact: equal texts have equal scores.

A text that is null or has no letter is `und`, with score 0 and rejected. Where nothing can be learned, every text is `und`. Null doc_ids are never
learned from, and count as held out. Repeated rows stay; other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._shared import documents, slices
from gridloom.llm.features import ngram_counts, snapped, tf_idf, unit

BINS, GRAM, CENTROIDS, PER_LANG, MOST_LANGS, REJECTED_SHARE = 4096, 3, 4, 400, 4096, 0.005
#: Bits of the values' grid: twice this and 12 for the row's length fit in a double.
GRID = 20
#: Texts that are vectors at the same time inside a task.
ROWS = 512


def held_out() -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_frequencies(docs: DataFrame, bins: int, gram: int) -> tuple[np.ndarray, int]:
    """In how many texts each bin occurs, and how many texts there are: sums of one row of each bin from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(bins + 1, dtype=np.int64), 0
        for batch in batches:
            for _, texts in slices(batch):
                for i in range(0, len(texts), ROWS):
                    found[:bins] += (ngram_counts(texts[i : i + ROWS], bins, gram, True, True) > 0).sum(axis=0)
                n += len(texts)
        found[bins] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins + 1)), pa.array(found)], ["bin", "n"])

    rows = docs.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(bins + 1, dtype=np.int64)
    out[rows["bin"]] = rows["n"]
    return out[:bins], int(out[bins])


def idf_of(found: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)


def first_by_hash(rows: DataFrame, kind: str, most: int, most_kinds: int = MOST_LANGS) -> DataFrame:
    """doc_id, kind of at most `most` ids of each kind, those with the least hashes of doc_id. Raises ValueError where there are more than `most_kinds` kinds.

    A cut of the hashes, from how many ids a kind has about, leaves about twice as many before a window ranks them, so no task sees more, however large the table.
    """
    counts = rows.groupBy(kind).agg(F.approx_count_distinct("doc_id").alias("n")).limit(most_kinds + 1).collect()
    if len(counts) > most_kinds:
        raise ValueError(f"more than {most_kinds} values of {kind}")
    if not counts:
        return rows.select("doc_id", kind)
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r[kind], (2 * most + 50) / r["n"])]), F.col(kind))
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    near = rows.filter(hashed / float(1 << 53) < share).select("doc_id", kind).distinct()
    first = W.partitionBy(kind).orderBy(hashed, "doc_id")
    return near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).select("doc_id", kind)


def k_means(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids; begun with rows far from each other, so the result is always the same."""
    picked = [int((rows @ unit(rows.sum(axis=0, keepdims=True)).T).argmax())]
    while len(picked) < min(k, len(rows)):
        picked.append(int((rows @ rows[picked].T).max(axis=1).argmin()))
    out = rows[picked]
    for _ in range(rounds):
        own = (rows @ out.T).argmax(axis=1)
        new = unit(np.stack([rows[own == j].sum(axis=0) if (own == j).any() else out[j] for j in range(len(out))]))
        if np.allclose(new, out):
            break
        out = new
    return out


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    least: np.ndarray  # of each centroid: the cosine below which a text is rejected


def cosines_of(texts: list[str], idf: np.ndarray, centroids: np.ndarray, gram: int = GRAM) -> np.ndarray:
    return snapped(tf_idf(ngram_counts(texts, len(idf), gram, True, True), idf), GRID) @ centroids.T


def fitted(docs: DataFrame, bins: int = BINS, gram: int = GRAM, centroids: int = CENTROIDS, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> Model | None:
    """A model from docs (doc_id, text, lang); None if no text has a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found, n = document_frequencies(known, bins, gram)
    idf = idf_of(found, n)
    ids = first_by_hash(known.select("doc_id", "lang"), "lang", per_lang, most_langs)
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])  # per_lang x most_langs ids at most
    one = sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # a row for each id

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        texts = rows["text"].tolist()
        own = tf_idf(np.concatenate([ngram_counts(texts[i : i + ROWS], bins, gram, True, True) for i in range(0, len(texts), ROWS)]), idf)
        made = snapped(k_means(own, centroids), GRID)
        near = (snapped(own, GRID) @ made.T).max(axis=1)
        return pd.DataFrame({"lang": str(rows["lang"].iloc[0]), "k": range(len(made)), "centroid": [x.tobytes() for x in made], "least": float(np.quantile(near, REJECTED_SHARE))})

    rows = one.groupBy("lang").applyInPandas(fit, "lang string, k int, centroid binary, least double").orderBy("lang", "k").toPandas()  # a few for each language
    if not len(rows):
        return None
    return Model(idf, np.frombuffer(b"".join(rows["centroid"]), dtype=np.float64).reshape(len(rows), -1), rows["lang"].tolist(), rows["least"].to_numpy())


def predicted(docs: DataFrame, model: Model | None, gram: int = GRAM) -> DataFrame:
    """doc_id, lang_pred, score (the cosine with the nearest centroid), rejected for every row of docs (doc_id, text)."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for batch in batches:
            for part, texts in slices(batch):
                langs, scores, rejected = [], [], []
                for i in range(0, len(texts), ROWS):
                    own = texts[i : i + ROWS]
                    lettered = np.array([m is not None and any(map(str.isalpha, t)) for t in own])
                    if m is None:
                        near, best = np.zeros(len(own)), np.zeros(len(own), dtype=np.int64)
                    else:
                        cosines = cosines_of(own, m.idf, m.centroids, gram)
                        best = cosines.argmax(axis=1)
                        near = np.where(lettered, np.clip(cosines[np.arange(len(own)), best], 0, 1), 0).astype(np.float64)
                    langs += [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                    scores.append(near)
                    rejected += [not ok or x < m.least[b] for b, ok, x in zip(best.tolist(), lettered.tolist(), near.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op10_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fitted(docs.filter(~held_out()))
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
