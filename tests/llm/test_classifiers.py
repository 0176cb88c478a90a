import hashlib
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import decontaminate, langid, pii, quality_knn, registry
from gridloom.llm.token_store import tokenizer_file

from .helpers import docs, held_out, wide
from .test_duplicates import jaccard_groups, plain_tiling

SF = "/root/testdata/sf0.01"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def tables():
    return {t: duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").df() for t in ("documents", "labels", "benchmark")}


def test_language_on_held_out(spark, tables):
    got = registry.QUERIES["op10_nearest_centroid"](spark, SF).toPandas().merge(tables["documents"], on="doc_id")
    assert len(got) == len(tables["documents"]) and (got["held_out"] == got["doc_id"].map(held_out)).all()
    own = got[got["held_out"]]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_cases(spark):
    words = {"en": "the house and the garden of the man ", "de": "das haus und der garten des mannes ", "fr": "la maison et le jardin de l'homme "}
    known = [(i, w * (1 + i % 5), lang) for i, (lang, w) in enumerate([(k, v) for k, v in words.items()] * 20)]
    rows = spark.createDataFrame([*known, (900, None, "en"), (901, "123 !!", "en"), (None, "the house", None), (3, words["en"], "en")], "doc_id long, text string, lang string")
    model = langid.fitted(rows.filter(~langid.held_out()))
    asked = [(1, None), (2, ""), (3, "12 ?!"), (4, "the garden"), (4, "the garden"), (None, "le jardin de la maison"), (5, "das haus " * 9000)]
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in langid.predicted(wide(spark, asked), model).collect()))
    assert got == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    assert langid.fitted(rows.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predicted(wide(spark, asked), None).collect()} == {"und"}
    assert langid.predicted(docs(spark, []), model).count() == 0


def test_k_means_is_bounded():
    rows = langid.unit(np.random.default_rng(0).random((50, 8)).astype(np.float32))
    made = langid.k_means(rows, 4)
    assert made.shape == (4, 8) and np.allclose((made**2).sum(axis=1), 1, atol=1e-5)
    assert len(langid.k_means(rows[:2], 4)) == 2


def test_quality_on_held_out(spark, tables):
    got = registry.QUERIES["op8_lsa_neighbours"](spark, SF).toPandas()
    assert len(got) == len(tables["documents"]) and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    own = got[got["held_out"]].merge(tables["labels"], on="doc_id")
    assert (own["quality"] == own["predicted"]).mean() > 0.95


def test_votes_are_exact():
    texts = [f"plain words of line {i} and more of it" for i in range(40)] + [f"x### y%%% {i} $$$" for i in range(40)]
    counts = quality_knn.counts_of(texts)
    idf = langid.idf_of((counts > 0).sum(axis=0), len(texts))
    axes = quality_knn.snapped(np.linalg.svd(quality_knn.weighted(counts, idf), full_matrices=False)[2][:8].T, quality_knn.TERM_GRID)
    m = quality_knn.Model(idf, axes, quality_knn.projected(counts, idf, axes), np.repeat([1.0, 0.0], 40))
    asked = ["", "words of line 7", "a### b$$$ c%%%"]
    got = quality_knn.votes(asked, m)
    for text, score in zip(asked, got, strict=True):
        cosines = [float(quality_knn.projected(quality_knn.counts_of([text]), idf, axes)[0] @ v) for v in m.vectors]
        near = sorted(range(80), key=lambda i: (-cosines[i], i))[: quality_knn.NEIGHBOURS]
        weight = [min(max(cosines[i], 1e-3), 1) ** quality_knn.POWER for i in near]
        assert score == pytest.approx(sum(w * m.labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight), abs=1e-12)
    assert got[1] > 0.9 and got[2] < 0.1 and 0 <= got[0] <= 1


def plain_grams(text, n, bins):
    """Counts of hashed runs of n bytes, counted one by one."""
    data = [48 if 48 <= b < 58 else b for b in b" " + text.encode() + b" "]
    out = np.zeros(bins)
    for run, k in Counter(zip(*(data[j:] for j in range(n)), strict=False)).items():
        code = int.from_bytes(bytes(run), "big") * 0x9E3779B97F4A7C15 % 2**64
        out[code >> 64 - (bins - 1).bit_length()] += k
    return out


def plain_quality(text):
    words, lines = text.split(), [x for x in text.split("\n") if x]
    return np.append(plain_grams(text, 2, quality_knn.BINS), [sum(a == b for a, b in zip(words, words[1:], strict=False)), len(lines) - len(set(lines)), len(lines)])


def plain_unit(rows):
    norm = np.sqrt((rows**2).sum(axis=-1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def test_quality_query_by_brute_force(spark, tables):
    """The fit and every document's vote anew in plain numpy; every labelled row is in the sample here."""
    docs_of = {i: t or "" for i, t in zip(tables["documents"]["doc_id"], tables["documents"]["text"], strict=True)}
    counts = {i: plain_quality(t) for i, t in docs_of.items()}
    every = np.stack(list(counts.values()))
    idf = np.log((1 + len(every)) / (1 + (every > 0).sum(axis=0))) + 1
    idf[quality_knn.BINS :] *= quality_knn.BOOST
    labels = tables["labels"].groupby("doc_id")["quality"].min()
    known = sorted(i for i in labels.index if not held_out(i) and i in counts)
    terms = lambda rows: plain_unit(np.sqrt(rows) * idf)
    axes = np.linalg.svd(terms(np.stack([counts[i] for i in known])), full_matrices=False)[2][: quality_knn.DIMENSIONS].T
    vectors, own = plain_unit(terms(np.stack([counts[i] for i in known])) @ axes), labels.loc[known].to_numpy()
    got = registry.QUERIES["op8_lsa_neighbours"](spark, SF).toPandas().set_index("doc_id")
    far, flips = [], 0
    for i, row in counts.items():
        cosines = vectors @ plain_unit(terms(row[None]) @ axes)[0]
        near = sorted(range(len(known)), key=lambda j: (-round(cosines[j], 6), j))[: quality_knn.NEIGHBOURS]
        weight = np.clip(cosines[near], 1e-3, 1) ** quality_knn.POWER
        far.append(abs((weight * own[near]).sum() / weight.sum() - got.loc[i, "score"]))
        flips += ((weight * own[near]).sum() / weight.sum() >= 0.3) != (got.loc[i, "predicted"] == 1)
    assert len(got) == len(counts) and np.quantile(far, 0.98) < 1e-3 and flips <= 2


def plain_centroids(rows, k):
    picked = [int((rows @ rows.sum(axis=0)).argmax())]
    while len(picked) < min(k, len(rows)):
        picked.append(min(range(len(rows)), key=lambda i: max(float(rows[i] @ rows[j]) for j in picked)))
    out = rows[picked]
    for _ in range(20):
        own = (rows @ out.T).argmax(axis=1)
        out = np.stack([plain_unit(rows[own == j].sum(axis=0)) if (own == j).any() else out[j] for j in range(len(out))])
    return out


def test_language_query_by_brute_force(spark, tables):
    """The fit and every document's nearest centroid anew in plain numpy."""
    rows = [(i, "" if t is None else t, lang) for i, t, lang in tables["documents"][["doc_id", "text", "lang"]].itertuples(index=False, name=None)]
    counts = {i: plain_grams(re.sub(r"[\x00-@\[-`{-\x7f]+", " ", f" {t} ").strip(" ").translate(ASCII_LOWER), langid.GRAM, langid.BINS) for i, t, _ in rows}
    known = sorted((i, lang) for i, t, lang in rows if not held_out(i) and isinstance(lang, str) and any(map(str.isalpha, t)))
    seen = np.stack([counts[i] for i, _ in known])
    idf = np.log((1 + len(seen)) / (1 + (seen > 0).sum(axis=0))) + 1
    vectors = plain_unit(np.log1p(seen) * idf)
    order = sorted(range(len(known)), key=lambda k: xxhash.xxh64_intdigest(struct.pack("<q", known[k][0]), 42) >> 11)
    sample = {lang: sorted([k for k in order if known[k][1] == lang][: langid.PER_LANG]) for lang in sorted({x for _, x in known})}
    made = {lang: plain_centroids(vectors[at], langid.CENTROIDS) for lang, at in sample.items()}
    got = registry.QUERIES["op10_nearest_centroid"](spark, SF).toPandas().set_index("doc_id")
    far, other = [], 0
    for i, t, _ in rows:
        best = max(((float((c @ plain_unit(np.log1p(counts[i]) * idf)).max()), lang) for lang, c in made.items())) if any(map(str.isalpha, t)) else (0.0, "und")
        far.append(abs(best[0] - got.loc[i, "score"]))
        other += best[1] != got.loc[i, "lang_pred"]
    assert len(got) == len(rows) and np.quantile(far, 0.98) < 1e-3 and other <= 2


def test_scores_do_not_depend_on_blocks(spark, tables):
    """Equal texts have equal scores, however the rows are dealt."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model, langs = quality_knn.fitted(documents.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")), langid.fitted(documents.filter(~langid.held_out()))
    scores = []
    for parts in (1, 7):
        dealt = documents.union(documents.limit(50)).repartition(parts)
        scores.append({(r["doc_id"], r["score"]) for r in quality_knn.rejecting(dealt, model).collect()} | {(-1 - r["doc_id"], r["score"], r["lang_pred"]) for r in langid.predicted(dealt, langs).collect()})
    assert scores[0] == scores[1] and len(scores[0]) == 2 * len(tables["documents"])


def test_sample_is_of_distinct_ids(spark):
    rows = spark.createDataFrame([(i, k) for i in range(300) for k in ("a", "b") for _ in range(6)] + [(i, f"rare{i}") for i in range(40)], "doc_id long, lang string")
    got = [(r["doc_id"], r["lang"]) for r in langid.first_by_hash(rows, "lang", 40).collect()]
    rank = sorted(range(300), key=lambda i: xxhash.xxh64_intdigest(struct.pack("<q", i), 42) >> 11)
    assert sorted(got) == sorted([(i, k) for k in "ab" for i in rank[:40]] + [(i, f"rare{i}") for i in range(40)])
    with pytest.raises(ValueError):  # no language is left out in silence
        langid.first_by_hash(rows, "lang", 40, 41)


def test_every_language_is_learned(spark):
    """Three hundred languages, most of two texts, beside one that has nearly all rows."""
    word = lambda k: "".join(chr(0x4E00 + 7 * k + j) for j in range(6))
    rows = [(3 * i + j, f"{word(i)} {word(i)} x{j}", f"l{i}") for i in range(300) for j in (0, 1)] + [(10_000 + i, "plain english words", "en") for i in range(3000)]
    model = langid.fitted(docs(spark, rows, "doc_id long, text string, lang string"))
    assert set(model.langs) == {f"l{i}" for i in range(300)} | {"en"}
    asked = docs(spark, [(i, word(i)) for i in range(300)])
    assert sum(r["lang_pred"] == f"l{r['doc_id']}" for r in langid.predicted(asked, model).collect()) >= 295


def test_quality_cases(spark):
    rows = [(i, f"good words of the line {i} and more") for i in range(30)] + [(100 + i, "bad### bad%%% $$$") for i in range(30)]
    labels = [(i, 1, 0) for i, _ in rows[:30]] + [(i, 0, 0) for i, _ in rows[30:]] + [(0, 1, 0), (5000, 1, 0), (None, 0, 0), (7, None, 0)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_knn.fitted(docs(spark, rows), given)
    asked = [(1, None), (2, ""), (3, "worse### thing$$$ %%%"), (3, "worse### thing$$$ %%%"), (None, "good words of a line"), (4, "good words of the line " * 5000)]
    got = quality_knn.rejecting(wide(spark, asked), model)
    assert got.columns[-1] == "score" and got.columns.count("score") == 1
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert got.count() == 6 and scores[3] < 0.3 and scores[None] >= 0.3 and scores[4] >= 0.3
    assert quality_knn.fitted(docs(spark, rows), given.limit(0)) is None
    assert {r["score"] for r in quality_knn.rejecting(docs(spark, asked), None).collect()} == {1.0}
    assert quality_knn.rejecting(docs(spark, []), model).count() == 0


def covers(doc, item, least=decontaminate.LEAST):
    """Whether half of an item is tiled, by trying all places."""
    runs = lambda words: {tuple(words[k : k + least]) for k in range(len(words) - least + 1)}
    return bool(runs(doc) & runs(item)) and plain_tiling(doc, item, least) >= decontaminate.THRESHOLD * len(item)


def test_pipeline_against_brute_force(spark, tables):
    """Each stage done anew without Spark, but for the classifier's model, which has tests of its own."""
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert first.schema == spark.read.parquet(f"{SF}/documents.parquet").schema
    left = {r["doc_id"]: r["text"] for r in first.collect()}
    ids = sorted(left)
    left = {ids[k]: left[ids[k]] for k in set(jaccard_groups([left[i] for i in ids]))}
    items = [decontaminate._words(t.lower()) for t in tables["benchmark"]["text"]]
    left = {i: pii.redacted(t, pii.spans(t)) for i, t in left.items() if not any(covers(decontaminate._words(t.lower()), x) for x in items)}
    assert not any(t in d for d in left.values() for t in tables["benchmark"]["text"])
    theirs = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = {i: hashlib.sha256(",".join(map(str, theirs.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in left.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == want and len(got) == len(want)
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest() for r in got)


def test_stages_of_nothing(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
