"""Near-duplicates by SimHash fingerprints, with pigeonring filtering of the candidates.

Take a fingerprint as a ring of 16 segments of 4 bits. If two differ in at most 2 bits, then some segment starts a chain around
the ring whose first l segments differ in at most 2 l / 16 bits, for every l: none
in the first 7, at most 1 in the first 15. So fingerprints are grouped by each start and its 7 segments
(28 bits), and pairs in a group are kept when the longer chains hold too, before all 64 bits are compared.

Equal fingerprints are one node from the outset, so copies cost nothing. Groups of up to `most` fingerprints are compared
within a row; larger ones that hold over a thousandth of all fingerprints are known before anything is dealt by group. The members of larger groups, which occur among many near copies, are linked exactly without pairs: each is filed under itself and the 64 fingerprints one bit away;
two that differ in at most 2 bits share such a file, all in a file differ in at most 2 bits, and a file holds 65 at most.

Null and empty texts, and texts of white space alone, have fingerprint zero and are linked like any other. Null doc_ids stay; they never name a component unless nothing else is in it (then null).
Repeated rows stay. An empty table gives no rows; other columns are left out. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import resemblance
from gridloom.llm._shared import HOT, documents, dropped, met, slices, staged, starts_of, unused
from gridloom.llm.components import components

SEGMENTS, BITS, WITHIN = 16, 4, 2
#: Characters whose shingles' bits are held at a time.
PART_CHARS = 300_000
#: Segments that must agree fully: the longest chain that may hold no difference.
EXACT = -(-SEGMENTS // WITHIN) - 1


def fingerprint(texts: list[str]) -> np.ndarray:
    """Of each text: bit i is set if it is in over half of the hashes of the 3-word shingles."""
    hashes, counts = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: only A-Z change, only ASCII space parts
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:]))) if len(words) > 2 else [b" ".join(words)] * bool(words)
        hashes.extend(map(xxhash.xxh64_intdigest, shingles, repeat(42)))
        counts.append(len(shingles))
    lens, out = np.array(counts, dtype=np.int64), np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(lens)
    if len(some):
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, starts_of(lens[some]), axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * votes > lens[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, limit=PART_CHARS):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fingerprint(texts).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _turned(fp: Column, segments: Column) -> Column:
    """The ring with another first segment."""
    by = segments * BITS
    return F.when(segments == 0, fp).otherwise(F.call_function("shiftleft", fp, by).bitwiseOR(F.call_function("shiftrightunsigned", fp, 64 - by)))


def _apart(a: Column, b: Column, segments: int) -> Column:
    """Bits that differ in a chain of the first segments."""
    x = a.bitwiseXOR(b)
    return F.bit_count(F.shiftrightunsigned(x, 64 - segments * BITS) if segments < SEGMENTS else x)


def links(nodes: DataFrame, most: int = 64) -> DataFrame:
    """Links a, b between distinct fingerprints (nodes: fp), enough to join all that differ in at most 2 bits."""
    starts = F.array(*[F.lit(i) for i in range(SEGMENTS)])
    keyed = nodes.select("fp", F.explode(starts).alias("start"))
    keyed = keyed.select("fp", "start", F.shiftrightunsigned(_turned(F.col("fp"), F.col("start")), 64 - EXACT * BITS).alias("chain"))
    sizes, _ = staged(keyed.groupBy("start", "chain").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    over = (F.col("n") > most) & (F.col("n") * HOT > nodes.count())
    hot = F.broadcast(sizes.filter(over).select("start", "chain"))  # less than HOT for each start
    shared = keyed.join(hot, ["start", "chain"], "left_anti").join(sizes.filter(~over), ["start", "chain"])

    def pairs(row: Column, start: Column) -> Column:
        turned = F.transform(row, lambda f: F.struct(f.alias("f"), _turned(f, start).alias("t")))
        # the chains of 8 to 15 segments may hold 1 difference: that of 15 bounds all of them
        near = lambda x, y: (x["f"] < y["f"]) & (_apart(x["t"], y["t"], SEGMENTS - 1) <= WITHIN * (SEGMENTS - 1) // SEGMENTS) & (_apart(x["t"], y["t"], SEGMENTS) <= WITHIN)
        return F.flatten(F.transform(turned, lambda x: F.transform(F.filter(turned, lambda y: near(x, y)), lambda y: F.struct(x["f"].alias("a"), y["f"].alias("b")))))

    small = shared.filter(F.col("n") <= most).groupBy("start", "chain").agg(F.collect_list("fp").alias("row"))  # at most `most`
    linked = small.select(F.explode(pairs(F.col("row"), F.col("start"))).alias("p")).select("p.a", "p.b")
    large = shared.filter(F.col("n") > most).select("fp").union(keyed.join(hot, ["start", "chain"], "left_semi").select("fp")).distinct()
    files = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    filed = large.select("fp", F.explode(files).alias("file")).groupBy("file").agg(F.collect_list("fp").alias("row")).filter(F.size("row") > 1)  # at most 65
    starred = filed.select(F.array_min("row").alias("a"), F.explode("row").alias("b")).filter("a <> b")
    return linked.union(starred)


def grouped(docs: DataFrame, most: int = 64) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of every row."""
    prints, _ = staged(fingerprints(docs), "prints")
    nodes, _ = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), most))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component")).join(roots, "root").select(F.col("node").alias("fp"), "component")
    label, _ = staged(nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "labels")
    return met(prints, label, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close(nodes: DataFrame, most: int = 64) -> DataFrame:
    """Pairs a, b of nodes (node, fp) with equal fingerprints, or ones that pigeonring chains find within 2 bits; enough to join all of them."""
    spark = nodes.sparkSession
    firsts, path = staged(nodes.groupBy("fp").agg(F.min("node").alias("a")), "firsts")
    equal = met(nodes, firsts, "fp").filter("node <> a").select("a", F.col("node").alias("b"))
    linked, _ = staged(links(firsts.select("fp"), most).distinct(), "fingerprints")
    ends = [firsts.select(F.col("fp").alias(x), F.col("a").alias(f"node_{x}")) for x in "ab"]
    out, _ = staged(equal.union(met(linked, ends[0], "a").join(ends[1], "b").select("node_a", "node_b")), "close")
    dropped(spark, path)
    return out


def deduplicated(docs: DataFrame, most: int = 8) -> DataFrame:
    """docs without near copies: of each component one row stays, that of the smallest doc_id (a null one last), then node, then hash of text.

    A near copy shares 0.8 of its 5-word shingles or more. Fingerprints of these shingles and pigeonring chains give the first candidates; two bits of 64 hold
    few pairs below 0.95, so bands of least hashes add those that fingerprints leave apart. Both are decided by sketches and whole sets (resemblance.py).
    """
    spark = docs.sparkSession
    found, path = staged(resemblance.printed(docs), "prints")
    uniq, uniq_path = staged(found.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("n", "fp", "bands", "sketch")]), "nodes")
    ids, ids_path = staged(found.select("doc_id", "node"), "ids")
    dropped(spark, path)
    roots = components(resemblance.links(uniq, docs, most, close(uniq.filter("n >= 4").select("node", "fp"))))
    nodes = ids.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    node, row = unused(docs, "node"), unused(docs, "row")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first")
    first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(least).select("first.doc_id", F.col("first.node").alias(node))
    rows = ids.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    keep, _ = staged(first.join(rows, "doc_id", "left"), "keep")
    dropped(spark, uniq_path)
    dropped(spark, ids_path)
    once = docs.join(keep.filter("_rows = 1").select("doc_id").hint("shuffle_hash"), "doc_id").select(*docs.columns)
    # a doc_id of several rows, or none, doesn't tell which of them was chosen: their sets do
    several = keep.filter("_rows IS NULL OR _rows > 1").select(F.col("doc_id").alias("_id"), F.col(node).alias("_node"))
    asked = docs.filter("doc_id IS NULL").unionByName(docs.join(several.filter("_id IS NOT NULL").select(F.col("_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(*docs.columns))
    again = resemblance.marked(asked, node).join(several, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(node) == F.col("_node")))
    again = again.groupBy("doc_id", node).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.col("text"))).alias(row)).select(f"{row}.*")
    return once.unionByName(again)
