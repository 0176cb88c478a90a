"""Links between documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Simhash can't do this: at 0.8, 64 bits differ in about 10, and chains for 17 bits hold nearly all pairs. So candidates are those that agree in a band of least
hashes: BANDS bands of ROWS each. A pair at similarity s agrees in one with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9997 at 0.8, 0.99999 at 0.85; below, agreement decides nothing.
Each set has a sketch as well, a bit of each of 1024 other least hashes, in which a pair at s differs in 512 (1 - s) bits about. A pair that differs in SURE or fewer is similar and one that differs in over NEVER is not
(either is wrong for a pair at 0.8 itself with a probability of 5 in a million, and beyond 0.05 from it with less than one in a billion); what lies between is compared by its whole sets, which are made again from the texts of these documents alone.
So bands and sketches, some 300 bytes for each distinct set, are what is stored and shuffled, and neither texts nor sets of documents that are like no other.

Pairs that simhash fingerprints have found are decided first, and bands pair only what these leave apart.
Groups of over `most` documents are not paired. Each member is compared with the leader of its group, the member with the largest groups in all: near copies of a text share most bands with that text, so groups of one family have the same leader, and it is near most of them. While a group has many members outside its largest component, a few of these lead it in turn, so that what is near any of them joins too.
At last the members still outside are compared with all others, by sketches, each pair in one of its groups. So a group of near copies grows with its size, while no candidate that could join two components is left out.
Sets are kept as 32-bit hashes, which move a similarity by about n / 2**32; a set of under 4 has no other at 0.8, and equal sets are told by 64 bits each.
A large group of documents that agree in a band and are yet all unlike each other still costs the square of its size, in comparisons of sketches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm._shared import HOT, dropped, met, released, slices, staged, starts_of
from gridloom.llm.components import components
from gridloom.llm.decontaminate import bit_table

WORDS, BANDS, ROWS = 5, 20, 5
#: The least similarity, as a fraction.
LEAST, OF = 4, 5
#: Odd factors of the hashes, one for each row of each band.
FACTORS = np.random.default_rng(42).integers(1 << 62, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
SKETCH_FACTORS = np.random.default_rng(43).integers(1 << 62, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
LONGS = len(SKETCH_FACTORS) // 64
#: Bits within which sketches tell a similar pair, and beyond which another; 102.4 is 0.8, with a deviation of 9.6.
SURE, NEVER = 60, 145
#: Outsiders of a group that lead it in one turn, and comparisons for each of its rows that are done at once.
LEADERS, LINEAR = 4, 16
#: Characters, and shingles, that are held at a time.
PART_CHARS, PART = 300_000, 50_000


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the runs of five words, or of all words where they are fewer; none where there is no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    runs = set(map(b" ".join, zip(*(words[i:] for i in range(WORDS))))) if len(words) >= WORDS else {b" ".join(words)} if words else set()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), dtype=np.uint64, count=len(runs))).view(np.int64)


def _node(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def printed(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of the set, equal for equal sets), n, fp (simhash of the set, as a long), bands, sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for part, texts in slices(batch, limit=PART_CHARS):
                own = [shingles(t) for t in texts]
                nodes = np.array(list(map(_node, own)), dtype=np.uint64).view(np.int64)
                prints = _prints(own)
                own = [np.unique(x.astype(np.int32)).view(np.uint32).astype(np.uint64) for x in own]
                lens = np.array([len(x) for x in own], dtype=np.int64)
                bands, sketch = np.zeros((len(own), BANDS), dtype=np.int64), np.zeros((len(own), LONGS), dtype=np.int64)
                step = np.cumsum(lens) // PART
                for k in np.unique(step[lens > 0]):
                    rows = np.flatnonzero((step == k) & (lens > 0))
                    flat, starts = np.concatenate([own[i] for i in rows]), starts_of(lens[rows])
                    bands[rows], sketch[rows] = _bands(flat, starts), _sketch(flat, starts)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (bands, sketch)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(nodes), pa.array(lens.astype(np.int32)), pa.array(prints), *lists], ["doc_id", "node", "n", "fp", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n int, fp long, bands array<long>, sketch array<long>")


def _prints(own: list[np.ndarray]) -> np.ndarray:
    """For each set of hashes its simhash: bit i is set if it is in over half of them; 0 for an empty one."""
    out = np.zeros(len(own), dtype=np.int64)
    for i, x in enumerate(own):
        votes = sum((np.unpackbits(x[k : k + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(x), PART)), np.zeros(64, dtype=np.int64))
        out[i] = np.packbits(2 * votes > len(x), bitorder="little").view("<i8")[0]
    return out


def _bands(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of shingles, a key for each band of its least hashes."""
    mix, keys = np.uint64(0x9E3779B97F4A7C15), []
    for band, factors in enumerate(FACTORS):
        key = np.full(len(starts), band, dtype=np.uint64)
        for factor in factors:
            key = (key ^ np.minimum.reduceat(flat * factor >> np.uint64(32), starts)) * mix
            key ^= key >> np.uint64(29)
        keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def _sketch(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of shingles, a bit of each of its least hashes."""
    bits = np.empty((len(SKETCH_FACTORS), len(starts)), dtype=np.uint8)
    for i, factor in enumerate(SKETCH_FACTORS):
        bits[i] = np.minimum.reduceat(flat * factor >> np.uint64(24), starts).astype(np.uint8) & 1
    return np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.int64)


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tokens (the set) of nodes (node), made from the texts; a bit table of the nodes, of a fixed size at most, leaves out nearly all others where they are read."""
    bits_of, bits = bit_table(nodes.select(F.col("node").alias("seed")))
    sent = docs.sparkSession.sparkContext.broadcast(bits_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        probe = sent.value
        for batch in batches:
            for _, texts in slices(batch, limit=PART_CHARS):
                found, own = [], []
                for text in texts:
                    x = shingles(text)
                    node = _node(x)
                    slot = node >> (64 - bits)
                    if probe[slot >> 3] >> (slot & 7) & 1:
                        found.append(node)
                        own.append(np.unique(x.astype(np.int32)))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(found, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, dtype=np.int32)))], ["node", "tokens"])

    made = docs.select("text").mapInArrow(run, "node long, tokens array<int>")
    return made.join(nodes, "node", "left_semi").groupBy("node").agg(F.any_value("tokens").alias("tokens"))  # copies are one before they are shuffled


def marked(docs: DataFrame, name: str) -> DataFrame:
    """docs with the node of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, limit=PART_CHARS):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array([_node(shingles(t)) for t in texts], dtype=np.uint64).view(np.int64))], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _sizes_fit(a: Column, b: Column) -> Column:
    return (OF * a.cast("long") >= LEAST * b.cast("long")) & (OF * b.cast("long") >= LEAST * a.cast("long"))


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(LONGS)), F.lit(0))


def decided(told: DataFrame, docs: DataFrame) -> DataFrame:
    """Of told (a, b, n_a, n_b, apart), the pairs a, b that are similar."""
    spark = docs.sparkSession
    told, path = staged(told.filter(F.col("apart") <= NEVER).distinct(), "told")
    sure, unsure = told.filter(F.col("apart") <= SURE).select("a", "b"), told.filter(F.col("apart") > SURE).drop("apart")
    nodes, nodes_path = staged(unsure.select(F.col("a").alias("node")).union(unsure.select("b")).distinct(), "unsure")
    if nodes.isEmpty():
        return sure
    own, own_path = staged(sets_of(docs, nodes), "sets")
    left, right = (own.select(F.col("node").alias(x), F.col("tokens").alias(f"t_{x}")) for x in "ab")
    both = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    near = met(unsure, left, "a").join(right, "b").filter((OF + LEAST) * both >= LEAST * (F.col("n_a").cast("long") + F.col("n_b")))
    out, _ = staged(sure.union(near.select("a", "b")), "similar")
    for p in (path, nodes_path, own_path):
        dropped(spark, p)
    return out


def links(uniq: DataFrame, docs: DataFrame, most: int = 8, close: DataFrame | None = None) -> DataFrame:
    """Links a, b between nodes of uniq (node, n, bands, sketch: once each, of docs) that join all that are similar; each is of a pair that is.

    `close` (a, b) are pairs that something else has found; they are decided first, and bands then pair only what these leave apart.
    """
    spark, paths = docs.sparkSession, []
    uniq = uniq.filter("n >= 4")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = staged(df, name)
        paths.append(path)
        return df

    close = uniq.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if close is None else close
    near = kept(_sketched(close, uniq).filter(F.col("apart") <= NEVER), "close")
    rooted = _rooted(uniq.select("node", "n", "bands"), components(near.filter(F.col("apart") <= SURE)))
    keyed = rooted.select("node", "n", "root", F.explode(F.array_distinct("bands")).alias("token"))
    groups = kept(keyed.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1"), "groups")
    is_hot = F.col("members") * HOT > groups.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    hot = F.broadcast(groups.filter(is_hot))  # less than HOT rows
    shared = kept(keyed.join(hot, "token").unionByName(keyed.join(hot.select("token"), "token", "left_anti").join(groups.filter(~is_hot), "token")), "shared")

    small = shared.filter(F.col("members") <= most).groupBy("token").agg(F.collect_list(F.struct("node", "n", "root")).alias("row"))  # at most `most`
    apart = lambda x, y: (x["node"] < y["node"]) & (x["root"] != y["root"]) & _sizes_fit(x["n"], y["n"])
    paired = F.flatten(F.transform("row", lambda x: F.transform(F.filter("row", lambda y: apart(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    large = shared.filter(F.col("members") > most)
    large = kept(large.join(large.groupBy("node").agg(F.sum("members").alias("weight")), "node").select("token", "node", "n", "root", "weight"), "large")
    heaviest = F.max_by(F.struct(F.col("node").alias("a"), F.col("root").alias("root_a")), F.struct("weight", "node")).alias("l")
    star = lambda rows, leaders: met(rows, leaders.select("token", "l.a", "l.root_a"), "token").filter("root <> root_a").select("a", F.col("node").alias("b"))
    first = _sketched(small.select(F.explode(paired).alias("p")).select("p.a", "p.b").union(star(large, large.groupBy("token").agg(heaviest))), uniq)
    out = [decided(near.unionByName(first), docs)]
    if large.isEmpty():
        return _without(paths, out[0])

    large, before, turn = large.drop("root"), None, 0
    while True:
        parted = kept(_rooted(large, components(reduce(DataFrame.union, out))), "parted")
        shares = parted.groupBy("token", "root").agg(F.count("*").alias("own"))
        largest = shares.groupBy("token").agg(F.max_by("root", F.struct("own", "root")).alias("largest"), F.max("own").alias("most"), F.sum("own").alias("members"), F.count("*").alias("roots"))
        largest = kept(largest.filter("roots > 1"), "largest")
        rows, pairs = largest.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum((F.col("members") - F.col("most")) * F.col("members").cast("double")), F.lit(0.0))).first()
        if not rows:
            return _without(paths, reduce(DataFrame.union, out))
        placed = met(parted, largest.select("token", "largest"), "token")
        outside = placed.filter("root <> largest")
        if pairs <= LINEAR * rows or before is not None and pairs > 0.9 * before:
            break
        # some outsiders of each group lead it in turn, until those that are left, times their groups, are in proportion to the groups
        before, turn = pairs, turn + 1
        seat = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(LEADERS))
        out.append(decided(_sketched(star(parted, outside.groupBy("token", seat.alias("_seat")).agg(heaviest)), uniq), docs))

    open_ = kept(placed.join(uniq.select("node", "sketch", "bands"), "node"), "open")
    outside = open_.filter("root <> largest").select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("sketch").alias("s_a"), F.col("bands").alias("bands_a"))
    once = F.array_min(F.array_intersect("bands_a", "bands")) == F.col("token")  # a pair that meets in a small group is decided, and one of a closed group has one root
    rest = open_.join(outside, "token").filter((F.col("root") != F.col("root_a")) & _sizes_fit(F.col("n"), F.col("n_a")))
    rest = rest.select("a", F.col("node").alias("b"), "n_a", F.col("n").alias("n_b"), _apart("s_a", "sketch").alias("apart"), once.alias("once")).filter((F.col("apart") <= NEVER) & F.col("once")).drop("once")
    turned = F.col("a") > F.col("b")
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), "apart")
    return _without(paths, reduce(DataFrame.union, [*out, decided(rest, docs)]))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with the root of each, itself where roots (node, root) has none."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _sketched(pairs: DataFrame, uniq: DataFrame) -> DataFrame:
    """pairs (a, b; also repeated) once each whose sizes allow 0.8, with n_a, n_b, apart."""
    pairs, _ = staged(pairs.distinct(), "pairs")
    side = lambda x: uniq.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    told = met(pairs, side("a"), "a").join(side("b"), "b").filter(_sizes_fit(F.col("n_a"), F.col("n_b")))
    return told.select("a", "b", "n_a", "n_b", _apart("s_a", "s_b").alias("apart"))


def _without(paths: list[str], out: DataFrame) -> DataFrame:
    """out, which is staged, once tables that it was made from are deleted."""
    for p in paths:
        dropped(out.sparkSession, p)
    return out
